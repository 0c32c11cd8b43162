"""Scans and sinks: driver tables as load panels, delimited files, JSON reports, digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import truncated

QUARTERS = ["q15", "q30", "q45", "q60"]
#: Users with neighbouring ids share a site, so that there are more sites where there are more users.
SITE_USERS = 10

#: Schema of a raw hourly file. Columns from `temperature` on may be missing values.
RAW_SCHEMA = T.StructType(
    [T.StructField("date_key", T.LongType()), T.StructField("hour", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in [*QUARTERS, "avg_power", "production", "temperature", "wind", "humidity", "rain"]]
)
REQUIRED = [f.name for f in RAW_SCHEMA.fields]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, needed: list[str], exactly: bool = False) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    extra = [c for c in df.columns if c not in needed] if exactly else []
    if missing or extra:
        raise ValueError(f"columns missing: {missing}; not expected: {extra}")
    return df


def read_hourly_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw hourly file with a stated schema; no inference, so the scan reads the file once."""
    header = spark.read.option("header", True).csv(path).columns
    require_columns(spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in header])), REQUIRED)
    kinds = {f.name: f.dataType for f in RAW_SCHEMA.fields}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    return spark.read.option("header", True).option("nanValue", "NaN").schema(schema).csv(path).select(*REQUIRED)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    """One JSON document, wherever Spark can read it."""
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file's bytes, computed by the executors."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def table_digest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, n, digest): a hash of each key's rows that doesn't depend on their order.

    Sum and exclusive or of 60-bit row hashes: combined before the shuffle, in constant memory for each key.
    """
    row = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)))
    half = [F.conv(F.substring(row, at, 15), 16, 10).cast("long") for at in (1, 17)]
    found = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(half[0].cast("decimal(20,0)")).alias("total"), F.bit_xor(half[1]).alias("odd"))
    return found.select(key, "n", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "total", "odd"))), 256).alias("digest"))


def site_of(user: str = "user_id") -> Column:
    return F.expr(f"{user} div {SITE_USERS}")


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly load of each site from events: quarter sums, their mean, production; absent hours are zero.

    One aggregation before the shuffle by (site, hour), and a grid joined to it. All purchases count as production.
    """
    events = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    quarter = F.floor(F.minute("ts") / 15)
    sums = [F.round(F.sum(F.when(quarter == i, F.col("value"))), 2).alias(c) for i, c in enumerate(QUARTERS)]
    made = F.when(F.col("event_type") == "purchase", F.col("value"))
    found = events.groupBy(site_of().alias("series_id"), truncated("hour", F.col("ts")).alias("ts")).agg(*sums, F.round(F.sum(made), 2).alias("production"))
    span = events.agg(truncated("day", F.min("ts")).alias("lo"), (truncated("day", F.max("ts")) + F.expr("interval 23 hours")).alias("hi"))
    sites = events.select(site_of().alias("series_id")).distinct().crossJoin(F.broadcast(span))  # one row
    grid = sites.select("series_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("ts"))
    filled = grid.join(found, ["series_id", "ts"], "left").na.fill(0.0, [*QUARTERS, "production"])
    # the mean in whole hundredths, rounded down: the same in any engine
    cents = sum(F.round(F.col(q) * 100).cast("long") for q in QUARTERS)
    return filled.select("series_id", "ts", *QUARTERS, (F.floor(cents / 4) / 100).alias("avg_power"), "production")


def gapped_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel without its 13th and 15th day, which stay real gaps."""
    return event_panel(spark, sf_dir).where("day(ts) not in (13, 15)")


def raw_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a raw file would give it: date key and hour, with hours out of range on two dates."""
    panel = event_panel(spark, sf_dir)
    hour = F.hour("ts").cast("double")
    broken = F.when(F.dayofmonth("ts").isin(13, 15) & (F.hour("ts") >= 20), hour + 24).otherwise(hour)
    return panel.select("series_id", F.date_format("ts", "yyyyMMdd").cast("long").alias("date_key"), broken.alias("hour"), *QUARTERS, "avg_power", "production")


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order value by priority, the long history for month folds."""
    orders = table(spark, sf_dir, "orders")
    day = truncated("day", F.col("o_orderdate"))
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), day.alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, day, load, n): order value in millions and number of orders by priority, for every day; none: 0."""
    found = order_panel(spark, sf_dir)
    span = found.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = found.select("series_id").distinct().crossJoin(F.broadcast(span)).select("series_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))  # one row
    joined = days.join(found, ["series_id", "day"], "left")
    return joined.select("series_id", "day", F.round(F.coalesce("total", F.lit(0.0)) / 1e6, 8).alias("load"), F.coalesce("n", F.lit(0)).alias("n"))
