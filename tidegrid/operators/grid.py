"""Validation, cleaning and the gap-aware hourly grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import six
from ..sources import QUARTERS

VALUES = [*QUARTERS, "avg_power", "production"]


def as_of(raw: DataFrame, date_key: int, hour: int) -> DataFrame:
    """Rows observed by the end of an hour. It goes before any other check, so that later faults can't reach back;
    plain comparisons of stored columns, which the scan takes over."""
    return raw.where((F.col("date_key") < date_key) | ((F.col("date_key") == date_key) & (F.col("hour") <= hour)))


def with_date(raw: DataFrame) -> DataFrame:
    """Adds date; a key that is no date gives null, which validate() refuses."""
    return raw.withColumn("date", F.try_to_date(F.col("date_key").cast("string"), "yyyyMMdd"))


def bad_hour() -> F.Column:
    hour = F.col("hour")
    return F.coalesce(~(hour.between(0, 23) & (hour % 1 == 0)), F.lit(True))


def bad_dates(raw: DataFrame) -> DataFrame:
    return raw.where(bad_hour()).select("series_id", "date_key").distinct()


def drop_bad_dates(raw: DataFrame) -> DataFrame:
    """Without every date of a series on which some hour is out of 0..23, fractional or missing."""
    return raw.join(bad_dates(raw), ["series_id", "date_key"], "left_anti")


def with_hours(raw: DataFrame) -> DataFrame:
    stamp = with_date(raw).withColumn("ts", F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour").cast("int")))
    return stamp.select("series_id", "ts", *(F.col(c).cast("double").alias(c) for c in VALUES))


def faults(clean: DataFrame, partial_last_day: bool = False) -> DataFrame:
    """(fault, n): what is wrong with a cleaned table, by kind; no rows if nothing is.

    duplicate hours, days without each of 24 hours (the last one may be a prefix of hours if allowed), and power or
    production that is missing, not a number, infinite or negative.
    """
    day = F.to_date("ts")
    twice = clean.groupBy("series_id", "ts").count().where("count > 1").agg(F.lit("duplicate_hour").alias("fault"), F.count("*").alias("n"))
    # the hours of a day as bits: distinct values would need a row of each hour in the aggregation
    hours = F.coalesce(F.bit_count(F.bit_or(F.expr("shiftleft(1, hour(ts))"))), F.lit(0))
    days = clean.groupBy("series_id", day.alias("day")).agg(hours.alias("hours"), F.max(F.hour("ts")).alias("top"))
    last = F.max("day").over(Window.partitionBy("series_id"))
    prefix = (F.col("day") == F.col("last")) & (F.col("hours") == F.col("top") + 1)
    short = days.withColumn("last", last).where((F.col("hours") != 24) & ~(F.lit(partial_last_day) & prefix))
    short = short.agg(F.lit("incomplete_day").alias("fault"), F.count("*").alias("n"))
    wrong = [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | (F.col(c) < 0) for c in VALUES]
    values = clean.agg(F.lit("bad_value").alias("fault"), F.count_if(F.array_contains(F.array(*wrong), True)).alias("n"))
    return twice.unionByName(short).unionByName(values).where("n > 0")


def validate(clean: DataFrame, partial_last_day: bool = False) -> DataFrame:
    if clean.limit(1).isEmpty():
        raise ValueError("no rows")
    if found := faults(clean, partial_last_day).collect():
        raise ValueError(f"faults: { {r['fault']: r['n'] for r in found} }")
    return clean


def clean_hours(raw: DataFrame) -> DataFrame:
    return with_hours(drop_bad_dates(raw))


def diagnostics(raw: DataFrame) -> DataFrame:
    """One row for each series: counts before and after cleaning, removed dates, nulls, range, and how far the mean is
    from the mean of the quarters."""
    clean = clean_hours(raw)
    before = raw.groupBy("series_id").agg(F.count("*").alias("raw_rows"), F.count_if(bad_hour()).alias("bad_hours"))
    removed = bad_dates(raw).groupBy("series_id").agg(F.count("*").alias("removed_dates"))
    gap = F.abs(F.col("avg_power") - sum(F.col(c) for c in QUARTERS) / 4)
    after = clean.groupBy("series_id").agg(
        F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), six(F.max(gap)).alias("mean_gap"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in VALUES)
    )
    return before.join(removed, "series_id", "left").na.fill(0, ["removed_dates"]).join(after, "series_id")


def densify(clean: DataFrame) -> DataFrame:
    """One row for each hour between a series' first and last one; hours without data hold nulls."""
    span = clean.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    hours = span.select("series_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("ts"))
    return hours.join(clean, ["series_id", "ts"], "left")


def append_hour(clean: DataFrame) -> DataFrame:
    """clean and, for each series, the hour after its last one, with nulls: the row that a forecast is made for."""
    following = clean.groupBy("series_id").agg((F.max("ts") + F.expr("interval 1 hour")).alias("ts"))
    return clean.unionByName(following, allowMissingColumns=True)


def lookup(targets: DataFrame, hours: DataFrame, lag: int, columns: dict[str, str]) -> DataFrame:
    """targets with values of exactly `lag` hours before; null where that hour has no row. columns: new name to old."""
    side = hours.select("series_id", (F.col("ts") + F.make_dt_interval(hours=F.lit(lag))).alias("ts"), *(F.col(old).alias(new) for new, old in columns.items()))
    return targets.join(side, ["series_id", "ts"], "left")


def require_history(rows: DataFrame, *columns: str) -> DataFrame:
    """rows, refused if one lacks a value that it must have."""
    lacking = rows.where(F.array_contains(F.array(*(F.col(c).isNull() for c in columns)), True))
    if not lacking.limit(1).isEmpty():
        raise ValueError(f"missing history in {list(columns)}")
    return rows
