"""Daily profiles, audits of derived columns, and the source dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flag
from ..sources import QUARTERS


def daily_profiles(clean: DataFrame) -> DataFrame:
    """(series_id, day, profile): 24 values in the order of hours. A day's group is 24 rows."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    pairs = F.array_sort(F.collect_list(F.struct(F.hour("ts").alias("h"), F.col("avg_power").alias("v"))))
    return clean.groupBy("series_id", day).agg(pairs.alias("p")).where(F.size("p") == 24).select("series_id", "day", F.transform("p", lambda x: x["v"]).alias("profile"))


def _distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x) / 24


def _block(at: int) -> Column:
    """The sum of six hours of a profile."""
    return F.aggregate(F.slice("profile", 6 * at + 1, 6), F.lit(0.0), lambda acc, x: acc + x)


def close_pairs(profiles: DataFrame, split: Column) -> DataFrame:
    """(series_id, day, profile, other): each day from the split on with the days before it that can be the nearest.

    Sums of hours are no further apart than the hours are, so they bound a distance from below. The two past days next to a
    day by its sum bound the least distance from above; a past day can be nearer only if its sum is in that band, which a join on
    bands of sums finds, and if the sums of its four quarters are.
    """
    days = profiles.select("series_id", "day", "profile", (F.col("day") < split).alias("_past"), F.array(*map(_block, range(4))).alias("_parts"))
    days = days.withColumn("_sum", F.aggregate("_parts", F.lit(0.0), lambda acc, x: acc + x))
    by_sum = Window.partitionBy("series_id").orderBy("_sum", "day")
    known = F.when(F.col("_past"), F.col("profile"))
    below = F.last(known, ignorenulls=True).over(by_sum.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(known, ignorenulls=True).over(by_sum.rowsBetween(0, Window.unboundedFollowing))
    series = Window.partitionBy("series_id")
    width = F.greatest((F.max("_sum").over(series) - F.min("_sum").over(series)) / F.sqrt(F.count("*").over(series)), F.lit(1e-9))
    placed = days.select("*", below.alias("_below"), above.alias("_above"), width.alias("_width"))
    past = placed.where("_past").select("series_id", F.floor(F.col("_sum") / F.col("_width")).alias("_band"), F.col("_sum").alias("_other_sum"), F.col("_parts").alias("_other_parts"), F.col("profile").alias("other"))
    # a little more than the bound, for sums are rounded
    near = F.least(_distance("profile", "_below"), _distance("profile", "_above")) * 24 * (1 + 1e-9) + 1e-6
    later = placed.where("not _past").withColumn("_near", near).where("_near is not null")
    bands = F.sequence(F.floor((F.col("_sum") - F.col("_near")) / F.col("_width")), F.floor((F.col("_sum") + F.col("_near")) / F.col("_width")))
    later = later.withColumn("_band", F.explode(bands))
    joined = later.join(past, ["series_id", "_band"]).where(F.abs(F.col("_sum") - F.col("_other_sum")) <= F.col("_near"))
    return joined.where(_distance("_parts", "_other_parts") * 24 <= F.col("_near")).select("series_id", "day", "profile", "other")


def nearest_profiles(profiles: DataFrame, split: Column) -> DataFrame:
    """(series_id, day, nearest, seen): for each day from the split on, the least mean distance to an earlier day of the
    series before it, and whether an equal one is among those."""
    pairs = close_pairs(profiles, split)
    return pairs.groupBy("series_id", "day").agg(F.min(_distance("profile", "other")).alias("nearest"), F.max(flag(F.col("profile") == F.col("other"))).alias("seen"))


def redundancy(clean: DataFrame) -> DataFrame:
    """(series_id, days, different_profiles, repeated_quarters): repeated rows are those whose four quarters were there before."""
    days = daily_profiles(clean).groupBy("series_id").agg(F.count("*").alias("days"), F.count_distinct("profile").alias("different_profiles"))
    rows = clean.groupBy("series_id").agg((F.count("*") - F.count_distinct(F.struct(*QUARTERS))).alias("repeated_quarters"))
    return days.join(rows, "series_id")


def derived_gap(clean: DataFrame) -> DataFrame:
    """(series_id, n, largest_gap): production per quarter sum against its rounded self, where the sum is not zero."""
    total = sum(F.col(q) for q in QUARTERS)
    ratio = F.col("production") / F.nullif(total, F.lit(0.0))
    found = clean.select("series_id", F.abs(ratio - F.round(ratio, 2)).alias("gap")).where("gap is not null")
    return found.groupBy("series_id").agg(F.count("*").alias("n"), F.max("gap").alias("largest_gap"))


def dictionary(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(column, dtype, missing, different, role): one aggregation over the table, then a row for each column."""
    kinds = dict(df.dtypes)
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in kinds), *(F.count_distinct(c).alias(f"d_{c}") for c in kinds))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("dtype"), F.col(f"m_{c}").alias("missing"), F.col(f"d_{c}").alias("different"), F.lit(roles.get(c, "")).alias("role")) for c, k in kinds.items()))
    return counts.select(F.explode(rows).alias("r")).select("r.*")
