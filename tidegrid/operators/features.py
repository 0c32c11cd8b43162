"""Feature operators. A row for hour t reads observations up to t - 1 only.

All work on the dense grid, so that a shift by k rows is a shift by k hours and never crosses a gap. Everything is one
window specification by series, which Spark evaluates after a single exchange and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import at_least, complete, cyclic, flag, hours_before, is_true, is_weekend, is_work_start, production_state, strict_max, weekday
from ..sources import QUARTERS
from .grid import densify

LOAD_LAGS = (1, 2, 3, 23, 24, 25, 48, 167, 168, 169)
OUTPUT_LAGS = (1, 2, 3, 24, 25)


def by_time():
    return Window.partitionBy("series_id").orderBy("ts")


BASE = (
    [f"load_lag_{k}" for k in LOAD_LAGS]
    + [f"output_lag_{k}" for k in OUTPUT_LAGS]
    + ["last_quarter", "load_mean_6", "load_mean_24", "load_std_6", "load_change", "output_change", "was_active", "active_share_6"]
    + ["hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "month_sin", "month_cos", "weekend", "hour", "weekday", "day_of_year", "work_start"]
)
QUARTER = ["q15_before", "q30_before", "q45_before", "quarter_ramp", "last_quarter_ramp", "quarter_range", "quarter_max", "quarter_max_day"]
REGIME = (
    [f"{kind}_{n}" for n in (6, 12, 24, 48) for kind in ("running_share", "output_log_mean")] + ["load_min_24", "load_max_24", "load_mean_48", "load_to_day_mean", "idle_run"]
)
GROUPS = {"base": BASE, "quarter": BASE + QUARTER, "regime": BASE + REGIME, "combined": BASE + QUARTER + REGIME}


def _lag(column: str | Column, k: int) -> Column:
    return F.lag(column, k).over(by_time())


def _before(n: int):
    return by_time().rowsBetween(-n, -1)


def _full(agg: Column, column: Column, n: int, least: int | None = None) -> Column:
    """agg over the n hours before, null unless at least `least` (all) of them have data."""
    return F.when(F.count(column).over(_before(n)) >= (least or n), agg.over(_before(n)))


def _calendar() -> list[Column]:
    ts = F.col("ts")
    return [
        *cyclic(F.hour(ts), 24, "hour"),
        *cyclic(weekday(ts), 7, "weekday"),
        *cyclic(F.month(ts), 12, "month"),
        flag(is_weekend(ts)).alias("weekend"),
        F.hour(ts).alias("hour"),
        weekday(ts).alias("weekday"),
        F.dayofyear(ts).alias("day_of_year"),
        flag(is_work_start(ts)).alias("work_start"),
    ]


def _base_columns() -> list[Column]:
    load, output = F.col("avg_power"), F.col("production")
    active_before = sum((flag(_lag("production", k) > 0) for k in range(1, 7)), F.lit(0))
    return [
        *(_lag("avg_power", k).alias(f"load_lag_{k}") for k in LOAD_LAGS),
        *(_lag("production", k).alias(f"output_lag_{k}") for k in OUTPUT_LAGS),
        _lag("q60", 1).alias("last_quarter"),
        _full(F.avg(load), load, 6).alias("load_mean_6"),
        _full(F.avg(load), load, 24).alias("load_mean_24"),
        _full(F.stddev_samp(load), load, 6).alias("load_std_6"),
        (_lag("avg_power", 1) - _lag("avg_power", 2)).alias("load_change"),
        (_lag("production", 1) - _lag("production", 2)).alias("output_change"),
        flag(_lag(output, 1) > 0).alias("was_active"),
        (active_before / 6).alias("active_share_6"),  # an hour without data counts as not active here
        *_calendar(),
    ]


def _quarter_columns() -> list[Column]:
    top, bottom = F.greatest(*QUARTERS), F.least(*QUARTERS)
    return [
        *(_lag(q, 1).alias(f"{q}_before") for q in QUARTERS[:3]),
        _lag(F.col("q60") - F.col("q15"), 1).alias("quarter_ramp"),
        _lag(F.col("q60") - F.col("q45"), 1).alias("last_quarter_ramp"),
        _lag(top - bottom, 1).alias("quarter_range"),
        _lag(top, 1).alias("quarter_max"),
        _lag(top, 24).alias("quarter_max_day"),
    ]


def _regime_columns() -> list[Column]:
    load, output = F.col("avg_power"), F.col("production")
    active = F.when(output.isNotNull(), (output > 0).cast("double"))  # here an hour without data stays unknown
    out = []
    for n in (6, 12, 24, 48):
        least = min(n, 24)
        out += [_full(F.avg(active), active, n, least).alias(f"running_share_{n}"), F.log1p(_full(F.avg(output), output, n, least)).alias(f"output_log_mean_{n}")]
    return out + [
        _full(F.min(load), load, 24).alias("load_min_24"),
        _full(F.max(load), load, 24).alias("load_max_24"),
        _full(F.avg(load), load, 48, 24).alias("load_mean_48"),
        (_lag("avg_power", 1) / at_least(_full(F.avg(load), load, 24), 1)).alias("load_to_day_mean"),
    ]


def idle_runs(dense: DataFrame) -> DataFrame:
    """Adds idle_run: hours without production in a row up to t - 1; an hour with production or without data ends a run."""
    island = F.sum(1 - F.col("_zero")).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    marked = dense.withColumn("_zero", flag(F.col("production") == 0)).withColumn("_island", island)
    run = F.sum("_zero").over(Window.partitionBy("series_id", "_island").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_run", run).withColumn("idle_run", _lag("_run", 1)).drop("_zero", "_island", "_run")


def features(clean: DataFrame, group: str = "base", need_target: bool = True) -> DataFrame:
    """(series_id, ts, target, then GROUPS[group]) for hours whose base features, and target, are complete.

    Groups beyond the base must not cost rows: a null among theirs, where the base is complete, is an error of the caller's data.
    """
    if group not in GROUPS:
        raise ValueError(f"no feature group {group}")
    dense = densify(clean)
    wide = dense.select("series_id", "ts", "production", F.col("avg_power").alias("target"), *_base_columns(), *(_quarter_columns() if group in ("quarter", "combined") else []), *(_regime_columns() if group in ("regime", "combined") else []))
    if group in ("regime", "combined"):
        wide = idle_runs(wide)
    needed = BASE + (["target"] if need_target else [])
    known = wide.na.drop(subset=needed)
    if extra := GROUPS[group][len(BASE) :]:
        wrong = F.raise_error(F.lit(f"features of group {group} are missing where the base is complete")).cast("double")
        known = known.withColumn(extra[0], F.when(complete(*map(F.col, extra)), F.col(extra[0])).otherwise(wrong))
    return known.select("series_id", "ts", "target", *GROUPS[group])


def idle_signal(clean: DataFrame, hours: int) -> DataFrame:
    """(series_id, ts, idle_hours): whether production was measured and zero in each of the hours before."""
    output = F.col("production")
    return densify(clean).select("series_id", "ts", is_true(_full(F.sum(output), output, hours) == 0).alias("idle_hours"))


def known_conditions(clean: DataFrame, high_cutoff: float | Column) -> DataFrame:
    """(series_id, ts, conditions known before the hour); hours without the history for them are left out."""
    output, ts = F.col("production"), F.col("ts")
    wide = densify(clean).select(
        "series_id",
        "ts",
        _lag(strict_max(*(F.col(q) for q in QUARTERS)), 1).alias("top"),
        _lag(F.col("q60") - F.col("q15"), 1).alias("ramp"),
        _full(F.sum(output), output, 6).alias("six"),
        flag(_lag(output, 1) > 0).alias("active"),
    )
    hour = F.when(F.hour(ts).between(8, 14), "workhour").otherwise("other")
    return wide.where(complete(F.col("top"), F.col("six"))).select(
        "series_id",
        "ts",
        flag(F.col("six") == 0).alias("prior_idle"),
        flag(is_work_start(ts)).alias("work_start"),
        flag(F.col("ramp") > 0).alias("ramp_up"),
        flag(F.col("top") >= high_cutoff).alias("quarter_high"),
        F.concat_ws("_", hour, F.when(F.col("active") == 1, "active").otherwise("inactive")).alias("workhour_activity"),
    )


def observed_states(clean: DataFrame) -> DataFrame:
    """(series_id, ts, state): known only after the hour; for diagnosis."""
    dense = densify(clean).select("series_id", "ts", F.col("production").alias("now"), _lag("production", 1).alias("before"))
    return dense.where("now is not null").select("series_id", "ts", production_state(F.col("now"), F.col("before")).alias("state"))


def origin_signals(clean: DataFrame) -> DataFrame:
    """(series_id, day, disagreement, no_output): for each midnight with full history, how far the day before is from the
    same 24 hours a week ago on average, and whether it had no production at all."""
    dense = densify(clean).select("series_id", "ts", "avg_power", "production", _lag("avg_power", 144).alias("week_ago"))
    day = (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("interval 1 day")).alias("day")
    grouped = dense.groupBy("series_id", day).agg(
        F.count_if(complete(F.col("avg_power"), F.col("week_ago"), F.col("production"))).alias("n"), F.avg(F.abs(F.col("avg_power") - F.col("week_ago"))).alias("disagreement"), F.max("production").alias("top")
    )
    return grouped.where("n = 24").select("series_id", "day", "disagreement", flag(F.col("top") == 0).alias("no_output"))


def trajectories(clean: DataFrame, hours: tuple[int, ...] = (0,)) -> DataFrame:
    """(series_id, anchor, horizon, target, peak, mean_day, peak_day, mean_week, peak_week): 24 rows for each anchor hour
    whose next 24 hours and both reference profiles are complete. The anchor is the last hour observed + 1."""
    top = strict_max(*(F.col(q) for q in QUARTERS))
    dense = densify(clean).select("series_id", "ts", "avg_power", top.alias("top"))
    wide = dense.select("series_id", "ts", "avg_power", "top", *(_lag(c, k).alias(f"{c}_{k}") for c in ("avg_power", "top") for k in (24, 168)))
    step = F.explode(F.sequence(F.lit(1), F.lit(24))).alias("horizon")
    long = wide.select("*", step).withColumn("anchor", hours_before(F.col("ts"), F.col("horizon") - 1)).where(F.hour("anchor").isin(*hours))
    renamed = long.select("series_id", "anchor", "horizon", F.col("avg_power").alias("target"), F.col("top").alias("peak"), F.col("avg_power_24").alias("mean_day"), F.col("top_24").alias("peak_day"), F.col("avg_power_168").alias("mean_week"), F.col("top_168").alias("peak_week"))
    values = [F.col(c) for c in renamed.columns[3:]]
    whole = F.count_if(complete(*values)).over(Window.partitionBy("series_id", "anchor"))
    return renamed.withColumn("_n", whole).where("_n = 24").drop("_n")


#: Both reference profiles of the 24 hours ahead, by kind, reference and hour.
PROFILES = [f"profile_{kind}_{name}_{h}" for kind in ("mean", "peak") for name in ("day", "week") for h in range(24)]
AHEAD = [f"{kind}_{h}" for kind in ("mean", "peak") for h in range(24)]


def trajectory_features(clean: DataFrame, need_target: bool = True) -> DataFrame:
    """(series_id, ts, GROUPS["combined"], PROFILES, AHEAD): a row for each hour ts from which a day can be forecast: what is
    known before it, the 24 hours of the day and of the week before, and, as targets, the mean and the quarter peak of the
    24 hours from ts on. Hours without a complete history, or without their targets where these are needed, are left out.
    """
    return features(clean, "combined", need_target=need_target).drop("target").join(profiles(clean, need_target), ["series_id", "ts"])


def profiles(clean: DataFrame, need_target: bool = True) -> DataFrame:
    """(series_id, ts, PROFILES, AHEAD) for hours with complete profiles and, where these are needed, targets: values of other hours as they are."""
    top = strict_max(*(F.col(q) for q in QUARTERS))
    dense = densify(clean).select("series_id", "ts", "avg_power", top.alias("top"))
    sides = {"mean": "avg_power", "peak": "top"}
    past = [_lag(c, back - h).alias(f"profile_{kind}_{name}_{h}") for kind, c in sides.items() for name, back in (("day", 24), ("week", 168)) for h in range(24)]
    ahead = [F.lead(c, h).over(by_time()).alias(f"{kind}_{h}") for kind, c in sides.items() for h in range(24)]
    return dense.select("series_id", "ts", *past, *ahead).na.drop(subset=PROFILES + (AHEAD if need_target else []))


DAILY_LAGS = (1, 2, 3, 7, 14, 28)
DAILY = [f"lag_{k}" for k in DAILY_LAGS] + ["mean_7", "mean_28", "orders_lag_1", "weekday_sin", "weekday_cos", "month_sin", "month_cos"]


def daily_features(days: DataFrame) -> DataFrame:
    """(series_id, day, period, target, DAILY) from days(series_id, day, load, n) without gaps; the first 28 days of a series are
    history only. period counts months."""
    w = Window.partitionBy("series_id").orderBy("day")
    before = lambda n: F.avg("load").over(w.rowsBetween(-n, -1))
    wide = days.select(
        "series_id",
        "day",
        (F.year("day") * 12 + F.month("day")).cast("long").alias("period"),
        F.col("load").alias("target"),
        *(F.lag("load", k).over(w).alias(f"lag_{k}") for k in DAILY_LAGS),
        before(7).alias("mean_7"),
        before(28).alias("mean_28"),
        F.lag("n", 1).over(w).cast("double").alias("orders_lag_1"),
        *cyclic(weekday(F.col("day")), 7, "weekday"),
        *cyclic(F.month("day"), 12, "month"),
    )
    return wide.where("lag_28 is not null")
