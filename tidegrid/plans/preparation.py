"""Queries of ingestion, cleaning and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import truncated
from ..operators import features, grid, profiles, requests
from .common import PANEL, cutoffs, event_panel, gapped_panel, rounded, sql, whole, with_split



def panel_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_panel(spark, sf_dir)


PANEL_HOURS = sql(PANEL, "select * from full_panel")


def as_of_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = grid.as_of(sources.raw_hours(spark, sf_dir), 20240120, 11)
    return grid.clean_hours(raw)


AS_OF_CLEANING = sql(
    PANEL,
    """
select series_id, ts, q15, q30, q45, q60, avg_power, production from full_panel
where extract(day from ts) not in (13, 15) and ts <= timestamp '2024-01-20 11:00:00'""",
)


def cleaning_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.diagnostics(sources.raw_hours(spark, sf_dir))


CLEANING_DIAGNOSTICS = sql(
    PANEL
    + """, raw as (
  select *, extract(hour from ts) + case when extract(day from ts) in (13, 15) and extract(hour from ts) >= 20 then 24 else 0 end as hour, date_trunc('day', ts) as day from full_panel
), dates as (
  select series_id, day, count(*) filter (where hour not between 0 and 23) as bad from raw group by series_id, day
), counts as (
  select series_id, sum(bad)::bigint as bad_hours, count(*) filter (where bad > 0) as removed_dates from dates group by series_id
), clean as (
  select r.* from raw r join dates d on d.series_id = r.series_id and d.day = r.day where d.bad = 0
)""",
    """
select p.series_id, (select count(*) from raw f where f.series_id = p.series_id) as raw_rows, any_value(c.bad_hours) as bad_hours, any_value(c.removed_dates) as removed_dates,
       count(*) as rows, min(ts) as first_ts, max(ts) as last_ts, round(max(abs(avg_power - (q15 + q30 + q45 + q60) / 4)), 6) as mean_gap,
       count(*) filter (where q15 is null) as null_q15, count(*) filter (where q30 is null) as null_q30, count(*) filter (where q45 is null) as null_q45,
       count(*) filter (where q60 is null) as null_q60, count(*) filter (where avg_power is null) as null_avg_power, count(*) filter (where production is null) as null_production
from clean p join counts c on c.series_id = p.series_id group by p.series_id""",
)


def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.densify(gapped_panel(spark, sf_dir))


DENSE_GRID = sql(PANEL, "select * from dense")


def validation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a table with a day cut short, an hour twice and a negative load."""
    panel = event_panel(spark, sf_dir)
    short = panel.where(~((F.dayofmonth("ts") == 7) & (F.hour("ts") > 20)))
    twice = panel.where((F.dayofmonth("ts") == 9) & (F.hour("ts") == 4))
    return grid.faults(short.unionByName(twice).withColumn("avg_power", F.when((F.dayofmonth("ts") == 11) & (F.hour("ts") == 3), F.lit(-1.0)).otherwise(F.col("avg_power"))))


VALIDATION_FAULTS = sql(
    PANEL
    + """, short as (
  select * replace (case when extract(day from ts) = 11 and extract(hour from ts) = 3 then -1.0 else avg_power end as avg_power) from full_panel where not (extract(day from ts) = 7 and extract(hour from ts) > 20)
), broken as (
  select * from short union all select * from short where extract(day from ts) = 9 and extract(hour from ts) = 4
), kinds as (
  select 'duplicate_hour' as fault, count(*) as n from (select 1 from broken group by series_id, ts having count(*) > 1)
  union all select 'incomplete_day', count(*) from (select 1 from broken group by series_id, date_trunc('day', ts) having count(distinct extract(hour from ts)) <> 24)
  union all select 'bad_value', count(*) from broken
  where q15 is null or q30 is null or q45 is null or q60 is null or avg_power is null or production is null or least(q15, q30, q45, q60, avg_power, production) < 0
)""",
    "select * from kinds where n > 0",
)


def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of expanding and trailing training windows before each week, and anchors whose day ends before it."""
    panel = event_panel(spark, sf_dir)
    week = truncated("week", F.col("ts"))
    late = F.col("ts") >= week + F.expr("interval 145 hours")  # its day ends in the next week
    counts = panel.groupBy("series_id", week.alias("before")).agg(F.count("*").alias("n"), F.count_if(late).alias("late"))
    weeks = panel.select(week.alias("before")).distinct()
    rows = panel.select("series_id").distinct().crossJoin(F.broadcast(weeks)).join(counts, ["series_id", "before"], "left").na.fill(0, ["n", "late"])  # a row for each week of the panel
    by_week = Window.partitionBy("series_id").orderBy(F.datediff("before", F.lit("1970-01-05")) / 7)

    def before(column: str, weeks_back: int) -> F.Column:
        return F.coalesce(F.sum(column).over(by_week.rangeBetween(-weeks_back, -1)), F.lit(0))

    expanding = F.coalesce(F.sum("n").over(by_week.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("series_id", "before", expanding.alias("expanding"), before("n", 1).alias("last_7"), before("n", 2).alias("last_14"), (expanding - before("late", 1)).alias("purged"))


TRAINING_WINDOWS = sql(
    PANEL,
    """
select p.series_id, w.before, count(*) filter (where ts < before) as expanding, count(*) filter (where ts < before and ts >= before - interval 7 day) as last_7,
       count(*) filter (where ts < before and ts >= before - interval 14 day) as last_14, count(*) filter (where ts + interval 23 hour < before) as purged
from panel p, (select distinct date_trunc('week', ts)::timestamp as before from panel) w group by p.series_id, w.before""",
)

_LAGGED = PANEL + ", lagged as (select *, {columns} from dense window w as (partition by series_id order by ts))"


def _win(n: int) -> str:
    return f"(partition by series_id order by ts rows between {n} preceding and 1 preceding)"


def _full(agg: str, column: str, n: int, least: int | None = None) -> str:
    return f"case when count({column}) over {_win(n)} >= {least or n} then {agg}({column}) over {_win(n)} end"


_BASE_SQL = {f"load_lag_{k}": f"lag(avg_power, {k}) over w" for k in features.LOAD_LAGS} | {f"output_lag_{k}": f"lag(production, {k}) over w" for k in features.OUTPUT_LAGS}
_BASE_SQL |= {
    "last_quarter": "lag(q60, 1) over w",
    "load_mean_6": _full("avg", "avg_power", 6),
    "load_mean_24": _full("avg", "avg_power", 24),
    "load_std_6": _full("stddev_samp", "avg_power", 6),
    "load_change": "lag(avg_power, 1) over w - lag(avg_power, 2) over w",
    "output_change": "lag(production, 1) over w - lag(production, 2) over w",
    "was_active": "case when lag(production, 1) over w > 0 then 1 else 0 end",
    "active_share_6": f"count(*) filter (where production > 0) over {_win(6)} / 6.0",
    "hour_sin": "sin(2 * pi() * extract(hour from ts) / 24)",
    "hour_cos": "cos(2 * pi() * extract(hour from ts) / 24)",
    "weekday_sin": "sin(2 * pi() * (isodow(ts) - 1) / 7)",
    "weekday_cos": "cos(2 * pi() * (isodow(ts) - 1) / 7)",
    "month_sin": "sin(2 * pi() * extract(month from ts) / 12)",
    "month_cos": "cos(2 * pi() * extract(month from ts) / 12)",
    "weekend": "case when isodow(ts) >= 6 then 1 else 0 end",
    "hour": "extract(hour from ts)::int",
    "weekday": "(isodow(ts) - 1)::int",
    "day_of_year": "dayofyear(ts)::int",
    "work_start": "case when isodow(ts) < 6 and extract(hour from ts) between 7 and 9 then 1 else 0 end",
}
_TOP, _LOW = "greatest(q15, q30, q45, q60)", "least(q15, q30, q45, q60)"
_QUARTER_SQL = {f"q{m}_before": f"lag(q{m}, 1) over w" for m in (15, 30, 45)} | {
    "quarter_ramp": "lag(q60 - q15, 1) over w",
    "last_quarter_ramp": "lag(q60 - q45, 1) over w",
    "quarter_range": f"lag({_TOP} - {_LOW}, 1) over w",
    "quarter_max": f"lag({_TOP}, 1) over w",
    "quarter_max_day": f"lag({_TOP}, 24) over w",
}
_REGIME_SQL = {}
for _n in (6, 12, 24, 48):
    _REGIME_SQL[f"running_share_{_n}"] = _full("avg", "(production > 0)::int::double", _n, min(_n, 24))
    _REGIME_SQL[f"output_log_mean_{_n}"] = f"ln(1 + {_full('avg', 'production', _n, min(_n, 24))})"
_REGIME_SQL |= {
    "load_min_24": _full("min", "avg_power", 24),
    "load_max_24": _full("max", "avg_power", 24),
    "load_mean_48": _full("avg", "avg_power", 48, 24),
    "load_to_day_mean": f"lag(avg_power, 1) over w / greatest({_full('avg', 'avg_power', 24)}, 1)",
}


def _feature_sql(group: str) -> str:
    exprs = _BASE_SQL | (_QUARTER_SQL if group in ("quarter", "combined") else {}) | (_REGIME_SQL if group in ("regime", "combined") else {})
    ctes = _LAGGED.format(columns=", ".join(f"{e} as {n}" for n, e in exprs.items()))
    idle = ""
    if group in ("regime", "combined"):
        ctes += """, marked as (
  select series_id, ts, case when production = 0 then 1 else 0 end as z, sum(case when production = 0 then 0 else 1 end) over (partition by series_id order by ts) as island from dense
), run as (
  select series_id, ts, sum(z) over (partition by series_id, island order by ts) as r from marked
), runs as (
  select series_id, ts, lag(r, 1) over (partition by series_id order by ts)::bigint as idle_run from run
)"""
        idle = " join runs using (series_id, ts)"
    floats = {n for n in exprs if n not in ("was_active", "weekend", "hour", "weekday", "day_of_year", "work_start")}
    columns = [f"round({n}, 6) as {n}" if n in floats else n for n in features.GROUPS[group]]
    needed = " and ".join(f"{n} is not null" for n in _BASE_SQL)
    return sql(ctes, f"select series_id, ts, round(avg_power, 6) as target, {', '.join(columns)} from lagged{idle} where avg_power is not null and {needed}")


def _features(group: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(features.features(event_panel(spark, sf_dir), group))

    return run


def known_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = event_panel(spark, sf_dir)
    high = cutoffs(panel).first()["high"]
    return features.known_conditions(panel, high)


KNOWN_CONDITIONS = sql(
    PANEL
    + f""", splits as (select date_trunc('day', min(ts)) + interval 21 day as split from panel),
cut as (select round(quantile_cont({_TOP}, 0.9), 6) as high from panel, splits where ts < split),
lagged as (select *, lag(case when q15 is not null then {_TOP} end, 1) over w as top, lag(q60 - q15, 1) over w as ramp, {_full("sum", "production", 6)} as six,
  lag(production, 1) over w as before from dense window w as (partition by series_id order by ts))""",
    """
select series_id, ts, case when six = 0 then 1 else 0 end as prior_idle,
       case when isodow(ts) < 6 and extract(hour from ts) between 7 and 9 then 1 else 0 end as work_start, case when ramp > 0 then 1 else 0 end as ramp_up,
       case when top >= high then 1 else 0 end as quarter_high,
       case when extract(hour from ts) between 8 and 14 then 'workhour' else 'other' end || '_' || case when before > 0 then 'active' else 'inactive' end as workhour_activity
from lagged, cut where top is not null and six is not null""",
)


def observed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.observed_states(event_panel(spark, sf_dir))


OBSERVED_STATES = sql(
    PANEL + ", s as (select *, coalesce(lag(production, 1) over (partition by series_id order by ts) > 0, false) as was from dense)",
    """select series_id, ts, case when production > 0 and not was then 'startup' when not production > 0 and was then 'shutdown' when production > 0 then 'running' else 'idle' end as state
from s where production is not null""",
)


def origin_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.origin_signals(event_panel(spark, sf_dir)))


SIGNALS = (
    PANEL
    + """, pairs as (
  select series_id, date_trunc('day', ts)::timestamp + interval 1 day as day, avg_power, production, lag(avg_power, 144) over (partition by series_id order by ts) as week_ago from dense
), signals as (
  select series_id, day, round(avg(abs(avg_power - week_ago)), 6) as disagreement, case when max(production) = 0 then 1 else 0 end as no_output from pairs
  group by series_id, day having count(*) filter (where avg_power is not null and week_ago is not null and production is not null) = 24
)"""
)
ORIGIN_SIGNALS = sql(SIGNALS, "select * from signals")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.trajectories(event_panel(spark, sf_dir))


TRAJECTORIES_CTE = (
    PANEL
    + """, tops as (
  select series_id, ts, avg_power, greatest(q15, q30, q45, q60) as top from dense
), refs as (
  select series_id, ts, avg_power, top, lag(avg_power, 24) over w as d, lag(top, 24) over w as dt, lag(avg_power, 168) over w as k, lag(top, 168) over w as kt
  from tops window w as (partition by series_id order by ts)
), steps as (
  select series_id, date_trunc('day', ts)::timestamp as anchor, (extract(hour from ts) + 1)::int as horizon, avg_power as target, top as peak, d as mean_day, dt as peak_day, k as mean_week, kt as peak_week
  from refs
), trajectories as (
  select * from steps qualify count(*) filter (where target is not null and mean_day is not null and mean_week is not null) over (partition by series_id, anchor) = 24
)"""
)
TRAJECTORIES = sql(TRAJECTORIES_CTE, "select * from trajectories")


def trajectory_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = event_panel(spark, sf_dir)
    # profiles and targets are values of other hours: an hour is rounded once, not in each of the rows that show it
    return rounded(features.features(panel, "combined").drop("target")).join(features.profiles(rounded(panel)), ["series_id", "ts"])


def _trajectory_sql() -> str:
    sides = {"mean": "avg_power", "peak": "top"}
    past = [f"lag({c}, {back - h}) over w as profile_{kind}_{name}_{h}" for kind, c in sides.items() for name, back in (("day", 24), ("week", 168)) for h in range(24)]
    ahead = [f"lead({c}, {h}) over w as {kind}_{h}" for kind, c in sides.items() for h in range(24)]
    needed = " and ".join(f"{c} is not null" for c in features.PROFILES + features.AHEAD)
    wide = f"select series_id, ts, {', '.join(past + ahead)} from (select *, greatest(q15, q30, q45, q60) as top from dense) window w as (partition by series_id order by ts)"
    return f"with {PANEL.strip()}, wide as ({wide})\nselect f.* exclude (target), w.* exclude (series_id, ts) from ({_feature_sql('combined')}) f join wide w on w.series_id = f.series_id and w.ts = f.ts where {needed}"


TRAJECTORY_FEATURES = _trajectory_sql()


def interval_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(requests.request_rows(event_panel(spark, sf_dir)))


REQUESTS_CTE = (
    PANEL
    + """, tops as (
  select series_id, ts, avg_power, production, greatest(q15, q30, q45, q60) as top from dense
), origins as (
  select series_id, ts as origin, avg_power as persistence, top as peak_persistence, production as origin_output,
         sum(production) over d as output_sum_24, avg(avg_power) over d as load_mean_24
  from tops window d as (partition by series_id order by ts rows between 23 preceding and current row)
  qualify count(avg_power) over d = 24
), leads as (
  select o.*, l.lead::int as lead, o.origin + to_hours(l.lead) as ts from origins o, (select unnest(range(1, 25)) as lead) l where extract(hour from o.origin) in (0, 6, 12, 18)
), requests as (
  select l.*, a.avg_power as actual, a.top as actual_peak, d.avg_power as previous_day, d.top as peak_previous_day, w.avg_power as previous_week, w.top as peak_previous_week
  from leads l join tops a on a.series_id = l.series_id and a.ts = l.ts join tops d on d.series_id = l.series_id and d.ts = l.ts - interval 24 hour
  join tops w on w.series_id = l.series_id and w.ts = l.ts - interval 168 hour
  where a.avg_power is not null and d.avg_power is not null and w.avg_power is not null
  qualify count(*) over (partition by l.series_id, l.origin) = 24
)"""
)
INTERVAL_REQUESTS = sql(
    REQUESTS_CTE,
    """
select series_id, origin, ts, lead, persistence, peak_persistence, origin_output, round(output_sum_24, 6) as output_sum_24, round(load_mean_24, 6) as load_mean_24,
       actual, actual_peak, previous_day, peak_previous_day, previous_week, peak_previous_week,
       round(sin(2 * pi() * extract(hour from ts) / 24), 6) as target_hour_sin, round(cos(2 * pi() * extract(hour from ts) / 24), 6) as target_hour_cos,
       round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) as target_weekday_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) as target_weekday_cos,
       round(sin(2 * pi() * extract(month from ts) / 12), 6) as target_month_sin, round(cos(2 * pi() * extract(month from ts) / 12), 6) as target_month_cos
from requests""",
)


def exact_lag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with the value a day before, by an equi-join on the exact hour."""
    panel = gapped_panel(spark, sf_dir)
    return grid.lookup(panel.select("series_id", "ts", "avg_power"), panel, 24, {"day_before": "avg_power"})


EXACT_LAG_LOOKUP = sql(PANEL, "select p.series_id, p.ts, p.avg_power, b.avg_power as day_before from panel p left join panel b on b.series_id = p.series_id and b.ts = p.ts - interval 24 hour")


def nearest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = event_panel(spark, sf_dir)
    days = with_split(profiles.daily_profiles(panel), panel)
    return rounded(profiles.nearest_profiles(days, F.col("split")))


NEAREST_PROFILE = sql(
    PANEL
    + """, splits as (select date_trunc('day', min(ts)) + interval 21 day as split from panel),
days as (select series_id, date_trunc('day', ts)::timestamp as day, extract(hour from ts) as h, avg_power from panel),
gaps as (
  select e.series_id, e.day, t.day as past, avg(abs(e.avg_power - t.avg_power)) as gap, max(abs(e.avg_power - t.avg_power)) as worst
  from days e join days t on t.series_id = e.series_id and t.h = e.h, splits where e.day >= split and t.day < split group by e.series_id, e.day, t.day
)""",
    "select series_id, day, round(min(gap), 6) as nearest, max(case when worst = 0 then 1 else 0 end) as seen from gaps group by series_id, day",
)


def profile_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.redundancy(event_panel(spark, sf_dir))


PROFILE_REDUNDANCY = sql(
    PANEL + ", days as (select series_id, date_trunc('day', ts) as day, list(avg_power order by ts) as profile from panel group by series_id, date_trunc('day', ts))",
    """
select d.series_id, count(*) as days, count(distinct profile) as different_profiles,
       (select count(*) - count(distinct row(q15, q30, q45, q60)) from panel p where p.series_id = d.series_id) as repeated_quarters
from days d group by d.series_id""",
)


def derived_column_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.derived_gap(event_panel(spark, sf_dir)))


DERIVED_COLUMN_GAP = sql(
    PANEL + ", r as (select series_id, production / nullif(q15 + q30 + q45 + q60, 0) as ratio from panel)",
    "select series_id, count(ratio) as n, round(max(abs(ratio - round(ratio, 2))), 6) as largest_gap from r where ratio is not null group by series_id",
)

_ROLES = {"series_id": "key", "ts": "calendar", "avg_power": "target", "production": "observed"} | dict.fromkeys(sources.QUARTERS, "observed")
_KINDS = {"series_id": "bigint", "ts": "timestamp_ntz"} | dict.fromkeys([*sources.QUARTERS, "avg_power", "production"], "double")


def source_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.dictionary(grid.densify(event_panel(spark, sf_dir)), _ROLES)


SOURCE_DICTIONARY = sql(
    PANEL,
    " union all ".join(f"select '{c}' as \"column\", '{k}' as dtype, count(*) - count({c}) as missing, count(distinct {c}) as different, '{_ROLES[c]}' as role from dense" for c, k in _KINDS.items()),
)


def daily_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = event_panel(spark, sf_dir)
    day = truncated("day", F.col("ts")).alias("day")
    return rounded(panel.groupBy("series_id", day).agg(F.avg("avg_power").alias("mean"), F.min("avg_power").alias("low"), F.max("avg_power").alias("high"), F.expr("percentile(avg_power, 0.5)").alias("middle"), F.stddev_pop("avg_power").alias("spread")))


DAILY_MEANS = sql(
    PANEL,
    """
select series_id, date_trunc('day', ts)::timestamp as day, round(avg(avg_power), 6) as mean, min(avg_power) as low, max(avg_power) as high,
       round(median(avg_power), 6) as middle, round(stddev_pop(avg_power), 6) as spread from panel group by series_id, date_trunc('day', ts)""",
)


def table_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = event_panel(spark, sf_dir)
    keyed = panel.select("series_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), (F.round(F.col("avg_power") * 10000)).cast("long").alias("load"))
    return sources.table_digest(keyed, "series_id", "hour", "load")


TABLE_DIGESTS = sql(
    PANEL + ", keyed as (select series_id, md5(strftime(ts, '%Y-%m-%d %H') || '|' || round(avg_power * 10000)::bigint) as h from panel)",
    """select series_id, count(*) as n, sha256(count(*) || '|' || sum(('0x' || h[1:15])::bigint)::hugeint || '|' || bit_xor(('0x' || h[17:31])::bigint)) as digest
from keyed group by series_id""",
)


def monthly_order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month folds of the long daily panel: rows and totals of each month, and rows in all months before."""
    days = sources.order_panel(spark, sf_dir)
    months = days.groupBy("series_id", truncated("month", F.col("day")).alias("month")).agg(F.count("*").alias("days"), F.sum("n").alias("orders"), (F.expr("sum(cast(round(total * 100) as bigint)) div count(*)") / 100).alias("mean_total"))
    before = Window.partitionBy("series_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    return months.withColumn("days_before", F.coalesce(F.sum("days").over(before), F.lit(0)))


MONTHLY_ORDER_PANEL = """
with days as (
  select o_orderpriority as series_id, date_trunc('day', o_orderdate)::timestamp as day, round(sum(o_totalprice), 2) as total, count(*) as n from orders group by 1, 2
), months as (
  select series_id, date_trunc('month', day)::timestamp as month, count(*) as days, sum(n)::bigint as orders, (sum(round(total * 100)::bigint)::bigint // count(*)) / 100.0 as mean_total from days group by 1, 2
)
select *, coalesce(sum(days) over (partition by series_id order by month rows between unbounded preceding and 1 preceding), 0)::bigint as days_before from months
"""

QUERIES = {
    "panel_hours": panel_hours,
    "as_of_cleaning": as_of_cleaning,
    "cleaning_diagnostics": cleaning_diagnostics,
    "dense_grid": dense_grid,
    "validation_faults": validation_faults,
    "training_windows": training_windows,
    "known_conditions": known_conditions,
    "observed_states": observed_states,
    "origin_signals": origin_signals,
    "trajectories": trajectories,
    "trajectory_features": trajectory_features,
    "interval_requests": interval_requests,
    "exact_lag_lookup": exact_lag_lookup,
    "nearest_profile": nearest_profile,
    "profile_redundancy": profile_redundancy,
    "derived_column_gap": derived_column_gap,
    "source_dictionary": source_dictionary,
    "daily_means": daily_means,
    "table_digests": table_digests,
    "monthly_order_panel": monthly_order_panel,
} | {f"features_{g}": _features(g) for g in features.GROUPS}
#: Queries that are about gaps, and whose SQL keeps them.
GAPPED = ("as_of_cleaning", "cleaning_diagnostics", "dense_grid", "exact_lag_lookup")
ORACLES = {name: globals()[name.upper()] for name in QUERIES if not name.startswith("features_")} | {f"features_{g}": _feature_sql(g) for g in features.GROUPS}
ORACLES = {name: text if name in GAPPED else whole(text) for name, text in ORACLES.items()}
