"""Shared query parts: prediction tables from the event panel, and the SQL of the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import complete, flag, six, truncated
from ..operators import features as feats
from ..sources import QUARTERS, event_panel, gapped_panel

TRAIN_DAYS = 21
CANDIDATES = ["persistence", "previous_day", "previous_week", "blend", "gated"]


def period() -> Column:
    return truncated("week", F.col("ts"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits: two engines add in different orders."""
    return df.select(*((six(c) if digits == 6 else F.round(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def split(panel: DataFrame) -> DataFrame:
    """One row: the first hour after the training days."""
    return panel.agg((truncated("day", F.min("ts")) + F.expr(f"interval {TRAIN_DAYS} days")).alias("split"))


def with_split(rows: DataFrame, panel: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(split(panel)))  # one row


def cutoffs(panel: DataFrame) -> DataFrame:
    """One row: the load under which an hour can be idle, the quarter peak that is an event, and that which is high."""
    top = F.greatest(*QUARTERS)
    early = with_split(panel, panel).where("ts < split").select(F.col("avg_power"), top.alias("top"))
    return early.agg(*(six(F.expr(e)).alias(n) for n, e in (("cap", "percentile(avg_power, 0.5)"), ("event", "percentile(top, 0.95)"), ("high", "percentile(top, 0.9)"))))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts, actual, peak, idle, state, candidates, event, high): hours with a week of history."""
    panel = event_panel(spark, sf_dir)
    base = feats.densify(panel)
    w = feats.by_time()
    lag = lambda c, k: F.lag(c, k).over(w)
    out = F.col("production")
    last_six = F.when(F.count(out).over(w.rowsBetween(-6, -1)) == 6, F.sum(out).over(w.rowsBetween(-6, -1)))
    wide = base.select(
        "series_id",
        "ts",
        F.col("avg_power").alias("actual"),
        F.greatest(*QUARTERS).alias("peak"),
        out.alias("output"),
        lag("production", 1).alias("output_before"),
        lag("avg_power", 1).alias("persistence"),
        lag("avg_power", 24).alias("previous_day"),
        lag("avg_power", 168).alias("previous_week"),
        last_six.alias("six"),
    )
    known = wide.where(complete(*(F.col(c) for c in ("actual", "persistence", "previous_day", "previous_week", "six"))))
    rows = known.crossJoin(F.broadcast(cutoffs(panel)))  # one row
    idle = flag((F.col("six") == 0) & (F.col("persistence") <= F.col("cap")))
    rows = rows.withColumn("idle", idle).withColumn("blend", (F.col("previous_day") + F.col("previous_week")) / 2)
    rows = rows.withColumn("gated", F.when(F.col("idle") == 1, F.col("persistence")).otherwise(F.col("blend")))
    return rows.withColumn("state", feats.production_state(F.col("output"), F.col("output_before"))).drop("six", "cap")


PANEL = """
ev as (
  select user_id // 10 as series_id, date_trunc('hour', ts) as ts, extract(minute from ts) // 15 as q, value, event_type = 'purchase' as made from events
), found as (
  select series_id, ts,
         round(sum(value) filter (where q = 0), 2) as q15, round(sum(value) filter (where q = 1), 2) as q30,
         round(sum(value) filter (where q = 2), 2) as q45, round(sum(value) filter (where q = 3), 2) as q60,
         round(sum(value) filter (where made), 2) as production
  from ev group by series_id, ts
), bounds as (
  select date_trunc('day', min(ts)) as lo, date_trunc('day', max(ts)) + interval 23 hour as hi from events
), grid as (
  select s.series_id, unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 hour)) as ts from bounds, (select distinct series_id from ev) s
), full_panel as (
  select g.series_id, g.ts, coalesce(q15, 0) as q15, coalesce(q30, 0) as q30, coalesce(q45, 0) as q45, coalesce(q60, 0) as q60,
         ((round(coalesce(q15, 0) * 100)::bigint + round(coalesce(q30, 0) * 100)::bigint + round(coalesce(q45, 0) * 100)::bigint + round(coalesce(q60, 0) * 100)::bigint) // 4) / 100.0 as avg_power, coalesce(production, 0) as production
  from grid g left join found f on f.series_id = g.series_id and f.ts = g.ts
), panel as (
  select * from full_panel where extract(day from ts) not in (13, 15)
), ends as (
  select series_id, min(ts) as lo, max(ts) as hi from panel group by series_id
), hours as (
  select series_id, unnest(generate_series(lo, hi, interval 1 hour)) as ts from ends
), dense as (
  select h.series_id, h.ts, p.q15, p.q30, p.q45, p.q60, p.avg_power, p.production from hours h left join panel p on p.series_id = h.series_id and p.ts = h.ts
)"""

CUTOFFS = (
    PANEL
    + """, splits as (
  select date_trunc('day', min(ts)) + interval 21 day as split from panel
), cutoffs as (
  select round(quantile_cont(avg_power, 0.5), 6) as cap, round(quantile_cont(greatest(q15, q30, q45, q60), 0.95), 6) as event,
         round(quantile_cont(greatest(q15, q30, q45, q60), 0.9), 6) as high
  from panel, splits where ts < split
)"""
)

PREDICTIONS = (
    CUTOFFS
    + """, wide as (
  select series_id, ts, avg_power as actual, greatest(q15, q30, q45, q60) as peak, production as output,
         lag(production, 1) over w as output_before, lag(avg_power, 1) over w as persistence, lag(avg_power, 24) over w as previous_day,
         lag(avg_power, 168) over w as previous_week,
         case when count(production) over (partition by series_id order by ts rows between 6 preceding and 1 preceding) = 6
              then sum(production) over (partition by series_id order by ts rows between 6 preceding and 1 preceding) end as six
  from dense window w as (partition by series_id order by ts)
), known as (
  select wide.*, event, high, case when six = 0 and persistence <= cap then 1 else 0 end as idle, (previous_day + previous_week) / 2 as blend
  from wide, cutoffs where actual is not null and persistence is not null and previous_day is not null and previous_week is not null and six is not null
), predictions as (
  select *, case when idle = 1 then persistence else blend end as gated,
         case when output > 0 and not coalesce(output_before > 0, false) then 'startup' when output <= 0 and output_before > 0 then 'shutdown'
              when output > 0 and output_before > 0 then 'running' else 'idle' end as state
  from known
)"""
)

LONG = (
    PREDICTIONS
    + """, long as (
  select p.*, date_trunc('week', ts)::timestamp as period, c.candidate, c.ordinal,
         abs(case c.candidate when 'persistence' then persistence when 'previous_day' then previous_day when 'previous_week' then previous_week when 'blend' then blend else gated end - actual) as err
  from predictions p, (values ('persistence', 0), ('previous_day', 1), ('previous_week', 2), ('blend', 3), ('gated', 4)) c(candidate, ordinal)
)"""
)


#: What makes the panel in SQL the one with gaps.
GAPS = "where extract(day from ts) not in (13, 15)"


def whole(ctes: str) -> str:
    """The same parts on the panel without gaps."""
    return ctes.replace(GAPS, "")


def sql(ctes: str, select: str) -> str:
    return f"with {ctes.strip()}\n{select.strip()}".replace(", 6)", " + 1e-9, 6)")  # see functions.six


__all__ = ["CANDIDATES", "CUTOFFS", "LONG", "PANEL", "PREDICTIONS", "cutoffs", "event_panel", "gapped_panel", "period", "predictions", "rounded", "split", "sql", "whole", "with_split"]
