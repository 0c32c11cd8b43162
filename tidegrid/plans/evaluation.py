"""Queries of metrics, thresholds, selection and diagnosis over the prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import day_type, flag, is_weekend, is_work_start, lead_bucket, six, truncated
from ..operators import evaluation as ev
from ..operators import features, requests, resampling
from . import common
from .common import CANDIDATES, LONG, PREDICTIONS, cutoffs, event_panel, period, predictions, rounded, whole
from .preparation import REQUESTS_CTE, SIGNALS, TRAJECTORIES_CTE

_REG = "count(*) as n, round(avg(abs({p} - {a})), 6) as mae, round(sqrt(avg(({p} - {a}) * ({p} - {a}))), 6) as rmse, round(sum(abs({p} - {a})) / nullif(sum(abs({a})), 0), 6) as wape"


def sql(ctes: str, select: str) -> str:
    return common.sql(whole(ctes), select)


def _reg(p: str, a: str = "actual") -> str:
    return _REG.format(p=p, a=a)


def daily_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by site and day of the week-ago baseline behind the idle gate: one window exchange, one aggregation."""
    rows = predictions(spark, sf_dir).withColumn("prediction", F.when(F.col("idle") == 1, F.col("persistence")).otherwise(F.col("previous_week")))
    return rounded(rows.groupBy("series_id", truncated("day", F.col("ts")).alias("day")).agg(*ev.regression()))


DAILY_BASELINE = sql(
    PREDICTIONS + ", p as (select *, case when idle = 1 then persistence else previous_week end as prediction from predictions)",
    f"select series_id, date_trunc('day', ts)::timestamp as day, {_reg('prediction')} from p group by series_id, date_trunc('day', ts)",
)


def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(predictions(spark, sf_dir))


PREDICTION_TABLE = sql(PREDICTIONS, "select series_id, ts, actual, peak, output, output_before, persistence, previous_day, previous_week, event, high, idle, round(blend, 6) as blend, round(gated, 6) as gated, state from predictions")


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    long = ev.long_errors(rows, CANDIDATES, period())
    values = F.when(F.lit(False), F.lit(0.0))
    for c in CANDIDATES:
        values = values.when(F.col("candidate") == c, F.col(c))
    return rounded(long.withColumn("prediction", values).groupBy("candidate").agg(*ev.regression()))


REGRESSION_METRICS = sql(
    LONG.replace("abs(case c.candidate", "case c.candidate").replace("end - actual) as err", "end as err"),
    f"select candidate, {_reg('err')} from long group by candidate",
)


def alert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the gated forecast's quarter view against events; the two cut-offs differ."""
    rows = predictions(spark, sf_dir)
    event, alert = F.col("peak") >= F.col("event"), F.col("gated") * 2 >= F.col("event")
    return rounded(ev.rates(rows.groupBy("series_id").agg(F.count("*").alias("n"), *ev.confusion(event, alert))))


_RATES = """case when tp + fp > 0 then round(tp / (tp + fp), 6) else 0 end as precision, case when tp + fn > 0 then round(tp / (tp + fn), 6) else 0 end as recall,
  case when 5 * tp + 4 * fn + fp > 0 then round(5 * tp / (5 * tp + 4 * fn + fp), 6) else 0 end as f2"""
_CONF = "count(*) filter (where {e} and {a}) as tp, count(*) filter (where not ({e}) and {a}) as fp, count(*) filter (where {e} and not ({a})) as fn"
ALERT_SCORES = sql(
    PREDICTIONS + f", c as (select series_id, count(*) as n, {_CONF.format(e='peak >= event', a='gated * 2 >= event')} from predictions group by series_id)",
    f"select series_id, n, tp, fp, fn, {_RATES} from c",
)


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = event_panel(spark, sf_dir)
    known = features.known_conditions(panel, cutoffs(panel).first()["high"])
    return predictions(spark, sf_dir).join(known.drop("high"), ["series_id", "ts"])


def condition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and alerts by conditions known before the hour; large: at least the 90th percentile of all errors."""
    rows = _conditions(spark, sf_dir).withColumn("err", ev.error("gated"))
    large = rows.agg(six(F.expr("percentile(err, 0.9)")).alias("large"))
    rows = rows.crossJoin(F.broadcast(large))  # one row
    keys = {c: F.col(c) for c in ("prior_idle", "work_start", "ramp_up", "quarter_high", "workhour_activity")}
    event, alert = F.col("peak") >= F.col("event"), F.col("gated") * 2 >= F.col("event")
    return rounded(
        ev.metrics_by(
            rows, keys, F.count("*").alias("n"), F.avg("err").alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.expr("percentile(err, 0.9)").alias("p90"), F.count_if(F.col("err") >= F.col("large")).alias("large_errors"), F.avg(flag(event)).alias("peak_rate"), *ev.confusion(event, alert)
        )
    )


_WIN6 = "(partition by series_id order by ts rows between 6 preceding and 1 preceding)"
_CONDITIONED = (
    PREDICTIONS
    + f""", lagged as (
  select series_id, ts, lag(greatest(q15, q30, q45, q60), 1) over w as top, lag(q60 - q15, 1) over w as ramp, lag(production, 1) over w as before,
         case when count(production) over {_WIN6} = 6 then sum(production) over {_WIN6} end as six6
  from dense window w as (partition by series_id order by ts)
), cond as (
  select p.*, abs(gated - actual) as err, case when six6 = 0 then 1 else 0 end as prior_idle, case when isodow(p.ts) < 6 and extract(hour from p.ts) between 7 and 9 then 1 else 0 end as work_start,
         case when ramp > 0 then 1 else 0 end as ramp_up, case when top >= high then 1 else 0 end as quarter_high,
         case when extract(hour from p.ts) between 8 and 14 then 'workhour' else 'other' end || '_' || case when before > 0 then 'active' else 'inactive' end as workhour_activity
  from predictions p join lagged l on l.series_id = p.series_id and l.ts = p.ts where top is not null and six6 is not null
), lim as (select round(quantile_cont(err, 0.9), 6) as large from cond), named as (
  select cond.*, lim.large, k.condition, case k.condition when 'prior_idle' then prior_idle::varchar when 'work_start' then work_start::varchar when 'ramp_up' then ramp_up::varchar when 'quarter_high' then quarter_high::varchar else workhour_activity end as v
  from cond, lim, (values ('prior_idle'), ('work_start'), ('ramp_up'), ('quarter_high'), ('workhour_activity')) k(condition)
)"""
)
CONDITION_METRICS = sql(
    _CONDITIONED,
    f"""select condition, v as value, count(*) as n, round(avg(err), 6) as mae, round(sqrt(avg(err * err)), 6) as rmse, round(quantile_cont(err, 0.9), 6) as p90,
count(*) filter (where err >= large) as large_errors, round(avg(case when peak >= event then 1 else 0 end), 6) as peak_rate, {_CONF.format(e="peak >= event", a="gated * 2 >= event")} from named group by condition, v""",
)


def error_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, p95 and share of events by state, hour, kind of day and week, in one pass."""
    rows = predictions(spark, sf_dir).withColumn("err", ev.error("gated"))
    keys = {"state": F.col("state"), "hour": F.hour("ts"), "day_type": day_type(F.col("ts")), "week": F.date_format(period(), "yyyy-MM-dd"), "weekend": flag(is_weekend(F.col("ts"))), "event": flag(F.col("peak") >= F.col("event")), "was_active": flag(F.col("output_before") > 0)}
    return rounded(ev.metrics_by(rows, keys, F.count("*").alias("n"), F.avg("actual").alias("actual_mean"), F.avg("err").alias("mae"), F.expr("percentile(err, 0.95)").alias("p95"), F.avg(flag(F.col("peak") >= F.col("event"))).alias("peak_rate")))


ERROR_CONDITIONS = sql(
    PREDICTIONS
    + """, e as (
  select *, abs(gated - actual) as err, case when peak >= event then 1 else 0 end as is_event from predictions
), named as (
  select e.*, k.condition, case k.condition when 'state' then state when 'hour' then extract(hour from ts)::int::varchar when 'day_type' then case when isodow(ts) >= 6 then 'weekend' else 'weekday' end
    when 'week' then strftime(date_trunc('week', ts), '%Y-%m-%d') when 'weekend' then case when isodow(ts) >= 6 then '1' else '0' end when 'event' then is_event::varchar
    else case when output_before > 0 then '1' else '0' end end as v
  from e, (values ('state'), ('hour'), ('day_type'), ('week'), ('weekend'), ('event'), ('was_active')) k(condition)
)""",
    "select condition, v as value, count(*) as n, round(avg(actual), 6) as actual_mean, round(avg(err), 6) as mae, round(quantile_cont(err, 0.95), 6) as p95, round(avg(is_event), 6) as peak_rate from named group by condition, v",
)


def largest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("series_id", "ts", "actual", "state", six("gated").alias("prediction"), six(ev.error("gated")).alias("err"))
    return ev.largest(rows, "err", 20, "ts", "series_id")


LARGEST_ERRORS = sql(PREDICTIONS, "select series_id, ts, actual, state, round(gated, 6) as prediction, round(abs(gated - actual), 6) as err from predictions order by err desc, ts, series_id limit 20")


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of weekly errors of each candidate, and the one chosen (least, first on a tie)."""
    scores = ev.mean_of_periods(ev.long_errors(predictions(spark, sf_dir), CANDIDATES, period()))
    chosen = ev.best(rounded(scores)).select(F.col("candidate").alias("chosen"))
    return rounded(scores).crossJoin(F.broadcast(chosen))  # one row


_WEEKLY = LONG + ", weekly as (select candidate, ordinal, period, avg(err) as mae, count(*) as n from long group by all)"
CANDIDATE_SCORES = sql(
    _WEEKLY + ", s as (select candidate, ordinal, round(avg(mae), 6) as score from weekly group by all)",
    "select candidate, ordinal, score, (select candidate from s order by score, ordinal limit 1) as chosen from s",
)


def forward_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.forward_selection(ev.long_errors(predictions(spark, sf_dir), CANDIDATES, period())))


FORWARD_SELECTION = sql(
    _WEEKLY
    + """, k as (
  select *, round(avg(mae) over (partition by candidate order by period rows between unbounded preceding and 1 preceding), 9) as earlier from weekly
)""",
    "select period, candidate, round(earlier, 6) as earlier, round(mae, 6) as mae, n from k where earlier is not null qualify row_number() over (partition by period order by earlier, ordinal) = 1",
)


def idle_gate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean weekly error of the gate for each pair of idle hours and load cap, and how many hours it overrides."""
    panel = event_panel(spark, sf_dir)
    rows = predictions(spark, sf_dir).select("series_id", "ts", "actual", "persistence", "blend")
    for hours in (6, 12, 24):
        rows = rows.join(features.idle_signal(panel, hours).withColumnRenamed("idle_hours", f"idle_{hours}"), ["series_id", "ts"])
    pairs = F.explode(F.array(*(F.struct(F.lit(h).alias("hours"), F.lit(float(c)).alias("cap"), F.col(f"idle_{h}").alias("idle")) for h in (6, 12, 24) for c in (5, 10, 20, 40, 80))))
    named = rows.select("*", pairs.alias("g")).select("ts", "actual", "persistence", "blend", "g.hours", "g.cap", (F.col("g.idle") & (F.col("persistence") <= F.col("g.cap"))).alias("gate"))
    err = F.abs(F.when(F.col("gate"), F.col("persistence")).otherwise(F.col("blend")) - F.col("actual"))
    weeks = named.groupBy("hours", "cap", period().alias("period")).agg(F.avg(err).alias("mae"), F.count_if("gate").alias("gated"))
    return rounded(weeks.groupBy("hours", "cap").agg(F.avg("mae").alias("score"), F.sum("gated").alias("gated_hours")))


IDLE_GATE_GRID = sql(
    PREDICTIONS
    + "".join(
        f""", idle_{h} as (select series_id, ts, coalesce(case when count(production) over w = {h} then sum(production) over w end = 0, false) as idle
  from dense window w as (partition by series_id order by ts rows between {h} preceding and 1 preceding))"""
        for h in (6, 12, 24)
    )
    + """, pairs as (
  select p.ts, p.actual, p.persistence, p.blend, g.hours, c.cap, case g.hours when 6 then a.idle when 12 then b.idle else d.idle end and persistence <= c.cap as gate
  from predictions p join idle_6 a using (series_id, ts) join idle_12 b using (series_id, ts) join idle_24 d using (series_id, ts), (values (6), (12), (24)) g(hours), (values (5.0::double), (10), (20), (40), (80)) c(cap)
), weeks as (
  select hours, cap, date_trunc('week', ts) as period, avg(abs(case when gate then persistence else blend end - actual)) as mae, count(*) filter (where gate) as gated from pairs group by all
)""",
    "select hours, cap, round(avg(mae), 6) as score, sum(gated)::bigint as gated_hours from weeks group by hours, cap",
)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("series_id", "ts", six("gated").alias("score"), (F.col("peak") >= F.col("event")).alias("is_event"))


_SCORED = PREDICTIONS + ", scored as (select series_id, ts, round(gated, 6) as score, peak >= event as is_event from predictions)"
_SCAN = (
    _SCORED
    + """, counted as (
  select series_id, score, count(*) as n, count(*) filter (where is_event) as p from scored group by series_id, score
), scan as (
  select *, sum(n) over d as alerts, sum(p) over d as tp, sum(p) over (partition by series_id) as positives from counted
  window d as (partition by series_id order by score desc rows between unbounded preceding and current row)
)"""
)


def recall_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.threshold_for_recall(_scored(spark, sf_dir), "score", "is_event", 0.85, "series_id")


RECALL_THRESHOLDS = sql(_SCAN, "select series_id, max(score) as threshold from scan where positives > 0 and tp / positives >= 0.85 group by series_id")


def f2_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.threshold_for_f2(_scored(spark, sf_dir), "score", "is_event", "series_id"))


F2_THRESHOLDS = sql(
    _SCAN,
    """select series_id, score as threshold, round(5 * tp / (5 * tp + 4 * (positives - tp) + alerts - tp), 6) as f2 from scan
qualify row_number() over (partition by series_id order by round(5 * tp / (5 * tp + 4 * (positives - tp) + alerts - tp), 12) desc, score desc) = 1""",
)


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.average_precision(_scored(spark, sf_dir), "score", "is_event", "series_id"))


AVERAGE_PRECISION = sql(_SCAN, "select series_id, round(sum(p * tp / alerts / positives), 6) as average_precision from scan where positives > 0 group by series_id")


def conformal_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("series_id", six(ev.error("gated")).alias("err"))
    return ev.conformal_radius(rows, "err", 0.9, "series_id")


CONFORMAL_RADII = sql(
    PREDICTIONS + ", r as (select series_id, round(abs(gated - actual), 6) as err, row_number() over (partition by series_id order by abs(gated - actual)) as k, count(*) over (partition by series_id) as n from predictions)",
    "select series_id, n, max(err) filter (where k = ceil((n + 1) * 0.9::double)) as radius from r group by series_id, n",
)


def _weekly_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("series_id", "ts", period().alias("period"), "idle", "actual", six("gated").alias("prediction"), six(ev.error("gated")).alias("err"))


def regime_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.regime_radii(_weekly_errors(spark, sf_dir), 0.9)


_RADII = (
    PREDICTIONS
    + """, errs as (
  select series_id, ts, date_trunc('week', ts)::timestamp as period, case when idle = 1 then 'idle' else 'other' end as regime, actual, round(gated, 6) as prediction, round(abs(gated - actual), 6) as err from predictions
), ranked as (
  select *, row_number() over (partition by period, regime order by err) as k, count(*) over (partition by period, regime) as n, row_number() over (partition by period order by err) as wk, count(*) over (partition by period) as wn from errs
), whole as (
  select period, max(err) filter (where wk = ceil((wn + 1) * 0.9::double)) as radius from ranked group by period
), own as (
  select period, regime, n, max(err) filter (where k = ceil((n + 1) * 0.9::double)) as radius from ranked group by period, regime, n
), radii as (
  select w.period, g.regime, coalesce(o.n, 0) as n, case when coalesce(o.n, 0) < 30 then w.radius else o.radius end as radius, case when coalesce(o.n, 0) < 30 then 1 else 0 end as fallback
  from whole w cross join (values ('idle'), ('other')) g(regime) left join own o on o.period = w.period and o.regime = g.regime
)"""
)
REGIME_RADII = sql(_RADII, "select * from radii")


def prediction_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _weekly_errors(spark, sf_dir)
    before = F.col("period") - F.expr("interval 7 days")
    return rounded(ev.attach_intervals(rows, ev.regime_radii(rows, 0.9), before).select("series_id", "ts", "regime", "prediction", "lower", "upper"))


_INTERVALS = (
    _RADII
    + """, intervals as (
  select e.series_id, e.ts, e.period, e.regime, e.actual, e.prediction, greatest(0, e.prediction - r.radius) as lower, e.prediction + r.radius as upper
  from errs e join radii r on r.period = e.period - interval 7 day and r.regime = e.regime
)"""
)
PREDICTION_INTERVALS = sql(_INTERVALS, "select series_id, ts, regime, prediction, round(lower, 6) as lower, round(upper, 6) as upper from intervals")


def interval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _weekly_errors(spark, sf_dir)
    before = F.col("period") - F.expr("interval 7 days")
    return rounded(ev.attach_intervals(rows, ev.regime_radii(rows, 0.9), before).groupBy("period", "regime").agg(*ev.interval_metrics()))


INTERVAL_METRICS = sql(
    _INTERVALS,
    """select period, regime, count(*) as n, round(avg(case when lower <= actual and actual <= upper then 1 else 0 end), 6) as coverage, round(avg(upper - lower), 6) as width,
round(avg(upper - lower + 20 * greatest(lower - actual, 0) + 20 * greatest(actual - upper, 0)), 6) as interval_score from intervals group by period, regime""",
)


def calibration_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the latest week that has at least two days of them, for each site."""
    return ev.latest_period_with(_weekly_errors(spark, sf_dir).select("series_id", "ts", "period", "err"), 48, "series_id")


CALIBRATION_ERRORS = sql(
    _RADII + ", sizes as (select series_id, period from errs group by series_id, period having count(*) >= 48), last as (select series_id, max(period) as period from sizes group by series_id)",
    "select e.series_id, e.ts, e.period, e.err from errs e join last l on l.series_id = e.series_id and l.period = e.period",
)


def peak_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("is_event", F.col("peak") >= F.col("event")).withColumn("alert", flag(F.col("gated") * 2 >= F.col("event")))
    return ev.episodes(rows, "is_event", F.max("peak").alias("top"), F.min_by("alert", "ts").alias("alert_at_onset"))


PEAK_EPISODES = sql(
    PREDICTIONS
    + """, e as (select *, peak >= event as on_, case when gated * 2 >= event then 1 else 0 end as alert from predictions),
f as (select *, case when on_ and not coalesce(lag(on_) over (partition by series_id order by ts), false) then 1 else 0 end as first_ from e),
g as (select *, sum(first_) over (partition by series_id order by ts)::bigint as episode from f)""",
    "select series_id, episode, min(ts) as start_ts, max(ts) as end_ts, count(*) as hours, max(peak) as top, arg_min(alert, ts) as alert_at_onset from g where on_ group by series_id, episode",
)


def alert_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of false and missed alerts for several price ratios."""
    event, alert = F.col("peak") >= F.col("event"), F.col("gated") * 2 >= F.col("event")
    counts = predictions(spark, sf_dir).groupBy("series_id").agg(*ev.confusion(event, alert))
    return counts.withColumn("ratio", F.explode(F.array(*(F.lit(r) for r in (1, 2, 5, 10))))).withColumn("cost", F.col("fp") + F.col("ratio") * F.col("fn"))


ALERT_COSTS = sql(
    PREDICTIONS + f", c as (select series_id, {_CONF.format(e='peak >= event', a='gated * 2 >= event')} from predictions group by series_id)",
    "select c.*, r.ratio::int as ratio, fp + ratio * fn as cost from c, (values (1), (2), (5), (10)) r(ratio)",
)


def guarded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that never fall far behind the baseline, scored on hours of change."""
    rows = predictions(spark, sf_dir)
    scores = ev.guarded_choice(rows, ["gated", "blend", "previous_day", "previous_week", "persistence"], "gated", period(), F.col("state").isin("startup", "shutdown"))
    return rounded(scores)


GUARDED_CANDIDATES = sql(
    LONG
    + """, m as (
  select candidate, case candidate when 'gated' then 0 when 'blend' then 1 when 'previous_day' then 2 when 'previous_week' then 3 else 4 end as ordinal, period, avg(err) as mae, avg(err) filter (where state in ('startup', 'shutdown')) as changing from long group by all
), b as (select period, mae as base from m where candidate = 'gated')""",
    """select m.candidate, m.ordinal, round(avg(m.mae), 6) as score, round(avg(m.changing), 6) as changing_score,
case when avg(m.mae) <= 1.01 * avg(b.base) and min(case when m.mae <= 1.05 * b.base then 1 else 0 end) = 1 then 1 else 0 end as eligible from m join b on b.period = m.period group by m.candidate, m.ordinal""",
)


def trajectory_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-ahead errors of the previous week by horizon."""
    rows = features.trajectories(event_panel(spark, sf_dir))
    return rounded(rows.groupBy("horizon").agg(*ev.regression("mean_week", "target")))


TRAJECTORY_METRICS = sql(TRAJECTORIES_CTE, f"select horizon, {_reg('mean_week', 'target')} from trajectories group by horizon")


def daily_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day: how far the forecast's peak and its hour are from the real ones."""
    rows = features.trajectories(event_panel(spark, sf_dir))
    real, guess = ev.first_peak(rows, "target", "series_id", "anchor"), ev.first_peak(rows, "mean_week", "series_id", "anchor")
    both = real.join(guess, ["series_id", "anchor"])
    return rounded(both.select("series_id", "anchor", F.abs(F.col("target_top") - F.col("mean_week_top")).alias("peak_gap"), F.abs(F.col("target_at") - F.col("mean_week_at")).alias("hours_apart")))


DAILY_PEAKS = sql(
    TRAJECTORIES_CTE
    + """, a as (select series_id, anchor, horizon, target from trajectories qualify row_number() over (partition by series_id, anchor order by target desc, horizon) = 1),
b as (select series_id, anchor, horizon, mean_week from trajectories qualify row_number() over (partition by series_id, anchor order by mean_week desc, horizon) = 1)""",
    "select a.series_id, a.anchor, round(abs(target - mean_week), 6) as peak_gap, abs(a.horizon - b.horizon) as hours_apart from a join b on a.series_id = b.series_id and a.anchor = b.anchor",
)


def lead_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request errors by lead, issue hour, week, work start and idle origin."""
    rows = requests.request_rows(event_panel(spark, sf_dir)).withColumn("err", ev.error("previous_week"))
    keys = {"lead": lead_bucket(F.col("lead")), "issue_hour": F.hour("origin"), "week": F.date_format(truncated("week", F.col("origin")), "yyyy-MM-dd"), "work_start": flag(is_work_start(F.col("ts"))), "idle_origin": flag(F.col("output_sum_24") == 0)}
    return rounded(ev.metrics_by(rows, keys, F.count("*").alias("n"), F.count_distinct("series_id", "origin").alias("requests"), F.avg("err").alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse")))


LEAD_BUCKETS = sql(
    REQUESTS_CTE
    + """, named as (
  select r.*, abs(previous_week - actual) as err, k.condition, case k.condition when 'lead' then case when lead <= 6 then '01-06' when lead <= 12 then '07-12' else '13-24' end
    when 'issue_hour' then extract(hour from origin)::int::varchar when 'week' then strftime(date_trunc('week', origin), '%Y-%m-%d')
    when 'work_start' then case when isodow(ts) < 6 and extract(hour from ts) between 7 and 9 then '1' else '0' end else case when output_sum_24 = 0 then '1' else '0' end end as v
  from requests r, (values ('lead'), ('issue_hour'), ('week'), ('work_start'), ('idle_origin')) k(condition)
)""",
    "select condition, v as value, count(*) as n, count(distinct row(series_id, origin)) as requests, round(avg(err), 6) as mae, round(sqrt(avg(err * err)), 6) as rmse from named group by condition, v",
)


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which days need a review, and why: profiles that disagree more than in three of four cases, or a day without production."""
    days = rounded(features.origin_signals(event_panel(spark, sf_dir)))
    rows = days.crossJoin(F.broadcast(days.agg(six(F.expr("percentile(disagreement, 0.75)")).alias("cutoff"))))  # one row
    high, idle = F.col("disagreement") > F.col("cutoff"), F.col("no_output") == 1
    reason = F.concat_ws("+", F.when(high, F.lit("profiles_disagree")), F.when(idle, F.lit("no_production")))
    return rows.select("series_id", "day", "disagreement", "no_output", flag(high | idle).alias("review"), F.when(reason == "", "standard").otherwise(reason).alias("reason"))


REVIEW_DECISIONS = sql(
    SIGNALS + ", cut as (select round(quantile_cont(disagreement, 0.75), 6) as cutoff from signals)",
    """select series_id, day, disagreement, no_output, case when disagreement > cutoff or no_output = 1 then 1 else 0 end as review,
case when disagreement > cutoff and no_output = 1 then 'profiles_disagree+no_production' when disagreement > cutoff then 'profiles_disagree' when no_output = 1 then 'no_production' else 'standard' end as reason from signals, cut""",
)


def improvement_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day sums of the gate's gain over the ungated blend, which the bootstrap draws from."""
    rows = predictions(spark, sf_dir).select("ts", (ev.error("blend") - ev.error("gated")).alias("gain"))
    return rounded(resampling.day_sums(rows, "gain"))


IMPROVEMENT_BY_DAY = sql(
    PREDICTIONS + ", d as (select date_trunc('day', ts)::timestamp as day, round(sum(abs(blend - actual) - abs(gated - actual)), 6) as total, count(*) as n from predictions group by 1)",
    "select *, row_number() over (order by day) - 1 as ordinal from d",
)


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("ts", (ev.error("blend") - ev.error("gated")).alias("gain"))
    days = resampling.day_sums(rows, "gain").persist()
    return rounded(resampling.bootstrap_mean(days, resampling.block_draws(spark, days.count())))


def day_cluster_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("ts", "idle", ev.error("gated").alias("err"))
    return rounded(resampling.bootstrap_difference(rows, "idle", "err"))


def permutation_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the blend's error grows if one of its references is taken from another hour."""
    rows = predictions(spark, sf_dir).select("series_id", "ts", "actual", "previous_day", "previous_week")
    parts = None
    for group in (["previous_day"], ["previous_week"], ["previous_day", "previous_week"]):
        mixed = resampling.permuted(rows, group).withColumn("blend", (F.col("previous_day") + F.col("previous_week")) / 2)
        part = mixed.groupBy("repeat").agg(F.avg(ev.error("blend")).alias("mae")).select(F.lit("+".join(group)).alias("columns"), "repeat", "mae")
        parts = part if parts is None else parts.unionByName(part)
    return rounded(parts)


def adopted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks select, the last but one accepts, and the last shows what each candidate then did."""
    rows = predictions(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg((F.max(period()) - F.expr("interval 7 days")).alias("decide"))))  # one row
    return rounded(ev.adopted_choice(rows, ["previous_week", "gated", "blend", "previous_day", "persistence"], "previous_week", period(), F.col("state").isin("startup", "shutdown"), F.col("decide")))


ADOPTED_CANDIDATES = sql(
    LONG
    + """, d as (select max(period) - interval 7 day as decide from long
), m as (
  select candidate, case candidate when 'previous_week' then 0 when 'gated' then 1 when 'blend' then 2 when 'previous_day' then 3 else 4 end as ordinal, period, avg(err) as mae,
         avg(err) filter (where state in ('startup', 'shutdown')) as changing from long, d where period < decide group by all
), b as (select period, mae as base from m where candidate = 'previous_week'
), s as (
  select candidate, ordinal, avg(mae) as score, avg(changing) as changing_score, case when avg(mae) <= 1.01 * avg(base) and bool_and(mae <= 1.05 * base) then 1 else 0 end as eligible from m join b using (period) group by all
), c as (select candidate as chosen from s where eligible = 1 order by round(changing_score, 9) nulls last, ordinal limit 1
), a as (
  select candidate, avg(err) filter (where period = decide) as whole, avg(err) filter (where period = decide and state in ('startup', 'shutdown')) as change, avg(err) filter (where period > decide) as later
  from long, d where period >= decide group by candidate
), p as (select coalesce(x.whole <= 1.01 * y.whole and x.change <= 0.95 * y.change, false) as passes from c join a x on x.candidate = c.chosen join a y on y.candidate = 'previous_week')""",
    """select s.candidate, s.ordinal, round(s.score, 6) as score, round(s.changing_score, 6) as changing_score, s.eligible, case when s.candidate = chosen then 1 else 0 end as selected,
       case when s.candidate = chosen and passes then 1 else 0 end as accepted, case when s.candidate = case when passes then chosen else 'previous_week' end then 1 else 0 end as adopted, round(a.later, 6) as later_mae
from s join a on a.candidate = s.candidate, c, p""",
)


def consecutive_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of state and hours between them."""
    w = Window.partitionBy("series_id").orderBy("ts")
    rows = features.observed_states(event_panel(spark, sf_dir)).withColumn("before", F.lag("state").over(w)).where("state <> before")
    return rows.groupBy("series_id", "before", "state").agg(F.count("*").alias("changes"))


CONSECUTIVE_STATES = sql(
    PREDICTIONS
    + """, s as (select *, coalesce(lag(production, 1) over (partition by series_id order by ts) > 0, false) as was from dense),
t as (select series_id, ts, case when production > 0 and not was then 'startup' when not production > 0 and was then 'shutdown' when production > 0 then 'running' else 'idle' end as state from s where production is not null),
u as (select *, lag(state) over (partition by series_id order by ts) as before from t)""",
    "select series_id, before, state, count(*) as changes from u where state <> before group by series_id, before, state",
)

_DRAWS = """, draws as (
  select repeat, (('0x' || substr(md5('{seed}|' || repeat || '|' || (place // least({block}, n))), 1, 8))::bigint + place % least({block}, n)) % n as ordinal
  from (select count(*) as n from numbered), range(0, 2000) r(repeat), (select unnest(range(0, (select count(*) from numbered))) as place)
)"""

BOOTSTRAP_INTERVAL = sql(
    PREDICTIONS
    + """, numbered as (
  select date_trunc('day', ts) as day, sum(abs(blend - actual) - abs(gated - actual)) as total, count(*) as n, row_number() over (order by date_trunc('day', ts)) - 1 as ordinal from predictions group by 1
)"""
    + _DRAWS.format(seed=42, block=7)
    + ", means as (select sum(total) / sum(n) as m from draws join numbered using (ordinal) group by repeat)",
    "select round(quantile_cont(m, 0.025), 6) as lower, (select round(sum(total) / sum(n), 6) from numbered) as mean, round(quantile_cont(m, 0.975), 6) as upper from means",
)

DAY_CLUSTER_DIFFERENCE = sql(
    PREDICTIONS
    + """, numbered as (
  select date_trunc('day', ts) as day, row_number() over (order by date_trunc('day', ts)) - 1 as ordinal,
         sum(abs(gated - actual)) filter (where idle = 1) as t1, count(*) filter (where idle = 1) as n1, sum(abs(gated - actual)) filter (where idle = 0) as t0, count(*) filter (where idle = 0) as n0
  from predictions group by 1
)"""
    + _DRAWS.format(seed=7, block=1)
    + """, means as (
  select sum(t1) / nullif(sum(n1), 0) - sum(t0) / nullif(sum(n0), 0) as m from draws join numbered using (ordinal) group by repeat
)""",
    """select round(quantile_cont(m, 0.025), 6) as lower, (select round(sum(t1) / nullif(sum(n1), 0) - sum(t0) / nullif(sum(n0), 0), 6) from numbered) as difference,
       round(quantile_cont(m, 0.975), 6) as upper from means where m is not null""",
)

PERMUTATION_SENSITIVITY = sql(
    PREDICTIONS
    + """, many as (
  select p.*, r.repeat::int as repeat, row_number() over (partition by series_id, r.repeat order by ts) as k,
         row_number() over (partition by series_id, r.repeat order by md5('42|' || r.repeat || '|' || series_id || '|' || strftime(ts, '%Y-%m-%d %H')), ts) as other
  from predictions p, range(0, 3) r(repeat)
), taken as (
  select m.repeat, m.actual, m.previous_day, m.previous_week, d.previous_day as other_day, d.previous_week as other_week
  from many m join many d on d.series_id = m.series_id and d.repeat = m.repeat and d.other = m.k
)""",
    """select 'previous_day' as columns, repeat, round(avg(abs((other_day + previous_week) / 2 - actual)), 6) as mae from taken group by repeat
union all select 'previous_week', repeat, round(avg(abs((previous_day + other_week) / 2 - actual)), 6) from taken group by repeat
union all select 'previous_day+previous_week', repeat, round(avg(abs((other_day + other_week) / 2 - actual)), 6) from taken group by repeat""",
)

_NAMES = """daily_baseline prediction_table regression_metrics alert_scores condition_metrics error_conditions largest_errors candidate_scores forward_selection
idle_gate_grid recall_thresholds f2_thresholds average_precision conformal_radii regime_radii prediction_intervals interval_metrics calibration_errors peak_episodes
alert_costs guarded_candidates adopted_candidates trajectory_metrics daily_peaks lead_buckets review_decisions improvement_by_day consecutive_states
bootstrap_interval day_cluster_difference permutation_sensitivity""".split()
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLES = {name: globals()[name.upper()] for name in _NAMES}
