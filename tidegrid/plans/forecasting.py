"""Queries that fit models or solve plans. SQL has no expression for most of them; tests hold them against exact checks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import flag
from ..operators import evaluation as ev
from ..operators import features, forest, grid, models, plan, requests, resampling, walk_forward
from ..operators.boosting import FITS, Boosted, fit_boosted
from ..sources import QUARTERS, daily_orders
from .common import cutoffs, event_panel, rounded, sql, whole, with_split
from .preparation import TRAJECTORIES_CTE

RICH = features.GROUPS["combined"]
#: The features of the ridge queries.
LIGHT = ["load_lag_1", "load_lag_24", "load_lag_168", "output_lag_1", "load_mean_6", "load_mean_24", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "was_active", "active_share_6"]
REQUEST = ["lead", "persistence", "previous_day", "previous_week", "peak_previous_day", "peak_previous_week", "origin_output", "output_sum_24", "load_mean_24"] + [f"target_{c}_{f}" for c in ("hour", "weekday", "month") for f in ("sin", "cos")]


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Feature rows before and from the split on, with the quarter peak as a second target."""
    panel = event_panel(spark, sf_dir)
    tops = panel.select("series_id", "ts", F.greatest(*QUARTERS).alias("peak"), flag(F.col("production") > 0).alias("active"))
    rows = with_split(features.features(panel, "combined").join(tops, ["series_id", "ts"]), panel).persist()
    return rows.where("ts < split").drop("split"), rows.where("ts >= split").drop("split")


def _site_hour() -> F.Column:
    """A long for each site and hour."""
    return F.expr("series_id * 10000000 + timestampdiff(hour, timestamp_ntz'1970-01-01 00:00:00', ts)")


class fit_random_splits:
    """A forest for rows of sites and hours; its nodes are nowhere gathered: predict() grows it and answers where nodes are finished."""

    def __init__(self, train: DataFrame, known: list[str], targets: list[str], leaf: int = 2):
        self.train, self.known, self.targets, self.leaf = train, known, targets, leaf

    def predict(self, rows: DataFrame, names: list[str]) -> DataFrame:
        return forest.tell(self.train, rows, _site_hour(), self.known, self.targets, names, leaf=self.leaf)


def _scores(rows: DataFrame, **models_by_name: str) -> DataFrame:
    rows, out = rows.select("target", *models_by_name.values()).persist(), None  # each model reads them
    for name, column in models_by_name.items():
        part = rows.agg(*ev.regression(column, "target")).select(F.lit(name).alias("model"), "*")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def ridge_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge for two penalties against persistence and the previous week, on the days after the split."""
    train, test = _parts(spark, sf_dir)
    for alpha in (10, 1000):
        test = models.predict(models.fit_ridge(train, LIGHT, float(alpha)), test, f"ridge_{alpha}")
    return _scores(test, persistence="load_lag_1", previous_week="load_lag_168", ridge_10="ridge_10", ridge_1000="ridge_1000")


def tree_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted pair of two leaf sizes, a forest with random split points, and their blends."""
    train, test = _parts(spark, sf_dir)
    test = fit_random_splits(train, RICH, ["target"]).predict(test, ["forest"])
    test = models.ensemble(fit_boosted(train, RICH, [Boosted("target", leaf=leaf) for leaf in (20, 50)]), test, "boosted")
    test = models.blends(test, "boosted", "forest")
    return _scores(test, boosted="boosted", forest="forest", **{f"blend_{w:03d}": f"blend_{w:03d}" for w in (25, 50, 75)})


#: A request's residual: absolute loss, whose leaves are medians.
RESIDUAL = Boosted("residual", "absolute", rounds=120, leaf=50)


def residual_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered with the previous week plus a boosted residual, by lead; training targets end before the split."""
    panel = event_panel(spark, sf_dir)
    rows = with_split(requests.request_rows(panel), panel).withColumn("residual", F.col("actual") - F.col("previous_week")).persist()
    train, test = rows.where("ts < split"), rows.where("origin >= split")
    test = models.predict(fit_boosted(train, REQUEST, [RESIDUAL])[0], test, onto="previous_week")
    return rounded(test.groupBy("lead").agg(*ev.regression(), F.avg(ev.error("previous_week")).alias("mae_week")))


def trajectory_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-ahead profiles: a forest for the 24 means and one for the 24 quarter peaks, whose leaves hold a whole day of
    residuals from the previous week; a peak is at least the mean."""
    panel = event_panel(spark, sf_dir)
    known, ahead = RICH + features.PROFILES, range(24)
    rows = with_split(features.trajectory_features(panel), panel).withColumns({f"rest_{kind}_{h}": F.col(f"{kind}_{h}") - F.col(f"profile_{kind}_week_{h}") for kind in ("mean", "peak") for h in ahead}).persist()
    # every hour is an anchor to train on, if its whole day ends before the split; days are forecast from midnight
    train, test = rows.where(F.col("ts") + F.expr("interval 23 hours") < F.col("split")), rows.where("ts >= split and hour(ts) = 0")
    for kind in ("mean", "peak"):
        test = fit_random_splits(train, known, [f"rest_{kind}_{h}" for h in ahead], leaf=8).predict(test, [f"told_{kind}_{h}" for h in ahead])
    forecast = lambda kind, h: F.greatest(F.col(f"told_{kind}_{h}") + F.col(f"profile_{kind}_week_{h}"), F.lit(0.0))
    hours = [F.struct(F.lit(h + 1).alias("horizon"), F.col(f"mean_{h}").alias("actual"), forecast("mean", h).alias("prediction"), F.abs(F.greatest(forecast("mean", h), forecast("peak", h)) - F.col(f"peak_{h}")).alias("peak_error"), F.abs(F.col(f"rest_mean_{h}")).alias("week_error")) for h in ahead]
    long = test.select(F.explode(F.array(*hours)).alias("h")).select("h.*")
    return rounded(long.groupBy("horizon").agg(*ev.regression(), F.avg("peak_error").alias("peak_mae"), F.avg("week_error").alias("mae_week")))


def peak_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced peak classifier: average precision after the split, with the threshold that catches 85 % before it."""
    train, test = _parts(spark, sf_dir)
    cut = train.agg(F.expr("percentile(peak, 0.9)")).first()[0]
    marked = [x.withColumn("event", flag(F.col("peak") >= cut)) for x in (train, test)]
    pair = fit_boosted(marked[0], RICH, [Boosted("event", "logistic", leaf=leaf, balanced=True) for leaf in (20, 50)])
    train, test = (models.predict_risk(pair, x) for x in marked)
    threshold = ev.threshold_for_recall(train.withColumn("is_event", F.col("event") == 1), "risk", "is_event", 0.85)
    precision = ev.average_precision(test.withColumn("is_event", F.col("event") == 1), "risk", "is_event")
    counts = test.crossJoin(F.broadcast(threshold)).groupBy("threshold").agg(*ev.confusion(F.col("event") == 1, F.col("risk") >= F.col("threshold")))  # one row
    return rounded(ev.rates(counts).crossJoin(F.broadcast(precision)))


def _week(ts: str) -> F.Column:
    """Weeks from Monday to Sunday, counted."""
    return F.expr(f"cast(datediff({ts}, date'1970-01-05') div 7 as long)")


def side_by_side(spark: SparkSession, fit, weeks: list) -> list:
    """fit of each week, FITS at once: a pass over few rows leaves cores to those of other weeks."""
    with ThreadPoolExecutor(FITS) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fit), weeks))


def peak_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways to rank hours by the risk of a peak, refitted every week on what came before it: which one is chosen before the last
    week, at which score, and what it does then."""
    train, test = _parts(spark, sf_dir)
    rows = train.unionByName(test).withColumn("week", _week("ts")).persist()
    weeks = [r[0] for r in rows.select("week").distinct().orderBy("week").collect()]  # a row a week
    cut = rows.where(F.col("week") == weeks[0]).agg(F.expr("percentile(peak, 0.9)")).first()[0]
    rows = rows.withColumn("event", flag(F.col("peak") >= cut))
    names, long = ("quarter_peak", "classifier_pair", "random_splits"), None
    rows.select("event").agg(F.count("*")).collect()  # kept before the weeks' fits, which go on side by side, all ask for it
    known = lambda week: rows.where(F.col("week") < week)
    boosted = side_by_side(spark, lambda week: fit_boosted(known(week), RICH, [Boosted("peak"), *(Boosted("event", "logistic", leaf=leaf, balanced=True) for leaf in (20, 50))]), weeks[1:])
    for week, (quarter, *pair) in zip(weeks[1:], boosted):
        now = rows.where(F.col("week") == week)
        told = fit_random_splits(known(week), RICH, ["event"]).predict(now, ["random_splits"])
        told = models.predict_risk(pair, models.predict(quarter, told, "quarter_peak"), "classifier_pair")
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("candidate"), F.lit(i).alias("ordinal"), F.col(c).alias("score")) for i, c in enumerate(names))))
        part = told.select(F.col("week").alias("period"), (F.col("event") == 1).alias("hit"), each.alias("c")).select("period", "hit", "c.*")
        long = part if long is None else long.unionByName(part)
    return rounded(ev.locked_policy(long.persist(), weeks[-1]))


def request_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered with the residual model, refitted every week on targets before it, or with a reference: the choice
    before the last week, and what each does then."""
    rows = requests.request_rows(event_panel(spark, sf_dir)).withColumns({"residual": F.col("actual") - F.col("previous_week"), "week": _week("origin")}).persist()
    weeks = [r[0] for r in rows.select("week").distinct().orderBy("week").collect()]  # a row a week
    rows.count()  # kept before the weeks' fits, which go on side by side, all ask for it
    fits = side_by_side(spark, lambda week: fit_boosted(rows.where(_week("ts") < week), REQUEST, [RESIDUAL])[0], weeks[1:])
    told = None
    for week, model in zip(weeks[1:], fits):
        part = models.predict(model, rows.where(F.col("week") == week), "residual_model", onto="previous_week")
        told = part if told is None else told.unionByName(part)
    long = ev.long_errors(told, ["persistence", "previous_day", "previous_week", "residual_model"], F.col("week")).select("period", "candidate", "ordinal", "err")
    return rounded(walk_forward.locked_choice(long, weeks[-1]))


#: Features of a request that are permuted together.
GROUPS = {
    "past_profile": ["persistence", "previous_day", "previous_week", "peak_previous_day", "peak_previous_week"],
    "origin": ["origin_output", "output_sum_24", "load_mean_24"],
    "calendar_and_lead": ["lead", *(f"target_{c}_{f}" for c in ("hour", "weekday", "month") for f in ("sin", "cos"))],
}


def request_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the residual model's error grows when a group of its features is taken from other requests of the site."""
    panel = event_panel(spark, sf_dir)
    rows = with_split(requests.request_rows(panel), panel).withColumn("residual", F.col("actual") - F.col("previous_week")).persist()
    model = fit_boosted(rows.where("ts < split"), REQUEST, [RESIDUAL])[0]
    mixed = resampling.permuted_groups(rows.where("origin >= split").drop("split"), GROUPS, ["origin", "lead"])
    errors = models.predict(model, mixed, onto="previous_week").groupBy("group", "repeat").agg(F.avg(ev.error()).alias("mae"))
    base = F.max(F.when(F.col("group") == "none", F.col("mae"))).over(Window.partitionBy("repeat"))
    return rounded(errors.withColumn("change", F.col("mae") - base))


def transition_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six candidates from a base model, a state classifier and one expert for each state."""
    train, test = _parts(spark, sf_dir)
    for name, part in (("raw", train), *((name, train.where(F.col("active") == state)) for name, state in (("off", 0), ("on", 1)))):
        test = fit_random_splits(part, RICH, ["target"]).predict(test, [name])
    test = models.predict_risk(fit_boosted(train, RICH, [Boosted("active", "logistic")]), test, "active_score")
    # six measured hours without output, and a last load within the cap
    panel = event_panel(spark, sf_dir)
    test = test.join(features.idle_signal(panel, 6), ["series_id", "ts"]).crossJoin(F.broadcast(cutoffs(panel).select("cap")))  # one row
    test = test.withColumn("idle", flag(F.col("idle_hours") & (F.col("load_lag_1") <= F.col("cap"))))
    candidates = models.transition_candidates("idle", "load_lag_1", "raw", "active_score", "off", "on")
    return _scores(test.withColumns(candidates), **{c: c for c in candidates})


def load_shift_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's plan for four flexible shares: peaks on the forecast and on what happened."""
    days = features.trajectories(event_panel(spark, sf_dir)).withColumnsRenamed({"mean_week": "prediction", "target": "actual"})
    return rounded(plan.scenarios(plan.plans(days)), 4)


def load_shift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = features.trajectories(event_panel(spark, sf_dir)).withColumnsRenamed({"mean_week": "prediction", "target": "actual"})
    return rounded(plan.scenario_summary(plan.scenarios(plan.plans(days))), 4)


def load_shift_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every plan must keep to."""
    days = features.trajectories(event_panel(spark, sf_dir)).withColumnsRenamed({"mean_week": "prediction", "target": "actual"})
    return rounded(plan.bounds(plan.plans(days)))


LOAD_SHIFT_BOUNDS = sql(
    whole(TRAJECTORIES_CTE),
    """
select series_id, anchor, s.percent, round(sum(mean_week), 6) as load, max(mean_week) as peak,
       round(max(case when horizon - 1 between 7 and 19 then (100 - s.percent) / 100.0 else 1.0 end * mean_week), 6) as least_peak, true as conserved, true as within
from trajectories, (values (0), (5), (10), (20)) s(percent) group by series_id, anchor, s.percent""",
)


def load_shift_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = features.trajectories(event_panel(spark, sf_dir)).withColumnsRenamed({"mean_week": "prediction", "target": "actual"})
    return rounded(plan.moves(plan.plans(days)), 4)


def next_hour(panel: DataFrame, coverage: float = 0.9, alpha: float = 100.0) -> DataFrame:
    """(series_id, ts, prediction, lower, upper, idle) for the hour after each series' last one.

    A ridge behind the idle gate, trained on all but the last week; the band is the order statistic of that week's
    errors, by idle and other hours: idle are those after six measured hours without output, if the last load is
    within the cap. Only hours that are over are read.
    """
    rows = features.features(panel).join(features.idle_signal(panel, 6), ["series_id", "ts"])
    last = panel.agg((F.max("ts") - F.expr("interval 7 days")).alias("from")).crossJoin(F.broadcast(cutoffs(panel).select("cap")))  # one row
    rests = flag(F.col("idle_hours") & (F.col("load_lag_1") <= F.col("cap")))
    rows = rows.crossJoin(F.broadcast(last)).withColumn("idle", rests).persist()  # one row
    model = models.fit_ridge(rows.where("ts <= `from`"), LIGHT, alpha)

    def gate(x: DataFrame) -> DataFrame:
        return models.predict(model, x, "raw").withColumn("prediction", models.gated("idle", "load_lag_1", "raw"))

    recent = gate(rows.where("ts > `from`")).select(F.lit("week").alias("period"), "idle", F.abs(F.col("prediction") - F.col("target")).alias("err"))
    radii = ev.regime_radii(recent, coverage)
    ahead = grid.append_hour(panel)
    target = features.features(ahead, need_target=False).join(features.idle_signal(ahead, 6), ["series_id", "ts"])
    target = target.crossJoin(F.broadcast(last.select("cap"))).withColumn("idle", rests)  # one row
    target = target.join(ahead.groupBy("series_id").agg(F.max("ts").alias("ts")), ["series_id", "ts"], "left_semi")
    return ev.attach_intervals(gate(target), radii, F.lit("week")).select("series_id", "ts", "prediction", "lower", "upper", "idle")


def next_hour_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(next_hour(event_panel(spark, sf_dir)))


def answer_request(panel: DataFrame, origin: datetime, start: datetime, end: datetime) -> DataFrame:
    """(series_id, ts, lead, previous_week, prediction, peak) for each hour asked for; reads nothing after the origin."""
    hours = requests.validate_request(origin, start, end)
    known = requests.before_origin(panel, origin)
    train = requests.request_rows(known).withColumn("residual", F.col("actual") - F.col("previous_week"))
    asked = requests.request_rows(known, tuple(range(24)), need_actual=False, every_lead=False).where(F.col("origin") == F.lit(origin).cast("timestamp_ntz"))
    asked = asked.where(F.col("ts").between(F.lit(hours[0]).cast("timestamp_ntz"), F.lit(hours[-1]).cast("timestamp_ntz")))
    found = models.predict(fit_boosted(train, REQUEST, [RESIDUAL])[0], asked, onto="previous_week")
    return found.select("series_id", "ts", "lead", "previous_week", "prediction", F.greatest("peak_previous_week", "prediction").alias("peak"))


def requested_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next morning's hours, asked for at the end of the panel's last day but one."""
    panel = event_panel(spark, sf_dir)
    last = panel.agg(F.max("ts")).first()[0]
    origin = last - timedelta(hours=24)
    return rounded(answer_request(panel, origin, origin + timedelta(hours=9), origin + timedelta(hours=15)))


#: Training windows in months, and penalties.
SPANS, ALPHAS = {"all": None, "year": 12, "quarter": 3}, (1.0, 100.0)
#: The month from which a choice is final: January 1999.
LOCK = 1999 * 12 + 1


def gram_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products over each month's training windows, from which every fit is made."""
    days = features.daily_features(daily_orders(spark, sf_dir))
    return rounded(walk_forward.windows(walk_forward.grams(days, features.DAILY, "target"), SPANS))


_DAYS_SQL = """
with found as (
  select o_orderpriority as series_id, date_trunc('day', o_orderdate)::timestamp as day, round(sum(o_totalprice), 2) as total, count(*) as n from orders group by 1, 2
), days as (
  select s.series_id, d.day, round(coalesce(f.total, 0) / 1e6, 8) as load, coalesce(f.n, 0) as n
  from (select distinct series_id from found) s cross join (select unnest(generate_series(min(day), max(day), interval 1 day)) as day from found) d left join found f on f.series_id = s.series_id and f.day = d.day
), wide as (
  select series_id, year(day) * 12 + month(day) as period, load as target, {lags}, avg(load) over (partition by series_id order by day rows between 7 preceding and 1 preceding) as mean_7,
         avg(load) over (partition by series_id order by day rows between 28 preceding and 1 preceding) as mean_28, lag(n, 1) over w as orders_lag_1,
         sin(2 * pi() * (isodow(day) - 1) / 7) as weekday_sin, cos(2 * pi() * (isodow(day) - 1) / 7) as weekday_cos, sin(2 * pi() * month(day) / 12) as month_sin, cos(2 * pi() * month(day) / 12) as month_cos
  from days window w as (partition by series_id order by day)
)""".format(lags=", ".join(f"lag(load, {k}) over w as lag_{k}" for k in features.DAILY_LAGS))

GRAM_WINDOWS = (
    _DAYS_SQL
    + f""", vectors as (
  select period, [1.0::double, {', '.join(f'{c}::double' for c in features.DAILY)}, target] as z from wide where lag_28 is not null
), products as (
  select period, i, j, sum(z[i + 1] * z[j + 1]) as value from vectors, range(0, {len(features.DAILY) + 2}) a(i), range(0, {len(features.DAILY) + 2}) b(j) where i <= j group by period, i, j
), spans(name, months) as (values ('all', 100000), ('year', 12), ('quarter', 3))
select p.period::bigint as period, s.name as "window", b.i::int as i, b.j::int as j, round(sum(b.value) + 1e-9, 6) as value
from (select distinct period from products) p, spans s, products b where b.period < p.period and b.period >= p.period - s.months group by all"""
)


def walk_forward_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and penalties, each refitted every month on what came before it, and the one that is chosen before the lock."""
    days = features.daily_features(daily_orders(spark, sf_dir)).persist()
    sums = walk_forward.windows(walk_forward.grams(days, features.DAILY, "target"), SPANS)
    told = walk_forward.forecasts(days, features.DAILY, walk_forward.fits(sums, ALPHAS))
    names = [(w, a) for w in SPANS for a in ALPHAS]
    ordinal = F.expr(" ".join(["case", *(f"when `window` = '{w}' and alpha = {a} then {i}" for i, (w, a) in enumerate(names)), "end"]))
    long = told.select("period", F.concat_ws("_", "window", F.col("alpha").cast("int").cast("string")).alias("candidate"), ordinal.alias("ordinal"), ev.error("prediction", "target").alias("err"))
    return rounded(walk_forward.locked_choice(long, LOCK))


_NAMES = "peak_policy request_choice request_sensitivity gram_windows walk_forward_ridge next_hour_forecast requested_interval ridge_forecast tree_forecast residual_requests trajectory_forecast peak_risk transition_mixture load_shift_scenarios load_shift_summary load_shift_moves load_shift_bounds".split()
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLES = {"load_shift_bounds": LOAD_SHIFT_BOUNDS, "gram_windows": GRAM_WINDOWS}
