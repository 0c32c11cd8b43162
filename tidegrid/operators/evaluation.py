"""Metrics, thresholds, order statistics, selection rules and episodes: all grouped or windowed aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flag, is_true

PENALTY = 20  # 2 / 0.1, of a 90 % interval


def error(prediction: str = "prediction", actual: str = "actual") -> Column:
    return F.abs(F.col(prediction) - F.col(actual))


def regression(prediction: str = "prediction", actual: str = "actual") -> list[Column]:
    """n, mae, rmse and wape (null where the actuals sum to zero) as aggregates."""
    miss = F.col(prediction) - F.col(actual)
    return [F.count("*").alias("n"), F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"), (F.sum(F.abs(miss)) / F.nullif(F.sum(F.abs(actual)), F.lit(0.0))).alias("wape")]


def confusion(event: Column, alert: Column) -> list[Column]:
    return [F.count_if(event & alert).alias("tp"), F.count_if(~event & alert).alias("fp"), F.count_if(event & ~alert).alias("fn")]


def rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f2 to tp, fp and fn; 0 where undefined."""
    share = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f2": share(5 * tp, 5 * tp + 4 * fn + fp)})


def metrics_by(rows: DataFrame, keys: dict[str, Column], *aggregates: Column) -> DataFrame:
    """(condition, value, aggregates): rows grouped by each of several keys, in one pass over them (grouping sets)."""
    named = rows.select("*", *(c.cast("string").alias(f"_{k}") for k, c in keys.items()))
    sets = [[F.col(f"_{k}")] for k in keys]
    grouped = named.groupingSets(sets, *(F.col(f"_{k}") for k in keys)).agg(F.grouping_id().alias("_g"), *aggregates)
    top = len(keys) - 1
    which = reduce(lambda acc, x: acc.when(F.col("_g") == ((1 << len(keys)) - 1 - (1 << (top - x[0]))), x[1]), enumerate(keys), F)
    return grouped.select(which.alias("condition"), F.coalesce(*(f"_{k}" for k in keys)).alias("value"), *(c for c in grouped.columns if c not in {"_g", *(f"_{k}" for k in keys)}))


def long_errors(rows: DataFrame, candidates: list[str], period: Column) -> DataFrame:
    """(period, candidate, ordinal, err) from one prediction column for each candidate."""
    structs = F.array(*(F.struct(F.lit(c).alias("candidate"), F.lit(i).alias("ordinal"), error(c).alias("err")) for i, c in enumerate(candidates)))
    return rows.select("*", period.alias("period"), F.explode(structs).alias("c")).select("*", "c.candidate", "c.ordinal", "c.err").drop("c")


def period_means(long: DataFrame) -> DataFrame:
    return long.groupBy("candidate", "ordinal", "period").agg(F.avg("err").alias("mae"), F.count("*").alias("n"))


def mean_of_periods(long: DataFrame) -> DataFrame:
    """(candidate, ordinal, score): each period's mean counts the same, whatever its rows."""
    return period_means(long).groupBy("candidate", "ordinal").agg(F.avg("mae").alias("score"))


def best(scores: DataFrame, *by: str, score: str = "score", ordinal: str = "ordinal", least: bool = True) -> DataFrame:
    """The row with the best score for each key; of equal ones the first in order. Without keys each task keeps one row."""
    order = F.asc(score) if least else F.desc(score)
    if not by:
        return scores.orderBy(order, ordinal).limit(1)
    w = Window.partitionBy(*by).orderBy(order, ordinal)
    return scores.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def forward_selection(long: DataFrame) -> DataFrame:
    """For each period but the first: the candidate with the least mean of earlier periods' errors, and its own error."""
    means = period_means(long)
    earlier = Window.partitionBy("candidate").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    known = means.withColumn("earlier", F.round(F.avg("mae").over(earlier), 9)).where("earlier is not null")
    return best(known, "period", score="earlier").select("period", "candidate", "earlier", "mae", "n")


#: Different values of one range of a running sum without keys, and most ranges.
RANGE, RANGES = 1_000_000, 10_000


def _running(counted: DataFrame, value: str, sums: dict[str, str], *by: str, down: bool = False) -> DataFrame:
    """counted(keys, value, ...), a row a value, with a running sum over values, from the lowest (down: highest), for each of
    sums (name: column), and its total (name_total).

    Without keys values are cut into ranges at approximate quantiles; sums of whole ranges, a row each, are carried forward,
    and only a range is in one task.
    """
    order = F.desc(value) if down else F.asc(value)
    if by:
        w, whole = Window.partitionBy(*by), [F.sum(c).over(Window.partitionBy(*by)).alias(f"{name}_total") for name, c in sums.items()]
        w = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return counted.select("*", *(F.sum(c).over(w).alias(name) for name, c in sums.items()), *whole)
    ranges = min(RANGES, -(-counted.count() // RANGE))
    edges = counted.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else []
    placed = counted.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(value))) if edges else F.lit(0))
    whole = placed.groupBy("_range").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    one = Window.partitionBy(F.lit(0))  # a row a range
    before = one.orderBy(F.desc("_range") if down else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("_range", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums), *(F.sum(f"_{n}").over(one).alias(f"{n}_total") for n in sums))
    w = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.select("*", *(F.sum(c).over(w).alias(f"_in_{n}") for n, c in sums.items()))
    joined = inside.join(F.broadcast(carried), "_range")  # RANGES rows
    return joined.select(*counted.columns, *((F.col(f"_in_{n}") + F.col(f"_{n}")).alias(n) for n in sums), *(f"{n}_total" for n in sums))


def _scan(rows: DataFrame, score: str, event: str, *by: str) -> DataFrame:
    """Distinct scores from the highest down, with alerts and hits at or above each."""
    counted = rows.groupBy(*by, score).agg(F.count("*").alias("_n"), F.sum(flag(F.col(event))).alias("_p"))
    return _running(counted, score, {"alerts": "_n", "tp": "_p"}, *by, down=True).withColumnRenamed("tp_total", "positives").drop("alerts_total")


def threshold_for_recall(rows: DataFrame, score: str, event: str, recall: float, *by: str) -> DataFrame:
    """(keys, threshold): the largest score at which at least that share of the events is caught."""
    if not 0 < recall <= 1:
        raise ValueError("recall must be in (0, 1]")
    fine = _scan(rows, score, event, *by).where((F.col("positives") > 0) & (F.col("tp") / F.col("positives") >= recall))
    return fine.groupBy(*by).agg(F.max(score).alias("threshold"))


def threshold_for_f2(rows: DataFrame, score: str, event: str, *by: str) -> DataFrame:
    """(keys, threshold, f2): the largest F2, of equal ones the higher threshold."""
    scan = _scan(rows, score, event, *by).withColumn("fp", F.col("alerts") - F.col("tp")).withColumn("fn", F.col("positives") - F.col("tp"))
    scored = scan.withColumn("f2", F.round(5 * F.col("tp") / (5 * F.col("tp") + 4 * F.col("fn") + F.col("fp")), 12)).withColumn("down", -F.col(score))
    return best(scored, *by, score="f2", ordinal="down", least=False).select(*by, F.col(score).alias("threshold"), "f2")


def average_precision(rows: DataFrame, score: str, event: str, *by: str) -> DataFrame:
    """(keys, average_precision): precision at each distinct score, weighted by the recall it adds."""
    step = F.col("_p") * F.col("tp") / F.col("alerts") / F.col("positives")
    return _scan(rows, score, event, *by).where("positives > 0").groupBy(*by).agg(F.sum(step).alias("average_precision"))


def conformal_radius(errors: DataFrame, err: str, coverage: float, *by: str) -> DataFrame:
    """(keys, n, radius): the ceil((n + 1) * coverage)-th smallest error; infinite if there are fewer."""
    if not 0 < coverage < 1:
        raise ValueError("coverage must be in (0, 1)")
    counted = errors.where(F.col(err).isNotNull()).groupBy(*by, F.col(err).alias("_e")).agg(F.count("*").alias("_n"))
    ranked = _running(counted, "_e", {"_k": "_n"}, *by).withColumnRenamed("_k_total", "n")
    reaches = F.col("_k") >= F.ceil((F.col("n") + 1) * F.lit(coverage))
    return ranked.groupBy(*by, "n").agg(F.coalesce(F.min(F.when(reaches, F.col("_e"))), F.lit(float("inf"))).alias("radius"))


def regime_radii(rows: DataFrame, coverage: float, least: int = 30) -> DataFrame:
    """(period, regime, n, radius, fallback): a radius for idle and other hours of each period; from all of the
    period's hours where a regime has fewer than `least`. rows: period, idle, err."""
    regimes = F.when(is_true(F.col("idle") == 1), "idle").otherwise("other")
    named = rows.select("period", regimes.alias("regime"), "err")
    own = conformal_radius(named, "err", coverage, "period", "regime")
    whole = conformal_radius(named, "err", coverage, "period").select("period", F.col("radius").alias("_whole"))
    both = whole.crossJoin(rows.sparkSession.createDataFrame([("idle",), ("other",)], "regime string")).join(own, ["period", "regime"], "left")
    few = F.coalesce(F.col("n"), F.lit(0)) < least
    return both.select("period", "regime", F.coalesce("n", F.lit(0)).alias("n"), F.when(few, F.col("_whole")).otherwise(F.col("radius")).alias("radius"), flag(few).alias("fallback"))


def attach_intervals(rows: DataFrame, radii: DataFrame, previous: Column) -> DataFrame:
    """rows with lower and upper bounds from the period before: a join on that period and the regime; lower is not negative."""
    keyed = rows.withColumn("_from", previous).withColumn("regime", F.when(is_true(F.col("idle") == 1), "idle").otherwise("other"))
    joined = keyed.join(radii.select(F.col("period").alias("_from"), "regime", "radius"), ["_from", "regime"])
    return joined.drop("_from").withColumns({"lower": F.greatest(F.lit(0.0), F.col("prediction") - F.col("radius")), "upper": F.col("prediction") + F.col("radius")})


def interval_metrics() -> list[Column]:
    a, lo, hi = F.col("actual"), F.col("lower"), F.col("upper")
    score = (hi - lo) + PENALTY * F.greatest(lo - a, F.lit(0.0)) + PENALTY * F.greatest(a - hi, F.lit(0.0))
    return [F.count("*").alias("n"), F.avg(flag((lo <= a) & (a <= hi))).alias("coverage"), F.avg(hi - lo).alias("width"), F.avg(score).alias("interval_score")]


def latest_period_with(rows: DataFrame, least: int, *by: str) -> DataFrame:
    """rows of the latest period, for each key, that has at least so many of them."""
    sizes = rows.groupBy(*by, "period").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    last = sizes.groupBy(*by).agg(F.max("period").alias("period"))
    return rows.join(last, [*by, "period"], "left_semi")


def episodes(rows: DataFrame, event: str, *carried: Column) -> DataFrame:
    """(series_id, episode, start_ts, end_ts, hours, carried): runs of rows, in order, whose event holds."""
    w = Window.partitionBy("series_id").orderBy("ts")
    on = is_true(F.col(event))
    starts = flag(on & ~is_true(F.lag(on).over(w)))
    named = rows.withColumn("_first", starts).withColumn("episode", F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(on)
    return named.groupBy("series_id", "episode").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("hours"), *carried)


def largest(rows: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The k rows with the largest values: each task keeps k, one merges them."""
    return rows.orderBy(F.desc(by), *ties).limit(k)


def first_peak(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(keys, horizon of the largest value, and it); of equal ones the earliest."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), "horizon")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*by, F.col("horizon").alias(f"{value}_at"), F.col(value).alias(f"{value}_top"))


def guarded_choice(rows: DataFrame, candidates: list[str], baseline: str, period: Column, changing: Column, whole: float = 1.01, each: float = 1.05) -> DataFrame:
    """(candidate, ordinal, score, changing_score, eligible): a candidate is eligible if its mean over periods is at most
    `whole` times the baseline's, and no period's over `each` times; the least error in changing hours then wins."""
    long = long_errors(rows.withColumn("_changing", changing), candidates, period)
    means = long.groupBy("candidate", "ordinal", "period").agg(F.avg("err").alias("mae"), F.avg(F.when(F.col("_changing"), F.col("err"))).alias("mae_changing"))
    base = means.where(F.col("candidate") == baseline).select("period", F.col("mae").alias("_base"))
    joined = means.join(F.broadcast(base), "period")  # a row for each period
    scores = joined.groupBy("candidate", "ordinal").agg(
        F.avg("mae").alias("score"), F.avg("mae_changing").alias("changing_score"), F.min((F.col("mae") <= each * F.col("_base")).cast("int")).alias("_each"), F.avg("_base").alias("_mean")
    )
    eligible = flag((F.col("score") <= whole * F.col("_mean")) & (F.col("_each") == 1))
    return scores.withColumn("eligible", eligible).drop("_each", "_mean")


def adopted_choice(rows: DataFrame, candidates: list[str], baseline: str, period: Column, changing: Column, decide: Column, whole: float = 1.01, better: float = 0.95) -> DataFrame:
    """(candidate, ordinal, score, changing_score, eligible, selected, accepted, adopted, later_mae): a choice in three steps that
    never looks ahead. Periods before `decide` select: of the eligible candidates (see guarded_choice) the one with the least error
    in changing hours, the first on ties. The period `decide` accepts it if its error is at most `whole` times the baseline's and, in changing
    hours, at most `better` times; else the baseline is adopted. later_mae is what each then has in the periods after.
    """
    timed = rows.withColumn("_when", period).withColumn("_changing", changing).withColumn("_decide", decide)
    scores = guarded_choice(timed.where("_when < _decide"), candidates, baseline, F.col("_when"), F.col("_changing"), whole)
    scores = scores.withColumn("_rank", F.coalesce(F.round("changing_score", 9), F.lit(float("inf"))))
    selected = best(scores.where("eligible = 1"), score="_rank").select(F.col("candidate").alias("_selected"))
    long = long_errors(timed.where("_when >= _decide"), candidates, F.col("_when"))
    deciding = F.col("_when") == F.col("_decide")
    after = long.groupBy("candidate").agg(F.avg(F.when(deciding, F.col("err"))).alias("_all"), F.avg(F.when(deciding & F.col("_changing"), F.col("err"))).alias("_change"), F.avg(F.when(~deciding, F.col("err"))).alias("later_mae"))
    base = after.where(F.col("candidate") == baseline).select(F.col("_all").alias("_base_all"), F.col("_change").alias("_base_change"))
    joined = scores.join(after, "candidate", "left").crossJoin(F.broadcast(selected)).crossJoin(F.broadcast(base))  # one row each
    passes = is_true((F.col("_all") <= whole * F.col("_base_all")) & (F.col("_change") <= better * F.col("_base_change")))
    chosen = F.col("candidate") == F.col("_selected")
    accepted = F.max(flag(chosen & passes)).over(Window.partitionBy(F.lit(0)))  # a row a candidate
    adopted = F.when(accepted == 1, F.col("_selected")).otherwise(F.lit(baseline))
    return joined.select("candidate", "ordinal", "score", "changing_score", "eligible", flag(chosen).alias("selected"), flag(chosen & passes).alias("accepted"), flag(F.col("candidate") == adopted).alias("adopted"), "later_mae")


def locked_policy(long: DataFrame, lock: int, recall: float = 0.85) -> DataFrame:
    """(candidate, ordinal, mean_precision, chosen, threshold, tp, fp, fn): from long(period, candidate, ordinal, score, hit), the mean over
    periods before the lock of each candidate's average precision, the candidate with the greatest (of equal ones the first), the
    score that catches so much of the events before the lock, and what it then does from the lock on.
    """
    early = long.where(F.col("period") < lock)
    precision = average_precision(early, "score", "hit", "candidate", "ordinal", "period").groupBy("candidate", "ordinal").agg(F.round(F.avg("average_precision"), 9).alias("mean_precision"))
    chosen = best(precision, score="mean_precision", least=False).select("candidate", F.lit(True).alias("_chosen"))
    found = precision.join(threshold_for_recall(early, "score", "hit", recall, "candidate"), "candidate", "left").join(F.broadcast(chosen), "candidate", "left")  # one row
    later = long.where(F.col("period") >= lock).join(F.broadcast(found.select("candidate", "threshold")), "candidate")  # a row a candidate
    counts = later.groupBy("candidate").agg(*confusion(F.col("hit"), F.col("score") >= F.col("threshold")))
    return found.join(counts, "candidate", "left").select("candidate", "ordinal", "mean_precision", F.coalesce("_chosen", F.lit(False)).alias("chosen"), "threshold", "tp", "fp", "fn")
