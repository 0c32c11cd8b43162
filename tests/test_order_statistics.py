"""Order statistics without keys are cut into ranges, and nearest profiles compare few pairs: the same values."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import evaluation as ev
from tidegrid.operators import profiles


def scores(spark, n=400):
    rng = np.random.default_rng(2)
    made = [("k", float(np.round(s, 2)), bool(e)) for s, e in zip(rng.normal(size=n), rng.random(n) < 0.3)]
    return spark.createDataFrame(made, "k string, score double, hit boolean").repartition(5)


@pytest.mark.parametrize("size", [1_000_000, 7, 1])
def test_ranges_do_not_change_order_statistics(spark, monkeypatch, size):
    """As one range or as many, and as the one key of a keyed call."""
    monkeypatch.setattr(ev, "RANGE", size)
    rows = scores(spark)
    errors = rows.withColumn("err", F.abs("score"))
    for call in (
        lambda *by: ev.threshold_for_recall(rows, "score", "hit", 0.8, *by),
        lambda *by: ev.threshold_for_f2(rows, "score", "hit", *by),
        lambda *by: ev.average_precision(rows, "score", "hit", *by),
        lambda *by: ev.conformal_radius(errors, "err", 0.9, *by),
        lambda *by: ev.conformal_radius(errors.limit(3), "err", 0.9, *by),
    ):
        (one,), (other,) = call().collect(), call("k").drop("k").collect()
        assert one.asDict() == pytest.approx(other.asDict())
    hits, total = 0, 0.0
    ordered = sorted(((r["score"], r["hit"]) for r in rows.collect()), reverse=True)
    positives = sum(h for _, h in ordered)
    for s in sorted({s for s, _ in ordered}, reverse=True):
        own = sum(h for x, h in ordered if x == s)
        hits += own
        total += own / positives * hits / sum(x >= s for x, _ in ordered)
    assert ev.average_precision(rows, "score", "hit").first()[0] == pytest.approx(total)
    radius = sorted(abs(s) for s, _ in ordered)[int(np.ceil((len(ordered) + 1) * 0.9)) - 1]
    assert ev.conformal_radius(errors, "err", 0.9).first()["radius"] == radius


def test_a_range_holds_few_values(spark, monkeypatch):
    monkeypatch.setattr(ev, "RANGE", 10)
    counted = spark.range(1000).select((F.col("id") * 1.0).alias("v"), F.lit(1).alias("n"))
    found = ev._running(counted, "v", {"s": "n"}, down=True).collect()
    assert {r["v"]: r["s"] for r in found} == {float(i): 1000 - i for i in range(1000)} and {r["s_total"] for r in found} == {1000}
    none = ev._running(counted.limit(0), "v", {"s": "n"})
    assert none.count() == 0


def days_of(years=10, seed=4):
    """Seasons, weekends, noise, and a few days that were there before."""
    rng = np.random.default_rng(seed)
    n = 365 * years
    level = 60 + 30 * np.sin(2 * np.pi * np.arange(n) / 365) + np.where(np.arange(n) % 7 >= 5, -25, 0) + rng.normal(size=n) * 4
    shape = 1 + 0.4 * np.sin(2 * np.pi * np.arange(24) / 24)
    made = np.round(level[:, None] * shape + rng.normal(size=(n, 24)) * 1.5, 2)
    made[-5:] = made[100:105]
    return made


def test_nearest_profiles_compare_few_pairs(spark):
    made = days_of()
    first = date(2011, 1, 1)
    split = 365 * 8
    kind = "series_id long, day date, profile array<double>"
    frame = spark.createDataFrame([(1, first + timedelta(days=i), p.tolist()) for i, p in enumerate(made)] + [(2, first, [1.0] * 24), (3, date(2022, 1, 1), [1.0] * 24)], kind)
    at = F.lit(first + timedelta(days=split))
    pairs = profiles.close_pairs(frame, at).count()
    assert pairs < split * (len(made) - split) / 10
    got = {(r["series_id"], r["day"]): (r["nearest"], r["seen"]) for r in profiles.nearest_profiles(frame, at).collect()}
    assert len(got) == len(made) - split  # a series with nothing before, or nothing after, has no row
    for i in range(split, len(made)):
        gaps = np.abs(made[:split] - made[i]).mean(1)
        nearest, seen = got[1, first + timedelta(days=i)]
        assert nearest == pytest.approx(gaps.min(), abs=1e-9) and seen == int((gaps == 0).any())
