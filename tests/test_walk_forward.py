"""Fits from sums of products against fits on the rows, and choices that later data can't change."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import evaluation as ev
from tidegrid.operators import models, walk_forward

KNOWN = ["a", "b", "c", "still"]


def rows_of(spark, seed=0, n=240, change=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 100, 3]
    y = np.maximum(x @ [1.0, -0.3, 4.0] + 40 + rng.normal(size=n), 0)
    period = np.arange(n) // 40 + 10
    if change is not None:
        y = np.where(period >= change, 99999.0, y)
    made = [(int(p), *map(float, r), 7.0, float(t)) for p, r, t in zip(period, x, y)] + [(12, None, 1.0, 1.0, 7.0, 1.0)]
    return spark.createDataFrame(made, "period int, a double, b double, c double, still double, target double").repartition(3)


@pytest.mark.parametrize("alpha", [0.5, 50.0])
def test_fits_are_those_on_the_rows(spark, alpha):
    """Expanding and trailing windows; a constant column has no part; the null row is left out."""
    rows = rows_of(spark)
    sums = walk_forward.windows(walk_forward.grams(rows, KNOWN, "target"), {"all": None, "two": 2})
    found = {(r["period"], r["window"]): r for r in walk_forward.fits(sums, (alpha,)).collect()}
    assert sorted({p for p, _ in found}) == [11, 12, 13, 14, 15]
    told = walk_forward.forecasts(rows.na.drop(), KNOWN, walk_forward.fits(sums, (alpha,)))
    for period, span in ((12, "all"), (15, "all"), (13, "two"), (15, "two")):
        train = rows.na.drop().where(f"period < {period}" + (f" and period >= {period} - 2" if span == "two" else ""))
        assert found[period, span]["rows"] == train.count() and abs(found[period, span]["coefficients"][3]) == 0
        plain = models.predict(models.fit_ridge(train, KNOWN[:3], alpha), rows.na.drop().where(f"period = {period}"))
        mine = told.where((F.col("period") == period) & (F.col("window") == span))
        assert np.allclose(sorted(r["prediction"] for r in plain.collect()), sorted(r["prediction"] for r in mine.collect()), atol=1e-6)


def test_later_periods_change_no_earlier_fit(spark):
    one, two = (sorted((r["period"], tuple(np.round(r["coefficients"], 9))) for r in walk_forward.fits(walk_forward.windows(walk_forward.grams(rows_of(spark, change=c), KNOWN, "target"), {"all": None}), (1.0,)).where("period <= 13").collect()) for c in (None, 13))
    assert one == two and len(one) == 3


def test_choice_is_locked(spark):
    """The least mean of monthly errors before the lock, the first on ties, whatever comes later."""
    kind = "period int, candidate string, ordinal int, err double"
    rows = [(1, "a", 0, 1.0), (2, "a", 0, 3.0), (1, "b", 1, 2.0), (2, "b", 1, 2.0), (1, "c", 2, 9.0), (2, "c", 2, 9.0)]
    for later in ([], [(3, "a", 0, 9999.0), (3, "b", 1, 0.0), (3, "c", 2, 0.0)]):
        found = {r["candidate"]: r for r in walk_forward.locked_choice(spark.createDataFrame(rows + later, kind), 3).collect()}
        assert [c for c, r in found.items() if r["chosen"]] == ["a"] and found["b"]["score"] == 2.0
        assert found["a"]["later"] == (9999.0 if later else None)


def adopted(spark, july, later=5.0):
    """April to June select, July accepts. Candidate b wins in changing hours, far is better there but too far off elsewhere."""
    rows = []
    for month, errors in ((4, (10, 10, 9, 4)), (5, (10, 10, 9, 4)), (6, (10, 10, 9, 4)), (7, july), (8, (10, 10, later, 0))):
        for hour in range(4):
            start = hour == 0
            base, same, b, c = errors
            rows.append((datetime(2021, month, 1) + timedelta(hours=hour), start, 0.0, float(base), float(same), float(b) if start else 10.0, float(c) if start else 60.0))
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, start boolean, actual double, base double, same double, b double, far double")
    month = F.date_trunc("month", "ts").cast("timestamp_ntz")
    decide = F.lit("2021-07-01 00:00:00").cast("timestamp_ntz")
    return {r["candidate"]: r for r in ev.adopted_choice(frame, ["base", "same", "b", "far"], "base", month, F.col("start"), decide).collect()}


def test_acceptance_decides_on_a_later_period(spark):
    good, bad, equal = adopted(spark, (10, 10, 9, 4)), adopted(spark, (10, 10, 11, 4)), adopted(spark, (10, 10, 9.6, 4))
    for found in (good, bad, equal):
        assert [c for c, r in found.items() if r["selected"]] == ["b"] and not found["far"]["eligible"] and found["base"]["eligible"]
    assert good["b"]["accepted"] and [c for c, r in good.items() if r["adopted"]] == ["b"]
    for found in (bad, equal):  # worse, and not better enough
        assert not found["b"]["accepted"] and [c for c, r in found.items() if r["adopted"]] == ["base"]


def test_later_data_does_not_change_what_is_adopted(spark):
    one, two = adopted(spark, (10, 10, 9, 4)), adopted(spark, (10, 10, 9, 4), later=99999.0)
    assert {c: r["adopted"] for c, r in one.items()} == {c: r["adopted"] for c, r in two.items()} and one["b"]["later_mae"] != two["b"]["later_mae"]
