"""Policies that are chosen before a lock, and permutations of whole feature groups."""

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import evaluation as ev
from tidegrid.operators import resampling


def long_rows(spark, later=(True, False)):
    """Two months in which a ranks better than b, and one after the lock."""
    kind = "period int, candidate string, ordinal int, score double, hit boolean"
    rows = []
    for period in (1, 2):
        for score_a, score_b, hit in ((0.9, 0.2, True), (0.8, 0.9, True), (0.3, 0.8, False), (0.1, 0.1, False)):
            rows += [(period, "a", 0, score_a, hit), (period, "b", 1, score_b, hit)]
    rows += [(3, c, i, s, hit) for i, c in enumerate("ab") for s, hit in zip((0.95, 0.05), later)]
    return spark.createDataFrame(rows, kind)


def test_policy_is_locked(spark):
    """The best mean precision is chosen and its score set before the lock; later months only count."""
    one, two = ({r["candidate"]: r for r in ev.locked_policy(long_rows(spark, x), 3).collect()} for x in ((True, False), (False, True)))
    for found in (one, two):
        assert found["a"]["chosen"] and not found["b"]["chosen"]
        assert found["a"]["mean_precision"] == 1.0 and found["b"]["mean_precision"] == pytest.approx((1 + 2 / 3) / 2)
        assert found["a"]["threshold"] == 0.8 and found["b"]["threshold"] == 0.2
    assert (one["a"]["tp"], one["a"]["fp"], one["a"]["fn"]) == (1, 0, 0) and (two["a"]["tp"], two["a"]["fp"], two["a"]["fn"]) == (0, 1, 1)


def test_the_first_of_equal_policies_is_chosen(spark):
    rows = long_rows(spark).where("candidate = 'a'")
    both = rows.unionByName(rows.withColumns({"candidate": F.lit("z"), "ordinal": F.lit(-1)}))
    assert [r["candidate"] for r in ev.locked_policy(both, 3).where("chosen").collect()] == ["z"]


def test_groups_are_permuted_together(spark):
    """Each group's columns come from one other row of the series, all else stays, and every row gives its values once."""
    rows = spark.createDataFrame([(s, o, lead, 10 * o + lead + 1000 * s, -(10 * o + lead + 1000 * s), o * 1.5) for s in (1, 2) for o in range(6) for lead in range(3)], "series_id long, origin int, lead int, a int, b int, c double")
    groups = {"ab": ["a", "b"], "c": ["c"]}
    mixed = resampling.permuted_groups(rows, groups, ["origin", "lead"])
    assert mixed.count() == 36 * 3 * 3 and mixed.columns == [*rows.columns, "repeat", "group"]
    got = mixed.collect()
    assert all(r["a"] == -r["b"] and r["a"] // 1000 == r["series_id"] for r in got)
    moved = {g: sum(r["a"] != 10 * r["origin"] + r["lead"] + 1000 * r["series_id"] for r in got if r["group"] == g) for g in ("none", "ab", "c")}
    assert moved["none"] == moved["c"] == 0 and moved["ab"] > 80
    assert all(r["c"] == r["origin"] * 1.5 for r in got if r["group"] != "c") and any(r["c"] != r["origin"] * 1.5 for r in got if r["group"] == "c")
    for repeat in range(3):
        assert sorted(r["a"] for r in got if r["group"] == "ab" and r["repeat"] == repeat) == sorted(r["a"] for r in rows.collect())
    assert sorted(got) == sorted(resampling.permuted_groups(rows.repartition(4), groups, ["origin", "lead"]).collect())
    with pytest.raises(ValueError):
        resampling.permuted_groups(rows, {"none": ["a"]}, ["origin"])


def test_weeks_are_fitted_side_by_side(spark):
    """Fits that wait for each other all end, in the order of their weeks, and two that boost at once give what each alone gives."""
    from threading import Barrier

    from tidegrid.operators.boosting import Boosted, fit_boosted
    from tidegrid.plans.forecasting import side_by_side

    both = Barrier(2, timeout=30)
    assert side_by_side(spark, lambda week: (week, both.wait() >= 0), [3, 1]) == [(3, True), (1, True)]
    rows = spark.range(400).selectExpr("cast(id % 37 as double) as x", "cast(id % 37 * 2 + id % 5 as double) as y", "id % 2 as week").persist()
    fit = lambda week: fit_boosted(rows.where(f"week <= {week}"), ["x"], [Boosted("y", "absolute", rounds=12)])[0].value
    alone = [fit(week) for week in (0, 1)]
    assert all((a == b).all() for a, b in zip(alone, side_by_side(spark, fit, [0, 1])))
