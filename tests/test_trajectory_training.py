"""The trajectory query trains on anchors of every hour, with 151 features and leaves of 24 values, and is judged at midnight."""

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import features
from tidegrid.plans import forecasting
from tidegrid.sources import event_panel

SF = "/root/testdata/sf0.001"


def test_every_hour_trains_and_midnight_is_judged(spark, monkeypatch):
    seen = []

    class Model:
        def __init__(self, train, known, targets, leaf):
            seen.append(({r[0] for r in train.select(F.hour("ts")).distinct().collect()}, len(known), len(targets), leaf))
            assert train.where("ts + interval 23 hours >= split").isEmpty()

        def predict(self, rows, names):
            assert {r[0] for r in rows.select(F.hour("ts")).distinct().collect()} == {0}
            return rows.withColumns({n: F.lit(0.0) for n in names})

    monkeypatch.setattr(forecasting, "fit_random_splits", Model)
    rows = forecasting.trajectory_forecast(spark, SF).collect()
    assert seen == [(set(range(24)), 151, 24, 8)] * 2
    assert sorted(r["horizon"] for r in rows) == list(range(1, 25)) and all(r["mae"] == r["mae_week"] for r in rows)  # no residual: the week before


def test_trajectory_features_read_nothing_from_their_hour_on(spark):
    panel = event_panel(spark, SF).where("ts < timestamp_ntz '2024-01-20 00:00:00'").persist()
    known = ["series_id", *features.GROUPS["combined"], *features.PROFILES]
    cut = F.lit("2024-01-15 06:00:00").cast("timestamp_ntz")
    later = panel.withColumns({c: F.when(F.col("ts") < cut, F.col(c)).otherwise(F.lit(99999.0)) for c in ("q15", "q30", "q45", "q60", "avg_power", "production")})
    mine, other = (features.trajectory_features(p).where(F.col("ts") == cut).select(*known).collect() for p in (panel, later))
    assert mine and sorted(mine) == sorted(other)
    last = features.trajectory_features(panel).agg(F.max("ts")).first()[0]
    assert str(last) == "2024-01-19 00:00:00"  # its day ends with the panel
    assert str(features.trajectory_features(panel, need_target=False).agg(F.max("ts")).first()[0]) == "2024-01-19 23:00:00"


def test_groups_that_add_nulls_are_an_error(spark):
    """A quarter that is missing where the base features are complete can't pass unseen."""
    panel = event_panel(spark, SF)
    assert features.features(panel, "combined").count() == features.features(panel).count()
    gap = panel.withColumn("q30", F.when(F.col("ts") != F.lit("2024-01-20 05:00:00").cast("timestamp_ntz"), F.col("q30")))
    assert features.features(gap).count() > 0
    with pytest.raises(Exception, match="where the base is complete"):
        features.features(gap, "quarter").collect()


def test_profiles_of_rounded_hours_are_the_rounded_profiles(spark):
    from tidegrid.plans.common import rounded

    rows = [(1, i, 0.1234565 * i, 1.0000005 * i, 2.5, 0.3333333 * i, 7.7777777, 1.0) for i in range(220)]
    hours = spark.createDataFrame(rows, "series_id long, i int, q15 double, q30 double, q45 double, q60 double, avg_power double, production double")
    panel = hours.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, i)")).drop("i")
    before, after = (sorted(x.collect()) for x in (features.profiles(rounded(panel)), rounded(features.profiles(panel))))
    assert before == after and len(before) == 220 - 168 - 23
