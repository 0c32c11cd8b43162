"""Goldens, and the property that matters most: what happens later must not change what was known."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import evaluation as ev
from tidegrid.operators import features, grid, models, plan, requests, resampling
from tidegrid.sources import QUARTERS, event_panel, file_digest, gapped_panel, read_hourly_csv, read_report, require_columns, write_csv, write_report

SF = "/root/testdata/sf0.001"
CUT = datetime(2024, 1, 20, 5)


@pytest.fixture(scope="module")
def panel(spark):
    return gapped_panel(spark, SF).persist()


def altered_after(panel, cut, hours=0):
    late = F.col("ts") >= F.lit(cut + timedelta(hours=hours)).cast("timestamp_ntz")
    return panel.select("series_id", "ts", *(F.when(late, F.lit(99999.0)).otherwise(F.col(c)).alias(c) for c in [*QUARTERS, "avg_power", "production"]))


def until(df, cut, column="ts"):
    return sorted(map(repr, df.where(F.col(column) <= F.lit(cut).cast("timestamp_ntz")).collect()))


@pytest.mark.parametrize("group", list(features.GROUPS))
def test_features_know_nothing_of_their_hour_or_later(panel, group):
    mine = features.features(panel, group).drop("target")
    other = features.features(altered_after(panel, CUT), group).drop("target")
    assert until(mine, CUT) == until(other, CUT)


def test_other_signals_know_nothing_of_later(panel):
    late = altered_after(panel, CUT)
    assert until(features.known_conditions(panel, 10.0), CUT) == until(features.known_conditions(late, 10.0), CUT)
    day = datetime(2024, 1, 20)
    assert until(features.origin_signals(panel), day, "day") == until(features.origin_signals(late), day, "day")
    known = ["series_id", "origin", "ts", "lead", "persistence", "previous_day", "previous_week", "output_sum_24", "load_mean_24"]
    origin = CUT - timedelta(hours=1)
    mine, other = requests.request_rows(panel).select(*known), requests.request_rows(late).select(*known)
    assert until(mine, origin, "origin") == until(other, origin, "origin")


def test_gaps_are_never_crossed(panel):
    found = features.features(panel)
    for stamp in (datetime(2024, 1, 14), datetime(2024, 1, 16)):
        assert found.where(F.col("ts") == F.lit(stamp).cast("timestamp_ntz")).isEmpty()


def test_group_names_and_unknown_group(panel):
    assert [len(features.GROUPS[g]) for g in ("base", "quarter", "regime", "combined")] == [34, 42, 47, 55]
    with pytest.raises(ValueError):
        features.features(panel, "none")


def test_validation(spark):
    full = event_panel(spark, SF)
    assert grid.validate(full).count() == full.count()
    cut = full.where(F.col("ts") < F.lit(datetime(2024, 1, 30, 10)).cast("timestamp_ntz"))
    grid.validate(cut, partial_last_day=True)
    for wrong in (cut, full.union(full.limit(1)), full.withColumn("production", F.lit(-1.0)), full.withColumn("avg_power", F.lit(float("nan"))), full.limit(0)):
        with pytest.raises(ValueError):
            grid.validate(wrong)
    with pytest.raises(ValueError):
        require_columns(full, ["series_id", "none"])


def test_as_of_reads_nothing_later(spark):
    raw = spark.createDataFrame([(20240101, 3.0), (20240101, 24.5), (20240102, 0.0)], "date_key long, hour double")
    assert grid.as_of(raw, 20240101, 5).count() == 1


def test_bad_hours_remove_the_whole_date(spark):
    raw = spark.createDataFrame([(1, 20240101, float(h)) for h in range(24)] + [(1, 20240102, 3.0), (1, 20240102, 3.5), (1, 20240103, None)], "series_id long, date_key long, hour double")
    assert [r["date_key"] for r in grid.drop_bad_dates(raw).select("date_key").distinct().collect()] == [20240101]


def test_alert_counts(spark):
    rows = spark.createDataFrame([(180.0, 174.0), (190.0, 171.0), (200.0, 190.0), (170.0, 180.0)], "actual double, predicted double")
    found = rows.agg(*ev.confusion(F.col("actual") >= 182, F.col("predicted") >= 172)).first()
    assert tuple(found) == (1, 2, 1)


def test_recall_thresholds(spark):
    rows = spark.createDataFrame([(0.1, False), (0.4, True), (0.6, True), (0.9, False)], "score double, hit boolean")
    assert ev.threshold_for_recall(rows, "score", "hit", 1.0).first()["threshold"] == 0.4
    assert ev.threshold_for_recall(rows, "score", "hit", 0.5).first()["threshold"] == 0.6
    with pytest.raises(ValueError):
        ev.threshold_for_recall(rows, "score", "hit", 0.0)


def test_f2_takes_the_higher_threshold_on_a_tie(spark):
    rows = spark.createDataFrame([(0.2, False), (0.5, False), (0.8, False)], "score double, hit boolean")
    assert ev.threshold_for_f2(rows, "score", "hit").first()["threshold"] == 0.8


def test_conformal_radius(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 10)], "err double")
    assert ev.conformal_radius(rows, "err", 0.8).first()["radius"] == 8.0
    assert ev.conformal_radius(rows.limit(1), "err", 0.9).first()["radius"] == float("inf")


def test_periods_count_the_same(spark):
    rows = spark.createDataFrame([("2024-04", 0.0, 5.0, 3.0)] * 100 + [("2024-05", 0.0, 5.0, 3.0)], "m string, actual double, a double, b double")
    found = {r["candidate"]: r["score"] for r in ev.mean_of_periods(ev.long_errors(rows, ["a", "b"], F.col("m"))).collect()}
    assert found == {"a": 5.0, "b": 3.0}


def test_first_of_equal_candidates_wins(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 1.0)], "candidate string, ordinal int, score double")
    assert ev.best(rows).first()["candidate"] == "a" and ev.best(rows, least=False).first()["candidate"] == "a"


def test_few_errors_fall_back_to_the_whole_period(spark):
    rows = spark.createDataFrame([("p", 1, float(i)) for i in range(10)] + [("p", 0, float(i)) for i in range(40)], "period string, idle int, err double")
    found = {r["regime"]: (r["n"], r["fallback"], r["radius"]) for r in ev.regime_radii(rows, 0.9).collect()}
    assert found["idle"] == (10, 1, 35.0) and found["other"][1] == 0


def test_selection_ignores_later_periods(spark):
    rows = [("1", 0.0, 1.0, 2.0), ("2", 0.0, 3.0, 1.0), ("3", 0.0, 9.0, 9.0)]
    later = rows[:2] + [("3", 0.0, 0.0, 99.0)]
    pick = lambda x: [(r["period"], r["candidate"]) for r in ev.forward_selection(ev.long_errors(spark.createDataFrame(x, "m string, actual double, a double, b double"), ["a", "b"], F.col("m"))).orderBy("period").collect()]
    assert pick(rows) == pick(later) == [("2", "a"), ("3", "b")]


def test_plan_of_a_midday_peak():
    load = np.full(24, 100.0)
    load[12] = 150
    amounts = plan.plan_day(load, plan.Flexibility(0.2))
    out, into = amounts.sum(1), amounts.sum(0)
    assert abs((load - out + into).max() - 120) < 1e-6 and abs(out.sum() - into.sum()) < 1e-9
    assert (out <= 0.2 * load + 1e-9).all() and (into <= 15 + 1e-9).all()
    night = np.full(24, 100.0)
    night[2] = 150
    assert plan.plan_day(night, plan.Flexibility(0.2)).sum() < 1e-9
    with pytest.raises(ValueError):
        plan.plan_day(load[:5], plan.Flexibility(0.2))
    for wrong in ({"fraction": 1.5}, {"fraction": 0.1, "reach": -1}, {"fraction": 0.1, "open_hours": (24,)}, {"fraction": 0.1, "arrival": float("nan")}):
        with pytest.raises(ValueError):
            plan.Flexibility(**wrong)


def _least(load, how):
    """(peak, movement) of the best plan, by a dense simplex on the two linear programs one after the other."""
    source, target = how.flows()
    hour = np.arange(24)[:, None]
    leaves, arrives = (hour == source).astype(float), (hour == target).astype(float)
    rows = np.vstack([np.column_stack([arrives - leaves, np.ones(24)]), np.column_stack([leaves, np.zeros(24)]), np.column_stack([arrives, np.zeros(24)])])
    limits = np.concatenate([load.max() - load, how.fraction * load, np.full(24, how.arrival * load.max())])

    def simplex(rows, limits, cost):
        m, n = rows.shape
        table = np.vstack([np.hstack([rows, np.eye(m), limits[:, None]]), np.hstack([cost, np.zeros(m + 1)])])
        basis = list(range(n, n + m))
        while (table[-1, :-1] < -1e-9).any():
            enter = int(np.flatnonzero(table[-1, :-1] < -1e-9)[0])
            ratios = [table[i, -1] / table[i, enter] if table[i, enter] > 1e-9 else np.inf for i in range(m)]
            leave = min((i for i in range(m) if ratios[i] <= min(ratios) + 1e-9), key=lambda i: basis[i])
            table[leave] /= table[leave, enter]
            for i in range(m + 1):
                if i != leave:
                    table[i] -= table[i, enter] * table[leave]
            basis[leave] = enter
        x = np.zeros(n + m)
        x[basis] = table[:-1, -1]
        return x[:n]

    fall = np.append(np.zeros(len(source)), 1.0)
    lowest = simplex(rows, limits, -fall)[-1]
    return load.max() - lowest, simplex(np.vstack([rows, fall]), np.append(limits, lowest), np.where(fall == 1, -1e4, 1.0))[:-1].sum()


def test_plan_is_the_optimum_of_both_programs():
    """Random days, days with ties and zeros, wide and narrow reach, open nights: least peak and then least movement."""
    rng = np.random.default_rng(3)
    days = [rng.uniform(20, 100, 24) for _ in range(12)] + [np.round(rng.uniform(0, 4, 24)) * 25 for _ in range(12)] + [np.zeros(24), np.full(24, 7.0), np.eye(24)[12] * 50]
    for how in (plan.Flexibility(0.05), plan.Flexibility(0.2), plan.Flexibility(0.6, 3, arrival=0.4), plan.Flexibility(0.3, 1, tuple(range(24))), plan.Flexibility(0.5, 2, (3, 4, 9))):
        for load, amounts in zip(days, plan.plan_days(np.array(days), how)):
            out, into = amounts.sum(1), amounts.sum(0)
            peak, moved = _least(load, how)
            assert abs((load - out + into).max() - peak) < 1e-6 and abs(amounts.sum() - moved) < 1e-5
            assert (out <= how.fraction * load + 1e-7).all() and (into <= how.arrival * load.max() + 1e-7).all()
            assert np.allclose(plan.plan_day(load, how), amounts)


def test_plans_need_whole_days(spark):
    rows = [(1, datetime(2024, 1, 1), h, 100.0, 100.0) for h in range(1, 24)]
    with pytest.raises(Exception, match="24 hours"):
        plan.plans(spark.createDataFrame(rows, "series_id long, anchor timestamp_ntz, horizon int, prediction double, actual double")).collect()


def test_plans_do_not_read_actuals(spark):
    rows = [(1, datetime(2024, 1, 1), h, 150.0 if h == 13 else 100.0, 100.0) for h in range(1, 25)]
    kind = "series_id long, anchor timestamp_ntz, horizon int, prediction double, actual double"
    mine = plan.plans(spark.createDataFrame(rows, kind))
    other = plan.plans(spark.createDataFrame([(*r[:4], 0.0) for r in rows], kind))
    keys = ["percent", "horizon", "outgoing", "incoming"]
    assert sorted(mine.select(*keys).collect()) == sorted(other.select(*keys).collect())
    assert {r["percent"]: r["feasible"] for r in plan.scenarios(other).collect()}[20] == 0
    sent = {(r["percent"], r["from_hour"]): r["s"] for r in plan.moves(mine).groupBy("percent", "from_hour").agg(F.sum("amount").alias("s")).collect()}
    assert sent and sent == {(r["percent"], r["horizon"] - 1): pytest.approx(r["outgoing"], abs=1e-6) for r in mine.collect() if r["outgoing"] > 1e-6}


def test_transition_candidates(spark):
    rows = spark.createDataFrame([(1, 2.0, 10.0, 0.2, 1.0, 9.0), (1, 2.0, 10.0, 0.4, 1.0, 9.0), (0, 2.0, 10.0, 0.1, 1.0, 9.0), (None, 2.0, 10.0, 0.1, 1.0, 9.0)], "idle int, last double, raw double, p double, off double, `on` double")
    got = [tuple(round(x, 6) for x in r) for r in rows.select(*(c.alias(n) for n, c in models.transition_candidates("idle", "last", "raw", "p", "off", "on").items())).collect()]
    assert got == [(10, 2, 2, 2, 3.6, 2.6), (10, 2, 10, 2, 5.2, 4.2), (10, 10, 10, 10, 10, 1.8), (10, 10, 10, 10, 10, 1.8)]


def test_requests_are_checked():
    origin = datetime(2024, 1, 14, 23)
    assert len(requests.validate_request(origin, datetime(2024, 1, 15, 8), datetime(2024, 1, 15, 14))) == 7
    for start, end in ((origin, origin), (origin + timedelta(hours=25),) * 2, (datetime(2024, 1, 15, 0, 30), datetime(2024, 1, 15, 3))):
        with pytest.raises(ValueError):
            requests.validate_request(origin, start, end)


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3)) * [1, 5, 0.2]
    y = x @ [1.0, -0.3, 4.0] + 20 + rng.normal(size=80)
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, target double")
    found = np.array([r["prediction"] for r in models.predict(models.fit_ridge(rows, ["a", "b", "c"], 10.0), rows).select("prediction").collect()])
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + 10.0 * np.eye(3), z.T @ (y - y.mean()))
    assert np.abs(found - (y.mean() + z @ beta)).max() < 1e-6


def test_release_contract(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), float(2 * i)) for i in range(30)], "a double, target double")
    contract = models.Contract(["a"], "2024-01-10 00", "digest")
    models.save_release(models.fit_ridge(rows, ["a"], 0.1), contract, str(tmp_path / "release"))
    model, found = models.load_release(spark, str(tmp_path / "release"))
    assert found == contract and models.predict(model, rows).count() == 30
    found.check(["a"], "2024-01-11 00", "digest")
    for features_, origin, digest in ((["b"], "2024-01-11 00", None), (["a"], "2024-01-09 00", None), (["a"], "2024-01-11 00", "other")):
        with pytest.raises(ValueError):
            found.check(features_, origin, digest)


def test_bootstrap_is_seeded_and_covers_the_mean(spark):
    days = spark.createDataFrame([(i, float(i % 5), 10) for i in range(20)], "ordinal int, total double, n long")
    draws = resampling.block_draws(spark, 20, 200)
    a, b = (resampling.bootstrap_mean(days, draws).first() for _ in range(2))
    assert a == b and a["lower"] <= a["mean"] <= a["upper"]


def test_sources_round_trip(spark, tmp_path):
    rows = [(20240101, float(h), *[1.0] * 6, None, 2.0, 3.0, 4.0) for h in range(24)]
    from tidegrid.sources import RAW_SCHEMA

    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    write_csv(raw, str(tmp_path / "raw"))
    assert sorted(map(repr, read_hourly_csv(spark, str(tmp_path / "raw")).collect())) == sorted(map(repr, raw.collect()))
    write_csv(raw.drop("rain"), str(tmp_path / "short"))
    with pytest.raises(ValueError):
        read_hourly_csv(spark, str(tmp_path / "short"))
    write_report(spark.createDataFrame([("mae", 1.5)], "name string, value double"), str(tmp_path / "report"))
    assert read_report(spark, str(tmp_path / "report")).first()["value"] == 1.5
    (tmp_path / "f").write_bytes(b"abc")
    assert file_digest(spark, str(tmp_path / "f")).startswith("ba7816bf")


def test_streamed_hours_equal_the_batch(spark, tmp_path):
    from tidegrid.streaming import hourly_loads, read_events, run_once

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    run_once(hourly_loads(read_events(spark, str(tmp_path / "in")), "40 days"), str(tmp_path / "none"), str(tmp_path / "c0"))
    run_once(hourly_loads(read_events(spark, str(tmp_path / "in"), 10), "1 hour"), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.schema("series_id long").parquet(str(tmp_path / "none")).isEmpty()  # nothing is final yet
    made = spark.read.parquet(str(tmp_path / "out")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    batch = event_panel(spark, SF)
    joined = made.alias("m").join(batch.alias("b"), ["series_id", "ts"])
    # all but the hours that the watermark still holds open
    assert joined.count() == made.count() > 300
    assert joined.where("m.avg_power <> b.avg_power or m.production <> b.production or m.q15 <> b.q15").isEmpty()


def test_requests_are_answered_from_the_past_alone(panel):
    from tidegrid.plans.forecasting import answer_request

    origin = datetime(2024, 1, 25, 23)
    asked = (origin, origin + timedelta(hours=9), origin + timedelta(hours=15))
    mine, other = answer_request(panel, *asked), answer_request(altered_after(panel, origin, 1), *asked)
    assert mine.count() == panel.select("series_id").distinct().count() * 7 and sorted(mine.collect()) == sorted(other.collect())


def test_next_hour_has_a_row_for_each_series(panel):
    from tidegrid.plans.forecasting import next_hour

    rows = next_hour(panel).collect()
    assert len(rows) == panel.select("series_id").distinct().count() and all(r["lower"] <= r["prediction"] <= r["upper"] for r in rows)
    last = panel.agg(F.max("ts")).first()[0]
    assert {r["ts"] for r in rows} == {last + timedelta(hours=1)}


def test_hours_of_a_day_are_counted_without_a_row_of_each(spark):
    from tidegrid.operators import grid

    values = ", ".join(f"1.0d as {c}" for c in grid.VALUES)
    hours = spark.range(70).selectExpr("id div 24 as series_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id % 24 as int)) as ts", *values.split(", "))
    found = grid.faults(hours.union(hours.where("series_id = 0 and hour(ts) < 2")))
    assert sorted(map(tuple, found.collect())) == [("duplicate_hour", 2), ("incomplete_day", 1)]
    assert "distinct" not in found._jdf.queryExecution().analyzed().toString().lower()
