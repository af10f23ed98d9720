from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazegrid.operators import advisory, audit, evaluate, exposure, forecast, ledger, memo, priority, serving

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    rows = []
    for cell in (1, 2, 3):
        for h in range(0, 600):
            if rng.random() < 0.85:
                rows.append(("c", cell, T0 + timedelta(hours=h), float(np.round(50 + 20 * np.sin(h / 4) + rng.normal(0, 5), 2))))
    return spark.createDataFrame(rows, "city string, cell long, ts timestamp, pm25_station double").cache()


def test_row_lags_match_pandas(spark, series):
    pdf = series.toPandas().sort_values(["cell", "ts"])
    g = pdf.groupby("cell").pm25_station
    pdf["lag_24"], pdf["y"] = g.shift(24), g.shift(-6)
    pdf["r24"] = g.transform(lambda s: s.shift(1).rolling(24, min_periods=6).median())
    pdf["r168"] = g.transform(lambda s: s.shift(1).rolling(168, min_periods=24).median())
    want = pdf.dropna(subset=["lag_24", "r24", "y"]).sort_values(["cell", "ts"])
    got = forecast.supervised(series, "pm25_station", 6).toPandas().sort_values(["cell", "ts"])
    assert len(got) == len(want)
    for a, b in (("lag_24", "lag_24"), ("y", "y"), ("roll_med_24", "r24"), ("roll_med_168", "r168")):
        np.testing.assert_allclose(got[a].to_numpy(), want[b].to_numpy())
    assert (got.target_hour.to_numpy() == (got.ts + pd.Timedelta(hours=6)).dt.hour.to_numpy()).all()


def test_hour_lags_leave_gaps_null(spark, series):
    got = forecast.origin_features(series, "pm25_station", "hours").toPandas()
    at = {(r.cell, r.ts): r.pm25_station for r in got.itertuples()}
    for r in got.itertuples():
        want = at.get((r.cell, r.ts - pd.Timedelta(hours=3)))
        assert (want is None and np.isnan(r.lag_3)) or r.lag_3 == want


def test_latest_features_equal_the_window_form(spark, series):
    full = series.withColumn("value", F.col("pm25_station"))
    newest = full.agg(F.max("ts")).first()[0]
    keep = [r.cell for r in full.where(F.col("ts") == newest).select("cell").collect()]
    a = {r.cell: r for r in forecast.latest_features(full).collect()}
    b = {r.cell: r for r in forecast.origin_features(full, "value").where(F.col("ts") == newest).collect()}
    assert set(a) == set(keep) and keep
    for c in keep:
        for f in ("lag_0", "lag_1", "lag_24", "roll_med_24", "roll_med_168"):
            assert a[c][f] == b[c][f]


def test_eval_reports_every_horizon_and_beats_nothing_by_magic(spark, series):
    df = series.withColumns({c: F.lit(1.0) for c in forecast.MET}).withColumns({c: F.lit(1) for c in forecast.STATIC})
    scores = forecast.forecast_eval(df, settings={"maxIter": 10}).collect()
    assert sorted(r.horizon for r in scores) == forecast.HORIZONS
    assert all(np.isfinite(r.rmse_model) and r.rmse_persistence > 0 for r in scores if r.n_test)
    few = df.where("ts < timestamp'2024-01-02'")
    assert {r.note for r in forecast.forecast_eval(few).collect()} == {"insufficient data"}


def test_others_median_and_mean_exclude_self(spark):
    df = spark.createDataFrame([("c", i, T0, v) for i, v in enumerate([1.0, 5.0, 9.0, 5.0])] + [("c", 9, T0 + timedelta(hours=1), 3.0)], "city string, cell long, ts timestamp, pm25_station double")
    med = {(r.cell, r.ts.hour): r.others_med for r in exposure.others_median(df).collect()}
    mean = {(r.cell, r.ts.hour): r.others for r in exposure.others_mean(df).collect()}
    vals = [1.0, 5.0, 9.0, 5.0]
    for i in range(4):
        rest = vals[:i] + vals[i + 1 :]
        assert med[(i, 0)] == np.median(rest) and mean[(i, 0)] == pytest.approx(np.mean(rest))
    assert med[(9, 1)] is None and mean[(9, 1)] is None


def _queue(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("c", f"A{i:02d}", f"Z{i:02d}", "W001", float(rng.uniform(20, 90)), (28.5 + float(rng.uniform(0, 0.1)), 77 + float(rng.uniform(0, 0.1)))) for i in range(n)]
    return spark.createDataFrame(rows, "city string, action_id string, zone_id string, ward_id string, eps double, centroid struct<lat:double,lon:double>")


@pytest.fixture(scope="module")
def field_of_cells(spark):
    from hazegrid.functions.geo import latlng_to_cell

    rng = np.random.default_rng(7)
    pts = spark.createDataFrame([(28.5 + float(a), 77 + float(b), float(s)) for a, b, s in zip(rng.uniform(0, 0.1, 150), rng.uniform(0, 0.1, 150), rng.uniform(0.1, 1, 150))], "lat double, lon double, severity double")
    return pts.select(F.lit("c").alias("city"), latlng_to_cell(F.col("lat"), F.col("lon")).alias("cell"), "severity").dropDuplicates(["cell"]).cache()


def test_greedy_coverage_matches_brute_force(spark, field_of_cells):
    queue = _queue(spark, 12).cache()
    pairs = priority.coverage_pairs(queue, field_of_cells).collect()
    cover, eps = {}, {r.action_id: r.eps for r in queue.collect()}
    sev = {r.cell: r.severity for r in field_of_cells.collect()}
    for p in pairs:
        cover.setdefault(p.action_id, set()).add(p.cell)
    done, want = set(), []
    for _ in range(5):
        gain = {a: sum(sev[c] * eps[a] / 100 for c in cs - done) for a, cs in cover.items() if a not in want}
        best = min(gain, key=lambda a: (-gain[a], -eps[a], a))
        if gain[best] <= 0:
            break
        want.append(best)
        done |= cover[best]
    got = priority.max_coverage(queue, field_of_cells, 5).orderBy("pick").collect()
    assert [r.action_id for r in got] == want
    assert got[0].coverage_pct == pytest.approx(100 * sum(sev[c] for c in done) / sum(sev.values()), abs=0.051)
    less = priority.max_coverage(queue, field_of_cells, 2).first().coverage_pct
    assert 0 < less <= got[0].coverage_pct <= 100


def test_dispatch_uses_every_stop_once_and_keeps_idle_teams(spark, field_of_cells):
    plan = priority.dispatch(_queue(spark, 3), field_of_cells, teams=4, budget=3).orderBy("team_id").collect()
    assert [r.team_id for r in plan] == ["T1", "T2", "T3", "T4"]
    ids = [s.action_id for r in plan if r.stops for s in r.stops]
    assert len(ids) == len(set(ids)) and ids
    assert any(r.stops is None and r.route_km == 0 for r in plan)


def test_route_length_of_a_straight_line(spark):
    stops = spark.createDataFrame([("c", 1, i, 28.5 + 0.01 * i, 77.0) for i in range(1, 4)] + [("c", 2, 1, 28.5, 77.0)], "city string, team int, seq int, lat double, lon double")
    got = {r.team: r for r in priority.route_length(stops).collect()}
    assert got[1].route_km == pytest.approx(round(2 * 1.11195 * 1.4, 1)) and len(got[1].route_geometry) == 3
    assert (got[2].route_km, got[2].route_geometry) == (0.0, [])


def test_eps_components_add_up(spark):
    hot = spark.createDataFrame([("c", 1, "Z0", 0.8, "acute", 2.0, True), ("c", 2, "Z0", 0.4, "acute", 9.0, True)], "city string, cell long, zone_id string, severity double, kind string, nearest_candidate_km double, attributable boolean")
    att = spark.createDataFrame([("c", 2, 0.66)], "city string, cell long, confidence double")
    lu = spark.createDataFrame([("c", 1, 2), ("c", 2, 9)], "city string, cell long, lu_sensitive int")
    r = priority.eps(hot, att, lu)
    row = r.first()
    assert row.eps == pytest.approx(100 * (0.35 * 0.8 + 0.25 * 0.66 + 0.2 * 1.0 + 0.2 * 1.0), abs=0.05)
    assert priority.eps_violations(r).isEmpty()


def test_rules_stack_and_memo_hedges(spark):
    q = spark.createDataFrame([("c", "A01", "Z00", "W001", "Old Town", "chronic", 3, 320.0, [5, 6])], "city string, action_id string, zone_id string, ward_id string, ward_name string, kind string, n_cells int, pm25_med double, cells array<long>")
    att = spark.createDataFrame([("c", 6, "waste_burning", 0.55, 300.0, ["fires seen"])], "city string, cell long, primary_source string, confidence double, pm25_estimate double, evidence_factors array<string>")
    m = memo.memos(q, att, memo.rules_table(spark), "2024-02-01 00:00:00").first()
    assert [b.id for b in m.legal_basis] == ["SWM-2016-15zg", "AIR-1981-31A", "GRAP-STAGE"]
    assert "INDICATIVE" in m.finding and m.memo_id == "AQ/C/20240201/Z00"
    assert memo.memos(q, att.where("cell = 1"), memo.rules_table(spark), "2024-02-01").isEmpty()


def test_response_needs_both_times(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 05:30:00"), ("junk", "2024-01-01"), (None, "2024-01-01")], "d string, a string")
    assert [r.h for r in df.select(ledger.response_hours(F.col("d"), F.col("a")).alias("h")).collect()] == [5.5, None, None]


def test_risk_is_capped_and_texts_name_unread_languages(spark):
    rows = [("delhi", 1, "W001", "Old Town", 300.0, 50, True), ("bengaluru", 2, "W002", "Lake", 20.0, 0, False)]
    a = advisory.ward_advisory(spark.createDataFrame(rows, "city string, cell long, ward_id string, ward_name string, pm25 double, vuln int, worsening boolean"))
    t = {r.ward_id: r for r in advisory.advisory_texts(a).collect()}
    assert (t["W001"].risk_score, t["W001"].risk_tier, t["W002"].risk_tier) == (1.0, "critical", "low")
    assert t["W001"].languages == ["en", "hi"] and "Old Town" in t["W001"].texts["hi"]
    assert "Kannada" in t["W002"].disclaimer and t["W002"].reviewed == {"en": True, "kn": False}
    todo = advisory.audio_worklist(advisory.advisory_texts(a), spark.createDataFrame([], "city string, ward_id string, lang string, text_hash string"), 1)
    assert todo.count() == 4


def test_silent_sensor_is_flagged(spark):
    field = spark.createDataFrame([("c", c, T0, 100.0 + c) for c in range(8)], "city string, cell long, ts timestamp, pm25_hat double")
    st = spark.createDataFrame([("c", 0, "mute", None), ("c", 1, "flat", 5.0), ("c", 2, "fine", 99.0)], "city string, cell long, station_id string, pm25 double")
    w = spark.createDataFrame([("c", c, "W001") for c in range(8)], "city string, cell long, ward_id string")
    got = {r.station_name: r.reason for r in audit.sensor_flags(field, st, w).collect()}
    assert got == {"mute": "no_data", "flat": "flat_while_satellite_spikes"}


def test_min_max_of_a_flat_layer_and_search(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "city string, v double")
    assert sorted(r.t for r in serving.min_max_scale(df, "v").collect()) == [0.0, 0.5, 1.0]
    w = spark.createDataFrame([("c", "W001", "Alpha"), ("c", "unassigned", "Alphabet"), ("c", "W002", "Beta")], "city string, ward_id string, ward_name string")
    assert [r.ward_id for r in serving.search_wards(w, " ALP").collect()] == ["W001"] and serving.search_wards(w, " ").isEmpty()


def test_trees_learn_steps_and_missing_values_city_by_city(spark):
    from hazegrid.operators import trees

    r = F.rand(3) * 4 - 2
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("city"), F.when(F.rand(1) > 0.2, r).alias("x"), F.rand(5).alias("noise"), "id")
    step = F.when(F.col("x").isNull(), 5.0).otherwise(F.signum("x")) * F.when(F.col("city") == "a", 1).otherwise(-1)
    rows = rows.withColumn("y", step + 0.05 * F.col("noise")).unionByName(spark.createDataFrame([("few", 1.0, 1.0, 1, 1.0), ("a", 1.0, 1.0, 1, None)], "city string, x double, noise double, id long, y double"))
    models = trees.fit_by_city(rows, ["noise", "x"], "y", {"maxIter": 15, "maxDepth": 3, "stepSize": 0.3}, least=2)
    assert set(models) == {"a", "b"}
    scored = trees.score_by_city(rows, models, ["noise", "x"])
    assert scored.columns == [*rows.columns, "pred"] and scored.where("city = 'few'").isEmpty()
    assert scored.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("pred"), 2)))).first()[0] < 0.2
    ranked = {(r.city, r["rank"]): r for r in exposure.feature_importance(spark, models, ["noise", "x"]).collect()}
    assert ranked["a", 1].feature == "x" and ranked["b", 1].weight > 0.9 and len(ranked) == 4
    assert trees.score_by_city(rows, {}, ["x"]).count() == 0


def test_leave_one_station_out_has_a_row_for_each_station_and_city(spark):
    from hazegrid.operators.exposure import FEATURES

    rows = []
    for city, level in (("a", 50.0), ("b", 90.0)):
        for cell in range(4):
            for h in range(60):
                rows.append((city, cell, datetime(2024, 1, 1 + h // 24, h % 24), level + 10 * cell + h % 5, *[float(cell + i) for i in range(len(FEATURES))]))
    schema = "city string, cell long, ts timestamp, pm25_station double, " + ", ".join(f"{f} double" for f in FEATURES)
    got = exposure.holdout_validation(spark.createDataFrame(rows, schema), maxIter=3, minInstancesPerNode=20).collect()
    assert len(got) == 2 * 5 and {(r.city, r.cell) for r in got} >= {("a", None), ("b", 3)}
    city = next(r for r in got if r.city == "a" and r.cell is None)
    assert city.n == 240 and city.n_stations == 4 and city.mean_pm25 == 67.0
