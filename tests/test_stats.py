from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions import stats


@pytest.mark.parametrize("small", [True, False])
def test_exact_quantiles_match_numpy_on_skewed_groups(spark, monkeypatch, small):
    if not small:  # force the bracketed path on every group
        monkeypatch.setattr(stats, "_SMALL_GROUP", 0)
        monkeypatch.setattr(stats, "_ACCURACY", 50)
    rng = np.random.default_rng(1)
    hot = np.where(rng.random(3000) < 0.4, 7.0, np.round(rng.lognormal(3, 1, 3000), 2))
    groups = {"hot": hot, "few": np.array([3.0, 1.0]), "one": np.array([5.0]), "low": np.repeat(-2.5, 40)}
    pdf = pd.DataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], columns=["g", "v"])
    pdf = pd.concat([pdf, pd.DataFrame({"g": ["hot", "few"], "v": [np.nan, None]})])
    df = spark.createDataFrame(pdf, "g string, v double")
    if not small:  # the sketch promises rank errors below 1/accuracy only on groups that large
        df = df.where("g in ('hot', 'low')")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    for row in stats.exact_quantiles(df, ["g"], "v", probs).collect():
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(groups[row.g], p), abs=1e-12)


def test_global_quantile_needs_no_group(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert stats.exact_quantiles(df, [], "v", {"q": 0.755}).first().q == pytest.approx(75.5)


def test_robust_z_scale_ladder(spark):
    rows = [("mad", x) for x in (1.0, 2.0, 3.0, 4.0, 100.0)] + [("std", x) for x in (5.0, 5.0, 5.0, 9.0)] + [("flat", 2.0)] * 3
    df = spark.createDataFrame(rows, "city string, v double")
    z = {(r.city, r.v): r.z for r in stats.robust_z(df, "v").collect()}
    assert z[("mad", 100.0)] == pytest.approx(97 / 1.4826)
    assert z[("std", 9.0)] == pytest.approx(4 / np.std([5, 5, 5, 9]))
    assert z[("flat", 2.0)] == 0
    cells = df.withColumn("cell", F.monotonically_increasing_id())
    again = {(r.city, r.v): r.z for r in stats.robust_z_cells(cells, {"v": "z"}).collect()}
    assert again == pytest.approx(z)


def test_framed_median_needs_enough_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "i int, v double")
    w = Window.orderBy("i").rowsBetween(-4, -1)
    got = [r.m for r in df.select("i", stats.framed_median(F.col("v"), w, 3).alias("m")).orderBy("i").collect()]
    ref = pd.Series(range(10), dtype=float).shift(1).rolling(4, min_periods=3).median()
    assert [x if x is None else float(x) for x in got] == [None if np.isnan(x) else x for x in ref]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (4.0, 1.0, 3.0, 2.0)] + [("b", x) for x in (9.0, 7.0, 8.0)], "g string, v double")
    got = dict(df.groupBy("g").agg(stats.median_upper("v")).collect())
    assert got == {"a": 3.0, "b": 8.0}


def test_r_squared_and_rmse(spark):
    y, p = np.array([1.0, 2.0, 4.0, 8.0]), np.array([1.5, 2.0, 3.0, 9.0])
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y double, p double")
    row = df.agg(stats.rmse(F.col("y"), F.col("p")), stats.r_squared(F.col("y"), F.col("p"))).first()
    assert row[0] == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert row[1] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def rolled_by_hand(at, x, length, least, hours):
    out = []
    for i in range(len(x)):
        seen = [x[j] for j in range(i) if not np.isnan(x[j]) and (at[i] - length <= at[j] < at[i] if hours else j >= i - length)]
        out.append(float(np.median(seen)) if len(seen) >= least else None)
    return out


@pytest.mark.parametrize("hours", [False, True])
def test_rolling_medians_over_block_borders(spark, monkeypatch, hours):
    monkeypatch.setattr(stats, "_SERIES_BLOCK", 1)  # blocks of four frames
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g, n in (("a", 400), ("b", 3), ("c", 97)):
        at = np.sort(rng.choice(900, n, replace=False))
        x = np.where(rng.random(n) < 0.1, np.nan, np.round(rng.normal(50, 20, n), 1))
        want[g] = list(zip(rolled_by_hand(at, x, 24, 6, hours), rolled_by_hand(at, x, 5, 1, hours), strict=True))
        rows += [(g, datetime(2024, 1, 1) + timedelta(hours=int(h)), None if np.isnan(v) else float(v), 7) for h, v in zip(at, x, strict=True)]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r) for r in rows], "g string, ts timestamp, v double, roll_a int")
    got = stats.rolling_medians(df, ["g"], "ts", "v", {"roll_a": (24, 6), "roll_b": (5, 1)}, hours=hours)
    assert got.columns == ["g", "ts", "v", "roll_a", "roll_b"] and got.count() == 500
    for g, expected in want.items():
        own = [(r.roll_a, r.roll_b) for r in got.where(F.col("g") == g).orderBy("ts").collect()]
        assert own == [tuple(None if e is None else pytest.approx(e) for e in pair) for pair in expected]


def test_a_frame_of_two_thousand_rows_is_not_sorted_row_by_row(spark):
    """60,000 rows of one series: sorting every frame would sort 120 million values."""
    df = spark.range(60_000).select(F.lit("s").alias("g"), "id", F.pmod(F.xxhash64("id"), F.lit(100_003)).cast("double").alias("v"))
    got = stats.rolling_medians(df, ["g"], "id", "v", {"m": (2000, 1)}).where("id % 997 = 5").orderBy("id").collect()
    x = df.orderBy("id").toPandas().v.to_numpy()
    assert [r.m for r in got] == [float(np.median(x[max(0, r.id - 2000) : r.id])) for r in got]


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_no_range_of_a_hot_group_is_large(spark, monkeypatch, accuracy):
    """One group of ten million distinct values; with a coarse sketch its brackets are 8 % of it each."""
    monkeypatch.setattr(stats, "_ACCURACY", accuracy)
    n = 10_000_000
    df = spark.range(0, n, 1, 8).select(F.lit("hot").alias("g"), F.pow(F.pmod(F.col("id") * 7_368_787, F.lit(n)).cast("double"), 1.5).alias("v"))
    probs = {"a": 0.1, "b": 0.5, "c": 0.999}
    packed = stats._packed(df, ["g"], "v", list(probs.values()))
    most = packed.where("_range >= 0").groupBy("_i", "_range").count().agg(F.max("count")).first()[0]
    assert most * 8 <= n * 4 / accuracy and most * 8 < n
    row = stats.exact_quantiles(df, ["g"], "v", probs).first()
    for name, p in probs.items():
        at = p * (n - 1)
        low, high = np.floor(at) ** 1.5, np.ceil(at) ** 1.5
        assert row[name] == pytest.approx(low + (at - np.floor(at)) * (high - low), rel=1e-12)


def test_rows_of_one_group_stay_spread(spark, monkeypatch):
    """One city holds all rows: neither its values nor its scored rows may end in one task."""
    monkeypatch.setattr(stats, "_SMALL_GROUP", 1_000_000)  # every value is counted
    df = spark.range(0, 200_000, 1, 4).select(F.lit("hot").alias("city"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    packed = stats._packed(df, ["city"], "v", [0.5])
    assert packed.groupBy(F.spark_partition_id().alias("p")).count().count() > 1
    scored = stats.robust_z(df, "v")
    assert scored.groupBy(F.spark_partition_id().alias("p")).count().count() > 1
    x = df.toPandas().v.to_numpy()
    med = np.median(x)
    row = stats.median_and_mad(df, "v", ["city"]).first()
    assert (row.med, row.mad) == (med, np.median(np.abs(x - med)))
    assert scored.agg(F.max("z")).first()[0] == pytest.approx((x.max() - med) / (1.4826 * row.mad))


def test_deviations_of_one_group_stay_spread(spark, monkeypatch):
    """The second quantile of a MAD reads deviations: they too are stored from several tasks."""
    monkeypatch.setattr(stats, "_SMALL_GROUP", 1_000_000)
    stored = []
    keep = getattr(stats, "materialise", None)
    monkeypatch.setattr(stats, "materialise", lambda t: stored.append(keep(t)) or stored[-1], raising=False)
    df = spark.range(0, 100_000, 1, 4).select(F.lit("hot").alias("city"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    stats.median_and_mad(df, "v", ["city"]).collect()
    assert [t.select(F.input_file_name().alias("f")).distinct().count() > 1 for t in stored] == [True, True]
