"""Local grids, neighbour means along the wind, decayed means, error bands, realised effects and equity, against plain loops."""

import math
import os
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazegrid.functions import geo
from hazegrid.operators import advection, equity, intervals, ledger, spatial

GRID = geo.Grid(edge_km=0.46, ref_lat=28.6)


def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("lat", [0.0, 28.6, 51.0, 60.0, -70.1])
def test_local_rings_keep_their_kilometres(spark, lat):
    cities = spark.createDataFrame([("c", lat - 0.1, lat + 0.1, 12.0, 12.2)], "city string, lat_min double, lat_max double, lon_min double, lon_max double")
    point = spark.createDataFrame([("c", lat, 12.1)], "city string, lat double, lon double")
    shape = geo.offsets(1, 6, GRID)
    at = spatial.stamp_local(point, cities, GRID).select("cell", F.explode(geo.offset_array(shape)).alias("o"))
    n = F.col("cell") + F.col("o.delta")
    rows = at.select(
        "o.ring", "o.ring_km", geo.hex_distance(F.col("cell"), n).alias("ring_of"),
        geo.cell_lat(F.col("cell"), GRID).alias("a"), geo.local_lon(F.col("cell"), GRID).alias("b"), geo.cell_lat(n, GRID).alias("c"), geo.local_lon(n, GRID).alias("d"),
    ).collect()
    assert len(rows) == len(shape)
    for r in rows:
        assert r.ring_of == r.ring and km((r.a, r.b), (r.c, r.d)) == pytest.approx(r.ring_km, rel=0.01)
        assert km((r.a, r.b), (lat, 12.1)) <= 0.46 * 1.01


def test_local_cells_cover_their_city_once(spark):
    cities = spark.createDataFrame(
        [("n", 59.9, 60.0, 10.0, 10.2), ("e", -0.05, 0.05, 10.0, 10.1)], "city string, lat_min double, lat_max double, lon_min double, lon_max double"
    )
    cells = spatial.local_city_cells(cities, GRID)
    assert cells.count() == cells.distinct().count()
    again = spatial.stamp_local(cells.withColumnRenamed("cell", "was"), cities, GRID)
    assert again.where("cell <> was").count() == 0
    rng = np.random.default_rng(1)
    pts = [("n", float(59.91 + 0.08 * rng.random()), float(10.02 + 0.16 * rng.random())) for _ in range(300)]
    p = spatial.stamp_local(spark.createDataFrame(pts, "city string, lat double, lon double"), cities, GRID)
    assert p.join(cells, ["city", "cell"], "left_anti").count() == 0
    area = 3 * math.sqrt(3) / 2 * 0.46**2
    n = cells.groupBy("city").count().collect()
    for r in n:
        width = 111.32 * (0.2 * math.cos(math.radians(59.95)) if r.city == "n" else 0.1)
        assert r["count"] * area == pytest.approx(0.1 * 111.32 * width, rel=0.1)


def by_the_wind(values, wind, base, gain, shape):
    sums = defaultdict(lambda: [0, 0.0, 0.0])
    for (cell, t), x in values.items():
        if t in wind:
            for o in shape:
                a = base + gain * max(0.0, math.cos(math.radians((wind[t] + 180) % 360) - math.radians(o.bearing)))
                s = sums[(cell + o.delta, t)]
                s[0], s[1], s[2] = s[0] + 1, s[1] + a * x, s[2] + a
    return {k: (n, s / w) for k, (n, s, w) in sums.items() if w > 0}


@pytest.mark.parametrize("layers, rings, base", [(1, 1, 0.2), (2, 1, 0.2), (1, 2, 0.0)])
def test_upwind_mean_equals_loops(spark, layers, rings, base):
    rng = np.random.default_rng(3)
    centre = 1_048_576 * 2_097_152 + 1_048_576
    cells = [centre + o.delta for o in geo.offsets(0, 2, GRID)]
    hours = [datetime(2024, 1, 1, 20) + timedelta(hours=h) for h in range(10)]
    values = {(c, t): float(rng.integers(1, 90)) for c in cells for t in hours if rng.random() < 0.6}
    wind = {t: float(rng.integers(0, 360)) for t in hours if t.hour != 22}
    rows = [("c", c, t, x) for (c, t), x in values.items()] + [("c", cells[0], hours[0] + timedelta(days=3), None)]
    v = spark.createDataFrame(rows, "city string, cell long, ts timestamp, x double")
    w = spark.createDataFrame([("c", t, d) for t, d in wind.items()] + [("c", hours[2], None)], "city string, ts timestamp, wind_from_deg double")
    want = values
    for _ in range(layers):
        found = by_the_wind(want, wind, base, 1.0, geo.offsets(1, rings, GRID))
        want = {k: x for k, (_, x) in found.items()}
    got = advection.upwind_mean(v, w, "x", base=base, rings=rings, layers=layers, grid=GRID).collect()
    assert {(r.cell, r.ts): (r.n_upwind, pytest.approx(r.upwind_mean)) for r in got} == found


def test_upwind_neighbours_count_for_more(spark):
    """Wind from the west: the western neighbour's value dominates."""
    cell = 1_048_576 * 2_097_152 + 1_048_576
    west, east = (next(o for o in geo.offsets(1, 1, GRID) if abs(o.bearing - b) < 1) for b in (270, 90))
    t = datetime(2024, 1, 1)
    v = spark.createDataFrame([("c", cell + west.delta, t, 100.0), ("c", cell + east.delta, t, 0.0)], "city string, cell long, ts timestamp, x double")
    w = spark.createDataFrame([("c", t, 270.0)], "city string, ts timestamp, wind_from_deg double")
    got = advection.upwind_mean(v, w, "x", base=0.2).where(F.col("cell") == cell).first()
    assert got.n_upwind == 2 and got.upwind_mean == pytest.approx(100 * 1.2 / 1.4)


def decayed_by_hand(rows, tau):
    by = defaultdict(list)
    for cell, t, x in rows:
        if x is not None:
            by[(cell, t.weekday() * 24 + t.hour)].append((t, x))
    out = {}
    for k, own in by.items():
        last = max(t for t, _ in own)
        w = [math.exp(-((last - t).total_seconds() / 3600) / tau) for t, _ in own]
        out[k] = (sum(a * x for a, (_, x) in zip(w, own, strict=True)) / sum(w), sum(w), last)
    return out


def test_decayed_means_merge_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 3)), datetime(2020, 1, 6) + timedelta(hours=int(168 * rng.integers(0, 250) + rng.integers(0, 5)), minutes=int(rng.integers(0, 60))), float(rng.integers(1, 99))) for _ in range(600)]
    rows.append((1, datetime(2024, 5, 5), None))
    schema = "city string, cell long, ts timestamp, x double"
    make = lambda part: spark.createDataFrame([("c", *r) for r in part], schema)
    want = decayed_by_hand(rows, 672.0)

    def same(states):
        got = advection.decayed_persistence(states).collect()
        assert len(got) == len(want)
        for r in got:
            mean, weight, last = want[(r.cell, r.how)]
            assert (r.usual, r.w, r.clock) == (pytest.approx(mean), pytest.approx(weight), last)

    same(advection.decayed_state(make(rows), "x"))
    parts = [rows[k::4] for k in range(4)]
    states = [advection.decayed_state(make(p), "x") for p in parts]
    same(advection.merge_states(states[3].unionByName(states[0]).unionByName(advection.merge_states(states[1].unionByName(states[2])))))
    # The same as a stream whose slices arrive shuffled, each run from the checkpoint.
    src, path, ck = (str(tmp_path / n) for n in ("in", "states", "ck"))
    for p in parts:
        make(p).write.mode("append").parquet(src)
        advection.keep_decayed(spark.readStream.schema(schema).parquet(src), path, ck, "x").awaitTermination(120)
    same(advection.merge_states(spark.read.parquet(path).drop("batch")))


def test_old_readings_fade_without_overflow(spark):
    rows = [("c", 1, datetime(1990, 1, 1), 1e6), ("c", 1, datetime(2024, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "city string, cell long, ts timestamp, x double")
    assert advection.decayed_persistence(advection.decayed_state(df, "x", tau_hours=1.0, by=["cell"])).first().usual == 5.0


def test_bands_cover_what_they_promise(spark):
    n = 40_000
    noise = F.pow(F.randn(7), 3) + F.rand(8) * 3
    rows = spark.range(2 * n).select(F.lit("c").alias("city"), (F.col("id") % 2).cast("int").alias("horizon"), (F.col("id") >= n).alias("later"), (F.rand(1) * 50).alias("guess"), noise.alias("e"))
    rows = rows.withColumn("y", F.col("guess") + F.col("e") * (F.col("horizon") + 1))
    bands = intervals.error_bands(rows.where("NOT later"), "y", "guess")
    for r in intervals.interval_coverage(intervals.with_bands(rows.where("later"), bands, "guess"), "y").collect():
        assert r.coverage == pytest.approx(0.8, abs=0.02)


@pytest.mark.parametrize("n", [1, 8, 9, 10, 19, 57])
def test_bands_are_order_statistics(spark, n):
    rng = np.random.default_rng(n)
    e = np.round(rng.normal(0, 10, n), 2)
    df = spark.createDataFrame([("c", 3, float(v), 0.0) for v in e] + [("c", 3, None, 0.0)], "city string, horizon int, y double, guess double")
    r = intervals.error_bands(df, "y", "guess").first()
    s = np.sort(e)
    low = s[int(np.floor((n + 1) * 0.1)) - 1] if (n + 1) * 0.1 >= 1 - 1e-9 else None
    high = s[int(np.ceil((n + 1) * 0.9 - 1e-9)) - 1] if (n + 1) * 0.1 >= 1 - 1e-9 else None
    assert (r.n, r.low, r.high) == (n, low, high)


def dealt_anew(df, parts):
    """Rows that come in another order, and from other tasks, each time they are read: as shuffled blocks do on a cluster."""

    def deal(batches):
        rng = np.random.default_rng(int.from_bytes(os.urandom(8), "little"))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rng.integers(0, 1000, b.num_rows))], names=[*b.schema.names, "_r"])

    return df.mapInArrow(deal, df.withColumn("_r", F.lit(0).cast("long")).schema).repartition(parts, "_r").drop("_r")


@pytest.fixture
def every_reading_computed(spark):
    """Spark would hide a second reading by sharing the shuffled rows of the first."""
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


@pytest.mark.parametrize("n", [3_000, 15_000, 60_000])
def test_bands_hold_when_rows_arrive_in_another_order(spark, every_reading_computed, n):
    """Merged sketches of large groups depend on the order of merging: the counts of ranges and their values must see one of them."""
    base = spark.range(0, 3 * n, 1, 8).select(
        F.lit("c").alias("city"), (F.col("id") % 3).cast("int").alias("horizon"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("y"), F.lit(0.0).alias("guess")
    )
    got = {r.horizon: (r.n, r.low, r.high) for r in intervals.error_bands(dealt_anew(base, 8), "y", "guess").collect()}
    want = {}
    for h, rows in base.toPandas().groupby("horizon"):
        s = np.sort(rows.y.to_numpy())
        want[h] = (n, s[int(np.floor((n + 1) * 0.1)) - 1], s[int(np.ceil((n + 1) * 0.9)) - 1])
    assert got == want


def test_coverage_holds_when_rows_arrive_in_another_order(spark, every_reading_computed):
    n = 15_000
    base = spark.range(0, 6 * n, 1, 8).select(
        F.lit("c").alias("city"), (F.col("id") % 3).cast("int").alias("horizon"), (F.col("id") >= 3 * n).alias("later"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("y"), F.lit(0.0).alias("guess"),
    )
    bands = intervals.error_bands(dealt_anew(base.where("NOT later"), 8), "y", "guess")
    rows = intervals.interval_coverage(intervals.with_bands(base.where("later"), bands, "guess"), "y").collect()
    got = {r.horizon: (r.n_rows, r.coverage, r.mean_width) for r in rows}
    want = {}
    for h, part in base.toPandas().groupby("horizon"):
        s = np.sort(part.y[~part.later].to_numpy())
        low, high = s[int(np.floor((n + 1) * 0.1)) - 1], s[int(np.ceil((n + 1) * 0.9)) - 1]
        want[h] = (n, round(float(part.y[part.later].between(low, high).mean()), 4), high - low)
    assert got == want


def test_effects_of_overlapping_actions(spark):
    t = datetime(2024, 1, 1)
    hour = lambda h: t + timedelta(hours=h)
    acts = [("c", "A1", "Z", [1, 2], t, hour(5)), ("c", "A2", "Z", [1, 2], t, hour(10)), ("c", "A3", "Y", [3], t, hour(1)), ("c", "A4", "Y", [3], t, None), ("c", "A5", "X", [9], t, hour(2))]
    a = spark.createDataFrame(acts, "city string, action_id string, zone_id string, cells array<long>, issued_at timestamp, actioned_at timestamp")
    real = {(c, h): 100.0 * c + h for c in (1, 2, 3) for h in range(0, 40) if not (c == 2 and h == 7)}
    hat = {(c, h): 90.0 * c for c in (1, 2, 3) for h in range(3, 73, 3)}
    f = spark.createDataFrame([("c", c, hour(h), x) for (c, h), x in real.items()], "city string, cell long, ts timestamp, pm25_hat double")
    g = spark.createDataFrame([("c", c, t, h, x) for (c, h), x in hat.items()], "city string, cell long, issued_at timestamp, horizon_h int, pm25_hat double")
    got = {r.action_id: r for r in ledger.realised_effect(a, g, f, hours=12).collect()}
    assert set(got) == {"A1", "A2", "A3"}
    windows = {"A1": ([1, 2], 5), "A2": ([1, 2], 10), "A3": ([3], 1)}
    for k, (cells, start) in windows.items():
        hours = range(start + 1, start + 13)
        r_ = {h: np.mean([real[c, h] for c in cells if (c, h) in real]) for h in hours}
        h_ = {h: np.mean([hat[c, -(-h // 3) * 3] for c in cells if (c, h) in real]) for h in hours}
        assert got[k].n_hours == 12 and got[k].realised == pytest.approx(np.mean(list(r_.values()))) and got[k].expected == pytest.approx(np.mean(list(h_.values())))
        assert got[k].accumulated == pytest.approx(sum(r_[h] - h_[h] for h in hours))
    assert [got[k].shared_hours for k in ("A1", "A2", "A3")] == [7, 7, 0]


def test_a_small_ward_is_not_silent_by_chance(spark):
    """City rate 0.01: 100 people without a report say little, 50,000 people with 40 reports say much."""
    wards = [(f"W{k}", 20_000.0, 0.5, 150.0) for k in range(8)] + [("small", 100.0, 0.5, 150.0), ("quiet", 50_000.0, 0.1, 150.0), ("clean", 50_000.0, 0.9, 20.0), ("none", 0.0, None, 150.0)]
    w = spark.createDataFrame([("c", *x) for x in wards], "city string, ward_id string, people double, access double, pm25 double")
    counts = {f"W{k}": 190 + 5 * k for k in range(8)} | {"quiet": 40, "clean": 40, "elsewhere": 7}
    reports = spark.createDataFrame([("c", k) for k, n in counts.items() for _ in range(n)] + [("c", None)], "city string, ward_id string")
    got = {r.ward_id: r for r in equity.equity_signal(reports, w).collect()}
    assert {k for k, r in got.items() if r.silent} == {"quiet"}
    assert got["small"].n_reports == 0 and abs(got["small"].shrunk - got["small"].city_rate) < 0.25 * got["small"].city_rate
    assert got["quiet"].shrunk < 0.3 * got["quiet"].city_rate and got["quiet"].boost == pytest.approx(got["quiet"].expected - 40)
    assert got["none"].shrunk == pytest.approx(got["none"].city_rate) and got["none"].weight == 1.0
    mean = np.mean([a for _, _, a, _ in wards if a is not None])
    assert got["quiet"].weight == pytest.approx(min(mean / 0.1, 5.0)) and got["W0"].weight == pytest.approx(mean / 0.5)
    # Moments by hand.
    e, c = np.array([p for _, p, _, _ in wards if p > 0]), np.array([counts.get(k, 0) for k, p, _, _ in wards if p > 0])
    m = c.sum() / e.sum()
    a = max(0.0, (e * (c / e - m) ** 2).sum() / e.sum() - m / e.mean())
    shrunk = m + a / (a + m / e) * (c / e - m)
    for (k, p, _, _), s in zip([x for x in wards if x[1] > 0], shrunk, strict=True):
        assert got[k].shrunk == pytest.approx(s)


def test_equal_rates_shrink_to_the_city(spark):
    w = spark.createDataFrame([("c", f"W{k}", 1000.0, 0.5, 10.0) for k in range(5)], "city string, ward_id string, people double, access double, pm25 double")
    reports = spark.createDataFrame([("c", f"W{k}") for k in range(5) for _ in range(10)], "city string, ward_id string")
    assert all(r.shrunk == pytest.approx(0.01) for r in equity.report_rates(reports, w).collect())
