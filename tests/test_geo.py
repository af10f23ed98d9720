import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.functions import geo
from hazegrid.functions.aqi import aqi, aqi_band

GRID = geo.Grid()


def centre(cell):
    q, r = cell // geo._SHIFT - geo._BIAS, cell % geo._SHIFT - geo._BIAS
    x = (q * math.sqrt(3) + r * math.sqrt(3) / 2) * GRID.edge_km
    return r * 1.5 * GRID.edge_km, x  # y, x in km


def test_cell_is_the_nearest_centre_and_neighbours_are_constants(spark):
    rng = np.random.default_rng(3)
    pts = [(float(a), float(b)) for a, b in zip(rng.uniform(28.4, 28.8, 400), rng.uniform(76.9, 77.4, 400))]
    rows = spark.createDataFrame(pts, "lat double, lon double").withColumn("cell", geo.latlng_to_cell(F.col("lat"), F.col("lon")))
    rows = rows.withColumn("near", geo.disk(F.col("cell"), 2)).withColumns(
        {"c_lat": geo.cell_lat(F.col("cell")), "c_lon": geo.cell_lon(F.col("cell"))}
    )
    for row in rows.collect():
        y, x = row.lat * geo.KM_PER_DEGREE, row.lon * GRID.km_per_lon
        gap = {c: math.dist((y, x), centre(c)) for c in row.near}
        assert min(gap, key=gap.get) == row.cell
        assert gap[row.cell] <= GRID.edge_km + 1e-9
        assert (row.c_lat * geo.KM_PER_DEGREE, row.c_lon * GRID.km_per_lon) == pytest.approx(centre(row.cell))


def test_ring_sizes():
    assert len(geo.offsets(0, 3)) == 1 + 3 * 3 * 4
    assert len(geo.offsets(5, 10)) == 270


def test_reach_bound_misses_no_pair():
    rng = np.random.default_rng(5)
    for radius in (0.5, 1.5, 2.0, 5.0):
        k = GRID.rings_for(radius)
        a = rng.uniform(0, 20, (4000, 2))
        t = rng.uniform(0, 2 * math.pi, 4000)
        b = a + radius * np.column_stack([np.cos(t), np.sin(t)])

        def axial(p):
            q = (p[:, 0] * math.sqrt(3) / 3 - p[:, 1] / 3) / GRID.edge_km
            r = p[:, 1] * 2 / 3 / GRID.edge_km
            s = -q - r
            rq, rr, rs = np.rint(q), np.rint(r), np.rint(s)
            dq, dr, ds = abs(rq - q), abs(rr - r), abs(rs - s)
            return np.where((dq > dr) & (dq > ds), -rr - rs, rq), np.where(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs, rr)

        (q1, r1), (q2, r2) = axial(a), axial(b)
        rings = (abs(q1 - q2) + abs(r1 - r2) + abs(q1 + r1 - q2 - r2)) / 2
        assert rings.max() <= k


def test_bearing_alignment_and_circular_mean(spark):
    row = spark.range(1).select(
        geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("east"),
        geo.wind_alignment(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(270.0)).alias("downwind"),
        geo.wind_alignment(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(90.0)).alias("upwind"),
        geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("km"),
    ).first()
    assert row.east == pytest.approx(90) and row.downwind == pytest.approx(1) and row.upwind == 0
    assert row.km == pytest.approx(6371 * math.pi / 180)
    mean = spark.createDataFrame([(350.0,), (10.0,)], "w double").agg(geo.circular_mean_deg(F.col("w"))).first()[0]
    assert min(mean, 360 - mean) == pytest.approx(0, abs=1e-9)


def test_polygon_with_hole_and_open_ring(spark):
    outer = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]  # not closed on purpose
    hole = [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0], [1.0, 1.0]]
    df = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0), (5.0, 1.0)], "x double, y double").withColumn(
        "p", F.lit(None).cast("array<array<array<double>>>")
    )
    shape = spark.createDataFrame([([outer, hole],)], "p array<array<array<double>>>")
    got = df.drop("p").crossJoin(shape).select(geo.point_in_polygon(F.col("x"), F.col("y"), F.col("p")).alias("i")).collect()
    assert [r.i for r in got] == [True, False, False]


def test_aqi_edges(spark):
    cases = [(0.0, 0, "Good"), (-1.0, 0, "Good"), (30.0, 50, "Good"), (30.0001, 51, "Satisfactory"), (1000.0, 500, "Severe"),
             (1001.0, 500, "Severe"), (None, 500, "Severe"), (float("nan"), 500, "Severe"), (45.0, 76, "Satisfactory")]
    df = spark.createDataFrame([(c[0],) for c in cases], "x double").select(aqi(F.col("x")).alias("a"), aqi_band(F.col("x")).alias("b"))
    assert [(r.a, r.b) for r in df.collect()] == [(c[1], c[2]) for c in cases]


def test_half_even_rounding(spark):
    row = spark.range(1).select(geo.round_to(F.lit(12.25), 1), geo.round_to(F.lit(2.675), 2), geo.round_to(F.lit(0.5), 0)).first()
    assert tuple(row) == (np.round(12.25, 1), np.round(2.675, 2), np.round(0.5))


def test_winds_of_full_circles_have_no_mean_direction(spark):
    """720 hours that turn by 37 degrees an hour cancel out; a sum of their sines is rounding noise."""
    wind = spark.range(720).select((F.col("id") * 37 % 360).cast("double").alias("w"))
    assert wind.agg(geo.circular_mean_deg(F.col("w"))).first()[0] is None
    assert wind.where("w < 180").agg(geo.circular_mean_deg(F.col("w"))).first()[0] == pytest.approx(89.5)
