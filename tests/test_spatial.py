import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.functions.geo import Grid
from hazegrid.operators import spatial, wards


def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def scatter(seed, n, spread=0.1):
    rng = np.random.default_rng(seed)
    return [(i, float(28.5 + rng.uniform(0, spread)), float(77 + rng.uniform(0, spread))) for i in range(n)]


def frames(spark, pts, tgt):
    p = spark.createDataFrame([("c", *x) for x in pts], "city string, id int, lat double, lon double")
    t = spark.createDataFrame([("c", *x) for x in tgt], "city string, tid int, t_lat double, t_lon double")
    return p, t


def test_within_km_equals_brute_force_with_a_hot_position(spark):
    pts, tgt = scatter(1, 80), scatter(2, 60)
    tgt += [(100 + i, tgt[0][1], tgt[0][2]) for i in range(40)]  # a third of the targets in one place
    p, t = frames(spark, pts, tgt)
    for radius in (0.5, 1.5, 5.0):
        got = {(r.id, r.tid) for r in spatial.within_km(p, t, radius).collect()}
        assert got == {(a[0], b[0]) for a in pts for b in tgt if km(a[1:], b[1:]) <= radius}


def test_nearest_reaches_past_every_radius(spark):
    pts = scatter(3, 30) + [(900, 29.9, 77.0), (901, 40.0, 90.0)]
    tgt = scatter(4, 25)
    p, t = frames(spark, pts, tgt)
    got = {r.id: r.nearest_km for r in spatial.nearest(p, t, ["id"], radii=(2.0, 8.0, 32.0)).collect()}
    for a in pts:
        assert abs(got[a[0]] - min(km(a[1:], b[1:]) for b in tgt)) < 1e-9
    empty = spatial.nearest(p, t.where("tid < 0"), ["id"]).collect()
    assert len(empty) == len(pts) and all(r.nearest_km is None for r in empty)


def test_components_of_a_long_chain_and_singletons(spark):
    nodes = spark.createDataFrame([("c", i) for i in range(60)] + [("d", 5)], "city string, cell long")
    edges = spark.createDataFrame([("c", i, i + 1) for i in range(39)] + [("c", 50, 51)], "city string, a long, b long")
    got = {(r.city, r.cell): r.comp for r in spatial.components(nodes, edges).collect()}
    assert all(got[("c", i)] == 0 for i in range(40))
    assert got[("c", 45)] == 45 and got[("c", 51)] == 50 and got[("d", 5)] == 5


def test_city_cells_cover_the_box_once(spark):
    box = spark.createDataFrame([("c", 28.5, 28.56, 77.0, 77.08)], "city string, lat_min double, lat_max double, lon_min double, lon_max double")
    rows = spatial.city_cells(box).collect()
    assert len({r.cell for r in rows}) == len(rows)
    area = 0.06 * 111.32 * 0.08 * Grid().km_per_lon
    assert abs(len(rows) - area / (1.5 * math.sqrt(3) * 0.46**2)) < 0.1 * len(rows)
    assert all(28.5 <= r.lat < 28.56 and 77.0 <= r.lon < 77.08 for r in rows)


def test_first_polygon_wins_and_hole_is_outside(spark):
    def box(x0, y0, x1, y1):
        return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]

    polys = spark.createDataFrame(
        [("c", 1, {"Ward_No": "119", "Zone_Name": "north zone"}, [[box(77.0, 28.5, 77.2, 28.7), box(77.08, 28.58, 77.12, 28.62)]]),
         ("c", 0, {"Ward_Name": "ALPHA"}, [[box(77.15, 28.5, 77.3, 28.7)]])],
        "city string, ward_pos int, properties map<string,string>, polygons array<array<array<array<double>>>>",
    )
    cells = spark.createDataFrame(
        [("c", 1, 28.6, 77.05), ("c", 2, 28.6, 77.10), ("c", 3, 28.6, 77.18), ("c", 4, 28.6, 77.9)], "city string, cell long, lat double, lon double"
    )
    got = {r.cell: (r.ward_id, r.ward_name) for r in wards.wards_from_polygons(cells, polys).collect()}
    assert got == {1: ("W002", "Ward 119 (North Zone)"), 2: ("unassigned", "Outside city limits"), 3: ("W001", "ALPHA"), 4: ("unassigned", "Outside city limits")}


def test_row_order_does_not_matter(spark):
    p, t = frames(spark, scatter(8, 50), scatter(9, 50))
    a = spatial.within_km(p, t, 2.0).select("id", "tid").orderBy("id", "tid").collect()
    b = spatial.within_km(p.orderBy(F.rand(1)).repartition(3), t.repartition(5), 2.0).select("id", "tid").orderBy("id", "tid").collect()
    assert a == b


@pytest.mark.parametrize(("lat", "lon"), [(0.0, 10.0), (13.0, 80.2), (28.6, 77.2), (45.0, -73.5), (60.0, 24.9), (-51.5, 179.99), (89.97, 0.0)])
def test_within_km_is_complete_at_every_latitude(spark, lat, lon):
    rng = np.random.default_rng(8)
    stretch = 1 / max(math.cos(math.radians(lat)), 0.01)

    def cloud(n):
        where = rng.uniform(-0.12, 0.12, (n, 2)) * [1, stretch] + [lat, lon]
        return [(i, float(min(90, y)), float((x + 180) % 360 - 180)) for i, (y, x) in enumerate(where)]

    a, b = cloud(150), cloud(150)
    p = spark.createDataFrame([("c", *r) for r in a], "city string, id int, lat double, lon double")
    t = spark.createDataFrame([("c", *r) for r in b], "city string, tid int, t_lat double, t_lon double")

    def km(u, v):
        la, lb = math.radians(u[1]), math.radians(v[1])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(v[2] - u[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))

    for radius in (1.5, 5.0):
        got = sorted((r.id, r.tid) for r in spatial.within_km(p, t, radius).collect())
        assert got == sorted((u[0], v[0]) for u in a for v in b if km(u, v) <= radius)


def planar_by_hand(points, centres, scale):
    lat, lon = np.array([c[0] for c in centres]), np.array([c[1] for c in centres])
    out = []
    for y, x in points:
        d = (y - lat) ** 2 + ((x - lon) * scale) ** 2
        out.append(min((v, k) for v, k in zip(d[d <= d.min()], np.flatnonzero(d <= d.min()), strict=True))[1])
    return out


@pytest.mark.parametrize("shape", ["even", "clusters", "line", "one", "lattice"])
def test_nearest_centre_equals_brute_force(spark, shape):
    rng = np.random.default_rng(8)
    n = {"even": 20_000, "clusters": 3000, "line": 500, "one": 1, "lattice": 400}[shape]
    y, x = rng.uniform(28, 29, n), rng.uniform(76, 78, n)
    if shape == "clusters":
        y, x = np.where(rng.random(n) < 0.9, 28 + y / 1e5, y), np.where(rng.random(n) < 0.9, 77 + x / 1e5, x)
    if shape == "line":
        y = np.full(n, 28.5)
    if shape == "lattice":  # many exact ties
        y, x = 28 + np.arange(n) % 20 / 16, 76 + np.arange(n) // 20 / 16
    centres = list(zip(y.tolist(), x.tolist(), strict=True))
    points = list(zip(rng.uniform(27.5, 29.5, 600).tolist(), rng.uniform(75, 79, 600).tolist(), strict=True))
    points += [(28 + i % 20 / 32, 76 + i / 32) for i in range(60)] + [(-60.0, 10.0), (89.0, 179.0), (28.5, 500.0)] + centres[:50]
    p = spark.createDataFrame([("c", i, *xy) for i, xy in enumerate(points)] + [("c", 10_000, None, 1.0), ("no", 10_001, 1.0, 1.0)], "city string, id long, lat double, lon double")
    c = spark.createDataFrame([("c", k, *xy) for k, xy in enumerate(centres)] + [("other", 5, 1.0, 1.0)], "city string, k long, c_lat double, c_lon double")
    got = spatial.nearest_planar(p, c, ["k"], x_scale=F.lit(0.75) * F.max(F.lit(1.0)))
    assert "collect_list" not in got._jdf.queryExecution().toString()
    found = {r.id: r.nearest for r in got.collect()}
    assert len(found) == len(points) + 2 and found[10_000] is None and found[10_001] is None
    assert [found[i].k for i in range(len(points))] == planar_by_hand(points, centres, 0.75)


def test_nearest_centre_without_centres(spark):
    p = spark.createDataFrame([("c", 1.0, 1.0)], "city string, lat double, lon double")
    c = spark.createDataFrame([], "city string, k long, c_lat double, c_lon double")
    assert spatial.nearest_planar(p, c, ["k"]).first().nearest is None
