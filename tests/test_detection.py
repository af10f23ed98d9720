import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions import geo
from hazegrid.operators import attribution, hotspots, signals
from hazegrid.plans import city_run

B, S = geo._BIAS, geo._SHIFT


def cell(q, r):
    return (q + B) * S + (r + B)


def test_contrast_brute_force_and_floor(spark):
    rng = np.random.default_rng(2)
    v = {(q, r): float(rng.normal(50, 5)) for q in range(-12, 13) for r in range(-12, 13) if rng.random() < 0.9}
    v[(0, 0)] = 120.0
    flat = {(q + 500, r): 10.0 for q in range(-12, 13) for r in range(-12, 13)} | {(500, 0): 30.0}
    rows = [("c", cell(*k), x) for k, x in (v | flat).items()]
    df = spark.createDataFrame(rows, "city string, cell long, m double")
    got = {r.cell: r.k for r in signals.neighbourhood_contrast(df, {"k": "m"}).collect()}

    def ring(a, b):
        dq, dr = a[0] - b[0], a[1] - b[1]
        return (abs(dq) + abs(dr) + abs(dq + dr)) // 2

    for key in list(v)[::23] + [(0, 0)]:
        inner = [x for k, x in v.items() if ring(k, key) <= 1]
        outer = np.array([x for k, x in v.items() if 5 <= ring(k, key) <= 10])
        med = np.median(outer)
        scale = 1.4826 * np.median(abs(outer - med))
        scale = max(scale if scale >= 1e-9 else outer.std(), 0.05 * abs(med), 1e-9)
        want = 0.0 if len(inner) < 2 or len(outer) < 6 else (np.median(inner) - med) / scale
        assert got[cell(*key)] == pytest.approx(want)
    assert got[cell(500, 0)] == 0.0  # the median of a single spike's disk is still flat


def test_persistence_ladder(spark):
    rows = [(3.0, 3.0, 2.0), (3.0, 2.0, 1.9), (2.0, 0.0, 0.0), (1.9, 1.9, 1.9), (0.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").select(signals.classify_persistence(F.col("a"), F.col("b"), F.col("c")).alias("k"))
    assert [r.k for r in df.collect()] == ["chronic", "emerging", "acute", "none", "chronic"]


def sequential_zones(points, link, cap):
    """Independent check: plain nearest-first merging over all pairs."""

    def km(a, b):
        la1, lo1, la2, lo2 = map(math.radians, (*points[a], *points[b]))
        h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    zones = [{c} for c in points]
    order = sorted((km(a, b), a, b) for a in points for b in points if a < b)
    for d, a, b in order:
        if d > link:
            break
        za = next(z for z in zones if a in z)
        zb = next(z for z in zones if b in z)
        if za is not zb and max(km(x, y) for x in za for y in zb) <= cap:
            zones.remove(zb)
            za |= zb
    return sorted(sorted(z) for z in zones)


@pytest.mark.parametrize("seed", [0, 1])
def test_capped_zones_equal_sequential_merging(spark, seed):
    rng = np.random.default_rng(seed)
    keys = {cell(9000 + int(q), 4500 + int(r)) for q, r in rng.integers(0, 14, (70, 2))}
    df = spark.createDataFrame([("c", c) for c in keys], "city string, cell long")
    pts = {r.cell: (r.lat, r.lon) for r in df.select("cell", geo.cell_lat(F.col("cell")).alias("lat"), geo.cell_lon(F.col("cell")).alias("lon")).collect()}
    groups = {}
    for r in hotspots.capped_zones(df).collect():
        groups.setdefault(r.root, []).append(r.cell)
    assert sorted(sorted(g) for g in groups.values()) == sequential_zones(pts, 2.0, 5.0)
    labels = {r.cell: r.zone_id for r in hotspots.label_zones(hotspots.capped_zones(df)).collect()}
    assert labels[min(keys)] == "Z00" and len(set(labels.values())) == len(groups)


def test_zone_takes_most_persistent_kind_and_any_evidence(spark):
    hot = spark.createDataFrame([("c", 1, "acute", False), ("c", 2, "chronic", True), ("c", 3, "emerging", False)], "city string, cell long, kind string, attributable boolean")
    zones = spark.createDataFrame([("c", 1, "Z00"), ("c", 2, "Z00"), ("c", 3, "Z01")], "city string, cell long, zone_id string")
    got = {r.cell: (r.kind, r.cell_kind, r.attributable) for r in hotspots.apply_zones(hot, zones).collect()}
    assert got == {1: ("chronic", "acute", True), 2: ("chronic", "chronic", True), 3: ("emerging", "emerging", False)}


BASE = {"no2_col_pct": 0, "hour": 12, "fire_hour_fraction": 0.0, "fire_hours": 0, "blh_m": 800, "air_trapped": False,
        **{f"lu_{c}": 0 for c in attribution.CATEGORIES}, **{f"n_{c}": 0 for c in attribution.CATEGORIES}}


def judged(spark, sites=(), **facts):
    values = BASE | facts
    df = spark.createDataFrame([(list(sites),)], "candidates array<struct<rank:int,name:string,type:string,distance_km:double,wind_alignment:double>>")
    return attribution.judge(df.select("*", *[F.lit(v).alias(k) for k, v in values.items()])).first()


def test_no_evidence_is_the_lowest_confidence_and_first_category(spark):
    r = judged(spark)
    assert (r.primary_source, r.confidence) == ("industrial", 0.05)
    assert r.evidence_factors == ["land use alone"]


def test_fire_outranks_a_site_next_door(spark):
    r = judged(spark, [(1, "Site", "construction", 0.0, 1.0)], fire_hour_fraction=0.1, fire_hours=72, lu_construction=3)
    assert r.s_waste_burning == 3.0 and r.s_construction == pytest.approx((1.0 + 0.45) * 1.2)
    assert r.primary_source == "waste_burning" and r.agreement == 1
    margin = (3.0 - 1.74) / 3.0
    assert r.confidence == pytest.approx(round(0.1 + 0.3 * margin + 0.3 + 0.3 * 0.25, 2))
    assert "72 hours (10% of the window)" in r.reason


def test_rush_hour_and_capped_reports(spark):
    r = judged(spark, no2_col_pct=85, hour=8, n_traffic=9)
    assert r.s_traffic == pytest.approx(0.8 + 0.75) and r.agreement == 2
    assert judged(spark, no2_col_pct=85, hour=12).s_traffic == 0


def test_unassigned_ward_never_corroborates(spark):
    zones = spark.sql("select 'c' city, 'Z00' zone_id, 'unassigned' ward_id, timestamp'2024-01-02' ts, 24 hours union all select 'c', 'Z01', 'W001', timestamp'2024-01-02', 24")
    reports = spark.sql("""select 'c' city, w ward_id, k category, t ts from values ('unassigned', 'traffic', timestamp'2024-01-02'), ('W001', 'traffic', timestamp'2024-01-01'),
      ('W001', 'traffic', timestamp'2023-12-31 23:59:59'), ('W001', 'other', timestamp'2024-01-02'), ('W001', null, timestamp'2024-01-02') v(w, k, t)""")
    rows = attribution.citizen_corroboration(zones, reports).collect()
    assert [(r.zone_id, r.n_reports, r.n_traffic) for r in rows] == [("Z01", 1, 1)]


def test_percentile_counts_strictly_below(spark):
    panel = spark.createDataFrame([("c", float(x), None, 1.0) for x in (1, 2, 2, 3)], "city string, no2_col double, so2_col double, aai double")
    rows = spark.createDataFrame([("c", "Z00", 2.0, None, 1.0), ("c", "Z01", 3.5, None, 1.0)], "city string, zone_id string, no2_col double, so2_col double, aai double")
    got = {r.zone_id: (r.no2_col_pct, r.so2_col_pct, r.aai_pct) for r in attribution.pollutant_signature(rows, panel).collect()}
    assert got == {"Z00": (25, None, 0), "Z01": (100, None, 0)}


def test_stacked_sites_are_cut_at_their_place_before_zones_join(spark):
    """Sites of one place share distance and alignment; the best of each place give the zone's best."""
    from hazegrid.functions.geo import Grid, latlng_to_cell
    from hazegrid.operators import attribution

    at = [(28.60, 77.20), (28.61, 77.21)]
    kinds = attribution.CATEGORIES
    osm = spark.createDataFrame([("c", f"site {i % 300}", kinds[i % 4], *at[i % 2]) for i in range(2000)], "city string, name string, kind string, lat double, lon double")
    here = spark.createDataFrame([(28.605, 77.19)], "lat double, lon double").select(latlng_to_cell(F.col("lat"), F.col("lon"), Grid()).alias("cell")).first().cell
    zones = spark.createDataFrame([("c", "z", here)], "city string, zone_id string, anchor long")
    winds = spark.createDataFrame([("c", "z", [(270.0, 3), (10.0, 1)])], "city string, zone_id string, winds array<struct<wind_from_deg: double, n: bigint>>")
    cut = attribution.candidates(zones, winds, osm, top=8)
    whole = attribution.candidates(zones, winds, osm)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert whole.count() == 2000 and rows(cut) == rows(whole.where("rank <= 8"))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # at the place, then in the zone


def test_a_mean_direction_does_not_depend_on_the_order_of_rows(spark):
    """A day of winds 37 degrees apart has its mean halfway between two degrees, where the last bit decides the rounding."""
    hours = [h * 37 % 360 for h in range(4, 28)]
    got = set()
    for seed in range(8):
        rows = [("c", "z", float(w), 1.0, 300.0) for w in np.random.default_rng(seed).permutation(hours * 2)]
        zp = spark.createDataFrame(rows, "city string, zone_id string, wind_from_deg double, wind_ms double, blh_m double").coalesce(1)
        got |= {tuple(r) for r in attribution.zone_meteorology(zp).collect()}
    assert len(got) == 1 and got.pop()[2] in (213, 214)


def test_zones_without_winds_or_with_winds_that_cancel_keep_their_row(spark):
    rows = [("c", "none", None, 1.0, 300.0), ("c", "both", 90.0, 1.0, 300.0), ("c", "both", 270.0, 3.0, 700.0)]
    zp = spark.createDataFrame(rows, "city string, zone_id string, wind_from_deg double, wind_ms double, blh_m double")
    got = {r.zone_id: tuple(r)[2:] for r in attribution.zone_meteorology(zp).collect()}
    assert got == {"none": (None, 1.0, 300, True), "both": (None, 2.0, 500, False)}


def test_a_zone_is_judged_by_all_its_sites_though_it_carries_few(spark):
    """The strongest site of a type may rank behind any number of others: score, agreement and reason are those of the whole list."""
    rng = np.random.default_rng(5)
    sites = [(z, f"site {i}", attribution.CATEGORIES[int(rng.choice(4, p=[0.02, 0.9, 0.04, 0.04]))], round(float(d), 2), round(float(a), 2))
             for z in ("a", "b", "c") for i, (d, a) in enumerate(zip(rng.uniform(0, 5, 400), rng.uniform(0, 1, 400)))]
    df = spark.createDataFrame([("x", *s) for s in sites], "city string, zone_id string, name string, type string, distance_km double, wind_alignment double")
    order = Window.partitionBy("city", "zone_id").orderBy(F.desc(F.col("wind_alignment") / (F.col("distance_km") + 1.0)), "distance_km", "type", "name")
    ranked = df.withColumn("rank", F.row_number().over(order))

    def verdicts(listed):
        site = F.struct("rank", "name", "type", "distance_km", "wind_alignment")
        zones = listed.groupBy("city", "zone_id").agg(F.sort_array(F.collect_list(site)).alias("candidates"))
        return [tuple(r) for r in attribution.judge(zones.withColumns({k: F.lit(v) for k, v in BASE.items()})).drop("candidates").orderBy("zone_id").collect()]

    few = attribution.decisive(ranked)
    assert few.groupBy("zone_id").count().where("count > 20").isEmpty() and few.where("rank <= 8").count() == 24
    assert verdicts(few) == verdicts(ranked) != verdicts(ranked.where("rank <= 8"))


def test_the_chain_cuts_nothing_unless_asked(spark):
    """More zones than the 100 cells attributed once: each has its window."""
    hot = spark.range(150).select(
        F.lit("c").alias("city"), F.concat(F.lit("Z"), "id").alias("zone_id"), F.col("id").alias("cell"), F.lit("chronic").alias("kind"),
        F.current_timestamp().alias("ts"), F.lit("W").alias("ward_id"), F.rand(1).alias("severity"), F.lit(True).alias("attributable"),
    )
    asked = {n: p.default for f in (city_run.stages,) for n, p in inspect.signature(f).parameters.items() if n in ("top_cells", "candidates", "blind")}
    assert set(asked.values()) == {None} and len(asked) == 3
    assert attribution.zone_window(hot, asked["top_cells"]).count() == 150
