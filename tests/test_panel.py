from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hazegrid.functions.geo import Grid, latlng_to_cell
from hazegrid.operators import clean, panel, spatial

T0 = datetime(2024, 1, 1)


def hours(spark, hs):
    return spark.createDataFrame([("c", T0 + timedelta(hours=h)) for h in hs], "city string, ts timestamp")


@pytest.fixture(scope="module")
def cells(spark):
    box = spark.createDataFrame([("c", 28.5, 28.54, 77.0, 77.04)], "city string, lat_min double, lat_max double, lon_min double, lon_max double")
    return spatial.city_cells(box).cache()


def test_satellite_gap_is_filled_from_the_same_cell_only(spark):
    days = spark.createDataFrame([("c", k, f"2024-01-0{d}") for k in (1, 2) for d in (1, 2, 3)], "city string, cell long, date string").withColumn("date", F.to_date("date"))
    sat = spark.createDataFrame([("c", 1, "2024-01-02", 10.0, 1.0, None), ("c", 2, "2024-01-01", 20.0, None, None)],
                                "city string, cell long, date string, no2_col double, so2_col double, aai double").withColumn("date", F.to_date("date"))
    got = {(r.cell, r.date.day): r.no2_col for r in panel.fill_satellite(days, sat).collect()}
    assert got == {(1, 1): 10.0, (1, 2): 10.0, (1, 3): 10.0, (2, 1): 20.0, (2, 2): 20.0, (2, 3): 20.0}


def test_fire_window_counts_axis_rows_not_clock_hours(spark, cells):
    axis = hours(spark, [0, 1, 2, 3, 10, 11, 12])  # a gap between 3 and 10
    here = cells.orderBy("cell").first()
    fires = spark.createDataFrame(
        [("c", T0 + timedelta(hours=1, minutes=30), here.lat, here.lon, 5.0), ("c", T0 + timedelta(hours=5), here.lat, here.lon, 99.0)],
        "city string, ts timestamp, lat double, lon double, frp double",
    )  # the second fire's hour is not on the axis
    rows = panel.fire_features(cells, fires, axis).where(F.col("cell") == here.cell).orderBy("ts").collect()
    assert [(r.ts.hour, r.fires_6h, r.frp_6h) for r in rows] == [(h, 1, 5.0) for h in (1, 2, 3, 10, 11, 12)]


def test_landuse_counts_stacked_features(spark, cells):
    c = cells.orderBy("cell").first()
    rows = [("c", k, c.lat, c.lon) for k in ["industrial"] * 5 + ["school", "hospital", "other"]] + [("c", "road", c.lat + 0.1, c.lon)]
    osm = spark.createDataFrame(rows, "city string, kind string, lat double, lon double")
    got = panel.landuse_features(cells, osm).where(F.col("cell") == c.cell).first()
    assert (got.lu_industrial, got.lu_sensitive, got.lu_road, got.lu_traffic) == (5, 2, 0, 0)


def test_panel_is_dense_and_means_stations_of_a_cell(spark, cells):
    c = cells.orderBy("cell").first()
    two = [("c", s, T0 + timedelta(hours=h, minutes=7), c.lat, c.lon, v) for s, h, v in (("a", 0, 10.0), ("b", 0, 20.0), ("a", 2, 30.0))]
    st = spark.createDataFrame(two, "city string, station_id string, ts timestamp, lat double, lon double, pm25 double")
    st = st.withColumn("cell", latlng_to_cell(F.col("lat"), F.col("lon")))
    wx = spark.createDataFrame([("c", T0 + timedelta(hours=h), 90.0, 2.0, 400.0, 20.0) for h in range(5)],
                               "city string, ts timestamp, wind_from_deg double, wind_ms double, blh_m double, temp_c double")
    none = lambda s: spark.createDataFrame([], s)
    w = cells.select("city", "cell", F.lit("W001").alias("ward_id"), F.lit("x").alias("ward_name"))
    p = panel.build_panel(
        cells, st, wx, none("city string, cell long, date date, no2_col double, so2_col double, aai double"),
        none("city string, ts timestamp, lat double, lon double, frp double"), none("city string, kind string, lat double, lon double"), w,
    ).cache()
    assert p.count() == cells.count() * 2  # hours 0 and 2 are common to both feeds
    own = {r.ts.hour: r.pm25_station for r in p.where(F.col("cell") == c.cell).collect()}
    assert own == {0: 15.0, 2: 30.0}
    assert p.where("fires_6h <> 0 or frp_6h <> 0 or lu_road <> 0 or dow <> 0").count() == 0
    assert p.where("pm25_station is not null").count() == 2


def test_no_common_hour_is_an_error(spark):
    a, b = hours(spark, [0]), hours(spark, [5])
    with pytest.raises(ValueError, match="no common hour"):
        clean.require_hours(clean.hour_axis(a, b), a, b)


def test_qc_is_one_sided_with_a_floor(spark):
    rows = [("c", "s", float(v)) for v in [10] * 10 + [11, 29, 31, -500]] + [("c", "s", float("nan")), ("c", "s", None)]
    df = spark.createDataFrame(rows, "city string, station_id string, pm25 double")
    kept = sorted(r.pm25 for r in clean.qc_station_readings(df).collect())
    assert kept == sorted([10.0] * 10 + [11.0, 29.0, -500.0])  # limit is 10 + 20 * max(0, 1)


def test_report_wards_by_name_then_by_place(spark):
    w = spark.createDataFrame([("c", 7, "W001", "Old Town ")], "city string, cell long, ward_id string, ward_name string")
    r = spark.createDataFrame([("c", "1", " old town", None, None), ("c", "2", "W001", None, None), ("c", "3", "nowhere", None, None)],
                              "city string, id string, ward_id string, lat double, lon double")
    named = {x.id: (x.ward_id, x.ward_fixed) for x in clean.canonicalise_ward(r, w).collect()}
    assert named == {"1": ("W001", True), "2": ("W001", False), "3": ("nowhere", False)}
    lost = spark.createDataFrame([("c", "4", "unassigned", 28.6, 77.1), ("c", "5", None, None, None), ("c", "6", "W009", 28.6, 77.1)],
                                 "city string, id string, ward_id string, lat double, lon double")
    here = spark.createDataFrame([(28.6, 77.1)], "lat double, lon double").select(latlng_to_cell(F.col("lat"), F.col("lon"))).first()[0]
    at = spark.createDataFrame([("c", here, "W001", "x")], "city string, cell long, ward_id string, ward_name string")
    found = {x.id: (x.ward_id, x.located) for x in clean.resolve_ward_from_location(lost, at).collect()}
    assert found == {"4": ("W001", True), "5": (None, False), "6": ("W009", False)}


def test_a_city_without_a_common_hour_is_named(spark):
    from datetime import datetime

    def rows(*r):
        return spark.createDataFrame([(c, datetime(2024, 1, 1, h)) for c, h in r], "city string, ts timestamp")

    a, b = rows(("x", 1), ("y", 1), ("y", 2)), rows(("x", 1), ("y", 5))
    with pytest.raises(ValueError, match="y: stations cover"):
        clean.require_hours(clean.hour_axis(a, b), a, b)
