"""Sources, primitives, cleaning, wards and panel (ids A, P, J, G, W, T, U, S, C, D)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions import geo, stats
from hazegrid.operators import clean, exposure, forecast, panel, serving, signals, spatial, wards
from hazegrid.sources import readers, sinks
from workload.feeds import GRID, Feeds, fx, text_ts
from workload.registry import query
from workload.sqlkit import (
    align, bearing, d, hav, lat_c, lat_of, lon_c, lon_of, med, med_of, q_of, quant, r_of, rnd, stamp, ts,
)
from workload.sqlkit import aqi as sql_aqi
from workload.sqlkit import band as sql_band
from workload.sqlkit import fx as sfx

# ------------------------------------------------------------------- A sources


@query("a1_read_feeds", """SELECT city, count(*) AS n, count(DISTINCT station_id) AS stations, min(pm25) AS lo, max(pm25) AS hi FROM stations GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    return f.stations.groupBy("city").agg(
        F.count("*").alias("n"), F.countDistinct("station_id").alias("stations"), F.min("pm25").alias("lo"), F.max("pm25").alias("hi")
    )


@query("a2_station_documents", f"SELECT city, station_id, {ts('ts')} AS ts, {sfx('lat')} AS lat, {sfx('lon')} AS lon, pm25 FROM stations")
def _(f: Feeds) -> DataFrame:
    utc = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    reading = F.struct(
        F.col("value"), F.struct(F.struct(utc.alias("utc")).alias("datetimeTo")).alias("period")
    )
    # One document per station and day, as the paged feed delivers them.
    doc = F.struct(
        F.col("user_id").alias("id"),
        F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("coordinates"),
        F.array(
            F.struct(F.lit(1).alias("id"), F.struct(F.lit("no2").alias("name")).alias("parameter"), F.array().cast("array<struct<value:double,period:struct<datetimeTo:struct<utc:string>>>>").alias("results")),
            F.struct(F.lit(2).alias("id"), F.struct(F.lit("pm25").alias("name")).alias("parameter"), F.col("results")),
        ).alias("sensors"),
    )
    pages = f.events.groupBy("city", "user_id", "lat", "lon", F.to_date("ts").alias("day")).agg(F.collect_list(reading).alias("results"))
    rows = readers.station_hours(pages.select("city", F.to_json(doc).alias("doc")))
    return rows.select(
        "city", F.concat(F.lit("ST_"), "station_id").alias("station_id"), text_ts("ts").alias("ts"), fx("lat").alias("lat"), fx("lon").alias("lon"), "pm25"
    )


@query("a3_weather_arrays", f"SELECT city, {ts('ts')} AS ts, wind_from_deg, wind_ms, blh_m, temp_c FROM weather")
def _(f: Feeds) -> DataFrame:
    day = f.weather.groupBy("city", F.to_date("ts").alias("d")).agg(
        F.collect_list(F.struct("ts", "wind_ms", "wind_from_deg", "temp_c", "blh_m")).alias("h")
    )
    pull = lambda name: F.transform("h", lambda x: x[name])
    hourly = F.struct(
        F.transform("h", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        pull("wind_ms").alias("wind_speed_10m"),
        pull("wind_from_deg").alias("wind_direction_10m"),
        pull("temp_c").alias("temperature_2m"),
        pull("blh_m").alias("boundary_layer_height"),
    )
    docs = day.select("city", F.to_json(F.struct(hourly.alias("hourly"))).alias("doc"))
    return readers.weather_hours(docs).withColumn("ts", text_ts("ts"))


@query("a4_fire_csv_rows", f"SELECT city, strftime(ts, '%Y-%m-%d %H:%M:00') AS ts, {sfx('lat')} AS lat, {sfx('lon')} AS lon, frp, confidence FROM fires")
def _(f: Feeds) -> DataFrame:
    raw = f.fires.select(
        "city", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.to_date("ts").alias("acq_date"),
        (F.hour("ts") * 100 + F.minute("ts")).alias("acq_time"), "frp", "confidence",
    )
    rows = readers.fire_rows(raw)
    return rows.select("city", text_ts("ts").alias("ts"), fx("lat").alias("lat"), fx("lon").alias("lon"), "frp", "confidence")


@query("a5_osm_elements", f"""SELECT city, name, CASE WHEN kind IN ('school', 'hospital') THEN kind ELSE kind END AS kind,
  CASE kind WHEN 'industrial' THEN 'landuse=industrial' WHEN 'construction' THEN 'landuse=construction' WHEN 'waste_burning' THEN 'landuse=landfill'
    WHEN 'traffic' THEN 'highway=trunk' WHEN 'road' THEN 'highway=primary' ELSE 'amenity=' || kind END || ';name=' || name AS tag,
  {sfx('lat')} AS lat, {sfx('lon')} AS lon FROM osm""")
def _(f: Feeds) -> DataFrame:
    k = F.col("kind")
    key = F.when(k.isin("industrial", "construction", "waste_burning"), "landuse").when(k.isin("traffic", "road"), "highway").otherwise("amenity")
    value = F.when(k == "waste_burning", "landfill").when(k == "traffic", "trunk").when(k == "road", "primary").otherwise(k)
    node = F.length("name") % 2 == 0
    doc = F.struct(
        F.lit(1).cast("long").alias("id"),
        F.when(node, F.col("lat")).alias("lat"),
        F.when(node, F.col("lon")).alias("lon"),
        F.when(~node, F.struct("lat", "lon")).alias("center"),
        F.create_map(key, value, F.lit("name"), F.col("name")).alias("tags"),
    )
    rows = readers.osm_features(f.osm.select("city", F.to_json(doc).alias("doc")))
    return rows.withColumn("lat", fx("lat")).withColumn("lon", fx("lon"))


@query("a6_satellite_coverage", f"SELECT city, {sfx('avg((no2_col IS NOT NULL)::INTEGER)')} AS coverage, avg((no2_col IS NOT NULL)::INTEGER) < 0.15 AS very_sparse FROM satellite GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    raw = f.satellite.withColumns({"no2_col": F.col("no2_col") / 1e6, "so2_col": F.col("so2_col") / 1e6})
    return readers.satellite_coverage(readers.satellite_days(raw)).withColumn("coverage", fx("coverage"))


@query("a7_ward_boundaries", f"""SELECT p.city, p.pos AS ward_pos, n.ward_id, n.ward_name, {sfx('x0')} AS bx0, {sfx('y0')} AS by0, {sfx('x0 + 0.08e0')} AS bx1, {sfx('y0 + 0.06e0')} AS by1,
  CASE WHEN p.pos = 12 THEN 2 ELSE 1 END AS n_rings, count(s.station_id) AS n_readings FROM poly p JOIN ward_names n USING (pos)
  LEFT JOIN wards w ON w.ward_id = n.ward_id LEFT JOIN stations s ON s.city = w.city AND s.cell = w.cell GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    geometry = F.struct(
        F.when(F.col("ward_pos") % 2 == 0, "Polygon").otherwise("MultiPolygon").alias("type"),
        F.when(F.col("ward_pos") % 2 == 0, F.to_json(F.get("polygons", F.lit(0)))).otherwise(F.to_json("polygons")).alias("coordinates"),
    )
    feature = F.struct("properties", geometry.alias("geometry"))
    # One document per city with a feature at every file position; foreign positions carry no shape.
    last = f.polygons.groupBy("city").agg(F.max("ward_pos").alias("last"))
    slots = last.select("city", F.explode(F.sequence(F.lit(0), "last")).alias("p"))
    both = slots.join(f.polygons.withColumn("p", F.col("ward_pos")).withColumn("f", feature).select("city", "p", "f"), ["city", "p"], "left")
    hole = F.struct(F.create_map().cast("map<string,string>").alias("properties"), F.struct(F.lit("Point").alias("type"), F.lit("[0,0]").alias("coordinates")).alias("geometry"))
    docs = both.withColumn("f", F.coalesce("f", hole)).groupBy("city").agg(F.sort_array(F.collect_list(F.struct("p", F.to_json("f").alias("j")))).alias("a"))
    text = F.concat(F.lit('{"features":['), F.array_join(F.transform("a", lambda x: x["j"]), ","), F.lit("]}"))
    # Coordinates are nested arrays in the file, not quoted text.
    plain = F.regexp_replace(F.regexp_replace(text, r'"coordinates":"', '"coordinates":'), r']"}', "]}")
    polys = readers.ward_polygons(docs.select("city", plain.alias("doc")))
    at = wards.wards_from_polygons(f.cells, polys.select("city", "ward_pos", "properties", "polygons"))
    seen = f.stations.join(at, ["city", "cell"]).groupBy("city", "ward_id").agg(F.count("*").alias("n_readings"))
    out = polys.select(
        "city", "ward_pos", wards.ward_id(F.col("ward_pos")).alias("ward_id"), wards.ward_name(F.col("properties"), F.col("ward_pos")).alias("ward_name"),
        fx("bbox.x0").alias("bx0"), fx("bbox.y0").alias("by0"), fx("bbox.x1").alias("bx1"), fx("bbox.y1").alias("by1"),
        F.size(F.get("polygons", F.lit(0))).alias("n_rings"),
    )
    return out.join(seen, ["city", "ward_id"], "left").withColumn("n_readings", F.coalesce("n_readings", F.lit(0)))


@query("a8_channel_rows", """SELECT city, category, count(*) AS n, count(source) AS with_source FROM reports GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    from hazegrid.session import shared_dir

    path = f"{shared_dir(f.spark)}/channel/{uuid.uuid5(uuid.NAMESPACE_URL, f.dir).hex}"
    f.reports.write.mode("overwrite").json(path)
    rows = readers.read_channel(f.spark, "citizen_reports", path)
    return rows.groupBy("city", "category").agg(F.count("*").alias("n"), F.count("source").alias("with_source"))


@query("a9_parquet_sink", "SELECT city, count(*) AS n, sum(pm25 > 50)::BIGINT AS high FROM stations GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    from hazegrid.session import shared_dir

    path = f"{shared_dir(f.spark)}/sink/{uuid.uuid5(uuid.NAMESPACE_URL, f.dir).hex}"
    sinks.write_table(f.stations, path)
    back = readers.read_table(f.spark, path, "stations")
    return back.groupBy("city").agg(F.count("*").alias("n"), F.count_if(F.col("pm25") > 50).alias("high"))


@query("a10_json_contract", "SELECT city, count(*) AS n, count(severity) AS rated FROM hot GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    from hazegrid.session import shared_dir

    path = f"{shared_dir(f.spark)}/contract/{uuid.uuid5(uuid.NAMESPACE_URL, f.dir).hex}"
    sinks.write_contract(f.hot, path)
    back = f.spark.read.schema("cell long, severity double, city string").json(path)
    return back.groupBy("city").agg(F.count("*").alias("n"), F.count("severity").alias("rated"))


@query("a11_critical_gate", "SELECT 'stations' AS feed, count(*) AS n, min(value) AS lo FROM events UNION ALL SELECT 'fires', count(*), min(value) FROM events WHERE event_type = 'error'")
def _(f: Feeds) -> DataFrame:
    ok, _ = readers.load_feeds({"stations": lambda: f.stations, "fires": lambda: f.fires}, {"stations"})
    count = lambda name, x: ok[name].agg(F.lit(name).alias("feed"), F.count("*").alias("n"), F.min(x).alias("lo"))
    return count("stations", "pm25").unionByName(count("fires", "frp"))


@query("a12_upsert_city_row", """SELECT city, CASE WHEN city < 'M' THEN 'new' ELSE 'old' END AS v, count(*) AS n FROM stations GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    n = f.stations.groupBy("city").agg(F.count("*").alias("n"))
    fresh = n.where("city < 'M'").withColumn("v", F.lit("new"))
    return sinks.upsert_city_rows(n.withColumn("v", F.lit("old")), fresh)


@query("a13_city_scope", f"SELECT city, station_id, {ts('ts')} AS ts, pm25 FROM stations WHERE city = (SELECT min(r_name) FROM region)")
def _(f: Feeds) -> DataFrame:
    first = f.cities.agg(F.min("city")).first()[0]
    return serving.require_city(f.stations, first, f.cities).select("city", "station_id", text_ts("ts").alias("ts"), "pm25")


@query("a14_cities_available", "SELECT DISTINCT city FROM stations")
def _(f: Feeds) -> DataFrame:
    return serving.cities_available(f.stations)


# ------------------------------------------------------- P projections, filters


@query("p1_trailing_window", f"SELECT l.city, l.cell, {ts('ts')} AS ts FROM labels l JOIN station_at USING (city) WHERE ts > now_ts - INTERVAL 24 HOUR AND ts <= now_ts")
def _(f: Feeds) -> DataFrame:
    lab = signals.with_latest(panel.station_cell_hour(f.stations))
    return lab.where(signals.trailing(F.col("ts"), F.col("at"), 24)).select("city", "cell", text_ts("ts").alias("ts"))


@query("p2_in_list", "SELECT city, kind, count(*) AS n FROM osm WHERE kind IN ('industrial', 'construction', 'waste_burning') GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return f.osm.where(F.col("kind").isin("industrial", "construction", "waste_burning")).groupBy("city", "kind").agg(F.count("*").alias("n"))


@query("p3_not_null_label", "SELECT city, count(*) AS n FROM satellite WHERE no2_col IS NOT NULL GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return f.satellite.where("no2_col is not null").groupBy("city").agg(F.count("*").alias("n"))


@query("p4_project_rename", f"SELECT city, station_id AS monitor, pm25 AS reading, {ts('ts')} AS read_at FROM stations")
def _(f: Feeds) -> DataFrame:
    return f.stations.drop("lat", "lon", "cell").withColumnsRenamed({"station_id": "monitor", "pm25": "reading"}).select(
        "city", "monitor", "reading", text_ts("ts").alias("read_at")
    )


@query("p5_attribution_list", f"SELECT city, cell, ward_id, {ts('ts')} AS ts, primary_source, confidence, reason FROM named")
def _(f: Feeds) -> DataFrame:
    return serving.attribution_list(f.named).withColumn("ts", text_ts("ts"))


@query("p6_filter_hotspots", "SELECT city, cell, ward_id, kind FROM hot WHERE kind IN ('chronic', 'acute') AND attributable AND ward_id IN ('W001', 'W002', 'W003', 'W004', 'W005')")
def _(f: Feeds) -> DataFrame:
    return serving.filter_hotspots(f.hot, [f"W{i:03d}" for i in range(1, 6)], ["chronic", "acute"], True).select("city", "cell", "ward_id", "kind")


@query("p8_percentile_filter", f"SELECT s.city, s.station_id, {ts('s.ts')} AS ts, s.pm25 FROM stations s JOIN (SELECT city, {quant('pm25', 0.9)} AS e FROM stations GROUP BY ALL) q USING (city) WHERE s.pm25 >= q.e")
def _(f: Feeds) -> DataFrame:
    edge = signals.city_quantile(f.stations, "pm25", 0.9)
    return f.stations.join(F.broadcast(edge), "city").where("pm25 >= q").select("city", "station_id", text_ts("ts").alias("ts"), "pm25")


@query("p9_search_wards", "SELECT city, ward_id, ward_name FROM (SELECT DISTINCT city, ward_id, ward_name FROM wards WHERE ward_id <> 'unassigned' AND (lower(ward_name) LIKE '%nation_1%' OR lower(ward_id) LIKE '%nation_1%') ORDER BY ward_name, ward_id LIMIT 8)")
def _(f: Feeds) -> DataFrame:
    return serving.search_wards(f.wards, " NATION_1", 8)


# ----------------------------------------------------------------- joins


@query("j1_spine", f"SELECT city, cell, count(*) AS n, {ts('min(ts)')} AS first_ts, {ts('max(ts)')} AS last_ts FROM cells JOIN hours USING (city) GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    sp = panel.spine(f.cells, f.hours)
    return sp.groupBy("city", "cell").agg(F.count("*").alias("n"), text_ts(F.min("ts")).alias("first_ts"), text_ts(F.max("ts")).alias("last_ts"))


@query("j9_fires_within", f"SELECT city, cell, count(*) AS n, {sfx(med(hav('c.lat', 'c.lon', 'f.lat', 'f.lon')))} AS med_km FROM fires f JOIN cells c USING (city) WHERE {hav('c.lat', 'c.lon', 'f.lat', 'f.lon')} <= 1.5e0 GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    cells = f.cells.select("city", "cell", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    pairs = spatial.within_km(f.fires, cells, 1.5)
    return pairs.groupBy("city", "cell").agg(F.count("*").alias("n"), fx(F.median("dist_km")).alias("med_km"))


@query("j10_nearest_monitor", f"SELECT city, cell, {sfx('min(' + hav('c.lat', 'c.lon', 's.lat', 's.lon') + ')')} AS km FROM cells c LEFT JOIN (SELECT DISTINCT city, lat, lon FROM stations) s USING (city) GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    sites = f.stations.select("city", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    return spatial.nearest(f.cells, sites, ["cell"]).select("city", "cell", fx("nearest_km").alias("km"))


@query("j11_adjacent_pairs", f"SELECT a.city, a.cell AS a, b.cell AS b, {sfx(hav(lat_c('a.cell'), lon_c('a.cell'), lat_c('b.cell'), lon_c('b.cell')))} AS km FROM hot a JOIN hot b ON a.city = b.city AND a.cell < b.cell WHERE {hav(lat_c('a.cell'), lon_c('a.cell'), lat_c('b.cell'), lon_c('b.cell'))} <= 2e0")
def _(f: Feeds) -> DataFrame:
    from hazegrid.operators.hotspots import zone_edges

    return zone_edges(f.hot, grid=GRID).select("city", "a", "b", fx("dist_km").alias("km"))


@query("j12_ring_neighbours", f"""SELECT a.city, a.cell, count(*) AS n, {med('b.pm25')} AS med_pm25 FROM (SELECT city, cell FROM stations GROUP BY ALL) a JOIN foot ON TRUE
  JOIN (SELECT city, cell, max(pm25) AS pm25 FROM stations GROUP BY ALL) b ON b.city = a.city AND b.cell = a.cell + delta GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    v = f.stations.groupBy("city", "cell").agg(F.max("pm25").alias("pm25"))
    near = spatial.ring_neighbours(v, v, geo.offsets(0, 2, GRID))
    return near.groupBy("city", F.col("centre").alias("cell")).agg(F.count("*").alias("n"), F.median("pm25").alias("med_pm25"))


@query("j15_unmonitored", "SELECT city, cell FROM cells ANTI JOIN stations USING (city, cell)")
def _(f: Feeds) -> DataFrame:
    return f.cells.select("city", "cell").join(f.stations.select("city", "cell").distinct(), ["city", "cell"], "left_anti")


@query("j16_monitored", "SELECT city, cell FROM cells SEMI JOIN stations USING (city, cell)")
def _(f: Feeds) -> DataFrame:
    return f.cells.select("city", "cell").join(f.stations.select("city", "cell").distinct(), ["city", "cell"], "left_semi")


@query("g1_group_medians", f"SELECT city, station_id, {med('pm25')} AS med, count(*) AS n FROM stations GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    med_ = stats.exact_quantiles(f.stations, ["city", "station_id"], "pm25", {"med": 0.5})
    return med_.join(f.stations.groupBy("city", "station_id").agg(F.count("*").alias("n")), ["city", "station_id"])


@query("g3_mad", f"SELECT city, any_value(m) AS med, {sfx(med('abs(pm25 - m)'))} AS mad FROM stations JOIN (SELECT city, {med('pm25')} AS m FROM stations GROUP BY ALL) USING (city) GROUP BY city")
def _(f: Feeds) -> DataFrame:
    return stats.median_and_mad(f.stations, "pm25", ["city"]).select("city", "med", fx("mad").alias("mad"))


@query("g4_exact_quantiles", f"SELECT city, {', '.join(f'{sfx(quant('pm25', p))} AS q{int(p * 1000)}' for p in (0.0, 0.05, 0.25, 0.75, 0.9, 0.999, 1.0))} FROM stations GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    ps = (0.0, 0.05, 0.25, 0.75, 0.9, 0.999, 1.0)
    q = stats.exact_quantiles(f.stations, ["city"], "pm25", {f"q{int(p * 1000)}": p for p in ps})
    return q.select("city", *[fx(c).alias(c) for c in q.columns if c != "city"])


@query("g5_fraction", f"SELECT city, station_id, {sfx('avg((pm25 > 60)::INTEGER)')} AS frac FROM stations GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return f.stations.groupBy("city", "station_id").agg(fx(F.avg((F.col("pm25") > 60).cast("double"))).alias("frac"))


@query("g10_circular_mean", f"SELECT city, {ts('ts::DATE')} AS day, {sfx('(degrees(atan2(avg(sin(radians(wind_from_deg))), avg(cos(radians(wind_from_deg))))) + 360e0) % 360e0', 4)} AS deg FROM weather GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return signals.daily_wind(f.weather).select("city", text_ts(F.col("date").cast("timestamp")).alias("day"), fx("wind_from_deg", 4).alias("deg"))


@query("g12_error_metrics", f"""SELECT city, {sfx('sqrt(avg(power(pm25_station - baseline, 2)))')} AS rmse, {sfx('1 - sum(power(pm25_station - baseline, 2)) / (var_pop(pm25_station) * count(*))')} AS r2,
  {sfx('avg(baseline - pm25_station)')} AS bias FROM lab JOIN baseline USING (city, ts) GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    t = exposure.residual_target(f.labelled, exposure.city_baseline(f.labelled))
    y, p = F.col("pm25_station"), F.col("baseline")
    return t.groupBy("city").agg(fx(stats.rmse(y, p)).alias("rmse"), fx(stats.r_squared(y, p)).alias("r2"), fx(F.avg(p - y)).alias("bias"))


@query("g16_others_median", f"""SELECT a.city, a.cell, {ts('a.ts')} AS ts, {sfx(med('b.pm25_station', 'b.cell <> a.cell'))} AS others_med FROM lab a JOIN lab b USING (city, ts) GROUP BY a.city, a.cell, a.ts""")
def _(f: Feeds) -> DataFrame:
    return exposure.others_median(f.labelled).select("city", "cell", text_ts("ts").alias("ts"), fx("others_med").alias("others_med"))



@query("w1_lags_leads", f"SELECT city, cell, {ts('ts')} AS ts, {', '.join(sfx(f'lag(pm25_station, {k}) OVER w') + f' AS lag_{k}' for k in (1, 3, 6, 24))}, {sfx('lead(pm25_station, 3) OVER w')} AS lead_3 FROM lab WINDOW w AS (PARTITION BY city, cell ORDER BY ts)")
def _(f: Feeds) -> DataFrame:
    w = Window.partitionBy("city", "cell").orderBy("ts")
    x = F.col("pm25_station")
    return f.labelled.select(
        "city", "cell", text_ts("ts").alias("ts"), *[fx(F.lag(x, k).over(w)).alias(f"lag_{k}") for k in (1, 3, 6, 24)], fx(F.lead(x, 3).over(w)).alias("lead_3")
    )


def _frame(n: int, least: int) -> str:
    over = f"OVER (PARTITION BY city, cell ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(pm25_station) {over} >= {least} THEN {med_window(over)} END"


def med_window(over: str) -> str:
    return med_of(f"list_sort(list(pm25_station) {over})")


@query("w3_rolling_medians", f"SELECT city, cell, {ts('ts')} AS ts, {sfx(_frame(24, 6))} AS roll_med_24, {sfx(_frame(168, 24))} AS roll_med_168 FROM lab")
def _(f: Feeds) -> DataFrame:
    series = f.labelled.select("city", "cell", "ts", "pm25_station")
    rolled = stats.rolling_medians(series, ["city", "cell"], "ts", "pm25_station", forecast.ROLLS)
    return rolled.select("city", "cell", text_ts("ts").alias("ts"), fx("roll_med_24").alias("roll_med_24"), fx("roll_med_168").alias("roll_med_168"))


@query("w10_latest_row", f"SELECT city, station_id, {ts('max(ts)')} AS ts, max_by(pm25, ts) AS pm25 FROM stations GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return f.stations.groupBy("city", "station_id").agg(text_ts(F.max("ts")).alias("ts"), F.max_by("pm25", "ts").alias("pm25"))


@query("t8_hour_offset", f"SELECT city, {ts('ts')} AS ts, cell, ward_id, {rnd('pm25_hat', 1)} AS pm25 FROM field JOIN (SELECT city, ts FROM baseline QUALIFY row_number() OVER (PARTITION BY city ORDER BY ts DESC) = 4) USING (city, ts) LEFT JOIN wards USING (city, cell)")
def _(f: Feeds) -> DataFrame:
    return exposure.field_snapshot(f.field, f.wards, 3).withColumn("ts", text_ts("ts"))


@query("u2_common_hours", f"SELECT city, {ts('ts')} AS ts FROM hours")
def _(f: Feeds) -> DataFrame:
    hours = clean.require_hours(f.hours, f.stations, f.weather)
    return hours.select("city", text_ts("ts").alias("ts"))


# ------------------------------------------------------------------ S geometry


@query("s_geometry", f"""SELECT city, station_id, {sfx(hav('lat', 'lon', '28.6e0', '77.2e0'))} AS km, {sfx(bearing('lat', 'lon', '28.6e0', '77.2e0'))} AS bearing,
  {sfx(align(bearing('lat', 'lon', '28.6e0', '77.2e0'), '37e0'))} AS aligned,
  {sfx('sqrt(power((28.6e0 - lat) * 111.32e0, 2) + power((77.2e0 - lon) * 111.32e0 * cos(radians(28.6e0)), 2))')} AS flat_km,
  count(*) AS n FROM stations GROUP BY city, station_id, lat, lon""")
def _(f: Feeds) -> DataFrame:
    s = f.stations.groupBy("city", "station_id", "lat", "lon").agg(F.count("*").alias("n"))
    a, o, la, lo = F.col("lat"), F.col("lon"), F.lit(28.6), F.lit(77.2)
    return s.select(
        "city", "station_id", fx(geo.haversine_km(a, o, la, lo)).alias("km"), fx(geo.bearing_deg(a, o, la, lo)).alias("bearing"),
        fx(geo.wind_alignment(a, o, la, lo, F.lit(37.0))).alias("aligned"), fx(geo.equirect_km(a, o, la, lo, F.lit(28.6))).alias("flat_km"), "n",
    )


@query("s4_cell_stamp", f"SELECT city, station_id, cell, {q_of('cell')} AS q, {r_of('cell')} AS r, {sfx(lat_c('cell'))} AS c_lat, {sfx(lon_c('cell'))} AS c_lon, count(*) AS n FROM stations GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    c = F.col("cell")
    return f.stations.groupBy("city", "station_id", "cell").agg(F.count("*").alias("n")).select(
        "city", "station_id", "cell", geo.cell_q(c).alias("q"), geo.cell_r(c).alias("r"), fx(geo.cell_lat(c, GRID)).alias("c_lat"), fx(geo.cell_lon(c, GRID)).alias("c_lon"), "n"
    )


@query("s6_neighbour_load", "SELECT s.city, s.cell + delta AS cell, count(*) AS n FROM stations s, foot WHERE ring = 1 GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return f.stations.select("city", F.explode(geo.neighbours(F.col("cell"), 1)).alias("cell")).groupBy("city", "cell").agg(F.count("*").alias("n"))


@query("s7_city_cells", "SELECT c.city, c.cell, count(s.station_id) AS n FROM cells c LEFT JOIN stations s USING (city, cell) GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    n = f.stations.groupBy("city", "cell").agg(F.count("*").alias("n"))
    return spatial.city_cells(f.cities, GRID).join(n, ["city", "cell"], "left").select("city", "cell", F.coalesce("n", F.lit(0)).alias("n"))


@query("s8_cell_distance", f"""SELECT a.city, a.cell AS a, b.cell AS b, {sfx(hav(lat_c('a.cell'), lon_c('a.cell'), lat_c('b.cell'), lon_c('b.cell')))} AS km,
  ((abs({q_of('a.cell')} - {q_of('b.cell')}) + abs({r_of('a.cell')} - {r_of('b.cell')}) + abs({q_of('a.cell')} - {q_of('b.cell')} + {r_of('a.cell')} - {r_of('b.cell')})) // 2)::INTEGER AS hexes
  FROM (SELECT DISTINCT city, cell FROM stations) a JOIN hot b ON b.city = a.city WHERE {hav(lat_c('a.cell'), lon_c('a.cell'), lat_c('b.cell'), lon_c('b.cell'))} <= 3e0""")
def _(f: Feeds) -> DataFrame:
    """Every hot cell with the station cells within 3 km."""
    a = spatial.add_centre(f.stations.select("city", "cell").distinct(), GRID).withColumnRenamed("cell", "a")
    b = spatial.add_centre(f.hot.select("city", "cell"), GRID, "t_lat", "t_lon").withColumnRenamed("cell", "b")
    x, y = F.col("a"), F.col("b")
    return spatial.within_km(a, b, 3.0).select("city", "a", "b", fx(geo.cell_distance_km(x, y, GRID)).alias("km"), geo.hex_distance(x, y).alias("hexes"))


@query("s10_point_in_polygon", """SELECT city, station_id, min(pos) AS ward_pos, any_value(n) AS n FROM (SELECT city, station_id, n, pos FROM (SELECT s.city, s.station_id, s.n, e.pos, e.ring,
    count(*) FILTER (WHERE (yi > lat) <> (yj > lat) AND lon < xi + (lat - yi) * (xj - xi) / nullif(yj - yi, 0)) % 2 AS odd
    FROM (SELECT city, station_id, lat, lon, count(*) AS n FROM stations GROUP BY ALL) s JOIN edges e ON e.city = s.city GROUP BY ALL)
  GROUP BY ALL HAVING max(CASE WHEN ring = 0 THEN odd ELSE 0 END) = 1 AND max(CASE WHEN ring = 1 THEN odd ELSE 0 END) = 0) GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    at = f.stations.groupBy("city", "station_id", "lat", "lon").agg(F.count("*").alias("n"))
    return spatial.first_polygon(at, f.polygons.select("city", "ward_pos", "polygons"), "ward_pos").select("city", "station_id", "ward_pos", "n")


@query("s12_aqi", f"SELECT city, station_id, {ts('ts')} AS ts, pm25, " + "{aqi} AS aqi, {band} AS band FROM stations".format(aqi=sql_aqi("pm25"), band=sql_band("pm25")))
def _(f: Feeds) -> DataFrame:
    from hazegrid.functions.aqi import aqi, aqi_band

    return f.stations.select("city", "station_id", text_ts("ts").alias("ts"), "pm25", aqi(F.col("pm25")).alias("aqi"), aqi_band(F.col("pm25")).alias("band"))


# ------------------------------------------------------------------ C cleaning


def _qc_sql(limit: float) -> str:
    return f"""(SELECT s.* FROM stations s JOIN (SELECT city, station_id, any_value(m) + greatest({med('abs(pm25 - m)')}, 1e0) * {d(limit)} AS lim FROM stations
      JOIN (SELECT city, station_id, {med('pm25')} AS m FROM stations GROUP BY ALL) USING (city, station_id) GROUP BY city, station_id) l USING (city, station_id) WHERE pm25 <= lim)"""


@query("c1_qc_station_readings", f"SELECT city, station_id, {ts('ts')} AS ts, pm25 FROM {_qc_sql(20)}")
def _(f: Feeds) -> DataFrame:
    return clean.qc_station_readings(f.stations).select("city", "station_id", text_ts("ts").alias("ts"), "pm25")


@query("c1_qc_report", f"SELECT r.city, r.n AS read, k.n AS kept, r.n - k.n AS dropped FROM (SELECT city, count(*) AS n FROM stations GROUP BY ALL) r JOIN (SELECT city, count(*) AS n FROM {_qc_sql(4)} GROUP BY ALL) k USING (city)")
def _(f: Feeds) -> DataFrame:
    return clean.qc_report(f.stations, clean.qc_station_readings(f.stations, 4.0))


@query("c2_floor_hours", f"SELECT city, station_id, {ts('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)')} AS ts, count(*) AS n FROM stations GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return clean.floor_hours(f.stations).groupBy("city", "station_id", text_ts("ts").alias("ts")).agg(F.count("*").alias("n"))


_canon = """(SELECT r.* EXCLUDE (ward_id), k.ward_id IS NULL AND n.ward_id IS NOT NULL AND trim(coalesce(r.ward_id, '')) <> '' AS ward_fixed,
  CASE WHEN ward_fixed THEN n.ward_id ELSE r.ward_id END AS ward_id FROM reports r
  LEFT JOIN (SELECT DISTINCT city, ward_id FROM wards) k ON k.city = r.city AND k.ward_id = trim(coalesce(r.ward_id, ''))
  LEFT JOIN (SELECT city, upper(trim(ward_name)) AS nm, max(ward_id) AS ward_id FROM wards GROUP BY ALL) n ON n.city = r.city AND n.nm = upper(trim(coalesce(r.ward_id, ''))))"""


@query("c4_canonicalise_ward", f"SELECT city, id, ward_id, ward_fixed FROM {_canon}")
def _(f: Feeds) -> DataFrame:
    return clean.canonicalise_ward(f.reports, f.wards).select("city", "id", "ward_id", "ward_fixed")


_located = "(SELECT * EXCLUDE (ward_id, w_here), (ward_id IS NULL OR ward_id IN ('', 'unassigned')) AND w_here IS NOT NULL AS located, CASE WHEN located THEN w_here ELSE ward_id END AS ward_id FROM (SELECT r.*, w.ward_id AS w_here FROM (" + stamp("lat", "lon", "reports") + ") r LEFT JOIN wards w ON w.city = r.city AND w.cell = r.cell))"


@query("c5_resolve_ward", f"SELECT city, id, ward_id, located FROM {_located}")
def _(f: Feeds) -> DataFrame:
    return clean.resolve_ward_from_location(f.reports, f.wards, GRID).select("city", "id", "ward_id", "located")


@query("c6_validate_reports", """SELECT city, id, coalesce(source, 'web') AS source, coalesce(status, 'submitted') AS status, CASE WHEN ward_id IS NULL THEN 'ward_id'
  WHEN coalesce(source, 'web') NOT IN ('web', 'telegram', 'whatsapp') THEN 'source' WHEN coalesce(status, 'submitted') NOT IN ('submitted', 'under_review', 'corroborated', 'action_taken', 'resolved') THEN 'status' END AS reject_reason FROM reports""")
def _(f: Feeds) -> DataFrame:
    return clean.validate_reports(f.reports).select("city", "id", "source", "status", "reject_reason")


@query("c7_classify_osm", "SELECT city, kind, count(*) AS n FROM osm GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    k = F.col("kind")
    tags = (
        F.when(k.isin("industrial", "construction"), F.create_map(F.lit("landuse"), k))
        .when(k == "waste_burning", F.create_map(F.lit("man_made"), F.lit("kiln")))
        .when(k == "traffic", F.create_map(F.lit("highway"), F.lit("motorway")))
        .when(k == "road", F.create_map(F.lit("highway"), F.lit("primary"), F.lit("amenity"), F.lit("school")))
        .otherwise(F.create_map(F.lit("amenity"), k))
    )
    return f.osm.select("city", clean.classify_osm(tags).alias("kind")).groupBy("city", "kind").agg(F.count("*").alias("n"))


@query("c8_fire_confidence", "SELECT city, CASE confidence WHEN 'l' THEN 'Low' WHEN 'n' THEN 'Nominal' ELSE 'High' END AS label, CASE confidence WHEN 'l' THEN 0.3e0 WHEN 'n' THEN 0.6e0 ELSE 0.9e0 END AS weight, count(*) AS n FROM fires GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    c = f.fires.select("city", clean.fire_confidence(F.col("confidence")).alias("c"))
    return c.groupBy("city", "c.label", "c.weight").agg(F.count("*").alias("n"))


@query("c9_source_completeness", f"""SELECT city, 'stations' AS source, count(*) AS n_rows, count(DISTINCT station_id) AS n_units, count(DISTINCT date_trunc('hour', ts)) AS n_periods,
    {rnd("count(*)::DOUBLE / (count(DISTINCT station_id) * count(DISTINCT date_trunc('hour', ts))) * 100e0", 1)} AS completeness_pct FROM stations GROUP BY ALL
  UNION ALL SELECT city, 'satellite', count(*), count(DISTINCT cell), count(DISTINCT date), {rnd('avg((no2_col IS NOT NULL)::INTEGER) * 100e0', 1)} FROM satellite GROUP BY ALL
  UNION ALL SELECT city, 'weather', count(*), NULL, count(DISTINCT ts), {rnd('avg((wind_ms IS NOT NULL)::INTEGER) * 100e0', 1)} FROM weather GROUP BY ALL
  UNION ALL SELECT city, 'fires', count(*), NULL, NULL, NULL FROM fires GROUP BY ALL UNION ALL SELECT city, 'osm', count(*), NULL, NULL, NULL FROM osm GROUP BY ALL
  UNION ALL SELECT city, 'citizen_reports', count(*), NULL, NULL, NULL FROM reports GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    return clean.source_completeness(f.stations, f.satellite, f.fires, f.weather, f.osm, f.reports)


@query("c10_locate_ward", f"""SELECT p.city, p.id, coalesce(w.ward_id, b.ward_id) AS ward_id FROM ({stamp("lat", "lon", "(SELECT city, id, lat + 0.003e0 * (id::BIGINT % 40) - 0.05e0 AS lat, lon FROM reports)")}) p
  LEFT JOIN wards w ON w.city = p.city AND w.cell = p.cell LEFT JOIN (SELECT p2.city, p2.id, min_by(ctr.ward_id, (power(ctr.la - p2.lat, 2) + power(ctr.lo - p2.lon, 2), ctr.ward_id)) AS ward_id
    FROM (SELECT city, id, lat + 0.003e0 * (id::BIGINT % 40) - 0.05e0 AS lat, lon FROM reports) p2 JOIN (SELECT city, ward_id, avg({lat_c('cell')}) AS la, avg({lon_c('cell')}) AS lo FROM wards GROUP BY ALL) ctr USING (city) GROUP BY ALL) b ON b.city = p.city AND b.id = p.id""")
def _(f: Feeds) -> DataFrame:
    moved = f.reports.select("city", "id", (F.col("lat") + F.lit(0.003) * (F.col("id").cast("long") % 40) - 0.05).alias("lat"), "lon")
    return wards.locate_ward(moved, f.wards, GRID).select("city", "id", "ward_id")


# ------------------------------------------------------------- D wards, panel


@query("d0a_wards_from_polygons", "SELECT w.city, w.cell, w.ward_id, w.ward_name, count(s.station_id) AS n FROM wards w LEFT JOIN stations s USING (city, cell) GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    n = f.stations.groupBy("city", "cell").agg(F.count("*").alias("n"))
    return wards.wards_from_polygons(f.cells, f.polygons).join(n, ["city", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("d0b_wards_voronoi", f"""SELECT c.city, c.cell, 'W' || lpad((pos + 1)::VARCHAR, 3, '0') AS ward_id, 'Ward ' || lpad((pos + 1)::VARCHAR, 3, '0') AS ward_name FROM (
  SELECT c.city, c.cell, min_by(s.pos, (power(c.lat - s.la, 2) + power((c.lon - s.lo) * cos(radians(m.lat0)), 2), s.pos)) AS pos FROM cells c JOIN (SELECT city, avg(lat) AS lat0 FROM cells GROUP BY ALL) m USING (city)
  JOIN (SELECT r_name AS city, (s_suppkey // 5)::INTEGER AS pos, {lat_of('s_suppkey * 13')} + 0.0037e0 AS la, {lon_of('s_suppkey * 13')} + 0.0021e0 AS lo FROM supplier JOIN region ON r_regionkey = s_suppkey % 5 ) s USING (city) GROUP BY ALL) c""")
def _(f: Feeds) -> DataFrame:
    from workload.feeds import site_lat, site_lon

    k = F.col("s_suppkey")
    region = f.table("region").select(F.col("r_regionkey").alias("_row"), F.col("r_name").alias("city"))
    seeds = f.table("supplier").withColumn("_row", (k % 5).cast("int")).join(region, "_row").select(
        "city", F.floor(k / 5).cast("int").alias("seed_pos"), (site_lat(k * 13) + 0.0037).alias("seed_lat"), (site_lon(k * 13) + 0.0021).alias("seed_lon")
    )
    return wards.wards_from_seeds(f.cells, wards.pick_seeds(seeds))


@query("d0c_attach_wards", "SELECT city, station_id, ward_id, ward_name, count(*) AS n FROM stations LEFT JOIN wards USING (city, cell) GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return wards.attach_wards(f.stations, f.wards).groupBy("city", "station_id", "ward_id", "ward_name").agg(F.count("*").alias("n"))


@query("d2_station_cell_hour", f"SELECT city, cell, {ts('ts')} AS ts, {sfx('pm25_station')} AS pm25_station FROM labels")
def _(f: Feeds) -> DataFrame:
    return panel.station_cell_hour(f.stations).select("city", "cell", text_ts("ts").alias("ts"), fx("pm25_station").alias("pm25_station"))


@query("d3_join_weather", f"SELECT city, cell, {ts('ts')} AS ts, wind_from_deg, wind_ms, blh_m, temp_c FROM labels LEFT JOIN weather USING (city, ts)")
def _(f: Feeds) -> DataFrame:
    return panel.join_weather(panel.station_cell_hour(f.stations), f.weather).select("city", "cell", text_ts("ts").alias("ts"), *panel.WEATHER)


@query("d4_join_satellite", f"SELECT city, cell, {ts('date')} AS date, {sfx('no2_col')} AS no2_col, {sfx('so2_col')} AS so2_col, {sfx('aai')} AS aai FROM sat_full")
def _(f: Feeds) -> DataFrame:
    full = panel.fill_satellite(panel._cell_days(f.cells, f.hours), f.satellite)
    return full.select("city", "cell", text_ts(F.col("date").cast("timestamp")).alias("date"), *[fx(c).alias(c) for c in panel.SATELLITE])


@query("d5_fire_features", f"SELECT city, cell, {ts('ts')} AS ts, fires_6h, {sfx('frp_6h')} AS frp_6h FROM fire_feat")
def _(f: Feeds) -> DataFrame:
    feat = panel.fire_features(f.cells, f.fires, f.hours)
    return feat.select("city", "cell", text_ts("ts").alias("ts"), "fires_6h", fx("frp_6h").alias("frp_6h"))


@query("d6_landuse_features", "SELECT * FROM landuse")
def _(f: Feeds) -> DataFrame:
    return panel.landuse_features(f.cells, f.osm)


@query("d7_time_features", f"SELECT city, station_id, {ts('ts')} AS ts, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS dow FROM stations")
def _(f: Feeds) -> DataFrame:
    return panel.time_features(f.stations).select("city", "station_id", text_ts("ts").alias("ts"), "hour", "dow")


_sums = ["pm25_station", "wind_from_deg", "no2_col", "so2_col", "aai", "frp_6h"]
_ints = ["fires_6h", "lu_industrial", "lu_construction", "lu_waste_burning", "lu_traffic", "lu_road", "lu_sensitive", "hour", "dow"]


@query("d8_build_panel", f"""SELECT city, cell, ward_id, count(*) AS n, {', '.join(f'count({c})::BIGINT AS n_{c}' for c in _sums)}, {', '.join(f'{sfx(f"min({c})", 5)} AS min_{c}, {sfx(f"max({c})", 5)} AS max_{c}' for c in _sums)},
  {', '.join(f'sum({c})::BIGINT AS sum_{c}' for c in _ints)}, {sfx(med('no2_col'), 5)} AS med_no2, {sfx(med('frp_6h'), 5)} AS med_frp FROM panel GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    return f.panel.groupBy("city", "cell", "ward_id").agg(
        F.count("*").alias("n"),
        *[F.count(c).alias(f"n_{c}") for c in _sums],
        *[x for c in _sums for x in (fx(F.min(c), 5).alias(f"min_{c}"), fx(F.max(c), 5).alias(f"max_{c}"))],
        *[F.sum(c).alias(f"sum_{c}") for c in _ints],
        fx(F.median("no2_col"), 5).alias("med_no2"),
        fx(F.median("frp_6h"), 5).alias("med_frp"),
    )


@query("d8_panel_hours", f"""SELECT city, {ts('ts')} AS ts, count(*) AS n, count(pm25_station) AS labelled, sum(fires_6h)::BIGINT AS fires, max(blh_m) AS blh_m, {sfx(med('no2_col'), 5)} AS med_no2 FROM panel GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    return f.panel.groupBy("city", text_ts("ts").alias("ts")).agg(
        F.count("*").alias("n"), F.count("pm25_station").alias("labelled"), F.sum("fires_6h").alias("fires"), F.max("blh_m").alias("blh_m"),
        fx(F.median("no2_col"), 5).alias("med_no2"),
    )


@query("d9_light_panel", f"SELECT city, cell, {ts('ts')} AS ts, {sfx('pm25_station')} AS pm25_station, wind_ms, blh_m FROM labels LEFT JOIN weather USING (city, ts)")
def _(f: Feeds) -> DataFrame:
    return panel.light_panel(f.stations, f.weather).select("city", "cell", text_ts("ts").alias("ts"), fx("pm25_station").alias("pm25_station"), "wind_ms", "blh_m")
