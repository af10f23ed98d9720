"""Signals, hotspots, attribution, exposure and forecast (ids E, F, H, M, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.functions import stats
from hazegrid.operators import attribution, exposure, forecast, hotspots, panel, signals
from hazegrid.session import cut_lineage, materialise
from workload.feeds import GRID, HOT_THRESH, Feeds, block_zone, fx, text_ts
from workload.registry import query
from workload.sqlkit import (
    BASIS, KIND, RANK, SEVERITY, WINDOWS, align, aqi, band, bearing, cte, d, hav, lat_c, lon_c, med, med_of, offset_rows,
    pmod360, quant, rnd, robust, ts,
)
from workload.sqlkit import fx as sfx

Z = ["z_w24h", "z_w7d", "z_w30d"]

# ------------------------------------------------------------------ E signals


@query("e1_robust_z", f"SELECT city, station_id, {ts('ts')} AS ts, {sfx('z')} AS z FROM ({robust('SELECT city, station_id, ts, pm25 FROM stations', 'pm25', 'z')})")
def _(f: Feeds) -> DataFrame:
    return stats.robust_z(f.stations, "pm25").select("city", "station_id", text_ts("ts").alias("ts"), fx("z").alias("z"))


@query("e2_window_medians", f"SELECT city, cell, {', '.join(f'{sfx(c)} AS {c}' for c in [*WINDOWS, *Z])} FROM wz")
def _(f: Feeds) -> DataFrame:
    m = signals.window_medians(panel.station_cell_hour(f.stations), "pm25_station")
    return m.select("city", "cell", *[fx(c).alias(c) for c in [*WINDOWS, *Z]])


# Contrast over the panel's window medians, restated from the daily satellite table.
cte("now_panel", "SELECT city, max(ts) AS now_ts FROM hours GROUP BY ALL")
cte("pw", "SELECT p.city, p.cell, p.ts, p.no2_col, p.fires_6h, n.now_ts FROM panel p JOIN now_panel n USING (city) WHERE p.ts > n.now_ts - INTERVAL 720 HOUR")
cte("pmed", f"""SELECT city, cell, {', '.join(f"{med('no2_col', f'ts > now_ts - INTERVAL {h} HOUR')} AS m_{w}, avg((fires_6h > 0)::INTEGER) FILTER (WHERE ts > now_ts - INTERVAL {h} HOUR) / 0.05e0 AS f_{w}" for w, h in WINDOWS.items())} FROM pw GROUP BY ALL""")
cte("ring10", offset_rows(0, 10))


def _contrast(rel: str, v: str) -> str:
    return f"""SELECT city, cell, CASE WHEN len(ins) >= 2 AND len(outs) >= 6 THEN ({med_of('ins')} - om) / greatest(CASE WHEN 1.4826e0 * mad >= 1e-9 THEN 1.4826e0 * mad ELSE sd END, abs(om) * 0.05e0, 1e-9) ELSE 0e0 END AS k
      FROM (SELECT *, {med_of('outs')} AS om, list_sort(list_transform(outs, lambda x: abs(x - {med_of('outs')}))) AS dev, {med_of('dev')} AS mad, list_aggregate(outs, 'stddev_pop') AS sd
        FROM (SELECT a.city, a.cell, list_sort(list(b.{v}) FILTER (WHERE ring <= 1 AND b.{v} IS NOT NULL)) AS ins, coalesce(list_sort(list(b.{v}) FILTER (WHERE ring >= 5 AND b.{v} IS NOT NULL)), []) AS outs
          FROM {rel} a JOIN ring10 ON ring <= 1 OR ring >= 5 JOIN {rel} b ON b.city = a.city AND b.cell = a.cell + delta WHERE a.{v} IS NOT NULL GROUP BY ALL))"""


for _w in WINDOWS:
    cte(f"kon_{_w}", _contrast("pmed", f"m_{_w}"))
cte("zscores", f"""SELECT p.city, p.cell, {', '.join(f'coalesce(greatest(k_{w}.k, p.f_{w}), 0e0) AS z_{w}' for w in WINDOWS)},
  coalesce(greatest({', '.join(f'k_{w}.k' for w in WINDOWS)}), 0e0) AS c_no2_col, coalesce(greatest({', '.join(f'p.f_{w}' for w in WINDOWS)}), 0e0) AS c_fire
  FROM pmed p {' '.join(f'LEFT JOIN kon_{w} k_{w} ON k_{w}.city = p.city AND k_{w}.cell = p.cell' for w in WINDOWS)}""")
cte("exposed", f"""SELECT z.*, coalesce(w.m, c.m) AS pm25_med, p.fires_6h, n.now_ts AS ts FROM zscores z JOIN now_panel n USING (city) JOIN panel p ON p.city = z.city AND p.cell = z.cell AND p.ts = n.now_ts
  LEFT JOIN field_week w ON w.city = z.city AND w.cell = z.cell LEFT JOIN (SELECT city, {med('m')} AS m FROM field_week GROUP BY ALL) c ON c.city = z.city""")
cte("field_week", f"SELECT city, cell, {med('pm25_hat')} AS m FROM field JOIN now_panel USING (city) WHERE ts > now_ts - INTERVAL 168 HOUR AND ts <= now_ts GROUP BY ALL")
cte("real_hot", f"SELECT *, {KIND.format(t='2e0')} AS kind FROM exposed WHERE kind <> 'none'")
cte("real_mark", f"""SELECT h.*, coalesce({rnd('km', 2)}, 999e0) AS nearest_candidate_km, coalesce({rnd('km', 2)}, 999e0) <= 0.5e0 OR c_fire > 0 AS attributable FROM real_hot h LEFT JOIN (
  SELECT h.city, h.cell, min({hav(lat_c('h.cell'), lon_c('h.cell'), 'o.lat', 'o.lon')}) AS km FROM real_hot h JOIN osm o USING (city) WHERE o.kind IN ('industrial', 'construction', 'waste_burning') GROUP BY ALL) USING (city, cell)""")


@query("e3_neighbourhood_contrast", f"SELECT city, cell, {sfx('k', 5)} AS contrast FROM kon_w30d")
def _(f: Feeds) -> DataFrame:
    at = signals.with_latest(f.panel.select("city", "cell", "ts", "no2_col"))
    month = at.where(signals.trailing(F.col("ts"), F.col("at"), 720)).groupBy("city", "cell").agg(F.median("no2_col").alias("m"))
    return signals.neighbourhood_contrast(month, {"contrast": "m"}, grid=GRID).where("contrast is not null").select("city", "cell", fx("contrast", 5).alias("contrast"))


cte("plume_band", "SELECT delta, bear FROM ring10 WHERE ring >= 1 AND km >= 2e0 AND km <= 6e0")
cte("wind_day", "SELECT city, ts::DATE AS date, (degrees(atan2(avg(sin(radians(wind_from_deg))), avg(cos(radians(wind_from_deg))))) + 360e0) % 360e0 AS wf FROM weather GROUP BY ALL")
_off = f"abs({pmod360('bear - ((wf + 180e0) % 360e0) + 180e0')} - 180e0)"
cte("plume_cell", f"""SELECT city, cell, {med('e')} AS enh FROM (SELECT city, cell, date, {med('v', f'{_off} <= 40e0')} - {med('v', f'abs({_off} - 90e0) <= 40e0')} AS e
  FROM (SELECT s.city, s.cell - delta AS cell, s.date, s.no2_col AS v, bear, wf FROM satellite s JOIN wind_day USING (city, date) JOIN plume_band ON TRUE WHERE s.no2_col IS NOT NULL) GROUP BY ALL) GROUP BY ALL""")


@query("e4_downwind_enhancement", f"SELECT city, cell, {sfx('plume', 5)} AS plume FROM ({robust('SELECT c.city, c.cell, coalesce(enh, 0e0) AS enh FROM cells c LEFT JOIN plume_cell USING (city, cell)', 'enh', 'plume')})")
def _(f: Feeds) -> DataFrame:
    return signals.downwind_enhancement(f.satellite, f.weather, f.cells, grid=GRID).select("city", "cell", fx("plume", 5).alias("plume"))


@query("e5_fire_persistence", f"SELECT city, cell, {', '.join(f'{sfx(f"f_{w}")} AS f_{w}' for w in WINDOWS)} FROM pmed")
def _(f: Feeds) -> DataFrame:
    p = signals.fire_persistence(f.panel.select("city", "cell", "ts", "fires_6h"))
    return p.select("city", "cell", *[fx(f"f_{w}").alias(f"f_{w}") for w in WINDOWS])


@query("e6_classify_persistence", f"SELECT city, cell, {KIND.format(t='1e0')} AS kind FROM wz")
def _(f: Feeds) -> DataFrame:
    m = signals.window_medians(panel.station_cell_hour(f.stations), "pm25_station")
    return m.select("city", "cell", signals.classify_persistence(*[F.col(z) for z in Z], 1.0).alias("kind"))


_CH = ["no2_col", "so2_col", "aai"]


def _snr(p: str) -> str:
    cte(f"snr_{p}", f"SELECT city, cell, {med(p)} AS m, count({p})::DOUBLE AS n, stddev_pop({p}) AS sd FROM satellite GROUP BY ALL HAVING count({p}) > 0")
    cte(f"snr_city_{p}", f"SELECT city, {med('m')} AS cm, {med('n')} AS cn, {med('sd')} * 1.25e0 / greatest(sqrt(greatest({med('n')}, 1e0)), 1e0) AS noise FROM snr_{p} GROUP BY ALL")
    spatial = f"({med('abs(m - cm)')} * 1.4826e0)"
    return f"""SELECT city, '{p}' AS pollutant, {rnd('any_value(cn)', 1)} AS n_obs, {rnd('any_value(cm)', 2)} AS level, {rnd(spatial, 2)} AS spatial,
      {rnd('any_value(noise)', 2)} AS noise, {rnd(f'{spatial} / nullif(any_value(noise), 0)', 2)} AS snr FROM snr_{p} JOIN snr_city_{p} USING (city) GROUP BY city"""


_VERDICT = "CASE WHEN snr IS NULL THEN 'no data' WHEN snr >= 3 THEN 'strong' WHEN snr >= 1.5 THEN 'usable' ELSE 'noise' END"


@query("e7_channel_snr", f"SELECT *, {_VERDICT} AS verdict FROM ({' UNION ALL '.join(_snr(p) for p in _CH)})")
def _(f: Feeds) -> DataFrame:
    return signals.channel_snr(f.satellite, _CH)


@query("e8_negative_fraction", f"SELECT city, {', '.join(f'{sfx(f"avg(({p} < 0)::INTEGER)")} AS neg_{p}' for p in _CH)} FROM satellite GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    n = signals.negative_fraction(f.satellite, _CH)
    return n.select("city", *[fx(c).alias(c) for c in n.columns if c != "city"])


# ----------------------------------------------------------------- F hotspots

_score_cols = [*Z, "c_no2_col", "c_fire"]


def _scores(f: Feeds) -> DataFrame:
    return hotspots.zone_scores(f.panel, grid=GRID)


@query("f1_zone_scores", f"SELECT city, cell, {', '.join(f'{sfx(c, 5)} AS {c}' for c in _score_cols)} FROM zscores")
def _(f: Feeds) -> DataFrame:
    return _scores(f).select("city", "cell", *[fx(c, 5).alias(c) for c in _score_cols])


@query("f2_exposure_context", f"SELECT city, cell, {ts('ts')} AS ts, {sfx('pm25_med')} AS pm25_med, fires_6h, {sfx('z_w30d', 5)} AS z_w30d FROM exposed")
def _(f: Feeds) -> DataFrame:
    e = hotspots.exposure_context(_scores(f), f.panel, f.field)
    return e.select("city", "cell", text_ts("ts").alias("ts"), fx("pm25_med").alias("pm25_med"), "fires_6h", fx("z_w30d", 5).alias("z_w30d"))


@query("f3_hot_cells", "SELECT city, cell, kind FROM real_hot")
def _(f: Feeds) -> DataFrame:
    return hotspots.hot_cells(_scores(f)).select("city", "cell", "kind")


@query("f4_mark_attributable", "SELECT city, cell, nearest_candidate_km, attributable FROM real_mark")
def _(f: Feeds) -> DataFrame:
    hot = cut_lineage(hotspots.hot_cells(_scores(f)))
    return hotspots.mark_attributable(hot, f.osm, GRID).select("city", "cell", "nearest_candidate_km", "attributable")


cte("zone_link", f"""SELECT a.city, a.cell AS a, b.cell AS b FROM hot a JOIN hot b ON a.city = b.city AND a.cell <> b.cell
  AND abs({lat_c('a.cell')} - {lat_c('b.cell')}) < 0.03e0 AND {hav(lat_c('a.cell'), lon_c('a.cell'), lat_c('b.cell'), lon_c('b.cell'))} <= 2e0""")


cte("walk", """SELECT city, cell, cell AS seen FROM hot UNION SELECT w.city, w.cell, l.b FROM walk w JOIN zone_link l ON l.city = w.city AND l.a = w.seen""")


@query("f5_zone_components", "SELECT city, cell, min(seen) AS comp FROM walk GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    from hazegrid.operators.spatial import components

    return components(f.hot.select("city", "cell"), hotspots.zone_edges(f.hot, grid=GRID).select("city", "a", "b"))


def _merge(name: str, rel: str) -> str:
    """CTEs that merge the cells of ``rel`` link by link, nearest first, unless a zone would be wider than 5 km."""
    gap = hav(lat_c("a.cell"), lon_c("a.cell"), lat_c("b.cell"), lon_c("b.cell"))
    cte(f"{name}_near", f"""SELECT city, a, b, row_number() OVER (PARTITION BY city ORDER BY km, a, b) AS n FROM (
      SELECT a.city, a.cell AS a, b.cell AS b, {gap} AS km FROM {rel} a JOIN {rel} b ON a.city = b.city AND a.cell < b.cell
      WHERE abs({lat_c('a.cell')} - {lat_c('b.cell')}) < 0.03e0 AND {gap} <= 2e0)""")
    own = lambda c: f"list_filter(st, lambda x: x.cell = {c})[1].g"
    far = f"""list_max(list_transform(list_filter(st, lambda x: x.g = ga), lambda x: list_max(list_transform(list_filter(st, lambda y: y.g = gb),
      lambda y: {hav('x.la', 'x.lo', 'y.la', 'y.lo')}))))"""
    cte(f"{name}_steps", f"""SELECT city, 0::BIGINT AS n, list({{'cell': cell, 'la': {lat_c('cell')}, 'lo': {lon_c('cell')}, 'g': cell}} ORDER BY cell) AS st FROM {rel} GROUP BY city
      UNION ALL SELECT city, n, CASE WHEN ga <> gb AND {far} <= 5e0
        THEN list_transform(st, lambda x: {{'cell': x.cell, 'la': x.la, 'lo': x.lo, 'g': CASE WHEN x.g = gb THEN ga ELSE x.g END}}) ELSE st END
      FROM (SELECT m.city, l.n, st, {own('l.a')} AS ga, {own('l.b')} AS gb FROM {name}_steps m JOIN {name}_near l ON l.city = m.city AND l.n = m.n + 1)""")
    cte(f"{name}_root", f"""SELECT city, u.cell AS cell, min(u.cell) OVER (PARTITION BY city, u.g) AS root FROM (
      SELECT city, unnest(st) AS u FROM {name}_steps QUALIFY n = max(n) OVER (PARTITION BY city))""")
    return f"(SELECT city, cell, printf('Z%02d', dense_rank() OVER (PARTITION BY city ORDER BY root) - 1) AS zone_id FROM {name}_root)"


_RANKED = f"['none', 'acute', 'emerging', 'chronic'][max({RANK.format(k='kind')}) OVER z + 1] AS zone_kind, bool_or(attributable) OVER z AS any_attributable"


@query("f5_reconcile_zones", f"""SELECT city, cell, zone_id, zone_kind AS kind, kind AS cell_kind, any_attributable AS attributable FROM (
  SELECT h.city, h.cell, m.zone_id, kind, {_RANKED} FROM hot h JOIN {_merge('hotmerge', 'hot')} m USING (city, cell) WINDOW z AS (PARTITION BY h.city, m.zone_id))""")
def _(f: Feeds) -> DataFrame:
    hot = f.hot.drop("zone_id", "cell_kind")
    return hotspots.reconcile_zones(hot, grid=GRID).select("city", "cell", "zone_id", "kind", "cell_kind", "attributable")


@query("f6_severity", f"SELECT city, cell, {SEVERITY} AS severity, {BASIS} AS detection_basis FROM real_hot")
def _(f: Feeds) -> DataFrame:
    hot = cut_lineage(hotspots.hot_cells(hotspots.exposure_context(_scores(f), f.panel, f.field)))
    return hotspots.detection_basis(hotspots.severity(hot)).select("city", "cell", "severity", "detection_basis")


@query("f6_hotspot_contract", f"SELECT * REPLACE ({ts('ts')} AS ts) FROM hot")
def _(f: Feeds) -> DataFrame:
    return hotspots.by_severity(f.hot).withColumn("ts", text_ts("ts"))


@query("f8_citywide_episode", f"""SELECT city, {sfx('now_med')} AS now_med, {sfx('week_med')} AS week_med, now_med / week_med > 1.25 AS episode FROM (SELECT city, {med('pm25_hat')} AS now_med FROM field_now GROUP BY ALL)
  JOIN (SELECT city, {med('pm25_hat')} AS week_med FROM field JOIN field_at USING (city) WHERE ts > now_ts - INTERVAL 7 DAY GROUP BY ALL) USING (city)""")
def _(f: Feeds) -> DataFrame:
    return hotspots.citywide_episode(f.field).select("city", fx("now_med").alias("now_med"), fx("week_med").alias("week_med"), "episode")


@query("f9_detect", f"""SELECT city, cell, ward_id, ward_name, zone_id, zone_kind AS kind, kind AS cell_kind, any_attributable AS attributable, {SEVERITY.replace('kind', 'zone_kind')} AS severity, {rnd('pm25_med', 2)} AS pm25_med,
    nearest_candidate_km, {', '.join(f'{rnd(z, 2)} AS {z}' for z in Z)}, fires_6h, {BASIS} AS detection_basis, {ts('ts')} AS ts
  FROM (SELECT h.* EXCLUDE (zone_id), m.zone_id, {_RANKED} FROM (SELECT *, 0 AS zone_id FROM real_mark) h JOIN {_merge('realmerge', 'real_mark')} m USING (city, cell) WINDOW z AS (PARTITION BY h.city, m.zone_id)) LEFT JOIN wards USING (city, cell)""")
def _(f: Feeds) -> DataFrame:
    return hotspots.detect(f.panel, f.field, f.osm, f.wards, grid=GRID).withColumn("ts", text_ts("ts"))


@query("f9_detect_blocks", f"""SELECT city, cell, ward_id, zone_id, kind, cell_kind, attributable, {SEVERITY} AS severity, {rnd('pm25_med', 2)} AS pm25_med, nearest_candidate_km, {', '.join(f'{rnd(z, 2)} AS {z}' for z in Z)}, fires_6h, {BASIS} AS detection_basis
  FROM (SELECT city, cell, zone_id, kind AS cell_kind, ['none', 'acute', 'emerging', 'chronic'][max({RANK.format(k='kind')}) OVER z + 1] AS kind, bool_or(attributable) OVER z AS attributable, pm25_med, nearest_candidate_km, {', '.join(Z)}, fires_6h
    FROM (SELECT *, 'B_' || floor((cell // 2097152 - 1048576) / 4)::BIGINT || '_' || floor((cell % 2097152 - 1048576) / 4)::BIGINT AS zone_id FROM real_mark) WINDOW z AS (PARTITION BY city, zone_id)) LEFT JOIN wards USING (city, cell)""")
def _(f: Feeds) -> DataFrame:
    hot = cut_lineage(hotspots.hot_cells(hotspots.exposure_context(_scores(f), f.panel, f.field)))
    marked = cut_lineage(hotspots.mark_attributable(hot, f.osm, GRID))
    zoned = hotspots.apply_zones(marked, marked.select("city", "cell", block_zone(F.col("cell")).alias("zone_id")))
    return hotspots.finish_hotspots(zoned, f.wards).drop("ward_name", "ts")


@query("f10_hotspot_summary", "SELECT city, kind, count(*) AS n_cells, count(DISTINCT zone_id) AS n_zones, count(*) FILTER (WHERE attributable) AS enforceable_cells, count(*) FILTER (WHERE NOT attributable) AS diffuse_cells FROM hot GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return hotspots.hotspot_summary(f.hot)


# -------------------------------------------------------------- H attribution

_CAT = ["industrial", "construction", "waste_burning", "traffic"]
_LU = ["lu_industrial", "lu_construction", "lu_waste_burning", "lu_traffic", "lu_road", "lu_sensitive"]
cte("zones", """SELECT city, zone_id, list(cell ORDER BY severity DESC, cell)[1] AS anchor, list(ward_id ORDER BY severity DESC, cell)[1] AS ward_id, any_value(kind) AS kind, any_value(ts) AS ts,
  CASE any_value(kind) WHEN 'emerging' THEN 168 WHEN 'acute' THEN 24 ELSE 720 END AS hours, list(cell ORDER BY cell) AS cells, count(*)::INTEGER AS n_cells
  FROM (SELECT * FROM hot WHERE attributable AND (city, zone_id) IN (SELECT (city, zone_id) FROM (SELECT city, zone_id FROM hot WHERE attributable QUALIFY row_number() OVER (PARTITION BY city ORDER BY severity DESC, cell) <= 100))) GROUP BY ALL""")
cte("zpanel", """SELECT z.zone_id, z.kind, z.ts AS zone_ts, p.*, f.pm25_hat FROM (SELECT city, zone_id, kind, ts, hours, unnest(cells) AS cell FROM zones) z JOIN panel p ON p.city = z.city AND p.cell = z.cell
  AND p.ts > z.ts - to_hours(z.hours) AND p.ts <= z.ts LEFT JOIN field f ON f.city = p.city AND f.cell = p.cell AND f.ts = p.ts""")
_num = ["pm25_hat", "no2_col", "so2_col", "aai", "wind_ms", "blh_m", "temp_c", *_LU]
cte("zrow", f"SELECT city, zone_id, {', '.join(f'{med(c)} AS {c}' for c in _num)}, CASE WHEN any_value(kind) = 'acute' THEN hour(any_value(zone_ts)) ELSE 12 END::INTEGER AS hour FROM zpanel GROUP BY ALL")
cte("zfire", f"""SELECT city, zone_id, arg_max(burned, (frac, -cell))::INTEGER AS fire_hours, {rnd('max(frac)', 4)} AS fire_hour_fraction, any_value(frp) AS frp_p90 FROM (
  SELECT city, zone_id, cell, avg((fires_6h > 0)::INTEGER) AS frac, sum((fires_6h > 0)::INTEGER) AS burned FROM zpanel GROUP BY ALL) JOIN (SELECT city, zone_id, {rnd(quant('frp_6h', 0.9), 1)} AS frp FROM zpanel GROUP BY ALL) USING (city, zone_id) GROUP BY ALL""")
cte("zmet", f"""SELECT city, zone_id, round_even((degrees(atan2(avg(sin(radians(wind_from_deg))), avg(cos(radians(wind_from_deg))))) + 360e0) % 360e0, 0)::INTEGER AS wind_from_deg, {rnd(med('wind_ms'), 1)} AS wind_ms,
  round_even({med('blh_m')}, 0)::INTEGER AS blh_m, {med('blh_m')} < 500 AS air_trapped FROM zpanel GROUP BY ALL""")
_zlat, _zlon = lat_c("z.anchor"), lon_c("z.anchor")
cte("zcand_all", f"""SELECT z.city, z.zone_id, o.name, o.kind AS type, {hav('o.lat', 'o.lon', _zlat, _zlon)} AS km, {bearing('o.lat', 'o.lon', _zlat, _zlon)} AS b FROM zones z JOIN osm o USING (city)
  WHERE o.kind IN ('industrial', 'construction', 'waste_burning', 'traffic') AND {hav('o.lat', 'o.lon', _zlat, _zlon)} <= 5e0""")
cte("zwind", "SELECT city, zone_id, wind_from_deg AS w, count(*) AS n FROM zpanel WHERE wind_from_deg IS NOT NULL GROUP BY ALL")
cte("zbear", f"SELECT c.city, c.zone_id, c.b, sum({align('c.b', 'w')} * n) / sum(n) AS a FROM (SELECT DISTINCT city, zone_id, b FROM zcand_all) c JOIN zwind USING (city, zone_id) GROUP BY ALL")
cte("zcand", f"""SELECT city, zone_id, name, type, distance_km, wind_alignment, rank::INTEGER AS rank FROM (SELECT c.city, c.zone_id, name, type, {rnd('km', 2)} AS distance_km, {rnd('a', 2)} AS wind_alignment,
  row_number() OVER (PARTITION BY c.city, c.zone_id ORDER BY {rnd('a', 2)} / ({rnd('km', 2)} + 1e0) DESC, {rnd('km', 2)}, type, name) AS rank FROM zcand_all c JOIN zbear USING (city, zone_id, b)) WHERE rank <= 8""")
cte("zsig", "SELECT r.city, r.zone_id, " + ", ".join(
    f"{rnd(f'r.{p}', 1)} AS {p}_value, (SELECT floor(count(*) FILTER (WHERE p.{p} < r.{p}) * 100e0 / count(p.{p}))::INTEGER FROM panel_sat p WHERE p.city = r.city) AS {p}_pct" for p in _CH) + " FROM zrow r")
cte("panel_sat", "SELECT city, no2_col, so2_col, aai FROM panel")
cte("zcit", f"""SELECT z.city, z.zone_id, count(*)::INTEGER AS n_reports, {', '.join(f"count(*) FILTER (WHERE category = '{c}')::INTEGER AS n_{c}" for c in _CAT)} FROM zones z JOIN reports r ON r.city = z.city AND r.ward_id = z.ward_id
  WHERE z.ward_id NOT IN ('', 'unassigned') AND r.category <> 'other' AND r.ts >= z.ts - to_hours(z.hours) AND r.ts <= z.ts GROUP BY ALL""")


def _zp(f: Feeds) -> DataFrame:
    zp = attribution.zone_panel(attribution.zone_window(f.hot, 100), f.panel)
    return zp.join(f.field, ["city", "cell", "ts"], "left")


@query("h1_zone_window", f"SELECT city, zone_id, anchor, ward_id, kind, {ts('ts')} AS ts, hours, n_cells FROM zones")
def _(f: Feeds) -> DataFrame:
    return attribution.zone_window(f.hot, 100).withColumn("ts", text_ts("ts")).drop("cells")


@query("h2_zone_row", f"SELECT city, zone_id, hour, {', '.join(f'{sfx(c, 5)} AS {c}' for c in _num)} FROM zrow")
def _(f: Feeds) -> DataFrame:
    r = attribution.zone_row(_zp(f), attribution.zone_window(f.hot, 100))
    return r.select("city", "zone_id", "hour", *[fx(c, 5).alias(c) for c in _num])


@query("h3_zone_fire_activity", "SELECT * FROM zfire")
def _(f: Feeds) -> DataFrame:
    return attribution.zone_fire_activity(_zp(f))


@query("h4_candidates", "SELECT * FROM zcand")
def _(f: Feeds) -> DataFrame:
    zones = attribution.zone_window(f.hot, 100)
    return attribution.candidates(zones, attribution.zone_winds(attribution.zone_panel(zones, f.panel)), f.osm, GRID, 8)


@query("h5_pollutant_signature", "SELECT * FROM zsig")
def _(f: Feeds) -> DataFrame:
    rows = attribution.zone_row(_zp(f), attribution.zone_window(f.hot, 100))
    return attribution.pollutant_signature(rows, f.panel)


@query("h6_citizen_corroboration", "SELECT * FROM zcit")
def _(f: Feeds) -> DataFrame:
    return attribution.citizen_corroboration(attribution.zone_window(f.hot, 100), f.reports)


@query("h7_meteorology", "SELECT * FROM zmet")
def _(f: Feeds) -> DataFrame:
    return attribution.zone_meteorology(_zp(f))


_best = {c: f"coalesce(max(CASE WHEN type = '{c}' THEN wind_alignment * exp(-distance_km / 2e0) END), 0e0) AS b_{c}" for c in _CAT}
cte("zev", f"""SELECT z.*, r.hour, r.pm25_hat, {', '.join(f'floor(r.lu_{c})::INTEGER AS lu_{c}' for c in _CAT)}, g.* EXCLUDE (city, zone_id), i.* EXCLUDE (city, zone_id), m.* EXCLUDE (city, zone_id),
  coalesce(c.n_reports, 0) AS n_reports, {', '.join(f'coalesce(c.n_{k}, 0) AS n_{k}, coalesce(b.b_{k}, 0e0) AS b_{k}, coalesce(b.s_{k}, FALSE) AS up_{k}, b.t_{k}' for k in _CAT)}
  FROM zones z JOIN zrow r USING (city, zone_id) JOIN zsig g USING (city, zone_id) JOIN zfire i USING (city, zone_id) JOIN zmet m USING (city, zone_id) LEFT JOIN zcit c USING (city, zone_id)
  LEFT JOIN (SELECT city, zone_id, {', '.join(_best.values())}, {', '.join(f"bool_or(type = '{c}' AND wind_alignment > 0.4) AS s_{c}, min_by(name || ' lies ' || distance_km || ' km off, upwind match ' || wind_alignment, rank) FILTER (WHERE type = '{c}') AS t_{c}" for c in _CAT)}
    FROM zcand GROUP BY ALL) b USING (city, zone_id)""")
_add = {c: f"b_{c}" for c in _CAT}
_add["traffic"] = "(b_traffic + CASE WHEN no2_col_pct >= 80 AND (hour BETWEEN 7 AND 10 OR hour BETWEEN 17 AND 20) THEN 0.8e0 ELSE 0e0 END)"
_add["waste_burning"] = "(b_waste_burning + CASE WHEN fire_hour_fraction > 0 THEN least(fire_hour_fraction / 0.10e0, 1e0) * 2e0 + 1e0 ELSE 0e0 END)"
_full = {c: f"({e} + (least(n_{c}, 3) * 0.25e0 + 0e0)) + least(lu_{c}, 3) * 0.15e0" for c, e in _add.items()}
_full["construction"] = f"({_full['construction']}) * CASE WHEN hour BETWEEN 8 AND 18 THEN 1.2e0 ELSE 0.5e0 END"
cte("zscore", f"SELECT *, {', '.join(f'{rnd(e, 3)} AS s_{c}' for c, e in _full.items())} FROM zev")
_top = "greatest(s_industrial, s_construction, s_waste_burning, s_traffic)"
cte("ztop", f"SELECT *, CASE {_top} {' '.join(f"WHEN s_{c} THEN '{c}'" for c in _CAT)} END AS primary_source, list_reverse_sort([{', '.join(f's_{c}' for c in _CAT)}]) AS ranked FROM zscore")


def _of(prefix: str) -> str:
    return f"CASE primary_source {' '.join(f"WHEN '{c}' THEN {prefix}{c}" for c in _CAT)} END"


cte("zagree", f"""SELECT *, least(coalesce({_of('up_')}, FALSE)::INTEGER + (primary_source = 'traffic' AND no2_col_pct >= 80)::INTEGER + (primary_source = 'waste_burning' AND fire_hour_fraction > 0)::INTEGER
  + ({_of('lu_')} > 0)::INTEGER + ({_of('n_')} > 0)::INTEGER, 4)::INTEGER AS agreement FROM ztop""")
_margin = "(ranked[1] - ranked[2]) / nullif(ranked[1], 0e0)"
cte("zconf", f"""SELECT *, CASE WHEN ranked[1] <= 0 THEN 0.05e0 ELSE {rnd(f"least(greatest(({_margin} * 0.30e0 + 0.10e0 + least(greatest(ranked[1] / 2e0, 0e0), 1e0) * 0.30e0 + agreement / 4e0 * 0.30e0) * least(1e0, ranked[1] / 0.5e0), 0.05e0), 0.95e0)", 2)} END AS confidence FROM zagree""")
_words = "replace(primary_source, '_', ' ')"
cte("zreason", f"""SELECT *, CASE WHEN len(fs) > 0 THEN fs ELSE ['land use alone'] END AS evidence_factors,
  'Highest score: ' || {_words} || '. ' || array_to_string(evidence_factors[:3], '; ') || '.' AS reason FROM (SELECT *, list_filter([{_of('t_')},
  CASE WHEN primary_source = 'traffic' AND no2_col_pct >= 80 THEN 'NO2 higher than over ' || no2_col_pct || '% of the city' END,
  CASE WHEN primary_source = 'waste_burning' AND fire_hours > 0 THEN 'fires seen from space in ' || fire_hours || ' hours (' || round_even(fire_hour_fraction * 100e0, 0)::INTEGER || '% of the window)' END,
  CASE WHEN {_of('n_')} > 0 THEN ({_of('n_')}) || ' times residents of the ward have named ' || {_words} END,
  CASE WHEN air_trapped THEN 'air mixes up to ' || blh_m || ' m only' END], lambda x: x IS NOT NULL) AS fs FROM zconf)""")


def _judged(f: Feeds) -> DataFrame:
    ev = attribution.gather_evidence(attribution.zone_window(f.hot, 100), f.panel, f.field, f.osm, f.reports, GRID, 8)
    return attribution.judge(cut_lineage(ev))


@query("h8_category_scores", f"SELECT city, zone_id, {', '.join(f's_{c}' for c in _CAT)} FROM zscore")
def _(f: Feeds) -> DataFrame:
    return _judged(f).select("city", "zone_id", *[f"s_{c}" for c in _CAT])


@query("h9_independent_signals", "SELECT city, zone_id, primary_source, agreement FROM zagree")
def _(f: Feeds) -> DataFrame:
    return _judged(f).select("city", "zone_id", "primary_source", "agreement")


@query("h10_confidence", "SELECT city, zone_id, confidence FROM zconf")
def _(f: Feeds) -> DataFrame:
    return _judged(f).select("city", "zone_id", "confidence")


@query("h11_rule_based_reason", "SELECT city, zone_id, array_to_string(evidence_factors, '|') AS factors, reason FROM zreason")
def _(f: Feeds) -> DataFrame:
    return _judged(f).select("city", "zone_id", F.array_join("evidence_factors", "|").alias("factors"), "reason")


@query("h12_attribute", f"SELECT city, zone_id, unnest(cells) AS cell, ward_id, {ts('ts')} AS ts, {rnd('pm25_hat', 1)} AS pm25_estimate, primary_source, confidence, reason, 'rules' AS explained_by FROM zreason")
def _(f: Feeds) -> DataFrame:
    a = attribution.attribute(f.hot, f.panel, f.field, f.osm, f.reports, 100, GRID, 8)
    return a.select("city", "zone_id", "cell", "ward_id", text_ts("ts").alias("ts"), "pm25_estimate", "primary_source", "confidence", "reason", "explained_by")


@query("h13_attribution_summary", "SELECT city, primary_source, explained_by, n, n_diffuse FROM (SELECT city, primary_source, explained_by, count(*) AS n FROM named GROUP BY ALL) FULL JOIN (SELECT city, count(*) FILTER (WHERE NOT attributable) AS n_diffuse FROM hot GROUP BY ALL) USING (city)")
def _(f: Feeds) -> DataFrame:
    return attribution.attribution_summary(f.named, f.hot)


# ----------------------------------------------------------------- M exposure


@query("m1_city_baseline", f"SELECT city, {ts('ts')} AS ts, {sfx('baseline')} AS baseline FROM baseline")
def _(f: Feeds) -> DataFrame:
    return exposure.city_baseline(f.labelled).select("city", text_ts("ts").alias("ts"), fx("baseline").alias("baseline"))


@query("m2_residual_target", f"SELECT city, cell, {ts('ts')} AS ts, {sfx('pm25_station - baseline')} AS resid FROM lab JOIN baseline USING (city, ts)")
def _(f: Feeds) -> DataFrame:
    r = exposure.residual_target(f.labelled, exposure.city_baseline(f.labelled))
    return r.select("city", "cell", text_ts("ts").alias("ts"), fx("resid").alias("resid"))


def _field_model(f: Feeds):
    lab = materialise(exposure.labelled(f.panel))
    return exposure.fit_field(lab)


@query("m3_fit_predict_field")
def _(f: Feeds) -> DataFrame:
    model, baseline = _field_model(f)
    hat = exposure.predict_field(model, f.panel, baseline)
    return hat.groupBy("city", "cell").agg(F.count("pm25_hat").alias("n"), F.median("pm25_hat").alias("med_hat"))


@query("m4_station_holdout")
def _(f: Feeds) -> DataFrame:
    return exposure.holdout_validation(f.panel, folds=3)


@query("m5_naive_citymean_loso", f"""SELECT city, count(*) AS n, {sfx('sqrt(avg(power(pm25_station - (s - pm25_station) / (k - 1), 2)))')} AS naive_citymean_rmse FROM lab JOIN (SELECT city, ts, sum(pm25_station) AS s, count(*) AS k FROM lab GROUP BY ALL) USING (city, ts) WHERE k > 1 GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    return exposure.naive_citymean_loso(f.labelled).withColumn("naive_citymean_rmse", fx("naive_citymean_rmse"))


@query("m6_feature_importance")
def _(f: Feeds) -> DataFrame:
    model, _ = _field_model(f)
    return exposure.feature_importance(f.spark, model, top=5)


@query("m7_field_snapshot", f"SELECT city, {ts('ts')} AS ts, cell, coalesce(ward_id, 'unassigned') AS ward_id, {rnd('pm25_hat', 1)} AS pm25 FROM field_now LEFT JOIN wards USING (city, cell)")
def _(f: Feeds) -> DataFrame:
    return exposure.field_snapshot(f.field, f.wards).withColumn("ts", text_ts("ts"))


# ----------------------------------------------------------------- N forecast

_H = forecast.HORIZONS


def _roll(n: int, least: int) -> str:
    over = f"OVER (PARTITION BY city, cell ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(pm25_station) {over} >= {least} THEN {med_of(f'list_sort(list(pm25_station) {over})')} END"


cte("origin", f"""SELECT *, pm25_station AS lag_0, {', '.join(f'lag(pm25_station, {k}) OVER w AS lag_{k}' for k in (1, 3, 6, 24))}, {_roll(24, 6)} AS roll_med_24, {_roll(168, 24)} AS roll_med_168,
  [{', '.join(f'lead(pm25_station, {h}) OVER w' for h in _H)}] AS ahead FROM lab WINDOW w AS (PARTITION BY city, cell ORDER BY ts)""")
cte("sup", f"""SELECT *, ahead[horizon // 3] AS y, hour(ts + to_hours(horizon))::INTEGER AS target_hour, (isodow(ts + to_hours(horizon)) - 1)::INTEGER AS target_dow
  FROM origin, (SELECT unnest(generate_series(3, 72, 3))::INTEGER AS horizon) WHERE lag_24 IS NOT NULL AND roll_med_24 IS NOT NULL AND ahead[horizon // 3] IS NOT NULL""")
cte("split", "SELECT city, max(ts) - INTERVAL 14 DAY AS edge FROM lab GROUP BY ALL")
cte("clim", f"SELECT city, cell, (isodow(ts) - 1) * 24 + hour(ts) AS how, {med('pm25_station')} AS clim FROM lab JOIN split USING (city) WHERE ts <= edge GROUP BY ALL")
cte("evalset", """SELECT s.*, s.ts > edge AS is_test, s.lag_0 AS persistence, coalesce(c.clim, s.roll_med_168) AS diurnal FROM sup s JOIN split USING (city)
  LEFT JOIN clim c ON c.city = s.city AND c.cell = s.cell AND c.how = (isodow(s.ts) - 1) * 24 + hour(s.ts)""")


@query("n1_supervised", f"SELECT city, cell, {ts('ts')} AS ts, {sfx('lag_24')} AS lag_24, {sfx('roll_med_24')} AS roll_med_24, {sfx('roll_med_168')} AS roll_med_168, target_hour, target_dow, horizon, {sfx('y')} AS y, lu_road FROM sup WHERE horizon = 24")
def _(f: Feeds) -> DataFrame:
    s = forecast.supervised(f.labelled, "pm25_station", 24)
    return s.select("city", "cell", text_ts("ts").alias("ts"), fx("lag_24").alias("lag_24"), fx("roll_med_24").alias("roll_med_24"), fx("roll_med_168").alias("roll_med_168"), "target_hour", "target_dow", "horizon", fx("y").alias("y"), "lu_road")


cte("hourly_lag", """SELECT a.city, a.cell, a.ts, b.pm25_station AS lag_3h, c.pm25_station AS y_6h FROM lab a LEFT JOIN lab b ON b.city = a.city AND b.cell = a.cell AND b.ts = a.ts - INTERVAL 3 HOUR
  LEFT JOIN lab c ON c.city = a.city AND c.cell = a.cell AND c.ts = a.ts + INTERVAL 6 HOUR""")


@query("n1_hour_lags", f"SELECT city, cell, {ts('ts')} AS ts, {sfx('lag_3h')} AS lag_3h, {sfx('y_6h')} AS y_6h FROM hourly_lag")
def _(f: Feeds) -> DataFrame:
    base = forecast.origin_features(f.labelled, "pm25_station", "hours")
    t = forecast._targets(base, "pm25_station", [6], "hours", False)
    return t.select("city", "cell", text_ts("ts").alias("ts"), fx("lag_3").alias("lag_3h"), fx("y").alias("y_6h"))


@query("n2_pooled", f"SELECT city, cell, horizon, count(*) AS n, {sfx(med('y'))} AS med_y, {sfx(med('lag_6'))} AS med_lag_6, min(target_hour) AS lo_hour, max(target_dow) AS hi_dow FROM sup GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    p = forecast.pooled(f.labelled)
    return p.groupBy("city", "cell", "horizon").agg(
        F.count("*").alias("n"), fx(F.median("y")).alias("med_y"), fx(F.median("lag_6")).alias("med_lag_6"), F.min("target_hour").alias("lo_hour"), F.max("target_dow").alias("hi_dow")
    )


@query("n4_diurnal_climatology", f"SELECT city, cell, how::INTEGER AS how, {sfx('clim')} AS clim FROM clim")
def _(f: Feeds) -> DataFrame:
    split = forecast.time_holdout(f.labelled)
    return forecast.diurnal_climatology(split.where(~F.col("is_test"))).withColumn("clim", fx("clim"))


@query("n5_time_holdout", f"SELECT city, ts > edge AS is_test, count(*) AS n, {ts('min(ts)')} AS first_ts, {ts('max(ts)')} AS last_ts FROM lab JOIN split USING (city) GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return forecast.time_holdout(f.labelled).groupBy("city", "is_test").agg(
        F.count("*").alias("n"), text_ts(F.min("ts")).alias("first_ts"), text_ts(F.max("ts")).alias("last_ts")
    )


@query("n6_baseline_scores", f"""SELECT c.city, h.horizon, coalesce(n_test, 0) AS n_test, {rnd('rp', 2)} AS rmse_persistence, {rnd('rd', 2)} AS rmse_diurnal, CASE WHEN n_test IS NULL THEN 'insufficient data' END AS note
  FROM (SELECT DISTINCT city FROM lab) c CROSS JOIN (SELECT unnest(generate_series(3, 72, 3))::INTEGER AS horizon) h LEFT JOIN (SELECT city, horizon, count(*) AS n_test, sqrt(avg((y - persistence) * (y - persistence))) AS rp, sqrt(avg((y - diurnal) * (y - diurnal))) AS rd
    FROM evalset WHERE is_test GROUP BY ALL) USING (city, horizon)""")
def _(f: Feeds) -> DataFrame:
    test = forecast.evaluation_frame(f.labelled).where("is_test")
    return forecast.complete_horizons(forecast.score_forecast(test), f.labelled.select("city"))


@query("n6_forecast_eval")
def _(f: Feeds) -> DataFrame:
    return forecast.forecast_eval(f.labelled)


@query("n7_oracle_met")
def _(f: Feeds) -> DataFrame:
    return forecast.forecast_eval(f.labelled, oracle_met=True)


@query("n8_forecast_field")
def _(f: Feeds) -> DataFrame:
    train = materialise(forecast.pooled(f.labelled))
    model, cols = forecast.fit_forecast(train)
    return forecast.forecast_field(f.panel, f.field, model, cols)


cte("series", "SELECT f.city, f.cell, f.ts, coalesce(l.pm25_station, f.pm25_hat) AS v, row_number() OVER (PARTITION BY f.city, f.cell ORDER BY f.ts DESC) AS n FROM field f LEFT JOIN lab l USING (city, cell, ts)")


@query("n8_latest_features", f"""SELECT city, cell, {', '.join(f'{sfx(f"max(v) FILTER (WHERE n = {k + 1})")} AS lag_{k}' for k in (0, 1, 3, 6, 24))}, {sfx(med('v', 'n BETWEEN 2 AND 25'))} AS roll_med_24, {sfx(med('v', 'n BETWEEN 2 AND 169'))} AS roll_med_168
  FROM series GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    s = forecast.forecast_series(f.panel, f.field)
    cols = ["lag_0", "lag_1", "lag_3", "lag_6", "lag_24", "roll_med_24", "roll_med_168"]
    return forecast.latest_features(s).select("city", "cell", *[fx(c).alias(c) for c in cols])


cte("ward_fc", f"SELECT city, ward_id, horizon_h, {rnd(med('pm25_hat'), 1)} AS pm25_hat, count(*) AS n_cells FROM forecast JOIN wards USING (city, cell) WHERE ward_id <> 'unassigned' GROUP BY ALL")


@query("n9_ward_forecast", "SELECT * FROM ward_fc")
def _(f: Feeds) -> DataFrame:
    return forecast.ward_forecast(f.forecast, f.wards)


@query("n10_horizon_filter", "SELECT * FROM forecast WHERE horizon_h = 48")
def _(f: Feeds) -> DataFrame:
    return forecast.horizon_filter(f.forecast, 48)


def _cat(x: str) -> str:
    return f"CASE WHEN {x} <= 50 THEN 'Good' WHEN {x} <= 100 THEN 'Satisfactory' WHEN {x} <= 200 THEN 'Moderate' WHEN {x} <= 300 THEN 'Poor' WHEN {x} <= 400 THEN 'Very Poor' ELSE 'Severe' END"


@query("n11_best_worst_hour", f"""SELECT city, ward_id, best_h, best_aqi, {_cat('best_aqi')} AS best_band, worst_h, worst_aqi, {_cat('worst_aqi')} AS worst_band FROM (SELECT city, ward_id, min_by(horizon_h, (a, horizon_h)) AS best_h, min(a) AS best_aqi,
  min_by(horizon_h, (-a, horizon_h)) AS worst_h, max(a) AS worst_aqi FROM (SELECT *, {aqi('pm25_hat')} AS a FROM ward_fc) GROUP BY ALL HAVING count(*) >= 2)""")
def _(f: Feeds) -> DataFrame:
    return forecast.best_worst_hour(forecast.ward_forecast(f.forecast, f.wards))


@query("all_stages_by_city")
def _(f: Feeds) -> DataFrame:
    """The whole chain over the raw feeds; one row per city and published table."""
    from hazegrid.plans.city_run import run

    raw = {
        "cities": f.cities, "polygons": f.polygons, "stations": f.stations.drop("cell"), "weather": f.weather, "satellite": f.satellite,
        "fires": f.fires, "osm": f.osm, "reports": f.reports, "status": f.status_updates,
    }
    tables = run(raw, "2024-02-01 06:00:00", GRID)
    out = None
    for name, df in tables.items():
        part = df.groupBy("city").agg(F.count("*").alias("n")).select("city", F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    return out
