"""SQL fragments and shared CTEs of the twins, in DuckDB's dialect.

``build`` prefixes a body with exactly the CTEs it refers to.
"""

from __future__ import annotations

import re

from hazegrid.functions.geo import _BIAS, _ROOT3, _SHIFT, EARTH_RADIUS_KM, KM_PER_DEGREE, offsets
from hazegrid.operators.clean import REPORT_CATEGORIES, REPORT_SOURCES, REPORT_STATUSES
from workload.feeds import EPOCH_HOUR, GRID, HOT_THRESH, OSM_KINDS

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def build(body: str) -> str:
    order: list[str] = []

    def visit(text: str, path: tuple[str, ...] = ()) -> None:
        for word in sorted(set(re.findall(r"\b[a-z_][a-z0-9_]*\b", text))):
            if word in CTES and word not in order and word not in path:
                visit(CTES[word], (*path, word))
                order.append(word)

    visit(body)
    parts = [f"{n} AS ({CTES[n]})" for n in order]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body.strip()


def d(x: float) -> str:
    """A double literal (a bare decimal point would be an exact decimal)."""
    r = repr(float(x))
    return r if "e" in r or "inf" in r else r + "e0"


def rnd(x: str, n: int) -> str:
    s = d(10**n)
    return f"(round_even(({x}) * {s}, 0) / {s})"


def fx(x: str, n: int = 6) -> str:
    s = d(10**n)
    return f"(floor(({x}) * {s} + 0.501e0) / {s})"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def lst(x: str, where: str = "TRUE") -> str:
    return f"list_sort(list({x}) FILTER (WHERE ({x}) IS NOT NULL AND ({where})))"


def med_of(sorted_list: str) -> str:
    n = f"len({sorted_list})"
    return f"(CASE WHEN {n} > 0 THEN {sorted_list}[({n} - 1) // 2 + 1] * 0.5e0 + {sorted_list}[{n} // 2 + 1] * 0.5e0 END)"


def med(x: str, where: str = "TRUE") -> str:
    """Median with the same two-term interpolation the Spark side uses."""
    return med_of(lst(x, where))


def quant(x: str, p: float, where: str = "TRUE") -> str:
    v = lst(x, where)
    pos = f"((len({v}) - 1) * {d(p)})"
    return (
        f"(CASE WHEN {pos} = floor({pos}) THEN {v}[floor({pos})::BIGINT + 1] ELSE "
        f"(ceil({pos}) - {pos}) * {v}[floor({pos})::BIGINT + 1] + ({pos} - floor({pos})) * {v}[ceil({pos})::BIGINT + 1] END)"
    )


def lat_of(k: str) -> str:
    return f"(28.45e0 + 0.01e0 * (({k}) % 30))"


def lon_of(k: str) -> str:
    return f"(76.95e0 + 0.01e0 * ((({k}) // 30) % 40))"


def row_of(lat: str) -> str:
    return f"least(4, greatest(0, floor(({lat} - 28.45e0) / 0.06e0)))::INTEGER"


def hav(a: str, b: str, c: str, e: str) -> str:
    x = (
        f"sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * "
        f"sin(radians({e} - {b}) / 2) * sin(radians({e} - {b}) / 2)"
    )
    return f"(asin(sqrt(CASE WHEN {x} > 1 THEN 1e0 ELSE {x} END)) * {d(2 * EARTH_RADIUS_KM)})"


def bearing(a: str, b: str, c: str, e: str) -> str:
    east = f"sin(radians({e} - {b})) * cos(radians({c}))"
    north = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({e} - {b}))"
    return f"((degrees(atan2({east}, {north})) + 360e0) % 360e0)"


def align(bear: str, wind: str) -> str:
    return f"greatest(0e0, cos(radians((({wind}) + 180e0) % 360e0 - {bear})))"


def pmod360(x: str) -> str:
    return f"(CASE WHEN ({x}) % 360e0 < 0 THEN ({x}) % 360e0 + 360e0 ELSE ({x}) % 360e0 END)"


def stamp(lat: str, lon: str, rel: str, extra: str = "*") -> str:
    """SELECT ``extra`` plus cell from a relation, by cube rounding of the projected point."""
    kx = d(GRID.km_per_lon)
    return f"""SELECT {extra}, (CASE WHEN _eq > _er AND _eq > _es THEN -_rr - _rs ELSE _rq END)::BIGINT * 1 AS _q,
      (CASE WHEN NOT (_eq > _er AND _eq > _es) AND _er > _es THEN -_rq - _rs ELSE _rr END)::BIGINT AS _r,
      (_q + {_BIAS}) * {_SHIFT} + (_r + {_BIAS}) AS cell
    FROM (SELECT *, floor(_fq + 0.5e0) AS _rq, floor(_fr + 0.5e0) AS _rr, floor(-_fq - _fr + 0.5e0) AS _rs,
        abs(_rq - _fq) AS _eq, abs(_rr - _fr) AS _er, abs(_rs - (-_fq - _fr)) AS _es
      FROM (SELECT *, (({lon} * {kx}) * {d(_ROOT3 / 3)} - ({lat} * {d(KM_PER_DEGREE)}) * {d(1 / 3)}) / {d(GRID.edge_km)} AS _fq,
          (({lat} * {d(KM_PER_DEGREE)}) * {d(2 / 3)}) / {d(GRID.edge_km)} AS _fr FROM {rel}))"""


def q_of(cell: str) -> str:
    return f"({cell} // {_SHIFT} - {_BIAS})"


def r_of(cell: str) -> str:
    return f"({cell} % {_SHIFT} - {_BIAS})"


def lat_c(cell: str) -> str:
    return f"({r_of(cell)} * {d(1.5 * GRID.edge_km)} / {d(KM_PER_DEGREE)})"


def lon_c(cell: str) -> str:
    return f"((({q_of(cell)} * {d(_ROOT3)} + {r_of(cell)} * {d(_ROOT3 / 2)}) * {d(GRID.edge_km)}) / {d(GRID.km_per_lon)})"


def offset_rows(lo: int, hi: int) -> str:
    rows = ", ".join(f"({o.delta}, {o.ring}, {d(o.dist_km)}, {d(o.bearing)})" for o in offsets(lo, hi, GRID))
    return f"SELECT * FROM (VALUES {rows}) t(delta, ring, km, bear)"


def pick(values: list[str], i: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({i}) + 1]"


def aqi(x: str) -> str:
    from hazegrid.functions.aqi import BREAKPOINTS

    arms = " ".join(
        f"WHEN {x} <= {hi} THEN round_even(({x} - {lo}) * {d(i1 - i0)} / {d(hi - lo)} + {d(i0)}, 0)::INTEGER"
        for lo, hi, i0, i1, _ in BREAKPOINTS
    )
    return f"(CASE WHEN {x} IS NULL THEN 500 WHEN {x} <= 0 THEN 0 {arms} ELSE 500 END)"


def band(x: str) -> str:
    from hazegrid.functions.aqi import BREAKPOINTS

    arms = " ".join(f"WHEN {x} <= {hi} THEN '{b}'" for _, hi, _, _, b in BREAKPOINTS)
    return f"(CASE WHEN {x} IS NULL THEN 'Severe' WHEN {x} <= 0 THEN 'Good' {arms} ELSE 'Severe' END)"


# --------------------------------------------------------------------- feeds

cte("cities", """SELECT r_name AS city, r_regionkey AS row_no, 28.45e0 + 0.06e0 * r_regionkey AS lat_min,
  28.45e0 + 0.06e0 * (r_regionkey + 1) AS lat_max, 76.95e0 AS lon_min, 77.35e0 AS lon_max FROM region""")
cte("ev_c", f"""SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, {lat_of('e.user_id')} AS lat, {lon_of('e.user_id')} AS lon,
  r.r_name AS city FROM events e JOIN region r ON r.r_regionkey = {row_of(lat_of('e.user_id'))}""")
cte("stations", "SELECT city, 'ST_' || user_id AS station_id, cell, ts, lat, lon, value AS pm25, event_type, event_id FROM ("
    + stamp("lat", "lon", "ev_c") + ")")
cte("weather", f"""SELECT r_name AS city, ts, ((37 * h) % 360)::DOUBLE AS wind_from_deg, (1 + h % 5)::DOUBLE AS wind_ms,
  (200 + 50 * (h % 24))::DOUBLE AS blh_m, (15 + h % 20)::DOUBLE AS temp_c
  FROM region, (SELECT DISTINCT date_trunc('hour', ts) AS ts, floor(epoch(date_trunc('hour', ts)) / 3600)::BIGINT - {EPOCH_HOUR} AS h FROM events)""")
cte("fires", """SELECT city, ts, lat + 0.001e0 * (event_id % 7) AS lat, lon, value AS frp,
  CASE event_id % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'n' ELSE 'h' END AS confidence FROM ev_c WHERE event_type = 'error'""")
cte("foot", offset_rows(0, 2))
cte("satellite", """SELECT city, cell + delta AS cell, ts::DATE AS date,
  CASE WHEN max(event_id) % 6 <> 0 THEN avg(pm25) * 1.0037e0 END AS no2_col,
  CASE WHEN max(event_id) % 6 <> 0 THEN min(pm25) - 20e0 END AS so2_col,
  CASE WHEN max(event_id) % 6 <> 0 THEN max(pm25) / 100e0 END AS aai
  FROM stations, foot WHERE event_type = 'view' GROUP BY ALL""")
cte("osm_raw", f"""SELECT s_name AS name, s_suppkey AS k FROM supplier UNION ALL SELECT p_name, p_partkey FROM part""")
cte("osm", f"""SELECT r_name AS city, name, {pick(OSM_KINDS, 'k % 7')} AS kind, 'k=' || kind AS tag, {lat_of('k * 7')} AS lat, {lon_of('k * 7')} AS lon
  FROM osm_raw JOIN region ON r_regionkey = {row_of(lat_of('k * 7'))}""")
_R0, _R1 = int(28.4 * KM_PER_DEGREE / (1.5 * GRID.edge_km)), int(28.8 * KM_PER_DEGREE / (1.5 * GRID.edge_km))
_STEP = GRID.edge_km * _ROOT3 / GRID.km_per_lon
_Q0, _Q1 = int(76.9 / _STEP - _R1 / 2) - 2, int(77.4 / _STEP - _R0 / 2) + 2
cte("cells", f"""SELECT city, (q + {_BIAS}) * {_SHIFT} + (r + {_BIAS}) AS cell, c_lat AS lat, c_lon AS lon FROM (
  SELECT q, r, r * {d(1.5 * GRID.edge_km)} / {d(KM_PER_DEGREE)} AS c_lat,
    ((q * {d(_ROOT3)} + r * {d(_ROOT3 / 2)}) * {d(GRID.edge_km)}) / {d(GRID.km_per_lon)} AS c_lon
  FROM (SELECT unnest(generate_series({_Q0}::BIGINT, {_Q1}::BIGINT)) AS q), (SELECT unnest(generate_series({_R0}::BIGINT, {_R1}::BIGINT)) AS r)), cities
  WHERE c_lat >= lat_min AND c_lat < lat_max AND c_lon >= lon_min AND c_lon < lon_max""")
cte("poly", """SELECT r_name AS city, n_nationkey AS pos, n_name, 76.95e0 + 0.08e0 * (n_nationkey // 5) AS x0, 28.45e0 + 0.06e0 * (n_nationkey % 5) AS y0
  FROM nation JOIN region ON r_regionkey = n_nationkey % 5""")
cte("ring_pts", """SELECT city, pos, 0 AS ring, i, x0 + [0.0e0, 0.08e0, 0.08e0, 0.0e0, 0.0e0][i] AS x, y0 + [0.0e0, 0.0e0, 0.06e0, 0.06e0, 0.0e0][i] AS y
    FROM poly, (SELECT unnest([1, 2, 3, 4, 5]) AS i)
  UNION ALL SELECT city, pos, 1, i, x0 + [0.01e0, 0.05e0, 0.05e0, 0.01e0, 0.01e0][i], y0 + [0.015e0, 0.015e0, 0.045e0, 0.045e0, 0.015e0][i]
    FROM poly, (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE pos = 12""")
cte("edges", """SELECT a.city, a.pos, a.ring, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj
  FROM ring_pts a JOIN ring_pts b ON a.pos = b.pos AND a.ring = b.ring AND a.i = b.i + 1""")
cte("inside", """SELECT city, cell, pos FROM (SELECT c.city, c.cell, e.pos, e.ring,
    count(*) FILTER (WHERE (yi > lat) <> (yj > lat) AND lon < xi + (lat - yi) * (xj - xi) / nullif(yj - yi, 0)) % 2 AS odd
    FROM cells c JOIN edges e ON e.city = c.city GROUP BY ALL)
  GROUP BY ALL HAVING max(CASE WHEN ring = 0 THEN odd ELSE 0 END) = 1 AND max(CASE WHEN ring = 1 THEN odd ELSE 0 END) = 0""")
cte("ward_names", """SELECT pos, 'W' || lpad((pos + 1)::VARCHAR, 3, '0') AS ward_id, CASE pos % 4 WHEN 0 THEN n_name
    WHEN 1 THEN 'Ward ' || pos || ' (' || upper(n_name[1]) || lower(n_name[2:]) || ')' WHEN 2 THEN 'Ward ' || pos
    ELSE 'Ward ' || lpad((pos + 1)::VARCHAR, 3, '0') END AS ward_name FROM poly""")
cte("wards", """SELECT c.city, c.cell, coalesce(w.ward_id, 'unassigned') AS ward_id, coalesce(w.ward_name, 'Outside city limits') AS ward_name
  FROM cells c LEFT JOIN (SELECT city, cell, min(pos) AS pos FROM inside GROUP BY ALL) i USING (city, cell) LEFT JOIN ward_names w USING (pos)""")
cte("reports", f"""SELECT r_name AS city, o_orderkey::VARCHAR AS id, TIMESTAMP '2024-01-01' + to_days((date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 30)::INTEGER)
    + to_hours(o_orderkey % 24) AS ts,
  CASE WHEN o_orderkey % 11 = 5 THEN 'unassigned' WHEN o_orderkey % 97 = 13 THEN NULL
    WHEN o_orderkey % 7 = 3 THEN ' nation_' || (o_custkey % 25) || ' ' ELSE 'W' || lpad((o_custkey % 25 + 1)::VARCHAR, 3, '0') END AS ward_id,
  {pick(REPORT_CATEGORIES, 'o_orderkey % 5')} AS category, {lat_of('o_custkey')} AS lat, {lon_of('o_custkey')} AS lon,
  CASE WHEN o_orderkey % 89 = 0 THEN 'fax' WHEN o_orderkey % 13 = 0 THEN NULL ELSE {pick(REPORT_SOURCES, 'o_orderkey % 3')} END AS source,
  CASE WHEN o_orderkey % 83 = 0 THEN 'lost' WHEN o_orderkey % 17 = 0 THEN NULL ELSE {pick(REPORT_STATUSES, 'o_orderkey % 5')} END AS status
  FROM orders JOIN region ON r_regionkey = {row_of(lat_of('o_custkey'))}""")
cte("status_updates", f"""SELECT r_name AS city, 'A' || lpad((o_orderkey % 40 + 1)::VARCHAR, 2, '0') AS action_id, o_orderdate AS dispatched_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_hours(o_orderkey % 96) END AS actioned_at,
  CASE WHEN o_orderstatus <> 'O' THEN 'actioned' ELSE 'dispatched' END AS status, o_orderdate + to_hours(1) AS updated_at
  FROM orders JOIN region ON r_regionkey = {row_of(lat_of('o_custkey'))}""")
cte("status_now", """SELECT * FROM status_updates QUALIFY row_number() OVER (PARTITION BY city, action_id
  ORDER BY updated_at DESC, dispatched_at DESC, actioned_at DESC NULLS LAST) = 1""")

# -------------------------------------------------------------------- stages

cte("hours", """SELECT DISTINCT s.city, date_trunc('hour', s.ts) AS ts FROM stations s JOIN weather w ON w.city = s.city AND w.ts = date_trunc('hour', s.ts)""")
cte("axis", "SELECT city, ts, row_number() OVER (PARTITION BY city ORDER BY ts) AS idx FROM hours")
cte("labels", "SELECT city, cell, date_trunc('hour', ts) AS ts, avg(pm25) AS pm25_station FROM stations GROUP BY ALL")
cte("fire_near", f"""SELECT f.city, c.cell, date_trunc('hour', f.ts) AS ts, f.frp FROM fires f JOIN cells c ON c.city = f.city
  AND abs(c.lat - f.lat) < 0.02e0 AND abs(c.lon - f.lon) < 0.02e0 WHERE {hav('c.lat', 'c.lon', 'f.lat', 'f.lon')} <= 1.5e0""")
cte("fire_feat", """SELECT city, cell, t.ts, count(*)::INTEGER AS fires_6h, sum(frp) AS frp_6h FROM fire_near n JOIN axis a USING (city, ts)
  JOIN axis t USING (city) WHERE t.idx BETWEEN a.idx AND a.idx + 5 GROUP BY ALL""")
cte("landuse", f"""SELECT c.city, c.cell, {', '.join(f"count(*) FILTER (WHERE kind = '{k}')::INTEGER AS lu_{k}" for k in OSM_KINDS[:5])},
  count(*) FILTER (WHERE kind IN ('school', 'hospital'))::INTEGER AS lu_sensitive FROM cells c LEFT JOIN (SELECT c.city, c.cell, o.kind FROM cells c
  JOIN osm o ON o.city = c.city AND abs(c.lat - o.lat) < 0.02e0 AND abs(c.lon - o.lon) < 0.02e0 WHERE {hav('c.lat', 'c.lon', 'o.lat', 'o.lon')} <= 1.5e0) USING (city, cell) GROUP BY ALL""")
cte("cell_days", "SELECT c.city, c.cell, h.date FROM cells c JOIN (SELECT DISTINCT city, ts::DATE AS date FROM hours) h USING (city)")
_fill = ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY city, cell ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"first_value({c} IGNORE NULLS) OVER (PARTITION BY city, cell ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
    for c in ("no2_col", "so2_col", "aai")
)
cte("sat_full", f"SELECT city, cell, date, {_fill} FROM cell_days LEFT JOIN satellite USING (city, cell, date)")
cte("panel", """SELECT c.city, c.cell, h.ts, l.pm25_station, w.wind_from_deg, w.wind_ms, w.blh_m, w.temp_c, s.no2_col, s.so2_col, s.aai,
  coalesce(f.fires_6h, 0) AS fires_6h, coalesce(f.frp_6h, 0) AS frp_6h, u.lu_industrial, u.lu_construction, u.lu_waste_burning, u.lu_traffic,
  u.lu_road, u.lu_sensitive, d.ward_id, d.ward_name, hour(h.ts)::INTEGER AS hour, (isodow(h.ts) - 1)::INTEGER AS dow, h.ts::DATE AS date
  FROM cells c JOIN hours h USING (city) JOIN weather w ON w.city = c.city AND w.ts = h.ts LEFT JOIN labels l ON l.city = c.city AND l.cell = c.cell AND l.ts = h.ts
  LEFT JOIN sat_full s ON s.city = c.city AND s.cell = c.cell AND s.date = h.ts::DATE LEFT JOIN fire_feat f ON f.city = c.city AND f.cell = c.cell AND f.ts = h.ts
  JOIN landuse u ON u.city = c.city AND u.cell = c.cell JOIN wards d ON d.city = c.city AND d.cell = c.cell""")
cte("lab", """SELECT l.*, w.wind_from_deg, w.wind_ms, w.blh_m, w.temp_c, u.* EXCLUDE (city, cell) FROM labels l
  LEFT JOIN weather w ON w.city = l.city AND w.ts = l.ts JOIN landuse u ON u.city = l.city AND u.cell = l.cell""")
cte("baseline", f"SELECT city, ts, {med('pm25_station')} AS baseline FROM lab GROUP BY ALL")
cte("field", "SELECT c.city, c.cell, b.ts, b.baseline + (c.cell % 23) AS pm25_hat FROM cells c JOIN baseline b USING (city)")
cte("field_at", "SELECT city, max(ts) AS now_ts FROM baseline GROUP BY ALL")
cte("field_now", "SELECT f.city, f.cell, f.ts, f.pm25_hat FROM field f JOIN field_at a ON a.city = f.city AND f.ts = a.now_ts")
cte("forecast", f"""SELECT city, cell, h::INTEGER AS horizon_h, {rnd('pm25_hat + h * (cell % 7 - 3) * 0.3e0', 1)} AS pm25_hat,
  (pm25_hat + h * (cell % 7 - 3) * 0.3e0) - pm25_hat >= 20e0 AS urgency FROM field_now, (SELECT unnest(generate_series(3, 72, 3)) AS h)""")

WINDOWS = {"w24h": 24, "w7d": 168, "w30d": 720}


def robust(rel: str, col: str, out: str) -> str:
    """SELECT * plus a robust z of ``col`` within city."""
    return f"""SELECT r.*, CASE WHEN r.{col} IS NULL THEN NULL ELSE coalesce((r.{col} - g.m) / CASE WHEN 1.4826e0 * g.mad >= 1e-9 THEN 1.4826e0 * g.mad
      WHEN g.sd >= 1e-9 THEN g.sd END, 0e0) END AS {out} FROM ({rel}) r LEFT JOIN (
      SELECT city, any_value(m) AS m, {med(f'abs({col} - m)')} AS mad, any_value(sd) AS sd FROM ({rel}) a JOIN (
        SELECT city, {med(col)} AS m, stddev_pop({col}) AS sd FROM ({rel}) b GROUP BY ALL) USING (city) GROUP BY city) g USING (city)"""


cte("station_at", "SELECT city, max(ts) AS now_ts FROM labels GROUP BY ALL")
cte("wmed", f"""SELECT l.city, l.cell, {', '.join(f"{med('pm25_station', f'ts > now_ts - INTERVAL {h} HOUR')} AS {w}" for w, h in WINDOWS.items())}
  FROM labels l JOIN station_at USING (city) WHERE ts > now_ts - INTERVAL 720 HOUR AND ts <= now_ts GROUP BY ALL""")
cte("wz1", robust("SELECT * FROM wmed", "w24h", "z_w24h"))
cte("wz2", robust("SELECT * FROM wz1", "w7d", "z_w7d"))
cte("wz", robust("SELECT * FROM wz2", "w30d", "z_w30d"))
KIND = "CASE WHEN z_w30d >= {t} THEN 'chronic' WHEN z_w7d >= {t} THEN 'emerging' WHEN z_w24h >= {t} THEN 'acute' ELSE 'none' END"
cte("hot_raw", f"""SELECT z.city, z.cell, coalesce(z_w24h, 0) AS z_w24h, coalesce(z_w7d, 0) AS z_w7d, coalesce(z_w30d, 0) AS z_w30d, w30d AS pm25_med,
  {KIND.format(t=d(HOT_THRESH))} AS kind, c.lat, c.lon, a.now_ts AS ts, coalesce(f.fires_6h, 0) AS fires_6h, (z.cell % 3 = 0)::INTEGER::DOUBLE AS c_fire
  FROM wz z JOIN cells c USING (city, cell) JOIN station_at a USING (city) LEFT JOIN fire_feat f ON f.city = z.city AND f.cell = z.cell AND f.ts = a.now_ts
  WHERE kind <> 'none'""")
cte("near_cand", f"""SELECT h.city, h.cell, min({hav('h.lat', 'h.lon', 'o.lat', 'o.lon')}) AS km FROM hot_raw h JOIN osm o USING (city)
  WHERE o.kind IN ('industrial', 'construction', 'waste_burning') GROUP BY ALL""")
cte("hot_mark", f"""SELECT h.*, coalesce({rnd('n.km', 2)}, 999e0) AS nearest_candidate_km,
  coalesce({rnd('n.km', 2)}, 999e0) <= 0.3e0 OR c_fire > 0 AS attr_cell,
  'B_' || floor({q_of('h.cell')} / 4)::BIGINT || '_' || floor({r_of('h.cell')} / 4)::BIGINT AS zone_id FROM hot_raw h LEFT JOIN near_cand n USING (city, cell)""")
RANK = "CASE {k} WHEN 'chronic' THEN 3 WHEN 'emerging' THEN 2 WHEN 'acute' THEN 1 ELSE 0 END"


def share(x: str, full: float) -> str:
    return f"least(greatest(({x}) / {d(full)}, 0e0), 1e0)"


SEVERITY = rnd(
    f"{share('greatest(z_w24h, z_w7d, z_w30d)', 6)} * 0.45e0 + {share('pm25_med', 120)} * 0.35e0 + "
    "CASE kind WHEN 'chronic' THEN 1e0 WHEN 'emerging' THEN 0.6e0 WHEN 'acute' THEN 0.35e0 ELSE 0e0 END * 0.20e0", 3
)
BASIS = (
    f"printf('satellite contrast z=%.1f vs surrounding 4-8 km', {rnd('greatest(z_w24h, z_w7d, z_w30d)', 1)}) || "
    "CASE WHEN fires_6h > 0 THEN '; ' || fires_6h || ' FIRMS detections in last 6 h' ELSE '' END"
)
cte("hot_zoned", f"""SELECT city, cell, zone_id, kind AS cell_kind, ['none', 'acute', 'emerging', 'chronic'][max({RANK.format(k='kind')}) OVER z + 1] AS kind2,
  bool_or(attr_cell) OVER z AS attributable, pm25_med, nearest_candidate_km, z_w24h, z_w7d, z_w30d, fires_6h, ts FROM hot_mark WINDOW z AS (PARTITION BY city, zone_id)""")
cte("hot", f"""SELECT city, cell, ward_id, ward_name, zone_id, kind, cell_kind, attributable, {SEVERITY} AS severity, {rnd('pm25_med', 2)} AS pm25_med,
  nearest_candidate_km, {rnd('z_w24h', 2)} AS z_w24h, {rnd('z_w7d', 2)} AS z_w7d, {rnd('z_w30d', 2)} AS z_w30d, fires_6h, {BASIS} AS detection_basis, ts
  FROM (SELECT * EXCLUDE (kind2), kind2 AS kind FROM hot_zoned) LEFT JOIN wards USING (city, cell)""")
cte("named", f"""SELECT city, cell, zone_id, ward_id, ts, kind, {rnd('pm25_med', 1)} AS pm25_estimate,
  {pick(['industrial', 'construction', 'waste_burning', 'traffic'], 'cell % 4')} AS primary_source, {rnd('(cell % 60) / 100e0 + 0.30e0', 2)} AS confidence,
  CASE WHEN cell % 5 = 0 THEN ['a site is near', 'fires seen'] ELSE ['a site is near'] END AS evidence_factors,
  'because ' || primary_source AS reason, 'rules' AS explained_by FROM hot WHERE attributable""")
cte("zone_eps", f"""SELECT city, zone_id, {rnd('sev * 0.35e0 + conf * 0.25e0 + act * 0.20e0 + vuln * 0.20e0', 6)} AS raw,
  {rnd('(sev * 0.35e0 + conf * 0.25e0 + act * 0.20e0 + vuln * 0.20e0) * 100e0', 1)} AS eps, {rnd('sev', 3)} AS severity, {rnd('conf', 3)} AS attribution_conf,
  {rnd('act', 3)} AS actionability, {rnd('vuln', 3)} AS vulnerability FROM (SELECT h.city, h.zone_id, greatest(0e0, least(max(h.severity), 1e0)) AS sev,
    max(coalesce(n.confidence, 0e0)) AS conf, CASE WHEN bool_or(h.attributable) THEN 1e0 ELSE 0e0 END
    * [1e0, 0.8e0, 0.6e0][max({RANK.format(k='h.kind')})] * CASE WHEN min(h.nearest_candidate_km) <= 3e0 THEN 1e0 ELSE 0.6e0 END AS act,
    least(max(u.lu_sensitive) / 5e0, 1e0) AS vuln FROM hot h LEFT JOIN named n USING (city, cell) LEFT JOIN landuse u USING (city, cell) GROUP BY ALL)""")
cte("queue", f"""SELECT z.city, 'A' || lpad((row_number() OVER (PARTITION BY z.city ORDER BY top_sev DESC, top_cell))::VARCHAR, 2, '0') AS action_id, z.zone_id,
  coalesce(w.ward_id, 'unknown') AS ward_id, coalesce(w.ward_name, 'unknown') AS ward_name, z.cells, {rnd('z.lat', 4)} AS lat, {rnd('z.lon', 4)} AS lon, e.eps,
  w.kind, coalesce(n.primary_source, 'unknown') AS source, coalesce(n.confidence, 0e0) AS confidence, z.n_cells::INTEGER AS n_cells, {rnd('w.pm25_med', 1)} AS pm25_med
  FROM (SELECT city, zone_id, list(cell ORDER BY severity DESC, cell) AS cells, cells[1] AS top_cell, max(severity) AS top_sev, count(*) AS n_cells,
    avg({lat_c('cell')}) AS lat, avg({lon_c('cell')}) AS lon FROM hot WHERE attributable GROUP BY ALL) z
  JOIN hot w ON w.city = z.city AND w.cell = z.top_cell LEFT JOIN named n ON n.city = z.city AND n.cell = z.top_cell JOIN zone_eps e ON e.city = z.city AND e.zone_id = z.zone_id""")
