"""Local grids, neighbour means along the wind, decayed persistence, bands, realised effects and equity (ids S7f, N12, N13, X9, L4, B5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from hazegrid.operators import advection, equity, forecast, intervals, ledger, panel, spatial
from workload.feeds import GRID, Feeds, fx, site_lat, site_lon, text_ts
from workload.registry import query
from workload.sqlkit import cte, lat_of, lon_of, offset_rows, rnd, ts
from workload.sqlkit import fx as sfx

# ------------------------------------------------------------- S7f local grids

#: Latitude to which the five cities move.
LATITUDES = [0.0, 28.6, 51.0, 60.0, -33.0]


def far_cities(f: Feeds) -> DataFrame:
    at = F.get(F.array(*[F.lit(x) for x in LATITUDES]), F.col("r_regionkey").cast("int"))
    return f.table("region").select(
        F.col("r_name").alias("city"), "r_regionkey", (at - 0.06).alias("lat_min"), (at + 0.06).alias("lat_max"), F.lit(76.95).alias("lon_min"), F.lit(77.05).alias("lon_max")
    )


cte("far_cities", f"""SELECT r_name AS city, r_regionkey, {LATITUDES}[r_regionkey + 1] - 0.06e0 AS lat_min, {LATITUDES}[r_regionkey + 1] + 0.06e0 AS lat_max,
  76.95e0 AS lon_min, 77.05e0 AS lon_max, floor(((lat_min + lat_max) / 2 + 90e0) / 0.25e0 + 0.5e0)::BIGINT + 1 AS band,
  111.32e0 * cos(radians((band - 1) * 0.25e0 - 90e0)) AS kx FROM region""")
cte("far_sites", f"""SELECT c.city, band, kx, {lat_of('k * 7')} - 28.45e0 - 0.15e0 + (lat_min + lat_max) / 2 AS lat, 76.95e0 + ({lon_of('k * 7')} - 76.95e0) / 4 + 0.0013e0 AS lon
  FROM (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT p_partkey FROM part) JOIN far_cities c ON r_regionkey = k % 5""")


@query("s7_local_cells", """SELECT city, cell, count(*) AS n FROM (
  SELECT city, ((CASE WHEN eq > er AND eq > es THEN -rr - rs ELSE rq END)::BIGINT + 1048576) * 2097152 + (CASE WHEN NOT (eq > er AND eq > es) AND er > es THEN -rq - rs ELSE rr END)::BIGINT + 1048576
      + band * 4398046511104 AS cell
  FROM (SELECT *, floor(fq + 0.5e0) AS rq, floor(fr + 0.5e0) AS rr, floor(-fq - fr + 0.5e0) AS rs, abs(rq - fq) AS eq, abs(rr - fr) AS er, abs(rs - (-fq - fr)) AS es
    FROM (SELECT *, (lon * kx * sqrt(3e0) / 3 - lat * 111.32e0 / 3) / 0.46e0 AS fq, lat * 111.32e0 * 2 / 3 / 0.46e0 AS fr FROM far_sites))) GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    k, cities = F.col("k"), far_cities(f)
    sites = f.table("supplier").select(F.col("s_suppkey").alias("k")).unionByName(f.table("part").select(F.col("p_partkey").alias("k")))
    placed = sites.withColumn("r_regionkey", (k % 5).cast("int")).join(cities, "r_regionkey").select(
        "city", (site_lat(k * 7) - 28.45 - 0.15 + (F.col("lat_min") + F.col("lat_max")) / 2).alias("lat"), (F.lit(76.95) + (site_lon(k * 7) - 76.95) / 4 + 0.0013).alias("lon")
    )
    return spatial.stamp_local(placed, cities, GRID).groupBy("city", "cell").agg(F.count("*").alias("n"))


@query("s7_local_grid", f"""SELECT city, (q + 1048576) * 2097152 + r + 1048576 + band * 4398046511104 AS cell, {sfx('lat')} AS lat, {sfx('lon')} AS lon FROM (
  SELECT city, band, q, r, lat_min, lat_max, lon_min, lon_max, r * 0.69e0 / 111.32e0 AS lat, (q * sqrt(3e0) + r * (sqrt(3e0) / 2)) * 0.46e0 / kx AS lon
  FROM (SELECT *, unnest(generate_series(floor(lat_min * 111.32e0 / 0.69e0)::BIGINT - 1, ceil(lat_max * 111.32e0 / 0.69e0)::BIGINT + 1)) AS r FROM far_cities),
    LATERAL (SELECT unnest(generate_series(floor(lon_min * kx / (0.46e0 * sqrt(3e0)) - r / 2e0)::BIGINT - 2, ceil(lon_max * kx / (0.46e0 * sqrt(3e0)) - r / 2e0)::BIGINT + 2)) AS q))
  WHERE lat >= lat_min AND lat < lat_max AND lon >= lon_min AND lon < lon_max""")
def _(f: Feeds) -> DataFrame:
    return spatial.local_city_cells(far_cities(f), GRID).select("city", "cell", fx("lat").alias("lat"), fx("lon").alias("lon"))


# ------------------------------------------------ N13 neighbour means, N12 decay

cte("ring1", offset_rows(1, 1))


@query("n13_upwind_mean", f"""SELECT city, cell, {ts('ts')} AS ts, count(*)::INTEGER AS n_upwind, {sfx('sum(a * x) / sum(a)')} AS upwind_mean FROM (
  SELECT l.city, l.cell + delta AS cell, l.ts, l.pm25_station AS x, 0.2e0 + greatest(0e0, cos(radians((w.wind_from_deg + 180e0) % 360e0) - radians(bear))) AS a
  FROM labels l JOIN weather w ON w.city = l.city AND w.ts = l.ts, ring1) GROUP BY city, cell, ts""")
def _(f: Feeds) -> DataFrame:
    mean = advection.upwind_mean(panel.station_cell_hour(f.stations), f.weather, "pm25_station", grid=GRID)
    return mean.select("city", "cell", text_ts("ts").alias("ts"), "n_upwind", fx("upwind_mean").alias("upwind_mean"))


HOW = "((isodow(ts) - 1) * 24 + hour(ts))::INTEGER"


@query("n12_decayed_persistence", f"""SELECT city, cell, how, {sfx('sum(pm25 * a) / sum(a)')} AS usual, {sfx('sum(a)')} AS weight, {ts('any_value(newest)')} AS newest FROM (
  SELECT *, exp(-(epoch_us(newest) - epoch_us(ts)) / (672e0 * 3.6e9)) AS a FROM (
    SELECT city, cell, ts, pm25, {HOW} AS how, max(ts) OVER (PARTITION BY city, cell, {HOW}) AS newest FROM stations)) GROUP BY city, cell, how""")
def _(f: Feeds) -> DataFrame:
    usual = advection.decayed_persistence(advection.decayed_state(f.stations, "pm25"))
    return usual.select("city", "cell", "how", fx("usual").alias("usual"), fx("w").alias("weight"), text_ts("clock").alias("newest"))


# ------------------------------------------------------------------- X9 bands

# Errors of the first week of the tail make the bands, the second week tries them.
cte("tail", "SELECT e.city, horizon, y, diurnal, e.ts > edge + INTERVAL 7 DAY AS later FROM evalset e JOIN split s ON s.city = e.city WHERE is_test AND diurnal IS NOT NULL")
cte("bands", """SELECT city, horizon, count(*) AS n, list_sort(list(y - diurnal)) AS e,
    CASE WHEN (n + 1) * 0.1e0 >= 1 - 1e-9 THEN e[least(greatest(floor((n + 1) * 0.1e0)::BIGINT - 1, 0), n - 1) + 1] END AS low,
    CASE WHEN (n + 1) * (1 - 0.9e0) >= 1 - 1e-9 THEN e[least(greatest(ceil((n + 1) * 0.9e0)::BIGINT - 1, 0), n - 1) + 1] END AS high
  FROM tail WHERE NOT later GROUP BY city, horizon""")


def _tail(f: Feeds) -> DataFrame:
    test = forecast.evaluation_frame(f.labelled).where("is_test AND diurnal IS NOT NULL")
    return test.withColumn("later", F.col("ts") > F.col("split") + F.expr("INTERVAL 7 DAYS"))


@query("x9_error_bands", f"SELECT city, horizon, n, {sfx('low')} AS low, {sfx('high')} AS high FROM bands")
def _(f: Feeds) -> DataFrame:
    b = intervals.error_bands(_tail(f).where("NOT later"), "y", "diurnal")
    return b.select("city", "horizon", "n", fx("low").alias("low"), fx("high").alias("high"))


@query("x9_interval_coverage", f"""SELECT t.city, t.horizon, count(*) AS n_rows, {rnd('avg(CASE WHEN (low IS NULL OR y >= diurnal + low) AND (high IS NULL OR y <= diurnal + high) THEN 1e0 ELSE 0e0 END)', 4)} AS coverage,
  {sfx('avg((diurnal + high) - (diurnal + low))')} AS mean_width FROM tail t LEFT JOIN bands b ON b.city = t.city AND b.horizon = t.horizon WHERE later GROUP BY t.city, t.horizon""")
def _(f: Feeds) -> DataFrame:
    tail = _tail(f)
    banded = intervals.with_bands(tail.where("later"), intervals.error_bands(tail.where("NOT later"), "y", "diurnal"), "diurnal")
    return intervals.interval_coverage(banded, "y").withColumn("mean_width", fx("mean_width"))


# ------------------------------------------------------------------ L4 effects

cte("carried", """SELECT q.city, action_id || s AS action_id, zone_id, cells, now_ts - INTERVAL 72 HOUR AS issued_at,
  CASE WHEN action_id NOT LIKE '%7' THEN now_ts - INTERVAL 72 HOUR + to_hours((len(cells) % 9 + 10 * k)::BIGINT) END AS actioned_at
  FROM queue q JOIN field_at a USING (city), (VALUES ('', 0), ('b', 1)) t(s, k)""")


@query("l4_realised_effect", f"""SELECT city, action_id, zone_id, count(*) AS n_hours, {sfx('avg(r)')} AS realised, {sfx('avg(h)')} AS expected, {sfx('avg(r - h)')} AS mean_change,
  {sfx('sum(r - h)', 4)} AS accumulated, sum(CASE WHEN others > 1 THEN 1 ELSE 0 END)::BIGINT AS shared_hours
  FROM (SELECT *, count(*) OVER (PARTITION BY city, zone_id, ts) AS others FROM (
    SELECT c.city, c.action_id, c.zone_id, f.ts, avg(f.pm25_hat) AS r, avg(g.pm25_hat) AS h FROM (SELECT *, unnest(cells) AS cell FROM carried) c
    JOIN field f ON f.city = c.city AND f.cell = c.cell AND f.ts > c.actioned_at AND f.ts <= c.actioned_at + INTERVAL 72 HOUR
    JOIN forecast g ON g.city = c.city AND g.cell = c.cell AND g.horizon_h = ceil((epoch(f.ts) - epoch(c.issued_at)) / 3600 / 3) * 3 GROUP BY ALL)) GROUP BY city, action_id, zone_id""")
def _(f: Feeds) -> DataFrame:
    now = f.field.groupBy("city").agg((F.max("ts") - F.expr("INTERVAL 72 HOURS")).alias("issued_at"))
    twice = F.explode(F.array(F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), F.struct(F.lit("b").alias("s"), F.lit(1).alias("k")))).alias("t")
    after = F.col("issued_at") + F.make_dt_interval(hours=F.size("cells") % 9 + 10 * F.col("t.k"))
    carried = f.queue.select("city", "action_id", "zone_id", "cells", twice).join(now, "city").select(
        "city", F.concat("action_id", "t.s").alias("action_id"), "zone_id", "cells", "issued_at", F.when(~F.col("action_id").endswith("7"), after).alias("actioned_at")
    )
    effect = ledger.realised_effect(carried, f.forecast.join(now, "city"), f.field)
    rounded = {c: fx(c) for c in ("realised", "expected", "mean_change")} | {"accumulated": fx("accumulated", 4)}
    return effect.withColumns(rounded)


# ------------------------------------------------------------------- B5 equity

cte("ward_facts", """SELECT w.city, w.ward_id, n_cells * (try_cast(w.ward_id[2:] AS INTEGER) % 4) * 100e0 AS people,
    CASE WHEN try_cast(w.ward_id[2:] AS INTEGER) % 5 > 0 THEN (try_cast(w.ward_id[2:] AS INTEGER) % 5) / 5e0 END AS access, pm25
  FROM (SELECT city, ward_id, count(*) AS n_cells FROM wards WHERE ward_id <> 'unassigned' GROUP BY ALL) w
  JOIN (SELECT city, ward_id, avg(pm25_hat) AS pm25 FROM field_now JOIN wards USING (city, cell) GROUP BY ALL) USING (city, ward_id)""")
cte("ward_rates", """SELECT f.*, coalesce(n, 0) AS n_reports, n_reports / nullif(people, 0) AS rate FROM ward_facts f
  LEFT JOIN (SELECT city, ward_id, count(*) AS n FROM reports GROUP BY ALL) USING (city, ward_id)""")
cte("city_rates", """SELECT city, m, greatest(0e0, square / everyone - m * m - m * n / everyone) AS a FROM (SELECT city, sum(n_reports) / sum(people) AS m, sum(people) AS everyone,
  count(*) AS n, sum(rate * n_reports) AS square FROM ward_rates WHERE people > 0 GROUP BY city)""")


@query("b5_equity_signal", f"""SELECT city, ward_id, n_reports, {sfx('expected', 4)} AS expected, {sfx('shrunk * 1e3')} AS shrunk, {sfx('weight')} AS weight, {sfx('n_reports * weight')} AS weighted_reports, silent,
    {sfx('CASE WHEN silent THEN greatest(0e0, expected - n_reports) ELSE 0e0 END', 4)} AS boost FROM (
  SELECT *, coalesce(pm25 >= 40e0 AND shrunk < 0.9e0 * m, FALSE) AS silent FROM (
    SELECT r.city, r.ward_id, n_reports, m * people AS expected, pm25, m, m + CASE WHEN people > 0 AND a > 0 THEN a / (a + m / people) ELSE 0e0 END * (coalesce(rate, m) - m) AS shrunk,
      CASE WHEN access IS NULL THEN 1e0 ELSE least(avg(access) OVER (PARTITION BY r.city) / access, 5e0) END AS weight FROM ward_rates r LEFT JOIN city_rates c ON c.city = r.city))""")
def _(f: Feeds) -> DataFrame:
    number = F.substring("ward_id", 2, 9).try_cast("int")
    newest = f.field.join(f.field.groupBy("city").agg(F.max("ts").alias("ts")), ["city", "ts"])
    level = newest.join(f.wards, ["city", "cell"]).groupBy("city", "ward_id").agg(F.avg("pm25_hat").alias("pm25"))
    facts = f.wards.where("ward_id <> 'unassigned'").groupBy("city", "ward_id").agg(F.count("*").alias("n_cells")).join(level, ["city", "ward_id"])
    facts = facts.withColumns({"people": F.col("n_cells") * (number % 4) * 100.0, "access": F.when(number % 5 > 0, number % 5 / 5.0)})
    out = equity.equity_signal(f.reports, facts, severe_at=40.0, below=0.9)
    return out.select(
        "city", "ward_id", "n_reports", fx("expected", 4).alias("expected"), fx(F.col("shrunk") * 1e3).alias("shrunk"), fx("weight").alias("weight"),
        fx("weighted_reports").alias("weighted_reports"), "silent", fx("boost", 4).alias("boost"),
    )
