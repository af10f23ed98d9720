"""Priority, memo, advisory, ledger, audit, serving and evaluation (ids R, K, V, L, B, Q, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.functions import advisory_text as text
from hazegrid.functions import stats
from hazegrid.functions.geo import round_to
from hazegrid.operators import advisory, audit, evaluate, exposure, forecast, ledger, memo, priority, serving
from hazegrid.session import cut_lineage
from workload.feeds import GRID, Feeds, fx, text_ts
from workload.registry import query
from workload.sqlkit import RANK, aqi, band, cte, d, hav, lat_c, lon_c, med, pick, quant, rnd, ts
from workload.sqlkit import fx as sfx

ISSUED = "2024-02-01 06:00:00"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ----------------------------------------------------------------- R priority


@query("r1_eps", "SELECT city, zone_id, eps, severity, attribution_conf, actionability, vulnerability FROM zone_eps")
def _(f: Feeds) -> DataFrame:
    return priority.eps(f.hot, f.named, f.landuse).select("city", "zone_id", "eps", "components.*")


@query("r1_eps_violations", "SELECT city, zone_id FROM zone_eps WHERE abs((severity * 0.35e0 + attribution_conf * 0.25e0 + actionability * 0.20e0 + vulnerability * 0.20e0) * 100 - eps) > 1")
def _(f: Feeds) -> DataFrame:
    return priority.eps_violations(priority.eps(f.hot, f.named, f.landuse)).select("city", "zone_id")


@query("r2_actions", "SELECT city, action_id, zone_id, ward_id, ward_name, array_to_string(cells, ',') AS cells, lat, lon, eps, kind, source, confidence, n_cells, pm25_med, 'pending' AS status FROM queue")
def _(f: Feeds) -> DataFrame:
    a = priority.by_eps(priority.actions(f.hot, f.named, f.landuse, GRID))
    cells = F.array_join(F.transform("cells", lambda c: c.cast("string")), ",")
    return a.withColumn("cells", cells).select("*", "centroid.lat", "centroid.lon").drop("centroid", "components")


_cover = hav(lat_c("h.cell"), lon_c("h.cell"), "a.lat", "a.lon")
cte("cover", f"SELECT a.city, a.action_id, a.eps, h.cell, h.severity, h.severity * (a.eps / 100e0) AS burden FROM queue a JOIN hot h USING (city) WHERE {_cover} <= 2e0")


@query("r3_stop_gains", f"SELECT q.city, q.action_id, {sfx('coalesce(sum(burden), 0e0)')} AS gain, count(c.cell) AS n_cells FROM queue q LEFT JOIN cover c USING (city, action_id) GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    pairs = priority.coverage_pairs(f.queue, f.hot, grid=GRID)
    return priority.stop_gains(pairs, f.queue).withColumn("gain", fx("gain"))


cte("first_pick", """SELECT city, action_id, gain FROM (SELECT city, action_id, sum(burden) AS gain, any_value(eps) AS eps FROM cover GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY city ORDER BY gain DESC, eps DESC, action_id) = 1""")


@query("r3_first_pick", f"SELECT city, action_id, {sfx('gain')} AS gain FROM first_pick WHERE gain > 0")
def _(f: Feeds) -> DataFrame:
    return priority.max_coverage(f.queue, f.hot, 1, grid=GRID).select("city", "action_id", fx("gain").alias("gain"))


# Each step takes, in every city, the stop with most burden among cells that no earlier pick covers.
cte("stops", "SELECT city, list({'id': action_id, 'eps': eps, 'own': own} ORDER BY action_id) AS all_stops FROM (SELECT city, action_id, eps, list({'cell': cell, 'sev': severity, 'b': burden} ORDER BY cell) AS own FROM cover GROUP BY ALL) GROUP BY city")
cte("picked", """SELECT city, 0 AS pick, NULL::VARCHAR AS action_id, 0e0 AS gain, 0e0 AS covered, []::BIGINT[] AS done FROM stops
  UNION ALL SELECT city, pick + 1, best.id, best.gain, best.covered, list_concat(done, best.cells) FROM (
    SELECT p.city, p.pick, p.done, list_sort(list_filter(list_transform(all_stops, lambda s: {'minus': -list_sum(list_transform(list_filter(s.own, lambda c: NOT list_contains(p.done, c.cell)), lambda c: c.b)), 'eps': -s.eps, 'id': s.id,
        'gain': list_sum(list_transform(list_filter(s.own, lambda c: NOT list_contains(p.done, c.cell)), lambda c: c.b)), 'covered': list_sum(list_transform(list_filter(s.own, lambda c: NOT list_contains(p.done, c.cell)), lambda c: c.sev)),
        'cells': list_transform(s.own, lambda c: c.cell)}), lambda s: s.gain > 0))[1] AS best
    FROM picked p JOIN stops USING (city) WHERE p.pick < 10) WHERE best IS NOT NULL""")


@query("r3_max_coverage", f"""SELECT city, pick, action_id, {sfx('gain')} AS gain, {rnd('sum(covered) OVER (PARTITION BY city) * 100e0 / nullif(everything, 0)', 1)} AS coverage_pct
  FROM picked JOIN (SELECT city, sum(severity) AS everything FROM hot GROUP BY ALL) USING (city) WHERE pick > 0""")
def _(f: Feeds) -> DataFrame:
    return priority.max_coverage(f.queue, f.hot, 10, grid=GRID).withColumn("gain", fx("gain"))


@query("r4_dispatch")
def _(f: Feeds) -> DataFrame:
    return priority.dispatch(f.queue, f.hot, 4, 10, GRID).drop("stops", "route_geometry")


_leg = hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")


@query("r5_route_length", f"""SELECT city, team, count(*) AS n_stops, {rnd('coalesce(sum(leg), 0e0) * 1.4e0', 1)} AS route_km, {rnd(f"{rnd('coalesce(sum(leg), 0e0) * 1.4e0', 1)} / 20e0 * 60e0", 1)} AS route_duration_min,
    CASE WHEN count(*) > 1 THEN string_agg(printf('%.4f %.4f', lon, lat), ';' ORDER BY seq) ELSE '' END AS route_geometry
  FROM (SELECT *, {_leg} AS leg FROM (SELECT city, (substr(action_id, 2)::INTEGER % 4 + 1) AS team, action_id AS seq, lat, lon FROM queue) WINDOW w AS (PARTITION BY city, team ORDER BY seq)) GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    team = (F.substring("action_id", 2, 9).cast("int") % 4 + 1).alias("team")
    stops = f.queue.select("city", team, F.col("action_id").alias("seq"), "centroid.lat", "centroid.lon")
    point = F.transform("route_geometry", lambda p: F.format_string("%.4f %.4f", p[0], p[1]))
    return priority.route_length(stops).withColumn("route_geometry", F.array_join(point, ";"))


@query("r6_zones_from_cells", f"""SELECT *, row_number() OVER (PARTITION BY city, queue ORDER BY severity DESC, zone_id)::INTEGER AS position FROM (SELECT city, zone_id, arg_max(kind, {RANK.format(k='kind')}) AS kind, max(severity) AS severity,
  list(cell ORDER BY severity DESC, cell)[1] AS lead_cell, {sfx('avg(pm25_med)')} AS pm25_med, count(*) AS n_cells, max(fires_6h) AS fires_6h, bool_or(attributable) AS attributable, CASE WHEN bool_or(attributable) THEN 'enforceable' ELSE 'diffuse' END AS queue FROM hot GROUP BY ALL)""")
def _(f: Feeds) -> DataFrame:
    return priority.zones_from_cells(f.hot).withColumn("pm25_med", fx("pm25_med"))


# ---------------------------------------------------------------------- K memo

cte("first_named", """SELECT q.city, q.action_id, arg_min({'s': n.primary_source, 'c': n.confidence, 'p': n.pm25_estimate, 'f': n.evidence_factors}, list_position(q.cells, n.cell)) AS x
  FROM queue q JOIN named n ON n.city = q.city AND list_contains(q.cells, n.cell) GROUP BY ALL""")
_pm = "coalesce(nullif(pm25_med, 0), nullif(x.p, 0), 0e0)"
cte("facts", f"""SELECT q.*, x.s AS src, x.c AS conf, x.f AS factors, {rnd(_pm, 1)} AS pm25, {aqi(_pm)} AS aqi, {band(_pm)} AS aqi_category FROM queue q JOIN first_named USING (city, action_id)""")
_rules = memo.LEGAL_RULES


def _cond(rule: dict) -> str:
    parts = []
    for field, op, value in rule["when"]:
        col = {"source": "src", "aqi": "aqi"}[field]
        parts.append(f"{col} IN ({', '.join(q(v) for v in value)})" if isinstance(value, list) else f"{col} {'>=' if op == 'gte' else '<='} {value}")
    return " AND ".join(parts)


def _matched(field: str) -> str:
    arms = ", ".join(f"CASE WHEN {_cond(r)} THEN {q(r[field])} END" for r in _rules)
    return f"list_filter([{arms}], lambda r: r IS NOT NULL)"


def _cited() -> str:
    arms = ", ".join(f"CASE WHEN {_cond(r)} THEN {q(r['statute'] + ', ' + r['provision'])} END" for r in _rules)
    return f"array_to_string(list_filter([{arms}], lambda r: r IS NOT NULL), '; ')"


def _facts(f: Feeds) -> DataFrame:
    return memo.situation(memo.first_attributed(f.queue, f.named))


@query("k1_situation", "SELECT city, action_id, src AS source, conf AS confidence, pm25, aqi, aqi_category, kind, n_cells FROM facts")
def _(f: Feeds) -> DataFrame:
    return _facts(f).select("city", "action_id", "source", "confidence", "pm25", "aqi", "aqi_category", "kind", "n_cells")


@query("k2_match_rules", f"SELECT city, action_id, array_to_string({_matched('id')}, ',') AS rules FROM facts")
def _(f: Feeds) -> DataFrame:
    m = memo.match_rules(_facts(f), memo.rules_table(f.spark))
    return m.select("city", "action_id", F.array_join(F.transform("legal_basis", lambda r: r["id"]), ",").alias("rules"))


_src = "replace(src, '_', ' ')"
cte("memo_rows", f"""SELECT *, 'AQ/' || upper(city[1:3]) || '/20240201/' || zone_id AS memo_id,
  'Zone ' || zone_id || ' in ' || ward_name || ': suspected emissions, ' || {_src} AS subject,
  'Hexes: ' || n_cells || ', type: ' || kind || '. PM2.5 there is put at ' || pm25 || ' ug/m3, which is AQI ' || aqi || ', ' || aqi_category || '.' AS background,
  'Likeliest source: ' || {_src} || ', with confidence ' || printf('%.2f', conf) || '. Grounds: ' || array_to_string(factors[:3], '; ') || '. '
    || CASE WHEN conf < 0.6 THEN 'Take this as INDICATIVE until a visit has confirmed it.' ELSE 'Observations of different kinds agree on it.' END AS finding,
  'Please visit the zone and proceed under ' || {_cited()} || '.' AS directive FROM facts""")


@query("k3_memo_text", "SELECT city, action_id, subject, background, finding, directive FROM memo_rows")
def _(f: Feeds) -> DataFrame:
    t = memo.memo_text(memo.match_rules(_facts(f), memo.rules_table(f.spark)))
    return t.select("city", "action_id", "subject", "background", "finding", "directive")


def _memos(f: Feeds) -> DataFrame:
    return memo.memos(f.queue, f.named, memo.rules_table(f.spark), ISSUED)


@query("k4_memos", f"SELECT city, memo_id, action_id, zone_id, ward_id, '{ISSUED}' AS issued_at, 'draft' AS status, aqi, len({_matched('id')})::INTEGER AS n_rules, subject, array_to_string(factors, '|') AS evidence FROM memo_rows")
def _(f: Feeds) -> DataFrame:
    return _memos(f).select(
        "city", "memo_id", "action_id", "zone_id", "ward_id", text_ts("issued_at").alias("issued_at"), "status", "situation.aqi",
        F.size("legal_basis").alias("n_rules"), "subject", F.array_join("evidence_chain", "|").alias("evidence"),
    )


@query("k5_actions_fallback", f"""SELECT z.city, 'A' || lpad((row_number() OVER (PARTITION BY z.city ORDER BY z.zone_id) - 1)::VARCHAR, 2, '0') AS action_id, z.zone_id, h.ward_id, h.ward_name, h.kind, h.severity, h.pm25_med, n::INTEGER AS n_cells, h.nearest_candidate_km, {ts('h.ts')} AS ts
  FROM (SELECT city, zone_id, list(cell ORDER BY severity DESC, cell)[1] AS top, count(*) AS n FROM hot WHERE attributable GROUP BY ALL) z JOIN hot h ON h.city = z.city AND h.cell = z.top""")
def _(f: Feeds) -> DataFrame:
    return memo.actions_fallback(f.hot).withColumn("ts", text_ts("ts")).drop("cells")


# ------------------------------------------------------------------ V advisory

cte("ward_in", """SELECT w.city, w.cell, w.ward_id, w.ward_name, coalesce(f.pm25_hat, n.pm25_hat) AS pm25, u.lu_sensitive AS vuln, coalesce(f.urgency, FALSE) AS worsening FROM wards w
  LEFT JOIN (SELECT * FROM forecast WHERE horizon_h = 24) f USING (city, cell) LEFT JOIN field_now n USING (city, cell) JOIN landuse u USING (city, cell) WHERE coalesce(f.pm25_hat, n.pm25_hat) IS NOT NULL""")
_bands = "['Good', 'Satisfactory', 'Moderate', 'Poor', 'Very Poor', 'Severe']"
cte("adv0", f"""SELECT city, ward_id, min(ward_name) AS ward_name, {med('pm25')} AS pm, max(vuln) AS sites, bool_or(worsening) AS worsening, count(*)::INTEGER AS n_cells FROM ward_in GROUP BY ALL""")
cte("adv1", f"""SELECT *, {rnd('pm', 1)} AS pm25, {aqi('pm')} AS aqi, {band('pm')} AS aqi_category, least((list_position({_bands}, {band('pm')}) - 1) / 5e0 * 0.70e0 + least(sites / 10e0, 1e0) * 0.15e0 + CASE WHEN worsening THEN 0.15e0 ELSE 0e0 END, 1e0) AS raw FROM adv0""")
_impact = "CASE aqi_category " + " ".join(f"WHEN {q(b)} THEN {q(t)}" for b, t in text.HEALTH_IMPACT.items()) + " END"
cte("adv", f"""SELECT city, ward_id, ward_name, pm25, aqi, aqi_category, {_impact} AS health_impact_cpcb, CASE WHEN raw >= 0.75 THEN 'critical' WHEN raw >= 0.55 THEN 'high' WHEN raw >= 0.35 THEN 'moderate' ELSE 'low' END AS risk_tier,
  {rnd('raw', 3)} AS risk_score, worsening, n_cells, sites AS schools_hospitals_nearby FROM adv1""")


def _inputs(f: Feeds) -> DataFrame:
    return advisory.ward_inputs(f.wards, f.forecast, f.field, f.landuse)


@query("v1_ward_inputs", "SELECT * FROM ward_in")
def _(f: Feeds) -> DataFrame:
    return _inputs(f)


@query("v2_ward_advisory", "SELECT * FROM adv")
def _(f: Feeds) -> DataFrame:
    a = advisory.by_risk(advisory.ward_advisory(_inputs(f)))
    return a.withColumn("schools_hospitals_nearby", F.col("vulnerability.schools_hospitals_nearby")).drop("vulnerability")


_LANGS = ["en", "hi", "ta", "kn"]


def _tpl(lang: str) -> str:
    arms = " ".join(f"WHEN {q(b)} THEN {q(t)}" for b, t in text.TEMPLATES[lang].items())
    return f"replace(replace(CASE aqi_category {arms} END, '{{ward}}', ward_name), '{{aqi}}', aqi::VARCHAR)"


_warn = q(text.DISCLAIMER_HEAD + text.DISCLAIMER_OPEN.replace("{langs}", "Kannada"))
cte("adv_text", " UNION ALL ".join(f"SELECT city, ward_id, risk_score, '{x}' AS lang, {_tpl(x)} AS text FROM adv" for x in _LANGS))


def _texts(f: Feeds) -> DataFrame:
    langs = F.array(*[F.lit(x) for x in _LANGS])
    return advisory.advisory_texts(advisory.ward_advisory(_inputs(f)), langs)


@query("v3_advisory_texts", f"SELECT city, ward_id, lang, text, {q('|'.join(_LANGS))} AS languages, CASE lang WHEN 'en' THEN 'cpcb_official' WHEN 'kn' THEN 'cross_checked' ELSE 'native_speaker' END AS verification, lang <> 'kn' AS reviewed, {_warn} AS disclaimer FROM adv_text")
def _(f: Feeds) -> DataFrame:
    t = _texts(f)
    return t.select(
        "city", "ward_id", F.array_join("languages", "|").alias("languages"), "verification", "reviewed", "disclaimer", F.explode("texts").alias("lang", "text")
    ).withColumns({"verification": F.element_at("verification", F.col("lang")), "reviewed": F.element_at("reviewed", F.col("lang"))})


cte("top_adv", "SELECT city, ward_id FROM adv QUALIFY row_number() OVER (PARTITION BY city ORDER BY risk_score DESC, ward_id) <= 25")


@query("v4_audio_worklist", "SELECT t.city, t.ward_id, t.lang, t.text, sha256(t.text) AS text_hash FROM adv_text t JOIN top_adv USING (city, ward_id) WHERE NOT (lang = 'hi' OR (lang = 'en' AND ward_id < 'W010'))")
def _(f: Feeds) -> DataFrame:
    t = cut_lineage(_texts(f))
    spoken = t.select("city", "ward_id", F.explode("texts").alias("lang", "text")).where("lang = 'hi' or (lang = 'en' and ward_id < 'W010')")
    manifest = spoken.select("city", "ward_id", "lang", F.sha2("text", 256).alias("text_hash"))
    return advisory.audio_worklist(t, manifest, 25)


@query("v4_audio_manifest", """SELECT city, ward_id, lang, CASE WHEN state IN ('reused', 'made') THEN 'audio/' || ward_id || '_' || lang || '.mp3' END AS path,
    CASE state WHEN 'reused' THEN 'old' WHEN 'made' THEN 'voice-' || lang END AS voice, len(text)::INTEGER AS chars, CASE state WHEN 'reused' THEN 7 WHEN 'made' THEN len(text) * 10 END::BIGINT AS bytes, sha256(text) AS text_hash, state FROM (
  SELECT t.city, t.ward_id, t.lang, t.text, CASE WHEN lang = 'kn' THEN 'no_voice' WHEN lang = 'hi' AND substr(ward_id, 4) <> '3' THEN 'reused'
    WHEN substr(ward_id, 4) NOT IN ('1', '6') THEN 'made' ELSE 'failed' END AS state FROM adv_text t JOIN top_adv USING (city, ward_id))""")
def _(f: Feeds) -> DataFrame:
    """Texts in one language were spoken before, some of their files are gone, and the service fails for some wards."""
    t = cut_lineage(_texts(f))
    spoken = t.select("city", "ward_id", F.explode("texts").alias("lang", "text"))
    path = F.concat(F.lit("audio/"), F.col("ward_id"), F.lit("_"), F.col("lang"), F.lit(".mp3"))
    last = F.substring("ward_id", 4, 1)
    # Every text of this language but those of wards ending in 3 is as it was when it was spoken.
    then = F.when(last == "3", F.lit("changed since")).otherwise(F.col("text"))
    previous = spoken.where("lang IN ('hi', 'kn')").select("city", "ward_id", "lang", path.alias("path"), F.lit("old").alias("voice"), F.lit(7).alias("bytes"), F.sha2(then, 256).alias("text_hash"))
    made = spoken.where(~last.isin("1", "6")).select("city", "ward_id", "lang", (F.length("text") * 10).alias("bytes"))
    voices = spoken.select("lang").distinct().where("lang <> 'kn'").withColumn("voice", F.concat(F.lit("voice-"), F.col("lang")))
    return advisory.audio_manifest(t, previous, previous.select("path"), made, voices, 25).drop("text_verification")


@query("t5_top_risk_wards", "SELECT a.* FROM adv a JOIN top_adv USING (city, ward_id)")
def _(f: Feeds) -> DataFrame:
    a = advisory.top_risk_wards(advisory.ward_advisory(_inputs(f)), 25)
    return a.withColumn("schools_hospitals_nearby", F.col("vulnerability.schools_hospitals_nearby")).drop("vulnerability")


# -------------------------------------------------------------------- L ledger

cte("cf", f"""SELECT city, action_id, {med('f.pm25_hat')} AS pm FROM (SELECT city, action_id, unnest(cells) AS cell FROM queue) c JOIN (SELECT * FROM forecast WHERE horizon_h = 48) f USING (city, cell) GROUP BY ALL""")
cte("cfr", f"SELECT city, action_id, {rnd('pm', 1)} AS pm25_counterfactual, {aqi('pm')} AS aqi_counterfactual, {band('pm')} AS band_counterfactual FROM cf")


@query("l1_counterfactual", "SELECT *, 48 AS horizon_h FROM cfr")
def _(f: Feeds) -> DataFrame:
    return ledger.counterfactual(f.queue, f.forecast)


cte("times", f"""SELECT q.city, q.action_id, {ts('s.sig')} AS signal_at, '{ISSUED}' AS memo_drafted_at, {ts('u.dispatched_at')} AS dispatched_at, {ts('u.actioned_at')} AS actioned_at,
  {rnd('(epoch_us(u.actioned_at) - epoch_us(u.dispatched_at)) / 1e6 / 3600e0', 2)} AS response_hours, u.action_id IS NOT NULL AS has_status FROM queue q
  LEFT JOIN (SELECT city, zone_id, min(ts) AS sig FROM hot GROUP BY ALL) s USING (city, zone_id) LEFT JOIN status_now u ON u.city = q.city AND u.action_id = q.action_id""")


@query("l2_response_times", "SELECT * FROM times")
def _(f: Feeds) -> DataFrame:
    t = ledger.response_times(f.queue, f.hot, _memos(f), ledger.latest_status(f.status_updates))
    return t.withColumns({c: text_ts(c) for c in ("signal_at", "memo_drafted_at", "dispatched_at", "actioned_at")})


cte("entries", """SELECT q.city, q.action_id, q.zone_id, q.ward_id, q.source, q.eps, t.response_hours, c.pm25_counterfactual, c.aqi_counterfactual, CASE WHEN c.action_id IS NOT NULL THEN t.signal_at END AS frozen_at,
  CASE WHEN t.actioned_at IS NOT NULL THEN 'actioned' WHEN t.has_status THEN 'dispatched' ELSE 'awaiting_outcome' END AS status FROM queue q JOIN times t USING (city, action_id) LEFT JOIN cfr c USING (city, action_id)""")


def _entries(f: Feeds) -> DataFrame:
    return ledger.ledger(f.queue, f.hot, _memos(f), f.status, f.forecast)


@query("l3_ledger", "SELECT * FROM entries")
def _(f: Feeds) -> DataFrame:
    return _entries(f).select(
        "city", "action_id", "zone_id", "ward_id", "source", "eps", "response.response_hours", "counterfactual.pm25_counterfactual",
        "counterfactual.aqi_counterfactual", text_ts("counterfactual.frozen_at").alias("frozen_at"), "status",
    )


@query("l3_ledger_counts", "SELECT city, count(*) AS n_actions, count(*) FILTER (WHERE status = 'actioned') AS n_actioned FROM entries GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return ledger.ledger_counts(_entries(f))


@query("st4_latest_status", f"SELECT city, action_id, {ts('dispatched_at')} AS dispatched_at, {ts('actioned_at')} AS actioned_at, status FROM status_now")
def _(f: Feeds) -> DataFrame:
    s = ledger.latest_status(f.status_updates)
    return s.select("city", "action_id", text_ts("dispatched_at").alias("dispatched_at"), text_ts("actioned_at").alias("actioned_at"), "status")


# --------------------------------------------------------------------- B audit

cte("level", f"SELECT city, cell, {med('pm25_hat')} AS level FROM field GROUP BY ALL")
cte("edge", f"SELECT city, {quant('level', 0.75)} AS e, {med('level')} AS m FROM level GROUP BY ALL")
cte("spots", f"""SELECT l.city, l.cell, w.ward_id, {rnd('level', 1)} AS satellite_signal, row_number() OVER (PARTITION BY l.city ORDER BY level DESC, l.cell)::INTEGER AS rank
  FROM level l JOIN edge USING (city) ANTI JOIN (SELECT DISTINCT city AS mc, cell AS mcell FROM stations) ON mc = l.city AND mcell = l.cell JOIN wards w ON w.city = l.city AND w.cell = l.cell WHERE level >= e QUALIFY rank <= 40""")
cte("lmad", f"SELECT city, any_value(m) AS m, {med('abs(level - m)')} * 1.4826e0 AS s FROM level JOIN edge USING (city) GROUP BY city")


def _dark_spots(f: Feeds) -> DataFrame:
    return audit.blind_spots(f.field, f.stations, f.wards, 40)


cte("spots_ok", f"""SELECT l.city, l.cell, level FROM level l JOIN edge USING (city) LEFT JOIN (SELECT DISTINCT city, cell, TRUE AS seen FROM stations) s USING (city, cell) WHERE level >= e AND seen IS NULL""")
cte("spot_rank", f"SELECT city, cell, ward_id, {rnd('level', 1)} AS satellite_signal, row_number() OVER (PARTITION BY city ORDER BY level DESC, cell)::INTEGER AS rank FROM spots_ok JOIN wards USING (city, cell) QUALIFY rank <= 40")


@query("b1_blind_spots", "SELECT * FROM spot_rank")
def _(f: Feeds) -> DataFrame:
    return _dark_spots(f)


_mute = "CASE WHEN station_id LIKE '%7' THEN NULL ELSE pm25 * 0.1e0 END"


@query("b2_sensor_flags", f"""SELECT city, cell, coalesce(ward_id, 'unassigned') AS ward_id, station_name, reason FROM (SELECT r.city, r.cell, r.station_name, CASE WHEN reading IS NULL THEN 'no_data' WHEN coalesce(level, m) - reading > 3 * coalesce(nullif(s, 0), 1e0) THEN 'flat_while_satellite_spikes' END AS reason
  FROM (SELECT city, cell, {med('p')} AS reading, coalesce(min(station_id) FILTER (WHERE p IS NOT NULL), min(station_id)) AS station_name FROM (SELECT city, cell, station_id, {_mute} AS p FROM stations) GROUP BY ALL) r LEFT JOIN level USING (city, cell) JOIN lmad USING (city)) LEFT JOIN wards USING (city, cell) WHERE reason IS NOT NULL""")
def _(f: Feeds) -> DataFrame:
    muted = f.stations.withColumn("pm25", F.when(~F.col("station_id").endswith("7"), F.col("pm25") * 0.1))
    return audit.sensor_flags(f.field, muted, f.wards)


@query("b3_placement_recommendations", "SELECT city, rank, 'Ward ' || ward_id || ', cell ' || cell || ': PM2.5 of about ' || satellite_signal || ' µg/m³ that no station measures. A site for a new one.' AS recommendation FROM spot_rank WHERE rank <= 5")
def _(f: Feeds) -> DataFrame:
    return audit.placement_recommendations(_dark_spots(f), 5)


@query("b3_audit_counts", f"SELECT city, count(*) AS n_cells, any_value(k) AS n_monitored, {rnd('any_value(e)', 1)} AS elevated_threshold_pm25 FROM level JOIN edge USING (city) JOIN (SELECT city, count(DISTINCT cell) AS k FROM stations GROUP BY ALL) USING (city) GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return audit.audit_counts(f.field, f.stations)


@query("b4_offender_registry", f"SELECT city, ward_id, primary_source AS source, count(*) AS count, max(confidence) AS max_confidence, {ts('max(ts)')} AS last_seen, CASE WHEN count(*) >= 5 THEN 'chronic' WHEN count(*) >= 3 THEN 'memo' ELSE 'advisory' END AS tier FROM named GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return audit.offender_registry(f.named).withColumn("last_seen", text_ts("last_seen"))


# ------------------------------------------------------------------- Q serving


@query("q1_stations_latest", f"SELECT city, station_id, cell, {sfx('lat')} AS lat, {sfx('lon')} AS lon, {rnd('pm25', 1)} AS pm25, {ts('ts')} AS ts FROM stations QUALIFY row_number() OVER (PARTITION BY city, station_id ORDER BY ts DESC, pm25 DESC) = 1")
def _(f: Feeds) -> DataFrame:
    s = serving.stations_latest(f.stations)
    return s.withColumns({"lat": fx("lat"), "lon": fx("lon"), "ts": text_ts("ts")})


@query("q2_satellite_median", f"SELECT city, cell, {rnd(med('no2_col'), 2)} AS no2 FROM satellite GROUP BY ALL HAVING count(no2_col) > 0")
def _(f: Feeds) -> DataFrame:
    return serving.satellite_median(f.satellite)


@query("q3_fires_list", f"SELECT city, {ts('ts')} AS ts, {sfx('lat')} AS lat, {sfx('lon')} AS lon, {rnd('frp', 2)} AS frp, confidence FROM fires")
def _(f: Feeds) -> DataFrame:
    return serving.fires_list(f.fires).withColumns({"ts": text_ts("ts"), "lat": fx("lat"), "lon": fx("lon")})


@query("q4_lookups", "SELECT 'attribution' AS doc, city, cell::VARCHAR AS id, primary_source AS v FROM named WHERE cell = (SELECT min(cell) FROM named) UNION ALL SELECT 'memo', city, memo_id, subject FROM memo_rows WHERE action_id = 'A03' UNION ALL SELECT 'ward', city, ward_id, risk_tier FROM adv WHERE ward_id = 'W007'")
def _(f: Feeds) -> DataFrame:
    cell = f.named.agg(F.min("cell")).first()[0]
    a = serving.lookup_row(f.named, cell=cell).select(F.lit("attribution").alias("doc"), "city", F.col("cell").cast("string").alias("id"), F.col("primary_source").alias("v"))
    m = serving.memo_by_id(_memos(f), "A03").select(F.lit("memo"), "city", "memo_id", "subject")
    w = serving.lookup_row(advisory.ward_advisory(_inputs(f)), ward_id="W007").select(F.lit("ward"), "city", "ward_id", "risk_tier")
    return a.union(m).union(w)


cte("cmp_skill", """SELECT city, horizon, round_even((1 - rd / rp) * 1000e0, 0) / 10e0 AS skill FROM (SELECT city, horizon, sqrt(avg((y - persistence) * (y - persistence))) AS rp, sqrt(avg((y - diurnal) * (y - diurnal))) AS rd FROM evalset WHERE is_test GROUP BY ALL)""")
cte("cmp", f"""SELECT h.city, hotspot_cells, zones, enforceable_cells, named, mean_confidence, s.*  EXCLUDE (city), a.n AS actions_queued, w.n AS advisory_wards FROM (SELECT city, count(*) AS hotspot_cells, count(DISTINCT zone_id) AS zones, count(*) FILTER (WHERE attributable) AS enforceable_cells FROM hot GROUP BY ALL) h
  LEFT JOIN (SELECT city, count(*) AS named, {rnd('avg(confidence)', 3)} AS mean_confidence FROM named GROUP BY ALL) n USING (city) LEFT JOIN (SELECT city, {', '.join(f'max(skill) FILTER (WHERE horizon = {h}) AS skill_h{h}' for h in (24, 48, 72))} FROM cmp_skill GROUP BY ALL) s USING (city)
  LEFT JOIN (SELECT city, count(*) AS n FROM queue GROUP BY ALL) a USING (city) LEFT JOIN (SELECT city, count(*) AS n FROM adv GROUP BY ALL) w USING (city)""")


def _comparison(f: Feeds) -> DataFrame:
    test = forecast.evaluation_frame(f.labelled).where("is_test")
    # The diurnal baseline stands in for the model, so that the row has an exact twin.
    s = forecast.score_forecast(test, "diurnal").select("city", "horizon", "skill_vs_persistence_pct")
    # Leaving stations out, the mean of the others stands in for the model in the same way.
    left = exposure.others_mean(f.labelled).where("others IS NOT NULL")
    r2 = left.groupBy("city").agg(round_to(stats.r_squared(F.col("pm25_station"), F.col("others")), 3).alias("r2"))
    return serving.city_comparison(f.hot, f.named, s, r2, f.queue, advisory.ward_advisory(_inputs(f)))


@query("q5_city_comparison", f"""SELECT cmp.*, b.by_source, {rnd('r2', 3)} AS fusion_loso_r2 FROM cmp
  LEFT JOIN (SELECT city, string_agg(primary_source || '=' || n, ',' ORDER BY primary_source) AS by_source FROM (SELECT city, primary_source, count(*) AS n FROM named GROUP BY ALL) GROUP BY city) b USING (city)
  LEFT JOIN (SELECT city, 1 - sum(power(pm25_station - (s - pm25_station) / (k - 1), 2)) / nullif(var_pop(pm25_station) * count(*), 0) AS r2
    FROM lab JOIN (SELECT city, ts, sum(pm25_station) AS s, count(*) AS k FROM lab GROUP BY ALL) USING (city, ts) WHERE k > 1 GROUP BY city) l USING (city)""")
def _(f: Feeds) -> DataFrame:
    named = F.transform(F.map_entries("by_source"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return _comparison(f).withColumn("by_source", F.array_join(named, ","))


@query("q9_skill_narrative", "SELECT count(*) FILTER (WHERE coalesce(skill_h24, 0) < 0) AS h24_losses, count(*) FILTER (WHERE coalesce(skill_h72, 0) > 0) AS h72_wins, count(*) AS cities FROM cmp")
def _(f: Feeds) -> DataFrame:
    return serving.skill_narrative(_comparison(f))


def _upper(x: str) -> str:
    v = f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))"
    return f"{v}[len({v}) // 2 + 1]"


cte("layer", f"SELECT city, cell, coalesce(ward_id, 'unassigned') AS ward_id, {rnd('pm25_hat', 1)} AS pm25 FROM field_now LEFT JOIN wards USING (city, cell)")


def _layer(f: Feeds) -> DataFrame:
    from hazegrid.operators.exposure import field_snapshot

    return field_snapshot(f.field, f.wards)


@query("q6_city_snapshot", f"SELECT city, pm25, {aqi('pm25')} AS aqi FROM (SELECT city, {_upper('pm25')} AS pm25 FROM layer GROUP BY ALL)")
def _(f: Feeds) -> DataFrame:
    return serving.city_snapshot(_layer(f))


@query("q6_worst_wards", f"SELECT city, ward_id, pm25, row_number() OVER (PARTITION BY city ORDER BY pm25 DESC, ward_id)::INTEGER AS rank FROM (SELECT city, ward_id, {_upper('pm25')} AS pm25 FROM layer WHERE ward_id <> 'unassigned' GROUP BY ALL) QUALIFY rank <= 6")
def _(f: Feeds) -> DataFrame:
    return serving.worst_wards(_layer(f), 6)


@query("q7_ward_now_and_horizons", f"""SELECT n.city, n.ward_id, {aqi('n.v')} AS aqi_now, {', '.join(f'{aqi(f"h.v{h}")} AS aqi_{h}h' for h in (24, 48, 72))} FROM (SELECT city, ward_id, {_upper('pm25')} AS v FROM layer GROUP BY ALL) n
  LEFT JOIN (SELECT city, ward_id, {', '.join(f'max(v) FILTER (WHERE horizon_h = {h}) AS v{h}' for h in (24, 48, 72))} FROM (SELECT city, ward_id, horizon_h, {_upper('pm25_hat')} AS v FROM forecast JOIN layer USING (city, cell) GROUP BY ALL) GROUP BY ALL) h USING (city, ward_id)""")
def _(f: Feeds) -> DataFrame:
    return serving.ward_now_and_horizons(_layer(f), f.forecast)


cte("wz_zone", "SELECT DISTINCT city, ward_id, zone_id FROM hot")
cte("votes", "SELECT z.city, z.ward_id, n.primary_source AS src, count(*) AS n, max(n.confidence) AS best FROM wz_zone z JOIN named n ON n.city = z.city AND n.zone_id = z.zone_id GROUP BY ALL")
cte("monitor_km", f"SELECT c.city, w.ward_id, min({hav('c.lat', 'c.lon', 's.lat', 's.lon')}) AS km FROM cells c JOIN wards w ON w.city = c.city AND w.cell = c.cell JOIN (SELECT DISTINCT city, lat, lon FROM stations) s ON s.city = c.city GROUP BY ALL")


@query("q8_ward_accountability", f"""SELECT w.city, w.ward_id, coalesce(h.n, 0) AS n_hotspots, coalesce(h.e, FALSE) AS enforceable, d.src AS dominant_source, d.n AS n_dominant, d.best AS best_confidence, d.total::BIGINT AS n_attributed, coalesce(a.n, 0) AS n_actions, coalesce(m.n, 0) AS n_memos, {sfx('k.km')} AS nearest_monitor_km
  FROM (SELECT DISTINCT city, ward_id FROM wards) w LEFT JOIN (SELECT city, ward_id, count(*) AS n, bool_or(attributable) AS e FROM hot GROUP BY ALL) h USING (city, ward_id)
  LEFT JOIN (SELECT *, sum(n) OVER (PARTITION BY city, ward_id) AS total FROM votes QUALIFY row_number() OVER (PARTITION BY city, ward_id ORDER BY n DESC, best DESC, src) = 1) d USING (city, ward_id)
  LEFT JOIN (SELECT z.city, z.ward_id, count(*) AS n FROM wz_zone z JOIN queue q ON q.city = z.city AND q.zone_id = z.zone_id GROUP BY ALL) a USING (city, ward_id)
  LEFT JOIN (SELECT z.city, z.ward_id, count(*) AS n FROM wz_zone z JOIN memo_rows q ON q.city = z.city AND q.zone_id = z.zone_id GROUP BY ALL) m USING (city, ward_id) LEFT JOIN monitor_km k USING (city, ward_id)""")
def _(f: Feeds) -> DataFrame:
    out = serving.ward_accountability(f.wards, f.hot, f.named, f.queue, _memos(f), f.stations, GRID)
    return out.withColumn("nearest_monitor_km", fx("nearest_monitor_km"))


@query("q10_forecast_layer", "SELECT city, cell, coalesce(ward_id, 'unassigned') AS ward_id, pm25_hat AS pm25, 48 AS h FROM forecast LEFT JOIN wards USING (city, cell) WHERE horizon_h = 48 UNION ALL SELECT city, cell, ward_id, pm25, 0 FROM layer")
def _(f: Feeds) -> DataFrame:
    ahead = serving.forecast_layer(_layer(f), f.forecast, f.wards, 48).withColumn("h", F.lit(48))
    return ahead.unionByName(serving.forecast_layer(_layer(f), f.forecast, f.wards, 0).withColumn("h", F.lit(0)))


@query("q11_min_max_scale", f"SELECT l.city, l.cell, l.pm25, {sfx('CASE WHEN hi > lo THEN (pm25 - lo) / (hi - lo) ELSE 0.5e0 END')} AS t FROM layer l JOIN (SELECT city, min(pm25) AS lo, max(pm25) AS hi FROM layer GROUP BY ALL) USING (city)")
def _(f: Feeds) -> DataFrame:
    return serving.min_max_scale(_layer(f), "pm25").select("city", "cell", "pm25", fx("t").alias("t"))


# ---------------------------------------------------------------- X evaluation

_CAT = ["industrial", "construction", "waste_burning", "traffic"]
cte("sources", f"""SELECT r_name AS city, s_name AS name, {pick(_CAT, 's_suppkey % 4')} AS kind, s_suppkey % 3 = 0 AS registered, 28.45e0 + 0.01e0 * (s_suppkey * 11 % 30) + 0.004e0 AS lat, 76.95e0 + 0.01e0 * (s_suppkey * 11 // 30 % 40) + 0.003e0 AS lon
  FROM supplier JOIN region ON r_regionkey = least(4, greatest(0, floor((28.45e0 + 0.01e0 * (s_suppkey * 11 % 30) + 0.004e0 - 28.45e0) / 0.06e0)))::INTEGER""")
cte("truth", f"""SELECT city, cell, ts, pm25_station + (cell % 7) - 3e0 AS pm25_true, {', '.join(f'((cell + {i}) % 5)::DOUBLE * pm25_station / 50e0 AS c_{c}' for i, c in enumerate(_CAT))},
  CASE WHEN cell % 9 = 0 THEN 'none' ELSE 'S' || (hour(ts) % 3) END AS top_source, pm25_station AS top_source_val, hour(ts) % 3 = 0 AS top_source_registered FROM lab""")


def _sources(f: Feeds) -> DataFrame:
    k = F.col("s_suppkey")
    s = f.table("supplier").select(
        F.col("s_name").alias("name"),
        F.get(F.array(*[F.lit(c) for c in _CAT]), (k % 4).cast("int")).alias("kind"),
        (k % 3 == 0).alias("registered"),
        (F.lit(28.45) + F.lit(0.01) * (k * 11 % 30) + 0.004).alias("lat"),
        (F.lit(76.95) + F.lit(0.01) * (F.floor(k * 11 / 30) % 40) + 0.003).alias("lon"),
    )
    return f.with_city(s)


def _truth(f: Feeds) -> DataFrame:
    c, v = F.col("cell"), F.col("pm25_station")
    return f.labelled.select(
        "city", "cell", "ts", (v + c % 7 - 3.0).alias("pm25_true"),
        *[(((c + i) % 5).cast("double") * v / 50.0).alias(f"c_{k}") for i, k in enumerate(_CAT)],
        F.when(c % 9 == 0, "none").otherwise(F.concat(F.lit("S"), (F.hour("ts") % 3).cast("string"))).alias("top_source"),
        v.alias("top_source_val"), (F.hour("ts") % 3 == 0).alias("top_source_registered"),
    )


_shot = hav(lat_c("h.cell"), lon_c("h.cell"), "s.lat", "s.lon")
cte("hits", f"""SELECT s.city, s.name, s.kind, s.registered, b.cell, b.km AS hit_km, n.primary_source AS attributed_as, b.cell IS NOT NULL AS detected, coalesce(n.primary_source = s.kind, FALSE) AS correct,
  CASE s.kind WHEN 'waste_burning' THEN 'direct (thermal fire)' WHEN 'construction' THEN 'no tracer at all' ELSE 'NO2, confounded' END AS tier FROM sources s
  LEFT JOIN (SELECT s.city, s.name, min_by(h.cell, ({_shot}, h.cell)) AS cell, min({_shot}) AS km FROM sources s JOIN hot h USING (city) WHERE {_shot} <= 2e0 GROUP BY ALL) b USING (city, name) LEFT JOIN named n ON n.city = s.city AND n.cell = b.cell""")


def _hits(f: Feeds) -> DataFrame:
    return evaluate.detection_hits(_sources(f), f.hot, f.named, GRID)


@query("x1_detection_hits", f"SELECT city, name, kind, registered, cell, {sfx('hit_km')} AS hit_km, attributed_as, detected, correct, tier FROM hits")
def _(f: Feeds) -> DataFrame:
    return _hits(f).withColumn("hit_km", fx("hit_km"))


@query("x1_detection_recall", "SELECT city, tier, registered, count(*) AS n, count(*) FILTER (WHERE detected) AS found, count(*) FILTER (WHERE correct) AS named FROM hits GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return evaluate.detection_recall(_hits(f))


@query("x2_zone_precision", f"""SELECT city, zone_id, count(*) AS n_cells, bool_or(attributable) AS attributable, {sfx('min(km)')} AS min_km, coalesce(min(km) <= 2, FALSE) AS hit, count(*) FILTER (WHERE attributable AND km <= 2) AS cells_hit
  FROM hot JOIN (SELECT h.city, h.cell, min({_shot}) AS km FROM hot h LEFT JOIN sources s USING (city) GROUP BY ALL) USING (city, cell) GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    return evaluate.zone_precision(f.hot, _sources(f), GRID).withColumn("min_km", fx("min_km"))


_sst = hav(lat_c("m.cell"), lon_c("m.cell"), "s.lat", "s.lon")


@query("x3_near_station", f"SELECT s.city, count(*) AS n, count(k.name) AS n_near FROM sources s LEFT JOIN (SELECT DISTINCT s.city, s.name FROM sources s JOIN (SELECT DISTINCT city, cell FROM stations) m USING (city) WHERE {_sst} <= 2e0) k USING (city, name) GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return evaluate.near_station(_sources(f), f.stations, GRID)


cte("trows", "SELECT t.*, n.kind FROM truth t JOIN named n USING (city, cell) WHERE t.ts > n.ts - to_hours(CASE n.kind WHEN 'acute' THEN 24 WHEN 'emerging' THEN 168 ELSE 720 END) AND t.ts <= n.ts")
cte("tlab", f"""SELECT m.city, m.cell, CASE greatest({', '.join(f'm_{c}' for c in _CAT)}) {' '.join(f"WHEN m_{c} THEN '{c}'" for c in _CAT)} END AS true_source, coalesce(r, 0) = 1 AS registered
  FROM (SELECT city, cell, {', '.join(f'avg(c_{c}) AS m_{c}' for c in _CAT)} FROM trows GROUP BY ALL) m LEFT JOIN (SELECT city, cell, min_by(r, (-w, top_source)) AS r FROM (SELECT city, cell, top_source, sum(top_source_val) AS w, max(top_source_registered::INTEGER) AS r FROM trows WHERE top_source <> 'none' GROUP BY ALL) GROUP BY ALL) USING (city, cell)
  WHERE greatest({', '.join(f'm_{c}' for c in _CAT)}) > 1""")
cte("scored", "SELECT n.city, n.cell, n.kind, n.primary_source AS predicted, n.confidence, t.true_source, t.registered, n.primary_source = t.true_source AS hit FROM named n JOIN tlab t USING (city, cell)")


def _scored(f: Feeds) -> DataFrame:
    return evaluate.scored_attributions(f.named, evaluate.truth_labels(f.named, _truth(f)))


@query("x4_truth_labels", "SELECT * FROM tlab")
def _(f: Feeds) -> DataFrame:
    return evaluate.truth_labels(f.named, _truth(f))


@query("x5_attribution_accuracy", f"""SELECT city, slice, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, {sfx('avg(hit::INTEGER)')} AS accuracy FROM (SELECT city, hit, unnest(['overall', CASE WHEN registered THEN 'registered' ELSE 'unregistered' END, 'kind=' || kind]) AS slice FROM scored) GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    return evaluate.attribution_accuracy(_scored(f)).withColumn("accuracy", fx("accuracy"))


@query("x5_confidence_calibration", f"SELECT city, {sfx(med('confidence', 'hit'))} AS median_hit, {sfx(med('confidence', 'NOT hit'))} AS median_miss, count(*) FILTER (WHERE confidence >= 0.7e0) AS n_sure, {sfx('avg(hit::INTEGER) FILTER (WHERE confidence >= 0.7e0)')} AS precision_sure FROM scored GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    c = evaluate.confidence_calibration(_scored(f))
    return c.withColumns({x: fx(x) for x in ("median_hit", "median_miss", "precision_sure")})


@query("x5_confusion", f"SELECT city, true_source, {', '.join(f"count(*) FILTER (WHERE predicted = '{c}') AS {c}" for c in _CAT)} FROM scored GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    return evaluate.confusion(_scored(f))


_hotq = "pm25_true >= e"


@query("x6_exposure_error", f"""SELECT city, count(*) AS n, {sfx('sqrt(avg(power(pm25_true - pm25_hat, 2)))')} AS rmse_field, {sfx('sqrt(avg(power(pm25_true - nv, 2)))')} AS rmse_naive, count(*) FILTER (WHERE {_hotq}) AS n_hot, {sfx(f'sqrt(avg(power(pm25_true - pm25_hat, 2)) FILTER (WHERE {_hotq}))')} AS hot_rmse_field,
  {sfx(f'sqrt(avg(power(pm25_true - nv, 2)) FILTER (WHERE {_hotq}))')} AS hot_rmse_naive, {sfx(f'avg(pm25_hat - pm25_true) FILTER (WHERE {_hotq})')} AS hot_bias_field, {sfx(f'avg(nv - pm25_true) FILTER (WHERE {_hotq})')} AS hot_bias_naive
  FROM (SELECT t.city, t.pm25_true, f.pm25_hat, s.nv FROM truth t JOIN field f USING (city, cell, ts) LEFT JOIN (SELECT city, date_trunc('hour', ts) AS ts, avg(pm25) AS nv FROM stations GROUP BY ALL) s USING (city, ts)) x
  JOIN (SELECT city, {quant('pm25_true', 0.9)} AS e FROM truth JOIN field USING (city, cell, ts) GROUP BY ALL) USING (city) GROUP BY ALL""")
def _(f: Feeds) -> DataFrame:
    e = evaluate.exposure_error(_truth(f), f.field, f.stations)
    return e.select("city", "n", "n_hot", *[fx(c).alias(c) for c in e.columns if c not in ("city", "n", "n_hot")])


cte("scen_hits", f"""SELECT s.city, sc, s.name, count(h.cell) > 0 AS detected FROM sources s CROSS JOIN (SELECT unnest([0, 1, 2]) AS sc) LEFT JOIN hot h ON h.city = s.city AND (sc = 0 OR h.cell % 3 <> sc) AND {_shot} <= 2e0 GROUP BY ALL""")


@query("x7_recall_invariance", "SELECT city, count(*) AS n_scenarios, min(found) AS min_found, max(found) AS max_found, count(DISTINCT found) = 1 AS invariant FROM (SELECT city, sc, count(*) FILTER (WHERE detected) AS found FROM scen_hits GROUP BY ALL) GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    src, parts = _sources(f), None
    for sc in range(3):
        hot = f.hot if sc == 0 else f.hot.where(F.col("cell") % 3 != sc)
        part = evaluate.detection_hits(src, hot, f.named, GRID).withColumn("scenario", F.lit(sc))
        parts = part if parts is None else parts.unionByName(part)
    return evaluate.recall_invariance(parts)
