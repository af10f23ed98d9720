"""The read path: point lookups, summaries and layers over the published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions.aqi import aqi
from hazegrid.functions.geo import Grid, round_to
from hazegrid.functions.stats import clean, median_upper
from hazegrid.operators.spatial import add_centre, nearest
from hazegrid.operators.wards import UNASSIGNED


def for_city(df: DataFrame, city: str) -> DataFrame:
    """City scope; prunes to one partition on tables written by city."""
    return df.where(F.col("city") == city)


def require_city(df: DataFrame, city: str, known: DataFrame) -> DataFrame:
    """Rows of ``city``, which must stand in ``known`` (a table with a city column of any length)."""
    if known.where(F.col("city") == city).isEmpty():
        some = [r["city"] for r in known.select("city").distinct().orderBy("city").limit(10).collect()]
        raise ValueError(f"unknown city {city!r}; known are {some} and perhaps more")
    scoped = for_city(df, city)
    if scoped.isEmpty():
        raise LookupError(f"no data for {city}")
    return scoped


def cities_available(df: DataFrame) -> DataFrame:
    return df.select("city").distinct()


def attribution_list(attributions: DataFrame) -> DataFrame:
    return attributions.select("city", "cell", "ward_id", "ts", "primary_source", "confidence", "reason")


def filter_hotspots(
    hotspots: DataFrame, wards: list[str] | None = None, kinds: list[str] | None = None, attributable_only: bool = False
) -> DataFrame:
    out = hotspots
    if wards:
        out = out.where(F.col("ward_id").isin(wards))
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    return out.where("attributable") if attributable_only else out


def lookup_row(df: DataFrame, **keys) -> DataFrame:
    """Rows equal on every given key."""
    cond = F.lit(True)
    for k, v in keys.items():
        cond = cond & (F.col(k) == v)
    return df.where(cond)


def memo_by_id(memos: DataFrame, key: str) -> DataFrame:
    """A memo by action, zone or memo id."""
    return memos.where((F.col("action_id") == key) | (F.col("zone_id") == key) | (F.col("memo_id") == key))


def search_wards(wards: DataFrame, text: str, top: int | None = None) -> DataFrame:
    """First real wards whose name or id contains the text, by name, ignoring case."""
    q = text.strip().lower()
    named = wards.where(~F.col("ward_id").isin("", UNASSIGNED)).select("city", "ward_id", "ward_name").distinct()
    hit = F.lower("ward_name").contains(q) | F.lower("ward_id").contains(q)
    found = named.where(hit & F.lit(bool(q))).orderBy("ward_name", "ward_id")
    return found if top is None else found.limit(top)


def stations_latest(stations: DataFrame) -> DataFrame:
    """The newest valid reading per station."""
    valid = stations.withColumn("pm25", clean(F.col("pm25"))).where("pm25 is not null")
    newest = F.max_by(F.struct("cell", "lat", "lon", "pm25"), F.struct("ts", "pm25")).alias("s")
    return valid.groupBy("city", "station_id").agg(newest, F.max("ts").alias("ts")).select(
        "city", "station_id", "s.cell", "s.lat", "s.lon", round_to(F.col("s.pm25"), 1).alias("pm25"), "ts"
    )


def satellite_median(satellite: DataFrame) -> DataFrame:
    """(city, cell, no2): median column over the days seen, 2 dp."""
    return (
        satellite.groupBy("city", "cell")
        .agg(F.median("no2_col").alias("_m"))
        .where("_m is not null")
        .select("city", "cell", round_to(F.col("_m"), 2).alias("no2"))
    )


def fires_list(fires: DataFrame) -> DataFrame:
    return fires.select("city", "ts", "lat", "lon", round_to(F.col("frp"), 2).alias("frp"), "confidence").orderBy("ts")


def city_comparison(
    hotspots: DataFrame, attributions: DataFrame, scores: DataFrame, loso: DataFrame, queue: DataFrame, advisories: DataFrame
) -> DataFrame:
    """One comparison row per city.

    ``scores`` holds (city, horizon, skill_vs_persistence_pct); ``loso`` holds (city, r2).
    """
    det = hotspots.groupBy("city").agg(
        F.count("*").alias("hotspot_cells"),
        F.countDistinct("zone_id").alias("zones"),
        F.count_if(F.col("attributable")).alias("enforceable_cells"),
    )
    by_source = (
        attributions.groupBy("city", "primary_source")
        .agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.count("confidence").alias("k"))
        .groupBy("city")
        .agg(
            F.sum("n").alias("named"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("primary_source", "n")))).alias("by_source"),
            round_to(F.sum("c") / F.sum("k"), 3).alias("mean_confidence"),
        )
    )
    skill = scores.groupBy("city").agg(
        *[F.max(F.when(F.col("horizon") == h, F.col("skill_vs_persistence_pct"))).alias(f"skill_h{h}") for h in (24, 48, 72)]
    )
    n_actions = queue.groupBy("city").agg(F.count("*").alias("actions_queued"))
    n_wards = advisories.groupBy("city").agg(F.count("*").alias("advisory_wards"))
    out = det
    for part in (by_source, skill, loso.select("city", F.col("r2").alias("fusion_loso_r2")), n_actions, n_wards):
        out = out.join(part, "city", "left")
    return out


def skill_narrative(comparison: DataFrame) -> DataFrame:
    """How many cities lose to persistence at 24 h and beat it at 72 h."""
    return comparison.agg(
        F.count_if(F.coalesce("skill_h24", F.lit(0.0)) < 0).alias("h24_losses"),
        F.count_if(F.coalesce("skill_h72", F.lit(0.0)) > 0).alias("h72_wins"),
        F.count("*").alias("cities"),
    )


def city_snapshot(layer: DataFrame) -> DataFrame:
    """(city, pm25, aqi): upper median of the layer's cells."""
    return layer.groupBy("city").agg(median_upper("pm25").alias("pm25")).withColumn("aqi", aqi(F.col("pm25")))


def worst_wards(layer: DataFrame, top: int | None = None) -> DataFrame:
    """Wards of each city by upper-median PM2.5 with their rank, all or the ``top``."""
    ward = layer.where(~F.col("ward_id").isin("", UNASSIGNED)).groupBy("city", "ward_id").agg(median_upper("pm25").alias("pm25"))
    rank = F.row_number().over(Window.partitionBy("city").orderBy(F.desc("pm25"), "ward_id"))
    ranked = ward.withColumn("rank", rank)
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def ward_now_and_horizons(layer: DataFrame, forecast: DataFrame, horizons: tuple[int, ...] = (24, 48, 72)) -> DataFrame:
    """AQI of each ward now and at the given leads, from upper medians over the ward's cells."""
    now = layer.groupBy("city", "ward_id").agg(aqi(median_upper("pm25")).alias("aqi_now"))
    cells = layer.select("city", "cell", "ward_id")
    ahead = forecast.where(F.col("horizon_h").isin(list(horizons))).join(cells, ["city", "cell"])
    med = ahead.groupBy("city", "ward_id", "horizon_h").agg(aqi(median_upper("pm25_hat")).alias("a"))
    wide = med.groupBy("city", "ward_id").agg(
        *[F.max(F.when(F.col("horizon_h") == h, F.col("a"))).alias(f"aqi_{h}h") for h in horizons]
    )
    return now.join(wide, ["city", "ward_id"], "left")


def ward_accountability(
    wards: DataFrame,
    hotspots: DataFrame,
    attributions: DataFrame,
    queue: DataFrame,
    memos: DataFrame,
    stations: DataFrame,
    grid: Grid = Grid(),
) -> DataFrame:
    """What a resident can hold the city to: hotspots, dominant source, actions, memos, nearest monitor.

    Cases are joined by the zones that touch the ward, not by the ward stamped on them.
    """
    hot = hotspots.groupBy("city", "ward_id").agg(F.count("*").alias("n_hotspots"), F.bool_or("attributable").alias("enforceable"))
    zones = hotspots.select("city", "ward_id", "zone_id").distinct()
    votes = (
        zones.join(attributions.select("city", "zone_id", "primary_source", "confidence"), ["city", "zone_id"])
        .groupBy("city", "ward_id", "primary_source")
        .agg(F.count("*").alias("n"), F.max("confidence").alias("best"))
    )
    dominant = votes.groupBy("city", "ward_id").agg(
        F.min_by(F.struct("primary_source", "n", "best"), F.struct(-F.col("n"), -F.col("best"), F.col("primary_source"))).alias("d"),
        F.sum("n").alias("n_attributed"),
    )
    n_act = zones.join(queue.select("city", "zone_id"), ["city", "zone_id"]).groupBy("city", "ward_id").agg(F.count("*").alias("n_actions"))
    n_memo = zones.join(memos.select("city", "zone_id"), ["city", "zone_id"]).groupBy("city", "ward_id").agg(F.count("*").alias("n_memos"))
    sites = stations.select("city", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")).distinct()
    cells = add_centre(wards.select("city", "cell", "ward_id"), grid)
    reach = nearest(cells, sites, ["cell"]).groupBy("city", "ward_id").agg(F.min("nearest_km").alias("nearest_monitor_km"))
    out = wards.select("city", "ward_id").distinct()
    for part in (hot, dominant, n_act, n_memo, reach):
        out = out.join(part, ["city", "ward_id"], "left")
    return out.select(
        "city", "ward_id", F.coalesce("n_hotspots", F.lit(0)).alias("n_hotspots"),
        F.coalesce("enforceable", F.lit(False)).alias("enforceable"), F.col("d.primary_source").alias("dominant_source"),
        F.col("d.n").alias("n_dominant"), F.col("d.best").alias("best_confidence"), "n_attributed",
        F.coalesce("n_actions", F.lit(0)).alias("n_actions"), F.coalesce("n_memos", F.lit(0)).alias("n_memos"),
        "nearest_monitor_km",
    )


def forecast_layer(layer: DataFrame, forecast: DataFrame, wards: DataFrame, h: int = 0) -> DataFrame:
    """The field itself at h = 0, else the forecast of that lead with its wards."""
    if h == 0:
        return layer.select("city", "cell", "ward_id", "pm25")
    ahead = forecast.where(F.col("horizon_h") == h).select("city", "cell", F.col("pm25_hat").alias("pm25"))
    return ahead.join(wards.select("city", "cell", "ward_id"), ["city", "cell"], "left").select(
        "city", "cell", F.coalesce("ward_id", F.lit(UNASSIGNED)).alias("ward_id"), "pm25"
    )


def min_max_scale(df: DataFrame, value: str, out: str = "t") -> DataFrame:
    """Scale to [0, 1] within each city; a flat layer is 0.5 everywhere."""
    edge = df.groupBy("city").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span: Column = F.col("_hi") - F.col("_lo")
    t = F.when(span > 0, (F.col(value) - F.col("_lo")) / F.nullif(span, F.lit(0.0))).otherwise(0.5)
    return df.join(F.broadcast(edge), "city").withColumn(out, t).drop("_lo", "_hi")  # one row per city
