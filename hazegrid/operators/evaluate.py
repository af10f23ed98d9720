"""Scoring of detection, attribution and exposure against supplied truth tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions.geo import Grid
from hazegrid.functions.stats import exact_quantiles, rmse
from hazegrid.operators.attribution import CATEGORIES, window_of
from hazegrid.operators.hotspots import lookup
from hazegrid.operators.spatial import add_centre, nearest, within_km

# What each instrument tier can physically see.
NEAR_KM = 2.0
MIN_DOMINANT = 1.0
TIERS = {
    "waste_burning": "direct (thermal fire)",
    "industrial": "NO2, confounded",
    "traffic": "NO2, confounded",
    "construction": "no tracer at all",
}


def detection_hits(sources: DataFrame, hotspots: DataFrame, attributions: DataFrame, grid: Grid = Grid(), km: float = NEAR_KM) -> DataFrame:
    """Per source: detected, the closest hit, the name it was given, whether that is right."""
    hot = add_centre(hotspots.select("city", "cell").distinct(), grid)
    near = within_km(hot, sources.select("city", "name", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")), km)
    best = near.groupBy("city", "name").agg(F.min_by("cell", F.struct("dist_km", "cell")).alias("cell"), F.min("dist_km").alias("hit_km"))
    named = attributions.select("city", "cell", F.col("primary_source").alias("attributed_as"))
    return (
        sources.select("city", "name", "kind", "registered")
        .join(best, ["city", "name"], "left")
        .join(named, ["city", "cell"], "left")
        .withColumn("detected", F.col("cell").isNotNull())
        .withColumn("correct", F.coalesce(F.col("attributed_as") == F.col("kind"), F.lit(False)))
        .withColumn("tier", lookup(F.col("kind"), TIERS))
    )


def detection_recall(hits: DataFrame) -> DataFrame:
    """(city, tier, registered, n, found, named)."""
    return hits.where("tier is not null").groupBy("city", "tier", "registered").agg(
        F.count("*").alias("n"), F.count_if(F.col("detected")).alias("found"), F.count_if(F.col("correct")).alias("named")
    )


def zone_precision(hotspots: DataFrame, sources: DataFrame, grid: Grid = Grid(), km: float = NEAR_KM) -> DataFrame:
    """(city, zone_id, n_cells, attributable, min_km, hit, cells_hit): is a real source in the zone's reach?"""
    src = sources.select("city", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    near = nearest(add_centre(hotspots.select("city", "cell", "zone_id", "attributable"), grid), src, ["cell"])
    return near.groupBy("city", "zone_id").agg(
        F.count("*").alias("n_cells"),
        F.bool_or("attributable").alias("attributable"),
        F.min("nearest_km").alias("min_km"),
        F.coalesce(F.min("nearest_km") <= km, F.lit(False)).alias("hit"),
        F.count_if(F.col("attributable") & (F.col("nearest_km") <= km)).alias("cells_hit"),
    )


def near_station(sources: DataFrame, stations: DataFrame, grid: Grid = Grid(), km: float = NEAR_KM) -> DataFrame:
    """(city, n, n_near): sources within reach of the centre of a monitored cell."""
    sites = add_centre(stations.select("city", "cell").distinct(), grid)
    pairs = within_km(sites, sources.select("city", "name", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")), km)
    seen = pairs.select("city", "name").distinct().withColumn("_near", F.lit(True))
    return sources.join(seen, ["city", "name"], "left").groupBy("city").agg(
        F.count("*").alias("n"), F.count("_near").alias("n_near")
    )


def truth_labels(attributions: DataFrame, truth: DataFrame) -> DataFrame:
    """(city, cell, true_source, registered): the dominant contribution over the verdict's own window.

    ``attributions`` holds city, cell, ts, kind. Cells that are only background are dropped.
    """
    asked = attributions.select("city", "cell", F.col("ts").alias("at"), "kind")
    rows = truth.join(asked, ["city", "cell"]).where(window_of(F.col("kind"), F.col("ts"), F.col("at")))
    means = rows.groupBy("city", "cell").agg(*[F.avg(f"c_{c}").alias(c) for c in CATEGORIES])
    top = F.greatest(*CATEGORIES)
    name = None
    for c in CATEGORIES:
        name = F.when(F.col(c) == top, c) if name is None else name.when(F.col(c) == top, c)
    label = means.where(top > MIN_DOMINANT).select("city", "cell", name.alias("true_source"))
    winners = (
        rows.where("top_source <> 'none'")
        .groupBy("city", "cell", "top_source")
        .agg(F.sum("top_source_val").alias("w"), F.max(F.col("top_source_registered").cast("int")).alias("r"))
        .groupBy("city", "cell")
        .agg(F.min_by("r", F.struct(-F.col("w"), F.col("top_source"))).alias("r"))
    )
    return label.join(winners, ["city", "cell"], "left").select(
        "city", "cell", "true_source", (F.coalesce("r", F.lit(0)) == 1).alias("registered")
    )


def scored_attributions(attributions: DataFrame, labels: DataFrame) -> DataFrame:
    return attributions.select("city", "cell", "kind", F.col("primary_source").alias("predicted"), "confidence").join(
        labels, ["city", "cell"]
    ).withColumn("hit", F.col("predicted") == F.col("true_source"))


def attribution_accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy overall, by registration and by kind, in one pass over stacked slices."""
    slices = F.explode(
        F.array(
            F.lit("overall"),
            F.when(F.col("registered"), "registered").otherwise("unregistered"),
            F.concat(F.lit("kind="), "kind"),
        )
    )
    return scored.select("city", "hit", slices.alias("slice")).groupBy("city", "slice").agg(
        F.count("*").alias("n"), F.count_if(F.col("hit")).alias("hits"), F.avg(F.col("hit").cast("double")).alias("accuracy")
    )


def confidence_calibration(scored: DataFrame, sure: float = 0.7) -> DataFrame:
    """Median confidence of hits and misses; precision at or above ``sure``."""
    certain = F.col("confidence") >= sure
    return scored.groupBy("city").agg(
        F.median(F.when(F.col("hit"), F.col("confidence"))).alias("median_hit"),
        F.median(F.when(~F.col("hit"), F.col("confidence"))).alias("median_miss"),
        F.count_if(certain).alias("n_sure"),
        F.avg(F.when(certain, F.col("hit").cast("double"))).alias("precision_sure"),
    )


def confusion(scored: DataFrame) -> DataFrame:
    return scored.groupBy("city", "true_source").pivot("predicted", CATEGORIES).count().na.fill(0, CATEGORIES)


def exposure_error(truth: DataFrame, field: DataFrame, stations: DataFrame, worst: float = 0.90) -> DataFrame:
    """RMSE and bias of the field and of the hourly station mean, overall and on the worst decile."""
    naive = stations.groupBy("city", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("pm25").alias("pm25_naive"))
    df = truth.select("city", "cell", "ts", "pm25_true").join(field.select("city", "cell", "ts", "pm25_hat"), ["city", "cell", "ts"])
    df = df.join(naive, ["city", "ts"], "left")
    edge = exact_quantiles(df, ["city"], "pm25_true", {"edge": worst})
    hot = F.col("pm25_true") >= F.col("edge")
    t, f, n = F.col("pm25_true"), F.col("pm25_hat"), F.col("pm25_naive")
    return df.join(F.broadcast(edge), "city").groupBy("city").agg(
        F.count("*").alias("n"),
        rmse(t, f).alias("rmse_field"),
        rmse(t, n).alias("rmse_naive"),
        F.count_if(hot).alias("n_hot"),
        rmse(F.when(hot, t), f).alias("hot_rmse_field"),
        rmse(F.when(hot, t), n).alias("hot_rmse_naive"),
        F.avg(F.when(hot, f - t)).alias("hot_bias_field"),
        F.avg(F.when(hot, n - t)).alias("hot_bias_naive"),
    )


def recall_invariance(hits: DataFrame) -> DataFrame:
    """(city, n_scenarios, min_found, max_found, invariant) over hits carrying a scenario column."""
    per = hits.groupBy("city", "scenario").agg(F.count_if(F.col("detected")).alias("found"))
    return per.groupBy("city").agg(
        F.count("*").alias("n_scenarios"),
        F.min("found").alias("min_found"),
        F.max("found").alias("max_found"),
        (F.countDistinct("found") == 1).alias("invariant"),
    )
