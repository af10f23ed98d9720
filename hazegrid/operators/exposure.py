"""Exposure field: citywide baseline plus a boosted-tree residual, and its honest checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions.geo import round_to
from hazegrid.functions.stats import r_squared, rmse
from hazegrid.operators.trees import Models, fit_by_city, importances, score_by_city
from hazegrid.session import materialise

# Model inputs.
FEATURES = [
    "no2_col", "wind_from_deg", "wind_ms", "blh_m", "temp_c", "fires_6h", "frp_6h",
    "lu_industrial", "lu_construction", "lu_waste_burning", "lu_traffic", "lu_road", "hour", "dow",
]
LABEL = "pm25_station"
FIELD_SETTINGS = {"maxIter": 20, "maxDepth": 6, "stepSize": 0.2, "subsamplingRate": 0.8, "minInstancesPerNode": 40, "maxBins": 64}
HOLDOUT_SETTINGS = FIELD_SETTINGS | {"maxIter": 8, "maxDepth": 5}


def labelled(panel: DataFrame) -> DataFrame:
    return panel.where(F.col(LABEL).isNotNull())


def city_baseline(lab: DataFrame) -> DataFrame:
    """(city, ts, baseline): median over the stations of the hour."""
    return lab.groupBy("city", "ts").agg(F.median(LABEL).alias("baseline"))


def residual_target(lab: DataFrame, baseline: DataFrame) -> DataFrame:
    return lab.join(baseline, ["city", "ts"]).withColumn("resid", F.col(LABEL) - F.col("baseline"))


def fit_field(lab: DataFrame, **settings) -> tuple[Models, DataFrame]:
    """(models, baseline): the deviation from the city's hourly median, learned city by city."""
    baseline = city_baseline(lab)
    return fit_by_city(residual_target(lab, baseline), FEATURES, "resid", FIELD_SETTINGS | settings), baseline


def predict_field(models: Models, panel: DataFrame, baseline: DataFrame) -> DataFrame:
    """(city, cell, ts, pm25_hat): baseline of the hour (else the median of the city's) plus residual."""
    typical = baseline.groupBy("city").agg(F.median("baseline").alias("_typical"))
    scored = score_by_city(panel.select("city", "cell", "ts", *FEATURES), models, FEATURES)
    joined = scored.join(baseline, ["city", "ts"], "left").join(F.broadcast(typical), "city", "left")  # one row per city
    return joined.select("city", "cell", "ts", (F.coalesce("baseline", "_typical") + F.col("pred")).alias("pm25_hat"))


def feature_importance(spark: SparkSession, models: Models, inputs: list[str] = FEATURES, top: int | None = None) -> DataFrame:
    """(city, rank, feature, weight): inputs of each city's model by their share of the gain; the ``top`` of them, or all."""
    rank = F.row_number().over(Window.partitionBy("city").orderBy(F.desc("weight"), "position"))
    out = importances(spark, models, inputs).select("city", rank.alias("rank"), "feature", "weight")
    return out if top is None else out.where(F.col("rank") <= top)


def others_mean(lab: DataFrame) -> DataFrame:
    """Add ``others``: mean of the city's other station cells that hour, from sums (null if alone)."""
    sums = lab.groupBy("city", "ts").agg(F.sum(LABEL).alias("_s"), F.count(LABEL).alias("_n"))
    others = (F.col("_s") - F.col(LABEL)) / F.nullif(F.col("_n") - 1, F.lit(0))
    return lab.join(sums, ["city", "ts"]).withColumn("others", others).drop("_s", "_n")


def naive_citymean_loso(lab: DataFrame) -> DataFrame:
    """(city, n, naive_citymean_rmse): predict each station by the mean of the others."""
    ok = others_mean(lab).where("others is not null")
    return ok.groupBy("city").agg(
        F.count("*").alias("n"), rmse(F.col(LABEL), F.col("others")).alias("naive_citymean_rmse")
    )


def others_median(lab: DataFrame) -> DataFrame:
    """Add ``others_med``: median of the city's other station cells that hour.

    With the hour's readings ranked, leaving one out shifts the middle by at most one place, so the
    row's rank and four readings around the middle of the hour are enough.
    """
    hour = Window.partitionBy("city", "ts")
    ranked = lab.withColumn("_p", F.row_number().over(hour.orderBy(LABEL, "cell")) - 1).withColumn("_m", F.count("*").over(hour) - 1)
    lo, hi = F.floor((F.col("_m") - 1) / 2), F.floor(F.col("_m") / 2)
    at = {f"_{n}": F.max(F.when(F.col("_p") == k, F.col(LABEL))).over(hour) for n, k in (("lo", lo), ("lo1", lo + 1), ("hi", hi), ("hi1", hi + 1))}
    near = ranked.withColumns(at)
    one = F.when(F.col("_p") <= lo, F.col("_lo1")).otherwise(F.col("_lo"))
    two = F.when(F.col("_p") <= hi, F.col("_hi1")).otherwise(F.col("_hi"))
    return near.withColumn("others_med", F.when(F.col("_m") > 0, one * 0.5 + two * 0.5)).drop("_p", "_m", *at)


def holdout_validation(panel: DataFrame, folds: int | None = None, **settings) -> DataFrame:
    """Leave stations out: (city, cell, n, rmse, r2, n_stations, mean_pm25, naive_citymean_rmse).

    A row for each station cell and one with a null cell for the whole city; the last three columns are the city's.
    The station cells of a city are dealt into ``folds`` parts, one station a part by default; a fit never sees the
    stations it is scored on, nor does its baseline. A fold is a filter on a column: no row is copied, and each of the
    fits is distributed. A city needs two stations at least.
    """
    lab = labelled(panel).select("city", "cell", "ts", LABEL, *FEATURES)
    order = F.row_number().over(Window.partitionBy("city").orderBy("cell")) - 1  # one row a station
    stations = lab.select("city", "cell").distinct().withColumn("_fold", order if folds is None else order % folds)
    dealt = materialise(lab.join(stations, ["city", "cell"]))
    many = dealt.groupBy("city").agg(F.countDistinct("_fold").alias("n")).where("n > 1")
    dealt = dealt.join(F.broadcast(many.select("city")), "city")  # one row per city
    parts = []
    for k in range(dealt.agg(F.coalesce(F.max("_fold"), F.lit(-1))).first()[0] + 1):
        # A city without a fold k has no rows to score, and none is fitted for it.
        test = dealt.where(F.col("_fold") == k)
        train = dealt.join(F.broadcast(test.select("city").distinct()), "city").where(F.col("_fold") != k)
        baseline = materialise(city_baseline(train))
        models = fit_by_city(residual_target(train, baseline), FEATURES, "resid", HOLDOUT_SETTINGS | settings)
        typical = baseline.groupBy("city").agg(F.median("baseline").alias("_typical"))
        scored = score_by_city(test, models, FEATURES).join(baseline, ["city", "ts"], "left").join(F.broadcast(typical), "city")
        parts.append(materialise(scored.select("city", "cell", F.col(LABEL).alias("y"), (F.coalesce("baseline", "_typical") + F.col("pred")).alias("hat"))))
    scored = reduce(DataFrame.unionByName, parts) if parts else dealt.select("city", "cell", F.col(LABEL).alias("y"), F.col(LABEL).alias("hat")).limit(0)
    scores = scored.groupingSets([("city", "cell"), ("city",)], "city", "cell").agg(
        F.count("*").alias("n"),
        round_to(rmse(F.col("y"), F.col("hat")), 2).alias("rmse"),
        round_to(r_squared(F.col("y"), F.col("hat")), 3).alias("r2"),
        F.countDistinct("cell").alias("_k"),
        F.avg("y").alias("_mean"),
    )
    whole = scores.where("cell IS NULL").select("city", F.col("_k").alias("n_stations"), round_to(F.col("_mean"), 1).alias("mean_pm25"))
    naive = naive_citymean_loso(lab).select("city", round_to(F.col("naive_citymean_rmse"), 2).alias("naive_citymean_rmse"))
    return scores.drop("_k", "_mean").join(whole, "city").join(naive, "city", "left")


def field_snapshot(field: DataFrame, wards: DataFrame, hour_offset: int = 0) -> DataFrame:
    """The field at the N-th latest hour of each city with wards, nulls dropped, 1 dp; an offset some city lacks is an error."""
    require_hour(field, hour_offset)
    hours = field.select("city", "ts").distinct()
    rank = F.row_number().over(Window.partitionBy("city").orderBy(F.desc("ts")))
    chosen = hours.withColumn("_n", rank).where(F.col("_n") == hour_offset + 1).drop("_n")
    snap = field.join(F.broadcast(chosen), ["city", "ts"]).where(F.col("pm25_hat").isNotNull() & ~F.isnan("pm25_hat"))
    return snap.join(wards.select("city", "cell", "ward_id"), ["city", "cell"], "left").select(
        "city", "ts", "cell", F.coalesce("ward_id", F.lit("unassigned")).alias("ward_id"), round_to(F.col("pm25_hat"), 1).alias("pm25")
    )


def require_hour(field: DataFrame, hour_offset: int) -> None:
    """Reject an offset outside the stored hours of any city; the message names it."""
    few = field.groupBy("city").agg(F.countDistinct("ts").alias("n")).orderBy("n", "city").first()
    most = few.n - 1 if few else -1
    if not 0 <= hour_offset <= most:
        raise ValueError(f"hour_offset must be in [0, {most}] ({few.city if few else 'no field'}); got {hour_offset}")
