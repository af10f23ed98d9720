"""Boosted regression trees of Spark's ML library: one model for each city, each fit and each score distributed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.session import materialise, shared_dir

#: Fits that run side by side: each is a chain of short jobs that leaves a cluster partly idle.
AT_ONCE = 8
#: A missing input: below every value, so a split can set it apart.
MISSING = -1e12

Models = Mapping[str, GBTRegressionModel]


def _vectors(rows: DataFrame, inputs: Sequence[str], out: str = "_inputs") -> DataFrame:
    """Add the inputs as one vector; missing values and NaN become ``MISSING``."""
    number = lambda c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(MISSING)), F.lit(MISSING)).alias(f"_in_{c}")
    named = rows.select("*", *[number(c) for c in inputs])
    columns = [f"_in_{c}" for c in inputs]
    return VectorAssembler(inputCols=columns, outputCol=out).transform(named).drop(*columns)


def fit_by_city(rows: DataFrame, inputs: Sequence[str], label: str, settings: Mapping, least: int = 1) -> dict[str, GBTRegressionModel]:
    """A model for each city with at least ``least`` labelled rows.

    Rows are written once, cut by city; a fit reads its own city and spreads its rows over the cluster. ``settings`` are
    those of GBTRegressor. The driver holds the trees alone, and cities are as many as a run is asked for.
    """
    spark = rows.sparkSession
    shared_dir(spark)  # boosting cuts its lineage with checkpoints
    used = rows.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))).select("city", *inputs, F.col(label).cast("double").alias("_y"))
    table = materialise(used, "city")
    cities = [r.city for r in table.groupBy("city").count().where((F.col("count") >= least) & F.col("city").isNotNull()).orderBy("city").collect()]
    learner = GBTRegressor(featuresCol="_inputs", labelCol="_y", seed=7, **settings)

    def fit(city: str) -> GBTRegressionModel:
        own = table.where(F.col("city") == city)
        return learner.fit(_vectors(own, inputs).select("_inputs", "_y"))

    if not cities:
        return {}
    with ThreadPool(min(AT_ONCE, len(cities))) as pool:
        return dict(zip(cities, pool.map(inheritable_thread_target(spark)(fit), cities), strict=True))


def score_by_city(rows: DataFrame, models: Models, inputs: Sequence[str], out: str = "pred") -> DataFrame:
    """``rows`` with the prediction of their city's model; a city without a model has no rows in the result.

    Trees are shared with the tasks once; rows do not move.
    """
    parts = []
    for city, model in models.items():
        own = _vectors(rows.where(F.col("city") == city), inputs)
        parts.append(model.setPredictionCol(out).transform(own).drop("_inputs"))
    if not parts:
        return rows.limit(0).withColumn(out, F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, parts)


def importances(spark: SparkSession, models: Models, inputs: Sequence[str]) -> DataFrame:
    """(city, position, feature, weight): share of each input in the gain of its city's trees."""
    rows = [(city, i, inputs[i], float(w)) for city, m in models.items() for i, w in enumerate(m.featureImportances.toArray())]
    return spark.createDataFrame(rows, "city string, position int, feature string, weight double")
