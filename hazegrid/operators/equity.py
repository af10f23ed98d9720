"""Citizen reports read fairly: weights by access, and wards that are dirty yet silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A ward is silent when its shrunken rate of reports is below this share of its city's.
SILENT_BELOW = 0.5
#: No report counts for more than this many.
HEAVIEST = 5.0


def report_rates(reports: DataFrame, wards: DataFrame, exposure: str = "people") -> DataFrame:
    """(city, ward_id, n_reports, exposure, rate, city_rate, expected, shrunk): empirical-Bayes rates of reports by ward.

    ``wards`` holds one row per city and ward with its ``exposure`` (people, or any measure of who could report);
    reports without a known ward do not count. A ward's rate is drawn to its city's the more, the less exposure it
    has: shrunk = m + a / (a + m / e) * (rate - m), with m the city's rate and a the variance between wards beyond
    chance, both by moments over the city. With a = 0, or no exposure, shrunk is m.
    """
    counts = reports.groupBy("city", "ward_id").agg(F.count("*").alias("n_reports"))
    e = F.col("exposure")
    ward = (
        wards.select("city", "ward_id", F.col(exposure).cast("double").alias("exposure"))
        .join(counts, ["city", "ward_id"], "left")
        .withColumn("n_reports", F.coalesce("n_reports", F.lit(0)))
        .withColumn("rate", F.col("n_reports") / F.when(e > 0, e))
    )
    city = ward.where("exposure > 0").groupBy("city").agg(
        (F.sum("n_reports") / F.sum(e)).alias("city_rate"), F.sum(e).alias("_all"), F.count("*").alias("_n"), F.sum(F.col("rate") * F.col("n_reports")).alias("_square")
    )
    # sum e (r - m)^2 / sum e = sum r c / sum e - m^2: one pass.
    m = F.col("city_rate")
    between = F.greatest(F.lit(0.0), F.col("_square") / F.col("_all") - m * m - m * F.col("_n") / F.col("_all"))
    city = city.select("city", "city_rate", between.alias("between"))
    pull = F.when((e > 0) & (F.col("between") > 0), F.col("between") / (F.col("between") + m / e)).otherwise(F.lit(0.0))
    shrunk = m + pull * (F.coalesce("rate", m) - m)
    return ward.join(city, "city", "left").select(
        "city", "ward_id", "n_reports", "exposure", "rate", "city_rate", (m * e).alias("expected"), shrunk.alias("shrunk")
    )


def access_weight(access: Column, mean_access: Column, heaviest: float = HEAVIEST) -> Column:
    """Inverse of a ward's digital access, 1 at its city's mean; unknown access counts as the mean, none as ``heaviest``."""
    weight = F.when(access > 0, mean_access / F.when(access > 0, access)).otherwise(F.lit(heaviest))
    return F.when(access.isNull(), F.lit(1.0)).otherwise(F.least(weight, F.lit(heaviest)))


def equity_signal(
    reports: DataFrame, wards: DataFrame, exposure: str = "people", severe_at: float = 120.0, below: float = SILENT_BELOW, heaviest: float = HEAVIEST
) -> DataFrame:
    """Per ward: report_rates, its report weight, the weighted count, and whether it is silent.

    ``wards`` also holds access (0 to 1) and pm25 (the field's level). Silent: the field is severe and the shrunken rate
    lies below ``below`` of the city's, so a small ward with no reports by chance is not. A silent ward's missing reports
    (expected less counted) are its boost.
    """
    mean = wards.groupBy("city").agg(F.avg("access").alias("_mean"))
    rated = report_rates(reports, wards, exposure).join(wards.select("city", "ward_id", "access", "pm25"), ["city", "ward_id"]).join(mean, "city", "left")
    weight = access_weight(F.col("access"), F.col("_mean"), heaviest)
    silent = F.coalesce((F.col("pm25") >= severe_at) & (F.col("shrunk") < below * F.col("city_rate")), F.lit(False))
    out = rated.withColumns({"weight": weight, "silent": silent}).drop("_mean")
    boost = F.when(F.col("silent"), F.greatest(F.lit(0.0), F.col("expected") - F.col("n_reports"))).otherwise(F.lit(0.0))
    return out.withColumns({"weighted_reports": F.col("n_reports") * F.col("weight"), "boost": boost})
