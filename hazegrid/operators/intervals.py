"""Prediction bands from held-out errors, and how often they hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.geo import round_to
from hazegrid.functions.stats import exact_quantiles

BY = ("city", "horizon")
LOW, HIGH = 0.1, 0.9


def _rank(n: Column, p: float) -> Column:
    """Place of the conformal quantile among n sorted errors, from 0: outwards of p, counting the error to come."""
    at = (F.floor((n + 1) * p) if p < 0.5 else F.ceil((n + 1) * p)) - 1
    return F.least(F.greatest(at, F.lit(0)), n - 1).cast("double")


def error_bands(held_out: DataFrame, truth: str, guess: str, by: Sequence[str] = BY, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(by, n, low, high): offsets around a forecast between which a new value falls with probability high - low.

    Order statistics of the errors of held-out rows, exact for groups of any size. With fewer rows than a side needs
    ((n + 1) p < 1) that side is open: null.
    """
    error = held_out.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).withColumn("_e", F.col(truth) - F.col(guess))
    n = error.groupBy(*by).agg(F.count("*").alias("n"))
    q = exact_quantiles(error, by, "_e", {"low": low, "high": high}, position=_rank)
    few = lambda p: (F.col("n") + 1) * p < 1 - 1e-9
    return n.join(q, list(by)).select(
        *by, "n", F.when(~few(low), F.col("low")).alias("low"), F.when(~few(1 - high), F.col("high")).alias("high")
    )


def with_bands(forecast: DataFrame, bands: DataFrame, guess: str, by: Sequence[str] = BY) -> DataFrame:
    """Add p10 and p90 to a forecast; an open side stays null. Bands are one row for each of ``by``."""
    offsets = bands.select(*by, F.col("low").alias("_low"), F.col("high").alias("_high"))
    out = forecast.join(offsets, list(by), "left")
    return out.withColumns({"p10": F.col(guess) + F.col("_low"), "p90": F.col(guess) + F.col("_high")}).drop("_low", "_high")


def interval_coverage(banded: DataFrame, truth: str, by: Sequence[str] = BY) -> DataFrame:
    """(by, n_rows, coverage, mean_width): share of rows inside their band; open sides hold always, rows without truth do not count."""
    inside = (F.col("p10").isNull() | (F.col(truth) >= F.col("p10"))) & (F.col("p90").isNull() | (F.col(truth) <= F.col("p90")))
    return banded.where(F.col(truth).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_rows"), round_to(F.avg(inside.cast("double")), 4).alias("coverage"), F.avg(F.col("p90") - F.col("p10")).alias("mean_width")
    )
