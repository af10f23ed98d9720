"""PM2.5 concentration to the national air quality index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Official PM2.5 breakpoints (concentration low, high, index low, high, band).
BREAKPOINTS = [
    (0, 30, 0, 50, "Good"),
    (30, 60, 51, 100, "Satisfactory"),
    (60, 90, 101, 200, "Moderate"),
    (90, 120, 201, 300, "Poor"),
    (120, 250, 301, 400, "Very Poor"),
    (250, 1000, 401, 500, "Severe"),
]

BANDS = [b[4] for b in BREAKPOINTS]


def _ladder(pm25: Column, value, low, high) -> Column:
    """First band whose half-open range (lo, hi] holds the reading."""
    x = F.when(F.isnan(pm25), F.lit(None)).otherwise(pm25)
    out = F.when(x <= 0, low)
    for c_lo, c_hi, i_lo, i_hi, band in BREAKPOINTS:
        out = out.when(x <= c_hi, value(x, c_lo, c_hi, i_lo, i_hi, band))
    return out.otherwise(high)


def aqi(pm25: Column) -> Column:
    def interpolate(x, c_lo, c_hi, i_lo, i_hi, band):
        return F.rint((x - c_lo) * float(i_hi - i_lo) / float(c_hi - c_lo) + float(i_lo)).cast("int")

    return _ladder(pm25, interpolate, F.lit(0), F.lit(500))


def aqi_band(pm25: Column) -> Column:
    return _ladder(pm25, lambda x, a, b, c, d, band: F.lit(band), F.lit("Good"), F.lit("Severe"))


def band_rank(band: Column) -> Column:
    """0 for Good up to 5 for Severe; unknown bands rank lowest."""
    pos = F.array_position(F.array(*[F.lit(b) for b in BANDS]), band)
    return F.when(pos > 0, pos - 1).otherwise(0).cast("int")


def aqi_category(index: Column) -> Column:
    """Band of an index value rather than of a concentration."""
    out = None
    for _, _, _, hi, band in BREAKPOINTS[:-1]:
        out = F.when(index <= hi, band) if out is None else out.when(index <= hi, band)
    return out.otherwise(BANDS[-1])
