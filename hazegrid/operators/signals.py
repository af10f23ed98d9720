"""Robust signals over the panel: window medians, ring contrast, plume, persistence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.geo import Grid, circular_mean_deg, offset_array, offsets, round_to
from hazegrid.functions.stats import MAD_SCALE, TINY, array_std, exact_quantiles, median_and_mad, robust_z_cells, sorted_median
from hazegrid.operators.spatial import ring_neighbours

# Detection windows in hours.
WINDOWS = {"w24h": 24, "w7d": 168, "w30d": 720}
FIRE_FRAC_SCALE = 0.05
INNER_K = 1
OUTER_K = (5, 10)


def trailing(ts: Column, at: Column, hours: float) -> Column:
    """True inside the half-open window (at - hours, at]."""
    return (ts > at - F.make_dt_interval(hours=F.lit(int(hours)))) & (ts <= at)


def latest_hours(df: DataFrame) -> DataFrame:
    """(city, at): each city's newest hour."""
    return df.groupBy("city").agg(F.max("ts").alias("at"))


def with_latest(df: DataFrame, at=None) -> DataFrame:
    """Add ``at``: a given instant (pushed down to the scan), a (city, at) clock, else each city's newest hour."""
    if at is None or isinstance(at, DataFrame):
        clock = latest_hours(df) if at is None else at
        return df.join(F.broadcast(clock), "city")  # one row per city
    return df.withColumn("at", F.lit(at).cast("timestamp"))


def window_medians(df: DataFrame, value: str, at=None, windows: Mapping[str, int] = WINDOWS) -> DataFrame:
    """(city, cell, w..., z_w...): per-cell median of each window and its robust z in the city."""
    stamped = with_latest(df, at)
    widest = max(windows.values())
    med = (
        stamped.where(trailing(F.col("ts"), F.col("at"), widest))
        .groupBy("city", "cell")
        .agg(*[F.median(F.when(trailing(F.col("ts"), F.col("at"), h), F.col(value))).alias(w) for w, h in windows.items()])
    )
    med = robust_z_cells(med, {w: f"z_{w}" for w in windows})
    return med.select("city", "cell", *[c for w in windows for c in (w, f"z_{w}")])


def neighbourhood_contrast(
    cells: DataFrame, values: Mapping[str, str], inner_k: int = INNER_K, outer_k: tuple[int, int] = OUTER_K, grid: Grid = Grid()
) -> DataFrame:
    """(city, cell, outputs): excess of the inner disk over the annulus, in units of the annulus' own spread.

    ``values`` maps output name to value column; all columns share one ring join. The spread
    is 1.4826 MAD, else the deviation, floored by 5 % of the annulus median. Fewer than 2
    inner or 6 outer values score 0; a cell with no value of its own gets null. Arrays hold
    at most one entry per hex of the disk or annulus.
    """
    cols = list(dict.fromkeys(values.values()))
    some = F.coalesce(*[F.col(c) for c in cols]).isNotNull()
    table = cells.select("city", "cell", *cols).where(some)
    rings = ring_neighbours(table, table, offsets(0, inner_k, grid) + offsets(*outer_k, grid))
    aggs = []
    for c in cols:
        aggs += [
            F.collect_list(F.when(F.col("ring") <= inner_k, F.col(c))).alias(f"in_{c}"),
            F.collect_list(F.when(F.col("ring") >= outer_k[0], F.col(c))).alias(f"out_{c}"),
            F.max(F.when(F.col("ring") == 0, F.col(c))).alias(f"own_{c}"),
        ]
    # One step per column set: medians are settled before the lambdas that use them.
    near = rings.groupBy("city", "centre").agg(*aggs)
    near = near.withColumns({f"{p}_{c}": F.sort_array(f"{p}_{c}") for c in cols for p in ("in", "out")})
    near = near.withColumns({f"med_{c}": sorted_median(F.col(f"out_{c}")) for c in cols})
    near = near.withColumns({f"dev_{c}": _deviations(f"out_{c}", f"med_{c}") for c in cols})
    near = near.withColumns({f"mad_{c}": sorted_median(F.col(f"dev_{c}")) * MAD_SCALE for c in cols})
    out = {}
    for name, c in values.items():
        med, mad = F.col(f"med_{c}"), F.col(f"mad_{c}")
        spread = F.when(mad >= TINY, mad).otherwise(array_std(F.col(f"out_{c}")))
        scale = F.greatest(spread, F.abs(med) * 0.05, F.lit(TINY))
        enough = (F.size(f"in_{c}") >= 2) & (F.size(f"out_{c}") >= 6)
        score = F.when(enough, (sorted_median(F.col(f"in_{c}")) - med) / scale).otherwise(0.0)
        out[name] = F.when(F.col(f"own_{c}").isNotNull(), score)
    return near.select("city", F.col("centre").alias("cell"), *[v.alias(n) for n, v in out.items()])


def _deviations(values: str, med: str) -> Column:
    return F.sort_array(F.transform(values, lambda x: F.abs(x - F.col(med))))


def daily_wind(weather: DataFrame) -> DataFrame:
    return weather.groupBy("city", F.to_date("ts").alias("date")).agg(
        circular_mean_deg(F.col("wind_from_deg")).alias("wind_from_deg")
    )


def downwind_enhancement(
    daily: DataFrame,
    weather: DataFrame,
    cells: DataFrame,
    value: str = "no2_col",
    r_min: float = 2.0,
    r_max: float = 6.0,
    half_angle: float = 40.0,
    grid: Grid = Grid(),
) -> DataFrame:
    """(city, cell, plume): robust z of the median over days of downwind minus crosswind air.

    Ring geometry is a constant of the offset, so the sector test is arithmetic on the
    joined wind; a cell-day collects at most the hexes of its distance band.
    """
    k = grid.rings_for(r_max)
    seen = daily.where(F.col(value).isNotNull()).join(daily_wind(weather), ["city", "date"])
    band = [o for o in offsets(1, k, grid) if r_min <= o.dist_km <= r_max]
    # Each reading is offered to the centres it can be seen from: centre = cell - offset.
    spread = seen.select("city", "date", F.col("cell").alias("src"), F.col(value).alias("v"), "wind_from_deg", F.explode(offset_array(band)).alias("o"))
    toward = F.pmod(F.col("wind_from_deg") + 180.0, F.lit(360.0))
    off = F.abs(F.pmod(F.col("o.ring_bearing") - toward + 180.0, F.lit(360.0)) - 180.0)
    sector = spread.select(
        "city",
        "date",
        (F.col("src") - F.col("o.delta")).alias("cell"),
        F.when(off <= half_angle, F.col("v")).alias("down"),
        F.when(F.abs(off - 90.0) <= half_angle, F.col("v")).alias("cross"),
    ).where("down is not null or cross is not null")
    per_day = sector.groupBy("city", "cell", "date").agg((F.median("down") - F.median("cross")).alias("enh"))
    per_cell = per_day.groupBy("city", "cell").agg(F.median("enh").alias("enh"))
    full = cells.select("city", "cell").join(per_cell, ["city", "cell"], "left").select(
        "city", "cell", F.coalesce("enh", F.lit(0.0)).alias("enh")
    )
    return robust_z_cells(full, {"enh": "plume"})


def fire_persistence(df: DataFrame, at=None, windows: Mapping[str, int] = WINDOWS, scale: float = FIRE_FRAC_SCALE) -> DataFrame:
    """(city, cell, f_w...): share of the window's hours on fire, in units of ``scale``."""
    stamped = with_latest(df, at)
    hit = (F.col("fires_6h") > 0).cast("double")
    return (
        stamped.where(trailing(F.col("ts"), F.col("at"), max(windows.values())))
        .groupBy("city", "cell")
        .agg(*[(F.avg(F.when(trailing(F.col("ts"), F.col("at"), h), hit)) / scale).alias(f"f_{w}") for w, h in windows.items()])
    )


def classify_persistence(z24: Column, z7: Column, z30: Column, thresh: float = 2.0) -> Column:
    """The longest window that is still hot decides: chronic, emerging, acute or none."""
    return (
        F.when(z30 >= thresh, "chronic").when(z7 >= thresh, "emerging").when(z24 >= thresh, "acute").otherwise("none")
    )


def channel_snr(daily: DataFrame, pollutants: list[str]) -> DataFrame:
    """(city, pollutant, n_obs, level, spatial, noise, snr, verdict): can the channel resolve structure?"""
    out = None
    for p in pollutants:
        cell = daily.groupBy("city", "cell").agg(
            F.median(p).alias("med"), F.count(p).cast("double").alias("n"), F.stddev_pop(p).alias("sd")
        )
        spread = median_and_mad(cell.where("med is not null"), "med", ["city"], small=True)
        seen = cell.where("med is not null").groupBy("city").agg(F.median("n").alias("n"), F.median("sd").alias("sd"))
        noise = F.col("sd") * 1.25 / F.greatest(F.sqrt(F.greatest(F.col("n"), F.lit(1.0))), F.lit(1.0))
        spatial = F.col("mad") * MAD_SCALE
        snr = round_to(spatial / F.nullif(noise, F.lit(0.0)), 2)
        part = daily.select("city").distinct().join(spread.join(seen, "city"), "city", "left").select(
            "city",
            F.lit(p).alias("pollutant"),
            F.coalesce(round_to(F.col("n"), 1), F.lit(0.0)).alias("n_obs"),
            round_to(F.col("med"), 2).alias("level"),
            round_to(spatial, 2).alias("spatial"),
            round_to(noise, 2).alias("noise"),
            snr.alias("snr"),
        )
        out = part if out is None else out.unionByName(part)
    verdict = F.when(F.col("snr").isNull(), "no data").when(F.col("snr") >= 3, "strong").when(F.col("snr") >= 1.5, "usable")
    return out.withColumn("verdict", verdict.otherwise("noise"))


def negative_fraction(daily: DataFrame, pollutants: list[str]) -> DataFrame:
    """Share of negative retrievals per city and channel."""
    return daily.groupBy("city").agg(
        *[F.avg(F.when(F.col(p).isNotNull(), (F.col(p) < 0).cast("double"))).alias(f"neg_{p}") for p in pollutants]
    )


def city_quantile(df: DataFrame, value: str, p: float) -> DataFrame:
    """(city, q): exact quantile of all rows of a city."""
    return exact_quantiles(df, ["city"], value, {"q": p})
