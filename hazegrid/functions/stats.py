"""Robust statistics: medians, MAD, exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hazegrid.functions.geo import round_to
from hazegrid.session import cut_lineage, materialise

MAD_SCALE = 1.4826
TINY = 1e-9
_ACCURACY = 10_000
_SMALL_GROUP = 4 * _ACCURACY
_RANGES = 256
#: Groups whose statistics are sent to every task; those of more groups travel by shuffle.
_SENT_GROUPS = 100_000
#: Rows, or hours, of a series that one task sorts at least.
_SERIES_BLOCK = 8192


def clean(x: Column) -> Column:
    """NaN to null: Spark would otherwise sort NaN above every reading."""
    return F.when(~F.isnan(x), x)


def sorted_median(s: Column) -> Column:
    """Interpolated median of an ascending array; null when it is empty."""
    n = F.size(s)
    low = F.get(s, F.floor((n - 1) / 2).cast("int"))
    high = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, low * 0.5 + high * 0.5)


def array_std(values: Column) -> Column:
    """Population standard deviation of a non-null array."""
    n = F.nullif(F.size(values), F.lit(0)).cast("double")
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    sq = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.sqrt(sq)


def median_upper(column: str) -> Column:
    """Aggregate: the upper of the two middle values, as a counted (mergeable) percentile."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def framed_median(x: Column, frame, min_obs: int = 1) -> Column:
    """Median over a row or range frame; null below ``min_obs`` non-null values."""
    return F.when(F.count(x).over(frame) >= min_obs, F.percentile(x, 0.5).over(frame))


def rolling_medians(
    df: DataFrame, by: Sequence[str], order: str, value: str, frames: Mapping[str, tuple[int, int]], hours: bool = False
) -> DataFrame:
    """Add medians of the rows before each row: ``frames`` maps a name to (length, least non-null values).

    Lengths count rows of the series ``by`` in ``order``, or with ``hours`` clock hours of the timestamp ``order``.
    A series is cut into blocks that bring the longest frame's rows from the block before, so a series of any length
    spreads over tasks. Within a block an ordered window takes the new value in and the oldest out, in logarithmic
    time; no frame is sorted anew.
    """
    longest = max(length for length, _ in frames.values())
    block = max(_SERIES_BLOCK, 4 * longest)
    if hours:
        at = F.floor(F.unix_timestamp(order) / 3600).cast("long")
    else:
        at = F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long") - 1
    placed = df.withColumn("_at", at).withColumn("_own", F.floor(F.col("_at") / block))
    ahead = F.pmod(F.col("_at"), F.lit(block)) >= block - longest
    blocks = F.when(ahead, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    spread = placed.withColumn("_block", F.explode(blocks))
    columns, schema = df.columns, df.schema
    for name in frames:
        schema = T.StructType([f for f in schema if f.name != name]).add(name, T.DoubleType())
    columns = [c for c in columns if c not in frames]
    lengths = dict(frames)

    def roll(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("_at", "ascending")]))
        at = table.column("_at").to_numpy()
        x = pd.Series(table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False))
        if hours:
            x.index = pd.to_datetime(at, unit="h")
        own = pc.equal(table.column("_own"), table.column("_block"))
        out = table.select(columns)
        for name, (length, least) in lengths.items():
            window = x.rolling(f"{length}h" if hours else length, min_periods=least, closed="left")
            out = out.append_column(name, pa.array(window.median().to_numpy(), pa.float64(), from_pandas=True))
        return out.filter(own)

    return spread.groupBy(*by, "_block").applyInArrow(roll, schema)


def _settled(stats: DataFrame) -> tuple[DataFrame, bool]:
    """(statistics of groups computed once, whether they are few); few are sent to every task, so no group's rows gather."""
    once = cut_lineage(stats)
    few = once.count() <= _SENT_GROUPS
    return (F.broadcast(once) if few else once), few


def _select(packed: DataFrame, by: Sequence[str], few: bool = False) -> DataFrame:
    """(by, _i, _pos, _lo, _hi): the values at the two ranks around ``_pos`` among counted values in value ranges.

    The counts of the ranges give their first ranks; only the one or two ranges that hold a wanted rank are sorted.
    """
    key = [*by, "_i"]
    totals = packed.groupBy(*key, "_range").agg(F.sum("_c").alias("_n"), F.first("_pos").alias("_at"))
    run = Window.partitionBy(*key).orderBy("_range")  # at most _RANGES + 1 rows
    starts = totals.withColumns({"_end": F.sum("_n").over(run), "_last": F.lead("_range").over(run).isNull()})
    holds = lambda rank: (F.col("_end") - F.col("_n") <= rank) & ((rank < F.col("_end")) | F.col("_last"))
    wanted = starts.where(holds(F.floor("_at")) | holds(F.ceil("_at"))).select(*key, "_range", (F.col("_end") - F.col("_n")).alias("_first"))
    inside = Window.partitionBy(*key, "_range").orderBy("_v")
    # Wanted ranges are hashed by their group: without the broadcast the packed values would gather by group too.
    sent = F.broadcast(wanted) if few else wanted
    ranked = packed.join(sent, [*key, "_range"]).withColumn("_to", F.col("_first") + F.sum("_c").over(inside))
    ranked = ranked.withColumn("_from", F.col("_to") - F.col("_c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))

    return ranked.groupBy(*key).agg(F.first("_pos").alias("_pos"), at(F.floor("_pos")).alias("_lo"), at(F.ceil("_pos")).alias("_hi"))


def _linear(n: Column, p: float) -> Column:
    return (n - 1) * F.lit(float(p))


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    position: Callable[[Column, float], Column] = _linear,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, whatever the group's share of the rows.

    ``position`` gives the place of a quantile among n sorted values from 0, within a few places of (n - 1) p.

    Ranks are selected level by level. A mergeable sketch first brackets each quantile.
    Everything below the bracket collapses into one counted row and everything above is
    dropped, both before the shuffle. The distinct values of the bracket stay spread by
    value and lie in _RANGES equal ranges, of which only those with a wanted rank are
    sorted: no task sees a bracket whole. Groups of few rows skip the bracket, not the ranges.
    Brackets are computed at once, and sent to every task unless groups are very many: rows of a group never gather.
    """
    by, names = list(by), list(probs)
    rows = _values(df, by, value)
    brackets, few = _settled(_brackets(rows, by, list(probs.values()), position))
    # Read for the counts of the ranges and for their values: both must see the same brackets.
    picked = _select(materialise(_pack(rows, by, brackets)), by, few)
    frac = F.col("_pos") - F.floor("_pos")
    value_at = F.when(frac == 0, F.col("_lo")).otherwise(
        (F.ceil("_pos") - F.col("_pos")) * F.col("_lo") + frac * F.col("_hi")
    )
    checked = F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), F.raise_error(F.lit("quantile left its bracket")).cast("double")).otherwise(value_at)
    flat = picked.withColumn("_q", checked)
    return flat.groupBy(*by).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)]
    )


def _values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))


def _packed(
    df: DataFrame, by: list[str], value: str, probs: Sequence[float], position: Callable[[Column, float], Column] = _linear
) -> DataFrame:
    """(by, _i, _pos, _range, _v, _c): counted distinct values of each quantile's bracket, and what lies below in one row."""
    rows = _values(df, by, value)
    return _pack(rows, by, _settled(_brackets(rows, by, probs, position))[0])


def _brackets(rows: DataFrame, by: Sequence[str], probs: Sequence[float], position: Callable[[Column, float], Column]) -> DataFrame:
    """(by, _b): for each quantile its place and the values around it between which it certainly lies."""
    pad = 2.0 / _ACCURACY
    edges = []
    for p in probs:
        edges += [max(p - pad, 0.0), min(p + pad, 1.0)]
    sketch = rows.groupBy(*by).agg(
        F.count("_v").alias("_n"),
        F.percentile_approx("_v", edges, _ACCURACY).alias("_e"),
    )
    specs = []
    for i, p in enumerate(probs):
        whole = F.col("_n") <= _SMALL_GROUP
        low_edge = F.lit(p - pad <= 0.0) | whole
        high_edge = F.lit(p + pad >= 1.0) | whole
        pos = position(F.col("_n"), p)
        specs.append(
            F.struct(
                F.lit(i).alias("i"),
                F.when(low_edge, F.lit(float("-inf"))).otherwise(F.col("_e")[2 * i]).alias("lo"),
                F.when(high_edge, F.lit(float("inf"))).otherwise(F.col("_e")[2 * i + 1]).alias("hi"),
                F.col("_e")[2 * i].alias("start"),
                (F.col("_e")[2 * i + 1] - F.col("_e")[2 * i]).alias("span"),
                pos.alias("pos"),
            )
        )
    return sketch.select(*by, F.array(*specs).alias("_b"))


def _pack(rows: DataFrame, by: Sequence[str], brackets: DataFrame) -> DataFrame:
    joined = rows.join(brackets, list(by)) if by else rows.crossJoin(brackets)
    spread = joined.select(*by, "_v", F.explode("_b").alias("b"))
    # Range -1 holds all rows below as one count, so a genuine -inf value stays itself.
    below = F.col("_v") < F.col("b.lo")
    part = F.floor((F.col("_v") - F.col("b.start")) / F.col("b.span") * _RANGES)
    inner = F.when(F.col("b.span") > 0, F.greatest(F.lit(0), F.least(F.lit(_RANGES - 1), part))).otherwise(0)
    return (
        spread.where(F.col("_v") <= F.col("b.hi"))
        .select(
            *by,
            F.col("b.i").alias("_i"),
            F.col("b.pos").alias("_pos"),
            F.when(below, -1).otherwise(F.coalesce(inner.cast("int"), F.lit(0))).alias("_range"),
            F.when(~below, F.col("_v")).alias("_v"),
        )
        .groupBy(*by, "_i", "_pos", "_range", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join group statistics back; a global statistic is a single row."""
    return df.join(stats, list(by), "left") if by else df.crossJoin(F.broadcast(stats))


def median_and_mad(df: DataFrame, value: str, by: Sequence[str], small: bool = False) -> DataFrame:
    """(by, med, mad) per group.

    ``small`` promises that groups are bounded by geography or calendar (one row per
    cell, per hour) and uses the plain aggregate; otherwise groups may be of any size.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).alias("_x"))
    dev = F.abs(F.col("_x") - F.col("med"))
    if small:
        med = rows.groupBy(*by).agg(F.median("_x").alias("med"))
        return attach(rows, med, by).groupBy(*by).agg(F.first("med", True).alias("med"), F.median(dev).alias("mad"))
    med, _ = _settled(exact_quantiles(rows, by, "_x", {"med": 0.5}))
    spread = attach(rows, med, by).withColumn("_d", dev)
    return attach(med, exact_quantiles(spread, by, "_d", {"mad": 0.5}), by)


def _scaled(value: Column, med: Column, mad: Column, sd: Column) -> Column:
    """(x - median) / (1.4826 MAD); else in standard deviations; 0 in a constant group; null stays null."""
    scaled = mad * MAD_SCALE
    scale = F.when(scaled >= TINY, scaled).when(sd >= TINY, sd)
    return F.when(value.isNotNull(), F.coalesce((value - med) / scale, F.lit(0.0)))


def robust_z(df: DataFrame, value: str, by: Sequence[str] = ("city",), out: str = "z") -> DataFrame:
    """Outlier-resistant z within groups of any size."""
    by = list(by)
    stats, _ = _settled(
        attach(median_and_mad(df, value, by), df.groupBy(*by).agg(F.stddev_pop(value).alias("sd")), by)
    )
    z = _scaled(F.col(value), F.col("med"), F.col("mad"), F.col("sd"))
    return attach(df, stats, by).withColumn(out, z).drop("med", "mad", "sd")


def robust_z_cells(df: DataFrame, outputs: Mapping[str, str]) -> DataFrame:
    """Robust z within the city of several columns of a one-row-per-cell table, in two aggregates.

    ``outputs`` maps value column to z column. The statistics are one row per city.
    """
    first = df.groupBy("city").agg(
        *[x for c in outputs for x in (F.median(c).alias(f"_med_{c}"), F.stddev_pop(c).alias(f"_sd_{c}"))]
    )
    dev = df.join(F.broadcast(first), "city")
    second = dev.groupBy("city").agg(
        *[
            x
            for c in outputs
            for x in (
                F.first(f"_med_{c}", True).alias(f"_med_{c}"),
                F.first(f"_sd_{c}", True).alias(f"_sd_{c}"),
                F.median(F.abs(F.col(c) - F.col(f"_med_{c}"))).alias(f"_mad_{c}"),
            )
        ]
    )
    z = {o: _scaled(F.col(c), F.col(f"_med_{c}"), F.col(f"_mad_{c}"), F.col(f"_sd_{c}")) for c, o in outputs.items()}
    return df.join(F.broadcast(second), "city").withColumns(z).select(*df.columns, *outputs.values())


def rmse(truth: Column, guess: Column) -> Column:
    return F.sqrt(F.avg((truth - guess) * (truth - guess)))


def r_squared(truth: Column, guess: Column) -> Column:
    """1 - SSE/SST from single-pass sums, so no second scan for the mean."""
    sse = F.sum((truth - guess) * (truth - guess))
    sst = F.var_pop(truth) * F.count(truth)
    return F.lit(1.0) - sse / F.nullif(sst, F.lit(0.0))


def skill_pct(model: Column, baseline: Column) -> Column:
    return round_to((F.lit(1.0) - model / F.nullif(baseline, F.lit(0.0))) * 100.0, 1)
