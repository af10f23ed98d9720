"""Neighbour means along the wind, and what a cell usually reads at this hour: inputs of a forecast on the hex graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions.geo import Grid, offset_array, offsets
from hazegrid.operators.forecast import hour_of_week

HOURS = 24


def upwind_mean(
    values: DataFrame,
    weather: DataFrame,
    value: str,
    base: float = 0.2,
    gain: float = 1.0,
    rings: int = 1,
    layers: int = 1,
    grid: Grid = Grid(),
    out: str = "upwind_mean",
) -> DataFrame:
    """(city, cell, ts, n_upwind, out): mean of the neighbours' ``value``, those upwind counting for more.

    A directed graph on the hexes whose weights change by the hour: neighbour j counts for cell i with
    ``base + gain * max(0, cos(wind bearing - bearing j to i))``. ``values`` holds city, cell, ts and the value, any
    number of hours missing; ``weather`` holds city, ts, wind_from_deg. ``layers`` repeats the step on its own result.
    Hours without a neighbour's value or without wind give no row.

    The graph step runs at cell x day grain: a day's hours ride in one array, so the rings multiply one row a day, and
    a cell gathers as many rows as its rings have hexes.
    """
    shape = offsets(1, rings, grid)
    hour = lambda c: F.hour(c)
    wind = weather.where("wind_from_deg IS NOT NULL").groupBy("city", F.to_date("ts").alias("date")).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct(hour("ts").alias("h"), F.col("wind_from_deg").alias("w"))))).alias("_wind")
    )
    rows = values.where(F.col(value).isNotNull()).select("city", "cell", "ts", F.col(value).cast("double").alias("_x"))
    for _ in range(layers):
        days = rows.groupBy("city", "cell", F.to_date("ts").alias("date")).agg(
            F.map_from_entries(F.collect_list(F.struct(hour("ts").alias("h"), F.col("_x").alias("x")))).alias("_day")
        )
        # A valued cell sends its day to its neighbours; the ring's bearing is that from sender to receiver.
        sent = days.withColumn("o", F.explode(offset_array(shape))).select(
            "city", (F.col("cell") + F.col("o.delta")).alias("cell"), "date", F.radians("o.ring_bearing").alias("to"), "_day"
        )
        met = sent.groupBy("city", "cell", "date").agg(F.collect_list(F.struct("to", F.col("_day").alias("day"))).alias("_near"))
        met = met.join(wind, ["city", "date"])

        def at(h: Column) -> Column:
            blows = F.radians(F.pmod(F.try_element_at("_wind", h) + 180.0, F.lit(360.0)))
            weight = lambda n: F.lit(base) + F.lit(gain) * F.greatest(F.lit(0.0), F.cos(blows - n["to"]))
            known = F.filter("_near", lambda n: F.try_element_at(n["day"], h).isNotNull())
            total = F.aggregate(known, F.lit(0.0), lambda a, n: a + weight(n) * F.try_element_at(n["day"], h))
            mass = F.aggregate(known, F.lit(0.0), lambda a, n: a + weight(n))
            return F.struct(h.alias("h"), F.size(known).alias("n"), F.when(mass > 0, total / mass).alias("x"))

        hours = F.transform(F.array_sort(F.map_keys("_wind")), at)
        rows = met.select("city", "cell", "date", F.explode(F.filter(hours, lambda r: r["x"].isNotNull())).alias("r")).select(
            "city", "cell", (F.col("date").cast("timestamp") + F.make_dt_interval(hours=F.col("r.h"))).alias("ts"), F.col("r.n").alias("n_upwind"), F.col("r.x").alias("_x")
        )
    return rows.withColumnRenamed("_x", out)


# ------------------------------------------------------------ decayed persistence

KEY = ["city", "cell", "how"]
TAU_HOURS = 24.0 * 28


def _fold(parts: DataFrame, by: Sequence[str], tau_hours: float) -> DataFrame:
    """Bring (sum, weight) of every part from its clock to the newest clock of its key, and add."""
    newest = F.max("clock").over(Window.partitionBy(*by))
    fade = F.exp((F.unix_micros("at") - F.unix_micros("_newest")) / (tau_hours * 3.6e9))
    moved = parts.withColumn("_newest", newest).select(*by, (F.col("s") * fade).alias("s"), (F.col("w") * fade).alias("w"), "_newest")
    return moved.groupBy(*by).agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.max("_newest").alias("clock"))


def decayed_state(readings: DataFrame, value: str, tau_hours: float = TAU_HOURS, by: Sequence[str] = tuple(KEY)) -> DataFrame:
    """(by, s, w, clock): exponentially decayed sum and weight as of the key's newest reading.

    A state of two numbers and a clock, which ``merge_states`` adds in any order. Readings are summed within stretches
    of one decay time from the stretch's start, so nothing overflows, before the shuffle; a key then has one row for
    each stretch of the calendar.
    """
    known = readings.where(F.col(value).isNotNull() & F.col("ts").isNotNull())
    if "how" in by and "how" not in known.columns:
        known = known.withColumn("how", hour_of_week(F.col("ts")))
    span = int(tau_hours * 3_600_000_000)
    stretch = F.floor(F.unix_micros("ts") / span).cast("long")
    rise = F.exp((F.unix_micros("ts") - stretch * span) / float(span))
    parts = known.groupBy(*by, stretch.alias("_k")).agg(
        F.sum(F.col(value) * rise).alias("s"), F.sum(rise).alias("w"), F.max("ts").alias("clock")
    )
    return _fold(parts.withColumn("at", F.timestamp_micros(F.col("_k") * span)), by, tau_hours)


def merge_states(states: DataFrame, tau_hours: float = TAU_HOURS, by: Sequence[str] = tuple(KEY)) -> DataFrame:
    """One state for each key out of any number of states; late parts count as if they had come in time."""
    return _fold(states.withColumn("at", F.col("clock")), by, tau_hours)


def decayed_persistence(states: DataFrame, out: str = "usual") -> DataFrame:
    """What the key usually reads: the decayed mean of its states."""
    return states.withColumn(out, F.col("s") / F.nullif(F.col("w"), F.lit(0.0)))


def keep_decayed(readings: DataFrame, path: str, checkpoint: str, value: str, tau_hours: float = TAU_HOURS):
    """Start a run that adds what has arrived: one small table of states for each batch, merged by ``merge_states`` on reading.

    A batch that is replayed writes its own folder again.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        decayed_state(batch, value, tau_hours).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return readings.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
