"""Streaming forms of the hourly ingest, the scheduled refresh and the inspection status."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hazegrid.operators.ledger import latest_status
from hazegrid.operators.panel import station_cell_hour
from hazegrid.sources.sinks import write_table


def station_hours_stream(readings: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Mean per (city, cell, hour) of a reading stream; repeats and late rows past the watermark drop out."""
    fresh = readings.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["city", "station_id", "ts"])
    return (
        fresh.groupBy("city", "cell", F.window("ts", "1 hour").alias("w"))
        .agg(F.avg("pm25").alias("pm25_station"))
        .select("city", "cell", F.col("w.start").alias("ts"), "pm25_station")
    )


def fire_fraction_stream(detections: DataFrame, delay: str = "6 hours", hours: int = 24) -> DataFrame:
    """(city, cell, at, fire_hours, fire_fraction): share of the ``hours`` up to ``at`` in which a cell burned.

    Detections become one row per cell and hour, and each sliding window counts its hours; windows
    close when the watermark passes them. The batch form is ``signals.fire_persistence``.
    """
    hourly = (
        detections.withWatermark("ts", delay)
        .groupBy("city", "cell", F.window("ts", "1 hour").alias("w"))
        .agg(F.count("*").alias("n"))
        .select("city", "cell", F.window_time("w").alias("hour"))
    )
    spans = hourly.groupBy("city", "cell", F.window("hour", f"{hours} hours", "1 hour").alias("w")).agg(F.count("*").cast("int").alias("fire_hours"))
    return spans.select("city", "cell", F.col("w.end").alias("at"), "fire_hours", (F.col("fire_hours") / float(hours)).alias("fire_fraction"))


def refresh_hours(readings: DataFrame, raw: str, table: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] = station_cell_hour):
    """Start a scheduled refresh: each run takes in what has arrived and rebuilds only the (city, date) parts it touches.

    Readings land under ``raw`` in a folder for each batch, cut by date; the parts of ``table`` they belong to are built
    anew from all readings of their dates and replaced. However late a row is, the table ends as the batch build of all
    rows. A batch that is replayed after a failure writes the same folder and the same parts.
    """

    def take_in(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn("date", F.to_date("ts"))
        dated.write.mode("overwrite").partitionBy("date").parquet(f"{raw}/batch={batch_id}")
        landed = spark.read.parquet(f"{raw}/batch={batch_id}").select("city", "date").distinct()
        kept = spark.read.option("basePath", raw).parquet(raw).select(*dated.columns)
        touched = kept.join(landed, ["city", "date"], "left_semi").drop("date")
        write_table(build(touched).withColumn("date", F.to_date("ts")), table, ("city", "date"))

    return (
        readings.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# -------------------------------------------------------------- inspection status

KEYED = ["city", "action_id"]
CLOCKS = ["updated_at", "dispatched_at", "actioned_at"]
STATE = "updated_at bigint, dispatched_at bigint, actioned_at bigint, closed boolean, row string"
CHANGE = "city string, action_id string, change string, row string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestStatus(StatefulProcessor):
    """The newest row of each action as keyed state; a timer lets go of an action some time after it was closed."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", STATE)

    def handleInputRows(self, key, rows, timerValues):
        # Clocks in microseconds; a missing one sorts first.
        order = lambda r: tuple(-(1 << 63) if r[i] is None else r[i] for i in range(3))
        known = self.newest.get()
        best = known = tuple(known) if known is not None else None
        for r in rows:
            own = (r.updated_at, r.dispatched_at, r.actioned_at, r.closed, r.row)
            if best is None or order(own) > order(best):
                best = own
        if best is not None and best != known:
            self.newest.update(best)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if best[3]:
                self.handle.registerTimer(best[0] // 1000 + self.keep_ms)
            yield Row(city=key[0], action_id=key[1], change="changed", row=best[4])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.newest.get()
        if last is not None:
            self.newest.clear()
            yield Row(city=key[0], action_id=key[1], change="closed", row=last[4])

    def close(self) -> None:
        pass


def status_changes(updates: DataFrame, delay: str = "60 days", keep_closed_days: int = 30, closed: Sequence[str] = ("actioned",)) -> DataFrame:
    """(city, action_id, change, row): every change of an action's newest status, in any order of arrival.

    The newest row of each action is keyed state; an older row that comes late changes nothing. Rows later than
    ``delay`` behind the newest update are dropped. An action whose status is in ``closed`` leaves the state
    ``keep_closed_days`` after its last update, with one row of change 'closed' that holds its last status, so state
    follows the open actions. ``row`` is the update as JSON.
    """
    micros = {c: F.unix_micros(c) for c in CLOCKS}
    keyed = updates.withWatermark("updated_at", delay).select(
        *KEYED,
        F.col("updated_at").alias("at"),
        F.to_json(F.struct(*updates.columns)).alias("row"),
        F.coalesce(F.col("status").isin(*closed), F.lit(False)).alias("closed"),
        *[c.alias(n) for n, c in micros.items()],
    )
    return keyed.groupBy(*KEYED).transformWithState(NewestStatus(keep_closed_days * 86_400_000), CHANGE, "Append", "EventTime")


def track_status(updates: DataFrame, changes: str, checkpoint: str, **settings):
    """Start a run of ``status_changes`` over what has arrived, with its changes in the table ``changes``."""
    spark = updates.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)  # timers and several states need it; the query keeps the setting it starts with
    try:
        return (
            status_changes(updates, **settings)
            .writeStream.format("parquet")
            .option("path", changes)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(provider, before)


def current_status(spark: SparkSession, changes: str, checkpoint: str, schema: T.StructType) -> DataFrame:
    """The newest status of each action: open ones from the state of the stream, closed ones from their last row."""
    held = spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint).select("value.row")
    # Changes are read as they were committed; of these, only closing rows matter.
    closed = spark.read.schema(T._parse_datatype_string(CHANGE)).parquet(changes).where("change = 'closed'").select("row")
    rows = held.unionByName(closed).select(F.from_json("row", schema).alias("r")).select("r.*")
    return latest_status(rows).select(*schema.names)
