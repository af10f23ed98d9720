"""Streams over delivered slices of the feeds: rows come late and twice, and every slice starts from the checkpoint (ids ST)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.operators.spatial import stamp_cell
from hazegrid.session import shared_dir
from hazegrid.streaming import live
from workload.feeds import GRID, Feeds, fx, text_ts
from workload.registry import query
from workload.sqlkit import cte, stamp, ts
from workload.sqlkit import fx as sfx

SLICES = 3


def folder(f: Feeds) -> str:
    return f"{shared_dir(f.spark)}/streams/{uuid.uuid4().hex}"


def event_slices(event_id: Column) -> Column:
    """Ten days a slice; some rows come a slice late, some a second time with the next one."""
    own = F.least(F.lit(SLICES - 1), F.floor(F.datediff("ts", F.lit("2024-01-01")) / 10)).cast("int")
    late = F.least(F.lit(SLICES - 1), own + 1)
    return F.when(event_id % 20 == 3, F.array(late)).when(event_id % 15 == 4, F.array(own, late)).otherwise(F.array(own))


def deliver(f: Feeds, rows: DataFrame, slices: Column, at: str, start: Callable[[DataFrame], object]) -> None:
    """Land one slice after the other under ``at``; after each, a run takes in what has arrived and stops."""
    sliced = rows.withColumn("_slice", F.explode(slices)).drop("event_id")
    plain = sliced.drop("_slice")
    for k in range(SLICES):
        sliced.where(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(f"{at}/in")
        run = start(f.spark.readStream.schema(plain.schema).parquet(f"{at}/in"))
        run.awaitTermination()


def appended(f: Feeds, at: str, name: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], object]:
    def start(stream: DataFrame):
        sink = build(stream).writeStream.format("parquet").option("path", f"{at}/{name}")
        return sink.option("checkpointLocation", f"{at}/ck").outputMode("append").trigger(availableNow=True).start()

    return start


# Deliveries in SQL: the watermark of a slice is the newest time of the slices before it, less the delay.
cte("sliced", """SELECT *, least(2, date_diff('day', DATE '2024-01-01', ts::DATE) // 10)::INTEGER AS own FROM stations""")
cte("deliveries", """SELECT *, CASE WHEN event_id % 20 = 3 THEN least(2, own + 1) ELSE own END AS slice FROM sliced
  UNION ALL SELECT *, least(2, own + 1) FROM sliced WHERE event_id % 15 = 4 AND event_id % 20 <> 3""")
cte("fire_sliced", f"""SELECT *, least(2, date_diff('day', DATE '2024-01-01', ts::DATE) // 10)::INTEGER AS own
  FROM ({stamp("lat", "lon", "(SELECT city, ts, event_id, lat + 0.001e0 * (event_id % 7) AS lat, lon FROM ev_c WHERE event_type = 'error')")})""")
cte("fire_deliveries", """SELECT *, CASE WHEN event_id % 20 = 3 THEN least(2, own + 1) ELSE own END AS slice FROM fire_sliced
  UNION ALL SELECT *, least(2, own + 1) FROM fire_sliced WHERE event_id % 15 = 4 AND event_id % 20 <> 3""")


def reached(table: str, hours: int, before: str = "TRUE") -> str:
    return f"(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {hours} HOURS FROM {table} WHERE {before})"


def on_time(table: str, hours: int, ends: str) -> str:
    """Rows of ``table`` whose time (or the end of their hour) lies behind the watermark of their slice."""
    marks = " ".join(f"WHEN {k} THEN {reached(table, hours, f'slice < {k}')}" for k in range(1, SLICES))
    return f"(SELECT * FROM (SELECT *, CASE slice {marks} END AS mark FROM {table}) WHERE mark IS NULL OR {ends} > mark)"


@query("st1_station_hours_stream", f"""SELECT city, cell, {ts('h')} AS ts, {sfx('avg(pm25)')} AS pm25_station FROM (
  SELECT DISTINCT city, station_id, cell, ts, pm25, date_trunc('hour', ts) AS h FROM {on_time('deliveries', 2, 'ts')})
  WHERE h + INTERVAL 1 HOUR <= {reached('deliveries', 2)} GROUP BY city, cell, h""")
def _(f: Feeds) -> DataFrame:
    at = folder(f)
    rows = stamp_cell(f.events, GRID).select(
        "city", F.concat(F.lit("ST_"), F.col("user_id").cast("string")).alias("station_id"), "cell", "ts", F.col("value").alias("pm25"), "event_id"
    )
    deliver(f, rows, event_slices(F.col("event_id")), at, appended(f, at, "hours", live.station_hours_stream))
    return f.spark.read.parquet(f"{at}/hours").select("city", "cell", text_ts("ts").alias("ts"), fx("pm25_station").alias("pm25_station"))


@query("st2_fire_fraction_stream", f"""SELECT city, cell, {ts('until')} AS "at", count(*)::INTEGER AS fire_hours, {sfx('count(*) / 24e0')} AS fire_fraction FROM (
  SELECT city, cell, unnest(generate_series(h + INTERVAL 1 HOUR, h + INTERVAL 24 HOURS, INTERVAL 1 HOUR)) AS until FROM (
    SELECT DISTINCT city, cell, date_trunc('hour', ts) AS h FROM {on_time('fire_deliveries', 6, "date_trunc('hour', ts) + INTERVAL 1 HOUR")}))
  WHERE until <= {reached('fire_deliveries', 6)} GROUP BY city, cell, until""")
def _(f: Feeds) -> DataFrame:
    at, e = folder(f), F.col("event_id")
    burning = f.events.where("event_type = 'error'").withColumn("lat", F.col("lat") + F.lit(0.001) * (e % 7))
    rows = stamp_cell(burning, GRID).select("city", "cell", "ts", "event_id")
    deliver(f, rows, event_slices(e), at, appended(f, at, "spans", live.fire_fraction_stream))
    spans = f.spark.read.parquet(f"{at}/spans")
    return spans.select("city", "cell", text_ts("at").alias("at"), "fire_hours", fx("fire_fraction").alias("fire_fraction"))


@query("st3_scheduled_refresh", f"SELECT city, cell, {ts('ts')} AS ts, {sfx('avg(pm25)')} AS pm25_station FROM (SELECT city, cell, date_trunc('hour', ts) AS ts, pm25 FROM deliveries) GROUP BY ALL")
def _(f: Feeds) -> DataFrame:
    at = folder(f)
    rows = stamp_cell(f.events, GRID).select("city", "cell", "ts", F.col("value").alias("pm25"), "event_id")
    deliver(f, rows, event_slices(F.col("event_id")), at, lambda s: live.refresh_hours(s, f"{at}/raw", f"{at}/table", f"{at}/ck"))
    hours = f.spark.read.parquet(f"{at}/table")
    return hours.select("city", "cell", text_ts("ts").alias("ts"), fx("pm25_station").alias("pm25_station"))


@query("st4_status_stream", f"SELECT city, action_id, {ts('dispatched_at')} AS dispatched_at, {ts('actioned_at')} AS actioned_at, status FROM status_now")
def _(f: Feeds) -> DataFrame:
    """Two years a slice, a tenth a slice late; actions closed long ago leave the state on the way."""
    at, rows = folder(f), f.status_updates
    own = F.least(F.lit(SLICES - 1), F.floor((F.year("dispatched_at") - 1995) / 2)).cast("int")
    late = F.dayofyear("dispatched_at") % 10 == 3
    slices = F.array(F.least(F.lit(SLICES - 1), F.when(late, own + 1).otherwise(own)))
    track = lambda s: live.track_status(s, f"{at}/changes", f"{at}/ck", delay="900 days", keep_closed_days=30)
    deliver(f, rows, slices, at, track)
    now = live.current_status(f.spark, f"{at}/changes", f"{at}/ck", rows.schema)
    return now.select("city", "action_id", text_ts("dispatched_at").alias("dispatched_at"), text_ts("actioned_at").alias("actioned_at"), "status")
