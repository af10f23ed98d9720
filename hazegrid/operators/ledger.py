"""Intervention ledger: frozen counterfactual, response chain, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions.aqi import aqi, aqi_band
from hazegrid.functions.geo import round_to

COUNTERFACTUAL_HORIZON_H = 48


def counterfactual(queue: DataFrame, forecast: DataFrame, horizon_h: int = COUNTERFACTUAL_HORIZON_H) -> DataFrame:
    """(city, action_id, pm25/aqi/band of doing nothing): median over the action's forecast cells."""
    at = forecast.where(F.col("horizon_h") == horizon_h).select("city", "cell", F.col("pm25_hat").alias("_hat"))
    med = (
        queue.select("city", "action_id", F.explode("cells").alias("cell"))
        .join(at, ["city", "cell"])
        .groupBy("city", "action_id")
        .agg(F.median("_hat").alias("_pm"))
    )
    return med.select(
        "city", "action_id", F.lit(horizon_h).alias("horizon_h"), round_to(F.col("_pm"), 1).alias("pm25_counterfactual"),
        aqi(F.col("_pm")).alias("aqi_counterfactual"), aqi_band(F.col("_pm")).alias("band_counterfactual"),
    )


def latest_status(updates: DataFrame) -> DataFrame:
    """The newest inspection row per action."""
    attrs = [c for c in updates.columns if c not in ("city", "action_id")]
    newest = F.max_by(F.struct(*attrs), F.struct("updated_at", "dispatched_at", "actioned_at")).alias("s")
    return updates.groupBy("city", "action_id").agg(newest).select("city", "action_id", *[f"s.{a}" for a in attrs])


def response_hours(dispatched: Column, actioned: Column) -> Column:
    """Hours between two texts or timestamps, 2 dp; null unless both parse."""
    d, a = F.try_to_timestamp(dispatched.cast("string")), F.try_to_timestamp(actioned.cast("string"))
    seconds = (F.unix_micros(a) - F.unix_micros(d)) / 1e6
    return round_to(seconds / 3600.0, 2)


def response_times(queue: DataFrame, hotspots: DataFrame, memos: DataFrame, status: DataFrame) -> DataFrame:
    """(city, action_id, signal_at, memo_drafted_at, dispatched_at, actioned_at, response_hours, has_status).

    The memo time is looked up by action, then by zone.
    """
    signal = hotspots.groupBy("city", "zone_id").agg(F.min("ts").alias("signal_at"))
    by_action = memos.groupBy("city", "action_id").agg(F.max("issued_at").alias("_m_action"))
    by_zone = memos.groupBy("city", "zone_id").agg(F.max("issued_at").alias("_m_zone"))
    live = status.select("city", "action_id", "dispatched_at", "actioned_at", F.lit(True).alias("_has"))
    return (
        queue.select("city", "action_id", "zone_id")
        .join(signal, ["city", "zone_id"], "left")
        .join(by_action, ["city", "action_id"], "left")
        .join(by_zone, ["city", "zone_id"], "left")
        .join(live, ["city", "action_id"], "left")
        .select(
            "city", "action_id", "signal_at", F.coalesce("_m_action", "_m_zone").alias("memo_drafted_at"), "dispatched_at",
            "actioned_at", response_hours(F.col("dispatched_at"), F.col("actioned_at")).alias("response_hours"),
            F.coalesce("_has", F.lit(False)).alias("has_status"),
        )
    )


def ledger(queue: DataFrame, hotspots: DataFrame, memos: DataFrame, status: DataFrame, forecast: DataFrame) -> DataFrame:
    """One entry per action; impact stays null until a real outcome is measured."""
    times = response_times(queue, hotspots, memos, status)
    cf = counterfactual(queue, forecast)
    state = F.when(F.col("actioned_at").isNotNull(), "actioned").when(F.col("has_status"), "dispatched").otherwise("awaiting_outcome")
    frozen = F.struct(
        "horizon_h", "pm25_counterfactual", "aqi_counterfactual", "band_counterfactual", F.col("signal_at").alias("frozen_at")
    )
    return (
        queue.select("city", "action_id", "zone_id", "ward_id", "ward_name", "source", "eps")
        .join(times, ["city", "action_id"])
        .join(cf, ["city", "action_id"], "left")
        .select(
            "city", "action_id", "zone_id", "ward_id", "ward_name", "source", "eps",
            F.struct("signal_at", "memo_drafted_at", "dispatched_at", "actioned_at", "response_hours").alias("response"),
            F.when(F.col("horizon_h").isNotNull(), frozen).alias("counterfactual"),
            F.lit(None).cast("double").alias("observed_change"), F.lit(None).cast("double").alias("our_impact"),
            state.alias("status"),
        )
    )


def ledger_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("city").agg(
        F.count("*").alias("n_actions"), F.count_if(F.col("status") == "actioned").alias("n_actioned")
    )


EFFECT_HOURS = 72


def realised_effect(actions: DataFrame, forecast: DataFrame, field: DataFrame, hours: int = EFFECT_HOURS, step: int = 3) -> DataFrame:
    """What happened after each action, less what its frozen forecast expected.

    ``actions`` holds city, action_id, zone_id, cells, issued_at (when the forecast was frozen) and actioned_at;
    ``forecast`` city, cell, issued_at, horizon_h (every ``step`` hours), pm25_hat; ``field`` city, cell, ts, pm25_hat.
    Returns city, action_id, zone_id, n_hours, realised, expected (means over the hours in (actioned_at, + ``hours``] and
    the cells), mean_change, accumulated (the sum of hourly changes) and shared_hours, those in which another action on
    the same zone was in its own time as well, so that the change is not its alone. Actions never carried out, or
    without a field or forecast hour, have none.

    An interval join in buckets: an action's cells are spread over the days it reaches, meet the field there, and the
    hour decides. An hour takes the next horizon at or after it.
    """
    last = F.col("actioned_at") + F.make_dt_interval(hours=F.lit(hours))
    days = F.explode(F.sequence(F.to_date("actioned_at"), F.to_date(last)))
    spread = actions.where("actioned_at IS NOT NULL").select(
        "city", "action_id", "zone_id", "issued_at", "actioned_at", last.alias("_last"), days.alias("_day"), "cells"
    )
    spread = spread.withColumn("cell", F.explode("cells")).drop("cells")
    dated = field.select("city", "cell", F.to_date("ts").alias("_day"), "ts", F.col("pm25_hat").alias("_real"))
    met = spread.join(dated, ["city", "cell", "_day"]).where("ts > actioned_at AND ts <= _last")
    lead = (F.unix_timestamp("ts") - F.unix_timestamp("issued_at")) / 3600
    met = met.withColumn("horizon_h", (F.ceil(lead / step) * step).cast("int"))
    frozen = forecast.select("city", "cell", "issued_at", F.col("horizon_h").cast("int").alias("horizon_h"), F.col("pm25_hat").alias("_hat"))
    hourly = (
        met.join(frozen, ["city", "cell", "issued_at", "horizon_h"])
        .groupBy("city", "zone_id", "ts", "action_id")
        .agg(F.avg("_real").alias("_real"), F.avg("_hat").alias("_hat"))
    )
    # A zone's hour holds as many rows as actions run on it at once.
    others = F.count("*").over(Window.partitionBy("city", "zone_id", "ts")) > 1
    change = F.col("_real") - F.col("_hat")
    return hourly.withColumn("_shared", others).groupBy("city", "action_id", "zone_id").agg(
        F.count("*").alias("n_hours"), F.avg("_real").alias("realised"), F.avg("_hat").alias("expected"),
        F.avg(change).alias("mean_change"), F.sum(change).alias("accumulated"), F.count_if("_shared").alias("shared_hours"),
    )
