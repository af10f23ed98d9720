"""Enforcement priority, action queue, maximum-coverage dispatch and team routes."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions.geo import EARTH_RADIUS_KM, Grid, haversine_km, round_to
from hazegrid.operators.hotspots import KIND_RANK, lookup
from hazegrid.operators.spatial import add_centre, within_km
from hazegrid.session import cut_lineage

# Fixed values.
EPS_WEIGHTS = {"severity": 0.35, "attribution_conf": 0.25, "actionability": 0.20, "vulnerability": 0.20}
KIND_URGENCY = {"acute": 1.0, "emerging": 0.8, "chronic": 0.6}
LOCATABLE_KM = 3.0
COVER_RADIUS_KM = 2.0
ROAD_FACTOR = 1.4
SPEED_KMH = 20.0

ZONE = ["city", "zone_id"]


def eps(hotspots: DataFrame, attributions: DataFrame, landuse: DataFrame) -> DataFrame:
    """(city, zone_id, eps, components) of every zone.

    ``attributions`` holds (city, cell, confidence); ``landuse`` holds (city, cell, lu_sensitive).
    """
    cells = (
        hotspots.join(attributions.select("city", "cell", F.col("confidence").alias("_conf")), ["city", "cell"], "left")
        .join(landuse.select("city", "cell", "lu_sensitive"), ["city", "cell"], "left")
    )
    zone = cells.groupBy(*ZONE).agg(
        F.max("severity").alias("sev"),
        F.max(F.coalesce("_conf", F.lit(0.0))).alias("conf"),
        F.max_by("kind", lookup(F.col("kind"), KIND_RANK, 0)).alias("kind"),
        F.min("nearest_candidate_km").alias("near"),
        F.bool_or("attributable").alias("attributable"),
        F.max("lu_sensitive").alias("sensitive"),
    )
    action = (
        F.when(F.col("attributable"), 1.0).otherwise(0.0)
        * lookup(F.col("kind"), KIND_URGENCY, 0.6)
        * F.when(F.col("near") <= LOCATABLE_KM, 1.0).otherwise(0.6)
    )
    parts = {
        "severity": F.greatest(F.lit(0.0), F.least(F.col("sev"), F.lit(1.0))),
        "attribution_conf": F.col("conf"),
        "actionability": action,
        "vulnerability": F.least(F.coalesce("sensitive", F.lit(0)) / 5.0, F.lit(1.0)),
    }
    total = sum((v * EPS_WEIGHTS[k] for k, v in list(parts.items())[1:]), parts["severity"] * EPS_WEIGHTS["severity"])
    return zone.select(
        *ZONE,
        round_to(total * 100.0, 1).alias("eps"),
        F.struct(*[round_to(v, 3).alias(k) for k, v in parts.items()]).alias("components"),
    )


def eps_violations(scored: DataFrame) -> DataFrame:
    """Zones whose rounded components do not add up to their EPS within one point (none expected)."""
    total = sum((F.col(f"components.{k}") * w for k, w in EPS_WEIGHTS.items()), F.lit(0.0)) * 100.0
    return scored.where(F.abs(total - F.col("eps")) > 1.0)


def actions(hotspots: DataFrame, attributions: DataFrame, landuse: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """The enforcement queue, one row per enforceable zone.

    Ids follow the order in which zones first appear among hotspots sorted by severity;
    publish with ``by_eps``.
    """
    enforce = hotspots.where("attributable")
    named = attributions.select(
        "city", "cell", F.col("primary_source").alias("_src"), F.col("confidence").alias("_conf")
    )
    cells = add_centre(enforce, grid).join(named, ["city", "cell"], "left")
    rank = F.struct(F.col("severity"), -F.col("cell"))
    anchor = F.struct("ward_id", "ward_name", "kind", "pm25_med", "_src", "_conf")
    zone = cells.groupBy(*ZONE).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("severity")).alias("s"), F.col("cell").alias("c")))),
            lambda x: x["c"],
        ).alias("cells"),
        F.max_by(anchor, rank).alias("a"),
        F.max(rank).alias("_first"),
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.count("*").cast("int").alias("n_cells"),
    )
    number = F.row_number().over(Window.partitionBy("city").orderBy(F.desc("_first")))
    return (
        zone.join(eps(enforce, attributions, landuse), ZONE)
        .withColumn("action_id", F.format_string("A%02d", number))
        .select(
            "city",
            "action_id",
            "zone_id",
            F.coalesce("a.ward_id", F.lit("unknown")).alias("ward_id"),
            F.coalesce("a.ward_name", F.lit("unknown")).alias("ward_name"),
            "cells",
            F.struct(round_to(F.col("lat"), 4).alias("lat"), round_to(F.col("lon"), 4).alias("lon")).alias("centroid"),
            "eps",
            "components",
            F.col("a.kind").alias("kind"),
            F.coalesce("a._src", F.lit("unknown")).alias("source"),
            F.coalesce("a._conf", F.lit(0.0)).alias("confidence"),
            "n_cells",
            round_to(F.col("a.pm25_med"), 1).alias("pm25_med"),
            F.lit("pending").alias("status"),
        )
    )


def by_eps(queue: DataFrame) -> DataFrame:
    return queue.orderBy("city", F.desc("eps"), "action_id")


def coverage_pairs(queue: DataFrame, hotspots: DataFrame, radius_km: float = COVER_RADIUS_KM, grid: Grid = Grid()) -> DataFrame:
    """(city, action_id, cell, burden): hot cells each stop would cover, weighted by the stop's EPS."""
    stops = queue.select(
        "city", "action_id", "eps", F.col("centroid.lat").alias("t_lat"), F.col("centroid.lon").alias("t_lon")
    )
    cells = add_centre(hotspots.select("city", "cell", "severity"), grid)
    return within_km(cells, stops, radius_km).select(
        "city", "action_id", "eps", "cell", "severity", (F.col("severity") * (F.col("eps") / 100.0)).alias("burden")
    )


def stop_gains(pairs: DataFrame, queue: DataFrame) -> DataFrame:
    """First-round gain of every stop: (city, action_id, gain, n_cells)."""
    g = pairs.groupBy("city", "action_id").agg(F.sum("burden").alias("gain"), F.count("*").alias("n_cells"))
    return queue.select("city", "action_id").join(g, ["city", "action_id"], "left").na.fill(0)


def max_coverage(
    queue: DataFrame, hotspots: DataFrame, budget: int | None = None, radius_km: float = COVER_RADIUS_KM, grid: Grid = Grid()
) -> DataFrame:
    """Greedy stop selection: (city, pick, action_id, gain, coverage_pct).

    Every round adds one stop in every city at once: the largest gain over cells not yet
    covered, the highest EPS (queue order) on a tie, and a city stops when nothing is
    gained, or after ``budget`` rounds. The table of pairs is stored after every round.
    """
    left = cut_lineage(coverage_pairs(queue, hotspots, radius_km, grid))
    burden = hotspots.groupBy("city").agg(F.sum("severity").alias("_all"))
    picks: DataFrame | None = None
    for i in count(1) if budget is None else range(1, budget + 1):
        gains = left.groupBy("city", "action_id", "eps").agg(
            F.sum("burden").alias("gain"), F.sum("severity").alias("covered")
        )
        best = (
            gains.where("gain > 0")
            .groupBy("city")
            .agg(F.min_by(F.struct("action_id", "gain", "covered"), F.struct(-F.col("gain"), -F.col("eps"), F.col("action_id"))).alias("b"))
            .select("city", F.lit(i).alias("pick"), "b.action_id", "b.gain", "b.covered")
        )
        best = cut_lineage(best)
        if best.isEmpty():
            break
        picks = best if picks is None else picks.unionByName(best)
        taken = left.join(F.broadcast(best.select("city", "action_id")), ["city", "action_id"], "left_semi").select("city", "cell")
        left = cut_lineage(left.join(taken, ["city", "cell"], "left_anti"))
    if picks is None:
        schema = "city string, pick int, action_id string, gain double, coverage_pct double"
        return hotspots.sparkSession.createDataFrame([], schema)
    share = picks.groupBy("city").agg(F.sum("covered").alias("_got")).join(burden, "city")
    pct = round_to(F.col("_got") * 100.0 / F.nullif("_all", F.lit(0.0)), 1)
    return picks.join(share, "city").select("city", "pick", "action_id", "gain", pct.alias("coverage_pct"))


def _team_split(teams: int, seed: int, restarts: int = 10):
    """Grouped function: k-means of one city's stops, best of several seeded starts."""

    def split(stops: pd.DataFrame) -> pd.DataFrame:
        stops = stops.sort_values("pick", kind="stable").reset_index(drop=True)
        xy = stops[["lat", "lon"]].to_numpy()
        k = min(teams, len(stops))
        rng = np.random.default_rng(seed)
        best, best_cost = np.zeros(len(stops), dtype=np.int32), np.inf
        for _ in range(restarts if k > 1 else 0):
            mid = xy[rng.choice(len(stops), k, replace=False)]
            for _ in range(50):
                d2 = ((xy[:, None, :] - mid[None]) ** 2).sum(axis=2)
                near = d2.argmin(axis=1)
                moved = np.array([xy[near == j].mean(axis=0) if (near == j).any() else mid[j] for j in range(k)])
                if np.allclose(moved, mid):
                    break
                mid = moved
            cost = d2.min(axis=1).sum()
            if cost < best_cost:
                best, best_cost = near.astype(np.int32), cost
        return stops.assign(team=best + 1)

    return split


def cluster_stops(stops: DataFrame, teams: int = 4, seed: int = 42) -> DataFrame:
    """Add team (1..teams): stops of a city grouped by k-means on position.

    All cities are split in one job; a group is one city's picks, at most the dispatch budget.
    """
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stops.schema.fields)
    return stops.groupBy("city").applyInPandas(_team_split(teams, seed), f"{cols}, team int")


def _visit_order():
    """Grouped function: start at the first pick, then always the closest stop left."""

    def visit(stops: pd.DataFrame) -> pd.DataFrame:
        stops = stops.sort_values("pick", kind="stable").reset_index(drop=True)
        lat, lon = np.radians(stops["lat"].to_numpy()), np.radians(stops["lon"].to_numpy())
        h = np.sin((lat[:, None] - lat) / 2) ** 2
        h = h + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
        km = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(h))
        seq = np.zeros(len(stops), dtype=np.int32)
        here, open_ = 0, np.ones(len(stops), dtype=bool)
        for step in range(1, len(stops) + 1):
            seq[here], open_[here] = step, False
            if open_.any():
                here = int(np.where(open_, km[here], np.inf).argmin())
        return stops.assign(seq=seq)

    return visit


def order_stops(clustered: DataFrame) -> DataFrame:
    """Add seq, the visiting order within (city, team); a team has at most the budget of stops."""
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in clustered.schema.fields)
    return clustered.groupBy("city", "team").applyInPandas(_visit_order(), f"{cols}, seq int")


def route_length(stops: DataFrame) -> DataFrame:
    """(city, team, n_stops, route_km, route_duration_min, route_geometry) along ``seq``."""
    w = Window.partitionBy("city", "team").orderBy("seq")
    leg = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    total = stops.withColumn("_leg", leg).groupBy("city", "team").agg(
        F.count("*").alias("n_stops"),
        F.sum("_leg").alias("_km"),
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))), lambda s: F.array(s["lon"], s["lat"])).alias("_path"),
    )
    km = round_to(F.coalesce("_km", F.lit(0.0)) * ROAD_FACTOR, 1)
    path = F.when(F.col("n_stops") >= 2, F.col("_path")).otherwise(F.array().cast("array<array<double>>"))
    return total.withColumn("route_km", km).select(
        "city", "team", "n_stops", "route_km",
        round_to(F.col("route_km") / SPEED_KMH * 60.0, 1).alias("route_duration_min"), path.alias("route_geometry"),
    )


def dispatch(queue: DataFrame, hotspots: DataFrame, teams: int = 4, budget: int | None = None, grid: Grid = Grid()) -> DataFrame:
    """(city, team_id, stops, route_km, route_duration_min, coverage_pct, route_geometry); idle teams kept."""
    picks = max_coverage(queue, hotspots, budget, grid=grid)
    stops = picks.join(
        queue.select("city", "action_id", "zone_id", "ward_id", "eps", F.col("centroid.lat").alias("lat"), F.col("centroid.lon").alias("lon")),
        ["city", "action_id"],
    )
    ordered = cut_lineage(order_stops(cluster_stops(cut_lineage(stops), teams)))
    detail = ordered.groupBy("city", "team").agg(
        F.sort_array(F.collect_list(F.struct("seq", "action_id", "zone_id", "ward_id", "eps", "lat", "lon"))).alias("stops")
    )
    share = picks.groupBy("city").agg(F.max("coverage_pct").alias("coverage_pct"))
    roster = share.withColumn("team", F.explode(F.sequence(F.lit(1), F.lit(teams))))
    full = roster.join(detail, ["city", "team"], "left").join(route_length(ordered), ["city", "team"], "left")
    return full.select(
        "city", F.format_string("T%d", "team").alias("team_id"), "stops",
        F.coalesce("route_km", F.lit(0.0)).alias("route_km"),
        F.coalesce("route_duration_min", F.lit(0.0)).alias("route_duration_min"), "coverage_pct", "route_geometry",
    )


def zones_from_cells(hotspots: DataFrame) -> DataFrame:
    """Console roll-up of zones: worst kind and severity, lead cell, mean PM2.5, fires, queue."""
    kind_rank: Column = lookup(F.col("kind"), KIND_RANK, 0)
    worst = F.struct(F.col("severity"), -F.col("cell"))
    z = hotspots.groupBy(*ZONE).agg(
        F.max_by("kind", kind_rank).alias("kind"),
        F.max("severity").alias("severity"),
        F.max_by("cell", worst).alias("lead_cell"),
        F.avg("pm25_med").alias("pm25_med"),
        F.count("*").alias("n_cells"),
        F.max("fires_6h").alias("fires_6h"),
        F.bool_or("attributable").alias("attributable"),
    )
    return z.withColumn("queue", F.when(F.col("attributable"), "enforceable").otherwise("diffuse")).withColumn(
        "position", F.row_number().over(Window.partitionBy("city", "queue").orderBy(F.desc("severity"), "zone_id"))
    )
