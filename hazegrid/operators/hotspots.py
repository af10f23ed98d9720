"""Hotspot detection: scores, persistence kinds, enforceability, zones, severity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions.geo import EARTH_RADIUS_KM, Grid, round_to
from hazegrid.functions.stats import exact_quantiles
from hazegrid.operators.signals import FIRE_FRAC_SCALE, WINDOWS, classify_persistence, latest_hours, neighbourhood_contrast, trailing, with_latest
from hazegrid.operators.spatial import add_centre, components, nearest, within_km
from hazegrid.operators.wards import attach_wards
from hazegrid.session import cut_lineage

# Fixed values.
ENFORCEABLE_KINDS = ["industrial", "construction", "waste_burning"]
ATTRIBUTABLE_KM = 0.5
CONTRAST_THRESH = 2.0
ZONE_LINK_KM = 2.0
MAX_ZONE_KM = 5.0
NO_CANDIDATE_KM = 999.0
EPISODE_RATIO = 1.25
KIND_RANK = {"chronic": 3, "emerging": 2, "acute": 1}
PERSISTENCE_WEIGHT = {"chronic": 1.0, "emerging": 0.6, "acute": 0.35}

HOTSPOT_COLUMNS = [
    "city", "cell", "ward_id", "ward_name", "zone_id", "kind", "cell_kind", "attributable", "severity",
    "pm25_med", "nearest_candidate_km", "z_w24h", "z_w7d", "z_w30d", "fires_6h", "detection_basis", "ts",
]


def lookup(key: Column, table: dict, default=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default) if default is not None else out


def zone_scores(panel: DataFrame, at=None, grid: Grid = Grid(), pollutant: str = "no2_col") -> DataFrame:
    """(city, cell, z_w24h, z_w7d, z_w30d, c_no2_col, c_fire): the stronger instrument per window.

    One aggregate over the longest window yields the medians and fire shares of all three;
    the ring contrast of the three medians shares a single neighbour join.
    """
    stamped = with_latest(panel.select("city", "cell", "ts", pollutant, "fires_6h"), at)
    hit = (F.col("fires_6h") > 0).cast("double")
    aggs = []
    for w, h in WINDOWS.items():
        inside = trailing(F.col("ts"), F.col("at"), h)
        aggs.append(F.median(F.when(inside, F.col(pollutant))).alias(f"m_{w}"))
        aggs.append((F.avg(F.when(inside, hit)) / FIRE_FRAC_SCALE).alias(f"f_{w}"))
    per_cell = stamped.where(trailing(F.col("ts"), F.col("at"), max(WINDOWS.values()))).groupBy("city", "cell").agg(*aggs)
    contrast = neighbourhood_contrast(per_cell, {f"k_{w}": f"m_{w}" for w in WINDOWS}, grid=grid)
    both = per_cell.join(contrast, ["city", "cell"], "left")
    zero = F.lit(0.0)
    # greatest() skips nulls: a window only one instrument covers is decided by that one.
    cols = [F.coalesce(F.greatest(f"k_{w}", f"f_{w}"), zero).alias(f"z_{w}") for w in WINDOWS]
    tops = {f"c_{pollutant}": "k", "c_fire": "f"}
    cols += [F.coalesce(F.greatest(*[f"{p}_{w}" for w in WINDOWS]), zero).alias(n) for n, p in tops.items()]
    return both.select("city", "cell", *cols)


def exposure_context(scores: DataFrame, panel: DataFrame, field: DataFrame, at=None) -> DataFrame:
    """Add pm25_med (7-day median of the field, else the median over the city's cells), fires_6h and ts."""
    clock = at if isinstance(at, DataFrame) else with_latest(panel.select("city", "ts"), at).select("city", "at").distinct()
    now = with_latest(panel.select("city", "cell", "ts", "fires_6h"), clock).where("ts = at").select("city", "cell", "fires_6h")
    week = (
        field.join(F.broadcast(clock), "city")  # one row per city
        .where(trailing(F.col("ts"), F.col("at"), 168))
        .groupBy("city", "cell")
        .agg(F.median("pm25_hat").alias("pm25_med"))
    )
    city_med = scores.join(week, ["city", "cell"]).groupBy("city").agg(F.median("pm25_med").alias("_city"))
    return (
        scores.join(week, ["city", "cell"], "left")
        .join(now, ["city", "cell"], "left")
        .join(F.broadcast(city_med), "city", "left")
        .join(F.broadcast(clock), "city")
        .withColumn("pm25_med", F.coalesce("pm25_med", "_city"))
        .withColumn("fires_6h", F.coalesce("fires_6h", F.lit(0)))
        .withColumnRenamed("at", "ts")
        .drop("_city")
    )


def hot_cells(scored: DataFrame, thresh: float = CONTRAST_THRESH) -> DataFrame:
    kind = classify_persistence(F.col("z_w24h"), F.col("z_w7d"), F.col("z_w30d"), thresh)
    return scored.withColumn("kind", kind).where("kind <> 'none'")


def mark_attributable(hot: DataFrame, osm: DataFrame, grid: Grid = Grid(), km: float = ATTRIBUTABLE_KM) -> DataFrame:
    """Add nearest_candidate_km (2 dp, 999 when the city has none) and attributable."""
    cand = osm.where(F.col("kind").isin(ENFORCEABLE_KINDS)).select(
        "city", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")
    )
    near = nearest(add_centre(hot, grid), cand, ["cell"])
    dist = F.coalesce(round_to(F.col("nearest_km"), 2), F.lit(NO_CANDIDATE_KM))
    return near.select(
        *hot.columns,
        dist.alias("nearest_candidate_km"),
        ((dist <= km) | (F.col("c_fire") > 0)).alias("attributable"),
    )


def zone_edges(hot: DataFrame, link_km: float = ZONE_LINK_KM, grid: Grid = Grid()) -> DataFrame:
    """(city, a, b, dist_km, coordinates) for every pair of hot cells within ``link_km``, a < b."""
    pts = add_centre(hot.select("city", "cell"), grid)
    other = pts.select("city", F.col("cell").alias("b"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    pairs = within_km(pts, other, link_km).where("cell < b")
    return pairs.select("city", F.col("cell").alias("a"), "b", "dist_km", "lat", "lon", "t_lat", "t_lon")


def _merge_component(max_km: float):
    """Grouped function: nearest-first merging of one component under a diameter cap."""

    def merge(links: pd.DataFrame) -> pd.DataFrame:
        links = links.sort_values(["dist_km", "a", "b"], kind="stable")
        ends = pd.concat(
            [
                links[["a", "lat", "lon"]].set_axis(["cell", "lat", "lon"], axis=1),
                links[["b", "t_lat", "t_lon"]].set_axis(["cell", "lat", "lon"], axis=1),
            ]
        ).drop_duplicates("cell")
        cells = ends["cell"].to_numpy()
        row = {c: i for i, c in enumerate(cells)}
        la, lo = np.radians(ends["lat"].to_numpy()), np.radians(ends["lon"].to_numpy())
        xyz = np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
        # A great circle of max_km is a chord of this length on the unit sphere.
        widest = 2 * np.sin(max_km / (2 * EARTH_RADIUS_KM)) + 1e-12
        group = np.arange(len(cells))
        parts = {i: np.array([i]) for i in range(len(cells))}
        for a, b in zip(links["a"], links["b"]):
            ga, gb = group[row[a]], group[row[b]]
            if ga == gb:
                continue
            gap = xyz[parts[ga]][:, None, :] - xyz[parts[gb]][None, :, :]
            if np.sqrt((gap * gap).sum(axis=2)).max() > widest:
                continue
            parts[ga] = np.concatenate([parts[ga], parts.pop(gb)])
            group[parts[ga]] = ga
        root = np.array([cells[parts[g]].min() for g in group])
        return pd.DataFrame({"city": links["city"].iloc[0], "cell": cells, "root": root})

    return merge


def capped_zones(hot: DataFrame, link_km: float = ZONE_LINK_KM, max_km: float = MAX_ZONE_KM, grid: Grid = Grid()) -> DataFrame:
    """(city, cell, root): single linkage, nearest pair first, no zone wider than ``max_km``.

    A merge never leaves its connected component, so components are independent. One
    component reaches one task as a row per hot cell pair in reach: its size is bounded by
    the city's area in hexes, not by the number of readings.
    """
    edges = zone_edges(hot, link_km, grid)
    comp = components(hot.select("city", "cell"), edges.select("city", "a", "b"))
    linked = edges.join(comp.withColumnRenamed("cell", "a"), ["city", "a"])
    merged = linked.groupBy("city", "comp").applyInPandas(_merge_component(max_km), "city string, cell long, root long")
    return hot.select("city", "cell").join(merged, ["city", "cell"], "left").select(
        "city", "cell", F.coalesce("root", "cell").alias("root")
    )


def label_zones(roots: DataFrame) -> DataFrame:
    """(city, cell, zone_id): ``Z00`` is the zone holding the city's smallest cell, and so on."""
    first = roots.groupBy("city", "root").agg(F.min("cell").alias("_first"))
    rank = F.dense_rank().over(Window.partitionBy("city").orderBy("_first")) - 1
    names = first.select("city", "root", F.format_string("Z%02d", rank).alias("zone_id"))
    return roots.join(names, ["city", "root"]).select("city", "cell", "zone_id")


def apply_zones(hot: DataFrame, zones: DataFrame) -> DataFrame:
    """Let the zone decide: most persistent kind, enforceable if any member is."""
    joined = hot.join(zones, ["city", "cell"]).withColumnRenamed("kind", "cell_kind")
    verdict = joined.groupBy("city", "zone_id").agg(
        F.max_by("cell_kind", lookup(F.col("cell_kind"), KIND_RANK)).alias("kind"),
        F.bool_or("attributable").alias("_any"),
    )
    return (
        joined.drop("attributable").join(verdict, ["city", "zone_id"]).withColumnRenamed("_any", "attributable")
    )


def reconcile_zones(hot: DataFrame, link_km: float = ZONE_LINK_KM, max_km: float = MAX_ZONE_KM, grid: Grid = Grid()) -> DataFrame:
    return apply_zones(hot, label_zones(capped_zones(hot, link_km, max_km, grid)))


def zone_max() -> Column:
    return F.greatest("z_w24h", "z_w7d", "z_w30d")


def severity(df: DataFrame) -> DataFrame:
    """Contrast, exposure and durability blended into [0, 1], 3 dp."""

    def share(x: Column, full: float) -> Column:
        return F.least(F.greatest(x / full, F.lit(0.0)), F.lit(1.0))

    blend = (
        share(zone_max(), 6.0) * 0.45
        + share(F.col("pm25_med"), 120.0) * 0.35
        + lookup(F.col("kind"), PERSISTENCE_WEIGHT, 0.0) * 0.20
    )
    return df.withColumn("severity", round_to(blend, 3))


def detection_basis(df: DataFrame) -> DataFrame:
    fires = F.when(F.col("fires_6h") > 0, F.format_string("; %d FIRMS detections in last 6 h", F.col("fires_6h").cast("int")))
    head = F.format_string("satellite contrast z=%.1f vs surrounding 4-8 km", round_to(zone_max(), 1))
    return df.withColumn("detection_basis", F.concat(head, F.coalesce(fires, F.lit(""))))


def citywide_episode(field: DataFrame, at=None, ratio: float = EPISODE_RATIO) -> DataFrame:
    """(city, now_med, week_med, episode): is the whole city high against its own week?"""
    stamped = with_latest(field, at)
    now = stamped.where("ts = at").groupBy("city").agg(F.median("pm25_hat").alias("now_med"))
    # A city's week may be a large share of all rows, hence the bracketed quantile.
    week = exact_quantiles(stamped.where(F.col("ts") > F.col("at") - F.expr("INTERVAL 7 DAYS")), ["city"], "pm25_hat", {"week_med": 0.5})
    return now.join(week, "city").withColumn(
        "episode", (F.col("week_med") > 0) & (F.col("now_med") / F.nullif("week_med", F.lit(0.0)) > ratio)
    )


def finish_hotspots(zoned: DataFrame, wards: DataFrame) -> DataFrame:
    """Severity, evidence text and ward of zoned hot cells, in the published columns."""
    full = attach_wards(detection_basis(severity(zoned)), wards)
    rounded = {c: round_to(F.col(c), 2) for c in ("pm25_med", "z_w24h", "z_w7d", "z_w30d")}
    return full.withColumns(rounded).select(*HOTSPOT_COLUMNS)


def detect(panel: DataFrame, field: DataFrame, osm: DataFrame, wards: DataFrame, at=None, grid: Grid = Grid()) -> DataFrame:
    """Hot cells with zone, kind, enforceability and severity; order by severity to publish."""
    clock = at if at is not None else cut_lineage(latest_hours(panel))
    scored = exposure_context(zone_scores(panel, clock, grid), panel, field, clock)
    # Few rows survive; the nearest search and the zone merge below read them many times.
    hot = cut_lineage(hot_cells(scored))
    marked = cut_lineage(mark_attributable(hot, osm, grid))
    return finish_hotspots(reconcile_zones(marked, grid=grid), wards)


def by_severity(hot: DataFrame) -> DataFrame:
    return hot.orderBy(F.desc("severity"), "city", "cell")


def hotspot_summary(hot: DataFrame) -> DataFrame:
    """(city, kind, n_cells, n_zones, enforceable_cells, diffuse_cells)."""
    return hot.groupBy("city", "kind").agg(
        F.count("*").alias("n_cells"),
        F.countDistinct("zone_id").alias("n_zones"),
        F.count_if(F.col("attributable")).alias("enforceable_cells"),
        F.count_if(~F.col("attributable")).alias("diffuse_cells"),
    )
