"""Spatial joins built from equi-joins: fixed radius, nearest, hex rings, polygons.

No operator here compares every pair of a group. One side is spread over the hexes
it can reach, both sides meet on an equi-join key, and an exact test keeps the true
matches, so cost follows the matches. Sides are broadcast only by the adaptive
planner's own size check.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions.geo import (
    _BAND,
    EARTH_RADIUS_KM,
    KM_PER_DEGREE,
    Grid,
    Offset,
    cell_lat,
    cell_lon,
    cell_q,
    haversine_km,
    latlng_to_cell,
    local_band,
    local_cell,
    local_lon,
    offset_array,
    pack,
    point_in_any,
    polygons_bbox,
)
from hazegrid.session import cut_lineage


def stamp_cell(df: DataFrame, grid: Grid = Grid(), lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add the id of the hex that holds each point; null coordinates give a null cell."""
    return df.withColumn("cell", latlng_to_cell(F.col(lat), F.col(lon), grid))


def add_centre(df: DataFrame, grid: Grid = Grid(), lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumn(lat, cell_lat(F.col("cell"), grid)).withColumn(lon, cell_lon(F.col("cell"), grid))


def city_cells(cities: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """(city, cell, lat, lon) for every hex whose centre lies in its city's bounding box.

    ``cities`` holds city, lat_min, lat_max, lon_min, lon_max. Each city is spread by
    hex row first, so a huge box is generated by many tasks.
    """
    row_deg = 1.5 * grid.edge_km / 111.32
    rows = cities.withColumn(
        "_r", F.explode(F.sequence(F.floor(F.col("lat_min") / row_deg), F.ceil(F.col("lat_max") / row_deg)))
    )
    rows = rows.repartition("city", "_r")
    step = grid.edge_km * 3**0.5 / grid.km_per_lon
    q_of = lambda lon: F.col(lon) / step - F.col("_r") / 2.0
    cells = rows.withColumn("_q", F.explode(F.sequence(F.floor(q_of("lon_min")), F.ceil(q_of("lon_max")))))
    out = add_centre(cells.withColumn("cell", pack(F.col("_q"), F.col("_r"))), grid)
    inside = (
        (F.col("lat") >= F.col("lat_min"))
        & (F.col("lat") < F.col("lat_max"))
        & (F.col("lon") >= F.col("lon_min"))
        & (F.col("lon") < F.col("lon_max"))
    )
    return out.where(inside).select("city", "cell", "lat", "lon")


def stamp_local(df: DataFrame, cities: DataFrame, grid: Grid = Grid(), lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add the local cell of each point, on the plane of its city; ``cities`` is as in ``city_cells``."""
    bands = cities.select("city", local_band((F.col("lat_min") + F.col("lat_max")) / 2).alias("_band"))
    return df.join(bands, "city").withColumn("cell", local_cell(F.col(lat), F.col(lon), F.col("_band"), grid)).drop("_band")


def local_city_cells(cities: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """(city, cell, lat, lon) as ``city_cells``, of hexes that are true to scale in each city."""
    row_deg = 1.5 * grid.edge_km / KM_PER_DEGREE
    band = local_band((F.col("lat_min") + F.col("lat_max")) / 2)
    rows = cities.withColumn("_band", band).withColumn(
        "_r", F.explode(F.sequence(F.floor(F.col("lat_min") / row_deg), F.ceil(F.col("lat_max") / row_deg)))
    )
    rows = rows.repartition("city", "_r")
    # Two corners of the box tell the row's hexes.
    q_at = lambda lon: cell_q(local_cell(F.col("_r") * row_deg, F.col(lon), F.col("_band"), grid))
    cells = rows.withColumn("_q", F.explode(F.sequence(q_at("lon_min") - 1, q_at("lon_max") + 1)))
    cells = cells.withColumn("cell", pack(F.col("_q"), F.col("_r")) + F.col("_band") * F.lit(_BAND))
    out = cells.withColumns({"lat": cell_lat(F.col("cell"), grid), "lon": local_lon(F.col("cell"), grid)})
    inside = "lat >= lat_min AND lat < lat_max AND lon >= lon_min AND lon < lon_max"
    return out.where(inside).select("city", "cell", "lat", "lon")


def _boxes_round(band: Column, size_deg: float) -> Column:
    """Boxes of a latitude band: as many of at least the band's height as fit round the globe there."""
    widest = F.greatest(F.cos(F.radians((band + 0.5) * size_deg)), F.lit(0.0))
    return F.greatest(F.floor(360.0 / size_deg * widest), F.lit(1)).cast("long")


def within_km(
    points: DataFrame, targets: DataFrame, radius_km: float, by: Sequence[str] = ("city",), out: str = "dist_km"
) -> DataFrame:
    """Every (point, target) with great-circle distance <= ``radius_km``, at any latitude.

    ``points`` carries lat/lon, ``targets`` carries t_lat/t_lon. Both sides meet on boxes: bands of
    latitude, each cut into boxes of its own width. A target is spread over the boxes its circle
    touches, so every row uses the scale of its own place; give the side with fewer rows per box as
    ``targets``.
    """
    reach = radius_km / EARTH_RADIUS_KM  # radians
    size = math.degrees(reach) / 2
    deg = math.degrees(reach) * (1 + 1e-9) + 1e-9

    def box(lon: Column, band: Column) -> Column:
        return F.floor((lon + 180.0) / 360.0 * _boxes_round(band, size)).cast("long")

    left = points.withColumn("_band", F.floor(F.col("lat") / size).cast("long"))
    left = left.withColumn("_box", F.pmod(box(F.col("lon"), F.col("_band")), _boxes_round(F.col("_band"), size)))
    # The meridians that touch the circle; all of them if it holds a pole.
    ratio = math.sin(min(reach, math.pi / 2)) / F.cos(F.radians("t_lat"))
    pole = (F.abs("t_lat") + deg >= 90.0) | (ratio >= 1.0)
    side = F.when(pole, 180.0).otherwise(F.degrees(F.asin(F.when(ratio < 1.0, ratio).otherwise(1.0))) * (1 + 1e-9) + 1e-9)
    bands = F.sequence(F.floor((F.col("t_lat") - deg) / size).cast("long"), F.floor((F.col("t_lat") + deg) / size).cast("long"))
    right = targets.where("t_lat IS NOT NULL AND t_lon IS NOT NULL").withColumn("_band", F.explode(bands)).withColumn("_side", side)
    n = _boxes_round(F.col("_band"), size)
    first, last = box(F.col("t_lon") - F.col("_side"), F.col("_band")), box(F.col("t_lon") + F.col("_side"), F.col("_band"))
    boxes = F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda i: F.pmod(i, n))
    right = right.withColumn("_box", F.explode(boxes)).drop("_side")
    pairs = left.join(right, [*by, "_band", "_box"]).drop("_band", "_box")
    dist = haversine_km(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
    return pairs.withColumn(out, dist).where(F.col(out) <= radius_km)


def nearest(
    points: DataFrame,
    targets: DataFrame,
    key: Sequence[str],
    carry: Sequence[str] = (),
    by: Sequence[str] = ("city",),
    out: str = "nearest_km",
    radii: Sequence[float] = (2.0, 8.0, 32.0, 128.0),
) -> DataFrame:
    """Distance (and ``carry`` columns) of the closest target of every point; null if none.

    Expanding search: each pass looks within one radius on boxes sized to that radius and
    only unmatched points go on. Points still alone after the last radius (none, at city
    scale) are compared with all distinct targets of their group, so the answer is exact.
    ``key`` identifies a point; ties go to the smallest carried values.
    """
    by, key = list(by), list(key)
    pts = points.select(*dict.fromkeys([*by, *key, "lat", "lon"])).distinct()
    tgt = targets.select(*dict.fromkeys([*by, *carry, "t_lat", "t_lon"])).distinct()
    best = F.min(F.struct(F.col(out), *[F.col(c) for c in carry])).alias("_best")
    ids = list(dict.fromkeys([*by, *key]))
    found: list[DataFrame] = []
    rest = pts
    for radius in radii:
        hits = cut_lineage(within_km(rest, tgt, radius, by, out).groupBy(*ids).agg(best))
        found.append(hits)
        rest = rest.join(hits, ids, "left_anti")
        if rest.isEmpty():
            break
    else:
        gap = haversine_km(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
        found.append(rest.join(tgt, by).withColumn(out, gap).groupBy(*ids).agg(best))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    cols = [F.col(f"_best.{c}").alias(c) for c in [out, *carry]]
    return points.join(hits.select(*ids, *cols), ids, "left")


def nearest_planar(
    points: DataFrame,
    centres: DataFrame,
    carry: Sequence[str],
    x_scale: Column | None = None,
    by: Sequence[str] = ("city",),
    out: str = "nearest",
) -> DataFrame:
    """Add ``out``, a struct of the closest centre's d2 and ``carry`` columns, to every point; null if its group has none.

    Points carry lat/lon, centres c_lat/c_lon; d2 is dlat^2 + (dlon * x_scale)^2 in degrees, ``x_scale`` an aggregate
    over the group's points (1 by default). Ties go to the smallest carried values.

    Centres lie in square buckets about as wide as they are apart in their group. A point first looks at the ring
    of buckets around its own; the best centre is final if it is closer than the ring's border. Other points come down
    a tree of the occupied buckets, 16 children a node, and keep at each level the nodes that can still hold the
    closest centre, judged by the boxes of the centres inside. No row carries all centres.
    """
    by = list(by)
    fan = 4
    here = points.where("lat IS NOT NULL AND lon IS NOT NULL").select(*by, "lat", "lon").distinct()
    scale = F.lit(1.0) if x_scale is None else x_scale
    scales = points.groupBy(*by).agg(F.max(scale).alias("_sx") if x_scale is None else scale.alias("_sx"))
    c = centres.where("c_lat IS NOT NULL AND c_lon IS NOT NULL").select(*dict.fromkeys([*by, *carry, "c_lat", "c_lon"])).distinct()
    high, wide = F.max("c_lat") - F.min("c_lat"), F.max("c_lon") - F.min("c_lon")
    size = F.greatest(F.sqrt(high * wide / F.count("*")), F.greatest(high, wide) / F.count("*"), F.lit(1e-9))
    groups = cut_lineage(
        c.groupBy(*by)
        .agg(F.min("c_lat").alias("_y0"), F.min("c_lon").alias("_x0"), size.alias("_s"), F.greatest(high, wide).alias("_e"))
        .join(scales, by)
    )
    deepest = groups.agg(F.max(F.ceil(F.log(F.greatest(F.col("_e") / F.col("_s"), F.lit(1.0))) / math.log(fan)))).first()[0]
    if deepest is None:
        kept = [centres.schema[k] for k in carry]
        kind = "struct<d2:double," + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in kept) + ">"
        return points.withColumn(out, F.lit(None).cast(kind))
    levels = int(deepest) + 1

    def bucket(df: DataFrame, lat: str, lon: str) -> DataFrame:
        row, column = F.floor((F.col(lat) - F.col("_y0")) / F.col("_s")), F.floor((F.col(lon) - F.col("_x0")) / F.col("_s"))
        return df.join(groups, by).withColumn("_i", row.cast("long")).withColumn("_j", column.cast("long"))

    # Centres with their bucket at level 0, and the occupied nodes of every level with the box of their centres.
    leaves = cut_lineage(bucket(c, "c_lat", "c_lon").select(*by, "_i", "_j", "c_lat", "c_lon", *[k for k in carry if k not in by]))
    box = [F.min("_la").alias("_la"), F.max("_lb").alias("_lb"), F.min("_oa").alias("_oa"), F.max("_ob").alias("_ob")]
    nodes = [
        leaves.groupBy(*by, "_i", "_j").agg(
            F.min("c_lat").alias("_la"), F.max("c_lat").alias("_lb"), F.min("c_lon").alias("_oa"), F.max("c_lon").alias("_ob")
        )
    ]
    for _ in range(levels):
        parent = [F.floor(F.col(k) / fan).cast("long").alias(k) for k in ("_i", "_j")]
        nodes.append(nodes[-1].select(*by, *parent, "_la", "_lb", "_oa", "_ob").groupBy(*by, "_i", "_j").agg(*box))

    def squared(dy: Column, dx: Column) -> Column:
        x = dx * F.col("_sx")
        return dy * dy + x * x

    best = F.min(F.struct(squared(F.col("lat") - F.col("c_lat"), F.col("lon") - F.col("c_lon")).alias("d2"), *[F.col(k) for k in carry])).alias(out)
    spot = [*by, "lat", "lon"]
    placed = bucket(here, "lat", "lon")
    # The ring: distance to its border is the bound within which the answer is final.
    low = lambda v, o, k: F.col(v) - (F.col(o) + (F.col(k) - 1) * F.col("_s"))
    up = lambda v, o, k: (F.col(o) + (F.col(k) + 2) * F.col("_s")) - F.col(v)
    reach = F.least(low("lat", "_y0", "_i"), up("lat", "_y0", "_i"), low("lon", "_x0", "_j") * F.col("_sx"), up("lon", "_x0", "_j") * F.col("_sx"))
    ring = F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(_i + a AS i, _j + b AS j))))"))
    near = placed.withColumn("_reach", reach).withColumn("_b", ring).withColumns({"_i": F.col("_b.i"), "_j": F.col("_b.j")}).drop("_b")
    first = near.join(leaves, [*by, "_i", "_j"]).groupBy(*spot, "_reach").agg(best)
    sure = F.sqrt(F.col(f"{out}.d2")) < F.col("_reach") * (1 - 1e-9) - 1e-12
    done = cut_lineage(first.where(sure).select(*spot, out))
    # The rest comes down the tree from its root.
    paths = here.join(done, spot, "left_anti").join(groups, by).select(*spot, "_sx").withColumns({"_i": F.lit(0).cast("long"), "_j": F.lit(0).cast("long")})
    least = lambda v, a, b: F.greatest(F.col(a) - F.col(v), F.col(v) - F.col(b), F.lit(0.0))
    most = lambda v, a, b: F.greatest(F.abs(F.col(v) - F.col(a)), F.abs(F.col(v) - F.col(b)))
    for level in reversed(range(levels)):
        own = nodes[level].withColumns({"_pi": F.floor(F.col("_i") / fan).cast("long"), "_pj": F.floor(F.col("_j") / fan).cast("long")})
        met = paths.withColumnsRenamed({"_i": "_pi", "_j": "_pj"}).join(own, [*by, "_pi", "_pj"])
        met = met.withColumn("_least", squared(least("lat", "_la", "_lb"), least("lon", "_oa", "_ob")))
        met = met.withColumn("_most", F.min(squared(most("lat", "_la", "_lb"), most("lon", "_oa", "_ob"))).over(Window.partitionBy(*spot)))
        paths = met.where("_least <= _most").select(*spot, "_sx", "_i", "_j")
    far = paths.join(leaves, [*by, "_i", "_j"]).groupBy(*spot).agg(best)
    return points.join(done.unionByName(far.select(*spot, out)), spot, "left")


def ring_neighbours(
    centres: DataFrame, values: DataFrame, shape: Sequence[Offset], by: Sequence[str] = ("city",)
) -> DataFrame:
    """One row per centre and existing neighbour at the given offsets, with ring, km and bearing.

    ``values`` holds (by, cell, ...); its columns arrive under their own names and the
    centre's cell under ``centre``. Centres are spread over tasks before they multiply.
    """
    spread = (
        centres.select(*by, F.col("cell").alias("centre"))
        .repartition(*by, "centre")
        .select(*by, "centre", F.explode(offset_array(list(shape))).alias("o"))
        .select(*by, "centre", (F.col("centre") + F.col("o.delta")).alias("cell"), "o.ring", "o.ring_km", "o.ring_bearing")
    )
    return spread.join(values, [*by, "cell"])


def first_polygon(
    points: DataFrame, polygons: DataFrame, order: str, bucket_deg: float = 0.05, by: Sequence[str] = ("city",)
) -> DataFrame:
    """Attach to each point the first polygon (by ``order``) that contains it.

    Polygons meet points on square buckets of their bounding boxes; the ray cast runs
    only on those candidates. Points outside every polygon are dropped.
    """

    def bucket(x: Column) -> Column:
        return F.floor(x / bucket_deg).cast("long")

    boxed = polygons.withColumn("_box", polygons_bbox(F.col("polygons")))
    boxed = boxed.withColumn("_bx", F.explode(F.sequence(bucket(F.col("_box.x0")), bucket(F.col("_box.x1")))))
    boxed = boxed.withColumn("_by", F.explode(F.sequence(bucket(F.col("_box.y0")), bucket(F.col("_box.y1")))))
    pts = points.select(*by, "lat", "lon").distinct()
    pts = pts.withColumn("_bx", bucket(F.col("lon"))).withColumn("_by", bucket(F.col("lat")))
    in_box = (
        (F.col("lon") >= F.col("_box.x0"))
        & (F.col("lon") <= F.col("_box.x1"))
        & (F.col("lat") >= F.col("_box.y0"))
        & (F.col("lat") <= F.col("_box.y1"))
    )
    hits = (
        pts.join(boxed, [*by, "_bx", "_by"])
        .where(in_box)
        .where(point_in_any(F.col("lon"), F.col("lat"), F.col("polygons")))
    )
    attrs = [c for c in polygons.columns if c not in (*by, "polygons")]
    first = hits.groupBy(*by, "lat", "lon").agg(
        F.min_by(F.struct(*attrs), F.col(order)).alias("_first")
    )
    return points.join(first, [*by, "lat", "lon"]).select(
        *points.columns, *[F.col(f"_first.{a}").alias(a) for a in attrs]
    )


def components(nodes: DataFrame, edges: DataFrame, key: Sequence[str] = ("city",)) -> DataFrame:
    """Connected components: (key, cell, comp), comp being the smallest cell of the component.

    Each round takes the smallest label among the neighbours and then jumps to that
    label's own label, so long chains shrink geometrically; lineage is cut every round.
    """
    key = list(key)
    both = cut_lineage(
        edges.select(*key, F.col("a").alias("cell"), F.col("b").alias("other")).unionByName(
            edges.select(*key, F.col("b").alias("cell"), F.col("a").alias("other"))
        )
    )
    labels = cut_lineage(nodes.select(*key, "cell", F.col("cell").alias("comp")))

    def spread(df: DataFrame) -> DataFrame:
        heard = (
            both.join(df.select(*key, F.col("cell").alias("other"), "comp"), [*key, "other"])
            .groupBy(*key, "cell")
            .agg(F.min("comp").alias("heard"))
        )
        return df.join(heard, [*key, "cell"], "left").withColumn("comp", F.least("comp", F.coalesce("heard", "comp"))).drop("heard")

    while True:
        # Two hops and one jump per round: fewer rounds, each still a handful of equi-joins.
        nearer = spread(spread(labels.withColumn("was", F.col("comp"))))
        jump = nearer.select(*key, F.col("cell").alias("comp"), F.col("comp").alias("root"))
        stepped = cut_lineage(
            nearer.join(jump, [*key, "comp"], "left").select(
                *key, "cell", "was", F.least("comp", F.coalesce("root", "comp")).alias("comp")
            )
        )
        labels = stepped.select(*key, "cell", "comp")
        if stepped.where("comp <> was").isEmpty():
            return labels
