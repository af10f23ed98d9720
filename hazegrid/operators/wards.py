"""Ward dimension: which administrative unit each cell belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions.geo import Grid
from hazegrid.operators.spatial import add_centre, first_polygon, nearest_planar, stamp_cell

UNASSIGNED = "unassigned"
OUTSIDE = "Outside city limits"

# Property keys that may hold a ward's name, in order of preference.
NAME_KEYS = ["KGISWardName", "Ward_Name", "ward_name", "WARD_NAME", "name", "Name", "ward"]


def ward_id(position: Column) -> Column:
    """``W001`` for the first feature of the file."""
    return F.format_string("W%03d", (position + 1).cast("int"))


def ward_name(properties: Column, position: Column) -> Column:
    """First non-empty name key, else the numbered ward with its zone, else the position."""

    def prop(key: str) -> Column:
        value = F.try_element_at(properties, F.lit(key))
        return F.when(value != "", value)

    number = F.try_element_at(properties, F.lit("Ward_No"))
    zone = prop("Zone_Name")
    numbered = F.when(
        number.isNotNull(),
        F.concat(F.lit("Ward "), number, F.coalesce(F.concat(F.lit(" ("), F.initcap(zone), F.lit(")")), F.lit(""))),
    )
    return F.coalesce(
        *[prop(k) for k in NAME_KEYS], numbered, F.format_string("Ward %03d", (position + 1).cast("int"))
    )


def wards_from_polygons(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """(city, cell, ward_id, ward_name): the first polygon, in file order, holding the centre.

    ``polygons`` holds city, ward_pos, properties and polygons.
    """
    named = polygons.select(
        "city",
        "ward_pos",
        "polygons",
        ward_id(F.col("ward_pos")).alias("ward_id"),
        ward_name(F.col("properties"), F.col("ward_pos")).alias("ward_name"),
    )
    hit = first_polygon(cells, named, "ward_pos").select("city", "cell", "ward_id", "ward_name")
    return cells.select("city", "cell").join(hit, ["city", "cell"], "left").select(
        "city",
        "cell",
        F.coalesce("ward_id", F.lit(UNASSIGNED)).alias("ward_id"),
        F.coalesce("ward_name", F.lit(OUTSIDE)).alias("ward_name"),
    )


def pick_seeds(seeds: DataFrame, n: int | None = None) -> DataFrame:
    """The first ``n`` seeds of each city, all by default: the number of fallback wards is a setting."""
    if n is None:
        return seeds
    rank = F.row_number().over(Window.partitionBy("city").orderBy("seed_pos", "seed_lat", "seed_lon"))
    return seeds.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def wards_from_seeds(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nearest-seed wards (Voronoi) in squared equirectangular degrees, ties to the first seed.

    ``seeds`` holds city, seed_pos, seed_lat, seed_lon, any number for a city (see ``pick_seeds`` for fewer).
    """
    centres = seeds.select("city", F.col("seed_pos").alias("_pos"), F.col("seed_lat").alias("c_lat"), F.col("seed_lon").alias("c_lon"))
    near = nearest_planar(cells, centres, ["_pos"], x_scale=F.cos(F.radians(F.avg("lat"))))
    return near.where("nearest IS NOT NULL").select(
        "city",
        "cell",
        ward_id(F.col("nearest._pos")).alias("ward_id"),
        F.format_string("Ward %03d", (F.col("nearest._pos") + 1).cast("int")).alias("ward_name"),
    )


def attach_wards(df: DataFrame, wards: DataFrame) -> DataFrame:
    return df.join(wards.select("city", "cell", "ward_id", "ward_name"), ["city", "cell"], "left")


def ward_centroids(wards: DataFrame, grid: Grid = Grid()) -> DataFrame:
    return (
        add_centre(wards, grid)
        .groupBy("city", "ward_id")
        .agg(F.min("ward_name").alias("ward_name"), F.avg("lat").alias("w_lat"), F.avg("lon").alias("w_lon"))
    )


def locate_ward(points: DataFrame, wards: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Ward of each point: its own cell's, else the ward whose mean centre is closest; null without a position or ward."""
    centres = ward_centroids(wards, grid).select("city", "ward_id", "ward_name", F.col("w_lat").alias("c_lat"), F.col("w_lon").alias("c_lon"))
    exact = stamp_cell(points, grid).join(wards.select("city", "cell", "ward_id", "ward_name"), ["city", "cell"], "left")
    kept = [*points.columns, "cell", "ward_id", "ward_name"]
    # Only positions outside every ward are searched.
    outside = exact.where("ward_id IS NULL").select("city", "lat", "lon").distinct()
    found = nearest_planar(outside, centres, ["ward_id", "ward_name"])
    near = exact.where("ward_id IS NULL").drop("ward_id", "ward_name").join(found, ["city", "lat", "lon"], "left")
    near = near.withColumns({"ward_id": F.col("nearest.ward_id"), "ward_name": F.col("nearest.ward_name")})
    return exact.where("ward_id IS NOT NULL").select(*kept).unionByName(near.select(*kept))
