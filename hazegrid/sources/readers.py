"""Readers for landed feed files and conformers from raw documents to rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.functions.stats import clean
from hazegrid.operators.clean import classify_osm
from hazegrid.sources.channels import Channel

SCHEMAS = {
    "stations": "city string, station_id string, cell long, ts timestamp, lat double, lon double, pm25 double",
    "weather": "city string, ts timestamp, wind_from_deg double, wind_ms double, blh_m double, temp_c double",
    "satellite": "city string, cell long, date date, no2_col double, so2_col double, aai double",
    "fires": "city string, ts timestamp, lat double, lon double, frp double, confidence string",
    "osm": "city string, name string, kind string, tag string, lat double, lon double",
    "field": "city string, cell long, ts timestamp, pm25_hat double",
    "citizen_reports": (
        "city string, id string, ts timestamp, ward_id string, category string, description string, lat double, "
        "lon double, media_url string, source string, language string, chat_id string, status string"
    ),
    "inspection_status": (
        "city string, action_id string, dispatched_at timestamp, actioned_at timestamp, status string, "
        "inspector string, updated_at timestamp"
    ),
}

STATION_PAGE = (
    "struct<id:long,coordinates:struct<latitude:double,longitude:double>,sensors:array<struct<id:long,"
    "parameter:struct<name:string>,results:array<struct<value:double,period:struct<datetimeTo:struct<utc:string>>>>>>>"
)
WEATHER_PAGE = (
    "struct<hourly:struct<time:array<string>,wind_speed_10m:array<double>,wind_direction_10m:array<double>,"
    "temperature_2m:array<double>,boundary_layer_height:array<double>>>"
)
OSM_ELEMENT = (
    "struct<id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>"
)
WARD_FILE = (
    "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
)
FIRE_COLUMNS = ["latitude", "longitude", "acq_date", "acq_time", "frp", "confidence"]

# Retrieval units per satellite channel.
SATELLITE_SCALE = {"no2_col": 1e6, "so2_col": 1e6, "aai": 1.0}


def read_table(spark: SparkSession, path: str, name: str, city: str | None = None) -> DataFrame:
    """A stored feed with its declared schema; a city prunes to its partition."""
    df = spark.read.schema(SCHEMAS[name]).parquet(path)
    return df if city is None else df.where(F.col("city") == city)


def station_hours(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Location documents (JSON text) to station rows: the first PM2.5 sensor, its hourly results.

    ``docs`` holds city and one JSON document per row.
    """
    loc = docs.select("city", F.from_json(column, STATION_PAGE).alias("d"))
    pm = F.get(F.filter("d.sensors", lambda s: s["parameter"]["name"] == "pm25"), F.lit(0))
    rows = loc.withColumn("s", pm).select("city", "d.id", "d.coordinates", F.explode("s.results").alias("r"))
    return rows.select(
        "city",
        F.col("id").cast("string").alias("station_id"),
        F.try_to_timestamp("r.period.datetimeTo.utc").alias("ts"),
        F.col("coordinates.latitude").alias("lat"),
        F.col("coordinates.longitude").alias("lon"),
        clean(F.col("r.value")).alias("pm25"),
    )


def weather_hours(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Column arrays of one document to one row per hour."""
    h = docs.select("city", F.from_json(column, WEATHER_PAGE).alias("d")).select("city", "d.hourly.*")
    zipped = F.arrays_zip("time", "wind_direction_10m", "wind_speed_10m", "boundary_layer_height", "temperature_2m")
    return h.select("city", F.explode(zipped).alias("z")).select(
        "city",
        F.try_to_timestamp("z.time").alias("ts"),
        F.col("z.wind_direction_10m").alias("wind_from_deg"),
        F.col("z.wind_speed_10m").alias("wind_ms"),
        F.col("z.boundary_layer_height").alias("blh_m"),
        F.col("z.temperature_2m").alias("temp_c"),
    )


def read_fire_csv(spark: SparkSession, paths: str | list[str], city: str) -> DataFrame:
    """Fire CSV chunks; a file whose header lacks the expected columns is an error, not data.

    Every file's first line is looked at, and each set of files with one header is read by that header.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    # A file's header is the first line of its first block: one row for each file.
    heads = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("head"))
    names = F.transform(F.split(F.regexp_replace("head", "^\ufeff", ""), ","), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))
    lacks = F.array_except(F.array(*[F.lit(c) for c in FIRE_COLUMNS]), names)
    wrong = heads.withColumn("lacks", lacks).where(F.size("lacks") > 0).orderBy("file").limit(5).collect()
    if wrong:
        told = "; ".join(f"{r.file} lacks {r.lacks}" for r in wrong)
        raise ValueError(f"not a fire detection CSV, missing columns: {told}")
    parts = []
    for head in [r[0] for r in heads.select("head").distinct().orderBy("head").toLocalIterator()]:
        files = [r[0] for r in heads.where(F.col("head") == head).select("file").orderBy("file").toLocalIterator()]
        parts.append(fire_rows(spark.read.option("header", True).csv(files).withColumn("city", F.lit(city))))
    if not parts:
        raise ValueError(f"not a fire detection CSV, missing {list(FIRE_COLUMNS)}")
    return reduce(DataFrame.unionByName, parts)


def fire_rows(raw: DataFrame) -> DataFrame:
    """acq_date and unpadded acq_time (1 to 4 digits) to a UTC timestamp; names conformed."""
    stamp = F.concat_ws(" ", F.col("acq_date").cast("string"), F.lpad(F.col("acq_time").cast("string"), 4, "0"))
    return raw.select(
        "city",
        F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HHmm")).alias("ts"),
        F.col("latitude").cast("double").alias("lat"),
        F.col("longitude").cast("double").alias("lon"),
        F.col("frp").cast("double").alias("frp"),
        F.col("confidence").cast("string").alias("confidence"),
    )


def osm_features(elements: DataFrame, column: str = "doc") -> DataFrame:
    """Map elements (JSON text) to classified features; without a position they are dropped."""
    e = elements.select("city", F.from_json(column, OSM_ELEMENT).alias("e"))
    tags = F.coalesce("e.tags", F.create_map().cast("map<string,string>"))
    kind = classify_osm(F.col("tags"))
    first_three = F.transform(F.slice(F.map_entries("tags"), 1, 3), lambda t: F.concat(t["key"], F.lit("="), t["value"]))
    return (
        e.withColumn("tags", tags)
        .withColumn("kind", kind)
        .select(
            "city",
            F.coalesce(
                F.try_element_at("tags", F.lit("name")), F.concat("kind", F.lit("_"), F.col("e.id").cast("string"))
            ).alias("name"),
            "kind",
            F.array_join(first_three, ";").alias("tag"),
            F.coalesce("e.lat", "e.center.lat").alias("lat"),
            F.coalesce("e.lon", "e.center.lon").alias("lon"),
        )
        .where("lat is not null")
    )


def satellite_days(raw: DataFrame) -> DataFrame:
    """Scale retrievals to working units; what was not observed stays null, never 0."""
    scaled = {c: clean(F.col(c)) * s if s != 1.0 else clean(F.col(c)) for c, s in SATELLITE_SCALE.items()}
    return raw.withColumns(scaled).withColumn("date", F.to_date("date"))


def satellite_coverage(satellite: DataFrame, sparse: float = 0.15) -> DataFrame:
    """(city, coverage, very_sparse): share of cell-days with a usable NO2 column."""
    cover = F.avg(F.col("no2_col").isNotNull().cast("double"))
    return satellite.groupBy("city").agg(cover.alias("coverage")).withColumn("very_sparse", F.col("coverage") < sparse)


def ward_polygons(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Boundary documents to (city, ward_pos, properties, polygons, bbox); other geometries are skipped.

    ``ward_pos`` is the feature's place in the file, so ids survive skipped features.
    """
    from hazegrid.functions.geo import polygons_bbox

    feats = docs.select("city", F.from_json(column, WARD_FILE).alias("d")).select(
        "city", F.posexplode("d.features").alias("ward_pos", "f")
    )
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    shape = F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).when(F.col("f.geometry.type") == "MultiPolygon", many)
    out = feats.select("city", "ward_pos", F.col("f.properties").alias("properties"), shape.alias("polygons"))
    return out.where("polygons is not null").withColumn("bbox", polygons_bbox(F.col("polygons")))


def read_channel(spark: SparkSession, name: str, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """citizen_reports or inspection_status from JSON lines or a database table (see ``channels`` for incremental reads)."""
    if jdbc:
        return Channel(spark, name, jdbc).read()
    return spark.read.schema(SCHEMAS[name]).json(path)


def require_nonempty(df: DataFrame, name: str, cities: DataFrame | None = None) -> DataFrame:
    """``df``, if it has rows, for each of ``cities`` where they are given; the message names those without."""
    if df.isEmpty():
        raise RuntimeError(f"critical feed {name!r} is empty")
    if cities is not None:
        lost = cities.select("city").distinct().join(df.select("city").distinct(), "city", "left_anti").orderBy("city").limit(20).collect()
        if lost:
            raise RuntimeError(f"critical feed {name!r} is empty for {[r.city for r in lost]}")
    return df


def load_feeds(
    loaders: dict[str, Callable[[], DataFrame]],
    critical: set[str],
    fallback: dict[str, DataFrame] | None = None,
    cities: DataFrame | None = None,
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Run the loaders; an empty or failed critical feed stops the run, others degrade.

    With ``cities``, a critical feed must have rows for every one of them.

    Returns the feeds and a note per degraded feed.
    """
    feeds, notes = {}, {}
    for name, load in loaders.items():
        try:
            feeds[name] = require_nonempty(load(), name, cities if name in critical else None)
        except Exception as error:
            if name in critical:
                raise RuntimeError(f"critical feed {name!r} failed: {error}") from error
            notes[name] = f"{type(error).__name__}: {error}"
            if fallback and name in fallback:
                feeds[name] = fallback[name]
    return feeds, notes
