"""Cleaning and conforming of the landed feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.geo import Grid, round_to
from hazegrid.functions.stats import clean, median_and_mad
from hazegrid.operators.spatial import stamp_cell
from hazegrid.operators.wards import UNASSIGNED

# Accepted codes of the report channel.
REPORT_CATEGORIES = ["industrial", "construction", "waste_burning", "traffic", "other"]
REPORT_SOURCES = ["web", "telegram", "whatsapp"]
REPORT_STATUSES = ["submitted", "under_review", "corroborated", "action_taken", "resolved"]

# Fire confidence letter -> (label, weight).
FIRE_CONFIDENCE = {"l": ("Low", 0.3), "n": ("Nominal", 0.6), "h": ("High", 0.9)}


def qc_station_readings(readings: DataFrame, mad_limit: float = 20.0) -> DataFrame:
    """Drop readings above median + ``mad_limit`` * max(MAD, 1) of their own station."""
    valid = readings.withColumn("pm25", clean(F.col("pm25"))).where("pm25 is not null")
    # One station's readings are bounded by the calendar.
    limits = median_and_mad(valid, "pm25", ["city", "station_id"], small=True).select(
        "city", "station_id", (F.col("med") + F.greatest("mad", F.lit(1.0)) * float(mad_limit)).alias("_limit")
    )
    return valid.join(limits, ["city", "station_id"]).where("pm25 <= _limit").drop("_limit")


def qc_report(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """(city, read, kept, dropped)."""
    before = raw.groupBy("city").agg(F.count("*").alias("read"))
    after = kept.groupBy("city").agg(F.count("*").alias("kept"))
    return before.join(after, "city", "left").select(
        "city", "read", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("read") - F.coalesce("kept", F.lit(0))).alias("dropped")
    )


def floor_hours(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.date_trunc("hour", "ts"))


def hour_axis(stations: DataFrame, weather: DataFrame) -> DataFrame:
    """(city, ts): hours present in both feeds."""
    return stations.select("city", "ts").intersect(weather.select("city", "ts"))


def require_hours(hours: DataFrame, stations: DataFrame, weather: DataFrame) -> DataFrame:
    """Stop with both ranges when the feeds of a city share no hour; the message names the cities.

    Cities with rows in one feed only are for the gate on critical feeds (``readers.load_feeds``).
    """

    def span(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("city").agg(F.struct(F.min("ts").alias("from"), F.max("ts").alias("to")).alias(name))

    spans = span(stations, "s").join(span(weather, "w"), "city").join(hours.select("city").distinct(), "city", "left_anti")
    lost = spans.orderBy("city").limit(20).collect()  # enough for a message
    if lost or hours.isEmpty():
        told = "; ".join(f"{r.city}: stations cover {tuple(r.s)}, weather covers {tuple(r.w)}" for r in lost)
        raise ValueError(f"no common hour. {told}")
    return hours


def canonicalise_ward(reports: DataFrame, wards: DataFrame) -> DataFrame:
    """Turn ward names into ward ids; adds ``ward_fixed``. Unknown text is left as it is."""
    ids = wards.select("city", F.col("ward_id").alias("_wid")).distinct()
    names = (
        wards.groupBy("city", F.upper(F.trim("ward_name")).alias("_wname")).agg(F.max("ward_id").alias("_named"))
    )
    typed = reports.withColumn("_wid", F.trim(F.coalesce("ward_id", F.lit("")))).withColumn("_wname", F.upper("_wid"))
    known = typed.join(ids.withColumn("_known", F.lit(True)), ["city", "_wid"], "left")
    joined = known.join(names, ["city", "_wname"], "left")
    fixed = F.col("_known").isNull() & F.col("_named").isNotNull() & (F.col("_wid") != "")
    return (
        joined.withColumn("ward_fixed", fixed)
        .withColumn("ward_id", F.when(F.col("ward_fixed"), F.col("_named")).otherwise(F.col("ward_id")))
        .select(*reports.columns, "ward_fixed")
    )


def resolve_ward_from_location(reports: DataFrame, wards: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Give a ward to reports that only carry coordinates; adds ``located``."""
    lookup = wards.select("city", "cell", F.col("ward_id").alias("_here"))
    open_ward = F.col("ward_id").isNull() | F.col("ward_id").isin("", UNASSIGNED)
    hit = open_ward & F.col("_here").isNotNull()
    return (
        stamp_cell(reports, grid)
        .join(lookup, ["city", "cell"], "left")
        .withColumn("located", hit)
        .withColumn("ward_id", F.when(F.col("located"), F.col("_here")).otherwise(F.col("ward_id")))
        .select(*reports.columns, "located")
    )


def validate_reports(reports: DataFrame) -> DataFrame:
    """Apply the channel defaults and add ``reject_reason`` (null for accepted rows)."""
    filled = reports.withColumn("source", F.coalesce("source", F.lit("web"))).withColumn(
        "status", F.coalesce("status", F.lit("submitted"))
    )
    reason = (
        F.when(F.col("ward_id").isNull(), "ward_id")
        .when(F.col("category").isNull() | ~F.col("category").isin(REPORT_CATEGORIES), "category")
        .when(~F.col("source").isin(REPORT_SOURCES), "source")
        .when(~F.col("status").isin(REPORT_STATUSES), "status")
    )
    return filled.withColumn("reject_reason", reason)


def classify_osm(tags: Column) -> Column:
    """Feature kind from its tags, first rule wins."""

    def tag(key: str) -> Column:
        return F.try_element_at(tags, F.lit(key))

    road = tag("highway")
    return (
        F.when(tag("landuse") == "industrial", "industrial")
        .when(tag("landuse") == "construction", "construction")
        .when((tag("man_made") == "kiln") | (tag("landuse") == "landfill"), "waste_burning")
        .when(road.isin("motorway", "trunk"), "traffic")
        .when(road.isNotNull() & (road != ""), "road")
        .otherwise(F.coalesce(tag("amenity"), F.lit("other")))
    )


def fire_confidence(letter: Column) -> Column:
    """struct(label, weight); null for an unknown letter."""
    out = None
    for code, (label, weight) in FIRE_CONFIDENCE.items():
        value = F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight"))
        out = F.when(letter == code, value) if out is None else out.when(letter == code, value)
    return out


def source_completeness(
    stations: DataFrame, satellite: DataFrame, fires: DataFrame, weather: DataFrame, osm: DataFrame, reports: DataFrame
) -> DataFrame:
    """(city, source, n_rows, n_units, n_periods, completeness_pct), one aggregate per feed.

    Event-like feeds have no expected rate, so their percentage stays null.
    """

    def pct(x: Column) -> Column:
        return round_to(x * 100.0, 1)

    hour = F.date_trunc("hour", "ts")
    # A station-hour pre-aggregate keeps the distinct counts off the raw rows.
    station_hours = stations.groupBy("city", "station_id", hour.alias("h")).agg(F.count("*").alias("c"))
    st = station_hours.groupBy("city").agg(
        F.sum("c").alias("n_rows"), F.countDistinct("station_id").alias("n_units"), F.countDistinct("h").alias("n_periods")
    )
    st = st.withColumn("completeness_pct", pct(F.col("n_rows") / (F.col("n_units") * F.col("n_periods"))))
    sat = satellite.groupBy("city").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("cell").alias("n_units"),
        F.countDistinct("date").alias("n_periods"),
        pct(F.avg(F.col("no2_col").isNotNull().cast("double"))).alias("completeness_pct"),
    )
    wx = weather.groupBy("city").agg(
        F.count("*").alias("n_rows"),
        F.lit(None).cast("long").alias("n_units"),
        F.countDistinct("ts").alias("n_periods"),
        pct(F.avg(F.col("wind_ms").isNotNull().cast("double"))).alias("completeness_pct"),
    )

    def events(df: DataFrame) -> DataFrame:
        return df.groupBy("city").agg(
            F.count("*").alias("n_rows"),
            F.lit(None).cast("long").alias("n_units"),
            F.lit(None).cast("long").alias("n_periods"),
            F.lit(None).cast("double").alias("completeness_pct"),
        )

    feeds = {
        "stations": st,
        "satellite": sat,
        "fires": events(fires),
        "weather": wx,
        "osm": events(osm),
        "citizen_reports": events(reports),
    }
    out = None
    for name, df in feeds.items():
        part = df.select("city", F.lit(name).alias("source"), "n_rows", "n_units", "n_periods", "completeness_pct")
        out = part if out is None else out.unionByName(part)
    return out
