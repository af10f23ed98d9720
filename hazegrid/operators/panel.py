"""The cell x hour feature table.

Everything is joined at cell x day grain, 24 times fewer rows than the result: the
citywide hours (with weather) ride in one array per (city, date) and the sparse hourly
features in one map per (city, cell, date), both at most 24 entries. Exploding the
hours is the last, narrow step, so the hourly spine itself is never shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions.stats import clean
from hazegrid.operators.clean import require_hours
from hazegrid.operators.spatial import within_km
from hazegrid.session import cut_lineage

LANDUSE_KINDS = ["industrial", "construction", "waste_burning", "traffic", "road"]
LANDUSE = [f"lu_{k}" for k in LANDUSE_KINDS] + ["lu_sensitive"]
SATELLITE = ["no2_col", "so2_col", "aai"]
WEATHER = ["wind_from_deg", "wind_ms", "blh_m", "temp_c"]
PANEL_COLUMNS = [
    "city", "cell", "ts", "pm25_station", *WEATHER, *SATELLITE, "fires_6h", "frp_6h",
    *LANDUSE, "ward_id", "ward_name", "hour", "dow", "date",
]


def station_cell_hour(stations: DataFrame) -> DataFrame:
    """Mean reading per (city, cell, hour)."""
    return stations.groupBy("city", "cell", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.avg(clean(F.col("pm25"))).alias("pm25_station")
    )


def join_weather(df: DataFrame, weather: DataFrame) -> DataFrame:
    return df.join(weather, ["city", "ts"], "left")


def spine(cells: DataFrame, hours: DataFrame) -> DataFrame:
    """Dense (city, cell, ts), spread by cell and day rather than by city."""
    return _cell_days(cells, hours).join(_hours_by_day(hours), ["city", "date"]).select(
        "city", "cell", F.explode("hours.ts").alias("ts")
    )


def _cell_days(cells: DataFrame, hours: DataFrame) -> DataFrame:
    """(city, cell, date) for the days with hours; one calendar span per city is broadcast."""
    span = hours.groupBy("city").agg(
        F.min(F.to_date("ts")).alias("_from"), F.max(F.to_date("ts")).alias("_to")
    )
    days = hours.select("city", F.to_date("ts").alias("date")).distinct()
    calendar = cells.select("city", "cell").join(F.broadcast(span), "city").select(
        "city", "cell", F.explode(F.sequence("_from", "_to")).alias("date")
    )
    return calendar.join(days, ["city", "date"], "left_semi")


def _hours_by_day(hours: DataFrame) -> DataFrame:
    """One row per (city, date) with its hours in an array (at most 24)."""
    attrs = [c for c in hours.columns if c != "city"]
    return hours.groupBy("city", F.to_date("ts").alias("date")).agg(
        F.sort_array(F.collect_list(F.struct("ts", *[c for c in attrs if c != "ts"]))).alias("hours")
    )


def index_hours(hours: DataFrame) -> DataFrame:
    """Add ``idx``, the position of the hour on its city's axis (one row per calendar hour)."""
    return hours.withColumn("idx", F.row_number().over(Window.partitionBy("city").orderBy("ts")))


def fill_satellite(cell_days: DataFrame, satellite: DataFrame) -> DataFrame:
    """Join by (city, cell, date), then carry each cell's own last seen (else next) value."""
    joined = cell_days.join(satellite.select("city", "cell", "date", *SATELLITE), ["city", "cell", "date"], "left")
    back = Window.partitionBy("city", "cell").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    # The next value is the last one seen when walking backwards: a running frame, not one per row.
    ahead = Window.partitionBy("city", "cell").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns(
        {c: F.coalesce(F.last(c, True).over(back), F.last(c, True).over(ahead)) for c in SATELLITE}
    )


def fire_features(
    cells: DataFrame, fires: DataFrame, hours: DataFrame, radius_km: float = 1.5, hours_back: int = 6
) -> DataFrame:
    """Sparse (city, cell, ts, fires_6h, frp_6h): fires near the cell in the trailing rows of the axis.

    Fires collapse to (position, hour) first, so a site holding most detections carries at
    most one row per hour; near cells are found once per distinct position. Each fire then
    adds itself to the ``hours_back`` axis rows it counts for, instead of a sliding window
    over the dense spine. Rows that are absent mean 0.
    """
    axis = index_hours(hours.select("city", "ts"))
    hourly = fires.groupBy("city", "lat", "lon", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("frp", F.lit(0.0))).alias("frp")
    )
    placed = hourly.join(axis, ["city", "ts"]).select("city", "lat", "lon", "idx", "n", "frp")
    positions = placed.select("city", "lat", "lon").distinct()
    near = within_km(
        positions, cells.select("city", "cell", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")), radius_km
    ).select("city", "lat", "lon", "cell")
    felt = (
        placed.join(near, ["city", "lat", "lon"])
        .groupBy("city", "cell", "idx")
        .agg(F.sum("n").alias("n"), F.sum("frp").alias("frp"))
        .withColumn("idx", F.explode(F.sequence(F.col("idx"), F.col("idx") + (hours_back - 1))))
        .groupBy("city", "cell", "idx")
        .agg(F.sum("n").cast("int").alias("fires_6h"), F.sum("frp").alias("frp_6h"))
    )
    return felt.join(axis, ["city", "idx"]).select("city", "cell", "ts", "fires_6h", "frp_6h")


def landuse_features(cells: DataFrame, osm: DataFrame, radius_km: float = 1.5) -> DataFrame:
    """(city, cell, lu_*): counts of each feature kind near the cell, 0 when none.

    Features collapse to counts per position first, so stacked copies cost one row.
    """
    counts = {f"lu_{k}": F.sum((F.col("kind") == k).cast("int")) for k in LANDUSE_KINDS}
    counts["lu_sensitive"] = F.sum(F.col("kind").isin("school", "hospital").cast("int"))
    sites = osm.groupBy("city", "lat", "lon").agg(*[c.alias(n) for n, c in counts.items()])
    targets = cells.select("city", "cell", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    near = within_km(sites, targets, radius_km).groupBy("city", "cell").agg(
        *[F.sum(n).cast("int").alias(n) for n in LANDUSE]
    )
    return cells.select("city", "cell").join(near, ["city", "cell"], "left").select(
        "city", "cell", *[F.coalesce(n, F.lit(0)).alias(n) for n in LANDUSE]
    )


def time_features(df: DataFrame) -> DataFrame:
    """Hour of day and day of week (Monday = 0)."""
    return df.withColumns({"hour": F.hour("ts"), "dow": F.weekday("ts")})


def light_panel(stations: DataFrame, weather: DataFrame) -> DataFrame:
    """Labelled cell-hours with weather only: enough to score a forecast."""
    wx = weather.withColumn("ts", F.date_trunc("hour", "ts"))
    return join_weather(station_cell_hour(stations).where("pm25_station is not null"), wx)


def build_panel(
    cells: DataFrame,
    stations: DataFrame,
    weather: DataFrame,
    satellite: DataFrame,
    fires: DataFrame,
    osm: DataFrame,
    wards: DataFrame,
    landuse: DataFrame | None = None,
) -> DataFrame:
    """All covariates of every (city, cell, hour) on the hours both feeds cover.

    ``landuse`` takes a stored ``landuse_features`` table; without it the counts are made here.
    """
    landuse = landuse_features(cells, osm) if landuse is None else landuse
    wx = weather.withColumn("ts", F.date_trunc("hour", "ts"))
    labels = station_cell_hour(stations)
    station_hours = stations.select("city", F.date_trunc("hour", "ts").alias("ts")).distinct()
    # One row per city and hour, read five times below: settle it so the readings are scanned once for it.
    hours = cut_lineage(wx.join(station_hours, ["city", "ts"], "left_semi").select("city", "ts", *WEATHER))
    require_hours(hours, station_hours, wx)
    burning = fire_features(cells, fires, hours)
    sparse = (
        labels.select("city", "cell", "ts", "pm25_station", F.lit(None).cast("int").alias("fires_6h"), F.lit(None).cast("double").alias("frp_6h"))
        .unionByName(burning.withColumn("pm25_station", F.lit(None).cast("double")))
        .groupBy("city", "cell", "ts")
        .agg(F.max("pm25_station").alias("pm25"), F.max("fires_6h").alias("fires"), F.max("frp_6h").alias("frp"))
        .groupBy("city", "cell", F.to_date("ts").alias("date"))
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct(F.hour("ts").alias("h"), F.struct("pm25", "fires", "frp").alias("v")))
            ).alias("seen")
        )
    )
    days = (
        fill_satellite(_cell_days(cells, hours), satellite)
        .join(sparse, ["city", "cell", "date"], "left")
        .join(landuse, ["city", "cell"], "left")
        .join(wards.select("city", "cell", "ward_id", "ward_name"), ["city", "cell"], "left")
        .join(_hours_by_day(hours), ["city", "date"])
    )
    hourly = days.withColumn("w", F.explode("hours")).withColumn("v", F.try_element_at("seen", F.hour("w.ts")))
    rows = hourly.select(
        "city",
        "cell",
        "w.ts",
        F.col("v.pm25").alias("pm25_station"),
        *[F.col(f"w.{c}").alias(c) for c in WEATHER],
        *SATELLITE,
        F.coalesce("v.fires", F.lit(0)).alias("fires_6h"),
        F.coalesce("v.frp", F.lit(0.0)).alias("frp_6h"),
        *LANDUSE,
        "ward_id",
        "ward_name",
        "date",
    )
    return time_features(rows).select(*PANEL_COLUMNS)
