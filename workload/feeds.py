"""The driver tables seen as air-quality feeds, and the stages built on them.

Positions are arithmetic on keys, written the same way in ``sqlkit``. Stages that several
queries read are written once per session to the shared folder.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.functions.geo import Grid, disk, latlng_to_cell, round_to
from hazegrid.operators import attribution, clean, exposure, hotspots, panel, priority, signals, wards
from hazegrid.operators.spatial import city_cells, stamp_cell
from hazegrid.session import materialise, tune

GRID = Grid(edge_km=0.46, ref_lat=28.6)
EPOCH_HOUR = 473_352  # 2024-01-01 00:00 UTC in hours
OSM_KINDS = ["industrial", "construction", "waste_burning", "traffic", "road", "school", "hospital"]
HOT_THRESH = 1.0

_CACHE: dict[tuple, "Feeds"] = {}


def feeds(spark: SparkSession, sf_dir: str) -> "Feeds":
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = Feeds(tune(spark), sf_dir)
    return _CACHE[key]


def fx(c: Column | str, digits: int = 6) -> Column:
    """Round for comparison; a tiny upward nudge keeps exact ties on one side in both engines."""
    x = F.col(c) if isinstance(c, str) else c
    scale = 10.0**digits
    return F.floor(x * scale + 0.501) / scale


def text_ts(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def site_lat(k: Column) -> Column:
    return F.lit(28.45) + F.lit(0.01) * (k % 30)


def site_lon(k: Column) -> Column:
    return F.lit(76.95) + F.lit(0.01) * (F.floor(k / 30) % 40)


def band_row(lat: Column) -> Column:
    return F.least(F.lit(4), F.greatest(F.lit(0), F.floor((lat - 28.45) / 0.06))).cast("int")


class Feeds:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def with_city(self, df: DataFrame, lat: str = "lat") -> DataFrame:
        """City = the region whose latitude band holds the point (5 bands)."""
        region = self.table("region").select(F.col("r_regionkey").alias("_row"), F.col("r_name").alias("city"))
        return df.withColumn("_row", band_row(F.col(lat))).join(region, "_row").drop("_row")

    # ------------------------------------------------------------------ feeds

    @property
    def cities(self) -> DataFrame:
        row = F.col("r_regionkey")
        return self.table("region").select(
            F.col("r_name").alias("city"),
            (F.lit(28.45) + F.lit(0.06) * row).alias("lat_min"),
            (F.lit(28.45) + F.lit(0.06) * (row + 1)).alias("lat_max"),
            F.lit(76.95).alias("lon_min"),
            F.lit(77.35).alias("lon_max"),
        )

    @property
    def events(self) -> DataFrame:
        k = F.col("user_id")
        ev = self.table("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
            site_lat(k).alias("lat"), site_lon(k).alias("lon"),
        )
        return self.with_city(ev)

    @property
    def stations(self) -> DataFrame:
        return stamp_cell(self.events, GRID).select(
            "city", F.concat(F.lit("ST_"), F.col("user_id").cast("string")).alias("station_id"), "cell", "ts", "lat", "lon",
            F.col("value").alias("pm25"),
        )

    @property
    def weather(self) -> DataFrame:
        hours = self.table("events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).distinct()
        h = F.floor(F.unix_timestamp("ts") / 3600).cast("long") - EPOCH_HOUR
        series = hours.select(
            "ts",
            ((h * 37) % 360).cast("double").alias("wind_from_deg"),
            (h % 5 + 1).cast("double").alias("wind_ms"),
            (h % 24 * 50 + 200).cast("double").alias("blh_m"),
            (h % 20 + 15).cast("double").alias("temp_c"),
        )
        region = self.table("region").select(F.col("r_regionkey").alias("_row"), F.col("r_name").alias("city"))
        return series.withColumn("_row", F.explode(F.sequence(F.lit(0), F.lit(4)))).join(region, "_row").drop("_row")

    @property
    def fires(self) -> DataFrame:
        e = F.col("event_id")
        conf = F.when(e % 3 == 0, "l").when(e % 3 == 1, "n").otherwise("h")
        return self.events.where("event_type = 'error'").select(
            "city", "ts", (F.col("lat") + F.lit(0.001) * (e % 7)).alias("lat"), "lon", F.col("value").alias("frp"),
            conf.alias("confidence"),
        )

    @property
    def satellite(self) -> DataFrame:
        """A view is seen by every hex within two rings of its site, as a coarse footprint would.

        The gain keeps averages off the exact rounding ties of two-decimal values.
        """
        own = latlng_to_cell(F.col("lat"), F.col("lon"), GRID)
        seen = self.events.where("event_type = 'view'").select(
            "city", F.to_date("ts").alias("date"), "value", "event_id", F.explode(disk(own, 2)).alias("cell")
        )
        cloudy = F.max("event_id") % 6 == 0
        return seen.groupBy("city", "cell", "date").agg(
            F.when(~cloudy, F.avg("value") * 1.0037).alias("no2_col"),
            F.when(~cloudy, F.min("value") - 20.0).alias("so2_col"),
            F.when(~cloudy, F.max("value") / 100.0).alias("aai"),
        )

    @property
    def osm(self) -> DataFrame:
        def features(table: str, key: str, name: str) -> DataFrame:
            k = F.col(key)
            kind = F.get(F.array(*[F.lit(x) for x in OSM_KINDS]), (k % 7).cast("int"))
            return self.table(table).select(
                F.col(name).alias("name"), kind.alias("kind"), F.concat(F.lit("k="), kind).alias("tag"),
                site_lat(k * 7).alias("lat"), site_lon(k * 7).alias("lon"),
            )

        both = features("supplier", "s_suppkey", "s_name").unionByName(features("part", "p_partkey", "p_name"))
        return self.with_city(both).select("city", "name", "kind", "tag", "lat", "lon")

    @property
    def polygons(self) -> DataFrame:
        """25 rectangles on a 5 x 5 grid; the middle one has a hole."""
        n = F.col("n_nationkey")
        y0 = F.lit(28.45) + F.lit(0.06) * (n % 5)
        x0 = F.lit(76.95) + F.lit(0.08) * F.floor(n / 5)

        def box(dx0, dy0, dx1, dy1):
            pt = lambda dx, dy: F.array(x0 + dx, y0 + dy)
            return F.array(pt(dx0, dy0), pt(dx1, dy0), pt(dx1, dy1), pt(dx0, dy1), pt(dx0, dy0))

        outer, hole = box(0.0, 0.0, 0.08, 0.06), box(0.01, 0.015, 0.05, 0.045)
        rings = F.when(n == 12, F.array(outer, hole)).otherwise(F.array(outer))
        props = (
            F.when(n % 4 == 0, F.create_map(F.lit("KGISWardName"), F.col("n_name")))
            .when(n % 4 == 1, F.create_map(F.lit("Ward_No"), n.cast("string"), F.lit("Zone_Name"), F.lower("n_name")))
            .when(n % 4 == 2, F.create_map(F.lit("Ward_No"), n.cast("string")))
            .otherwise(F.create_map(F.lit("other"), F.lit("x")))
        )
        region = self.table("region").select(F.col("r_regionkey").alias("_row"), F.col("r_name").alias("city"))
        return (
            self.table("nation")
            .withColumn("_row", n % 5)
            .join(region, "_row")
            .select("city", n.alias("ward_pos"), props.alias("properties"), F.array(rings).alias("polygons"))
        )

    @property
    def reports(self) -> DataFrame:
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        day = F.datediff(F.col("o_orderdate").cast("timestamp"), F.lit("1995-01-01")) % 30
        pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
        ward = (
            F.when(o % 11 == 5, F.lit("unassigned"))
            .when(o % 97 == 13, F.lit(None).cast("string"))
            .when(o % 7 == 3, F.concat(F.lit(" nation_"), (c % 25).cast("string"), F.lit(" ")))
            .otherwise(F.format_string("W%03d", (c % 25 + 1).cast("int")))
        )
        base = self.table("orders").select(
            o.cast("string").alias("id"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=day, hours=(o % 24).cast("int"))).alias("ts"),
            ward.alias("ward_id"),
            pick(clean.REPORT_CATEGORIES, o % 5).alias("category"),
            site_lat(c).alias("lat"),
            site_lon(c).alias("lon"),
            F.when(o % 89 == 0, "fax").when(o % 13 == 0, F.lit(None)).otherwise(pick(clean.REPORT_SOURCES, o % 3)).alias("source"),
            F.when(o % 83 == 0, "lost").when(o % 17 == 0, F.lit(None)).otherwise(pick(clean.REPORT_STATUSES, o % 5)).alias("status"),
        )
        return self.with_city(base)

    @property
    def status_updates(self) -> DataFrame:
        o = F.col("o_orderkey")
        at = F.col("o_orderdate").cast("timestamp")
        done = F.when(F.col("o_orderstatus") != "O", at + F.make_dt_interval(hours=(o % 96).cast("int")))
        rows = self.table("orders").select(
            site_lat(F.col("o_custkey")).alias("lat"),
            F.format_string("A%02d", (o % 40 + 1).cast("int")).alias("action_id"),
            at.alias("dispatched_at"),
            done.alias("actioned_at"),
            F.when(done.isNotNull(), "actioned").otherwise("dispatched").alias("status"),
            (at + F.make_dt_interval(hours=F.lit(1))).alias("updated_at"),
        )
        return self.with_city(rows).drop("lat")

    # ----------------------------------------------------------------- stages

    @cached_property
    def cells(self) -> DataFrame:
        return materialise(city_cells(self.cities, GRID))

    @cached_property
    def wards(self) -> DataFrame:
        return materialise(wards.wards_from_polygons(self.cells, self.polygons))

    @cached_property
    def landuse(self) -> DataFrame:
        return materialise(panel.landuse_features(self.cells, self.osm))

    @property
    def hours(self) -> DataFrame:
        return clean.hour_axis(clean.floor_hours(self.stations), self.weather)

    @cached_property
    def panel(self) -> DataFrame:
        built = panel.build_panel(
            self.cells, self.stations, self.weather, self.satellite, self.fires, self.osm, self.wards, self.landuse
        )
        return materialise(built)

    @cached_property
    def labelled(self) -> DataFrame:
        """Labelled cell-hours with weather and static land use."""
        light = panel.light_panel(self.stations, self.weather)
        return materialise(light.join(self.landuse, ["city", "cell"]))

    @cached_property
    def field(self) -> DataFrame:
        """A dense field every query can restate in SQL: city median of the hour plus a cell term."""
        base = exposure.city_baseline(self.labelled)
        days = base.groupBy("city", F.to_date("ts").alias("_d")).agg(F.collect_list(F.struct("ts", "baseline")).alias("_h"))
        spread = self.cells.select("city", "cell").repartition("city", "cell")
        rows = spread.join(days, "city").select("city", "cell", F.explode("_h").alias("h"))
        return materialise(
            rows.select("city", "cell", "h.ts", (F.col("h.baseline") + (F.col("cell") % 23)).alias("pm25_hat"))
        )

    @cached_property
    def forecast(self) -> DataFrame:
        newest = signals.with_latest(self.field).where("ts = at").select("city", "cell", "pm25_hat")
        leads = newest.withColumn("horizon_h", F.explode(F.sequence(F.lit(3), F.lit(72), F.lit(3))))
        hat = F.col("pm25_hat") + F.col("horizon_h") * (F.col("cell") % 7 - 3) * 0.3
        return materialise(
            leads.select(
                "city", "cell", "horizon_h", round_to(hat, 1).alias("pm25_hat"),
                (hat - F.col("pm25_hat") >= 20.0).alias("urgency"),
            )
        )

    @cached_property
    def hot(self) -> DataFrame:
        """Hot station cells of the robust window medians, zoned by 4 x 4 hex blocks."""
        med = signals.window_medians(panel.station_cell_hour(self.stations), "pm25_station")
        z = [f"z_{w}" for w in signals.WINDOWS]
        scored = med.select("city", "cell", "w30d", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in z])
        newest = signals.with_latest(self.stations.select("city", F.date_trunc("hour", "ts").alias("ts")).distinct())
        at = newest.groupBy("city").agg(F.max("at").alias("ts"))
        burned = panel.fire_features(self.cells, self.fires, self.hours)
        hot = (
            hotspots.hot_cells(scored, HOT_THRESH)
            .join(self.cells.select("city", "cell"), ["city", "cell"], "left_semi")
            .join(at, "city")
            .join(burned.select("city", "cell", "ts", "fires_6h"), ["city", "cell", "ts"], "left")
            .withColumn("fires_6h", F.coalesce("fires_6h", F.lit(0)))
            .withColumn("c_fire", (F.col("cell") % 3 == 0).cast("double"))
            .withColumn("pm25_med", F.col("w30d"))
            .drop("w30d")
        )
        marked = materialise(hotspots.mark_attributable(materialise(hot), self.osm, GRID, km=0.3))
        zoned = hotspots.apply_zones(marked, marked.select("city", "cell", block_zone(F.col("cell")).alias("zone_id")))
        return materialise(hotspots.finish_hotspots(zoned, self.wards))

    @cached_property
    def named(self) -> DataFrame:
        """Attributions of enforceable hot cells by a rule on the cell id."""
        c = F.col("cell")
        cat = F.get(F.array(*[F.lit(x) for x in attribution.CATEGORIES]), (c % 4).cast("int"))
        conf = round_to((c % 60) / 100.0 + 0.30, 2)
        factors = F.when(c % 5 == 0, F.array(F.lit("a site is near"), F.lit("fires seen"))).otherwise(F.array(F.lit("a site is near")))
        return self.hot.where("attributable").select(
            "city", "cell", "zone_id", "ward_id", "ts", "kind", round_to(F.col("pm25_med"), 1).alias("pm25_estimate"),
            cat.alias("primary_source"), conf.alias("confidence"), factors.alias("evidence_factors"),
            F.concat(F.lit("because "), cat).alias("reason"), F.lit("rules").alias("explained_by"),
        )

    @cached_property
    def queue(self) -> DataFrame:
        return materialise(priority.actions(self.hot, self.named, self.landuse, GRID))

    @cached_property
    def status(self) -> DataFrame:
        from hazegrid.operators.ledger import latest_status

        return materialise(latest_status(self.status_updates))


def block_zone(cell: Column) -> Column:
    from hazegrid.functions.geo import cell_q, cell_r

    return F.concat_ws("_", F.lit("B"), F.floor(cell_q(cell) / 4).cast("string"), F.floor(cell_r(cell) / 4).cast("string"))
