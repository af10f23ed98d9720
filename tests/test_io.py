import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import serving
from hazegrid.sources import readers, sinks
from hazegrid.streaming import live


def test_fire_csv_rejects_an_error_page(spark, tmp_path):
    (tmp_path / "a.csv").write_text("latitude,longitude,acq_date,acq_time,frp,confidence\n28.5,77.1,2024-01-02,7,3.5,n\n")
    row = readers.read_fire_csv(spark, str(tmp_path / "a.csv"), "c").first()
    assert (row.ts, row.frp) == (datetime(2024, 1, 2, 0, 7), 3.5)
    (tmp_path / "b.csv").write_text("Invalid MAP_KEY.\n")
    with pytest.raises(ValueError, match="acq_date"):
        readers.read_fire_csv(spark, str(tmp_path / "b.csv"), "c")


def test_station_document_takes_the_pm_sensor(spark):
    hour = {"value": 12.5, "period": {"datetimeTo": {"utc": "2024-01-01T05:00:00Z"}}}
    doc = {"id": 7, "coordinates": {"latitude": 28.5, "longitude": 77.1}, "sensors": [
        {"id": 1, "parameter": {"name": "no2"}, "results": [hour]}, {"id": 2, "parameter": {"name": "pm25"}, "results": [hour, hour]}]}
    none = {**doc, "sensors": doc["sensors"][:1]}
    df = spark.createDataFrame([("c", json.dumps(doc)), ("c", json.dumps(none))], "city string, doc string")
    rows = readers.station_hours(df).collect()
    assert len(rows) == 2 and rows[0].station_id == "7" and rows[0].ts == datetime(2024, 1, 1, 5)


def test_osm_elements_without_position_drop(spark):
    els = [{"id": 1, "center": {"lat": 1.0, "lon": 2.0}, "tags": {"man_made": "kiln"}}, {"id": 2, "tags": {"landuse": "industrial"}},
           {"id": 3, "lat": 1.0, "lon": 2.0, "tags": {"highway": "residential", "name": "X", "a": "b", "c": "d"}}]
    df = spark.createDataFrame([("c", json.dumps(e)) for e in els], "city string, doc string")
    rows = {r.name: (r.kind, r.tag) for r in readers.osm_features(df).collect()}
    assert rows == {"waste_burning_1": ("waste_burning", "man_made=kiln"), "X": ("road", "highway=residential;name=X;a=b")}


def test_critical_feed_stops_the_run_and_others_degrade(spark):
    ok = lambda: spark.range(3)
    empty = lambda: spark.range(0)
    feeds, notes = readers.load_feeds({"stations": ok, "osm": empty}, {"stations"})
    assert set(feeds) == {"stations"} and "empty" in notes["osm"]
    with pytest.raises(RuntimeError, match="stations"):
        readers.load_feeds({"stations": empty}, {"stations"})


def test_write_replaces_only_the_given_cities(spark, tmp_path):
    path = str(tmp_path / "t")
    both = spark.createDataFrame([("a", 1, 2.0), ("b", 2, float("nan"))], "city string, cell long, pm25_hat double")
    sinks.write_table(both, path)
    sinks.write_table(spark.createDataFrame([("a", 9, 5.0)], both.schema), path)
    got = {(r.city, r.cell) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 9), ("b", 2)}
    sinks.write_contract(both, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j" / "city=b").glob("*.json"))
    assert json.loads(text)["pm25_hat"] is None
    with pytest.raises(ValueError, match="unknown city"):
        serving.require_city(both, "zz", both.select("city"))


def test_upsert_replaces_the_row_of_a_city(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "city string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "city string, v int")
    assert [tuple(r) for r in sinks.upsert_city_rows(old, new).collect()] == [("a", 1), ("b", 2), ("c", 2)]


def test_station_stream_equals_batch(spark, tmp_path):
    rows = [("c", "s1", 5, datetime(2024, 1, 1, h, m), float(10 * h + m)) for h in range(4) for m in (0, 10)]
    rows += [rows[0], ("c", "s9", 5, datetime(2024, 1, 3), 1.0)]  # a repeat, and a row that closes the hours
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "city string, station_id string, cell long, ts timestamp, pm25 double")
    df.coalesce(1).write.parquet(src)
    stream = live.station_hours_stream(spark.readStream.schema(df.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.ts.hour: r.pm25_station for r in spark.table("hours").where("ts < timestamp'2024-01-02'").collect()}
    assert got == {h: 10.0 * h + 5 for h in range(4)}


def test_status_state_over_restarts_late_updates_and_expiry(spark, tmp_path):
    schema = "city string, action_id string, dispatched_at timestamp, actioned_at timestamp, status string, inspector string, updated_at timestamp"
    src, changes, ck = (str(tmp_path / x) for x in ("in", "changes", "ck"))
    fields = spark.createDataFrame([], schema).schema
    day = lambda k, h=0: datetime(2024, 1, 1) + timedelta(days=k, hours=h)

    def run(*rows):
        spark.createDataFrame([("c", a, day(0), None, status, who, at) for a, status, at, who in rows], schema).write.mode("append").parquet(src)
        live.track_status(spark.readStream.schema(schema).parquet(src), changes, ck, delay="5 days", keep_closed_days=10).awaitTermination(180)
        held = spark.read.format("statestore").option("stateVarName", "newest").load(ck)
        now = {r.action_id: (r.status, r.inspector) for r in live.current_status(spark, changes, ck, fields).collect()}
        return now, {r[0] for r in held.select("key.action_id").collect()}

    now, held = run(("A1", "dispatched", day(1), "x"), ("A2", "dispatched", day(1), "x"), ("A2", "actioned", day(2), "y"), ("A3", None, None, "z"))
    assert now == {"A1": ("dispatched", "x"), "A2": ("actioned", "y"), "A3": (None, "z")} and held == {"A1", "A2", "A3"}
    # Another run goes on from the checkpoint; an older row that comes late changes nothing, a newer one does.
    now, held = run(("A2", "dispatched", day(1, 5), "late"), ("A1", "actioned", day(3), "y"), ("A4", "dispatched", day(4), "x"))
    assert now["A2"] == ("actioned", "y") and now["A1"] == ("actioned", "y") and held == {"A1", "A2", "A3", "A4"}
    # Reopened within its time: the timer of the closing goes with it.
    now, held = run(("A1", "dispatched", day(9), "again"))
    assert now["A1"] == ("dispatched", "again")
    # Twenty days on, what was closed has left the state and keeps its last status; what is open stays.
    now, held = run(("A4", "dispatched", day(25), "x"))
    assert held == {"A1", "A3", "A4"} and now["A2"] == ("actioned", "y") and now["A1"] == ("dispatched", "again")
    # Behind the watermark (day 20) an update no longer counts.
    now, held = run(("A2", "dispatched", day(15), "too late"))
    assert now["A2"] == ("actioned", "y") and "A2" not in held
    assert {r.action_id for r in spark.read.parquet(changes).where("change = 'closed'").collect()} == {"A2"}


def test_refresh_rebuilds_only_what_is_touched(spark, tmp_path):
    src, raw, table, ck = (str(tmp_path / x) for x in ("in", "raw", "table", "ck"))
    schema = "city string, cell long, ts timestamp, pm25 double"

    def run(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(src)
        live.refresh_hours(spark.readStream.schema(schema).parquet(src), raw, table, ck).awaitTermination(120)
        return {(r.city, r.ts): r.pm25_station for r in spark.read.parquet(table).collect()}

    t = datetime(2024, 1, 1, 5)
    got = run(("a", 1, t, 10.0), ("b", 1, t, 50.0), ("a", 1, t + timedelta(days=1), 30.0))
    assert got == {("a", t): 10.0, ("b", t): 50.0, ("a", t + timedelta(days=1)): 30.0}
    old = set((tmp_path / "table" / "city=b").rglob("*.parquet"))
    got = run(("a", 1, t + timedelta(minutes=30), 20.0))  # weeks later it would count as well
    assert got[("a", t)] == 15.0 and got[("b", t)] == 50.0 and len(got) == 3
    assert set((tmp_path / "table" / "city=b").rglob("*.parquet")) == old


def test_sliding_fire_fraction(spark, tmp_path):
    rows = [("c", 5, datetime(2024, 1, 1, h, m)) for h in (0, 1, 5) for m in (0, 30)] + [("c", 6, datetime(2024, 1, 5))]
    src = str(tmp_path / "fires")
    df = spark.createDataFrame(rows, "city string, cell long, ts timestamp")
    df.coalesce(1).write.parquet(src)
    stream = live.fire_fraction_stream(spark.readStream.schema(df.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("fractions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {r["at"]: (r.fire_hours, r.fire_fraction) for r in spark.table("fractions").where("cell = 5").collect()}
    for at, (n, share) in got.items():
        burning = [h for h in (0, 1, 5) if at - timedelta(hours=24) <= datetime(2024, 1, 1, h) < at]
        assert n == len(burning) and share == n / 24
    assert got[datetime(2024, 1, 1, 6)] == (3, 3 / 24) and len(got) >= 29


def test_every_fire_chunk_is_checked(spark, tmp_path):
    head = "latitude,longitude,acq_date,acq_time,frp,confidence"
    (tmp_path / "a.csv").write_text(f"{head}\n28.6,77.2,2024-01-01,130,5.0,h\n")
    (tmp_path / "b.csv").write_text("confidence,frp,acq_time,acq_date,longitude,latitude,more\nn,6.0,1200,2024-01-02,77.3,28.7,x\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert sorted((r.lat, r.frp) for r in readers.read_fire_csv(spark, paths, "c").collect()) == [(28.6, 5.0), (28.7, 6.0)]
    (tmp_path / "c.csv").write_text("<html>busy</html>\n")
    with pytest.raises(ValueError, match="c.csv"):
        readers.read_fire_csv(spark, [*paths, str(tmp_path / "c.csv")], "c")


def test_a_critical_feed_must_cover_every_city(spark):
    cities = spark.createDataFrame([("a",), ("b",)], "city string")
    one = spark.createDataFrame([("a", 1)], "city string, v int")
    with pytest.raises(RuntimeError, match="b"):
        readers.load_feeds({"stations": lambda: one}, {"stations"}, cities=cities)


@pytest.fixture
def database(spark):
    """An embedded database in this JVM with one channel table."""
    import uuid

    from hazegrid.sources.channels import Channel

    jdbc = {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}

    def put(rows, name="inspection_status"):
        df = spark.createDataFrame(rows, "city string, action_id string, status string, updated_at timestamp")
        df.coalesce(1).write.jdbc(jdbc["url"], f'"{name}"', mode="append", properties={"driver": jdbc["driver"]})
        return Channel(spark, name, jdbc)

    return put


def crowded(n=3000):
    """Most rows within one hour of two months: equal strides of time would leave them to one task."""
    start = datetime(2024, 1, 1)
    return [("c", f"A{k}", "open", start + (timedelta(days=k % 60) if k % 20 == 0 else timedelta(days=9, seconds=k, microseconds=k))) for k in range(n)]


def test_channel_is_read_by_many_even_tasks(spark, database):
    rows = [*crowded(), ("c", "nowhen", "open", None)]
    channel = database(rows)
    got = channel.read(rows_per_task=200)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 12 and max(sizes) <= 200
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert channel.bounds().rows == 3000 and channel.bounds(datetime(2030, 1, 1)) is None
    since = datetime(2024, 2, 1)
    assert sorted(map(tuple, channel.read(since, 10).collect()), key=str) == sorted((r for r in rows if r[3] and r[3] >= since), key=str)


def test_stretches_neither_overlap_nor_leave_gaps(database):
    channel = database(crowded(900))
    parts = channel.stretches(channel.bounds(), 50)
    assert sum(p.rows for p in parts) == 900
    assert all(a.high <= b.low and not b.closed for a, b in zip(parts, parts[1:]))


def test_one_moment_with_many_rows_is_one_stretch(database):
    channel = database([("c", f"A{k}", "open", datetime(2024, 1, 1)) for k in range(100)])
    assert [p.rows for p in channel.stretches(channel.bounds(), 10)] == [100] and channel.read(rows_per_task=10).count() == 100


def test_sync_takes_what_is_new_and_late(spark, database, tmp_path):
    path, t = str(tmp_path / "channel"), datetime(2024, 3, 1, 12)
    channel = database([("c", "A1", "dispatched", t), ("c", "A2", "dispatched", t - timedelta(hours=5))])
    assert channel.sync(path) == 2 and channel.sync(path) == 0
    late = ("c", "A3", "dispatched", t - timedelta(minutes=30))
    channel = database([late, ("c", "A1", "actioned", t + timedelta(hours=2)), ("c", "A9", "too late", t - timedelta(hours=3))])
    assert channel.sync(path, overlap=timedelta(hours=1)) == 2  # the last row lies before the overlap
    assert channel.sync(path, overlap=timedelta(days=1)) == 1
    now = {r.action_id: r.status for r in channel.current(path).collect()}
    assert now == {"A1": "actioned", "A2": "dispatched", "A3": "dispatched", "A9": "too late"}
    assert spark.read.parquet(path).count() == 5


def test_empty_channel(spark, database, tmp_path):
    channel = database([])
    assert channel.read().count() == 0 and channel.sync(str(tmp_path / "none")) == 0
    got = readers.read_channel(spark, "inspection_status", jdbc=channel.jdbc)
    assert got.columns == ["city", "action_id", "status", "updated_at"]
