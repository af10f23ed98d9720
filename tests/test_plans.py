"""Stages run on their own, report their failures and work on what earlier runs published."""

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import advisory
from hazegrid.plans import city_run
from hazegrid.plans.stages import Stage, run_stages


def chain(broken=()):
    def add(name, source):
        def run(t):
            if name in broken:
                raise ValueError(f"{name} broke")
            n = t[source].withColumn("v", F.col("v") + 1)
            # An error of the data shows only when rows are read.
            return {name: n.withColumn("v", F.raise_error(F.lit("bad row"))) if f"lazy {name}" in broken else n}

        return Stage(name, (source,), (name,), run)

    return [add("one", "raw"), add("two", "one"), add("three", "two"), add("side", "one")]


def told(report):
    return {r.stage: (r.status, r.error) for r in report.collect()}


def test_a_failure_stays_with_its_stage(spark, tmp_path):
    raw = {"raw": spark.createDataFrame([(1,)], "v int")}
    tables, report = run_stages(spark, chain(["two"]), raw, str(tmp_path / "a"))
    assert told(report) == {
        "one": ("done", None), "two": ("error", "ValueError: two broke"), "three": ("skipped", "no table two"), "side": ("done", None)
    }
    assert set(tables) == {"one", "side"} and tables["side"].first().v == 3
    assert all(r.duration_ms >= 0 for r in report.collect()) and [r.position for r in report.orderBy("position").collect()] == [1, 2, 3, 4]


def test_an_error_of_the_data_is_its_stages_own(spark, tmp_path):
    raw = {"raw": spark.createDataFrame([(1,)], "v int")}
    _, report = run_stages(spark, chain(["lazy one"]), raw, str(tmp_path / "b"))
    got = told(report)
    assert got["one"][0] == "error" and "bad row" in got["one"][1] and {got[k][0] for k in ("two", "three", "side")} == {"skipped"}


def test_one_stage_works_on_what_was_published(spark, tmp_path):
    raw, at = {"raw": spark.createDataFrame([(1,)], "v int")}, str(tmp_path / "c")
    assert {s for s, _ in told(run_stages(spark, chain(), raw, at)[1]).values()} == {"done"}
    tables, report = run_stages(spark, chain(), {}, at, only="three")
    assert told(report) == {"three": ("done", None)} and tables["three"].first().v == 4
    # A later run whose second stage fails goes on with the second table of the run before.
    tables, report = run_stages(spark, chain(["two"]), {"raw": raw["raw"].withColumn("v", F.lit(11))}, at)
    assert told(report)["three"] == ("done", None) and tables["three"].first().v == 4 and tables["side"].first().v == 13
    with pytest.raises(ValueError, match="unknown stage"):
        run_stages(spark, chain(), raw, at, only="four")


def test_stages_of_the_city_chain_fit_together():
    feeds = {"cities", "polygons", "stations", "weather", "satellite", "fires", "osm", "reports", "status"}
    known = set(feeds)
    for stage in city_run.stages("2024-01-01 00:00:00"):
        assert set(stage.needs) <= known, stage.name
        assert not set(stage.gives) & known
        known |= set(stage.gives)


def test_city_chain_reports_a_broken_feed(spark, tmp_path):
    """A feed without its columns ends the stages that need it; the others have their table or say what they lack."""
    feeds = {n: spark.createDataFrame([], "x int") for n in ("polygons", "stations", "weather", "satellite", "fires", "osm", "reports", "status")}
    feeds["cities"] = spark.createDataFrame([("c", 28.5, 28.52, 77.0, 77.02)], "city string, lat_min double, lat_max double, lon_min double, lon_max double")
    tables, report = city_run.run_reported(spark, feeds, "2024-01-01 00:00:00", str(tmp_path / "d"))
    got = told(report)
    assert tables == {} and got["ground"][0] == "error" and got["audit"] == ("skipped", "no table field, qc_stations, wards") and len(got) == 11


def test_audio_manifest_reuses_makes_and_skips(spark):
    texts = {"same": "hello", "changed": "new words", "lost": "gone file", "fresh": "first", "failed": "silent", "mute": "x", "empty": ""}
    a = spark.createDataFrame([("c", w, 1.0, {"en": t, "xx": t}, {"en": "checked"}) for w, t in texts.items()], "city string, ward_id string, risk_score double, texts map<string,string>, verification map<string,string>")
    hashed = lambda t: F.sha2(F.lit(t), 256)
    old = spark.createDataFrame([("c", w, "en", f"audio/{w}_en.mp3", "v0", 5, t) for w, t in (("same", "hello"), ("changed", "old words"), ("lost", "gone file"), ("same", "hello"))],
                                "city string, ward_id string, lang string, path string, voice string, bytes int, t string").withColumn("text_hash", F.sha2("t", 256)).drop("t")
    files = spark.createDataFrame([("audio/same_en.mp3",), ("audio/changed_en.mp3",)], "path string")
    made = spark.createDataFrame([("c", w, "en", n) for w, n in (("changed", 90), ("lost", 80), ("fresh", 70), ("same", 60), ("failed", None))], "city string, ward_id string, lang string, bytes int")
    voices = spark.createDataFrame([("en", "v1")], "lang string, voice string")
    got = {(r.ward_id, r.lang): r for r in advisory.audio_manifest(a, old, files, made, voices).collect()}
    assert len(got) == 12 and {k for k, r in got.items() if r.state == "no_voice"} == {(w, "xx") for w in texts if w != "empty"}
    state = {w: got[w, "en"].state for w in texts if w != "empty"}
    assert state == {"same": "reused", "changed": "made", "lost": "made", "fresh": "made", "failed": "failed", "mute": "failed"}
    same, fresh, mute = got["same", "en"], got["fresh", "en"], got["mute", "en"]
    assert (same.voice, same.bytes, same.path) == ("v0", 5, "audio/same_en.mp3") and (fresh.voice, fresh.bytes, fresh.chars) == ("v1", 70, 5)
    assert (mute.path, mute.voice, mute.bytes) == (None, None, None) and mute.text_verification == "checked" and got["mute", "xx"].text_verification is None
    assert same.text_hash == spark.range(1).select(hashed("hello")).first()[0]
