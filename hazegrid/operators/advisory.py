"""Ward health advisories, their texts per language and the audio work list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions import advisory_text as text
from hazegrid.functions.aqi import aqi, aqi_band, band_rank
from hazegrid.functions.geo import round_to
from hazegrid.operators.hotspots import lookup


def ward_inputs(wards: DataFrame, forecast: DataFrame, field: DataFrame, landuse: DataFrame) -> DataFrame:
    """Per cell: tomorrow's forecast (else the newest field value), schools and hospitals, worsening flag."""
    tomorrow = forecast.where("horizon_h = 24").select("city", "cell", F.col("pm25_hat").alias("_f"), "urgency")
    newest = field.groupBy("city").agg(F.max("ts").alias("_at"))  # one row per city
    now = field.join(F.broadcast(newest), "city").where("ts = _at").select("city", "cell", F.col("pm25_hat").alias("_now"))
    return (
        wards.select("city", "cell", "ward_id", "ward_name")
        .join(tomorrow, ["city", "cell"], "left")
        .join(now, ["city", "cell"], "left")
        .join(landuse.select("city", "cell", "lu_sensitive"), ["city", "cell"], "left")
        .select(
            "city",
            "cell",
            "ward_id",
            "ward_name",
            F.coalesce("_f", "_now").alias("pm25"),
            F.coalesce("lu_sensitive", F.lit(0)).alias("vuln"),
            F.coalesce("urgency", F.lit(False)).alias("worsening"),
        )
        .where("pm25 is not null")
    )


def risk_score(band: Column, sites: Column, worsening: Column) -> Column:
    trend = F.when(worsening, 0.15).otherwise(0.0)
    raw = band_rank(band) / 5.0 * 0.70 + F.least(sites / 10.0, F.lit(1.0)) * 0.15 + trend
    return F.least(raw, F.lit(1.0))


def risk_tier(score: Column) -> Column:
    return F.when(score >= 0.75, "critical").when(score >= 0.55, "high").when(score >= 0.35, "moderate").otherwise("low")


def ward_advisory(inputs: DataFrame) -> DataFrame:
    """One row per ward: median PM2.5, AQI band, official impact, risk tier and score."""
    ward = inputs.groupBy("city", "ward_id").agg(
        F.min("ward_name").alias("ward_name"),
        F.median("pm25").alias("_pm"),
        F.max("vuln").alias("schools_hospitals_nearby"),
        F.bool_or("worsening").alias("worsening"),
        F.count("*").cast("int").alias("n_cells"),
    )
    band = aqi_band(F.col("_pm"))
    score = risk_score(F.col("aqi_category"), F.col("schools_hospitals_nearby"), F.col("worsening"))
    return (
        ward.withColumns({"pm25": round_to(F.col("_pm"), 1), "aqi": aqi(F.col("_pm")), "aqi_category": band})
        .withColumns({"risk_tier": risk_tier(score), "risk_score": round_to(score, 3)})
        .select(
            "city", "ward_id", "ward_name", "pm25", "aqi", "aqi_category",
            lookup(F.col("aqi_category"), text.HEALTH_IMPACT).alias("health_impact_cpcb"), "risk_tier", "risk_score",
            "worsening", "n_cells",
            F.struct(
                "schools_hospitals_nearby", F.lit(None).cast("int").alias("outdoor_workers"), F.lit(None).cast("int").alias("elderly")
            ).alias("vulnerability"),
        )
    )


def templates_table(spark: SparkSession) -> DataFrame:
    """(lang, band, template, verification, reviewed, lang_name): 24 fixed rows."""
    rows = [
        (lang, band, t, text.VERIFICATION[lang], text.VERIFICATION[lang] in text.SPEAKER_VERIFIED, text.LANGUAGE_NAMES[lang])
        for lang, bands in text.TEMPLATES.items()
        for band, t in bands.items()
    ]
    return spark.createDataFrame(
        rows, "lang string, aqi_category string, template string, verification string, reviewed boolean, lang_name string"
    )


def city_languages(city: Column, default: Sequence[str] = ("en",)) -> Column:
    def arr(langs):
        return F.array(*[F.lit(x) for x in langs])

    out = None
    for name, langs in text.CITY_LANGUAGES.items():
        out = F.when(F.lower(city) == name, arr(langs)) if out is None else out.when(F.lower(city) == name, arr(langs))
    return out.otherwise(arr(default))


def advisory_texts(advisories: DataFrame, languages: Column | None = None) -> DataFrame:
    """Add languages, texts, reviewed, verification and disclaimer maps from the template table."""
    spark = advisories.sparkSession
    langs = languages if languages is not None else city_languages(F.col("city"))
    spoken = advisories.withColumn("_langs", langs).select("*", F.posexplode("_langs").alias("_pos", "lang"))
    filled = spoken.join(F.broadcast(templates_table(spark)), ["lang", "aqi_category"])  # 24 rows
    body = F.replace(F.replace("template", F.lit("{ward}"), F.col("ward_name")), F.lit("{aqi}"), F.col("aqi").cast("string"))
    entry = F.struct(
        F.col("_pos"), F.col("lang"), body.alias("body"), F.col("reviewed"), F.col("verification"), F.col("lang_name")
    )
    per_ward = filled.groupBy("city", "ward_id").agg(F.sort_array(F.collect_list(entry)).alias("_e"))

    def as_map(field: str) -> Column:
        return F.map_from_arrays(F.transform("_e", lambda e: e["lang"]), F.transform("_e", lambda e: e[field]))

    unread = F.transform(F.filter("_e", lambda e: ~e["reviewed"]), lambda e: e["lang_name"])
    warning = F.when(F.size(unread) == 0, text.DISCLAIMER_REVIEWED).otherwise(
        F.replace(F.lit(text.DISCLAIMER_OPEN), F.lit("{langs}"), F.array_join(unread, ", "))
    )
    return advisories.join(per_ward, ["city", "ward_id"]).select(
        *advisories.columns,
        F.transform("_e", lambda e: e["lang"]).alias("languages"),
        as_map("body").alias("texts"),
        as_map("reviewed").alias("reviewed"),
        as_map("verification").alias("verification"),
        F.concat(F.lit(text.DISCLAIMER_HEAD), warning).alias("disclaimer"),
        F.lit("rules").alias("written_by"),
    )


def by_risk(advisories: DataFrame) -> DataFrame:
    return advisories.orderBy("city", F.desc("risk_score"), "ward_id")


def top_risk_wards(advisories: DataFrame, top: int | None = None) -> DataFrame:
    """The ``top`` wards of each city by risk; all without a positive number."""
    if top is None or top <= 0:
        return advisories
    rank = F.row_number().over(Window.partitionBy("city").orderBy(F.desc("risk_score"), "ward_id"))
    return advisories.withColumn("_n", rank).where(F.col("_n") <= top).drop("_n")


def audio_worklist(advisories: DataFrame, manifest: DataFrame, top: int | None = None) -> DataFrame:
    """(city, ward_id, lang, text, text_hash) still to be spoken: changed or new since the manifest."""
    wanted = top_risk_wards(advisories, top).select("city", "ward_id", F.explode("texts").alias("lang", "text"))
    hashed = wanted.where(F.length("text") > 0).withColumn("text_hash", F.sha2("text", 256))
    return hashed.join(manifest.select("city", "ward_id", "lang", "text_hash"), ["city", "ward_id", "lang", "text_hash"], "left_anti")


def audio_manifest(
    advisories: DataFrame, previous: DataFrame, files: DataFrame, made: DataFrame, voices: DataFrame, top: int | None = None
) -> DataFrame:
    """(city, ward_id, lang, path, voice, chars, bytes, text_hash, text_verification, state) for every text to be spoken.

    ``previous`` is the last manifest, ``files`` the paths that still exist, ``made`` (city, ward_id, lang, bytes) what the
    speech service has returned this time, ``voices`` (lang, voice) the configured voices. State 'reused': the text is the
    one of the last manifest and its file is there, so its old entry stands. 'made': a new entry. 'failed': the service
    gave nothing. 'no_voice': the language has none. Failed and voiceless texts have no path; the text itself still ships.
    """
    wanted = top_risk_wards(advisories, top).select("city", "ward_id", "verification", F.explode("texts").alias("lang", "text"))
    wanted = wanted.where(F.length("text") > 0).select(
        "city", "ward_id", "lang", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"),
        F.try_element_at("verification", F.col("lang")).alias("text_verification"),
    )
    key = ["city", "ward_id", "lang"]
    old = previous.join(files.select("path").distinct(), "path", "left_semi").groupBy(*key, "text_hash").agg(
        F.max_by(F.struct("path", "voice", F.col("bytes").cast("long").alias("bytes")), "path").alias("_old")
    )
    new = made.where("bytes IS NOT NULL").groupBy(*key).agg(F.max(F.col("bytes").cast("long")).alias("_bytes"))
    joined = wanted.join(old, [*key, "text_hash"], "left").join(new, key, "left").join(F.broadcast(voices.select("lang", F.col("voice").alias("_voice"))), "lang", "left")
    state = (
        F.when(F.col("_voice").isNull(), "no_voice").when(F.col("_old").isNotNull(), "reused").when(F.col("_bytes").isNotNull(), "made").otherwise("failed")
    )
    own = F.concat(F.lit("audio/"), F.col("ward_id"), F.lit("_"), F.col("lang"), F.lit(".mp3"))
    pick = lambda old, new: F.when(F.col("state") == "reused", F.col(f"_old.{old}")).when(F.col("state") == "made", new)
    return joined.withColumn("state", state).select(
        *key, pick("path", own).alias("path"), pick("voice", F.col("_voice")).alias("voice"), "chars",
        pick("bytes", F.col("_bytes")).alias("bytes"), "text_hash", "text_verification", "state",
    )
