"""PM2.5 forecast: supervised frames, baselines, pooled boosted trees, field and ward forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazegrid.functions.aqi import aqi, aqi_category
from hazegrid.functions.geo import round_to
from hazegrid.functions.stats import rmse, rolling_medians, skill_pct
from hazegrid.operators.exposure import LABEL
from hazegrid.operators.trees import Models, fit_by_city, score_by_city
from hazegrid.session import materialise

# Fixed values.
HORIZONS = list(range(3, 73, 3))
LAGS = [0, 1, 3, 6, 24]
MET = ["blh_m", "wind_ms", "temp_c"]
STATIC = ["lu_road", "lu_industrial", "lu_traffic"]
ROLLS = {"roll_med_24": (24, 6), "roll_med_168": (168, 24)}
TEST_TAIL_DAYS = 14
MIN_TRAIN_ROWS = 200
URGENT_RISE = 20.0
FORECAST_SETTINGS = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.2, "subsamplingRate": 0.8, "minInstancesPerNode": 30, "maxBins": 64}

SERIES = ["city", "cell"]
_NEED = ["lag_0", "lag_24", "roll_med_24"]


def _hour_number(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / 3600).cast("long")


def origin_features(series: DataFrame, value: str, lag_mode: str = "rows") -> DataFrame:
    """What is known at T: lags and rolling medians of the cell's own series.

    ``lag_mode="rows"`` counts labelled rows; ``"hours"`` counts clock hours and leaves gaps null.
    """
    x = F.col(value)
    if lag_mode == "hours":
        order = Window.partitionBy(*SERIES).orderBy(_hour_number(F.col("ts")))

        def frame(lo, hi):
            return order.rangeBetween(lo, hi)

        lag = {f"lag_{k}": x if k == 0 else F.max(x).over(frame(-k, -k)) for k in LAGS}
    else:
        order = Window.partitionBy(*SERIES).orderBy("ts")
        lag = {f"lag_{k}": x if k == 0 else F.lag(x, k).over(order) for k in LAGS}
    return rolling_medians(series.withColumns(lag), SERIES, "ts", value, ROLLS, hours=lag_mode == "hours")


def _targets(df: DataFrame, value: str, horizons: Sequence[int], lag_mode: str, oracle_met: bool) -> DataFrame:
    """Explode the horizons; each row gets the value (and met, for the oracle) h steps ahead."""
    if lag_mode == "hours":
        order = Window.partitionBy(*SERIES).orderBy(_hour_number(F.col("ts")))

        def ahead(c, h):
            return F.max(c).over(order.rangeBetween(h, h))
    else:
        order = Window.partitionBy(*SERIES).orderBy("ts")

        def ahead(c, h):
            return F.lead(c, h).over(order)

    met = [m for m in MET if m in df.columns] if oracle_met else []
    per_h = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                ahead(F.col(value), h).alias("y"),
                *[ahead(F.col(m), h).alias(f"{m}_tgt") for m in met],
            )
            for h in horizons
        ]
    )
    return df.withColumn("_t", per_h).withColumn("_t", F.explode("_t")).select(
        "*", "_t.horizon", "_t.y", *[f"_t.{m}_tgt" for m in met]
    ).drop("_t")


def target_clock(df: DataFrame) -> DataFrame:
    at = F.col("ts") + F.make_dt_interval(hours=F.col("horizon"))
    return df.withColumns({"target_hour": F.hour(at), "target_dow": F.weekday(at)})


def pooled(
    series: DataFrame,
    value: str = LABEL,
    horizons: Sequence[int] = tuple(HORIZONS),
    require_target: bool = True,
    lag_mode: str = "rows",
    oracle_met: bool = False,
) -> DataFrame:
    """Supervised rows of every horizon; the features at T are computed once for all of them."""
    frame = target_clock(_targets(origin_features(series, value, lag_mode), value, horizons, lag_mode, oracle_met))
    return frame.na.drop(subset=[*_NEED, "y"] if require_target else _NEED)


def supervised(series: DataFrame, value: str, horizon: int, require_target: bool = True, **kw) -> DataFrame:
    return pooled(series, value, [horizon], require_target, **kw)


def feature_columns(frame: DataFrame) -> list[str]:
    names = [f"lag_{k}" for k in LAGS] + ["roll_med_24", "roll_med_168", *MET, *STATIC]
    names += ["target_hour", "target_dow", "horizon", *[f"{m}_tgt" for m in MET]]
    return [n for n in names if n in frame.columns]


def time_holdout(df: DataFrame, days: int = TEST_TAIL_DAYS, embargo_hours: int = 0) -> DataFrame:
    """Add is_test: rows after the city's newest label minus ``days``.

    With an embargo, training rows whose target reaches past the split become null (unused).
    """
    edge = df.groupBy("city").agg((F.max("ts") - F.make_dt_interval(days=F.lit(days))).alias("split"))
    out = df.join(F.broadcast(edge), "city")  # one row per city
    test = F.col("ts") > F.col("split")
    if embargo_hours:
        near = F.col("ts") > F.col("split") - F.make_dt_interval(hours=F.lit(embargo_hours))
        return out.withColumn("is_test", F.when(test, True).when(~near, False))
    return out.withColumn("is_test", test)


def hour_of_week(ts: Column) -> Column:
    return F.weekday(ts) * 24 + F.hour(ts)


def diurnal_climatology(train: DataFrame, value: str = LABEL) -> DataFrame:
    """(city, cell, how, clim): median by hour of week."""
    return train.groupBy("city", "cell", hour_of_week(F.col("ts")).alias("how")).agg(F.median(value).alias("clim"))


def with_baselines(frame: DataFrame, clim: DataFrame, climatology_at: str = "origin") -> DataFrame:
    """Add persistence (the value at T) and diurnal (climatology, else the weekly rolling median)."""
    clock = F.col("ts")
    if climatology_at == "target":
        clock = F.col("ts") + F.make_dt_interval(hours=F.col("horizon"))
    keyed = frame.withColumn("how", hour_of_week(clock)).join(clim, ["city", "cell", "how"], "left")
    return keyed.withColumns({"persistence": F.col("lag_0"), "diurnal": F.coalesce("clim", "roll_med_168")}).drop("clim", "how")


def evaluation_frame(panel: DataFrame, climatology_at: str = "origin", **kw) -> DataFrame:
    """Pooled rows with is_test and both baselines; the climatology sees training hours only."""
    keep = [c for c in ("city", "cell", "ts", LABEL, *MET, *STATIC) if c in panel.columns]
    lab = panel.where(F.col(LABEL).isNotNull()).select(*keep)
    split = time_holdout(lab)
    clim = diurnal_climatology(split.where(~F.col("is_test")))
    edge = split.select("city", "split").distinct()
    frame = pooled(lab, **kw).join(F.broadcast(edge), "city").withColumn("is_test", F.col("ts") > F.col("split"))
    return with_baselines(frame, clim, climatology_at)


def score_forecast(test: DataFrame, prediction: str | None = None) -> DataFrame:
    """(city, horizon, n_test, rmse_..., skill_...): baselines, and the model when given."""
    y = F.col("y")
    aggs = [
        F.count("*").alias("n_test"),
        rmse(y, F.col("persistence")).alias("rmse_persistence"),
        rmse(y, F.col("diurnal")).alias("rmse_diurnal"),
    ]
    if prediction:
        aggs.append(rmse(y, F.col(prediction)).alias("rmse_model"))
    out = test.groupBy("city", "horizon").agg(*aggs)
    if prediction:
        out = out.withColumns(
            {
                "skill_vs_persistence_pct": skill_pct(F.col("rmse_model"), F.col("rmse_persistence")),
                "skill_vs_diurnal_pct": skill_pct(F.col("rmse_model"), F.col("rmse_diurnal")),
            }
        )
    return out.withColumns({c: round_to(F.col(c), 2) for c in out.columns if c.startswith("rmse_")})


def complete_horizons(scores: DataFrame, cities: DataFrame, horizons: Sequence[int] = tuple(HORIZONS)) -> DataFrame:
    """One row per city and horizon; horizons without test rows say so."""
    grid = cities.select("city").distinct().withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    full = grid.join(scores, ["city", "horizon"], "left")
    return full.withColumn("note", F.when(F.col("n_test").isNull(), "insufficient data")).withColumn(
        "n_test", F.coalesce("n_test", F.lit(0))
    )


def fit_forecast(train: DataFrame, **settings) -> tuple[Models, list[str]]:
    """(models by city, inputs); a city with fewer than ``MIN_TRAIN_ROWS`` rows gets no model."""
    cols = feature_columns(train)
    return fit_by_city(train, cols, "y", FORECAST_SETTINGS | settings, least=MIN_TRAIN_ROWS), cols


def forecast_eval(panel: DataFrame, oracle_met: bool = False, settings: dict | None = None, **kw) -> DataFrame:
    """Train on each city's earlier weeks, score every horizon on its tail against both baselines.

    ``oracle_met`` feeds the observed weather at the target hour: an upper bound, not a result. A city
    with too few training rows says so on every horizon, whatever other cities have.
    """
    frame = materialise(evaluation_frame(panel, oracle_met=oracle_met, **kw))
    models, cols = fit_forecast(frame.where(~F.col("is_test")), **(settings or {}))
    scored = score_by_city(frame.where("is_test"), models, cols)
    return complete_horizons(score_forecast(scored, "pred"), panel.select("city"))


def latest_features(series: DataFrame, value: str = "value") -> DataFrame:
    """Origin features at each city's newest hour only.

    Only the last 169 rows of a cell matter, so they are ranked once and aggregated by
    rank; no sliding frame runs over the history.
    """
    newest = series.groupBy("city").agg(F.max("ts").alias("at"))  # one row per city
    rank = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("ts")))
    recent = series.withColumn("_n", rank).where(F.col("_n") <= 169)
    x = F.col(value)
    n = F.col("_n")
    aggs = [F.max("ts").alias("ts")]
    aggs += [F.max(F.when(n == k + 1, x)).alias(f"lag_{k}") for k in LAGS]
    for width, least in ((24, 6), (168, 24)):
        inside = F.when(n.between(2, width + 1), x)
        aggs.append(F.when(F.count(inside) >= least, F.percentile(inside, 0.5)).alias(f"roll_med_{width}"))
    aggs += [F.max(F.when(n == 1, F.col(c))).alias(c) for c in [*MET, *STATIC] if c in series.columns]
    base = recent.groupBy(*SERIES).agg(*aggs).join(F.broadcast(newest), "city").where("ts = at").drop("at")
    return base.na.drop(subset=_NEED)


def forecast_series(panel: DataFrame, field: DataFrame) -> DataFrame:
    """Each cell's own series: the station reading where there is one, else the field."""
    keep = [c for c in ("city", "cell", "ts", LABEL, *MET, *STATIC) if c in panel.columns]
    joined = field.select("city", "cell", "ts", "pm25_hat").join(panel.select(*keep), ["city", "cell", "ts"], "left")
    return joined.withColumn("value", F.coalesce(LABEL, "pm25_hat"))


def forecast_field(
    panel: DataFrame, field: DataFrame, models: Models, cols: list[str], horizons: Sequence[int] = tuple(HORIZONS)
) -> DataFrame:
    """(city, cell, horizon_h, pm25_hat, urgency) at every lead from the newest hour."""
    base = latest_features(forecast_series(panel, field))
    leads = target_clock(base.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))))
    out = score_by_city(leads, models, cols)
    return out.select(
        "city",
        "cell",
        F.col("horizon").cast("int").alias("horizon_h"),
        round_to(F.col("pred"), 1).alias("pm25_hat"),
        F.coalesce(F.col("pred") - F.col("lag_0") >= URGENT_RISE, F.lit(False)).alias("urgency"),
    )


def ward_forecast(forecast: DataFrame, wards: DataFrame) -> DataFrame:
    """(city, ward_id, horizon_h, pm25_hat, n_cells): ward medians, unassigned dropped."""
    real = wards.where("ward_id is not null and ward_id <> 'unassigned'").select("city", "cell", "ward_id")
    return (
        forecast.join(real, ["city", "cell"])
        .groupBy("city", "ward_id", "horizon_h")
        .agg(round_to(F.median("pm25_hat"), 1).alias("pm25_hat"), F.count("*").alias("n_cells"))
    )


def horizon_filter(forecast: DataFrame, h: int | None = None) -> DataFrame:
    return forecast if h is None else forecast.where(F.col("horizon_h") == h)


def best_worst_hour(ward_series: DataFrame) -> DataFrame:
    """Earliest lead with the lowest and with the highest AQI per ward (two leads at least)."""
    rated = ward_series.withColumn("aqi", aqi(F.col("pm25_hat")))
    h = F.col("horizon_h")
    out = rated.groupBy("city", "ward_id").agg(
        F.count("*").alias("n"),
        F.min_by("horizon_h", F.struct(F.col("aqi"), h)).alias("best_h"),
        F.min("aqi").alias("best_aqi"),
        F.min_by("horizon_h", F.struct(-F.col("aqi"), h)).alias("worst_h"),
        F.max("aqi").alias("worst_aqi"),
    )
    return out.where("n >= 2").select(
        "city", "ward_id", "best_h", "best_aqi", aqi_category(F.col("best_aqi")).alias("best_band"),
        "worst_h", "worst_aqi", aqi_category(F.col("worst_aqi")).alias("worst_band"),
    )
