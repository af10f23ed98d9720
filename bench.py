"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from workload.catalog import QUERIES  # noqa: E402
from workload.feeds import feeds  # noqa: E402

# Tables that several queries read; they are made before the clock starts, and their time is told apart.
SHARED = ["cells", "wards", "landuse", "panel", "labelled", "field", "forecast", "hot", "queue", "status"]
HEADLINE = [
    "c1_qc_station_readings",
    "c5_resolve_ward",
    "d0a_wards_from_polygons",
    "d6_landuse_features",
    "d5_fire_features",
    "d8_build_panel",
    "e2_window_medians",
    "e4_downwind_enhancement",
    "f1_zone_scores",
    "f9_detect",
    "h12_attribute",
    "m5_naive_citymean_loso",
    "n2_pooled",
    "n6_baseline_scores",
    "n8_latest_features",
    "n9_ward_forecast",
    "r2_actions",
    "r3_max_coverage",
    "k4_memos",
    "v3_advisory_texts",
    "l3_ledger",
    "b1_blind_spots",
    "q5_city_comparison",
    "x1_detection_recall",
    "x6_exposure_error",
    "w3_rolling_medians",
    "c10_locate_ward",
    "n12_decayed_persistence",
    "n13_upwind_mean",
    "x9_interval_coverage",
    "l4_realised_effect",
    "st1_station_hours_stream",
    "m3_fit_predict_field",
    "m6_feature_importance",
    "n6_forecast_eval",
    "n7_oracle_met",
    "n8_forecast_field",
]


def session() -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8"))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # JVM warm-up
    start = time.time()
    for name in SHARED:
        getattr(feeds(spark, sf_dir), name)
    shared = round(time.time() - start, 3)
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf), "shared_tables": shared}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
