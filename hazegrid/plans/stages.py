"""Run stages one after the other, each on its own: a failure is reported and the rest goes on."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]
REPORT = "position int, stage string, status string, duration_ms bigint, error string, tables array<string>"


class Stage(NamedTuple):
    """A step of a plan: reads the tables ``needs`` and returns the tables ``gives``."""

    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    run: Callable[[Tables], Tables]


def run_stages(
    spark: SparkSession, stages: Iterable[Stage], inputs: Mapping[str, DataFrame], published: str, only: str | None = None
) -> tuple[Tables, DataFrame]:
    """(tables, report): every stage, or ``only`` one, with its tables written under ``published``.

    A stage's tables are written within the stage, so an error of its data is its own error and not that of a later
    reader. The report has a row for each stage run: position, stage, status ('done', 'error' or 'skipped'), duration_ms,
    error, tables. A stage that lacks a table because an earlier one failed takes the one published by an earlier run;
    if there is none it is skipped, and its error names the missing table. Stages that do not need the failed one go on.
    Running a single stage works on what earlier runs published.
    """
    stages = list(stages)
    names = [s.name for s in stages]
    if only is not None and only not in names:
        raise ValueError(f"unknown stage {only!r}; choose from {names}")
    tables, rows = dict(inputs), []
    for position, stage in enumerate(stages, 1):
        if only is not None and stage.name != only:
            continue
        began, status, error = time.monotonic(), "done", None
        missing = [n for n in stage.needs if n not in tables and not _recall(spark, tables, published, n)]
        if missing:
            status, error = "skipped", f"no table {', '.join(missing)}"
        else:
            try:
                made = stage.run(tables)
                for name in stage.gives:
                    made[name].write.mode("overwrite").parquet(f"{published}/{name}")
                tables |= {n: spark.read.parquet(f"{published}/{n}") for n in stage.gives}
            except Exception as failure:  # noqa: BLE001 - one stage must not take down the others
                status, error = "error", f"{type(failure).__name__}: {failure}"[:2000]
        took = int((time.monotonic() - began) * 1000)
        rows.append((position, stage.name, status, took, error, list(stage.gives) if status == "done" else []))
    return {n: t for n, t in tables.items() if n not in inputs}, spark.createDataFrame(rows, REPORT)


def _recall(spark: SparkSession, tables: Tables, published: str, name: str) -> bool:
    try:
        tables[name] = spark.read.parquet(f"{published}/{name}")
    except AnalysisException:
        return False
    return True
