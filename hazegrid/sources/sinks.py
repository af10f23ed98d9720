"""Writers: tables partitioned by city, JSON contracts, one-row upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ("city",)) -> None:
    """Replace only the partitions present in ``df``; rows are clustered so each writes few files.

    The rebalance lets the adaptive planner split a partition value that holds most rows.
    """
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is not valid JSON."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df


def write_contract(df: DataFrame, path: str) -> None:
    """JSON lines with nulls kept, one folder per city."""
    nan_to_null(df).write.mode("overwrite").option("ignoreNullFields", False).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("city").json(path)


def upsert_city_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` replace the rows of their cities; sorted by city."""
    return table.join(rows.select("city"), "city", "left_anti").unionByName(rows, allowMissingColumns=True).orderBy("city")
