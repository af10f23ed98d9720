"""Helpers the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.session import shared_dir

#: Rows of a batch that Python sees at once: texts may hold megabytes each.
ARROW_ROWS = "512"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound what a Python task holds: texts are long, so batches are short."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a, b: long) -> (node, component), the smallest node.

    Alternates large-star and small-star steps; every step is a minimum with map-side combine and an
    equi-join, so the edges of a hub never meet in one task. Nodes without a link are not returned.
    Rows with a null end or equal ends count for nothing.
    """
    edges = store(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = mark(edges)
    for _ in range(rounds):
        # Large star: larger neighbours of u point to the smallest node around u.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        star = edges.join(low, F.col("b") == F.col("u")).select("a", F.col("m").alias("b"))
        # Small star: smaller neighbours of u, and u, point to the smallest of them.
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        joined = star.join(low.select(F.col("a").alias("u"), "m"), F.col("a") == F.col("u"))
        pairs = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p"))
        edges = store(pairs.select("p.a", "p.b").where("a <> b").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
