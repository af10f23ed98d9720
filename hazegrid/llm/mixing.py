"""Mixing sources to target weights by temperature.

Source shares p become weights p**a / sum(p**a). The exponent a is bisected: the weights must reach a
target entropy, or no source may be repeated more often than a limit. The weights become token
budgets, and each budget a run of block permutations: a source's documents fall into blocks, whole
passes take every block in an order of that pass, and the last pass stops where the budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.llm.common import store

BISECTIONS = 60


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised weights of the sources that have tokens."""
    total = sum(tokens.values())
    raised = {s: math.pow(n / total, exponent) for s, n in tokens.items()}
    whole = sum(raised.values())
    return {s: x / whole for s, x in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in shares.values() if x > 0)


def repetition(tokens: dict[str, int], exponent: float) -> float:
    """Passes over the most repeated source if the least repeated one is read exactly once."""
    w = weights(tokens, exponent)
    per_token = [w[s] / n for s, n in tokens.items()]
    return max(per_token) / min(per_token)


def bisect_exponent(tokens: dict[str, int], max_repetition: float | None = None, target_entropy: float | None = None) -> float:
    """The smallest exponent in [0, 1] within the repetition limit, or the one that reaches the entropy.

    Both quantities fall as the exponent rises. An entropy or limit beyond reach gives 0 or 1.
    """

    def flat_enough(a: float) -> bool:
        if max_repetition is not None:
            return repetition(tokens, a) > max_repetition
        return entropy(weights(tokens, a)) > target_entropy

    if (max_repetition is None) == (target_entropy is None):
        raise ValueError("give either max_repetition or target_entropy")
    lo, hi = 0.0, 1.0
    if not flat_enough(lo):
        return 0.0
    for _ in range(BISECTIONS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if flat_enough(mid) else (lo, mid)
    return hi


def shuffled(*parts: Column) -> Column:
    """A key that orders rows at random, yet the same everywhere: hex of a hash over the parts."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def count_tokens(text: Column) -> Column:
    """Words between white space; 0 for null and blank texts."""
    parts = F.split(text, r"[ \t-\r]+")
    # A text that begins or ends with white space has an empty part there.
    edges = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.when(text.isNull(), 0).otherwise(F.size(parts) - edges).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repetition: float | None = 2.0,
    target_entropy: float | None = None, budget: int | None = None, block_tokens: int = 100_000, seed: str = "mix", sources: int = 10_000,
) -> DataFrame:
    """``docs`` columns with ``n_tokens``, ``epoch``, ``block``, ``block_key`` and ``doc_key``: a row for each time a document is read.

    The mixture is read in the order (epoch, block_key, doc_key), source by source. ``budget`` is its
    number of tokens; without it, it is as large as it must be for every source to be read once, so
    that no document is lost. Documents are taken whole: the last pass of a source ends with the
    document that meets its budget. A null source is the source ''. Documents without tokens weigh
    nothing and are read with each whole pass; a source without any tokens is read once. Rows with a
    null id and repeated rows are documents like others. Null texts have no tokens. An empty table
    gives no rows. Columns with one of the added names are replaced.
    """
    added = ("n_tokens", "epoch", "block", "block_key", "doc_key")
    kept = [c for c in docs.columns if c not in added]
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source")
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id")
    n_tokens = count_tokens(F.col(text_col).cast("string")).alias("n_tokens")
    sized = store(docs.select(ident, source, n_tokens))
    # One row for each source reaches the driver: a list of feeds, whose length is checked.
    totals = {s: int(n) for s, n in sized.groupBy("__source").agg(F.sum("n_tokens")).limit(sources + 1).collect()}
    if len(totals) > sources:
        raise ValueError(f"more than {sources} sources")
    live = {s: n for s, n in totals.items() if n}
    w = weights(live, bisect_exponent(live, max_repetition, target_entropy)) if live else {}
    whole = budget if budget is not None else max((live[s] / w[s] for s in live), default=0.0)
    rows = []
    for s, n in totals.items():
        own = math.floor(whole * w[s] + 1e-6) if n else 0
        passes, rest = divmod(own, n) if n else (1, 0)
        rows.append((s, max(1, math.ceil(n / block_tokens)), passes, rest))
    spark = docs.sparkSession
    plan = spark.createDataFrame(rows, "__source string, __blocks long, __passes long, __rest long")

    def dealt(df: DataFrame, plan: DataFrame) -> DataFrame:
        at = F.conv(F.substring(shuffled(F.lit(f"{seed}/block"), F.col("__source"), F.col("__id")), 1, 15), 16, 10).cast("long")
        out = df.join(F.broadcast(plan), "__source").withColumn("block", F.pmod(at, F.col("__blocks")))
        return out.withColumn("__last", F.col("__passes"))

    def keys(epoch: str) -> dict[str, Column]:
        return {
            "block_key": shuffled(F.lit(f"{seed}/pass"), F.col("__source"), F.col(epoch), F.col("block")),
            "doc_key": shuffled(F.lit(f"{seed}/doc"), F.col("__source"), F.col(epoch), F.col("__id")),
        }

    # The last pass ends inside one block of each source: find that block from block totals, then the
    # document from the rows of that block alone.
    blocks = dealt(sized, plan).where("__rest > 0").groupBy("__source", "block", "__last", "__rest").agg(F.sum("n_tokens").alias("size"))
    running = Window.partitionBy("__source").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("__id", F.lit("")).withColumns(keys("__last")).withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    edge = placed.where("before < __rest AND before + size >= __rest").groupBy("__source").agg(
        F.max(F.struct("block_key", "block", "before")).alias("e")
    )
    edge = store(edge.select("__source", F.col("e.block_key").alias("__edge"), F.col("e.block").alias("block"), (F.col("e.before")).alias("__before")))
    inside = Window.partitionBy("__source", "block").orderBy("doc_key", "__id").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt(sized, plan).join(F.broadcast(edge), ["__source", "block"]).withColumns(keys("__last"))  # one row for each source
    near = near.withColumn("b", F.col("__before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where(F.col("b") < F.col("__rest"))
    ends = near.groupBy("__source").agg(F.first("__edge").alias("__edge"), F.max("doc_key").alias("__stop"))
    final = spark.createDataFrame(
        [(r["__source"], r["__edge"], r["__stop"]) for r in ends.collect()], "__source string, __edge string, __stop string"
    )
    read = dealt(docs.select(*[F.col(f"`{c}`") for c in kept], ident, source, n_tokens), plan.join(final, "__source", "left")).withColumns(keys("__last"))
    again = (F.col("block_key") < F.col("__edge")) | ((F.col("block_key") == F.col("__edge")) & (F.col("doc_key") <= F.col("__stop")))
    times = F.col("__passes") + F.when(again, 1).otherwise(0)
    copies = read.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    return copies.withColumns(keys("epoch")).select(*kept, *added)
