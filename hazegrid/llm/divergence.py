"""Divergence of sources within a language, on a three-dimensional cube of tasks.

Word probabilities of every (lang, source) group are compared with those of every other source of the language.
A task owns a cell of the cube (group block, group block, term block): it gets the slices of the two blocks
for these terms, fills dense matrices with them, and gives the partial divergence of every pair of groups.
Partial sums are added along the term axis. All numbers are integers, so any order of adding gives one result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import small_batches, store

#: Bytes of words as they stand, A-Z lowered; every other byte parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Distinct words a task gathers before it hands its counts on.
GATHERED = 200_000
#: Parts into which the entries of a source are dealt.
SALTS = 32
#: Sources a block holds on average, and terms.
GROUP_BLOCK = 16
TERM_BLOCK = 4096


def words(text: str) -> list[bytes]:
    """Words of a text in UTF-8: runs of ASCII letters (lowered) and of anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences of each word and documents with it, for each group.

    A group without words has one row with a null term. Tasks count before the shuffle.
    """
    small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))

    def run(batches):
        counts: dict[tuple, Counter] = {}
        held: dict[tuple, Counter] = {}

        def flush():
            keys = [(g, t) for g, c in counts.items() for t in (c or [None])]
            columns = [
                pa.array([g[0] for g, _ in keys], pa.string()),
                pa.array([g[1] for g, _ in keys], pa.string()),
                pa.array([t for _, t in keys], pa.binary()).cast(pa.string()),
                pa.array([counts[g][t] if t is not None else 0 for g, t in keys], pa.int64()),
                pa.array([held[g][t] if t is not None else 0 for g, t in keys], pa.int64()),
            ]
            counts.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "n_docs"])

        gathered = 0
        for batch in batches:
            for lang, source, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Counter(words(doc))
                group = (lang, source)
                if group not in counts:
                    counts[group], held[group] = Counter(), Counter()
                before = len(counts[group])
                counts[group].update(own)
                held[group].update(own.keys())
                gathered += 1 + len(counts[group]) - before
                if gathered >= GATHERED:
                    yield flush()
                    gathered = 0
        yield flush()

    part = rows.mapInArrow(run, "lang string, source string, term string, n bigint, n_docs bigint")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _share(count: str, n: str, v: str) -> F.Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), in decimals as the product may pass a long."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0))) div CAST({n} + 2 * {v} AS DECIMAL(20,0))")


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of shares up to 10^9 + 1: the square fits in 64 bits."""
    d = p - q
    return d * d // (p + q)


def _cell(keys: tuple, cell: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of all pairs of groups of one cell, over the terms met in it, and how many these are."""
    groups = cell[cell.term_id < 0]
    entries = cell[cell.term_id >= 0]
    left, right = (groups[groups.side == s].sort_values("group_id") for s in (0, 1))
    diagonal = keys[1] == keys[2]
    right = left if diagonal else right
    terms, at = np.unique(entries.term_id.to_numpy(np.int64), return_inverse=True)

    def dense(side: int, own: pd.DataFrame) -> np.ndarray:
        full = np.repeat(own.p.to_numpy(np.int64)[:, None], len(terms), axis=1)
        mine = (entries.side == side).to_numpy()
        full[np.searchsorted(own.group_id.to_numpy(), entries.group_id.to_numpy()[mine]), at[mine]] = entries.p.to_numpy(np.int64)[mine]
        return full

    a = dense(0, left)
    b = a if diagonal else dense(1, right)
    ids = right.group_id.to_numpy()
    out = []
    for k, g in enumerate(left.group_id.to_numpy()):
        to = ids > g if diagonal else np.ones(len(ids), dtype=bool)
        value = gap(a[k], b[to]).sum(axis=1) - len(terms) * gap(left.p.to_numpy(np.int64)[k], right.p.to_numpy(np.int64)[to])
        out.append(pd.DataFrame({"g": g, "h": ids[to], "value": value}))
    return pd.concat(out) if out else pd.DataFrame({"g": [], "h": [], "value": []}).astype("int64")


def shares(docs: DataFrame, min_docs: int = 10, **columns) -> tuple[DataFrame, DataFrame]:
    """(groups, entries), written tables with the exact shares of kept terms.

    groups: group_id, lang, source, n_group, n_all, v (kept terms of the language), n_groups (of the language), p_none
    (share of a kept term that the group lacks). entries: group_id, lang, source, term_id, term, p (share in the
    group), q (share in the language), v, n_groups.
    """
    counts = store(term_counts(docs, **columns))
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("n_docs"))
    kept = store(terms.where(F.col("n_docs") >= min_docs).select("lang", "term", "n_lang", F.monotonically_increasing_id().alias("term_id")))
    held = store(counts.where("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "term_id", "n", "n_lang"))
    every = counts.select("lang", "source", F.lit(0).cast("long").alias("n"))  # groups without kept terms too
    sums = held.select("lang", "source", "n").unionByName(every).groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("n_all"))
    langs = store(sums.groupBy("lang").agg(F.count("*").alias("n_groups")).join(langs, "lang", "left").na.fill(0, ["v", "n_all"]))
    # A language without kept terms has no shares; 1 keeps the divisor from being zero.
    none = _share("0", "n_group", "greatest(v, 1)").alias("p_none")
    number = F.monotonically_increasing_id().alias("group_id")
    groups = store(sums.join(langs, "lang").select(number, "lang", "source", "n_group", "n_all", "v", "n_groups", none))
    # One source may hold a third of all terms: its entries are dealt out over salts, its one row is copied to each.
    salt = F.pmod(F.xxhash64("term_id"), F.lit(SALTS)).alias("salt")
    copied = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    p, q = _share("n", "n_group", "v").alias("p"), _share("n_lang", "n_all", "v").alias("q")
    entries = held.select("*", salt).join(copied, ["lang", "source", "salt"])
    return groups, store(entries.select("group_id", "lang", "source", "term_id", "term", p, q, "v", "n_groups"))


def pair_divergence(groups: DataFrame, entries: DataFrame, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(group_id, other_id, value) for every two groups of a language, both ways.

    Cells hold about ``group_block`` sources a side and ``term_block`` terms, dealt by hash: no source and no term
    is larger than one row of a cell. An entry goes to as many cells as its language has group blocks. A term that
    a cell does not meet has the same share in both groups of a pair as any other absent term, so the whole sum is
    v times that gap, plus what the cells' terms differ from it.
    """
    blocks = F.ceil(F.col("n_groups") / F.lit(group_block)).cast("int")
    block = F.pmod(F.xxhash64("group_id"), blocks).cast("int")
    slices = F.greatest(F.lit(1), F.ceil(F.col("v") / F.lit(term_block))).cast("int")
    term_slice = F.pmod(F.xxhash64("term_id"), slices).cast("int")

    # A block meets itself, the later ones from the left and the earlier ones from the right.
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    side = F.when(F.col("other") >= F.col("block"), 0).otherwise(1)

    def placed(rows: DataFrame) -> DataFrame:
        return rows.select("*", others).select(
            "lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "slice", side.alias("side"), "group_id", "term_id", "p"
        )

    every_slice = F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice")
    own = groups.where("v > 0").select(
        "lang", "group_id", F.lit(-1).cast("long").alias("term_id"), F.col("p_none").alias("p"), blocks.alias("blocks"), block.alias("block"), every_slice
    )
    held = entries.select("lang", "group_id", "term_id", "p", blocks.alias("blocks"), block.alias("block"), term_slice.alias("slice"))
    cells = placed(own).unionByName(placed(held))
    partial = cells.groupBy("lang", "i", "j", "slice").applyInPandas(_cell, "g bigint, h bigint, value bigint")
    summed = partial.groupBy("g", "h").agg(F.sum("value").alias("value"))
    none = groups.select("group_id", "p_none", "v")
    a, b = (none.select(F.col("group_id").alias(k), F.col("p_none").alias(f"p_{k}"), F.col("v").alias(f"v_{k}")) for k in ("g", "h"))
    base = F.expr("v_g * (((p_g - p_h) * (p_g - p_h)) div (p_g + p_h))")
    whole = summed.join(a, "g").join(b, "h").select("g", "h", (F.col("value") + base).alias("value"))
    turned = whole.select(F.col("h").alias("group_id"), F.col("g").alias("other_id"), "value")
    return store(whole.select(F.col("g").alias("group_id"), F.col("h").alias("other_id"), "value").unionByName(turned))


def audit(
    docs: DataFrame, min_docs: int = 10, top: int = 10, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK, **columns
) -> DataFrame:
    """lang, source, part, item, value, rank: how far a source is from the others of its language, and by which terms.

    Part ``pair``: each other source, all ranks. Part ``term``: the ``top`` kept terms the source uses more than its
    language does. Ties go to the item first in UTF-8. Null text, lang and source count as ''; repeated rows count as
    often as they stand; texts are read whole; a language in which no term is in ``min_docs`` documents has pairs of
    value 0 and no terms; a language of one source has no pairs; an empty table gives no rows; other columns of
    ``docs`` do not matter, whatever their names.
    """
    groups, entries = shares(docs, min_docs, **columns)
    named = groups.select("group_id", "lang", "source")
    silent = groups.where("v = 0").select("lang", "source")
    zero = silent.join(silent.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    found = pair_divergence(groups, entries, group_block, term_block)
    found = found.join(named, "group_id").join(named.select(F.col("group_id").alias("other_id"), F.col("source").alias("item")), "other_id")
    pairs = found.select("lang", "source", "item", "value").unionByName(zero.select("lang", "source", "item", "value")).withColumn("part", F.lit("pair"))
    far = entries.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    order = "row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)"
    terms = far.withColumn("rank", F.expr(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    ranked = pairs.withColumn("rank", F.expr(order)).unionByName(terms)
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
