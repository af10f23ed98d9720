"""SimHash near-duplicates through a Gray-order hierarchical index.

The index has two kinds of upper nodes. The top ones are masked bit patterns: 64 bits fall into
``blocks`` blocks, and two fingerprints with at most ``distance`` differing bits agree in at least
``blocks - distance`` of them, so every choice of that many blocks is a mask and all fingerprints
that share a masked pattern form one group; Spark deals the groups out. Inside a group, fingerprints
stand in Gray order, runs of neighbours form nodes, and each node keeps the bits its members share.
Two nodes are compared by the differences of their shared bits alone: once those exceed the
distance, the whole pair of nodes is pruned; once no pair below can exceed it, all are linked at once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.llm.common import components, small_batches, store

FANOUT = 8
#: Node pairs that are held at once.
FRONTIER = 1 << 17
#: Fingerprints of a masked pattern that one task compares; larger groups are cut into cells.
CELL = 8192


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the ``width``-word shingles of ``text``; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        cut = zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in cut), np.uint64, len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp: signed long) of every row; a null text counts as empty."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        out = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
        return pd.Series(out.view(np.int64))

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col).cast("string")).alias("fp"))


def masks(blocks: int, distance: int) -> list[int]:
    """One mask, as a signed long, for each choice of blocks that two near fingerprints must share."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    found = [sum(c) for c in combinations(spans, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def gray_rank(fp: Column) -> Column:
    """Place of a 64-bit word in the Gray sequence, shifted so that signed order is unsigned order."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of labels over the pairs (a, b); every label ends at its root."""
    while len(a):
        ra, rb = labels[a], labels[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def link_groups(fps: np.ndarray, groups: np.ndarray, distance: int) -> np.ndarray:
    """Root position of every fingerprint, linking those of one group within ``distance`` bits.

    ``fps`` (uint64) come ordered by group and then by Gray rank; ``groups`` numbers the groups.
    """
    n = len(fps)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [{"pattern": fps, "common": np.full(n, full), "group": groups, "lo": np.arange(n), "hi": np.arange(1, n + 1)}]
    while True:
        low = levels[-1]
        g = low["group"]
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        if len(starts) == len(g):
            break
        inside = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
        head = np.flatnonzero(inside % FANOUT == 0)
        tail = np.append(head[1:], len(g))
        ones = np.bitwise_and.reduceat(low["pattern"] & low["common"], head)
        zeros = np.bitwise_and.reduceat(~low["pattern"] & low["common"], head)
        levels.append({"pattern": ones, "common": ones | zeros, "group": g[head], "lo": head, "hi": tail})
    labels = np.arange(n)
    first = [np.arange(n)]  # the first fingerprint below each node
    for level in levels[1:]:
        first.append(first[-1][level["lo"]])
    top = np.arange(len(levels[-1]["group"]))
    # Depth first, a slice at a time: what waits are slices of arrays that exist, not their children.
    stack = [(len(levels) - 1, top, top)]
    while stack:
        depth, a, b = stack.pop()
        step = FRONTIER if depth == 0 else max(1, FRONTIER // (FANOUT * FANOUT))
        if len(a) > step:
            stack.append((depth, a[step:], b[step:]))
            a, b = a[:step], b[:step]
        level = levels[depth]
        both = level["common"][a] & level["common"][b]
        apart = np.bitwise_count((level["pattern"][a] ^ level["pattern"][b]) & both).astype(np.int64)
        near = apart <= distance
        a, b, apart, both = a[near], b[near], apart[near], both[near]
        if depth == 0:
            labels = _roots(labels, a, b)
            continue
        sure = apart + np.bitwise_count(~both) <= distance
        if sure.any():
            # All below lie within the distance of each other: chain them.
            sa, sb = a[sure], b[sure]
            labels = _roots(labels, first[depth][sa], first[depth][sb])
            nodes = np.unique(np.concatenate((sa, sb)))
            for d in range(depth, 0, -1):
                lo, hi = levels[d]["lo"][nodes], levels[d]["hi"][nodes]
                size = hi - lo
                kids = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                labels = _roots(labels, first[d - 1][kids], np.repeat(first[d][nodes], size))
                nodes = kids
            a, b = a[~sure], b[~sure]
        if not len(a):
            continue
        lo_a, n_a, lo_b, n_b = level["lo"][a], level["hi"][a] - level["lo"][a], level["lo"][b], level["hi"][b] - level["lo"][b]
        size = n_a * n_b
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wide = np.repeat(n_b, size)
        ka = np.repeat(lo_a, size) + k // wide
        kb = np.repeat(lo_b, size) + k % wide
        keep = ka <= kb if depth > 1 else ka < kb
        stack.append((depth - 1, ka[keep], kb[keep]))
    return labels


def _linker(distance: int):
    keys = ["m", "k", "i", "j"]

    def links(batches):
        held: list[pd.DataFrame] = []

        def solve(part: pd.DataFrame) -> pd.DataFrame:
            same = (part[keys].to_numpy()[1:] == part[keys].to_numpy()[:-1]).all(axis=1)
            groups = np.concatenate(([0], np.cumsum(~same)))
            fps = part["fp"].to_numpy(np.int64)
            roots = link_groups(fps.view(np.uint64), groups, distance)
            moved = roots != np.arange(len(roots))
            return pd.DataFrame({"a": fps[moved], "b": fps[roots[moved]]})

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            last = batch[keys].to_numpy()[-1]
            if (batch[keys].to_numpy()[0] == last).all() or sum(map(len, held)) < 4096:
                continue  # the group goes on, or too little to be worth a round
            rows = pd.concat(held, ignore_index=True)
            whole = ~(rows[keys].to_numpy() == last).all(axis=1)
            held = [rows[~whole]]
            if whole.any():
                yield solve(rows[whole].reset_index(drop=True))
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return links


def near_links(fps: DataFrame, distance: int = 4, blocks: int = 6, cell: int = CELL) -> DataFrame:
    """Links (a, b) that join all distinct ``fp`` within ``distance`` bits; a spanning set, not all pairs.

    Groups of more than ``cell`` fingerprints are cut into chunks, and each pair of chunks is a task.
    """
    tops = [F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(x)).alias("k")) for i, x in enumerate(masks(blocks, distance))]
    spread = fps.select("fp", F.explode(F.array(*tops)).alias("t")).select("t.m", "t.k", "fp")
    counted = spread.withColumn("n", F.count("*").over(Window.partitionBy("m", "k"))).where("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    cells = counted.withColumn("g", chunks).withColumn("c", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    dealt = cells.withColumn("o", other).select(
        "m", "k", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), gray_rank(F.col("fp")).alias("r"), "fp"
    )
    # With one chunk the cell is (0, 0) and the window's own partitioning still holds.
    ready = dealt.repartition("m", "k", "i", "j").sortWithinPartitions("m", "k", "i", "j", "r")
    return ready.mapInPandas(_linker(distance), "a long, b long")


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 4, blocks: int = 6
) -> DataFrame:
    """(id_col, fingerprint, component_id), one row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``distance`` bits. Null and
    empty texts have fingerprint zero and link like any other; a row with a null id has its own
    output row and takes its group's smallest id (null if all are null). Repeated rows repeat. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    marked = store(fingerprints(docs, id_col, text_col, width))
    first = store(marked.groupBy("fp").agg(F.min("id").alias("first")))
    joined = components(near_links(first.select("fp"), distance, blocks))
    roots = first.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    lowest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; a row with a null id stays only if all ids of the group are null."""
    kept = near_components(docs.select(id_col, text_col), id_col, text_col, **options)
    ids = kept.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_kept")).distinct()
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("_kept")), "left_semi")
