"""Exact top-k search with BM25 over sharded inverted indexes.

A shard is a bounded number of documents with its own postings, built where the documents are read.
Document counts, lengths and document frequencies are global, so scores of all shards compare and the
merge of their top k is exact. Within a shard, a scheme like MaxScore, not WAND, skips what cannot enter the top k, for a block of
queries side by side: the short lists are added up first, and a block of documents is looked at only if its best sum so far and its
maxima of the long lists can reach the threshold. There the long lists are a rough matrix product, and documents whose sum, with
what the product may be off, reaches the threshold are scored in full.
A part of the shards answers first and hands its thresholds on.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.llm.common import small_batches, store

K1, B = 1.2, 0.75
SHARD_DOCS = 4096
#: Postings after which a shard ends, however few its documents.
SHARD_POSTINGS = 3_000_000
#: Documents of a block, for the block maxima.
BLOCK = 64
#: Queries that meet the long lists of a shard in one product.
QUERIES = 256
#: Queries whose short lists are added up at once, and their postings if that is less.
ROWS, POSTINGS = 8, 1_000_000
#: Lists longer than this share of a shard are long.
LONG = 1 / 16
#: Query terms of a block of queries; a block is what every task gets at once.
BLOCK_TERMS = 750_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and anything beyond ASCII, with A-Z in lower case."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


INDEX = "shard string, ids array<bigint>, lens array<int>, terms array<string>, dfs array<int>, docs binary, tfs binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row for each shard: ids and lengths of its documents, terms with frequencies, postings in term order.

    Rows with a null id are not documents; null and empty texts are documents without words.
    """
    small_batches(docs.sparkSession)

    def shards(batches):
        part, number = TaskContext.get().partitionId(), count()
        ids: list[int] = []
        lens: list[int] = []
        kinds: list[int] = []
        vocabulary: dict[bytes, int] = {}
        terms: list[int] = []
        tfs: list[int] = []

        def flush() -> pd.DataFrame:
            t, f = np.array(terms, dtype=np.int64), np.array(tfs, dtype=np.int32)
            d = np.repeat(np.arange(len(ids), dtype=np.int32), kinds)
            order = np.argsort(t, kind="stable")
            row = {
                "shard": f"{part}-{next(number)}", "ids": ids, "lens": lens,
                "terms": [w.decode("utf-8", "replace") for w in vocabulary], "dfs": np.bincount(t, minlength=len(vocabulary)).astype(np.int32),
                "docs": d[order].tobytes(), "tfs": f[order].tobytes(),
            }
            return pd.DataFrame({k: [v] for k, v in row.items()})

        for batch in batches:
            for i, text in zip(batch["id"], batch["t"], strict=True):
                found = words(text)
                tally = Counter(found)
                ids.append(i)
                lens.append(len(found))
                kinds.append(len(tally))
                terms.extend([vocabulary.setdefault(w, len(vocabulary)) for w in tally])
                tfs.extend(tally.values())
                if len(ids) >= shard_docs or len(terms) >= SHARD_POSTINGS:
                    yield flush()
                    ids, lens, kinds, vocabulary, terms, tfs = [], [], [], {}, [], []
        if ids:
            yield flush()

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInPandas(shards, INDEX)


class Shard:
    """Postings of one shard that a block of queries asks for, as what each adds to a score.

    A query is a set of words and a word weighs the same in each, so scores are sums of stored numbers.
    ``numbers`` has the number of each term of the shard among the words of the block, or -1.
    """

    def __init__(self, ids, lens, dfs, docs: bytes, tfs: bytes, mean_len: float, numbers: np.ndarray, weights: np.ndarray):
        # Documents of like length stand together, so that a block's maxima are not those of one long document.
        order = np.argsort(lens, kind="stable")
        self.ids, lens = np.asarray(ids, dtype=np.int64)[order], np.asarray(lens, dtype=np.float64)[order]
        n, df, asked = len(self.ids), np.asarray(dfs, dtype=np.int64), numbers >= 0
        wanted = np.repeat(asked, df)
        self.docs = np.argsort(order).astype(np.int32)[np.frombuffer(docs, dtype=np.int32)[wanted]]
        tf = np.frombuffer(tfs, dtype=np.int32)[wanted].astype(np.float64)
        self.df = df[asked]
        self.start = np.cumsum(self.df) - self.df
        self.place = np.full(len(weights), -1)
        self.place[numbers[asked]] = np.arange(len(self.df))
        norm = K1 * (1 - B + B * lens / mean_len)
        self.adds = np.repeat(weights[numbers[asked]], self.df) * (tf * (K1 + 1) / (tf + norm[self.docs]))
        long_terms = np.flatnonzero(self.df > max(1, n * LONG))
        self.row = np.full(len(self.df), -1)
        self.row[long_terms] = np.arange(len(long_terms))
        self.dense = np.zeros((n, len(long_terms)))
        for r, t in enumerate(long_terms):
            own = slice(self.start[t], self.start[t] + self.df[t])
            self.dense[self.docs[own], r] = self.adds[own]
        self.rough = self.dense.astype(np.float32).T
        self.edges = np.arange(0, n, BLOCK)
        self.block_max = np.maximum.reduceat(self.rough, self.edges, axis=1)
        # Nothing is negative, so a rough sum is off by a share of itself.
        self.off = (len(long_terms) + 8) * 2.0**-23

    def top(self, first: np.ndarray, terms: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score): the k best documents of each query with a score above 0 and not below its floor; of equals the smaller ids.

        Query i has the words ``terms[first[i] : first[i + 1]]``.
        """
        place = self.place[terms]
        here = place >= 0
        query, place = np.repeat(np.arange(len(floors)), np.diff(first))[here], place[here]
        is_long = self.row[place] >= 0
        long_q, long_r = query[is_long], self.row[place[is_long]]
        query, place = query[~is_long], place[~is_long]
        held = np.append(0, np.cumsum(np.bincount(query, self.df[place], minlength=len(floors))))
        n, found = len(self.ids), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for begin in range(0, len(floors), QUERIES):
            end = min(begin + QUERIES, len(floors))
            has = np.zeros((end - begin, len(self.rough)), dtype=np.float32)
            own = slice(*np.searchsorted(long_q, [begin, end]))
            has[long_q[own] - begin, long_r[own]] = 1
            of_short = np.empty((end - begin, n))
            a = begin
            while a < end:
                # One query at least, then as many as hold few postings together.
                b = min(max(a + 1, int(np.searchsorted(held, held[a] + POSTINGS, "right")) - 1), a + ROWS, end)
                own = slice(*np.searchsorted(query, [a, b]))
                size = self.df[place[own]]
                at = np.repeat(self.start[place[own]] - (np.cumsum(size) - size), size)
                at += np.arange(len(at))
                cell = np.repeat((query[own] - a) * n, size)
                cell += self.docs.take(at, mode="clip")
                of_short[a - begin : b - begin] = np.bincount(cell, self.adds.take(at, mode="clip"), minlength=(b - a) * n).reshape(b - a, n)
                a = b
            floor = floors[begin:end]
            least = floor - 1e-6
            open_ = np.flatnonzero(floor <= 0)
            if len(open_):
                # Without a threshold from other shards, the k-th of this one.
                last = n - min(k, n)
                sums = has[open_] @ self.rough + of_short[open_]
                least[open_] = np.partition(sums, last, axis=1)[:, last] * (1 - 2 * self.off) - 1e-6
            least = np.maximum(least * (1 - 2 * self.off), 1e-300)[:, None]
            # Only blocks that can reach the threshold by the maxima of their long lists are looked at.
            alive = np.maximum.reduceat(of_short, self.edges, axis=1) + has @ self.block_max >= least
            named = []
            for j, lo in enumerate(self.edges):
                q = np.flatnonzero(alive[:, j])
                if len(q):
                    sums = has[q] @ self.rough[:, lo : lo + BLOCK] + of_short[q, lo : lo + BLOCK]
                    i, d = np.nonzero(sums >= least[q])
                    named.append((q[i], d + lo))
            if named:
                q, d = map(np.concatenate, zip(*named, strict=True))
                q, ids, score = self._best(q, d, of_short[q, d], has, floor, k)
                found.append((q + begin, ids, score))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _best(self, q, d, score, has, floors, k):
        """The k best of the documents ``d`` named for queries ``q``, by exact scores; ``score`` has the short lists' part."""
        for i in range(0, len(q), 1024):
            own = slice(i, i + 1024)
            score[own] += np.einsum("ij,ij->i", self.dense[d[own]], has[q[own]])
        score = np.round(score, 6)
        some = (score > 0) & (score >= floors[q])
        q, ids, score = q[some], self.ids[d[some]], score[some]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[best], ids[best], score[best]


def search(
    index: DataFrame, queries: DataFrame, id_col: str = "query_id", text_col: str = "text", k: int = 10, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(id_col, rank, doc_id, score): the ``k`` documents of an index (``build_index``, stored) that answer each query best.

    A query is the set of its text's words. Scores are BM25 rounded to six digits; equal scores rank by
    doc_id. Queries with a null id, without words, or with words no document has, give no rows. Of
    queries with one id their words together make the query. Queries run in blocks of about
    ``block_terms`` words; a block is sent to all shards.
    """
    spark = small_batches(index.sparkSession)
    n_docs, length = index.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    schema = f"{id_col} bigint, doc_id bigint, score double"
    if not n_docs:
        return spark.createDataFrame([], f"{id_col} bigint, rank int, doc_id bigint, score double")

    def split(batches):
        for batch in batches:
            own = [sorted({w.decode("utf-8", "replace") for w in words(t)}) for t in batch["t"]]
            yield pd.DataFrame({"q": batch["q"], "terms": own})

    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("q"), F.col(text_col).cast("string").alias("t"))
    pairs = store(asked.mapInPandas(split, "q bigint, terms array<string>").select("q", F.explode("terms").alias("term")).distinct())
    in_shards = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("e")).select(F.col("e.terms").alias("term"), F.col("e.dfs").alias("df"))
    known = in_shards.join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    known = pairs.join(known, "term").select("q", F.struct("term", F.col("df").cast("int").alias("df")).alias("e"))
    listed = known.groupBy("q").agg(F.sort_array(F.collect_list("e")).alias("e"))
    total = pairs.count()
    blocks = max(1, -(-total // block_terms))
    ready = store(listed.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))))
    mean_len = max(length / n_docs, 1e-9)
    # About the square root of all shards answer first; the k-th score they find for a query is the
    # threshold that every other shard starts from, so those name few documents more.
    n_shards = index.count()
    stride = max(1, round(n_shards**0.5))
    early = F.pmod(F.xxhash64("shard"), F.lit(stride)) == 0

    def answers(shards: DataFrame, *block) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            names, weights, ids, first, terms, floors = sent.value
            for batch in batches:
                for r in batch.to_struct_array():
                    own = {c: r[c].values for c in ("ids", "lens", "terms", "dfs")}
                    numbers = pc.index_in(own.pop("terms"), value_set=names).fill_null(-1).to_numpy()
                    arrays = [x.to_numpy() for x in own.values()]
                    shard = Shard(*arrays, r["docs"].as_buffer(), r["tfs"].as_buffer(), mean_len, numbers, weights)
                    q, docs, scores = shard.top(first, terms, floors, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(docs), pa.array(scores)], [id_col, "doc_id", "score"])

        part = store(shards.select("ids", "lens", "terms", "dfs", "docs", "tfs").mapInArrow(run, schema))
        sent.unpersist()
        return part

    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        # A block is bounded: about block_terms words, and a threshold for each query.
        rows = ready.where(F.col("block") == b).select("q", "e.term", "e.df").toArrow()
        if not rows.num_rows:
            continue
        ids, lists = rows["q"].to_numpy(), rows["term"].combine_chunks()
        words_of = pc.dictionary_encode(lists.flatten().cast(pa.string()))
        terms = words_of.indices.to_numpy()
        df = np.empty(len(words_of.dictionary))
        df[terms] = rows["df"].combine_chunks().flatten().to_numpy()
        first = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        block = [words_of.dictionary, np.log(1 + (n_docs - df + 0.5) / (df + 0.5)), ids, first, terms]
        part = answers(index.where(early), *block, np.zeros(len(ids)))
        if stride > 1:
            best = F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1)
            floors = {q: f[0] for q, f in part.groupBy(id_col).agg(best).collect() if f}
            part = part.unionByName(answers(index.where(~early), *block, np.array([floors.get(q, 0.0) for q in ids.tolist()])))
        found = found.unionByName(part)
    # Each shard gives k rows for a query at most.
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(id_col, "rank", "doc_id", "score")
