"""Alignment of two tokenizers by interval coalescing.

Both tokenizers cut the same bytes of a text. All tokens of a batch, A's and B's, are sorted by their start
(lexsort); the running maximum of their ends (maximum.accumulate) tells where a group breaks: a token that
starts at or behind the maximum opens a new one. Within a group every A token is linked with every B token.
What the corpus says of a link, the number of documents that hold its pair of ids, is a count on Spark and
comes back to the documents by a join.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm import bpe, pieces
from hazegrid.llm.common import small_batches, store

#: Texts aligned at once.
TEXTS = 32
#: Rows of pair counts that are broadcast at most: two ids, a count and a flag each.
BROADCAST_PAIRS = 1_000_000
#: Links of a group that are listed one by one; larger groups are counted by distinct ids first.
LISTED = 64


@dataclass
class Aligned:
    """Tokens of a batch of texts behind each other: bounds by text, group of each token, id pairs with their times by text."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_ends: np.ndarray
    pair_doc: np.ndarray
    pair_a: np.ndarray
    pair_b: np.ndarray
    times: np.ndarray


def _starts(ids: list[np.ndarray], width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, where each starts in the bytes of the batch, and where it ends."""
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
    stop = np.cumsum(width[flat])
    return flat, stop - width[flat], stop


def align(a_ids: list[np.ndarray], b_ids: list[np.ndarray], a_width: np.ndarray, b_width: np.ndarray) -> Aligned:
    """Groups and links of texts whose A and B tokens cover the same bytes (both empty: no tokens)."""
    a, a_start, a_stop = _starts(a_ids, a_width)
    b, b_start, b_stop = _starts(b_ids, b_width)
    start, stop = np.concatenate([a_start, b_start]), np.concatenate([a_stop, b_stop])
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(stop[order])
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(opens) - 1
    a_group, b_group = group[: len(a)], group[len(a) :]
    n_groups = int(opens.sum())
    a_ends, b_ends = np.cumsum([len(x) for x in a_ids]), np.cumsum([len(x) for x in b_ids])
    group_ends = np.where(a_ends > 0, np.append(a_group, -1)[a_ends - 1] + 1, 0)

    doc_of = np.searchsorted(group_ends, np.arange(n_groups), "right")
    n_a, n_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    large = n_a * n_b > LISTED
    ga, ia, ca = _counted(a_group, a, large)
    gb, ib, cb = _counted(b_group, b, large)
    # Every A entry of a group meets every B entry of it.
    in_b = np.bincount(gb, minlength=n_groups)
    first_b = np.cumsum(in_b) - in_b
    reps = in_b[ga]
    left = np.repeat(np.arange(len(ga)), reps)
    right = np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps) + first_b[ga[left]]
    key_doc, key_a, key_b, n = doc_of[ga[left]], ia[left], ib[right], ca[left] * cb[right]
    order = np.lexsort((key_b, key_a, key_doc))
    key_doc, key_a, key_b, n = key_doc[order], key_a[order], key_b[order], n[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key_doc[1:] != key_doc[:-1]) | (key_a[1:] != key_a[:-1]) | (key_b[1:] != key_b[:-1])
    at = np.flatnonzero(new)
    times = np.add.reduceat(n, at) if len(at) else n
    return Aligned(a, b, a_ends, b_ends, a_group, b_group, group_ends, key_doc[at], key_a[at], key_b[at], times)


def _counted(group: np.ndarray, ids: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, count), sorted by group: tokens of small groups one by one, of large groups by distinct id."""
    big = large[group]
    if not big.any():
        return group, ids, np.ones(len(ids), dtype=np.int64)
    (g, i), n = np.unique(np.stack([group[big], ids[big]]), axis=1, return_counts=True)
    g, i = np.concatenate([group[~big], g]), np.concatenate([ids[~big], i])
    n = np.concatenate([np.ones(len(g) - len(n), dtype=np.int64), n])
    order = np.argsort(g, kind="stable")
    return g[order], i[order], n[order]


class Spelling:
    """Writes groups as text: `a1,a2|b1;a3|b2`."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a = n_a
        # Each id with what may follow it: a further token of its side, the other side, another group, the end.
        self.of = [f"{i}{s}".encode() for n, follow in ((n_a, ",|"), (n_b, ",;")) for i in range(n) for s in follow]

    def write(self, x: Aligned) -> list[bytes]:
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, dtype=bool)
        a_word, b_word = 2 * x.a + last(x.a_group), 2 * (self.n_a + x.b) + last(x.b_group)
        order = np.argsort(np.concatenate([2 * x.a_group, 2 * x.b_group + 1]), kind="stable")
        words = np.concatenate([a_word, b_word])[order].tolist()
        ends, at, out = (x.a_ends + x.b_ends).tolist(), 0, []
        for end in ends:
            out.append(b"".join(map(self.of.__getitem__, words[at:end]))[:-1])
            at = end
        return out


class Pair:
    """A byte-level vocabulary (A) and a piece model (B) over the same texts."""

    def __init__(self, vocabulary: str, model: bytes):
        spec = json.loads(vocabulary)
        self.a = bpe.ByteBPE(spec | {"added_tokens": []})  # special tokens' strings are plain text here
        self.b = pieces.load(model)
        self.a_width = np.array([len(t) for t in self.a.tokens], dtype=np.int64)
        self.b_width = self.b.n_bytes
        self.spelling = Spelling(len(self.a.tokens), self.b.size)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; texts that a side does not spell byte by byte have none."""
        a = self.a.encode([" " + t if t else "" for t in texts])
        b = self.b.encode([t or "" for t in texts], ends=False)
        none = np.zeros(0, dtype=np.int64)
        for k, text in enumerate(texts):
            if text:
                raw = (" " + text).encode("utf-8", "surrogatepass")
                spelled = (b"".join(map(t.__getitem__, x[k].tolist())) for t, x in ((self.a.tokens, a), (self.b.bytes_of, b)))
                if not all(s == raw for s in spelled):
                    a[k] = b[k] = none
        return a, b


_pair: dict[int, Pair] = {}


def _model(vocabulary: str, model: bytes) -> Pair:
    key = hash((vocabulary, model))
    if key not in _pair:
        _pair.clear()
        _pair[key] = Pair(vocabulary, model)
    return _pair[key]


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups binary, pair_a array<int>, pair_b array<int>, times array<bigint>"


def align_documents(
    docs: DataFrame, vocabulary: str, model: bytes, text_col: str = "text", keep: list[str] | None = None, digest: bool = False
) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with the alignment of each text, one row for each row.

    ``groups`` is the text `a1,a2|b1;...` in bytes, or with ``digest`` the SHA-256 of it as ``groups_sha256``
    ('' without tokens); ``pair_a``, ``pair_b`` and ``times`` list the distinct id pairs linked in the document
    with the number of their links. Null and empty texts, and texts whose bytes a side does not give back (those
    with U+2581), have no tokens: zeros and empty lists. Texts are taken whole; a large group costs its distinct
    ids, not its tokens. Repeated rows give repeated rows; an empty table gives none; columns of ``docs`` with an
    added name are replaced.
    """
    spark = small_batches(docs.sparkSession)
    added = [f for f in T._parse_datatype_string(ALIGNED) if not (digest and f.name == "groups")]
    if digest:
        added.append(T.StructField("groups_sha256", T.StringType()))
    names = [f.name for f in added]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    files = spark.sparkContext.broadcast((vocabulary, model))  # two vocabulary files: their size does not follow the input
    schema = T.StructType([docs.schema[c] for c in keep] + added)

    def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype()), kind))

    def run(batches):
        pair = _model(*files.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for at in range(0, len(texts), TEXTS):
                part = texts[at : at + TEXTS]
                x = align(*pair.encode(part), pair.a_width, pair.b_width)
                bounds = np.searchsorted(x.pair_doc, np.arange(len(part) + 1))
                links = np.append(0, np.cumsum(x.times))[bounds]
                groups = pair.spelling.write(x)
                made = {
                    "n_a": pa.array(np.diff(x.a_ends, prepend=0)),
                    "n_b": pa.array(np.diff(x.b_ends, prepend=0)),
                    "n_groups": pa.array(np.diff(np.maximum.accumulate(x.group_ends), prepend=0)),
                    "n_links": pa.array(np.diff(links)),
                    "pair_a": lists(x.pair_a, bounds, pa.int32()),
                    "pair_b": lists(x.pair_b, bounds, pa.int32()),
                    "times": lists(x.times, bounds, pa.int64()),
                }
                if digest:
                    made["groups_sha256"] = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string())
                else:
                    made["groups"] = pa.array(groups, pa.binary())
                rows = batch.slice(at, len(part))
                columns = [rows.column(i) for i in range(batch.num_columns - 1)] + [made[c] for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    return source.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair_a, pair_b, n, best): in how many documents a pair is linked, and whether no pair of its A id has more.

    Counted in the map tasks first, so a frequent pair crosses the network once a task; a window holds the pairs
    of one A id, at most as many as B has ids.
    """
    pairs = aligned.select(F.explode(F.arrays_zip("pair_a", "pair_b")).alias("p")).groupBy("p.pair_a", "p.pair_b").agg(F.count("*").alias("n"))
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("pair_a")))


def weigh(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Adds n_best (links whose pair no pair of the same A id beats) and count_sum (counts over links) to rows of ``align_documents``.

    ``aligned`` is written once, so alignment runs once and each row keeps its number. The most frequent pairs,
    ``broadcast_pairs`` at most, are broadcast; the others, none of which many documents hold, are joined by a
    shuffle on the pair. Rows keep all their columns but the pair lists.
    """
    taken = [c for c in aligned.columns if c not in ("pair_a", "pair_b", "times")]
    stored = store(aligned.withColumn("__row", F.monotonically_increasing_id()))
    counts = store(pair_counts(stored))
    size, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most total / (total / broadcast_pairs) pairs reach this count.
    often = 0 if size <= broadcast_pairs else -(-total // broadcast_pairs)
    links = stored.select("__row", F.explode(F.arrays_zip("pair_a", "pair_b", "times")).alias("p")).select("__row", "p.*")

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy("__row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
        )

    joined = links.join(F.broadcast(counts.where(F.col("n") >= often)), ["pair_a", "pair_b"], "left")
    if often:
        rest = joined.where("n IS NULL").select("__row", "pair_a", "pair_b", "times").join(counts.where(F.col("n") < often), ["pair_a", "pair_b"])
        parts = summed(joined.where("n IS NOT NULL")).unionByName(summed(rest)).groupBy("__row")
        sums = parts.agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    else:
        sums = summed(joined)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return (
        stored.select(*[F.col(f"`{c}`") for c in taken if c not in ("n_best", "count_sum")], "__row")
        .join(sums, "__row", "left")
        .select(*[F.col(f"`{c}`") for c in taken if c not in ("n_best", "count_sum")], zero("n_best"), zero("count_sum"))
    )
