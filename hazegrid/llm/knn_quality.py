"""Quality by nearest-neighbour voting among labelled texts in a latent-semantic space.

A text's terms are triples of its character classes, runs of one class counting once, and how often
words and lines repeat. A bounded sample of labelled rows gives term weights, the latent space
(singular vectors) and the labelled vectors; they are broadcast. Every text is compared with every
labelled vector in blocks of exact cosine products, and the nearest labels vote by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import small_batches

CLASSES = 12
BUCKETS = 12
TERMS = CLASSES**3 + 4 * BUCKETS
#: Texts compared at once.
BLOCK = 256


def _classes() -> np.ndarray:
    """Class of each code point: lower and caseless letters, capitals, digits, space, line end, and kinds of marks."""
    table = np.zeros(0x3000, dtype=np.int64)
    kinds = {".": 5, ",": 6, "!": 7, "?": 7, "|": 8, **dict.fromkeys("#$%&*<>", 9)}
    for p in range(len(table)):
        c = chr(p)
        if c.isupper():
            table[p] = 1
        elif c.isalpha():
            table[p] = 0
        elif c.isnumeric():
            table[p] = 2
        elif c.isspace():
            table[p] = 4 if c == "\n" else 3
        else:
            table[p] = kinds.get(c, 10 if p < 128 else 11)
    return table


_CLASS = _classes()


def _bucket(share: float) -> int:
    return min(BUCKETS - 1, int(share * BUCKETS))


def terms(text: str | None) -> np.ndarray:
    """Square roots of the terms' shares; all zero for null and empty texts."""
    out = np.zeros(TERMS, dtype=np.float32)
    text = text or ""
    if not text:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _CLASS[np.minimum(points, len(_CLASS) - 1)]
    c = c[np.append(True, c[1:] != c[:-1])]
    c = np.concatenate(([4], c, [4]))
    seen = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    out[: CLASSES**3] = np.sqrt(seen / seen.sum())
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    shares = (
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        1 - min(1.0, len(set(words)) / (4 * n**0.5)),
        min(1.0, len(points) / n / 24),
    )
    for i, share in enumerate(shares):
        out[CLASSES**3 + i * BUCKETS + _bucket(share)] = 0.5
    return out


@dataclass
class Model:
    """``space`` maps weighted terms to the latent space; ``vectors`` are unit rows with their ``labels``."""

    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int

    def place(self, rows: np.ndarray) -> np.ndarray:
        latent = rows @ self.space
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def vote(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 among the ``k`` nearest, ties with the last included, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        near = np.maximum(self.place(rows) @ self.vectors.T, 0.0)
        k = min(self.k, near.shape[1])
        edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        near[near < edge[:, None]] = 0.0
        # Neighbours that are as good as the same text outweigh those that only share the language.
        weight = near.astype(np.float64) ** 8
        total = weight.sum(axis=1)
        return np.where(total > 0, np.clip((weight @ self.labels) / np.maximum(total, 1e-300), 0.0, 1.0), 0.5)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_per_class: int = 1500, dims: int = 48, k: int = 25,
) -> Model:
    """Model from at most ``max_per_class`` rows of each label, by hash, whose id is not held out.

    Without labels every score is 0.5; with one label only, every score is that label.
    """
    small_batches(docs.sparkSession)
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))
    picked = [usable.where(f"y = {y}").orderBy(F.xxhash64("id"), "id").limit(max_per_class) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * max_per_class ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(chosen, "id").dropDuplicates(["id"])

    def read(batches):
        for batch in batches:
            packed = [terms(t).tobytes() for t in batch["t"]]
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "v": packed})

    # A few thousand vectors of a fixed length, however many rows and however long the texts.
    got = sorted(rows.select("id", "y", "t").mapInPandas(read, "id long, y int, v binary").collect(), key=lambda r: r.id)
    if not got:
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k)
    x = np.stack([np.frombuffer(bytes(r.v), dtype=np.float32) for r in got]).astype(np.float64)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.2
    idf[(x > 0).sum(axis=0) < 2] = 0.0
    values, vectors = np.linalg.eigh((x * idf).T @ (x * idf))
    space = (idf[:, None] * vectors[:, ::-1][:, :dims]).astype(np.float32)
    model = Model(space, np.zeros((0, 1), np.float32), np.array([float(r.y) for r in got]), k)
    model.vectors = model.place(x.astype(np.float32))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with ``score``: likelihood of label 1, from 0 to 1.

    Null and empty texts score 0.5. Repeated rows repeat; a column named score is replaced; an empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    # Bounded by the sample: labelled rows x dims, terms x dims.
    sent = docs.sparkSession.sparkContext.broadcast((model.space, model.vectors, model.labels, model.k))
    schema = T.StructType([docs.schema[c] for c in keep]).add("score", T.DoubleType())

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores = np.zeros(len(texts))
            for at in range(0, len(texts), BLOCK):
                rows = np.stack([terms(t) for t in texts[at : at + BLOCK]])
                part = own.vote(rows)
                part[~rows.any(axis=1)] = 0.5
                scores[at : at + BLOCK] = part
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=[*keep, "score"])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    return source.mapInArrow(run, schema)
