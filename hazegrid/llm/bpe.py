"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that stands inside no token of the vocabulary can never be merged over,
so it marks a certain cut. The pre-tokeniser's pieces are cut there as well, each fragment is merged
on its own, and the ids are concatenated. Fragments repeat, so each task remembers a bounded number
of them.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import small_batches

#: Pieces and fragments a task remembers before it starts afresh.
REMEMBERED = 100_000
NO_RANK = 1 << 40
#: Latin texts without exotic digits or spaces: explicit classes say the same and run faster.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[\t\n\r -~À-ÖØ-öø-ɏ]*\Z")
_PLAIN_PIECES = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LATIN}]+| ?[0-9]+| ?[^\t\n\r {_LATIN}0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
)
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECES = regex.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def pieces(text: str) -> list[str]:
    """The pre-tokeniser's pieces of a text."""
    return (_PLAIN_PIECES if _PLAIN.match(text) else _PIECES).findall(text)


def byte_letters() -> dict[str, int]:
    """The vocabulary file's letter of each byte: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A vocabulary with its merges; ``encode`` works on a batch, so that fragments not met before are merged together."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = {to_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.tokens[i] = token
        self.byte_id = np.array([vocab[bytes([b])] for b in range(256)], dtype=np.int64)
        self.inner = np.zeros((256, 256), dtype=bool)
        for token in vocab:
            for i in range(len(token) - 1):
                self.inner[token[i], token[i + 1]] = True
        self._fill([(vocab[a], vocab[b], vocab[a + b]) for a, b in ((to_bytes(x), to_bytes(y)) for x, y in merges)])
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.special else None
        self.known: dict[str, bytes] = {}

    # A hash table in arrays: pair of ids -> rank and id of the merged token.

    def _fill(self, merges: list[tuple[int, int, int]]) -> None:
        self.bits = max(4, (8 * len(merges)).bit_length())
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, NO_RANK, dtype=np.int64)
        self.merged = np.zeros(1 << self.bits, dtype=np.int64)
        for rank, (a, b, whole) in enumerate(merges):
            pair = a << 32 | b
            at = int(self._slot(np.array([pair]))[0])
            while self.key[at] not in (-1, pair):
                at = (at + 1) % len(self.key)
            if self.key[at] < 0:
                self.key[at], self.rank[at], self.merged[at] = pair, rank, whole

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        mixed = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, pair: np.ndarray) -> np.ndarray:
        """Slots of the pairs; an empty slot for pairs that no merge has."""
        at = self._slot(pair)
        while True:
            other = (self.key[at] != pair) & (self.key[at] >= 0)
            if not other.any():
                return at
            at[other] = (at[other] + 1) % len(self.key)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """True where a byte certainly starts a new token: the pair before it is inside no token."""
        start = np.ones(len(data), dtype=bool)
        start[1:] = ~self.inner[data[:-1], data[1:]]
        return start

    def merge(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every fragment (``start`` marks their first places) until no merge applies; ids and their places."""
        place = np.arange(len(ids))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            last = np.append(start[1:], True)
            slot = self._find(ids << 32 | np.append(ids[1:], 0))
            rank = np.where(last, NO_RANK, self.rank[slot])
            head = np.flatnonzero(start)
            size = np.diff(np.append(head, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, head), size)
            open_ = best < NO_RANK
            hit = open_ & (rank == best)
            # Of overlapping hits (one letter repeated) every second one merges, from the left.
            after = np.flatnonzero(hit[1:] & hit[:-1]) + 1
            if len(after):
                run = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
                where = np.flatnonzero(hit)
                hit[where[(where - run[np.searchsorted(run, where, "right") - 1]) % 2 == 1]] = False
            ids = np.where(hit, self.merged[slot], ids)
            done.append((place[~open_], ids[~open_]))
            stay = open_ & ~np.append(False, hit[:-1])
            ids, start, place = ids[stay], start[stay], place[stay]
        places = np.concatenate([p for p, _ in done] or [np.zeros(0, np.int64)])
        found = np.concatenate([i for _, i in done] or [np.zeros(0, np.int64)])
        order = np.argsort(places, kind="stable")
        return found[order], places[order]

    def learn(self, new: list[str]) -> None:
        """Remember the packed ids of pieces: cut, merge the fragments, put them together again."""
        data = [p.encode("utf-8", "surrogatepass") for p in new]
        ends = np.cumsum([len(d) for d in data])
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        start = self.cuts(raw)
        start[ends[:-1]] = True
        ids, places = self.merge(self.byte_id[raw], start)
        packed = ids.astype(np.int32).tobytes()
        stops = (4 * np.searchsorted(places, ends)).tolist()
        at = 0
        for piece, stop in zip(new, stops, strict=True):
            self.known[piece] = packed[at:stop]
            at = stop

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        split = []
        for text in texts:
            if any(s in text for s in self.special):
                split.append([q for part in self.split_special(text) for q in ([part] if part in self.special else pieces(part))])
            else:
                split.append(pieces(text))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for token, i in self.special.items():
            self.known[token] = np.array([i], dtype=np.int32).tobytes()
        new = list(set(filterfalse(self.known.__contains__, chain.from_iterable(split))))
        if new:
            self.learn(new)
        packed = self.known.__getitem__
        return [np.frombuffer(b"".join(map(packed, own)), dtype=np.int32) for own in split]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _model(spec: str) -> ByteBPE:
    return ByteBPE(json.loads(spec))


def read_vocabulary(path: str) -> str:
    """The vocabulary file's content; tasks get the content, so only the driver needs the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def round_trip(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with ``ids`` (array<int>) and ``decoded`` (string), one row for each row.

    A null text counts as empty: no ids, decoded ''. Special tokens in a text become their id, as in
    the public library. ``keep`` defaults to all columns; columns named ids or decoded are replaced.
    Order of rows is that of the input partitions; an empty table gives no rows.
    """
    spark = small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    spec = spark.sparkContext.broadcast(vocabulary)  # one vocabulary file: its size does not follow the input
    schema = T.StructType([docs.schema[c] for c in keep]).add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(batches):
        model = _model(spec.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            # A few texts at a time: ids of a batch of very long texts need not be held together.
            for at in range(0, len(texts), 128):
                ids = model.encode([t or "" for t in texts[at : at + 128]])
                back = [model.decode(x.tolist()) for x in ids]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                rows = batch.slice(at, len(ids))
                columns = [rows.column(i) for i in range(batch.num_columns - 1)]
                columns += [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", "decoded"])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    return source.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to rows of ``round_trip``."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.withColumns(
        {"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(listed, 256), "decoded_sha256": F.sha2("decoded", 256)}
    )
