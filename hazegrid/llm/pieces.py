"""SentencePiece encoding and decoding by vectorised merge rounds.

A text becomes words: a run of space marks with the letters behind it, as no piece has a mark after a
letter. The words of a batch lie behind each other in flat numpy arrays of symbols. Every round looks up
all neighbouring pairs at once, takes the best score of each word (a segmented minimum), merges its
occurrences from the left and drops what cannot merge any more, until no pair remains.

Occurrences of one word merge in the same round up to the first after which a new neighbour pair would
have to go first; that keeps the order of one merge at a time, so ids equal the public library's.
"""

from __future__ import annotations

import hashlib
import re
from codecs import register_error
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from hazegrid.llm.common import small_batches

SPACE = "▁"
#: Rank of a pair that makes no piece.
NEVER = np.int32(2**31 - 1)
#: Words a task remembers before it starts afresh.
REMEMBERED = 100_000
#: Texts encoded at once: their ids are held together.
TEXTS = 64

# A byte that is no part of a valid character stands for one replacement character.
register_error("each_byte", lambda e: ("�", e.start + 1))


class PieceBPE:
    """A BPE piece model with byte fallback; ``encode`` works on a batch, so that words not met before merge together."""

    def __init__(self, serialized: bytes):
        spec = proto.ModelProto()
        spec.ParseFromString(serialized)
        norm = spec.normalizer_spec
        kinds = proto.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models with an identity normaliser and a space before the text")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("no user-defined or unused pieces")
        self.size = len(spec.pieces)
        of_kind = lambda kind: [i for i, p in enumerate(spec.pieces) if p.type == kind]
        self.control = set(of_kind(kinds.CONTROL))
        self.begin, self.end = (next(i for i in self.control if spec.pieces[i].piece == s) for s in ("<s>", "</s>"))
        self.byte_id = np.array(of_kind(kinds.BYTE), dtype=np.int32)
        self.bytes_of = [p.piece.replace(SPACE, " ").encode() for p in spec.pieces]
        for b, i in enumerate(self.byte_id.tolist()):
            self.bytes_of[i] = bytes([b])
        for i in self.control:
            self.bytes_of[i] = b""
        for i in of_kind(kinds.UNKNOWN):
            self.bytes_of[i] = " ⁇ ".encode()
        self.led = {i for i in of_kind(kinds.NORMAL) if spec.pieces[i].piece.startswith(SPACE)}
        self.n_bytes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

        ids = {spec.pieces[i].piece: i for i in of_kind(kinds.NORMAL)}
        # Letters that stand in pieces without being one are symbols too; their numbers follow the pieces.
        symbols = dict(ids)
        for letter in sorted(set("".join(ids))):
            symbols.setdefault(letter, len(self.bytes_of) + len(symbols) - len(ids))
        letters = [s for s in symbols if len(s) == 1]
        self.letter_of = np.full(0x110000, -1, dtype=np.int32)
        self.letter_of[[ord(c) for c in letters]] = np.arange(len(letters))
        self.symbol_of = np.array([symbols[c] for c in letters], dtype=np.int64)
        at = {c: i for i, c in enumerate(letters)}
        self.inner = np.zeros((len(letters), len(letters)), dtype=bool)
        for piece in ids:
            for x, y in zip(piece, piece[1:], strict=False):
                self.inner[at[x], at[y]] = True
        # Equal scores share a rank: among them the leftmost goes first.
        ranks = {s: r for r, s in enumerate(sorted({-spec.pieces[i].score for i in ids.values()}))}
        rank = {p: ranks[-spec.pieces[i].score] for p, i in ids.items()}
        pairs = [
            (symbols[p[:k]], symbols[p[k:]], rank[p], i)
            for p, i in ids.items()
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        ]
        self._fill(np.array(pairs, dtype=np.int64).reshape(-1, 4))
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if all(SPACE not in p.lstrip(SPACE) for p in ids) else "(?s:.+)").findall
        self.block = self._run_block(ids, rank)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _run_block(ids: dict[str, int], rank: dict[str, int]) -> int:
        """Marks after which a run of space marks certainly starts a new token, or 0.

        Pieces with two marks or more are runs of one rank, so a run merges from the left: a stack whose top
        grows while a piece fits. A run that ends as the longest piece takes part in nothing more.
        """
        runs = [p for p in ids if SPACE * 2 in p]
        if not runs or any(p.strip(SPACE) for p in runs) or len({rank[p] for p in runs}) > 1 or max(rank.values()) != rank[runs[0]]:
            return 0
        longest, stack = max(map(len, runs)), []
        for _ in range(longest):
            stack.append(1)
            while len(stack) > 1 and SPACE * (stack[-1] + stack[-2]) in ids:
                stack[-2:] = [stack[-1] + stack[-2]]
        return longest if stack == [longest] else 0

    # A hash table in arrays: pair of symbols -> rank and id of the merged piece.

    def _fill(self, pairs: np.ndarray) -> None:
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, NEVER, dtype=np.int32)
        self.merged = np.zeros(1 << self.bits, dtype=np.int64)
        left = pairs
        slot = self._slot(left[:, 0] << 32 | left[:, 1])
        while len(left):
            pair = left[:, 0] << 32 | left[:, 1]
            free = self.key[slot] < 0
            self.key[slot[free]] = pair[free]  # of two that want one slot the last stays
            own = self.key[slot] == pair
            self.rank[slot[own]], self.merged[slot[own]] = left[own, 2], left[own, 3]
            left, slot = left[~own], (slot[~own] + 1) % len(self.key)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        mixed = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of the pairs; an empty slot for pairs that make no piece."""
        pair = a << 32 | b
        at = self._slot(pair)
        other = np.flatnonzero((self.key[at] != pair) & (self.key[at] >= 0))
        while len(other):
            at[other] = (at[other] + 1) % len(self.key)
            other = other[(self.key[at[other]] != pair[other]) & (self.key[at[other]] >= 0)]
        return at

    def _cuts(self, code: np.ndarray, letter: np.ndarray, head: np.ndarray) -> np.ndarray:
        """True where a token certainly starts: at the ``head`` of a word, or where no piece holds the letters before and behind."""
        start = head.copy()
        start[1:] |= (letter[1:] < 0) | (letter[:-1] < 0) | ~self.inner[letter[:-1], letter[1:]]
        if self.block:
            mark = code == ord(SPACE)
            where = np.flatnonzero(mark)
            first = np.flatnonzero(mark & (head | ~np.append(False, mark[:-1])))
            if len(where) > len(first):
                start[where[(where - first[np.searchsorted(first, where, "right") - 1]) % self.block == 0]] = True
        return start

    def merge(self, symbol: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the words that ``start`` marks until no pair remains; symbols and their places."""
        place = np.arange(len(symbol))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            last = np.append(start[1:], True)
            slot = self._find(symbol, np.append(symbol[1:], 0))
            rank = np.where(last, NEVER, self.rank[slot])
            head = np.flatnonzero(start)
            low = np.minimum.reduceat(rank, head)
            word = np.cumsum(start) - 1
            best = low[word]
            open_ = best < NEVER
            hit = np.flatnonzero(open_ & (rank == best))
            done.append((place[~open_], symbol[~open_]))
            if not len(hit):
                break
            # Of overlapping hits (one letter repeated) every second one counts, from the left.
            run = np.flatnonzero(np.append(True, np.diff(hit) > 1))
            nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[nth % 2 == 0]
            whole = self.merged[slot[hit]]
            # A merge makes new pairs with both neighbours. Where one of them must go before the word's next
            # occurrence, the occurrences behind wait for another round.
            r = rank[hit]
            before = np.where(start[hit], -1, symbol[hit - 1])
            after = np.where(last[hit + 1], -1, symbol[np.minimum(hit + 2, len(symbol) - 1)])
            touching = np.append(False, (hit[1:] == hit[:-1] + 2) & ~start[hit[1:]])
            before[touching] = whole[np.flatnonzero(touching) - 1]
            urgent = lambda a, b: (a >= 0) & (b >= 0) & (self.rank[self._find(np.maximum(a, 0), np.maximum(b, 0))] <= r)
            stops = urgent(before, whole) | urgent(whole, after)
            if stops.any():
                of = word[hit]
                first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                seen = np.cumsum(stops) - stops
                go = seen == np.repeat(seen[first], np.diff(np.append(first, len(hit))))
                hit, whole = hit[go], whole[go]
            symbol = symbol.copy()
            symbol[hit] = whole
            stay = open_.copy()
            stay[hit + 1] = False
            symbol, start, place = symbol[stay], start[stay], place[stay]
        places = np.concatenate([p for p, _ in done] or [np.zeros(0, np.int64)])
        found = np.concatenate([s for _, s in done] or [np.zeros(0, np.int64)])
        order = np.argsort(places, kind="stable")
        return found[order], places[order]

    def learn(self, new: list[str]) -> None:
        """Remember the packed ids of words: cut, merge, and spell letters without a piece in bytes."""
        ends = np.cumsum([len(w) for w in new])
        code = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = self.letter_of[code]
        head = np.zeros(len(code), dtype=bool)
        head[[0, *ends[:-1]]] = True
        start = self._cuts(code, letter, head)
        symbol = np.where(letter < 0, -1, self.symbol_of[letter])
        symbol, places = self.merge(symbol, start)
        spelled = np.flatnonzero((symbol < 0) | (symbol >= self.size))
        if len(spelled):
            spell = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), dtype=np.uint8) for c in code[places[spelled]]]
            width = np.ones(len(symbol), dtype=np.int64)
            width[spelled] = [len(s) for s in spell]
            where = np.repeat(np.arange(len(symbol)), width)
            in_bytes = np.isin(where, spelled)
            symbol, places = symbol[where], places[where]
            symbol[in_bytes] = self.byte_id[np.concatenate(spell)]
        packed = symbol.astype("<u4").tobytes()
        stops = (4 * np.searchsorted(places, ends)).tolist()
        at = 0
        for word, stop in zip(new, stops, strict=True):
            self.known[word] = packed[at:stop]
            at = stop

    def encode(self, texts: list[str], ends: bool = True) -> list[np.ndarray]:
        """Ids of every text; with ``ends`` the begin and end ids stand around them."""
        split = [self.split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(filterfalse(self.known.__contains__, chain.from_iterable(split))))
        if new:
            self.learn(new)
        packed = self.known.__getitem__
        first, last = (np.array([x], dtype="<u4").tobytes() if ends else b"" for x in (self.begin, self.end))
        return [np.frombuffer(b"".join([first, *map(packed, own), last]), dtype="<u4") for own in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space before it; a byte that is no part of a character gives U+FFFD."""
        first = next((k for k, i in enumerate(ids) if i not in self.control), len(ids))
        ids = ids[first:-1] if ids and ids[-1] in self.control else ids[first:]
        led = bool(ids) and ids[0] in self.led
        if self.control.isdisjoint(ids):
            runs = [ids]
        else:  # a control piece also ends a character spelled in bytes
            at = [-1, *(k for k, i in enumerate(ids) if i in self.control), len(ids)]
            runs = [ids[a + 1 : b] for a, b in zip(at, at[1:], strict=False)]
        text = "".join(b"".join(map(self.bytes_of.__getitem__, r)).decode("utf-8", "each_byte") for r in runs)
        return text[1:] if led else text


@lru_cache(maxsize=2)
def load(serialized: bytes) -> PieceBPE:
    return PieceBPE(serialized)


def read_model(path: str) -> bytes:
    """The model file's content; tasks get the content, so only the driver needs the file."""
    with open(path, "rb") as f:
        return f.read()


ADDED = {
    "ids": (T.ArrayType(T.LongType()), pa.large_list(pa.int64())),
    "decoded": (T.StringType(), pa.string()),
    "n_tokens": (T.LongType(), pa.int64()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def round_trip(
    docs: DataFrame, model: bytes, text_col: str = "text", keep: list[str] | None = None, add: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with the columns ``add`` names, one row for each row.

    ``ids`` are those of the text with begin and end, ``decoded`` is the text of the ids; ``n_tokens``,
    ``ids_sha256`` (of ids as little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of UTF-8) are
    digests of the two. A null text counts as empty: begin and end alone, decoded ''. Texts are taken whole,
    TEXTS of them at a time, so a task holds the ids of few texts. Repeated rows give repeated rows; nulls in
    other columns pass; columns of ``docs`` with the name of an added one are replaced; an empty table gives
    no rows. Rows keep the order of their partition.
    """
    spark = small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in add]
    spec = spark.sparkContext.broadcast(model)  # one model file: its size does not follow the input
    schema = T.StructType([docs.schema[c] for c in keep])
    for c in add:
        schema = schema.add(c, ADDED[c][0])

    def run(batches):
        own = load(spec.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for at in range(0, len(texts), TEXTS):
                ids = own.encode([t or "" for t in texts[at : at + TEXTS]])
                back = [own.decode(x.tolist()) for x in ids]
                made = {
                    "ids": lambda: ids,
                    "decoded": lambda: back,
                    "n_tokens": lambda: [len(x) for x in ids],
                    "ids_sha256": lambda: [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": lambda: [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back],
                }
                rows = batch.slice(at, len(ids))
                columns = [rows.column(i) for i in range(batch.num_columns - 1)]
                columns += [pa.array(made[c](), pa.list_(pa.int64()) if c == "ids" else ADDED[c][1]) for c in add]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *add])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    return source.mapInArrow(run, schema)
