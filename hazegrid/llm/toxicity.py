"""Toxicity of texts whose spelling may be disguised.

Disguises are seen as a noisy channel: look-alike symbols for letters, letters set apart, letters
repeated. Every suspicious span becomes a lattice of what each character may stand for; a Viterbi
search picks the reading that the channel's costs and a character trigram model of the whole corpus
like best. The restored text is then scored by evidence learned from labelled rows: word beginnings
that stand, as good as always, in toxic documents.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import small_batches, store

# What look-alike symbols stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Letters the character model tells apart; 0 is anything that is no letter, the last is any other letter.
LETTERS = " abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SIZE = 64
OTHER = SIZE - 1
#: Costs, in nats, of what the channel may do.
LOOK_ALIKE_COST, REPEAT_COST, DOUBLE_COST, GAP_COST, KEEP_SYMBOL_COST = 1.0, 0.2, 3.0, 0.2, 3.0

#: What may stand between letters set apart.
GAPS = " \t.-_*/\\,~'"

_RUN = "a-zß-ÿ" + re.escape("".join(LOOK_ALIKES))
_SINGLE = r"a-zß-ÿ0-9" + re.escape("".join(c for c in LOOK_ALIKES if not c.isdigit()))
#: Wide on purpose: whether a symbol is a letter in disguise is for the costs of the lattice to decide.
_SUSPECT = re.compile(
    # at least four single letters or look-alikes, set apart
    rf"(?<![\w{_SINGLE}])[{_SINGLE}](?:[{re.escape(GAPS)}]{{1,4}}[{_SINGLE}]){{3,}}(?![\w{_SINGLE}])"
    # a run of letters and look-alikes that has both
    rf"|(?<![{_RUN}])(?=[^a-zß-ÿ\s]*+[a-zß-ÿ])(?=[a-zß-ÿ]*+[^a-zß-ÿ\s])[{_RUN}]+"
)
#: A letter three times running, or three doubled letters in one word.
_REPEATED = re.compile(
    r"(?<![^\W\d_])(?=[^\W\d_]*?([^\W\d_])\1\1|(?:[^\W\d_]*?([^\W\d_])\2){3})[^\W\d_]+"
)
_WORDS = re.compile(r"[^\W\d_]+")


def _codes(text: str) -> np.ndarray:
    """Letter numbers of a lower-cased text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


def _table() -> np.ndarray:
    table = np.zeros(0x3000, dtype=np.int64)
    for p in range(len(table)):
        if chr(p).isalpha():
            table[p] = LETTERS.index(chr(p)) if chr(p) in LETTERS[1:] else OTHER
    table[-1] = OTHER
    return table


_TABLE = _table()
_KINDS = np.where(_TABLE > 0, 1, 0)
_KINDS[[ord(c) for c in LOOK_ALIKES]] = 2


def oddities(text: str) -> tuple[bool, bool]:
    """Whether a lower-cased text can hold a suspicious span, or a word with repeated letters.

    Necessary conditions, seen at all places at once, so that most texts need no pattern search.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) < 2:
        return False, False
    kind = _KINDS[np.minimum(points, len(_KINDS) - 1)]
    letter, mark = kind == 1, kind == 2
    same = (points[1:] == points[:-1]) & letter[1:]
    doubled = np.flatnonzero(same)
    word = np.cumsum(~letter)
    repeated = bool((same[1:] & same[:-1]).any() or (word[doubled[2:]] == word[doubled[:-2]]).any())
    if (mark[:-1] & letter[1:]).any() or (letter[:-1] & mark[1:]).any():
        return True, repeated
    single = letter | mark
    edge = ~single
    alone = single.copy()
    alone[1:] &= edge[:-1]
    alone[:-1] &= edge[1:]
    # Four singles, each at most four characters of gap from the one before.
    at = np.flatnonzero(alone)
    return bool((at[3:] - at[:-3] <= 15).any()), repeated


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Character trigrams of all texts, counted in tasks and summed by Spark: at most SIZE**3 rows reach the driver."""
    small_batches(docs.sparkSession)

    def count(batches):
        # One count for each batch of texts, joined by a non-letter, costs one pass.
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 64):
                text = "  ".join(["", *[t or "" for t in batch["t"][at : at + 64]], ""]).lower()
                c = _codes(text)
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"code": found, "n": total[found]})

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInPandas(count, "code long, n long")
    total = np.zeros(SIZE**3, dtype=np.int64)
    for code, n in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():
        total[code] = n
    return total.reshape(SIZE, SIZE, SIZE)


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of the third letter after the first two, smoothed by the letter's own share."""
    share = (counts.sum(axis=(0, 1)) + 1.0) / (counts.sum() + SIZE)
    pairs = counts.sum(axis=2, keepdims=True)
    return -np.log((counts + 5.0 * share) / (pairs + 5.0)).astype(np.float32)


def decode_span(span: str, costs: np.ndarray) -> str:
    """The likeliest reading of a suspicious span (lower case): a Viterbi search over its lattice.

    A state is the last two letters; each character may stand for itself, for a look-alike's letter,
    for nothing if it repeats the letter before, or, if it is a gap between letters set apart, for nothing.
    Of equal costs the reading offered first stays. Readings are chains of letters, so a long span costs
    time in proportion to its length.
    """
    spaced = any(c in GAPS for c in span)
    number = {c: i for i, c in enumerate(LETTERS)}
    runs = [any(span[max(0, k) : k + 3] == c * 3 for k in (i - 2, i - 1, i)) for i, c in enumerate(span)]
    # (state) -> (cost, chain of letters, last first)
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i, c in enumerate(span):
        choices: list[tuple[float, str]] = []
        if c.isalpha():
            choices.append((0.0, c))
        elif c in LOOK_ALIKES:
            choices += [(LOOK_ALIKE_COST, x) for x in LOOK_ALIKES[c]]
            choices.append((KEEP_SYMBOL_COST, c))
        else:
            choices.append((KEEP_SYMBOL_COST if spaced else 0.0, c))
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def offer(state, cost, chain, after=after):
            if state not in after or cost < after[state][0]:
                after[state] = (cost, chain)

        for (a, b), (cost, chain) in best.items():
            for extra, letter in choices:
                if letter.isalpha():
                    n = number.get(letter, OTHER)
                    offer((b, n), cost + extra + float(costs[a, b, n]), (letter, chain))
                    if chain and chain[0] == letter:
                        offer((a, b), cost + extra + (REPEAT_COST if runs[i] else REPEAT_COST + DOUBLE_COST), chain)
                else:
                    offer((b, 0), cost + extra + float(costs[a, b, 0]), (letter, chain))
            if i and c in GAPS:
                offer((a, b), cost + GAP_COST, chain)
        best = after
    _, chain = min(((cost + float(costs[a, b, 0]), chain) for (a, b), (cost, chain) in best.items()), key=lambda x: x[0])
    letters = []
    while chain:
        letters.append(chain[0])
        chain = chain[1]
    return "".join(reversed(letters))


@dataclass
class Model:
    costs: np.ndarray
    evidence: dict[str, float]
    prior: float = 0.02
    _spans: dict[str, str] = field(default_factory=dict)
    _words: dict[str, float] = field(default_factory=dict)

    def restore(self, text: str) -> str:
        """``text`` in lower case with suspicious spans read anew."""
        text = text.lower()
        odd, repeated = oddities(text)
        if odd:
            text = _SUSPECT.sub(lambda m: self._read(m.group()), text)
        if repeated:
            text = _REPEATED.sub(lambda m: self._read(m.group()), text)
        return text

    def words(self, text: str | None) -> set[str]:
        """Distinct words of ``text`` as it stands and as restored: a misread symbol hides no plain word."""
        plain = (text or "").lower()
        restored = self.restore(plain)
        found = set(_WORDS.findall(plain))
        return found if restored == plain else found | set(_WORDS.findall(restored))

    def _read(self, span: str) -> str:
        if not any(map(str.isalpha, span)):
            return span
        if len(self._spans) > 20_000:
            self._spans.clear()
        if span not in self._spans:
            self._spans[span] = decode_span(span, self.costs)
        return self._spans[span]

    def _weigh(self, word: str) -> float:
        if len(self._words) > 100_000:
            self._words.clear()
        found = max((self.evidence.get(f, 0.0) for f in features(word)), default=0.0)
        self._words[word] = found
        return found

    def score(self, text: str | None) -> float:
        """1 - (1 - prior) * product over distinct words of (1 - their evidence)."""
        clean, known = 1.0 - self.prior, self._words.get
        for word in self.words(text):
            weight = known(word)
            if weight is None:
                weight = self._weigh(word)
            if weight:
                clean *= 1.0 - weight
        return 1.0 - clean


def features(word: str) -> list[str]:
    """The word itself and its beginnings; the mark keeps both apart."""
    return [f"{word}$", *[word[:n] for n in range(3, min(9, len(word) + 1))]]


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_per_class: int = 4000, min_docs: int = 6, min_odds: float = 0.985, max_features: int = 20_000, per_document: int = 256,
    explanations: int = 3, min_gain: int = 3,
) -> Model:
    """Model from all texts (characters) and a bounded sample of labelled rows (evidence).

    At most ``max_per_class`` rows of each label, by hash, whose id is not held out; equal texts
    count once. A feature can be evidence if it stands in ``min_docs`` toxic documents of the sample and
    its smoothed share of toxic documents is ``min_odds`` or more. Of those, features are taken, down to
    ``min_gain`` documents, that explain most toxic documents not yet explained ``explanations`` times
    by different words, so that what copies of one document share by chance adds little. A document
    of the sample names its ``per_document`` most frequent features, which bounds what the driver gets. Without labels there is no evidence and every score is the prior.
    """
    costs = trigram_costs(trigram_counts(docs, text_col))
    blank = Model(costs, {})
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))
    picked = [usable.where(f"y = {y}").orderBy(F.xxhash64("id"), "id").limit(max_per_class) for y in (0, 1)]
    # At most 2 * max_per_class ids: small enough to send to every task.
    chosen = F.broadcast(picked[0].unionByName(picked[1]))

    def read(batches):
        for batch in batches:
            words = [sorted(blank.words(t)) for t in batch["t"]]
            yield pd.DataFrame({"y": batch["y"], "words": words})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(chosen, "id")
    sample = store(rows.dropDuplicates(["t", "y"]).select("y", "t").mapInPandas(read, "y int, words array<string>"))

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for y, words in zip(batch["y"], batch["words"], strict=True):
                seen[int(y)].update({f for w in words for f in features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"f": names, "clean": [seen[0][f] for f in names], "toxic": [seen[1][f] for f in names]})

    sizes = {int(y): n for y, n in sample.groupBy("y").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_toxic or not n_clean:
        return blank
    counted = sample.mapInPandas(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate_t, rate_c = (F.col("toxic") + 0.5) / (n_toxic + 1), (F.col("clean") + 0.05) / (n_clean + 1)
    odds = rate_t / (rate_t + rate_c)
    strong = counted.where(F.col("toxic") >= min_docs).withColumn("p", odds).where(F.col("p") >= min_odds)
    listed = strong.orderBy(F.desc("toxic"), F.desc(F.length("f")), "f").limit(max_features).collect()
    weight = {r.f: (min(r.p, 0.999), r.toxic) for r in listed}

    def explain(batches):
        for batch in batches:
            named = [{f for w in words for f in features(w)} & weight.keys() for words in batch["words"]]
            yield pd.DataFrame({"fs": [sorted(fs, key=lambda f: (-weight[f][1], f))[:per_document] for fs in named]})

    left = [set(r.fs) for r in sample.where("y = 1").mapInPandas(explain, "fs array<string>").collect()]
    evidence: dict[str, float] = {}
    wanted = [explanations] * len(left)
    while True:
        tally = Counter(f for doc, n in zip(left, wanted, strict=True) if n for f in doc)
        # Most documents first; of equals the longer beginning, which says more.
        f, n = max(tally.items(), key=lambda x: (x[1], not x[0].endswith("$"), len(x[0]), x[0]), default=("", 0))
        if n < min_gain:
            break
        evidence[f] = weight[f][0]
        stem = f.rstrip("$")
        # What begins alike is the same word, not another explanation.
        alike = {g for g in weight if g.rstrip("$").startswith(stem) or stem.startswith(g.rstrip("$"))}
        wanted = [n - (f in doc) if n else 0 for doc, n in zip(left, wanted, strict=True)]
        left = [doc - alike for doc in left]
    return Model(costs, evidence)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with ``score`` (double, 0 to 1); a column of that name is replaced.

    Null and empty texts get the prior. Repeated rows repeat, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    # Evidence is bounded by max_features and the costs by the alphabet.
    sent = docs.sparkSession.sparkContext.broadcast((model.costs, model.evidence, model.prior))
    schema = T.StructType([docs.schema[c] for c in keep]).add("score", T.DoubleType())

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            scores = [own.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*keep, "score"])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    return source.mapInArrow(run, schema)
