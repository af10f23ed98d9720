import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from hazegrid.llm import toxicity

BAD = ["idiot", "loser", "worthless", "stupid"]
PLAIN = "the cat sat on a mat and there was no other thing to be seen at this hour of day while rain fell".split()


def corpus(n=300):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(PLAIN, 30))
        if i % 5 == 0:
            w[7] = BAD[i // 5 % 4]
        rows.append((i, " ".join(w)))
        labels.append((i, 1 if i % 5 == 0 else 0))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))


@pytest.mark.parametrize(
    ("seen", "meant"), [("1d10t", "idiot"), ("l0ser", "loser"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("looooser", "loser"), ("$tup1d", "stupid")]
)
def test_disguises_are_read(model, seen, meant):
    assert model.restore(f"you {seen} there").split()[1] == meant
    assert model.score(f"the cat sat {seen} on a mat") > 0.5


def test_plain_text_is_left_alone(model):
    for text in ["the cat sat on a mat!!", "see 3 mats, 10 cats and B2 at 5pm", "a i o"]:
        assert model.score(text) < 0.5
    assert model.restore("Nothing odd Here, at all.") == "nothing odd here, at all."


def test_viterbi_against_all_paths(model):
    """Every reading of a short span, priced alone."""

    def price(letters, extra):
        number = {c: i for i, c in enumerate(toxicity.LETTERS)}
        a = b = 0
        cost = extra
        for c in [*letters, " "]:
            n = number.get(c, 0) if c != " " else 0
            cost += float(model.costs[a, b, n])
            a, b = b, n
        return cost

    for span in ("l0s3r", "1d10t", "m4t", "c4+"):
        options = []
        for c in span:
            options.append([(x, toxicity.LOOK_ALIKE_COST) for x in toxicity.LOOK_ALIKES[c]] + [(c, toxicity.KEEP_SYMBOL_COST)] if c in toxicity.LOOK_ALIKES else [(c, 0.0)])
        best = min((price([x for x, _ in path], sum(e for _, e in path)), "".join(x for x, _ in path)) for path in itertools.product(*options))
        assert toxicity.decode_span(span, model.costs) == best[1]


def test_held_out_rows_and_odd_rows(model, make):
    rows, labels = corpus()
    docs = make([*rows, (9000, None), (9001, ""), (None, "you idiot"), (0, rows[0][1]), (9002, "word " * 40000 + "1diot")])
    got = toxicity.score(docs, model)
    assert got.count() == len(rows) + 5 and set(docs.columns) == set(got.columns)
    by = {r.doc_id: r.score for r in got.collect()}
    assert all((by[i] >= 0.5) == bool(y) for i, y in labels)
    assert by[9000] == by[9001] == pytest.approx(0.02) and by[None] > 0.5 and by[9002] > 0.5
    assert toxicity.score(make([]), model).count() == 0


def test_without_labels_every_score_is_the_prior(make, spark):
    docs = make([(1, "you idiot"), (2, None)])
    blank = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert [r.score for r in toxicity.score(docs, blank).collect()] == pytest.approx([0.02, 0.02])
    assert toxicity.trigram_counts(make([])).sum() == 0


@pytest.mark.parametrize(
    ("seen", "meant"),
    [
        ("idio+", "idiot"), ("worthles$", "worthless"), ("l0$er", "loser"), ("i d ! o t", "idiot"), ("i/d/i/o/t", "idiot"),
        ("i   d   i   o   t", "idiot"), ("$ t u p i d", "stupid"), ("iidiioott", "idiot"), ("$+up!d", "stupid"), ("1 0 $ 3 r", "loser"),
    ],
)
def test_ends_gaps_and_doubles_reach_the_lattice(model, seen, meant):
    assert meant in model.words(f"you {seen} there")
    assert model.score(f"the cat sat {seen} on a mat") > 0.5


def test_a_misread_symbol_hides_no_plain_word(model):
    assert {"mat", "idiot"} <= model.words("a mat!! IDIOT! +")
    assert model.score("an idiot! on a mat!!") > 0.5 > model.score("1 2 3 4 5 | a+ b! c| see 5pm, mp3!")


def slow_reading(span, costs):
    """Cheapest reading by trying every choice at every character: letters, look-alikes, gaps and repeats."""
    number = {c: i for i, c in enumerate(toxicity.LETTERS)}
    gaps = any(c in toxicity.GAPS for c in span)

    def go(i, a, b, last, cost, text):
        if i == len(span):
            yield cost + float(costs[a, b, 0]), text
            return
        c = span[i]
        if c.isalpha():
            options = [(0.0, c)]
        elif c in toxicity.LOOK_ALIKES:
            options = [(toxicity.LOOK_ALIKE_COST, x) for x in toxicity.LOOK_ALIKES[c]] + [(toxicity.KEEP_SYMBOL_COST, c)]
        else:
            options = [(toxicity.KEEP_SYMBOL_COST if gaps else 0.0, c)]
        three = any(span[max(0, k) : k + 3] == c * 3 for k in (i - 2, i - 1, i))
        for extra, x in options:
            n = number.get(x, toxicity.OTHER) if x.isalpha() else 0
            yield from go(i + 1, b, n, x, cost + extra + float(costs[a, b, n]), text + x)
            if x.isalpha() and last == x:
                again = toxicity.REPEAT_COST + (0.0 if three else toxicity.DOUBLE_COST)
                yield from go(i + 1, a, b, last, cost + extra + again, text)
        if i and c in toxicity.GAPS:
            yield from go(i + 1, a, b, last, cost + toxicity.GAP_COST, text)

    return min(go(0, 0, 0, "", 0.0, ""))[1]


@pytest.mark.parametrize("span", ["l.0.s.3", "i d ! o", "mmaatt", "loooser", "c4+", "a $ $", "s  e e", "ii1dd"])
def test_viterbi_with_gaps_and_repeats_against_all_paths(model, span):
    assert toxicity.decode_span(span, model.costs) == slow_reading(span, model.costs)


def test_a_long_span_is_read_whole(model):
    assert len(model.words("a " * 30000 + "1d10t")) >= 2 and model.score("1 " * 30000 + "1d10t") > 0.5


def test_evidence_against_plain_counts(model):
    rows, labels = corpus()
    y = dict(labels)
    used = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    seen = {1: Counter(), 0: Counter()}
    texts = {(t, y[i]) for i, t in used}
    for t, label in texts:
        seen[label].update({f for w in model.words(t) for f in toxicity.features(w)})
    size = Counter(label for _, label in texts)
    for f, weight in model.evidence.items():
        toxic, clean = (seen[1][f] + 0.5) / (size[1] + 1), (seen[0][f] + 0.05) / (size[0] + 1)
        assert seen[1][f] >= 6 and weight == pytest.approx(min(0.999, toxic / (toxic + clean)))
