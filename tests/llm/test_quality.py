import math
import re
from collections import Counter

import numpy as np

from hazegrid.llm import knn_quality, quality_rules

PROSE = "the quick brown fox jumps over lazy dogs while some other animals watch from afar and wonder why this must always happen here today"
ROWS = [
    (1, " ".join(f"{w}{i % 7}" if i % 5 == 0 else w for i, w in enumerate(PROSE.split() * 3))),
    (2, " ".join(PROSE.split()[::-1]) + ". " + PROSE + ".\nAnother line, of its own kind, that says what no other line says at all; it ends well.\n" * 1),
    (3, "##$ & " * 40),
    (4, None),
    (5, ""),
    (6, "one two three\none two three\n\none two three\n \n"),
    (7, "same same same same " * 2000),
    (8, " \t\x0b pad  a a a a\r\n"),
    (None, PROSE),
    (2, "é ü ß x 漢 字 " * 30),
]


def slow(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    hit = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_against_brute_force(make):
    got = quality_rules.judge(make(ROWS)).collect()
    have = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == sorted((str(i), *slow(t)) for i, t in ROWS)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert 0 <= r.p_clean <= 1 and not (r.kept and r.base_failed)
    assert quality_rules.judge(make([])).count() == 0


def test_em_against_plain_python(spark):
    rng = np.random.default_rng(1)
    names = ["v_a", "v_b", "v_c"]
    clean = rng.random(3000) < 0.8
    right = np.array([[0.95, 0.9, 0.85], [0.7, 0.6, 0.8]])
    rows = []
    for y in clean:
        v = [0 if rng.random() < 0.2 else (1 if (rng.random() < right[0][j]) else -1) if y else (-1 if rng.random() < right[1][j] else 1) for j in range(3)]
        rows.append(v)
    df = spark.createDataFrame([tuple(map(int, r)) for r in rows], "v_a int, v_b int, v_c int")
    got = quality_rules.estimate(df, names, rounds=15, tolerance=0.0)
    prior, c, j = quality_rules.PRIOR, [quality_rules.RIGHT_CLEAN] * 3, [quality_rules.RIGHT_JUNK] * 3
    w = quality_rules.WEIGHT
    x = np.array(rows)
    for _ in range(15):
        odds = np.full(len(x), math.log(prior / (1 - prior)))
        for k in range(3):
            odds += np.where(x[:, k] > 0, math.log(c[k] / (1 - j[k])), np.where(x[:, k] < 0, math.log((1 - c[k]) / j[k]), 0))
        p = 1 / (1 + np.exp(-odds))
        prior = (p.sum() + w * quality_rules.PRIOR) / (len(x) + w)
        up, down = x > 0, x < 0
        c = [((p * up[:, k]).sum() + w * quality_rules.RIGHT_CLEAN) / ((p * (up | down)[:, k]).sum() + w) for k in range(3)]
        j = [(((1 - p) * down[:, k]).sum() + w * quality_rules.RIGHT_JUNK) / (((1 - p) * (up | down)[:, k]).sum() + w) for k in range(3)]
    assert np.allclose([got[0], *got[1].values(), *got[2].values()], [prior, *c, *j])


def labelled(n=240):
    rng = np.random.default_rng(9)
    words = PROSE.split()
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, 80))
        bad = i % 4 == 0
        text = " ".join(x.upper() + "!!" for x in w) if bad and i % 8 else " ".join(f"{x}###" for x in w) if bad else " ".join(w).capitalize() + "."
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_neighbours_vote_as_brute_force_says(make, spark):
    rows, labels = labelled()
    docs = make([*rows, (9000, None), (9001, ""), (None, "x y z"), (3, rows[3][1]), (9002, "WORD!! " * 30000)])
    model = knn_quality.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"), k=7)
    got = {r.doc_id: r.score for r in knn_quality.score(docs, model).collect()}
    assert got[9000] == got[9001] == 0.5 and got[9002] < 0.3
    assert all((got[i] >= 0.3) == bool(y) for i, y in labels)
    for i, text in rows[:40]:
        own = model.place(knn_quality.terms(text)[None, :])[0]
        near = [max(0.0, float(own @ v)) for v in model.vectors]
        edge = sorted(near)[-7]
        top = [(s, y) for s, y in zip(near, model.labels, strict=True) if s >= edge - 1e-6]
        assert abs(got[i] - sum(s**8 * y for s, y in top) / sum(s**8 for s, _ in top)) < 0.02
    none = knn_quality.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r.score for r in knn_quality.score(docs, none).collect()} == {0.5}
    assert knn_quality.score(make([]), model).count() == 0
