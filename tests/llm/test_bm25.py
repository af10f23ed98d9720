import math
from collections import Counter

import numpy as np

from hazegrid.llm import bm25
from hazegrid.llm.common import store


def slow(rows, asked, k):
    docs = [(i, Counter(bm25.words(t)), len(bm25.words(t))) for i, t in rows if i is not None]
    n, mean = len(docs), max(1e-9, sum(d[2] for d in docs) / max(1, len(docs)))
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for q, text in asked:
        terms = sorted(set(bm25.words(text)))
        scores = []
        for i, c, size in docs:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in terms if w in c)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_against_brute_force(make):
    rng = np.random.default_rng(4)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 4000) if x < 500]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60))))) for i in range(400)]
    rows += [(1000, ""), (1001, None), (None, "w1 w2"), (5, rows[5][1]), (1002, rows[6][1].upper()), (1003, "é ü w1 " * 5000)]
    asked = [(i, t) for i, t in rows if i is not None and i % 20 == 0] + [(7000, "nothing known here"), (7001, "w1"), (7002, None)]
    index = store(bm25.build_index(make(rows), shard_docs=90))
    queries = make(asked).withColumnRenamed("doc_id", "query_id")
    for block_terms in (100_000, 60):
        got = sorted(map(tuple, bm25.search(index, queries, k=7, block_terms=block_terms).collect()))
        want = slow(rows, asked, 7)
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-6)


def test_empty_sides(make):
    index = store(bm25.build_index(make([(1, "a b"), (2, "a")])))
    nothing = make([]).withColumnRenamed("doc_id", "query_id")
    assert bm25.search(index, nothing).count() == 0
    assert bm25.search(store(bm25.build_index(make([]))), make([(1, "a")]).withColumnRenamed("doc_id", "query_id")).count() == 0


def test_a_shard_answers_a_block_of_queries_at_once():
    """Long and short lists, words no shard has, floors and none: as plain sums say, though long lists are added up roughly first."""
    rng = np.random.default_rng(8)
    n, n_terms, k = 700, 300, 5
    tf = rng.integers(1, 9, (n_terms, n)) * (rng.random((n_terms, n)) < rng.choice([0.005, 0.02, 0.1, 0.6], n_terms)[:, None])
    tf[:, 50] = tf[:, 40]  # equal documents
    term, doc = np.nonzero(tf)
    lens, ids = tf.sum(axis=0), rng.permutation(n) + 1000
    weights = rng.random(n_terms + 20) * 8
    numbers = np.where(np.arange(n_terms) % 7 == 0, -1, rng.permutation(n_terms))
    shard = bm25.Shard(ids, lens, (tf > 0).sum(axis=1), doc.astype(np.int32).tobytes(), tf[term, doc].astype(np.int32).tobytes(), 90.0, numbers, weights)
    asked = [rng.choice(n_terms + 20, int(rng.integers(0, 200)), replace=False) for _ in range(bm25.QUERIES + 30)]
    first = np.append(0, np.cumsum([len(x) for x in asked]))
    impact = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens / 90.0))
    plain = []
    for own in asked:
        sums = np.round(sum((weights[numbers[t]] * impact[t] for t in range(n_terms) if numbers[t] in own), np.zeros(n)), 6)
        best = sorted(zip(-sums, ids.tolist(), strict=True))[:k]
        plain.append([(i, -s) for s, i in best if s < 0])
    kth = np.array([p[2][1] if q % 2 and len(p) > 2 else 0.0 for q, p in enumerate(plain)])
    for floors, allowed in ((np.zeros(len(asked)), plain), (kth, [[x for x in p if x[1] >= f - 5e-7] for p, f in zip(plain, kth, strict=True)])):
        q, docs, scores = shard.top(first, np.concatenate(asked), floors, k)
        want = [(i, d, s) for i, p in enumerate(allowed) for d, s in p]
        assert list(zip(q.tolist(), docs.tolist(), strict=True)) == [x[:2] for x in want]
        assert np.allclose(scores, [x[2] for x in want], atol=2e-6)
