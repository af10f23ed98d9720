import hashlib
import math

import pytest

from hazegrid.llm import mixing

ROWS = [(i, " ".join(["w"] * (1 + i % 7)), "big" if i % 3 else f"small{i % 4}") for i in range(300)]


def key(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def slow(rows, limit=2.0, block_tokens=100, budget=None):
    """Copies of every document: whole passes, then blocks in the order of the last pass until the budget is met."""
    by = {}
    for i, text, s in rows:
        by.setdefault(s or "", []).append(("" if i is None else str(i), len((text or "").split())))
    total = {s: sum(n for _, n in d) for s, d in by.items()}
    live = {s: n for s, n in total.items() if n}
    a = mixing.bisect_exponent(live, limit)
    w = mixing.weights(live, a)
    whole = budget or max(live[s] / w[s] for s in live)
    copies = {}
    for s, d in by.items():
        own = math.floor(whole * w[s] + 1e-6) if total[s] else 0
        passes, rest = divmod(own, total[s]) if total[s] else (1, 0)
        blocks = max(1, math.ceil(total[s] / block_tokens))
        order = sorted((key("mix/pass", s, passes, int(key("mix/block", s, i)[:15], 16) % blocks), key("mix/doc", s, passes, i), i, n) for i, n in d)
        so_far = 0
        for _, _, i, n in order:
            more = 1 if so_far < rest else 0
            so_far += n
            copies[s, i] = passes + more
    return copies


@pytest.mark.parametrize("limit", [1.0, 1.5, 3.0])
def test_copies_against_brute_force(make, limit):
    got = mixing.mix(make(ROWS), max_repetition=limit, block_tokens=100)
    seen = {}
    for r in got.groupBy("source", "doc_id").count().collect():
        seen[r.source, str(r.doc_id)] = r["count"]
    assert seen == {k: n for k, n in slow(ROWS, limit).items() if n}
    assert len(seen) == len(ROWS)  # nothing is lost


def test_weights_meet_the_target(make):
    got = mixing.mix(make(ROWS), max_repetition=2.0, block_tokens=50)
    tokens = {r.source: r.n for r in got.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    total = {}
    for _, t, s in ROWS:
        total[s] = total.get(s, 0) + len(t.split())
    w = mixing.weights(total, mixing.bisect_exponent(total, 2.0))
    assert all(abs(tokens[s] - max(total[x] / w[x] for x in w) * w[s]) <= 7 for s in w)
    h = mixing.bisect_exponent(total, None, target_entropy=1.2)
    assert mixing.entropy(mixing.weights(total, h)) == pytest.approx(1.2, abs=1e-6)


def test_budget_below_one_pass(make):
    got = mixing.mix(make(ROWS), budget=200, block_tokens=40)
    seen = {(r.source, str(r.doc_id)) for r in got.collect()}
    assert seen == {k for k, n in slow(ROWS, 2.0, 40, 200).items() if n}


def test_odd_rows(make):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (None, "z z z", "b"), (None, "z z z", "b"), (4, " pad \n", "b"), (5, "w " * 50000, "c")]
    got = mixing.mix(make(rows)).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, None}
    assert {r.doc_id: r.n_tokens for r in got}[4] == 1 and {r.doc_id: r.n_tokens for r in got}[5] == 50000
    assert mixing.mix(make([])).count() == 0
    assert mixing.mix(make([(1, None, "a")])).count() == 1
