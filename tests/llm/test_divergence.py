import random
from collections import Counter, defaultdict

import pytest

from hazegrid.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, p bigint, value string, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "x", 1, "y", 2) for i, (t, lang, source) in enumerate(rows)], SCHEMA)


def plain(rows, min_docs, top):
    """The contract by loops over exact integers."""
    import re

    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    count, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang].add(source)
        count[lang, source].update(found)
        held[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        v = len(kept)
        total = Counter()
        for s in sources:
            total.update({t: count[lang, s][t] for t in kept})

        def share(c, t, n, v=v):
            return 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * v)

        p = {s: {t: share(count[lang, s], t, sum(count[lang, s][t] for t in kept)) for t in kept} for s in sources}
        q = {t: share(total, t, sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            far = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -x, r) for r, (x, o) in enumerate(far, 1)]
            own = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -x, r) for r, (x, t) in enumerate(own[:top], 1)]
    return sorted(out)


def made():
    rnd = random.Random(5)
    rows = [(None, None, None), ("", "en", "quiet"), ("Ünique wörd", "de", "lone"), ("only-two only", "xx", "a"), ("other", "xx", "b")]
    for _ in range(700):
        lang, source = rnd.choice(["en", "en", "fr", None]), rnd.choice(["big"] * 4 + [f"s{k}" for k in range(12)])
        bias = hash_of(source)
        words = [f"W{chr(97 + (rnd.randrange(26) * (1 + bias % 3)) % 26)}{chr(97 + rnd.randrange(9))}" for _ in range(rnd.randrange(40))]
        rows.append((" ".join(words) + "é3ß", lang, source))
    return rows + rows[:20]


def hash_of(s):
    return sum(map(ord, s))


@pytest.mark.parametrize("group_block, term_block", [(16, 4096), (3, 20), (1, 1000)])
def test_rows_equal_plain_loops_for_any_blocks(spark, group_block, term_block):
    rows = made()
    got = divergence.audit(frame(spark, rows), min_docs=4, top=5, group_block=group_block, term_block=term_block).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 4, 5)


def test_ties_go_to_the_item_first_in_utf8(spark):
    rows = [("aa bb", "en", s) for s in ("z", "é", "Z", "a")] * 3
    got = divergence.audit(frame(spark, rows), min_docs=2).where("part = 'pair' AND source = 'a'").orderBy("rank").collect()
    assert [r.item for r in got] == ["Z", "z", "é"] and {r.value for r in got} == {0}


def test_counts_beyond_a_long_when_multiplied(spark):
    got = spark.range(1).select(divergence._share("cast(9200000000000 as bigint)", "cast(9300000000000 as bigint)", "cast(5 as bigint)").alias("p")).first().p
    assert got == 1 + 1_000_000_000 * 9_200_000_000_002 // (9_300_000_000_010)


def test_tasks_hand_their_counts_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GATHERED", 3)
    rows = [("one two three four five", "en", "a"), ("one", "en", "b"), ("", "en", "c")] * 4
    got = {tuple(r) for r in divergence.term_counts(frame(spark, rows)).where("term IS NOT NULL").collect()}
    assert ("en", "a", "one", 4, 4) in got and ("en", "b", "one", 4, 4) in got and len(got) == 6


def test_empty_table(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
