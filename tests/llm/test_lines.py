import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.llm import linetree


def slow(rows, min_tokens=8, depth=4, similarity=0.8, ends=False):
    """The trees over distinct masked lines in order, without segments, components or Spark."""
    mask = lambda line: " ".join("<*>" if any(c.isdigit() for c in t) else t for t in line.split())
    seen = {}
    for i, text in rows:
        if i is None or text is None:
            continue
        for line in text.split("\n"):
            m = mask(line)
            if len(m.split(" ")) >= min_tokens:
                seen.setdefault(m, set()).add(i)
    first = {}
    for branch in [lambda t: t[:depth], lambda t: t[-depth:]][: 2 if ends else 1]:
        leaves = {}
        for m in seen:
            t = m.split(" ")
            leaves.setdefault((len(t), *branch(t)), []).append(m)
        for lines in leaves.values():
            if len({i for m in lines for i in seen[m]}) < 2:
                continue
            found = []  # [template, ids, lines]
            for m in sorted(lines, key=lambda x: x.encode()):
                t = m.split(" ")
                best = max(found, key=lambda f: sum(a == b for a, b in zip(f[0], t, strict=True)), default=None)
                if best and sum(a == b for a, b in zip(best[0], t, strict=True)) >= similarity * len(t) - 1e-9:
                    best[0] = [a if a == b else None for a, b in zip(best[0], t, strict=True)]
                    best[1] |= seen[m]
                    best[2].append(m)
                else:
                    found.append([t, set(seen[m]), [m]])
            for _, ids, members in found:
                if len(ids) > 1:
                    for m in members:
                        first[m] = min(first.get(m, min(ids)), min(ids))
    out = []
    for i, text in rows:
        keep = None if text is None else "\n".join(x for x in text.split("\n") if i is None or mask(x) not in first or i == first[mask(x)])
        out.append((str(i), keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("ends", [False, True])
def test_against_the_plain_tree(make, ends):
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    lines = [" ".join(rng.choice(words, n)) for n in rng.integers(3, 30, 25)]
    rows = []
    for d in range(40):
        own = []
        for at in rng.choice(len(lines), 4):
            t = lines[at].split()
            if rng.random() < 0.6:
                t[int(rng.integers(len(t)))] = f"item{d}" if rng.random() < 0.5 else "other" + words[d % 60]
            own.append(" ".join(t))
        own.append(" ".join(rng.choice(words, 12)))
        rows.append((d, "\n".join(own)))
    rows += [(50, None), (51, ""), (None, lines[0]), (3, rows[3][1]), (52, "  a\tb  c d e f g h 1\n" * 3), (53, "a b c d e f g h 2"), (54, "x " * 40000)]
    got = linetree.drop_recurring(make(rows), ends=ends)
    assert sorted([(str(r.doc_id), r.text) for r in got.collect()], key=str) == slow(rows, ends=ends)
    counted = {r.doc_id: (r.n_lines, r.n_dropped) for r in got.where("doc_id IN (50, 51, 53)").collect()}
    assert counted[50] == (0, 0) and counted[51] == (1, 0) and counted[53] == (1, 1)


def leaf_of(spark, lines, tail=False):
    """Distinct lines under the leaves that the operator gives them."""
    df = spark.createDataFrame([(i, m) for i, m in enumerate(lines)], "h long, m string").withColumn("tail", F.lit(tail))
    key = (linetree.tail_key if tail else linetree.leaf_key)(F.col("m"), linetree.tokens("m"), 4)
    return df.withColumn("leaf", key)


def groups(names):
    found = {}
    for i, t in names:
        found.setdefault(t, set()).add(i)
    return sorted(map(sorted, found.values()))


def test_parts_of_a_leaf_meet(spark):
    lines = [f"same start of line number {chr(97 + i % 26)}{chr(97 + i // 26)} and the rest of it" for i in range(200)]
    found = linetree.templates(leaf_of(spark, lines), part=30)
    assert found.count() == 200 and found.select("template").distinct().count() == 1


def test_long_passage_stays_once_and_clean_text_stays(make):
    passage = " ".join(f"word{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(60))
    rows = [(i, f"own text number {'abcdef'[i]} of this document which is quite alone {'qwerty'[i]}\n{passage}") for i in range(6)]
    got = {r.doc_id: r.text for r in linetree.drop_recurring(make(rows), depth=4, similarity=0.95).collect()}
    assert [passage in got[i] for i in range(6)] == [True] + [False] * 5
    assert all(got[i].startswith("own text") for i in range(6))
    assert linetree.drop_recurring(make([])).count() == 0


def test_short_boilerplate_goes_and_short_prose_stays(make):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        own = [" ".join(rng.choice(["yes", "no", "so", "oh", "well"], 2)) for _ in range(8)]  # common words meet by chance
        own += [f"{' '.join(f'q{c}{chr(97 + i % 26)}{chr(97 + i // 26)}' for c in 'abc')}", f"{i} {i + 1}"]
        own += ["All rights reserved."] if i % 2 else []
        own += [f"Page {i} of 60"] if i % 3 else []
        own += ["Seen only here"] if i < 9 else []
        rows.append((i, "\n".join(own)))
    got = {r.doc_id: r for r in linetree.drop_recurring(make(rows)).collect()}
    assert [i for i in got if "All rights reserved." in got[i].text] == [1]
    assert [i for i in got if "Page" in got[i].text] == [1]
    for i, text in rows:
        gone = (i % 2 == 1 and i > 1) + (i % 3 > 0 and i > 1)
        assert got[i].n_dropped == gone
        assert got[i].text == "\n".join(x for x in text.split("\n") if i == 1 or not x.startswith(("All", "Page")))


@pytest.mark.parametrize("tail, similarity, n", [(False, 0.8, 12), (True, 0.8, 12), (False, 0.8, 8), (False, 0.5, 9), (True, 0.6, 30)])
def test_mixed_templates_of_a_large_leaf_are_those_of_the_plain_tree(spark, tail, similarity, n):
    rng = np.random.default_rng(8)
    words = [f"v{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    lines = set()
    for _ in range(30):
        base = rng.choice(words, n)
        for _ in range(int(rng.integers(1, 12))):
            t = list(base)
            for at in rng.choice(n, int(rng.integers(0, 4)), replace=False):
                t[at] = str(rng.choice(words))
            t[-4 if tail else 0 : None if tail else 4] = ["the", "same", "four", "words"]
            lines.add(" ".join(t))
    lines = sorted(lines)
    made = []  # every line against every template, in order
    plain = []
    for m in lines:
        t = m.split(" ")
        same = [sum(a == b for a, b in zip(x, t, strict=True)) for x in made]
        at = same.index(max(same)) if same and max(same) >= similarity * n - 1e-9 else len(made)
        made[at : at + 1] = [[a if a == b else None for a, b in zip(made[at], t, strict=True)] if at < len(made) else t]
        plain.append(at)
    df = leaf_of(spark, lines, tail)
    assert df.select("leaf").distinct().count() == 1
    for part in (10, 10_000):
        got = linetree.templates(df, similarity, part=part).collect()
        assert groups((r.h, r.template) for r in got) == groups(enumerate(plain))


def test_a_leaf_of_unlike_lines_is_no_single_task(spark):
    """200,000 lines of one real leaf, half of them with a long beginning in common; two near ones in every thousand."""
    rng = np.random.default_rng(3)
    n = 200_000
    tail = rng.integers(0, 5000, (n, 16))
    lines = [" ".join(["the", "same", "four", "words", *(["and", "some", "more", "besides"] if i % 2 else []), *(f"t{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}{chr(97 + x // 676)}" for x in tail[i][4 * (i % 2) :])]) for i in range(n)]
    for i in range(0, n, 1000):
        lines[i + 1] = lines[i].rsplit(" ", 1)[0] + " edited"
    began = time.monotonic()
    df = leaf_of(spark, lines)
    got = linetree.templates(df)
    assert df.select("leaf").distinct().count() == 1 and got.count() == n
    pairs = got.groupBy("template").agg(F.collect_list("h").alias("h")).where("size(h) > 1").collect()
    assert sorted(sorted(r.h) for r in pairs) == [[i, i + 1] for i in range(0, n, 1000)]
    assert time.monotonic() - began < 240
    nodes = df.withColumn("node", F.xxhash64("leaf", "h"))
    assert linetree.near_lines(nodes, 0.8, 4).count() < n


def test_an_edit_at_either_end_hides_no_passage(make):
    passage = [f"word{chr(97 + i % 26)}" for i in range(20)]
    rows = [(i, " ".join(passage)) for i in (4, 5)]
    rows += [(i, " ".join([f"begin{chr(97 + i)}", *passage[1:]])) for i in (1, 2)]
    rows += [(3, " ".join([*passage[:-1], "end"])), (6, " ".join(["quite", "other", *passage[2:18], "last", "words"]))]
    rows += [(7, " ".join(passage[:4] + [f"own{c}" for c in "abcdefghijklmnop"]))]
    got = {r.doc_id: r.n_dropped for r in linetree.drop_recurring(make(rows), ends=True).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 1, 6: 0, 7: 0}
