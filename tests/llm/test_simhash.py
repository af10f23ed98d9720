import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hazegrid.llm import simhash
from hazegrid.llm.common import components


def slow_fingerprint(text):
    words = (text or "").lower().split() if (text or "").isascii() else "".join(c.lower() if c.isascii() else c for c in text).split()
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, distance=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= distance) for i in range(len(rows))]
        if new == label:
            break
        label = new
    lowest = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            lowest[c] = min(i, lowest.get(c, i))
    return sorted((str(i), f"{f:016x}", str(lowest.get(c))) for (i, _), f, c in zip(rows, fps, label, strict=True))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_components_against_brute_force(make):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(6)]
    rows = [(i, b) for i, b in enumerate(base)]
    for n in range(40):
        text = base[n % 6].split()
        for at in rng.choice(len(text), n % 4, replace=False):
            text[at] = "changed"
        rows.append((100 + n, " ".join(text)))
    rows += [(900, ""), (901, None), (902, " \t\n"), (7, base[0]), (7, base[0]), (None, base[1]), (950, "one two"), (951, "ONE two"), (960, "Ünder ü"), (970, "long " * 50000)]
    assert got(simhash.near_components(make(rows))) == slow_components(rows)


def test_shared_fingerprints_of_hot_groups(spark):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 2**63))
    fps = {center} | {center ^ sum(1 << int(b) for b in rng.choice(63, 3, replace=False)) for _ in range(300)}
    fps |= {int(x) for x in rng.integers(0, 2**63, 50)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.near_links(df, cell=40)  # groups are cut into cells
    marked = {r.node: r.component for r in components(links).collect()}
    order = sorted(fps)
    label = {f: f for f in order}
    while True:
        new = {f: min(label[g] for g in order if (f ^ g).bit_count() <= 4) for f in order}
        if new == label:
            break
        label = new
    assert {f: marked.get(f, f) for f in order} == label


@pytest.mark.parametrize("seed", range(4))
def test_link_groups_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(30)], dtype=np.uint64))
    groups = np.sort(rng.integers(0, 4, len(fps)))
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4) & (groups[:, None] == groups[None, :])
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert (simhash.link_groups(fps, groups, 4) == label).all()


def test_one_of_each_and_empty(make):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (9, "quite another text of some words here"), (None, "a b c d e f"), (3, "a b c d e f")]
    assert sorted(r.doc_id for r in simhash.one_of_each(make(rows)).collect()) == [3, 3, 9]
    assert simhash.near_components(make([])).count() == 0
    assert set(simhash.one_of_each(make(rows)).columns) == set(make([]).columns)


def test_gray_rank_is_the_inverse_of_the_gray_code(spark):
    ranks = [0, 1, 2, 3, 77, 2**40 + 5, 2**62]
    df = spark.createDataFrame([(r, r ^ (r >> 1)) for r in ranks], "rank long, code long")
    back = df.select("rank", simhash.gray_rank(F.col("code")).bitwiseXOR(F.lit(-(1 << 63))).alias("g")).collect()
    assert all(r.rank == r.g for r in back)
