import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from hazegrid.llm import aligning, bpe, pieces

VOCABULARY = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
MODEL_PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pieces.read_model(MODEL_PATH)


def groups_of(a, b, a_width, b_width):
    """Walks both token rows and cuts where both end."""
    out, own, other, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            own.append(a[i])
            at_a += a_width[a[i]]
            i += 1
        else:
            other.append(b[j])
            at_b += b_width[b[j]]
            j += 1
        if at_a == at_b:
            out.append((own, other))
            own, other = [], []
    return out


def brute(texts):
    """Contract columns of each text by the public libraries and plain loops."""
    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    public.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    letters = bpe.byte_letters()
    a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in public.get_vocab().items()}
    spell = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    b_bytes = [spell(i) for i in range(model.get_piece_size())]
    docs, counts = [], Counter()
    for t in texts:
        a = public.encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        raw = (" " + (t or "")).encode()
        if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            a = b = []
        groups = groups_of(a, b, {i: len(x) for i, x in a_bytes.items()}, [len(x) for x in b_bytes])
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        counts.update(links.keys())
        docs.append((a, b, groups, links))
    top = Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(k for p, k in links.items() if counts[p] == top[p[0]])
        total = sum(k * counts[p] for p, k in links.items())
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), sum(links.values()), best, total, digest))
    return out


TEXTS = [
    None,
    "",
    " ",
    "the thing is the cat and the hat",
    "thanedble qualle réeux  achlich",
    "thanedble qualle réeux  achlich",
    "a<|endoftext|>b<s>c</s>",
    "mark ▁ inside",
    "漢字 😀😀😀 é\x00\n\t  x",
    "x" * 5000,
    "aZ9-" * 3000,
    "the " * 4000,
    "don't stop the music",
]


@pytest.mark.parametrize("broadcast_pairs", [1_000_000, 40])
def test_rows_equal_plain_loops(make, broadcast_pairs):
    docs = make([(i if i != 4 else None, t) for i, t in enumerate(TEXTS)]).withColumnRenamed("fp", "n_links").withColumnRenamed("t", "groups")
    aligned = aligning.align_documents(docs, VOCABULARY, MODEL, digest=True)
    got = aligning.weigh(aligned, broadcast_pairs).collect()
    row = lambda r: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
    key = lambda x: (x[0] or "", x[1])
    assert sorted(((r.text, row(r)) for r in got), key=key) == sorted(zip(TEXTS, brute(TEXTS), strict=True), key=key)


def test_groups_are_written_out(make):
    text = "the thing, thanedble"
    r = aligning.align_documents(make([(1, text)]), VOCABULARY, MODEL, keep=["doc_id"]).first()
    pair = aligning.Pair(VOCABULARY, MODEL)
    (a,), (b,) = pair.encode([text])
    groups = groups_of(a.tolist(), b.tolist(), pair.a_width, pair.b_width)
    assert r.groups.decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    assert sum(r.times) == r.n_links and r.n_groups == len(groups)


def test_large_groups_are_counted_by_distinct_ids():
    """One group of 9,000 A tokens and 4,001 B tokens: links are counted, not listed."""
    a, b = [np.array([0, 1, 2] * 3000)], [np.array([0] * 4000 + [1])]
    x = aligning.align(a, b, np.array([2, 2, 2]), np.array([3, 6000]))
    assert len(x.pair_a) < 20
    plain = Counter((p, q) for g in groups_of(a[0].tolist(), b[0].tolist(), [2, 2, 2], [3, 6000]) for p in g[0] for q in g[1])
    assert {(p, q): n for p, q, n in zip(x.pair_a.tolist(), x.pair_b.tolist(), x.times.tolist(), strict=True)} == plain


def test_empty_table(make):
    assert aligning.weigh(aligning.align_documents(make([]), VOCABULARY, MODEL)).count() == 0
