import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hazegrid.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = bpe.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe._model(VOCABULARY)


def test_every_code_point_beside_letters_and_spaces(public, own):
    texts = [f"a{chr(c)}b1{chr(c)}{chr(c)} {chr(c)}x" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert [x.tolist() for x in own.encode(texts)] == [public.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aaabetho TH's're é\n\t  09€漢<|endoftext|>😀́"), max_size=60))
def test_random_texts(text):
    ids = bpe._model(VOCABULARY).encode([text])[0].tolist()
    assert ids == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids if text else ids == []
    assert bpe._model(VOCABULARY).decode(ids) == text


def test_rows_with_nulls_repeats_and_long_texts(make, public):
    texts = [None, "", "x" * 30000, "the end<|endoftext|>again", "aaaaaaaaa", "thanedble " * 5000, "don't  stop \n\n now", "don't  stop \n\n now"]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    df = bpe.digests(bpe.round_trip(make(rows), VOCABULARY))
    assert df.count() == len(rows)
    assert {"fp", "lang", "text"} <= set(df.columns)
    by = {r.text: r for r in df.collect()}
    for t in texts:
        want = public.encode(t or "", add_special_tokens=False).ids
        r = by[t]
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == (t or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(make([]), VOCABULARY).count() == 0


def test_cuts_are_inside_no_token(own):
    for text in ("thanedble", "qzxjv", "été"):
        raw = text.encode()
        import numpy as np

        start = own.cuts(np.frombuffer(raw, dtype=np.uint8))
        for i in range(1, len(raw)):
            assert start[i] == (not any(raw[i - 1 : i + 1] in t for t in own.tokens))
