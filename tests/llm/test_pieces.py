import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from hazegrid.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pieces.read_model(PATH)
PUBLIC = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODES = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000]


@pytest.fixture(scope="module")
def own():
    return pieces.load(MODEL)


def same(own, texts):
    want = PUBLIC.encode(texts, add_bos=True, add_eos=True)
    assert [x.tolist() for x in own.encode(texts)] == want
    assert [own.decode(x) for x in want] == PUBLIC.decode(want)


def test_every_code_point_alone_and_repeated(own):
    same(own, [f"a{chr(c)}b1{chr(c)}{chr(c)} {chr(c)}x" for c in CODES])
    same(own, [chr(c) * k for c in CODES for k in (3, 5, 17)])


def test_runs_of_spaces(own):
    same(own, [" " * k + s for k in range(70) for s in ("", "a", "the", " x  ", "▁", "\n")])


def test_pieces_put_together_at_random(own):
    rnd = random.Random(1)
    some = [PUBLIC.id_to_piece(i) for i in range(259, 32000)]
    same(own, ["".join(rnd.choice(some)[: rnd.randint(1, 5)] for _ in range(rnd.randint(1, 12))) for _ in range(4000)])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aaabetho TH'sre é\n\t  09€漢<s>😀́▁--=="), max_size=60))
def test_random_texts(text):
    same(pieces.load(MODEL), [text])


def test_long_words_equal_the_public_ids(own):
    rnd = random.Random(2)
    same(own, ["x" * 30000, " " * 30000 + "b", "-" * 20000, "ha" * 9000, "漢" * 5000, "".join(rnd.choice("abcdef") for _ in range(20000))])


def test_decoding_of_any_ids(own):
    rnd = random.Random(3)
    for _ in range(3000):
        ids = [rnd.randrange(rnd.choice((300, 32000))) for _ in range(rnd.randint(0, 8))]
        assert own.decode(ids) == PUBLIC.decode(ids), ids


def test_equal_pairs_of_a_word_wait_where_a_new_pair_goes_first(own):
    """Merging all hits of a word at once would differ: some word needs more rounds than distinct ranks."""
    text = "thethethandandthereare" * 20
    symbol, places = own.merge(own.symbol_of[own.letter_of[[ord(c) for c in text]]], own._cuts(*heads(own, text)))
    assert ["".join(text[a:b]) for a, b in zip(places, [*places[1:], len(text)], strict=True)] == [
        PUBLIC.id_to_piece(i) for i in symbol.tolist()
    ]


def heads(own, text):
    import numpy as np

    code = np.array([ord(c) for c in text], dtype=np.uint32)
    head = np.zeros(len(code), dtype=bool)
    head[0] = True
    return code, own.letter_of[code], head


def test_rows_with_nulls_repeats_and_clashing_names(make):
    texts = [None, "", "x" * 30000, "<s>the end</s>", "thanedble " * 5000, "don't  stop", "don't  stop"]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    docs = make(rows).withColumnRenamed("fp", "ids").withColumnRenamed("t", "decoded").withColumnRenamed("lang", "n_tokens")
    got = pieces.round_trip(docs, MODEL, add=tuple(pieces.ADDED)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = PUBLIC.encode(r.text or "", add_bos=True, add_eos=True)
        back = PUBLIC.decode(want)
        assert (r.ids, r.decoded, r.n_tokens) == (want, back, len(want))
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert pieces.round_trip(make([]), MODEL).count() == 0


def test_other_kinds_of_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(MODEL)
    spec.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pieces.PieceBPE(spec.SerializeToString())
