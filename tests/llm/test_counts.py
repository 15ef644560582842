"""Token counts of chunked texts against the library on whole texts."""

import random
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from steadfast.llm import counts
from tests.llm import helpers

WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Everything that a cut could fall into: white space, contractions, marks, jamo, added tokens, letters that grow.
BITS = ["a", "bc", " ", "\n", "　", "'", "'re", "'LL", "́", "é", "é", "한", "日本", "1", "23", "!", "<|endoftext|>", "<|startof", "text|>", "İ", "ß", "😀", "ཱི", "ﬁ", "-"]


def whole(text):
    return len(counts.tokenizer(WORDS).encode(text, add_special_tokens=False))


def pieced(text, chunk, overlap):
    pieces = []
    for a, b in counts.cuts(len(text), chunk, overlap):
        n, places, before = counts.encode_piece(text[a:b], a, WORDS)
        places, before = counts._near_edges(text[a:b], a, places, before, overlap)
        pieces.append(counts.Piece(a, text[a:b], n, places, before))
    return counts.splice(iter(pieces), WORDS), len(pieces)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=250), st.integers(60, 120), st.integers(counts.MARGIN + 1, 50))
def test_pieces_count_as_the_whole(bits, chunk, overlap):
    text = "".join(bits)
    assert pieced(text, chunk, overlap)[0] == whole(text)


@pytest.mark.parametrize("text", ["a" * 2_000, "日本語" * 700, "'" * 1_500 + "re", "e" + "́" * 1_500, "ཱི" * 600, "1" * 999, "<|endoftext|>" * 200, " " * 1_000 + "x"])
def test_overlaps_are_widened_where_nothing_is_shared(text):
    got, n = pieced(text, 100, 40)
    assert n > 5 and got == whole(text)


def test_spans_cover_the_text():
    for length in (0, 1, 99, 100, 139, 140, 141, 1000):
        spans = counts.cuts(length, 100, 40)
        assert spans[0][0] == 0 and spans[-1][1] == length
        assert all(b - c == 40 for (_, b), (c, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("chunk", [60, 5_000, counts.CHUNK])
def test_count_documents(spark, chunk):
    got = counts.count(helpers.documents(spark), WORDS, limit=50, chunk=chunk, overlap=50)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter()
    for doc, text, *_ in helpers.rows():
        n = whole(text or "")
        want[doc, len((text or "").encode()), n, n > 50] += 1
    assert Counter(map(tuple, got.collect())) == want
    assert counts.count(helpers.nothing(spark), WORDS).count() == 0


def test_long_texts_without_blanks(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS[3:] + ["x"]) for _ in range(9_000)).replace(" ", "_"), "z" * 50_000, "语" * 40_000 + "。" + "言" * 40_000]
    got = counts.count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORDS, chunk=4_000, overlap=100)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: whole(t) for i, t in enumerate(texts)}
