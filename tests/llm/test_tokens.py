"""Byte-level BPE, packing and shards."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from steadfast.llm import bpe, packing, shards
from steadfast.llm.queries import MULTI_RANKS, RANKS
from steadfast.llm.tokens import encoder
from tests.llm import helpers


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t1'.😀 sд中。、２", max_size=300), st.integers(5, 60), st.integers(1, 20))
def test_chunks_give_the_ids_of_the_whole_text(text, chunk, overlap):
    spans = bpe.cuts(text, chunk, overlap)
    coded = [bpe.encode_chunk(text[a:b], a, MULTI_RANKS) for a, b in spans]
    ids = np.concatenate([*bpe.stitch((marks, ids) for ids, marks in coded), np.zeros(0, "<u4")])
    assert ids.tolist() == encoder(MULTI_RANKS).encode_ordinary(text)
    assert bpe.decode(ids, MULTI_RANKS) == text.encode()


@pytest.mark.parametrize("text", ["中文沒有空格，只有標點。第２章" * 400, "let a1=[b2,c3];f(x);don't" * 400, "за,что?" * 900])
def test_texts_without_blanks_are_cut(text):
    spans = bpe.cuts(text, 500, 20)
    assert len(spans) > 8 and max(b - a for a, b in spans) < 1_100
    coded = [bpe.encode_chunk(text[a:b], a, MULTI_RANKS) for a, b in spans]
    ids = np.concatenate([*bpe.stitch((marks, ids) for ids, marks in coded), np.zeros(0, "<u4")])
    assert ids.tolist() == encoder(MULTI_RANKS).encode_ordinary(text)


def test_one_run_of_letters_is_one_chunk():
    assert bpe.cuts("中" * 2_000, 500, 20) == [(0, 2_000)]


@pytest.mark.parametrize("chunk", [50, bpe.CHUNK])
def test_encode_documents(spark, chunk):
    got = bpe.encode(helpers.documents(spark), MULTI_RANKS, chunk=chunk, overlap=10, digests=True).collect()
    one, want = encoder(MULTI_RANKS), []
    for doc, text, *_ in helpers.rows():
        ids = one.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    assert bpe.encode(helpers.nothing(spark), MULTI_RANKS).count() == 0


def test_encode_returns_ids_and_bytes(spark):
    for r in bpe.encode(helpers.documents(spark).where("doc_id in (4, 11)"), MULTI_RANKS, chunk=1000).collect():
        text = helpers.rows()[r.doc_id][1]
        assert bytes(r.text_bytes) == text.encode()
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == encoder(MULTI_RANKS).encode_ordinary(text)


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 300), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    packed = packing.patterns(histogram, 64)
    held = Counter()
    for count, pack in packed:
        assert count > 0 and 0 < sum(pack) <= 64
        for length in pack:
            held[length] += count
    assert held == Counter({k: n for k, n in histogram.items() if n})
    # at most one sequence is half empty when there are short pieces enough to fill
    if set(k for k, n in histogram.items() if n) == {1}:
        assert sum(count for count, _ in packed) == -(-histogram[1] // 64)


def test_pack_documents(spark):
    got = packing.pack(helpers.documents(spark), RANKS, size=64, with_ids=True).collect()
    want = Counter()
    for doc, text, *_ in helpers.rows():
        ids = [*encoder(RANKS).encode_ordinary(text or ""), 0]
        for a in range(0, len(ids), 64):
            piece = np.array(ids[a:a + 64], "<u4").tobytes()
            want[doc, a, len(piece) // 4, zlib.crc32(piece), len(ids), piece] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in got) == want
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert len(by_sequence) <= sum(n for v in by_sequence.values() for _, n in v) // 64 + 8
    assert packing.pack(helpers.nothing(spark), RANKS).count() == 0


@pytest.mark.parametrize("domain", [1, 2, 3, 10, 1000, 4097])
def test_permutation_is_one(domain):
    moved = shards.Permutation(domain)
    assert sorted(map(moved, range(domain))) == list(range(domain))


def test_rows_of_one_id_spread_over_shards(spark, tmp_path):
    docs = spark.range(900).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, -5, id)) doc_id", "concat('text ', id) text")
    manifest = shards.write(docs, RANKS, f"{tmp_path}/hot", size=32)
    held = Counter((r.shard, r.doc_id) for r in shards.read(manifest).collect())
    assert sum(held.values()) == 900
    for doc in (None, -5):
        sizes = [n for (_, d), n in held.items() if d == doc]
        assert sum(sizes) == 300 and len(sizes) > 1
    again = shards.write(docs.repartition(7), RANKS, f"{tmp_path}/again", size=32)
    digests = lambda m: sorted((r.shard, r.sha256) for r in m.collect())
    assert digests(again) == digests(manifest)


def test_shards_round_trip(spark, tmp_path):
    docs = helpers.documents(spark)
    manifest = shards.write(docs, RANKS, f"{tmp_path}/a", size=32)
    got = sorted(shards.read(manifest, block=5).collect())
    assert [r.slot for r in got] == list(range(len(got)))
    want = Counter()
    for doc, text, *_ in helpers.rows():
        ids = np.array([*encoder(RANKS).encode_ordinary(text or ""), 0], "<u4")
        for a in range(0, len(ids), 32):
            want[doc, a, len(ids[a:a + 32]), zlib.crc32(ids[a:a + 32].tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want
    assert sorted(shards.read(manifest, from_slot=777).collect()) == got[777:]
    # the order depends on key and rows only, not on how they are dealt
    again = shards.write(docs.repartition(3), RANKS, f"{tmp_path}/b", size=32)
    key = lambda m: sorted((r.shard, r.sequences, r.sha256) for r in m.collect())
    assert key(manifest) == key(again)
    assert key(shards.write(docs, RANKS, f"{tmp_path}/c", size=32, key=1)) != key(manifest)
    assert shards.read(shards.write(helpers.nothing(spark), RANKS, f"{tmp_path}/d")).count() == 0


def test_added_tokens_are_cut_out_as_the_tokenizer_file_says(spark, tmp_path):
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"{end}{end} x", f"one  {end}  two\n\n{end}", f"a <|endof{end}text|> é{end}😀", "<|ENDOFTEXT|> <|endoftext |>", f"it's {end}'s"]
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert ids[0].tolist() == [64, 50256, 65, 0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, 0, len(v), zlib.crc32(v.tobytes()), len(v)) for i, v in enumerate(ids))
    assert sorted(tuple(r)[:5] for r in packing.pack(docs, RANKS).collect()) == want
    read = shards.read(shards.write(docs, RANKS, f"{tmp_path}/added")).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in read) == [w[:4] for w in want]
