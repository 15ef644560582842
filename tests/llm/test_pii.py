"""Personal data against plain patterns in Python, discovery, redaction; and the pipeline."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from steadfast.llm import pii
from tests.llm import helpers

CASES = [
    "x..y@a..b", "..a@b.c-d@e.f", "a@b.c_d@e.f @x.y a@.b a@b. a.@b.c.", "a@b.k,d@e.f g@h.i@j.k", "a" + "@b" * 40 + ".c",
    "1.2.3.4.5.6.7.8.9", "999.1.1.1 1.1.1.256 01.002.3.4", "0000000001.2.3.4 9" * 3, "12345678901234567890123.1.1.1",
    "4111 1111 1111 1111 4111-1111--1111-1111", "4111111111111111 4222222222222 4111 1111 1111 1112",
    "12-34-56-78-90-12-34 4111 1111 1111 1111 1", "+1 (555) 555-5555. +49 30 123456 +1 +12345678901234567", "+1 234 567 890 at b@c.de",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 " * 20, "é+1 555 555 55 55 é a@b.co 😀 4111 1111 1111 1111", "\x01a@b.co \x014111\x01",
    "a." * 300 + "@b" + ".c" * 300, "a@b.cc " * 700, "+1 555 555 5555, " * 300, "7" * 3000, "+" + "1 " * 900,
]


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0
    return True


def brute(text):
    spans = [(m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(pii.PLAIN[kind], text or "") if passes(kind, m.group())]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_base_spans(spark):
    rows = [(1000 + i, t) for i, t in enumerate(CASES)]
    docs = helpers.documents(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    texts = {r[0]: r[1] for r in helpers.rows() + rows}
    got = pii.report(docs).collect()
    assert len(got) == len(rows) + len(helpers.rows())
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (texts[r.doc_id] or "")[:60]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in pii.KINDS]
        assert not want or set(want.split(",")) <= set(r.spans.split(","))
    assert pii.report(helpers.nothing(spark)).count() == 0


def test_contexts_discover(spark):
    seeds = [(i, f"Please call my number: +1 555 555 {1000 + i} today.") for i in range(30)]
    hidden = [(100, "please  call MY Number: 5550199, or see page 1234567."), (101, "my number: 12"), (102, "")]
    docs = spark.createDataFrame(seeds + hidden, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    start = hidden[0][1].index("5550199")
    assert spans[100] == f"phone:{start}:{start + 7}" and spans[101] == "" and spans[102] == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs.withColumn("spans", F.lit(1))).collect()}
    assert clean[100] == "please  call MY Number: [PHONE], or see page 1234567." and clean[3] == "Please call my number: [PHONE] today."


def luhn(body):
    return next(body + d for d in "0123456789" if passes("card", body + d))


def test_contexts_are_taken_from_the_whole_text(spark):
    seeds = [(i, f"Order 123, passport +1 555 555 {1000 + i}") for i in range(30)]
    # after an earlier match of their own kind, and behind spaces that a card can't have
    seeds += [(i, f"or +1 555 555 0000, fax +1 555 444 {1000 + i}") for i in range(30, 60)]
    seeds += [(i, f"charge the card {luhn(f'41110000000{1000 + i}')}") for i in range(60, 90)]
    texts = ["Order 123, passport 4567899", "or 0000, fax 7654321", "charge the card 99887766", "Order 124, passport 4567891"]
    docs = spark.createDataFrame(seeds + list(enumerate(texts, 100)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert spans[100] == "phone:20:27" and spans[101] == "phone:13:20" and spans[102] == "card:16:24" and spans[103] == ""


def test_contexts_in_long_lists(spark):
    text = " ".join(f"w{'o' * (i % 7)} é (no. {i}1234, <x{i}@y.zz>" for i in range(700))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.found_in(docs, ["doc_id"]).first()
    assert len(found.base) == 700 and len(found.unknown) == 700
    for span in [*found.base, *found.unknown]:
        assert text[span.start:span.end] == span.value and span.before == text[max(0, span.start - pii.REACH):span.start]


def test_redaction_keeps_rows_and_columns(spark):
    docs = helpers.documents(spark)
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert got.where("doc_id = 10").first().text == "mail [EMAIL] or [PHONE] at [IP], card [CARD]."
    assert got.where("doc_id is null").count() == 1


def test_pipeline_stages(spark, tmp_path):
    docs = helpers.documents(spark)
    spark.createDataFrame([(i, int(i != 9), 0) for i in range(13)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    here = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "personal_data", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, here, str(tmp_path))
        assert out.columns == docs.columns
        assert stage(spark, here.where("1 = 0"), str(tmp_path)).count() == 0
    language = corpus_pipeline.known_language(spark, here, str(tmp_path))
    assert {r.doc_id for r in language.where("doc_id is not null").collect()} == {3, 4, 5, 6, 7, 8, 10, 11, 12}
    kept = corpus_pipeline.no_near_duplicates(spark, language, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [3, 4, 8, 10, 11, 12] and len(kept) == 7
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_near_duplicates_keep_a_row_of_each_group(spark, tmp_path):
    a, b, c = (helpers.sentence(i, 60) for i in (21, 22, 23))
    # id 7: a copy of 1's text and two texts of its own; no id: copies, a near copy, a copy of 1's text
    rows = [(1, a), (7, a), (7, b), (7, helpers.sentence(24, 60)), (7, b), (8, b), (None, c), (None, c), (None, c + " more"), (None, a)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, lang string")
    kept = corpus_pipeline.no_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=str)
    one_of_c = [t for d, t in got if d == 0]
    assert len(one_of_c) == 1 and one_of_c[0] in (c, c + " more")
    assert [g for g in got if g[0]] == sorted([(1, a), (7, b), (7, rows[3][1])], key=str)


@pytest.mark.parametrize("text, spans, want", [
    ("abc 12 def", [(4, 6, 0)], "abc [EMAIL] def"),
    ("ab", [(0, 2, 1)], "[IP]"),
    ("0123456789", [(1, 5, 2), (3, 7, 3), (8, 9, 0)], "0[CARD]7[EMAIL]9"),
])
def test_redacted_text(spark, text, spans, want):
    df = spark.createDataFrame([(text, [(a, b, k, "", "") for a, b, k in spans])], f"text string, spans array<{pii.SPAN}>")
    assert df.select(pii.redacted_text(F.col("text"), F.col("spans"))).first()[0] == want


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Columns named like what the stages or the operators compute come through as they were."""
    names = ["_key_", "_score_", "_found_", "_spans_", "key", "score", "found", "doc", "spans", "base", "root", "pooled", "lang_pred", "first"]
    docs = helpers.documents(spark).select("*", *(F.lit(n).alias(n) for n in names))
    here = helpers.parquet(spark, tmp_path, "documents", docs)
    helpers.parquet(spark, tmp_path, "labels", here.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, here, str(tmp_path))
        assert out.columns == here.columns
        assert all(r[n] == n for r in out.collect() for n in names)
