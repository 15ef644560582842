"""Text functions, defanging and features on inline rows."""

import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.functions import text as X
from steadfast.operators import features as FE
from steadfast.plans.release import defang_audit

NESTED = "http://hop.test/out?to=http://second-hop.test/form&lang=en"


def values(spark, items, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


CASES = [
    "token form: http://203.0.113.9/form", "two: https://one.test/a, then www.two.test/b.",
    f"hop over {NESTED} twice", "plain words", "",
]


def test_defang_leaves_nothing_live_and_restores(spark):
    safe = values(spark, CASES, X.defang)
    assert not any("http://" in s or "https://" in s for s in safe)
    assert values(spark, CASES, lambda t: X.refang(X.defang(t))) == CASES
    assert values(spark, [NESTED], X.defang)[0].count("hxxp://") == 2


def test_defang_audit_reports_what_is_lost(spark):
    texts = ["HTTP://a.b/c", "WWW.a.b", "already hxxp://a.b", "http://a.b?q=HTTP://c.d", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: (r["roundtrip_ok"], r["live_scheme_left"]) for r in defang_audit(df, "i").collect()}
    assert got == {0: (False, False), 1: (False, False), 2: (False, False), 3: (True, True), 4: (True, False)}


def test_whitespace_is_unicode(spark):
    assert values(spark, [" a  b\x1cc "], X.collapse_spaces) == ["a b c"]
    assert values(spark, ["　 x y \n"], X.strip) == ["x y"]
    assert values(spark, ["a b  c"], lambda t: F.size(X.words(t))) == [3]


def test_low_content(spark):
    texts = ["one two three four five", "a b c d e f g", "11 22 33 44 55", "ab cd ef gh", ""]
    assert values(spark, texts, lambda t: X.is_low_content(F.lit(""), t)) == [False, True, True, True, True]


def test_tags(spark):
    texts = ["mail <joe@x.org> now", "<b>x</b>", "1 < 2", "< A href=x>"]
    assert values(spark, texts, X.has_any_tag) == [True, True, False, False]
    assert values(spark, texts, X.has_listed_tag) == [False, False, False, True]


def test_handcrafted(spark):
    rows = [(0, "Click http://evil.com/login now!! URGENT suspended 123", True), (1, "hello there", False), (2, "", None), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, text string, had_html boolean")
    got = {r["id"]: r for r in FE.handcrafted_features(df, "id").collect()}
    assert got[0]["hc_url_count"] == 1 and got[0]["hc_had_html"] == 1 and got[0]["hc_exclaim_count"] == 2
    assert got[0]["hc_urgency_count"] == 3  # urgent, and suspended for both of its entries
    assert got[1]["hc_url_count"] == 0 and got[1]["hc_word_len"] == 2
    for i in (2, 3):
        assert all(got[i][c] == 0 for c in L.HANDCRAFTED)


def test_mail_year(spark):
    texts = [
        "Tue, 05 Aug 2008 16:31:02 -0700", "Wed, 31 Dec 2008 23:31:02 -0700 (PDT)", "nonsense", None,
        "2008-01-02 03:04:05", "1 Jan 2007 10:00 GMT",
    ]
    assert values(spark, texts, X.mail_year) == [2008, 2009, None, None, 2008, 2007]


def test_era(spark):
    ids = ["naz:phishing0.mbox:12", "naz:2019:3", "plain", "plain.mbox"]
    assert values(spark, ids, X.era_of) == ["legacy_mbox", "modern_year", "modern_year", "legacy_mbox"]


def tfidf_by_hand(docs, max_terms):
    def grams(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
        u = re.findall(r"\b\w\w+\b", t)
        return Counter(u + [f"{a} {b}" for a, b in zip(u, u[1:])])

    counts = {i: grams(t) for i, t in docs}
    total, df = Counter(), Counter()
    for c in counts.values():
        total.update(c)
        df.update(c.keys())
    vocab = sorted(sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:max_terms])
    out = {}
    for i, c in counts.items():
        w = {t: (1 + math.log(c[t])) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in vocab if t in c}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, vocab.index(t)): v / norm for t, v in w.items()})
    return out


def test_tfidf_matches_definition(spark):
    docs = [
        (0, "Café au lait, café noir naïve ﬁsh fish"), (1, "cafe noir cafe noir cafe"), (2, "fish and naive fish"),
        (3, "nothing shared zzz"), (4, ""), (5, "a b c"),
    ]
    df = spark.createDataFrame(docs, "id int, text string")
    counts = FE.term_counts(df, "id")
    vocab = FE.with_idf(FE.vocabulary(counts, 6), len(docs))
    got = {(r["id"], r["term_id"]): r["weight"] for r in FE.tfidf_long(df, vocab, "id").collect()}
    want = tfidf_by_hand(docs, 6)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_vocabulary_is_exact_whatever_the_sketch(spark):
    """Collisions, ties at the cut, thresholds that must be lowered, fewer terms than asked for."""
    import random

    rng = random.Random(9)
    docs = [(i, " ".join(f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(60))) for i in range(80)] + [(80, "solo " * 500)]
    df = spark.createDataFrame(docs, "id int, text string")
    counts = FE.term_counts(df, "id")
    stats = [(r["term"], r["doc_freq"], r["corpus_count"]) for r in FE.term_statistics(counts).collect()]
    for size in (1, 7, 60, 333, 100_000):
        want = sorted((-n, t) for t, d, n in stats if d >= 2)[:size]
        for width in (1, 64, 2**20):
            got = FE.vocabulary(counts, size, 2, width).collect()
            assert sorted((-r["corpus_count"], r["term"]) for r in got) == want
            assert [r["term_id"] for r in sorted(got, key=lambda r: r["term"])] == list(range(len(want)))


def test_terms_are_counted_and_weighed_in_parts(spark, monkeypatch):
    """Parts of few tokens, long texts among them, ids that repeat or are null: as by hand. No gram of a text
    is a row of its own before it is counted."""
    import random

    import numpy as np
    import pyarrow as pa

    from steadfast.functions import terms as G

    rng = random.Random(4)
    texts = [" ".join(rng.choice(("aa", "bb", "cc", "\u00e9\u00e9", "aa bb")) for _ in range(n)) for n in (0, 1, 3, 40, 7, 0, 90, 2, 1)]
    ids = [1, 1, None, 4, 5, 6, 7, 8, None]
    schema = "id int, text string"
    rows = FE.term_counts(spark.createDataFrame([*zip(ids, texts), (9, None)], schema), "id").collect()

    def by_hand(text):
        w = text.replace("\u00e9", "e").split()
        return Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])

    want = sorted(((i, t, n) for i, x in zip(ids, texts) for t, n in by_hand(x).items()), key=str)
    assert sorted(map(tuple, rows), key=str) == want
    total = Counter()
    for x in texts:
        total.update(by_hand(x))
    df = spark.createDataFrame(list(zip(ids, texts)), schema)
    made = FE.term_occurrences(df.coalesce(1)).collect()
    assert len(made) == len(total) and {r["term"]: r["tf"] for r in made} == total
    words = [x.replace("\u00e9", "e").split() for x in texts]
    terms = ["aa", "bb aa", "cc", "ee ee", "zz", "aa bb cc"]
    for tokens in (1, 5, 30, 2**19):
        monkeypatch.setattr(G, "PART_TOKENS", tokens)
        lists = pa.array([["x"], *words, ["x"]], pa.list_(pa.string())).slice(1, len(words))
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), lists], ["id", "tokens"])
        found = [tuple(r.values()) for b in G.by_text([batch]) for r in b.to_pylist()]
        assert sorted(found, key=str) == want
        got = G.weigher(terms, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])(lists).to_pylist()
        for x, entries in zip(texts, got, strict=True):
            w = {i: (1 + math.log(by_hand(x)[t])) * (i + 1) for i, t in enumerate(terms) if t in by_hand(x)}
            norm = math.sqrt(sum(v * v for v in w.values()))
            assert [e["term_id"] for e in entries] == list(w)
            assert np.allclose([e["weight"] for e in entries], [v / norm for v in w.values()])


def test_a_filter_on_weights_weighs_once(spark):
    df = spark.createDataFrame([(0, "aa bb"), (1, "cc"), (2, "aa")], "id int, text string")
    vocab = spark.createDataFrame([("aa", 1.0, 0)], "term string, idf double, term_id int")
    coefs = spark.createDataFrame([(0, 1.0)], "term_id int, coefficient double")
    scored = FE.linear_score(df, vocab, coefs, "id")
    assert sorted(r["id"] for r in scored.collect()) == [0, 2]
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[weighed", plan)) == 1  # above the union of both ways of folding


def test_rare_terms_are_not_shuffled(spark):
    """Exact counts are made of the terms in frequent buckets only."""
    docs = [(i, f"common common rare{i}") for i in range(3000)]
    counts = FE.term_counts(spark.createDataFrame(docs, "id int, text string"), "id")
    seen, count = [], FE.term_statistics

    def recorded(rows):
        seen.append(rows.select("term").distinct().count())
        return count(rows)

    FE.term_statistics = recorded
    try:
        assert {r["term"] for r in FE.vocabulary(counts, 1, 2).collect()} == {"common"}
    finally:
        FE.term_statistics = count
    assert seen[0] < 100  # of 9,002


def test_characters_of_a_class_are_counted_without_a_match_each(spark):
    texts = ["", "abc", "A1 \u00c9\u0301 \u0661x\n\U0001d400\U0001d41b \U0001f600", "...", "\U0001d7d8\u2163\u01c5"]
    for outside, kinds in ((r"\P{L}", "L"), (r"\P{Nd}", "Nd"), (r"\P{Lu}", "Lu")):
        want = [sum(unicodedata.category(c).startswith(kinds) for c in t) for t in texts]
        assert values(spark, texts, lambda t: X.count_within(t, outside)) == want
    plan = spark.createDataFrame([("a", 1, False)], "text string, id int, had_html boolean").select(*X.handcrafted(F.col("text"), F.col("had_html")))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_count") + plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1


def test_scales_use_population_deviation(spark):
    df = spark.createDataFrame([(1, "ab", False), (2, "abcd", False)], "id int, text string, had_html boolean")
    row = FE.scale_factors(FE.handcrafted_features(df, "id")).first()
    assert row["hc_char_len"] == pytest.approx(1.0) and row["hc_had_html"] == 1.0


FOLDED = {
    "\uff46\uff55\uff4c\uff4c \uff57\uff49\uff44\uff54\uff48": "full width", "\u2163 \u2173": "IV iv", "\ufb01ne \u01c6": "fine dz",
    "cr\u00e8me br\u00fbl\u00e9e": "creme brulee", "e\u0301le\u0300ve": "eleve", "\uac00": "\u1100\u1161", "\u1e9e\u00df": "\u1e9e\u00df",
    "\U0001d400\U0001d41b": "Ab", "plain": "plain", "": "",
}


def test_accents_fold_over_all_of_unicode(spark):
    assert values(spark, list(FOLDED), X.strip_accents) == list(FOLDED.values())
    assert values(spark, ["\uff34\uff25\uff38\uff34 \u2163"], X.terms) == [["text", "iv"]]
    assert values(spark, [None, "\ufb00"], X.strip_accents) == [None, "ff"]


def test_only_texts_that_need_it_reach_python(spark):
    texts = ["plain", "cr\u00e8me \u201cx\u201d", "\ufb01", "e\u0301", "\uac00", "", "\u65e5\u672c"]
    assert values(spark, texts, X.folds_in_place) == [True, True, False, False, False, True, True]
    df = spark.createDataFrame(list(enumerate(texts + [None])), "id int, text string")
    made = {r["id"]: r["grams"] for r in FE.grams(df).collect()}
    assert made[0] == ["plain"] and made[1] == ["creme"] and made[2] == ["fi"] and made[7] == [] and len(made) == 8
    branches = df.where(X.folds_in_place(F.col("text")))
    assert "Python" not in branches.withColumn("f", X.fold_in_place(F.col("text")))._jdf.queryExecution().executedPlan().toString()
