"""Verdicts on inline texts."""

import pytest
from pyspark.sql import functions as F

from steadfast.functions import text as X
from steadfast.functions import urls as U
from steadfast.operators import rewrites as R

FORM = "http://203.0.113.9/token/confirm.cgi"
FEED = "http://facebook.com/harborcafe"
CASES = {
    # name: original, rewrite, n, missing, strict, kind, n_primary, primary
    "kept": (
        "Your parcel waits: https://parcel-desk.test/track?id=77 (two days left)", "Track it here https://parcel-desk.test/track?id=77 today",
        1, [], True, "exact", 1, True,
    ),
    "dropped": (
        "Renew on http://renewals.test/step1 - opt out: http://mailer.test/optout", "Renewal form: http://renewals.test/step1",
        2, ["http://mailer.test/optout"], False, "missing", 1, True,
    ),
    "no_url": ("Lunch moved to noon.", "Lunch is at twelve now.", 0, [], None, "none", 0, None),
    "footer_dropped": (
        f"Enter the token on {FORM} - our page: {FEED}", f"The token goes into {FORM}", 2, [FEED], False, "missing", 1, True,
    ),
    "lander_dropped": (
        f"Enter the token on {FORM}, list: http://mailer.test/u", "Enter the token.",
        2, [FORM, "http://mailer.test/u"], False, "missing", 1, False,
    ),
    "only_footers": (
        f"Find us: {FEED} or http://twitter.com/harborcafe", f"Find us: {FEED}",
        2, ["http://twitter.com/harborcafe"], False, "missing", 0, None,
    ),
    "longer_host": ("see http://tide.test today", "see http://tide.test.nz today", 1, [], True, "substring", 1, True),
    "bare_scheme": ("broken http://... link", "broken https://whole.test/a link, or http://whole.test/b", 1, [], True, "substring", 1, True),
    "case_and_dots": ("READ HTTP://Notes.TEST/Q7).", "read http://notes.test/q7/", 1, [], True, "exact", 1, True),
    "null_rewrite": ("read http://notes.test", None, 1, ["http://notes.test"], False, "missing", 1, False),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, c[0], c[1]) for k, c in CASES.items()]
    df = spark.createDataFrame(rows, "name string, original_text string, rewrite_text string")
    return {r["name"]: r for r in R.with_verdicts(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_verdict(judged, name):
    _, _, n, missing, strict, kind, n_primary, primary = CASES[name]
    row = judged[name]
    assert row["n_orig_urls"] == n
    assert row["missing_urls"] == missing
    assert row["retained_urls"] is strict
    assert row["match_kind"] == kind
    assert row["n_primary_urls"] == n_primary
    assert row["retained_primary"] is primary


def test_raw_address_outranks_brand(spark):
    df = spark.createDataFrame([("terms: http://paypal.com/legal - token form: http://203.0.113.9/token/confirm",)], "t string")
    assert df.select(U.primary_urls(F.col("t")).alias("p")).first()["p"] == ["http://203.0.113.9/token/confirm"]


@pytest.mark.parametrize("url,points", [
    ("http://1.2.3.4/login", 6), ("http://paypal.com", 0), ("http://www.paypal.com/login", 2), ("http://x.org/a", 1),
    ("http://a.facebook.com/x", -1), ("http://clickthru.ebay.com/x", -1), ("http://x.org/logo.png?v=1", -1),
    ("http://x.org/unsubscribe", -1), ("http://notfacebook.com/x", 1),
])
def test_strength(spark, url, points):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(U.url_strength(F.col("u"))).first()[0] == points


def test_host_is_found_once_for_a_url(spark):
    """No list of hosts or words is searched for an expression that each of its names would compute anew."""
    df = spark.createDataFrame([("http://x.org/a",), (None,)], "u string")
    scored = df.select(U.url_strength(F.col("u")).alias("s"), U.host_of(F.col("u")).alias("h"), U.is_incidental(F.col("u")).alias("i"))
    assert [tuple(r) for r in scored.collect()] == [(1, "x.org", False), (1, None, None)]
    plan = df.select(U.url_strength(F.col("u")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 1
    assert plan.count("lower(") == 2


def test_validity_treats_null_as_not_valid(spark):
    rows = [(None, None), (None, False), (True, None), (True, True), (False, False), (True, False)]
    df = spark.createDataFrame(rows, "retained_urls boolean, refused boolean")
    assert [r[0] for r in df.select(R.is_valid()).collect()] == [False, False, True, False, False, True]


def test_intersection_needs_every_severity(spark):
    rows = [("a", s, True, False) for s in (0.25, 0.5, 0.75, 1.0)]
    rows += [("b", s, True, False) for s in (0.25, 0.5, 0.75)]
    rows += [("c", s, True if s < 1 else None, False) for s in (0.25, 0.5, 0.75, 1.0)]
    df = spark.createDataFrame(rows, "original_id string, severity double, retained_urls boolean, refused boolean")
    assert [r[0] for r in R.intersection_ids(df, R.is_valid()).collect()] == ["a"]


def test_last_write_wins(spark):
    rows = [("a", 0.5, 1, "old"), ("a", 0.5, 3, "new"), ("a", 0.5, 2, "mid"), ("b", 0.5, 1, "only")]
    df = spark.createDataFrame(rows, "original_id string, severity double, pos int, rewrite_text string")
    got = R.latest_rewrites(df, order=["pos"]).select("original_id", "rewrite_text").collect()
    assert sorted(map(tuple, got)) == [("a", "new"), ("b", "only")]


def test_retention_label_precedence(spark):
    rows = [(True, None, [], 0), (False, None, [], 0), (False, True, [], 1), (None, False, ["u"], 2)]
    df = spark.createDataFrame(rows, "refused boolean, retained_urls boolean, missing_urls array<string>, n_orig_urls int")
    got = [r[0] for r in df.select(R.retention_label()).collect()]
    assert got == ["REFUSED", "manual (no URL)", "PASS", "FAIL (missing 1/2)"]


def test_parse_and_refusal(spark):
    df = spark.createDataFrame([(" SUBJECT: Verify \nbody\n",), ("no header",), ("Subject: only",)], "r string")
    got = [tuple(r[0]) for r in df.select(X.parse_rewrite(F.col("r"))).collect()]
    assert got == [("Verify", "body", "Verify\nbody"), ("", "no header", "no header"), ("only", "", "only")]
    df = spark.createDataFrame([("As an AI I will not",), ("fine",), (None,)], "r string")
    assert [r[0] for r in df.select(X.looks_like_refusal(F.col("r"))).collect()] == [True, False, False]


def test_cache_reuse(spark):
    work = spark.createDataFrame(
        [(i, 0.5, "ph", "th") for i in "abcde"], "original_id string, severity double, prompt_hash string, input_text_sha string"
    )
    cache = spark.createDataFrame(
        [("a", 0.5, "ph", "th"), ("b", 0.5, "ph", None), ("c", 0.5, "old", "th"), ("d", 0.5, "ph", "old")], work.schema
    )
    got = {r["original_id"]: r["status"] for r in R.reconcile(work, cache).collect()}
    assert got == {"a": "hit", "b": "hit", "c": "stale", "d": "stale", "e": "miss"}
    assert sorted(r[0] for r in R.worklist(work, cache).select("original_id").collect()) == ["c", "d", "e"]


def test_spot_check_judges_each_pair_once(spark):
    """Verdicts are made once for each pair, and once more for the chosen ones; a chosen key that repeats has all its rows."""
    made = spark.sparkContext.accumulator(0)

    def judge(i):
        made.add(1)
        return None if i % 5 == 0 else i % 2 == 0

    rows = [(f"o{i}", 0.5, i, f"text {i}") for i in range(300)] + [("o2", 0.5, 2, "text 2")]
    df = spark.createDataFrame(rows, "original_id string, severity double, i int, original_text string").repartition(4).select(
        "*", F.udf(judge, "boolean")("i").alias("retained_urls"), F.array().cast("array<string>").alias("missing_urls"),
        F.lit(1).alias("n_orig_urls"), F.lit(False).alias("refused"), F.col("original_text").alias("rewrite_text"))
    got = R.spotcheck_pairs(df, 200, 3).collect()
    assert made.value <= len(rows) + 2 * len(got)
    assert sorted(r["original_id"] for r in got if r["verdict"] == "PASS") == sorted(
        r[0] for r in rows if r[2] % 5 and r[2] % 2 == 0)
    assert sum(r["verdict"] == "FAIL" for r in got) == 3
    assert R.spotcheck_pairs(df.where("i % 5 = 0"), 2, 2).collect() == []
