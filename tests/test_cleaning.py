"""Cleaning, splitting and sampling."""

import hashlib
import math

from pyspark.sql import functions as F

from steadfast.operators import cleaning as C
from steadfast.operators import quality, sampling


def order(seed, value):
    return hashlib.md5(f"{seed}|{value}".encode()).hexdigest(), str(value)


def test_first_source_wins_even_over_a_positive(spark):
    rows = [("ham", 0, "h1", 0, "Hi", "Same Body"), ("bad", 1, "b1", 1, "HI", "same body"), ("bad", 1, "b0", 1, "x", "other")]
    df = spark.createDataFrame(rows, "source string, source_rank int, original_id string, label int, subject string, body string")
    kept = C.dedup_first(C.with_dedup_key(df)).select("original_id").collect()
    assert sorted(r[0] for r in kept) == ["b0", "h1"]


def test_a_third_of_rows_are_one_text(spark):
    df = spark.range(3000).select(
        F.lit("s").alias("source"), F.lit(0).alias("source_rank"), F.format_string("%05d", "id").alias("original_id"),
        F.lit("subject").alias("subject"),
        F.when(F.col("id") % 3 == 0, "one two three four five").otherwise(F.concat(F.lit("aa bb cc dd ee "), F.col("id").cast("string"))).alias("body"),
    )
    assert C.dedup_first(C.with_dedup_key(df)).count() == 2001
    row = C.cleaning_funnel(df).first()
    assert (row["parsed"], row["low_content"], row["duplicate"], row["kept"]) == (3000, 0, 999, 2001)


def test_split_takes_exact_share_in_digest_order(spark):
    df = spark.range(1003).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    got = {r["id"]: r["split"] for r in sampling.stratified_split(df.repartition(5), "id").collect()}
    for label in (0, 1):
        ids = sorted((i for i in range(1003) if (i % 4 == 0) == bool(label)), key=lambda i: order(42, i))
        cut = math.ceil(0.2 * len(ids))
        assert {i for i in ids if got[i] == "test"} == set(ids[:cut])


def test_samples_are_prefixes_and_exact(spark):
    df = spark.range(500)
    want = sorted(range(500), key=lambda i: order(42, i))
    for n in (0, 1, 17, 200, 500, 900):
        got = {r[0] for r in sampling.seeded_sample(df, "id", n).collect()}
        assert got == set(want[:n])


def test_folds_and_ranks(spark):
    df = spark.range(301).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    folds = sampling.stratified_folds(df, "id").groupBy("label", "fold").count().collect()
    assert len(folds) == 10
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert max(sizes) - min(sizes) <= 1
    ranks = {r["id"]: r["rank"] for r in sampling.hash_ranks(df, "id").collect()}
    assert ranks == {i: k + 1 for k, i in enumerate(sorted(range(301), key=lambda i: order(42, i)))}


def test_label_checks(spark):
    good = [("a%d" % i, "ham" if i % 5 else "bad", 0 if i % 5 else 1, "test" if i % 7 == 0 else "train") for i in range(50)]
    df = spark.createDataFrame(good, "id string, source string, label int, split string")
    assert all(r["ok"] for r in quality.label_invariants(df).collect())
    bad = df.unionByName(spark.createDataFrame([("a1", "ham", 1, "other")], df.schema))
    failed = {r["check"] for r in quality.label_invariants(bad).collect() if not r["ok"]}
    assert failed == {"one_label_per_source", "ids_unique", "split_values"}
    assert quality.leakage_check(df.withColumn("k", F.lit("same")), "k").first()["in_both"] == 1
    assert quality.leakage_check(df, "id").first()["in_both"] == 0
