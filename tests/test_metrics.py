"""Metrics and resampling against brute force, also when cut into many buckets."""

import random

import pytest
from pyspark.sql import functions as F

from steadfast.functions import hashing as H
from steadfast.operators import metrics as M
from steadfast.operators import paired as P
from steadfast.operators import resample as S


def brute(pos, neg):
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap = 0.0
    for p in pos:
        tp, fp = sum(x >= p for x in pos), sum(x >= p for x in neg)
        ap += tp / (tp + fp) / len(pos)
    return auc, ap


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(7)
    neg, pos = [], []
    for g in ("m1", "m2"):
        for i in range(400):  # a third of the negatives share one score
            neg.append((g, f"n{i}", 0.0 if i % 3 == 0 else round(rng.random() * 0.8, 2)))
        for s in (0.0, 0.5, 1.0):
            for i in range(60):
                pos.append((g, s, f"p{i}", 0.0 if i % 10 == 0 else round(min(1.0, 0.3 + rng.random() * (1 - s / 3)), 2)))
    pos_df = spark.createDataFrame(pos, "model string, severity double, row_id string, score double").persist()
    neg_df = spark.createDataFrame(neg, "model string, row_id string, score double").persist()
    return pos, neg, pos_df, neg_df


def test_ranking_metrics(scores):
    pos, neg, pos_df, neg_df = scores
    got = M.ranking_metrics(pos_df, neg_df, ["model"], ["severity"]).collect()
    assert len(got) == 6
    for r in got:
        p = [x[3] for x in pos if x[0] == r["model"] and x[1] == r["severity"]]
        n = [x[2] for x in neg if x[0] == r["model"]]
        auc, ap = brute(p, n)
        assert (r["n_pos"], r["n_neg"]) == (60, 400)
        assert r["roc_auc"] == pytest.approx(auc, abs=1e-12)
        assert r["pr_auc"] == pytest.approx(ap, abs=1e-12)


@pytest.mark.parametrize("fpr", [0.01, 0.25, 0.0, 1.0])
def test_fpr_threshold(scores, fpr):
    import numpy as np

    _, neg, _, neg_df = scores
    got = {r[0]: r[1] for r in M.fpr_threshold(neg_df, ["model"], fpr).collect()}
    for g in ("m1", "m2"):
        assert got[g] == pytest.approx(np.quantile([x[2] for x in neg if x[0] == g], 1 - fpr), abs=1e-12)


def test_no_group_and_all_ties(spark):
    pos = spark.createDataFrame([(0.5,)] * 3, "score double")
    neg = spark.createDataFrame([(0.5,)] * 5, "score double")
    row = M.detection_metrics(pos, neg, []).first()
    assert row["roc_auc"] == 0.5 and row["pr_auc"] == pytest.approx(3 / 8)
    assert row["recall"] == 1.0 and row["precision"] == pytest.approx(3 / 8)


def test_undefined_ratios_are_zero(spark):
    pos = spark.createDataFrame([(0.1,)], "score double")
    neg = spark.createDataFrame([(0.2,)], "score double")
    row = M.confusion_metrics(pos, neg, []).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_few_negatives_pass_the_fixed_rate(scores):
    _, neg, _, neg_df = scores
    limits = M.fpr_threshold(neg_df, ["model"], 0.01)
    rate = M.recall_at_fpr(neg_df, limits, ["model"]).agg(F.max("recall_fpr")).first()[0]
    assert rate <= 0.05


def weighted_brute(pos, neg, coefs, n):
    """The definition of one replicate, row by row."""
    import hashlib

    from steadfast import lexicons as L
    from steadfast.functions.hashing import MODULUS

    def weight(row_id, c):
        t = hashlib.md5(f"42|{row_id}".encode()).hexdigest()
        h1, h2 = int(t[:8], 16) % MODULUS, int(t[8:16], 16) % MODULUS
        u = ((c[1] * h1 + c[2] * h2 + c[3]) % MODULUS) / MODULUS
        return sum(u >= s for s in L.POISSON_CDF)

    aucs, aps = [], []
    for c in coefs:
        p = [(s, weight(i, c)) for i, s in pos]
        q = [(s, weight(i, c)) for i, s in neg]
        tp_all, fp_all = sum(w for _, w in p), sum(w for _, w in q)
        aucs.append(sum(w * v * ((s > t) + 0.5 * (s == t)) for s, w in p for t, v in q) / (tp_all * fp_all))
        ap = 0.0
        for s, w in p:
            if w:
                tp, fp = sum(v for t, v in p if t >= s), sum(v for t, v in q if t >= s)
                ap += w * tp / (tp + fp) / tp_all
        aps.append(ap)
    return aucs, aps


@pytest.mark.parametrize("rows_per_slice", [100_000, 25])
def test_bootstrap_slices_agree_with_definition(scores, rows_per_slice):
    import numpy as np

    pos, neg, pos_df, neg_df = scores
    n = 12
    got = S.bootstrap_cis(pos_df, neg_df, ["model"], n=n, rows_per_slice=rows_per_slice).collect()
    assert len(got) == 6
    coefs = S.coefficients(42, n)
    for r in got:
        p = [(x[2], x[3]) for x in pos if x[0] == r["model"] and x[1] == r["severity"]]
        q = [(x[1], x[2]) for x in neg if x[0] == r["model"]]
        aucs, aps = weighted_brute(p, q, coefs, n)
        for name, vals in (("roc_auc", aucs), ("pr_auc", aps)):
            assert r[f"{name}_lo"] == pytest.approx(np.quantile(vals, 0.025), abs=1e-9)
            assert r[f"{name}_hi"] == pytest.approx(np.quantile(vals, 0.975), abs=1e-9)


def test_bootstrap_covers_the_point(scores):
    _, _, pos_df, neg_df = scores
    points = {(r["model"], r["severity"]): r for r in M.detection_metrics(pos_df, neg_df, ["model"], ["severity"]).collect()}
    for r in S.bootstrap_cis(pos_df, neg_df, ["model"], n=300).collect():
        p = points[(r["model"], r["severity"])]
        for m in ("roc_auc", "pr_auc", "f1", "precision", "recall"):
            assert r[f"{m}_lo"] - 1e-9 <= p[m] <= r[f"{m}_hi"] + 1e-9


def test_weights_follow_the_unit_rate_law(spark):
    rows = spark.range(5000).select(*(c.alias(n) for c, n in zip(H.row_hashes(42, F.col("id").cast("string")), ("h1", "h2"))))
    drawn = rows.withColumn("r", F.explode(S.replicates(42, 20)))
    u = H.replicate_uniform(F.col("h1"), F.col("h2"), *(F.col("r")[c] for c in "abc"))
    w = drawn.select(S.poisson_weight(u).alias("w"), F.col("r.replicate"))
    row = w.agg(F.avg("w"), F.var_pop("w"), F.avg(F.when(F.col("w") == 0, 1.0).otherwise(0.0))).first()
    assert row[0] == pytest.approx(1, abs=0.02) and row[1] == pytest.approx(1, abs=0.05) and row[2] == pytest.approx(0.3679, abs=0.01)
    assert all(r[1] == pytest.approx(1, abs=0.08) for r in w.groupBy("replicate").agg(F.avg("w")).collect())


GOLDEN = [
    (34, 1, 2.0954757928848267e-09), (18, 4, 0.004343509674072266), (8, 5, 0.5810546875), (61, 1, 2.7321894746634712e-17),
    (33, 8, 0.00011222142620681552), (20, 6, 0.009355306625366211), (7, 4, 0.548828125), (7, 6, 1.0), (2, 4, 0.6875),
    (0, 0, 1.0), (5, 5, 1.0), (0, 1, 1.0), (0, 10, 0.001953125),
]


def test_exact_p_values(spark):
    df = spark.createDataFrame([(b, c, p) for b, c, p in GOLDEN], "b long, c long, p double")
    for r in df.withColumn("got", P.exact_mcnemar_p(F.col("b"), F.col("c"))).collect():
        assert r["got"] == pytest.approx(r["p"], rel=1e-9), r


def test_exact_p_for_large_counts(spark):
    import math

    def exact(b, c):
        n, k = b + c, min(b, c)
        return min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)))

    pairs = [(50_500, 49_900), (12_000, 11_500), (30_000, 20_000)]
    df = spark.createDataFrame(pairs, "b long, c long")
    for r in df.withColumn("got", P.exact_mcnemar_p(F.col("b"), F.col("c"))).collect():
        assert r["got"] == pytest.approx(exact(r["b"], r["c"]), rel=1e-6, abs=1e-300)


def test_paired_tests_on_known_counts(spark):
    rows = [(f"r{i}", 0.0, 0.9) for i in range(50)] + [(f"r{i}", 1.0, 0.1 if i < 12 else 0.9) for i in range(50)]
    rows += [("only0", 0.0, 0.9)]
    df = spark.createDataFrame(rows, "row_id string, severity double, score double").withColumn("model", F.lit("m"))
    outcomes = P.paired_outcomes(df, ["model"])
    r = P.mcnemar_test(outcomes, ["model"]).first()
    assert (r["n"], r["mcnemar_b_lost"], r["mcnemar_c_gained"]) == (50, 12, 0)
    assert r["effect_drop"] == pytest.approx(0.24)
    ci = S.paired_bootstrap(outcomes, ["model"], n=400).first()
    assert 0.08 < ci["drop_lo"] < 0.24 < ci["drop_hi"] < 0.42
    assert S.permutation_test(outcomes, ["model"], n=2000).first()["perm_p_value"] < 0.01


def test_permutation_without_discordant_rows(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 0, 0)], "row_id string, d0 int, d1 int").withColumn("model", F.lit("m"))
    assert S.permutation_test(df, ["model"], n=50).first()["perm_p_value"] == 1.0


def test_results_ignore_partitioning(scores):
    _, _, pos_df, neg_df = scores
    a = M.detection_metrics(pos_df, neg_df, ["model"], ["severity"]).orderBy("model", "severity").collect()
    b = M.detection_metrics(
        pos_df.orderBy(F.rand(3)).repartition(7), neg_df.repartition(5), ["model"], ["severity"]
    ).orderBy("model", "severity").collect()
    for x, y in zip(a, b):
        assert all(u == pytest.approx(v, abs=1e-12) if isinstance(u, float) else u == v for u, v in zip(x, y))


def test_a_slice_gets_offsets_once_for_each_cell(spark):
    """They are as long as there are replicates: no row may carry them."""
    import pandas as pd

    seen, made = [], S._replicate_sums

    def spy(*args):
        worker = made(*args)

        def run(key, rows):
            if "_pos_above" in rows:
                held = rows["_pos_above"].notna()
                if held.sum() > rows.loc[rows["label"] > 0, "severity"].nunique() or (held & (rows["label"] < 2)).any():
                    raise ValueError("offsets with rows")
            return worker(key, rows)

        return run

    seen = [("m", i, float(i % 3), float(i % 2), 0.01 * i) for i in range(60)]
    pos = spark.createDataFrame(pd.DataFrame(seen, columns=["model", "row_id", "severity", "x", "score"]).drop(columns="x"))
    neg = pos.withColumn("score", pos["score"] / 2).drop("severity")
    S._replicate_sums = spy
    try:
        rows = S.bootstrap_cis(pos, neg, ["model"], n=20, rows_per_slice=25).collect()
    finally:
        S._replicate_sums = made
    assert len(rows) == 3 and all(0 <= r["pr_auc_lo"] <= r["pr_auc_hi"] <= 1 for r in rows)
