"""Physical plans: what must not appear at scale."""

import os
import re

import pytest

from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

# Terms: characters that fold to several are folded in Arrow batches.
PYTHON_ALLOWED = {"bootstrap_ci", "mime_ingest", "html_ingest", "mbox_ingest", "corpus_build", "tfidf_weights", "linear_score"}
CHECKED = (
    "retention_funnel", "intersection_ids", "last_write_wins", "dedup_first", "cleaning_funnel", "stratified_split",
    "kfold_assign", "dense_index", "seeded_sample", "tfidf_weights", "linear_score", "roc_auc", "fpr_threshold",
    "mcnemar", "paired_bootstrap", "permutation_test", "bootstrap_ci", "cache_reconcile", "release_emails",
    "handcrafted_features", "mime_ingest", "url_ablation", "mitigation_grid", "release_rewrites", "significance_table", "corpus_build",
)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_plan(spark, name):
    plan = plan_of(QUERIES[name][0](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in PYTHON_ALLOWED:
        assert not re.search(r"ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)
    # No window over an unpartitioned table, but for the bounded count per digest prefix
    # and the numbering of the bounded vocabulary.
    for window in re.findall(r"Window \[.*", plan):
        assert not re.search(r"windowspecdefinition\(\s*(?!_prefix#|term#)[\w#]+ (?:ASC|DESC)", window), window


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from checks import fixtures as fx

    plan = plan_of(fx.rewrite_log(spark, SF).where(F.col("severity") == 1.0).select("original_id"))
    assert "EqualTo(toxic,1)" in plan
    assert not re.search(r"ReadSchema: struct<[^>]*(html|lang|quality)", plan)


def test_wide_rows_are_not_shuffled_by_sampling(spark):
    from steadfast.operators.sampling import stratified_split

    df = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("lang", "label")
    plan = plan_of(stratified_split(df, "doc_id"))
    assert "Exchange hashpartitioning" not in plan and "Sort [" not in plan


def test_last_write_wins_sorts_no_text(spark):
    plan = plan_of(QUERIES["last_write_wins"][0](spark, SF))
    assert not [line for line in plan.splitlines() if "Aggregate" in line and re.search(r"\b(raw|original_text|doc_text|text)#", line)]


def test_paired_statistics_have_no_rows_times_replicates(spark):
    plan = plan_of(QUERIES["permutation_test"][0](spark, SF))
    assert not [line for line in plan.splitlines() if "Generate" in line and "row_id#" in line]
