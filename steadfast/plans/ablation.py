"""URL ablation, mitigation grid and their comparisons."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from steadfast import lexicons as L
from steadfast.operators import metrics as M
from steadfast.operators.resample import bootstrap_cis
from steadfast.operators.support import pinned
from steadfast.plans.degradation import restrict


def url_ablation(
    positives: DataFrame, negatives: DataFrame, ids: DataFrame,
    group: Sequence[str] = ("condition", "model"), target_fpr: float = L.TARGET_FPR,
) -> DataFrame:
    return M.condition_metrics(restrict(positives, ids), negatives, group, ["severity"], target_fpr)


def mitigation_grid(
    positives: DataFrame, negatives: DataFrame, ids: DataFrame,
    group: Sequence[str] = ("condition", "training", "model"),
) -> DataFrame:
    """URL condition x training, at every severity."""
    return url_ablation(positives, negatives, ids, group)


def mitigation_transfer(positives: DataFrame, negatives: DataFrame, ids: DataFrame) -> DataFrame:
    """The grid per test generator, each on its own intersection."""
    scope = restrict(positives, ids, ["row_id", "generator"])
    return M.condition_metrics(scope, negatives, ["condition", "training", "model"], ["generator", "severity"])


def external_report(
    positives: DataFrame, negatives: DataFrame, ids: DataFrame,
    group: Sequence[str] = ("condition", "model"), n_boot: int = L.N_BOOTSTRAP, **options,
) -> DataFrame:
    """Condition metrics with intervals, the form used for replication corpora and for
    externally supplied scores."""
    scope = restrict(positives, ids)
    points = M.condition_metrics(scope, negatives, group)
    limits = pinned(M.fpr_threshold(negatives, group))
    cis = bootstrap_cis(scope, negatives, group, n=n_boot, thresholds=limits, **options)
    wanted = [c for c in cis.columns if c.startswith(("recall_lo", "recall_hi", "recall_fpr_", "pr_auc_", "roc_auc_"))]
    renamed = {"recall_lo": "recall_05_lo", "recall_hi": "recall_05_hi"}
    return points.join(cis.select(*group, "severity", *wanted).withColumnsRenamed(renamed), [*group, "severity"], "left")
