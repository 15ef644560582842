"""Detection quality as rewriting gets more severe.

`positives`: row_id, severity, score and the group columns. `negatives`: row_id, score and
the group columns; they are the same at every severity. `ids`: the rows in scope.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.functions import text as X
from steadfast.operators import metrics as M
from steadfast.operators import rewrites as R
from steadfast.operators.resample import bootstrap_cis
from steadfast.operators.support import pinned
from steadfast.schemas import severity_key


def restrict(positives: DataFrame, ids: DataFrame, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Scores of the ids in scope, pinned: they are narrow and every metric reads them, and
    the ids behind them may come from judging whole texts."""
    return pinned(positives.join(ids, list(keys), "left_semi"))


def clean_baseline(positives: DataFrame, negatives: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    clean = positives.where(F.col("severity") == 0.0)
    return M.detection_metrics(clean, negatives, group).drop("n_phish")


def scored_curve(
    name: str, positives: DataFrame, negatives: DataFrame, group: Sequence[str] = ("model",),
    n_boot: int = L.N_BOOTSTRAP, **options,
) -> DataFrame:
    """Every metric per (group, severity); with n_boot > 0 also percentile intervals."""
    points = M.detection_metrics(positives, negatives, group, ["severity"])
    if n_boot:
        cis = bootstrap_cis(positives, negatives, group, ["severity"], n=n_boot, **options)
        points = points.join(cis.drop("recall_fpr_lo", "recall_fpr_hi"), [*group, "severity"], "left")
    return points.select(F.lit(name).alias("set"), "*")


def degradation_curve(
    positives: DataFrame, negatives: DataFrame, ids: DataFrame, group: Sequence[str] = ("model",),
    n_boot: int = L.N_BOOTSTRAP, name: str = "intersection", **options,
) -> DataFrame:
    """Headline curve: the same ids at every severity."""
    return scored_curve(name, restrict(positives, ids), negatives, group, n_boot, **options)


def sensitivity_curve(
    positives: DataFrame, negatives: DataFrame, valid_pairs: DataFrame, ids: DataFrame,
    group: Sequence[str] = ("model",), n_boot: int = L.N_BOOTSTRAP, **options,
) -> DataFrame:
    """Each severity on the ids valid at that severity; severity 0 on the intersection."""
    keyed = positives.withColumn("_sev", severity_key(F.col("severity")))
    pairs = valid_pairs.select("row_id", severity_key(F.col("severity")).alias("_sev"))
    clean = keyed.where(F.col("_sev") == 0).join(ids, "row_id", "left_semi")
    moved = keyed.where(F.col("_sev") > 0).join(pairs, ["row_id", "_sev"], "left_semi")
    scope = pinned(clean.unionByName(moved).drop("_sev"))
    return scored_curve("per_severity_pass", scope, negatives, group, n_boot, **options)


def cross_generator_curve(
    positives: DataFrame, negatives: DataFrame, ids: DataFrame, group: Sequence[str] = ("model",),
    n_boot: int = 0, **options,
) -> DataFrame:
    """One curve per generator, each on that generator's own intersection."""
    scope = restrict(positives, ids, ["row_id", "generator"])
    points = M.detection_metrics(scope, negatives, group, ["generator", "severity"])
    if n_boot:
        cis = bootstrap_cis(scope, negatives, group, ["generator", "severity"], n=n_boot, **options)
        points = points.join(cis, [*group, "generator", "severity"], "left")
    return points


def era_ablation(positives: DataFrame, ids: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """Detection rate per era; era 'all' is the total over eras."""
    scope = restrict(positives, ids).withColumn("era", X.era_of(F.col("row_id")))
    hit = F.when(F.col("score") >= L.DETECT_THRESHOLD, 1.0).otherwise(0.0)
    keys = [*group, "severity"]
    return (
        scope.groupingSets([[*keys, "era"], keys], *keys, "era")
        .agg(F.count("*").alias("n_phish"), F.avg(hit).alias("detection_rate"))
        .select(F.coalesce("era", F.lit("all")).alias("era"), *keys, "n_phish", "detection_rate")
    )


def valid_ids(judged: DataFrame, generator: str | None = None) -> DataFrame:
    """row_id of ids valid at every severity (of one generator, or per generator)."""
    rows = judged if generator is None else judged.where(F.col("generator") == generator)
    keys = ["original_id"] if generator else ["original_id", "generator"]
    return R.intersection_ids(rows, R.is_valid(), keys).withColumnRenamed("original_id", "row_id")
