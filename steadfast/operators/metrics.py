"""Detection metrics over score tables.

Positives are scored per cell (say model x severity). Negatives never change, so they are
kept once per group (say model) and every cell of the group looks them up. Scores are first
reduced to counts per distinct value, which are dealt to ranges of (group, score). Ranks are
running sums inside a range plus the totals of the ranges below, so no task holds a group,
whatever its size, and there is one way at every size.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.operators.support import pinned

def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, and 0 where the bottom is 0."""
    return F.coalesce(top / F.nullif(bottom.cast("double"), F.lit(0.0)), F.lit(0.0))


def split_classes(scores: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score"):
    """(positives, negatives) of one score table whose cells hold both classes."""
    cols = [*keys, F.col(score).alias("score")]
    return scores.where(F.col(label) == 1).select(*cols), scores.where(F.col(label) == 0).select(*cols)


def sliced(hist: DataFrame, group: Sequence[str]) -> DataFrame:
    """Adds _slice: ranges of (group, score) as Spark deals them, written once so that all
    later steps see the same ones. Rows of one group and score share a slice; where slices
    are cut changes no result."""
    return pinned(hist.repartitionByRange(*group, "score").withColumn("_slice", F.spark_partition_id()))


def lower_slices(hist: DataFrame, keys: Sequence[str], value: str, names: tuple[str, str]) -> DataFrame:
    """Per (keys, _slice): the total of `value` in lower slices, and in all. At most a row for
    each slice and key."""
    side = Window.partitionBy("_one", *keys)
    up = side.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.withColumn("_one", F.lit(0)).groupBy("_one", *keys, "_slice").agg(F.sum(value).alias("_part"))
        .select(*keys, "_slice", (F.sum("_part").over(up) - F.col("_part")).alias(names[0]), F.sum("_part").over(side).alias(names[1]))
    )


def running(hist: DataFrame, group: Sequence[str], value: str, names: tuple[str, str]) -> DataFrame:
    """Adds the running total of `value` up to each score, ties included, and the group's
    total, to a sliced histogram."""
    here = Window.partitionBy(*group, "_slice").orderBy("score")
    return (
        hist.withColumn("_local", F.sum(value).over(here))
        .join(lower_slices(hist, group, value, ("_below", names[1])), [*group, "_slice"])
        .withColumn(names[0], F.col("_local") + F.col("_below")).drop("_local", "_below")
    )


def ranking_metrics(
    positives: DataFrame, negatives: DataFrame, group: Sequence[str], cell: Sequence[str] = (),
) -> DataFrame:
    """Tie-aware ROC-AUC and step-wise average precision per (group, cell). Positives and
    negatives are one histogram, so a positive score finds the negatives below it in place."""
    no_cell = [F.lit(None).cast(positives.schema[c].dataType).alias(c) for c in cell]
    rows = positives.select(*group, *cell, "score", F.lit(1).alias("pos"), F.lit(0).alias("neg")).unionByName(
        negatives.select(*group, *no_cell, "score", F.lit(0).alias("pos"), F.lit(1).alias("neg"))
    )
    hist = sliced(rows.groupBy(*group, *cell, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), group)
    same = Window.partitionBy(*group, "_slice", "score")
    up = Window.partitionBy(*group, "_slice").orderBy("score")
    up_cell = Window.partitionBy(*group, "_slice", *cell).orderBy("score")
    ranked = (
        hist.withColumns({
            "_neg_at": F.sum("neg").over(same), "_neg_le": F.sum("neg").over(up), "_pos_le": F.sum("pos").over(up_cell),
        })
        .where(F.col("pos") > 0)
        .join(lower_slices(hist, group, "neg", ("_neg_below", "n_neg")), [*group, "_slice"])
        .join(lower_slices(hist, [*group, *cell], "pos", ("_pos_below", "n_pos")), [*group, *cell, "_slice"])
    )
    below = F.col("_neg_below") + F.col("_neg_le") - F.col("_neg_at")
    above = F.col("n_neg") - below
    pos_ge = F.col("n_pos") - F.col("_pos_below") - F.col("_pos_le") + F.col("pos")
    return (
        ranked.groupBy(*group, *cell)
        .agg(
            F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
            F.sum(F.col("pos") * (below + F.col("_neg_at") / 2.0)).alias("_pairs"),
            F.sum(F.col("pos") * pos_ge / (pos_ge + above)).alias("_steps"),
        )
        .select(
            *group, *cell, "n_pos", "n_neg",
            (F.col("_pairs") / F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))).alias("roc_auc"),
            (F.col("_steps") / F.col("n_pos")).alias("pr_auc"),
        )
    )


def confusion_metrics(
    positives: DataFrame, negatives: DataFrame, group: Sequence[str], cell: Sequence[str] = (),
    threshold: float = L.DETECT_THRESHOLD,
) -> DataFrame:
    """precision, recall and f1 at a threshold; each is 0 when undefined."""
    hit = F.count_if(F.col("score") >= threshold)
    pos = positives.withColumn("_one", F.lit(0)).groupBy("_one", *group, *cell).agg(
        F.count("*").alias("n_phish"), hit.alias("tp")
    )
    neg = negatives.withColumn("_one", F.lit(0)).groupBy("_one", *group).agg(hit.alias("_fp"))
    fp = F.coalesce("_fp", F.lit(0))
    tp, n = F.col("tp"), F.col("n_phish")
    return pos.join(neg, ["_one", *group], "left").select(
        *group, *cell, "n_phish", "tp", fp.alias("fp"), (n - tp).alias("fn"),
        _ratio(2 * tp, tp + fp + n).alias("f1"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, n).alias("recall"),
    )


def detection_metrics(
    positives: DataFrame, negatives: DataFrame, group: Sequence[str], cell: Sequence[str] = (),
    threshold: float = L.DETECT_THRESHOLD,
) -> DataFrame:
    """All five metrics per cell."""
    ranks = ranking_metrics(positives, negatives, group, cell)
    points = confusion_metrics(positives, negatives, group, cell, threshold)
    keys = [*group, *cell]
    one = F.lit(0)  # keeps the join key list non-empty when there are no groups
    return points.withColumn("_one", one).join(ranks.withColumn("_one", one), ["_one", *keys], "left").select(
        *keys, "n_phish", "roc_auc", "pr_auc", "f1", "precision", "recall"
    )


def fpr_threshold(
    negatives: DataFrame, group: Sequence[str], target_fpr: float = L.TARGET_FPR,
) -> DataFrame:
    """Linear-interpolated (1 - fpr) quantile of the negative scores per group, exact, from
    running counts; no task holds a whole group's scores."""
    hist = sliced(negatives.groupBy(*group, "score").agg(F.count("*").alias("neg")), group)
    ranked = running(hist, group, "neg", ("le", "n"))
    place = (F.col("n") - 1) * F.lit(1.0 - target_fpr)

    def value_at(rank: Column) -> Column:
        here = (F.col("le") - F.col("neg") <= rank) & (rank < F.col("le"))
        return F.max(F.when(here, F.col("score")))

    low, high = F.floor(place), F.ceil(place)
    return (
        ranked.groupBy(*group).agg(
            value_at(low).alias("_a"), value_at(high).alias("_b"), F.max(place - low).alias("_t")
        )
        .select(*group, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).alias("fpr_threshold"))
    )


def recall_at_fpr(
    positives: DataFrame, thresholds: DataFrame, group: Sequence[str], cell: Sequence[str] = ()
) -> DataFrame:
    """Share of positives at or above their group's threshold. `thresholds` has one row per
    group; pass it through `pinned` so that the join does not shuffle the scores."""
    side = thresholds.withColumn("_one", F.lit(0))
    hit = F.when(F.col("score") >= F.col("fpr_threshold"), 1.0).otherwise(0.0)
    return (
        positives.withColumn("_one", F.lit(0)).join(side, ["_one", *group])
        .groupBy(*group, *cell)
        .agg(F.avg(hit).alias("recall_fpr"), F.first("fpr_threshold").alias("fpr_threshold"))
    )


def condition_metrics(
    positives: DataFrame, negatives: DataFrame, group: Sequence[str], cell: Sequence[str] = ("severity",),
    target_fpr: float = L.TARGET_FPR, threshold: float = L.DETECT_THRESHOLD,
) -> DataFrame:
    """One scored condition: recall at the fixed threshold and at fixed false-positive rate,
    both AUCs, and the threshold used."""
    limits = pinned(fpr_threshold(negatives, group, target_fpr))
    at_fpr = recall_at_fpr(positives, limits, group, cell)
    base = detection_metrics(positives, negatives, group, cell, threshold)
    keys = [*group, *cell]
    return base.join(at_fpr, keys).select(
        *keys, "n_phish", F.col("recall").alias("recall_05"), "recall_fpr", "pr_auc", "roc_auc",
        "fpr_threshold",
    )


def detection_rate(
    positives: DataFrame, keys: Sequence[str], threshold: float = L.DETECT_THRESHOLD
) -> DataFrame:
    hit = F.when(F.col("score") >= threshold, 1.0).otherwise(0.0)
    return positives.groupBy(*keys).agg(
        F.count("*").alias("n_phish"), F.avg(hit).alias("detection_rate")
    )


def cv_summary(per_fold: DataFrame, keys: Sequence[str] = ("model",), metrics: Sequence[str] = L.METRICS) -> DataFrame:
    """Mean and sample deviation over folds, one row per (model, metric)."""
    tall = per_fold.unpivot(list(keys), list(metrics), "metric", "value")
    return tall.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )


def drop_summary(curve: DataFrame, keys: Sequence[str], metric: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Metric at the clean and the most severe point, and their difference."""
    sev = F.col("severity").cast("double")
    at_lo = F.max(F.when(sev == lo, F.col(metric)))
    at_hi = F.max(F.when(sev == hi, F.col(metric)))
    return curve.groupBy(*keys).agg(
        at_lo.alias("clean"), at_hi.alias("severe"), (at_hi - at_lo).alias("change")
    )


def robust_verdict(drops: DataFrame, limit: float = L.ROBUST_DROP) -> DataFrame:
    return drops.withColumn(
        "verdict", F.when(F.abs("change") < limit, "robust").otherwise("degrades")
    )


def in_order(curve: DataFrame, keys: Sequence[str], place: str | None = None) -> DataFrame:
    """A curve or id list sorted by its keys; with `place`, also each row's place. Ranges are
    sorted apart and numbered by the totals below, so that long lists may be sorted too."""
    if place is None:
        return curve.orderBy(*keys)
    key = F.struct(*keys)
    ranked = running(sliced(curve.withColumns({"score": key, "_n": F.lit(1)}), []), [], "_n", (place, "_all"))
    return ranked.drop("score", "_n", "_all", "_slice").orderBy(*keys)


def curve_pivot(
    curve: DataFrame, keys: Sequence[str], metric: str, grid: Sequence[float] = L.SEVERITIES
) -> DataFrame:
    """Severities as columns s000 ... s100; the grid is given, so no extra pass finds it."""
    sev = F.col("severity").cast("double")
    cols = [
        F.max(F.when(sev == s, F.col(metric))).alias(f"s{round(s * 100):03d}") for s in grid
    ]
    return curve.groupBy(*keys).agg(*cols)


def side_by_side(
    left: DataFrame, right: DataFrame, keys: Sequence[str], metric: str, names: tuple[str, str]
) -> DataFrame:
    a = left.select(*keys, F.col(metric).alias(names[0]))
    b = right.select(*keys, F.col(metric).alias(names[1]))
    return a.join(b, list(keys)).withColumn("delta", F.col(names[1]) - F.col(names[0]))
