"""Bootstrap intervals and permutation tests for data spread over a cluster.

Each (row, replicate) gets an independent unit-rate Poisson weight computed from hashes.
This is the usual stand-in for drawing n of n rows with replacement when the rows are not
in one place: it needs no shared state, and a retried task draws the same weights.
"""

import hashlib
import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.functions import hashing as H
from steadfast.operators.metrics import running, sliced
from steadfast.operators.paired import ln_factorial
from steadfast.operators.support import pinned

REPLICATE_TYPE = "array<struct<replicate:int,a:bigint,b:bigint,c:bigint>>"


def coefficients(seed, n: int) -> list[tuple[int, int, int, int]]:
    """(replicate, a, b, c) for `hashing.replicate_uniform`; a list the size of n."""
    out = []
    for r in range(1, n + 1):
        text = hashlib.md5(f"{seed}|replicate|{r}".encode()).hexdigest()
        out.append((r, *(int(text[i:i + 8], 16) % H.MODULUS for i in (0, 8, 16))))
    return out


def replicates(seed, n: int) -> Column:
    """The replicate list as one constant column, to be exploded in place."""
    rows = [dict(zip(("replicate", "a", "b", "c"), row)) for row in coefficients(seed, n)]
    return F.from_json(F.lit(json.dumps(rows)), REPLICATE_TYPE)


def poisson_weight(u: Column) -> Column:
    weight = F.lit(0)
    for step in L.POISSON_CDF:
        weight = weight + F.when(u >= step, 1).otherwise(0)
    return weight


def _counts(outcomes: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Rows, lost and gained detections per cell: all that the paired statistics depend on."""
    d0, d1 = F.col("d0"), F.col("d1")
    return outcomes.groupBy(*cell).agg(
        F.count("*").alias("n"), F.count_if((d0 == 1) & (d1 == 0)).alias("b"), F.count_if((d0 == 0) & (d1 == 1)).alias("c")
    )


def _drawn(laws: DataFrame, chance: Column, keys: Sequence[str], n: int, seed) -> DataFrame:
    """(keys, replicate, value): n draws from each row's law on lo..hi, where `chance` is the
    probability of `k`. Points of the distribution function and uniforms are put in one order;
    a draw's value is the number of points up to it. So the cost is that of the points (some
    deviations of the law) and draws, whatever the number of rows behind them."""
    along = Window.partitionBy(*keys)
    points = (
        laws.withColumn("k", F.explode(F.sequence("lo", "hi")))
        .withColumn("_p", F.sum(chance).over(along.orderBy("k")))
        .select(*keys, "lo", "_p", F.lit(None).cast("int").alias("replicate"), F.lit(1).alias("_step"))
    )
    draws = laws.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(
        *keys, "lo", H.uniform(seed, *[F.col(k) for k in keys[:-1]], F.col("replicate"), F.col(keys[-1])).alias("_p"),
        "replicate", F.lit(0).alias("_step"),
    )
    upto = along.orderBy("_p", F.desc("_step")).rowsBetween(Window.unboundedPreceding, 0)
    both = points.unionByName(draws).withColumn("value", F.col("lo") + F.sum("_step").over(upto))
    return both.where(F.col("replicate").isNotNull()).select(*keys, "replicate", "value")


#: How far from its mean a law is followed: tails beyond are below the uniforms' resolution.
DEVIATIONS = 12


def paired_bootstrap(
    outcomes: DataFrame, cell: Sequence[str], n: int = L.N_BOOTSTRAP, ci: float = L.CI_LEVEL, seed=L.SEED,
) -> DataFrame:
    """Percentile interval of the mean drop d0 - d1. Unit-rate Poisson weights of rows that
    count alike add up to one Poisson number, so a replicate draws three numbers a cell."""
    parts = F.array(*[
        F.struct(F.lit(name).alias("part"), value.cast("double").alias("mean"))
        for name, value in (("b", F.col("b")), ("c", F.col("c")), ("r", F.col("n") - F.col("b") - F.col("c")))
    ])
    mean, k = F.col("mean"), F.col("k")
    reach = DEVIATIONS * F.sqrt(mean)
    laws = _counts(outcomes, cell).select(*cell, F.inline(parts)).withColumns({
        "lo": F.greatest(F.lit(0), F.floor(mean - reach - DEVIATIONS)).cast("long"), "hi": F.ceil(mean + reach + 40).cast("long"),
    })
    chance = F.when(mean == 0, (k == 0).cast("double")).otherwise(F.exp(k * F.log(mean) - mean - ln_factorial(k)))
    drawn = _drawn(laws, chance, [*cell, "part"], n, seed)
    of = lambda name: F.sum(F.when(F.col("part") == name, F.col("value")))
    means = drawn.groupBy(*cell, "replicate").agg(
        ((of("b") - of("c")) / F.nullif(F.sum("value").cast("double"), F.lit(0.0))).alias("mean")
    )
    a = (1 - ci) / 2
    return means.groupBy(*cell).agg(
        F.percentile("mean", F.lit(a)).alias("drop_lo"),
        F.percentile("mean", F.lit(1 - a)).alias("drop_hi"),
    )


def permutation_test(
    outcomes: DataFrame, cell: Sequence[str], n: int = L.N_PERMUTATIONS, seed=L.SEED + 1,
) -> DataFrame:
    """Sign-flip p-value. Only discordant rows move the statistic, and flipping m signs is one
    binomial number, so a permutation draws a single number a cell."""
    counts = _counts(outcomes, cell).withColumns({"m": F.col("b") + F.col("c"), "seen": F.abs(F.col("b") - F.col("c")), "part": F.lit("m")})
    m, k = F.col("m"), F.col("k")
    reach = DEVIATIONS * F.sqrt(m.cast("double")) / 2 + DEVIATIONS
    laws = counts.withColumns({
        "lo": F.greatest(F.lit(0), F.floor(m / 2 - reach)).cast("long"), "hi": F.least(m, F.ceil(m / 2 + reach)).cast("long"),
    })
    keys = [*cell, "seen", "m"]
    chance = F.exp(ln_factorial(m) - ln_factorial(k) - ln_factorial(m - k) - m * math.log(2))
    drawn = _drawn(laws.select(*keys, "part", "lo", "hi"), chance, [*keys, "part"], n, seed)
    hits = F.count_if(F.abs(2 * F.col("value") - m) >= F.col("seen"))
    return drawn.groupBy(*cell).agg(((hits + 1) / F.lit(n + 1.0)).alias("perm_p_value"))


# ------------------------------------------------------------------ metric intervals
ROWS_PER_SLICE = 200_000
#: Weights (rows x replicates) that a slice's worker draws at once.
NUMBERS_AT_ONCE = 1_000_000
#: The label of rows that tell a slice what lies above it, one for each of its cells.
OFFSETS = 2


def _replicate_sums(coefs, cdf, modulus, group, cell, threshold):
    """Per-slice worker: weighted counts of one score slice for every replicate. Returns a
    function for applyInPandas; the slice is bounded by the bucket cuts."""

    def slice_sums(key, rows):
        import numpy as np
        import pandas as pd

        width = len(group) + 4
        out = []

        def same_nan(values):
            return tuple("nan" if v != v else v for v in values)

        offsets = {}
        if "_pos_above" in rows:
            given, rows = rows[rows["label"] == OFFSETS], rows[rows["label"] != OFFSETS]
            known = zip(*(given[c] for c in cell)) if len(cell) else [()] * len(given)
            offsets = dict(zip(map(same_nan, known), zip(given["_pos_above"], given["_neg_above"])))
        rows = rows.sort_values("score", kind="stable")
        is_neg = rows["label"].to_numpy() == 0
        neg, pos = rows[is_neg], rows[~is_neg]
        neg_score = neg["score"].to_numpy()
        cells = list(pos.groupby(list(cell), sort=False, dropna=False)) if len(cell) else [((), pos)]

        def weights(frame, part):
            h1 = frame["_h1"].to_numpy()[:, None]
            h2 = frame["_h2"].to_numpy()[:, None]
            u = ((part[:, 1] * h1 + part[:, 2] * h2 + part[:, 3]) % modulus) / float(modulus)
            return np.searchsorted(cdf, u, side="right")

        def add(cell_values, part, **sums):
            frame = pd.DataFrame({"replicate": part[:, 0].astype("int32"), **sums})
            for name, value in zip(cell, cell_values):
                frame[name] = pd.Series([value] * len(frame), dtype=object)
            out.append(frame)

        step = max(1, NUMBERS_AT_ONCE // max(1, len(rows)))
        for start in range(0, len(coefs), step):
            part = coefs[start:start + step]
            w_neg = weights(neg, part)
            hit = (neg_score >= threshold)[:, None]
            hit_fpr = (neg_score >= neg["fpr_threshold"].to_numpy())[:, None] if len(neg) else hit
            run = np.vstack([np.zeros((1, len(part)), dtype="int64"), np.cumsum(w_neg, axis=0)])
            n_neg = run[-1]
            zero = np.zeros(len(part))
            add([None] * len(cell), part, pos=zero, neg=n_neg.astype(float), tp=zero,
                fp=(w_neg * hit).sum(axis=0).astype(float), tp_fpr=zero, pairs=zero, steps=zero)
            for values, frame in cells:
                if not len(frame):
                    continue
                values = values if isinstance(values, tuple) else (values,)
                score = frame["score"].to_numpy()
                w = weights(frame, part)
                below = run[np.searchsorted(neg_score, score, side="left")]
                upto = run[np.searchsorted(neg_score, score, side="right")]
                pairs = (w * (below + upto) / 2.0).sum(axis=0)
                offset = offsets.get(same_nan(values))
                total = w.sum(axis=0)
                if offset is None:
                    pos_above = neg_above = 0.0
                else:
                    pos_above, neg_above = (np.asarray(o)[start:start + len(part)] for o in offset)
                cum = np.cumsum(w, axis=0)
                before = np.vstack([np.zeros((1, len(part)), dtype="int64"), cum])
                first = np.searchsorted(score, score, side="left")
                tp = pos_above + total - before[first]
                fp = neg_above + n_neg - below
                steps = (w * np.divide(tp, tp + fp, out=np.zeros_like(tp, dtype=float), where=(tp + fp) > 0)).sum(axis=0)
                add(values, part, pos=total.astype(float), neg=zero,
                    tp=(w * (score >= threshold)[:, None]).sum(axis=0).astype(float), fp=zero,
                    tp_fpr=(w * (score >= frame["fpr_threshold"].to_numpy())[:, None]).sum(axis=0).astype(float),
                    pairs=pairs, steps=steps)
        result = pd.concat(out, ignore_index=True)
        for name, value in zip(("_one", *group, "_bucket", "_heavy", "_salt"), key):
            result[name] = value
        return result

    return slice_sums


def bootstrap_cis(
    positives: DataFrame, negatives: DataFrame, group: Sequence[str], cell: Sequence[str] = ("severity",),
    row_id: Sequence[str] = ("row_id",), n: int = L.N_BOOTSTRAP, ci: float = L.CI_LEVEL,
    threshold: float = L.DETECT_THRESHOLD, thresholds: DataFrame | None = None, seed=L.SEED,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Percentile intervals of roc_auc, pr_auc, f1, precision, recall and recall_fpr.

    Rows are cut into score slices; a score so frequent that it fills a slice gets its own,
    split further by salt. Each slice is reduced to one line per replicate, so what is
    shuffled afterwards is slices x replicates, not rows x replicates.
    """
    spark = positives.sparkSession
    keys = ["_one", *group]
    slot = [*keys, "_bucket", "_heavy", "_salt"]
    h1, h2 = H.row_hashes(seed, *[F.col(c) for c in row_id])

    def narrow(df, label):
        cells = [F.col(c) if label else F.lit(None).cast(positives.schema[c].dataType).alias(c) for c in cell]
        return df.select(
            F.lit(0).alias("_one"), *group, *cells, F.lit(label).alias("label"), "score",
            h1.alias("_h1"), h2.alias("_h2"),
        )

    rows = narrow(positives, 1).unionByName(narrow(negatives, 0))
    if thresholds is not None:
        rows = rows.join(thresholds.withColumn("_one", F.lit(0)), keys)
    else:
        rows = rows.withColumn("fpr_threshold", F.lit(threshold))
    rows = rows.join(_slices(rows, keys, rows_per_slice), [*keys, "score"]).withColumn(
        "_salt", (F.col("_h1") % F.col("_repeats")).cast("int")
    ).drop("_repeats")

    import numpy as np

    coefs = np.array(coefficients(seed, n), dtype="int64")
    cdf = np.array(L.POISSON_CDF)
    shape = {f.name: f.dataType for f in rows.schema.fields}
    sums = ("pos", "neg", "tp", "fp", "tp_fpr", "pairs", "steps")
    from pyspark.sql import types as T

    out_type = T.StructType(
        [T.StructField(c, shape[c]) for c in slot] + [T.StructField(c, shape[c]) for c in cell]
        + [T.StructField("replicate", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in sums]
    )
    worker = _replicate_sums(coefs, cdf, H.MODULUS, tuple(group), tuple(cell), threshold)
    part = rows.groupBy(*slot).applyInPandas(worker, out_type)
    per_bucket = part.groupBy(*keys, "_bucket", "_heavy", *cell, "replicate").agg(
        *[F.sum(c).alias(c) for c in sums]
    )
    per_bucket = _stitch(rows, part, per_bucket, worker, out_type, keys, slot, cell, sums)
    return _intervals(per_bucket, keys, group, cell, ci)


def _slices(rows: DataFrame, keys, rows_per_slice: int) -> DataFrame:
    """Per (keys, score): its slice, whether the score fills one alone, and into how many
    parts such a score is split. A slice begins every `rows_per_slice` rows of a group, so
    its size doesn't depend on the group's."""
    hist = sliced(rows.groupBy(*keys, "score").agg(F.count("*").alias("_n")), keys)
    ranked = running(hist, keys, "_n", ("_le", "_all"))
    return pinned(ranked.select(
        *keys, "score", F.floor((F.col("_le") - F.col("_n")) / rows_per_slice).cast("int").alias("_bucket"),
        (F.col("_n") > rows_per_slice).alias("_heavy"), F.ceil(F.col("_n") / rows_per_slice).alias("_repeats"),
    ))


def _order(bucket="_bucket", heavy="_heavy"):
    """A heavy score closes its bucket: everything else in the bucket is smaller."""
    return F.col(bucket) * 2 + F.col(heavy).cast("int")


def _stitch(rows, part, per_bucket, worker, out_type, keys, slot, cell, sums):
    """Add what lies outside each slice: negatives below (for pairs) and counts above (for
    precision steps, whose second pass redraws the same weights)."""
    table = pinned(per_bucket.withColumn("_at", _order()))
    is_pos = F.lit(True)
    for c in cell:
        is_pos = is_pos & F.col(c).isNotNull()
    neg = table.groupBy(*keys, "_at", "replicate").agg(F.sum("neg").alias("bucket_neg"))
    up = Window.partitionBy(*keys, "replicate").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "replicate")
    neg = neg.withColumn("neg_below", F.sum("bucket_neg").over(up) - F.col("bucket_neg")).withColumn(
        "neg_above", F.sum("bucket_neg").over(whole) - F.col("neg_below") - F.col("bucket_neg")
    )
    cells = Window.partitionBy(*keys, *cell, "replicate")
    pos = table.where(F.col("pos") >= 0).where(is_pos).withColumn(
        "pos_above",
        F.sum("pos").over(cells)
        - F.sum("pos").over(cells.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)),
    )
    full = pos.join(neg, [*keys, "_at", "replicate"])
    # Heavy slices hold one score: closed forms. Light slices: second pass with offsets.
    own = F.col("pos_above") + F.col("pos")
    against = F.col("neg_above") + F.col("bucket_neg")
    heavy_steps = F.col("pos") * F.coalesce(own / F.nullif(own + against, F.lit(0.0)), F.lit(0.0))
    inside = F.when(F.col("_heavy"), F.col("pos") * F.col("bucket_neg") / 2.0).otherwise(F.col("pairs"))
    full = full.withColumns({
        "pairs": inside + F.col("pos") * F.col("neg_below"), "_heavy_steps": heavy_steps,
    })
    offsets = full.where(~F.col("_heavy")).groupBy(*keys, "_bucket", "_heavy", *cell).agg(
        F.sort_array(F.collect_list(F.struct("replicate", "pos_above", "neg_above"))).alias("_o")
    ).select(
        *keys, "_bucket", "_heavy", *cell, F.transform("_o", lambda o: o["pos_above"]).alias("_pos_above"),
        F.transform("_o", lambda o: o["neg_above"]).alias("_neg_above"),
    )
    light = rows.where(~F.col("_heavy"))
    # Offsets are as long as there are replicates: a slice gets them once for each cell, not with every row.
    none = {c: F.lit(None).cast("array<double>") for c in ("_pos_above", "_neg_above")}
    filled = {c: F.lit(0) for c in rows.columns if c not in (*keys, "_bucket", "_heavy", *cell)}  # a null would make hashes floats
    marks = offsets.withColumns({**filled, "label": F.lit(OFFSETS)}).select(
        *[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], *none)
    again = (
        light.withColumns(none).unionByName(marks).groupBy(*slot).applyInPandas(worker, out_type).where(is_pos)
        .groupBy(*keys, "_bucket", "_heavy", *cell, "replicate").agg(F.sum("steps").alias("_light_steps"))
    )
    joined = full.join(again, [*keys, "_bucket", "_heavy", *cell, "replicate"], "left").withColumn(
        "steps", F.when(F.col("_heavy"), F.col("_heavy_steps")).otherwise(F.coalesce("_light_steps", F.lit(0.0)))
    )
    columns = [*keys, "_bucket", "_heavy", *cell, "replicate", *sums]
    negatives = table.where(~is_pos).select(*columns)
    return joined.select(*columns).unionByName(negatives)


def _intervals(per_bucket, keys, group, cell, ci):
    sums = per_bucket.groupBy(*keys, *cell, "replicate").agg(
        *[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp", "tp_fpr", "pairs", "steps")]
    )
    present = F.lit(True)
    for c in cell:
        present = present & F.col(c).isNotNull()
    if cell:
        neg = sums.where(~present).select(*keys, "replicate", F.col("neg").alias("_n"), F.col("fp").alias("_f"))
        pos = sums.where(present)
        both = pos.join(neg, [*keys, "replicate"])
    else:
        both = sums.withColumns({"_n": F.col("neg"), "_f": F.col("fp")})
    p, n, tp, fp = F.col("pos"), F.col("_n"), F.col("tp"), F.col("_f")
    values = both.where((p > 0) & (n > 0)).select(
        *group, *cell,
        (F.col("pairs") / (p * n)).alias("roc_auc"), (F.col("steps") / p).alias("pr_auc"),
        F.coalesce(2 * tp / F.nullif(tp + fp + p, F.lit(0.0)), F.lit(0.0)).alias("f1"),
        F.coalesce(tp / F.nullif(tp + fp, F.lit(0.0)), F.lit(0.0)).alias("precision"),
        (tp / p).alias("recall"), (F.col("tp_fpr") / p).alias("recall_fpr"),
    )
    a = (1 - ci) / 2
    cols = []
    for m in (*L.METRICS, "recall_fpr"):
        cols += [F.percentile(m, F.lit(a)).alias(f"{m}_lo"), F.percentile(m, F.lit(1 - a)).alias(f"{m}_hi")]
    return values.groupBy(*group, *cell).agg(*cols)
