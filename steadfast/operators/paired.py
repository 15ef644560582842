"""Paired comparison of the same rows at two severities."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.schemas import severity_key


def paired_outcomes(
    scores: DataFrame, cell: Sequence[str], row_id: str = "row_id", lo: float = 0.0,
    hi: float = 1.0, threshold: float = L.DETECT_THRESHOLD,
) -> DataFrame:
    """(cell, row, d0, d1): detected at the low and at the high severity. One aggregate
    instead of a self-join; rows scored at only one of the two drop out."""
    sev = severity_key(F.col("severity"))
    found = (F.col("score") >= threshold).cast("int")

    def at(level):
        return F.max(F.when(sev == F.lit(f"{level:.2f}").cast("decimal(3,2)"), found))

    return (
        scores.groupBy(*cell, row_id).agg(at(lo).alias("d0"), at(hi).alias("d1"))
        .where(F.col("d0").isNotNull() & F.col("d1").isNotNull())
    )


def mcnemar_counts(outcomes: DataFrame, cell: Sequence[str]) -> DataFrame:
    d0, d1 = F.col("d0"), F.col("d1")
    counts = outcomes.groupBy(*cell).agg(
        F.count("*").alias("n"), F.sum(d0).alias("_det0"), F.sum(d1).alias("_det1"),
        F.count_if((d0 == 1) & (d1 == 0)).alias("mcnemar_b_lost"),
        F.count_if((d0 == 0) & (d1 == 1)).alias("mcnemar_c_gained"),
    )
    det0, det1 = F.col("_det0") / F.col("n"), F.col("_det1") / F.col("n")
    return counts.select(
        *cell, "n", det0.alias("det_sev0"), det1.alias("det_sev1"),
        ((F.col("_det0") - F.col("_det1")) / F.col("n")).alias("effect_drop"),
        "mcnemar_b_lost", "mcnemar_c_gained",
    )


SHIFT = 10


def ln_factorial(n: Column) -> Column:
    """Stirling's series at an argument moved up by SHIFT, where it is good to full precision,
    less the logs of the factors that this adds: one formula for every n."""
    n = n.cast("double")
    x = n + (SHIFT + 1.0)
    series = 1.0 / (12.0 * x) - 1.0 / (360.0 * F.pow(x, F.lit(3.0))) + 1.0 / (1260.0 * F.pow(x, F.lit(5.0)))
    series = series - 1.0 / (1680.0 * F.pow(x, F.lit(7.0)))
    added = sum((F.log(n + i) for i in range(2, SHIFT + 1)), F.log(n + 1.0))
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - added


def exact_mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided binomial p at one half, from the discordant counts. The tail is summed
    outward from its largest term; terms more than ten standard deviations out are below
    the last digit of a double, so the sum stays short however large the counts are."""
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    ln_choose = ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)
    reach = F.least(k, F.ceil(10.0 * F.sqrt(n.cast("double"))).cast("long") + 64)
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(reach - 1, F.lit(0).cast("long"))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * F.greatest(k - i, F.lit(0)) / (n - k + i + 1)).alias("term"),
            (acc["total"] + acc["term"] * F.greatest(k - i, F.lit(0)) / (n - k + i + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    p = 2.0 * F.exp(ln_choose - n * math.log(2.0)) * tail
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), p))


def mcnemar_test(outcomes: DataFrame, cell: Sequence[str]) -> DataFrame:
    return mcnemar_counts(outcomes, cell).withColumn(
        "mcnemar_exact_p", exact_mcnemar_p(F.col("mcnemar_b_lost"), F.col("mcnemar_c_gained"))
    )


def significant_cells(tests: DataFrame, keys: Sequence[str] = ("training",), alpha: float = L.ALPHA) -> DataFrame:
    return tests.groupBy(*keys).agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("mcnemar_exact_p") < alpha).alias("significant"),
    )
