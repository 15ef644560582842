"""How many rewrites are still valid, under either definition."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.functions import text as X
from steadfast.operators import rewrites as R

DEFINITIONS = {"strict": "retained_urls", "primary": "retained_primary"}


def _tall(judged: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per (record, definition); the two verdicts are unfolded in place."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("definition"), F.col(column).alias("retained"))
        for name, column in DEFINITIONS.items()
    ])
    return judged.select(
        "original_id", "severity", "refused", *extra, F.explode(pairs).alias("_d")
    ).select("original_id", "severity", "refused", *extra, "_d.definition", "_d.retained")


def retention_funnel(judged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """pass / fail / manual / refused / total per (keys, definition, severity)."""
    return R.retention_summary(_tall(judged, keys), [*keys, "definition", "severity"], "retained")


def retention_definitions(
    judged: DataFrame, keys: Sequence[str] = (), severities: Sequence[float] = L.REWRITE_SEVERITIES
) -> DataFrame:
    """The funnel plus, per definition, the number of ids valid at every severity."""
    tall = _tall(judged, keys)
    both = R.intersection_ids(tall, R.is_valid("retained"), [*keys, "definition", "original_id"], severities)
    sizes = both.groupBy(*keys, "definition").agg(F.count("*").alias("_size"))
    funnel = R.retention_summary(tall, [*keys, "definition", "severity"], "retained")
    return funnel.join(sizes, [*keys, "definition"], "left").withColumn(
        "intersection_all_sev", F.coalesce("_size", F.lit(0))
    ).drop("_size")


def definition_delta(judged: DataFrame, keys: Sequence[str] = ("era",)) -> DataFrame:
    """Ids gained by the primary definition, by era."""
    with_era = judged.withColumn("era", X.era_of(F.col("original_id")))
    tall = _tall(with_era, keys)
    ids = R.intersection_ids(tall, R.is_valid("retained"), [*keys, "definition", "original_id"])
    sizes = ids.groupBy(*keys).agg(
        F.count_if(F.col("definition") == "strict").alias("strict"),
        F.count_if(F.col("definition") == "primary").alias("primary"),
    )
    return sizes.withColumn("delta", F.col("primary") - F.col("strict"))
