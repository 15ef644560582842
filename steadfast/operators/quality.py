"""Data-quality checks, each a (check, ok, detail) row."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_checks(one_row: DataFrame, checks: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Turn a single row of counts into check rows."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("check"), ok.alias("ok"), d.cast("string").alias("detail"))
        for n, ok, d in checks
    ])
    return one_row.select(F.explode(rows).alias("_c")).select("_c.*")


def label_invariants(df: DataFrame, max_ratio: float = 3.0) -> DataFrame:
    """Labels binary, one label per source, negatives outnumber positives by the expected
    factor, ids unique, split values known. Per-source label ranges are combined first, so
    the final aggregate is over one row per source."""
    label, split = F.col("label"), F.col("split")
    per_source = df.groupBy("source").agg(
        F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.count_if(~label.isin(0, 1) | label.isNull()).alias("bad_label"),
        F.count_if(label == 1).alias("pos"), F.count_if(label == 0).alias("neg"),
        F.count_if(~split.isin("train", "test") | split.isNull()).alias("bad_split"),
    )
    totals = per_source.agg(
        F.sum("n").alias("n"), F.sum("bad_label").alias("bad_label"), F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"), F.sum("bad_split").alias("bad_split"),
        F.count_if(F.col("lo") != F.col("hi")).alias("mixed"),
    )
    repeated = (
        df.groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") > 1)
        .agg(F.count("*").alias("repeated"))
    )
    unique = as_checks(repeated, [("ids_unique", F.col("repeated") == 0, F.col("repeated"))])
    return as_checks(totals, [
        ("labels_binary", F.col("bad_label") == 0, F.col("bad_label")),
        ("one_label_per_source", F.col("mixed") == 0, F.col("mixed")),
        ("negatives_outnumber", F.col("neg") > F.col("pos") * max_ratio, F.concat_ws(":", F.col("pos"), F.col("neg"))),
        ("split_values", F.col("bad_split") == 0, F.col("bad_split")),
    ]).unionByName(unique)


def leakage_check(df: DataFrame, key: str) -> DataFrame:
    """How many key values occur in both splits."""
    sides = df.groupBy(key).agg(
        F.bit_or(F.when(F.col("split") == "train", 1).when(F.col("split") == "test", 2).otherwise(0)).alias("sides")
    )
    return sides.agg(
        F.count("*").alias("keys"), F.count_if(F.col("sides") == 3).alias("in_both")
    )


def expected_size(df: DataFrame, name: str, column: str, expected: int) -> DataFrame:
    """All rows of a report carry the same expected size."""
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    ok = F.coalesce((F.col("lo") == expected) & (F.col("hi") == expected), F.lit(False))
    return as_checks(row, [(name, ok, F.concat_ws("..", "lo", "hi"))])
