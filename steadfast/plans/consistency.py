"""One table that says whether the published reports agree with the data."""

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.operators.quality import as_checks, expected_size, label_invariants


def consistency_report(emails: DataFrame, reports: Mapping[str, tuple[DataFrame, str, int]], train_rows: int | None = None) -> DataFrame:
    """Label invariants, split sizes, and expected sizes of the given reports
    (name -> table, column, expected value)."""
    sizes = emails.agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test")
    )
    checks = [("has_test_split", F.col("test") > 0, F.col("test"))]
    if train_rows is not None:
        checks.append(("train_rows", F.col("train") == train_rows, F.col("train")))
    out = label_invariants(emails).unionByName(as_checks(sizes, checks))
    for name, (table, column, expected) in reports.items():
        out = out.unionByName(expected_size(table, name, column, expected))
    return out
