"""Corpus cleaning: unify, drop low content, keep the first of exact copies."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.functions import hashing as H
from steadfast.functions import text as X
from steadfast.operators.support import pinned


def unify(df: DataFrame) -> DataFrame:
    """text = subject + newline + body, trimmed; absent parts count as empty."""
    return df.withColumns({
        "subject": X.or_empty(F.col("subject")),
        "body": X.or_empty(F.col("body")),
        "text": X.unified_text(F.col("subject"), F.col("body")),
        "had_html": F.coalesce(F.col("had_html"), F.lit(False)),
    })


def attach_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Label and reading rank per source. `labels` has one row per known source (a
    configuration table); rows of unlisted sources are excluded."""
    return df.join(pinned(labels), "source", "inner")


def drop_low_content(df: DataFrame) -> DataFrame:
    return df.where(~X.is_low_content(F.col("subject"), F.col("body")))


def with_dedup_key(df: DataFrame) -> DataFrame:
    return df.withColumn("dedup_key", H.dedup_key(F.col("subject"), F.col("body")))


def first_copies(df: DataFrame, key: str, order: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(key, copies, first order values) per distinct key. Copies are combined before the
    shuffle, so a text repeated a billion times costs one row per map task."""
    first = F.min(F.struct(*order, *carry)).alias("_first")
    return (
        df.groupBy(key).agg(F.count("*").alias("copies"), first)
        .select(key, "copies", "_first.*")
    )


def dedup_first(
    df: DataFrame, key: str = "dedup_key", order: Sequence[str] = ("source_rank", "original_id"),
) -> DataFrame:
    """Keep the first row of each key. The winners are found on narrow rows; the wide rows
    are then matched to them by their own unique order columns, which cannot be skewed."""
    winners = first_copies(df.select(key, *order), key, order).select(*order)
    return df.join(winners, list(order), "left_semi")


def cleaning_funnel(df: DataFrame) -> DataFrame:
    """Per source: parsed, low_content, duplicate, kept. Low content is tested first."""
    low = X.is_low_content(F.col("subject"), F.col("body"))
    flagged = df.select(
        "source", "source_rank", "original_id", low.alias("low"),
        H.dedup_key(F.col("subject"), F.col("body")).alias("key"),
    )
    # Both results below start from this one shuffled table.
    first = F.min(F.struct("source_rank", "original_id")).alias("first")
    per_key = flagged.groupBy("key", "source", "low").agg(F.count("*").alias("n"), first)
    seen = per_key.groupBy("source").agg(
        F.sum("n").alias("parsed"), F.sum(F.when(F.col("low"), F.col("n")).otherwise(0)).alias("low_content")
    )
    winner = F.min(F.when(~F.col("low"), F.struct("first", "source"))).alias("winner")
    kept = (
        per_key.groupBy("key").agg(winner).where(F.col("winner").isNotNull())
        .groupBy(F.col("winner.source").alias("source")).agg(F.count("*").alias("kept"))
    )
    kept_n = F.coalesce("kept", F.lit(0))
    return seen.join(kept, "source", "left").select(
        "source", "parsed", "low_content",
        (F.col("parsed") - F.col("low_content") - kept_n).alias("duplicate"),
        kept_n.alias("kept"),
    )


def class_balance(df: DataFrame) -> DataFrame:
    """Counts by (source, label) and by (split, label) in one pass."""
    return (
        df.groupingSets([["source", "label"], ["split", "label"]], "source", "split", "label")
        .agg(F.count("*").alias("n"), F.grouping("source").alias("_by_split"))
        .select(
            F.when(F.col("_by_split") == 1, "split").otherwise("source").alias("dimension"),
            F.coalesce("source", "split").alias("value"), "label", "n",
        )
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    one = F.lit(1)
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "test").alias("test"),
        F.avg(F.when(F.col("label") == 1, one).otherwise(0)).alias("positive_fraction"),
        F.avg(F.when(F.col("had_html"), one).otherwise(0)).alias("html_fraction"),
    )


def same_year(df: DataFrame, date_col: str, year: int) -> DataFrame:
    """Keep rows whose date reads as the given year; unreadable dates drop out."""
    return df.where(X.mail_year(F.col(date_col)) == year)


def non_empty(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(F.length(F.col(column)) > 0)
