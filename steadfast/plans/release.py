"""Shareable copies of the data: every URL defanged."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.functions import text as X
from steadfast.operators.rewrites import with_verdicts


def release_emails(emails: DataFrame) -> DataFrame:
    safe = {c: X.defang(F.col(c)) for c in ("subject", "body", "text")}
    return emails.withColumns(safe).select(
        "id", "label", "source", "split", "original_id", "had_html", "subject", "body", "text"
    )


def release_rewrites(rewrites: DataFrame, originals: DataFrame) -> DataFrame:
    """Both verdicts are recomputed against the originals; an unknown id counts as an empty
    original."""
    base = originals.select("original_id", F.col("text").alias("_known"))
    recorded = ["n_orig_urls", "retained_urls", "refused"]
    joined = rewrites.join(base, "original_id", "left").withColumn("original_text", X.or_empty(F.col("_known")))
    kept = joined.withColumnsRenamed({c: f"_{c}" for c in recorded})
    judged = with_verdicts(kept)
    return judged.select(
        "original_id", "source", "severity", "provider", "model", "temperature",
        F.coalesce("_refused", F.lit(False)).alias("refused"), F.col("_n_orig_urls").alias("n_orig_urls"),
        F.col("_retained_urls").alias("retained_urls_strict"),
        F.col("retained_primary").alias("retained_urls_primary"), "n_primary_urls",
        X.defang(F.col("rewrite_subject")).alias("rewrite_subject"),
        X.defang(F.col("rewrite_body")).alias("rewrite_body"),
        X.defang(F.col("rewrite_text")).alias("rewrite_text"),
    )


def defang_audit(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Where defanging is not the identity after restoring, or leaves a live scheme."""
    safe = df.select(id_col, text_col, X.defang(F.col(text_col)).alias("safe"))
    return safe.select(
        id_col, "safe", (X.refang(F.col("safe")) == F.col(text_col)).alias("roundtrip_ok"),
        X.live_scheme_left(F.col("safe")).alias("live_scheme_left"),
    )


def write_release(emails: DataFrame, rewrites: DataFrame, path: str, format: str = "parquet") -> None:
    emails.write.mode("overwrite").partitionBy("split").format(format).save(f"{path}/emails")
    rewrites.write.mode("overwrite").format(format).save(f"{path}/rewrites")
