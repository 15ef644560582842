"""Readers and writers of tables: datasets, external corpora, rewrite logs, reports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfast.schemas import EMAIL, EXTERNAL_CSV, REWRITE
from steadfast.sources.quoted import RANGE_BYTES, read_csv


def read_dataset(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The processed table; absent text reads as '' and absent flags as false."""
    if path.rstrip("/").endswith("csv"):
        df = read_csv(spark, path, EMAIL, range_bytes).drop("_file", "index")
    else:
        df = spark.read.parquet(path)
    return df.withColumns({
        "text": F.coalesce("text", F.lit("")), "had_html": F.coalesce("had_html", F.lit(False)),
    })


def read_external(spark: SparkSession, path: str, corpus: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """subject / body / date / label files with a stable original_id corpus:file:position."""
    rows = read_csv(spark, path, EXTERNAL_CSV, range_bytes)
    name = F.element_at(F.split("_file", "/"), -1)
    return rows.select(
        F.concat_ws(":", F.lit(corpus), name, F.col("index").cast("string")).alias("original_id"),
        F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("body", F.lit("")).alias("body"),
        "date", "label",
    )


def read_rewrites(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Rewrite log with the write position (file, block, seq) for last-write-wins. Blank
    lines are skipped. A missing log is an error, or an empty table for a cache."""
    if missing_ok and not _exists(spark, path):
        empty = spark.createDataFrame([], REWRITE)
        return empty.withColumns({"file": F.lit(""), "block": F.lit(0).cast("long"), "seq": F.lit(0).cast("long")})
    rows = spark.read.schema(REWRITE).json(path)
    return rows.select(
        *REWRITE.names, F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"),
    ).where(F.col("original_id").isNotNull())


WRITE_ORDER = ("ts", "file", "block", "seq")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def append_rewrites(df: DataFrame, path: str) -> None:
    df.select(*[c for c in REWRITE.names if c in df.columns]).write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """One small CSV per report. Reports have one row per cell, never one per message."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
