"""Incremental form of the resumable rewrite log: new files are judged as they arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfast.operators.rewrites import with_verdicts
from steadfast.schemas import REWRITE

RECORDED = ("refused", "n_orig_urls", "missing_urls", "retained_urls")


def judge(batch: DataFrame, originals: DataFrame) -> DataFrame:
    """The batch operator, applied to whatever rows arrived."""
    base = originals.select("original_id", F.col("text").alias("original_text"))
    rows = batch.drop(*RECORDED).join(base, "original_id", "left")
    return with_verdicts(rows).drop("original_text")


def stream_verdicts(spark: SparkSession, log: str, originals: DataFrame, out: str, checkpoint: str):
    """Start the stream. Each micro-batch owns one output folder, so a replayed batch
    overwrites itself and no record is written twice."""
    source = spark.readStream.schema(REWRITE).json(log)

    def write(batch: DataFrame, batch_id: int) -> None:
        judge(batch, originals).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
