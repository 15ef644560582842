"""What the operators of this folder share: reading, folds, written side tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfast.operators.support import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, column: str = "doc_id"):
    """crc32 of an id's decimal text, modulo `modulus`. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as `spark.checkpoint.dir` names it. Where it is unset,
    a local session has a folder of its own; a cluster has none, which is an error."""
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, a lost executor
    costs nothing that is written, and later readers take only the columns they need."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: the join is by sorting, with both sides shuffled. Else Spark
    may broadcast it through the driver, as it takes files of packed numbers, and what Python or an explode
    makes of a row, for much smaller than they are."""
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch, column: str = "text") -> list[str]:
    """A batch's texts; null is the empty text."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def slices(batches, rows: int = 512):
    """Arrow batches in parts of some rows, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
