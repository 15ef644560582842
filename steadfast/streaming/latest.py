"""Last write wins as a stream: the rewrite log is followed file by file, and the last record of each key
is held in a state store.

Records come in any order. One counts as later if its time is later or, at equal times, its content is
greater, so late, repeated and replayed records change nothing, and the outcome doesn't depend on how
the log was cut into files or micro-batches. A key whose last record changes is written again; each
micro-batch owns one folder, so a replayed batch overwrites itself. State is one record a key, in
RocksDB under the checkpoint: it is on disk, and a lost executor's part is rebuilt from there.
"""

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from steadfast.operators.rewrites import latest_rewrites
from steadfast.schemas import REWRITE

# Workers get the processor with the task, whether or not they can import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ("original_id", "severity")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What travels and is kept beside the key: the time in microseconds, and the record as JSON.
HELD = "micros long, record string"


class LastWrite(StatefulProcessor):
    """Emits a key's record whenever a later one has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", HELD)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        kept = self.last.get()
        best = old = None if kept is None else (kept[0], kept[1])
        for frame in rows:  # in chunks: a key may be written very often
            for row in zip(frame["micros"], frame["record"]):
                row = (int(row[0]), row[1])
                if best is None or row > best:
                    best = row
        if best != old:
            self.last.update(best)
            yield pd.DataFrame({"_k0": [key[0]], "_k1": [key[1]], "micros": [best[0]], "record": [best[1]]})

    def close(self) -> None:
        pass


def follow(spark: SparkSession, log: str, out: str, checkpoint: str, files_a_batch: int = 1000):
    """Start the stream over what the log holds; started again, it goes on with new files."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    records = spark.readStream.schema(REWRITE).option("maxFilesPerTrigger", files_a_batch).json(log).where(F.col("original_id").isNotNull())
    keyed = records.select(
        F.col("original_id").alias("_k0"), F.coalesce(F.format_string("%.2f", "severity"), F.lit("")).alias("_k1"),
        F.coalesce(F.unix_micros("ts"), F.lit(-(2**63))).alias("micros"), F.to_json(F.struct(*REWRITE.names)).alias("record"))
    last = keyed.groupBy("_k0", "_k1").transformWithStateInPandas(
        statefulProcessor=LastWrite(), outputStructType=f"_k0 string, _k1 string, {HELD}", outputMode="Update", timeMode="None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return last.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, out: str, columns: Sequence[str] = REWRITE.names) -> DataFrame:
    """The last record of every key as far as the stream has come."""
    written = spark.read.schema(f"_k0 string, _k1 string, {HELD}, batch long").parquet(out)
    last = latest_rewrites(written, ("_k0", "_k1"), ("micros", "record"))
    return last.dropDuplicates(["_k0", "_k1"]).select(F.from_json("record", REWRITE).alias("r")).select(*[f"r.{c}" for c in columns])
