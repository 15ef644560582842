"""Tar archives of messages, read by member ranges and written by task.

A plain archive is split: a first job walks its headers, skipping the contents, and notes where each
range of about RANGE_BYTES begins and ends. The ranges are a small table; a Data Source makes each
of them a partition, whose task seeks to its first header and stops at its end. A compressed archive
can't be entered in the middle: it is one partition, decompressed as a stream. Either way members leave
in batches of at most BATCH_BYTES (or one member), so no row or task ever holds an archive.
"""

import os
import sys
import tarfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from steadfast.operators.support import pinned
from steadfast.schemas import RAW_MESSAGE

# Workers get these helpers with the task, whether or not they can import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 64 * 2**20
BATCH_BYTES = 16 * 2**20
FORMAT = "message_archives"
RANGES = "path string, start long, stop long, globals string, members long"
#: First bytes of the compressed forms that are streamed.
COMPRESSED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00")


def opened(path: str, mode: str = "rb"):
    """A file of any store that Arrow knows; a bare path is a local one."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else "file://" + os.path.abspath(path))
    return store.open_input_file(name) if mode == "rb" else store.open_output_stream(name, compression=None)


def is_message(member: tarfile.TarInfo) -> bool:
    """Regular files count, but for dotfiles."""
    return member.isfile() and not member.name.rsplit("/", 1)[-1].startswith(".")


def ranges_of(path: str, range_bytes: int = RANGE_BYTES) -> Iterator[tuple]:
    """(path, start, stop, globals, members) for the stretches of an archive; one without an end for a
    compressed archive. Headers in force from earlier in the archive go along."""
    import json

    with opened(path) as file:
        head = file.read(6)
        file.seek(0)
        if head.startswith(COMPRESSED):
            yield path, 0, None, "{}", None
            return
        start, members, carried = 0, 0, "{}"
        with tarfile.open(fileobj=file, mode="r:") as tar:
            for member in tar:
                tar.members = []  # nothing is kept of what was passed
                if member.offset - start >= range_bytes and members:
                    yield path, start, member.offset, carried, members
                    start, members, carried = member.offset, 0, json.dumps(tar.pax_headers)
                members += is_message(member)
            if members:
                yield path, start, tar.offset, carried, members


def messages_of(path: str, start: int, stop: int | None, carried: str, prefix: str) -> Iterator[tuple[str, bytes]]:
    """(original_id, raw) of the members whose header lies in a range."""
    import json

    name = path.rstrip("/").rsplit("/", 1)[-1]
    with opened(path) as file:
        if stop is not None:
            file.seek(start)
        with tarfile.open(fileobj=file, mode="r|*" if stop is None else "r:") as tar:
            tar.pax_headers = {**json.loads(carried), **tar.pax_headers}
            for member in tar:
                tar.members = []
                if stop is not None and member.offset >= stop:
                    return
                if is_message(member):
                    yield f"{prefix}:{name}:{member.name}", tar.extractfile(member).read()


class Range(InputPartition):
    def __init__(self, path, start, stop, carried):
        super().__init__((path, start))
        self.path, self.start, self.stop, self.carried = path, start, stop, carried


class Reader(DataSourceReader):
    def __init__(self, options):
        self.ranges, self.prefix = options["ranges"], options.get("prefix", "")

    def partitions(self):
        """One per row of the table of ranges."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(self.ranges if ":" in self.ranges.split("/", 1)[0] else "file://" + os.path.abspath(self.ranges))
        rows = pq.read_table(name, filesystem=store).to_pylist()
        return [Range(r["path"], r["start"], r["stop"], r["globals"]) for r in rows]

    def read(self, partition):
        import pyarrow as pa

        def batch(rows):
            return pa.record_batch([pa.array([i for i, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.binary())],
                                   names=["original_id", "raw"])

        if partition is None:  # what Spark hands over where there are no ranges
            return
        rows, held = [], 0
        for row in messages_of(partition.path, partition.start, partition.stop, partition.carried, self.prefix):
            if rows and held + len(row[1]) > BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[1])
        if rows:
            yield batch(rows)


class ArchiveSource(DataSource):
    """spark.read.format("message_archives").option("ranges", table).option("prefix", p).load()"""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return RAW_MESSAGE

    def reader(self, schema):
        return Reader(self.options)


def archive_ranges(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ranges of all archives; each archive's headers are walked by one task."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string")

    def walk(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                for row in ranges_of(path, range_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (
                        pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["path", "start", "stop", "globals", "members"])

    return listed.repartition(max(1, len(paths)), "path").mapInArrow(walk, RANGES)


def read_archives(spark: SparkSession, paths: list[str], prefix: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(original_id, raw) per message of tar archives, id prefix:archive:member. No archives, no rows."""
    if not paths:
        return spark.createDataFrame([], RAW_MESSAGE)
    spark.dataSource.register(ArchiveSource)
    ranges = pinned(archive_ranges(spark, paths, range_bytes))
    where = ranges.inputFiles()
    if not where:
        return spark.createDataFrame([], RAW_MESSAGE)
    return spark.read.format(FORMAT).option("ranges", where[0].rsplit("/", 1)[0]).option("prefix", prefix).load()


def write_archives(messages: DataFrame, folder: str, compression: str = "") -> DataFrame:
    """Write (member, raw) rows as archives, one per partition, and return what was written: (path,
    members). A task writes under a name of its own, so a repeated one leaves no half archive among
    the returned ones. `compression` is "", "gz", "bz2" or "xz"."""
    suffix = ".tar" + (f".{compression}" if compression else "")

    def write(batches):
        import io

        import pyarrow as pa

        path, n, tar, out = f"{folder}/{uuid.uuid4().hex}{suffix}", 0, None, None
        for batch in batches:
            for member, raw in zip(batch.column("member").to_pylist(), batch.column("raw").to_pylist()):
                if tar is None:
                    out = opened(path, "wb")
                    tar = tarfile.open(fileobj=out, mode=f"w|{compression}", format=tarfile.PAX_FORMAT)
                info = tarfile.TarInfo(member)
                info.size = len(raw or b"")
                tar.addfile(info, io.BytesIO(raw or b""))
                tar.members = []
                n += 1
        if tar is not None:
            tar.close()
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], names=["path", "members"])

    make_folder(messages.sparkSession, folder)
    return pinned(messages.select(F.col("member").cast("string").alias("member"), F.col("raw").cast("binary").alias("raw")).mapInArrow(write, "path string, members long"))


def make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
