"""CSV files whose fields may hold line breaks, read in splits.

Whether a line break ends a record depends on all quotes before it, so a task that starts in the middle of
a file can't know what it sees. A first job reads every range of about RANGE_BYTES once and notes, for each
state that the range may begin in, the state that it ends in and the records that end within. Folding these
few bytes a range, in file order, gives every range its true state and the number of records before it. The
second job then reads each range as a partition of its own: it skips the record that an earlier range began,
gives out those that begin within its bounds, and reads on to the end of the last one.

Fields are separated by commas, records end in \\n or \\r\\n, a quote within quotes is doubled. A quote within
an unquoted field is an ordinary character, and what follows a closing quote belongs to the field up to the
next comma or line break. Blank lines are no records. A file may mix both line ends, and within quotes they
stay as they are (Spark's own reader takes the first one it sees for all, and makes it \\n). A file that ends
within quotes has its rest as the last record. Files compressed as .gz, .bz2, .zst or .lz4 can't be entered
in the middle: each is one partition. Records are split here only; Spark's own CSV expression parses values.
"""

import os
import re
import sys
from collections.abc import Callable, Iterator
from urllib.parse import quote

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from steadfast.operators.support import pinned

# Workers get these helpers with the task, whether or not they can import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 64 * 2**20
BLOCK_BYTES = 2**20
BATCH_BYTES = 16 * 2**20
FORMAT = "quoted_records"
COMPRESSED = r"\.(gz|bz2|zst|lz4)$"
#: At most this many tasks look for states; each may take several ranges.
TASKS = 10_000
#: Where a reader can be: before a record, after a carriage return there, before another field, in an
#: unquoted field (or behind a closed quote), in a quoted field, behind a quote in a quoted field.
RECORD_START, RETURN, FIELD_START, UNQUOTED, QUOTED, QUOTE = STATES = "RCFUQE"
WALKED = "path string, start long, stop long, ends string, ended array<bigint>"
RECORD = "file string, index bigint, record string"

_FIELD = rb'(?:"(?:[^"]++|"")*+"[^,\n]*+|(?!")[^,\n]*+)'
WHOLE_RECORD = re.compile(rb"(?:" + _FIELD + rb",)*+" + _FIELD + rb"\n")
BLANK_LINES = re.compile(rb"(?:\r?\n)*+")
IN_QUOTES = re.compile(rb'(?:[^"]++|"")*+')
PLAIN = re.compile(rb"[^,\n]*+")
NEW_LINE, COMMA, MARK, CARRIAGE = b'\n,"\r'


def opened(path: str, compressed: bool = False):
    """A file of any store that Arrow knows, as Spark names it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        uri = "file://" + quote(os.path.abspath(path))
    elif scheme == "file":
        uri = "file:///" + quote(rest.lstrip("/"))
    else:
        uri = f"{scheme}:{quote(rest, safe='/@:')}"
    store, name = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(name, compression="detect") if compressed else store.open_input_file(name)


def advance(block: bytes, state: str, first_end: bool = False) -> tuple[str, int, int]:
    """(state, records ended, bytes read) after a block, or after the record that the block begins in."""
    at, ended, end = 0, 0, len(block)
    while at < end:
        if state == QUOTED:
            at = IN_QUOTES.match(block, at).end()
            if at < end:
                state, at = QUOTE, at + 1
        elif state == QUOTE:
            state, at = (QUOTED, at + 1) if block[at] == MARK else (UNQUOTED, at)
        elif state == UNQUOTED:
            at = PLAIN.match(block, at).end()
            if at < end:
                ended += block[at] == NEW_LINE
                state, at = RECORD_START if block[at] == NEW_LINE else FIELD_START, at + 1
        elif state == RETURN:
            state, at = (RECORD_START, at + 1) if block[at] == NEW_LINE else (UNQUOTED, at)
        elif block[at] == MARK:
            state, at = QUOTED, at + 1
        elif state == FIELD_START:
            state = UNQUOTED
        elif block[at] == CARRIAGE:
            state, at = RETURN, at + 1
        elif block[at] == NEW_LINE:
            at += 1
        else:
            state = UNQUOTED
        if state == RECORD_START:
            if first_end:
                break
            at = BLANK_LINES.match(block, at).end()
            while whole := WHOLE_RECORD.match(block, at):
                ended += 1
                at = BLANK_LINES.match(block, whole.end()).end()
    return state, ended, at


def walk(read: Callable[[int], bytes], size: int) -> tuple[str, list[int]]:
    """Per state to begin in: the state after `size` bytes, and the records that end in them. States
    that have met are followed once; the first block is small, as most meet within a record or two."""
    reached = {s: (s, 0) for s in STATES}
    block = 2**12
    while size > 0 and (data := read(min(block, size))):
        moved = {s: advance(data, s) for s in {s for s, _ in reached.values()}}
        reached = {start: (moved[s][0], n + moved[s][1]) for start, (s, n) in reached.items()}
        size, block = size - len(data), BLOCK_BYTES
    return "".join(reached[s][0] for s in STATES), [reached[s][1] for s in STATES]


def records(read: Callable[[int], bytes], state: str, size: float, before: int = 0, block: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(number, record without its line end) of the records that begin in the next `size` bytes, the first
    of which are in `state` after `before` records have ended. Only these and the last record's rest are read."""
    at, held, since = 0, b"", 0
    while state != RECORD_START:
        if since >= size or not (held := read(int(min(block, size - since)))):
            return
        state, ended, at = advance(held, state, first_end=True)
        before += ended
        if state != RECORD_START:
            since += len(held)
    while True:
        at = BLANK_LINES.match(held, at).end()
        if since + at >= size:
            return
        if whole := WHOLE_RECORD.match(held, at):
            yield before, held[at:whole.end() - 1].removesuffix(b"\r")
            before, at = before + 1, whole.end()
            continue
        since, held, at = since + at, held[at:], 0
        more = read(max(block, len(held)))  # twice as much each time, so long records cost their length
        if not more:
            if held.rstrip(b"\r"):
                yield before, held.removesuffix(b"\r")
            return
        held += more


class Range(InputPartition):
    def __init__(self, path, start, stop, state, before):
        super().__init__((path, start))
        self.path, self.start, self.stop, self.state, self.before = path, start, stop, state, before


def settled(walked: list[dict]) -> Iterator[Range]:
    """Ranges with their true states, from what each would do in any state."""
    path, state, before = None, RECORD_START, 0
    for r in sorted(walked, key=lambda r: (r["path"], r["start"])):
        if r["path"] != path:
            path, state, before = r["path"], RECORD_START, 0
        yield Range(path, r["start"], r["stop"], state, before)
        if r["stop"] is not None:
            i = STATES.index(state)
            state, before = r["ends"][i], before + r["ended"][i]


class Reader(DataSourceReader):
    def __init__(self, options):
        self.ranges = options["ranges"]

    def partitions(self):
        """One per row of the table of ranges."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        scheme, colon, rest = self.ranges.partition(":")
        store, name = fs.FileSystem.from_uri("file:///" + rest.lstrip("/") if scheme == "file" else self.ranges if colon else "file://" + self.ranges)
        return list(settled(pq.read_table(name, filesystem=store).to_pylist()))

    def read(self, partition):
        import pyarrow as pa

        def batch(rows):
            return pa.record_batch([pa.array([partition.path] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int64()),
                                    pa.array([r.decode("utf-8", "replace") for _, r in rows], pa.string())], names=["file", "index", "record"])

        if partition is None:  # what Spark hands over where there are no ranges
            return
        rows, held = [], 0
        with opened(partition.path, partition.stop is None) as file:
            if partition.stop is not None:
                file.seek(partition.start)
            size = float("inf") if partition.stop is None else partition.stop - partition.start
            for number, record in records(file.read, partition.state, size, partition.before):
                if rows and held + len(record) > BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
                rows.append((number, record))
                held += len(record)
        if rows:
            yield batch(rows)


class QuotedSource(DataSource):
    """spark.read.format("quoted_records").option("ranges", table).load()"""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return RECORD

    def reader(self, schema):
        return Reader(self.options)


def walked_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of all files under a path, each walked by one task; one without an end for a compressed file."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    packed = F.rlike("path", F.lit(COMPRESSED))
    starts = F.when(packed, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "length", packed.alias("packed"), F.explode(starts).alias("start")).select(
        "path", "start", F.when(~F.col("packed"), F.least("length", F.col("start") + range_bytes)).alias("stop"))
    tasks = files.agg(F.sum(F.ceil(F.col("length") / range_bytes)).alias("n")).first()["n"] or 1

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop"))):
                ends, ended = None, None
                if stop is not None:
                    with opened(path) as file:
                        file.seek(start)
                        ends, ended = walk(file.read, stop - start)
                yield pa.record_batch([pa.array([path]), pa.array([start], pa.int64()), pa.array([stop], pa.int64()), pa.array([ends], pa.string()),
                                       pa.array([ended], pa.list_(pa.int64()))], names=["path", "start", "stop", "ends", "ended"])

    return ranges.repartition(min(int(tasks), TASKS), "path", "start").mapInArrow(run, WALKED)


def read_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, index, record): every record of the files under a path, numbered from 0 in its file."""
    spark.dataSource.register(QuotedSource)
    where = pinned(walked_ranges(spark, path, range_bytes)).inputFiles()
    if not where:
        return spark.createDataFrame([], RECORD)
    return spark.read.format(FORMAT).option("ranges", where[0].rsplit("/", 1)[0]).load()


def read_csv(spark: SparkSession, path: str, schema: StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The columns of `schema` by position, `_file`, and `index`: a row's place in its file, whose first record is
    a header. Values are what `spark.read.csv` with multiLine and doubled quotes gives."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv("record", ddl, {"multiLine": "true", "escape": '"'})
    rows = read_records(spark, path, range_bytes).where("index > 0")
    return rows.select(F.col("file").alias("_file"), (F.col("index") - 1).alias("index"), F.inline(F.array(parsed)))
