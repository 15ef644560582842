"""Packing documents into sequences of a fixed number of tokens.

A document's ids, closed by an end id, are cut every `size` ids; only the last piece is shorter.
The histogram of piece lengths (at most `size` rows, whatever the corpus) is packed on the driver,
shortest pack first: lengths from the longest to the shortest each go to the packs that are
shortest so far, and counts of packing patterns are kept instead of packs. Each place in a pattern
then covers a range of ranks among the pieces of its length, and pieces find their place by their
rank. Ranks come from counts by task and length, so no task sees all pieces of a length.

Empty or null texts are one piece with the end id. Repeated rows are packed each. No rows give no
sequences. Only doc_id and text are read; other columns are left out.
"""

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steadfast.llm.common import saved, texts_of
from steadfast.llm.tokens import ids_of

SIZE = 1024
END_ID = 0
PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, place long")
SLOT = "length long, first long, past long, sequence_base long, offset long"


def _cut(path, size, end_id, with_ids):
    def run(batches):
        ids_in, task, seen = ids_of(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = np.array([*ids_in(text), end_id], "<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start:start + size].tobytes()
                    n = len(piece) // 4
                    rows.append((doc, start, n, zlib.crc32(piece), len(ids), task, seen[n], piece))
                    seen[n] += 1
            columns = list(zip(*rows)) or [[]] * 8
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"]
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            if with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array(columns[7], pa.binary())]
            yield pa.record_batch(arrays, names=names)

    return run


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first over a histogram: (number of packs, lengths in them)."""
    open_by_total: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    totals: list[int] = []  # of packs that still have room, ascending

    def put(count, pack):
        total = sum(pack)
        if total not in open_by_total:
            open_by_total[total] = []
            insort(totals, total)
        open_by_total[total].append((count, pack))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        moved = []
        while left and totals and totals[0] + length <= size:
            count, pack = open_by_total[totals[0]].pop()
            if not open_by_total[totals[0]]:
                del open_by_total[totals.pop(0)]
            # a pack takes as many of this length as fit, if there are so many
            times = min((size - sum(pack)) // length, -(-left // count))
            used = min(count, left // times)
            if not used:
                times, used = left, 1
            moved.append((used, pack + (length,) * times))
            left -= used * times
            if used < count:
                put(count - used, pack)
        if left:
            each = size // length
            if left // each:
                moved.append((left // each, (length,) * each))
            if left % each:
                moved.append((1, (length,) * (left % each)))
        for count, pack in moved:
            put(count, pack)
    return [(count, pack) for total in totals for count, pack in open_by_total[total]]


def slots(packed: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """Each place of each pattern: (length, first rank, rank past it, first sequence, offset)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pack in packed:
        offset = 0
        for length in pack:
            first = used.get(length, 0)
            rows.append((length, first, first + count, sequence, offset))
            used[length] = first + count
            offset += length
        sequence += count
    return rows


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Per piece: its document, where it starts there, its length and checksum, its sequence and
    its offset in it; with `with_ids` also its ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    schema = PIECE + (", ids binary" if with_ids else "")
    pieces = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .mapInArrow(_cut(path, size, end_id, with_ids), schema), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = {r["length"]: r["n"] for r in
                 pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    # at most a few places for each length: the patterns don't grow in number with the corpus
    places = F.broadcast(spark.createDataFrame(slots(patterns(histogram, size)), SLOT))
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("earlier") + F.col("place"))
    found = ranked.join(places, "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence_base") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset",
        *(["ids"] if with_ids else []),
    )
