"""Token sequences in training order, as fixed-stride binary shards.

A document's ids, closed by an end id, are cut into sequences of at most `size` ids. Its place in
the corpus (doc_id, number of the piece, hash of the text) is a number below `domain`; a keyed Feistel network,
applied again while the result lies outside, permutes these numbers. Equal ranges of permuted
numbers are shards; within a shard sequences are in permuted order, and a sequence's global slot is
its shard's first slot plus its place. So the order depends on key, ids and texts only, not on how
Spark dealt the rows, and nothing needs to be counted before the one shuffle.

A record is a header (doc_id, start, length, 1 if the id is null) and `size` ids of two bytes, four
where the vocabulary needs them; the stride is constant, so slot s is at (s - first_slot) * stride.
A shard is written under another name and then renamed, so an attempt that dies leaves nothing
behind under the shard's name, and a repeated one writes the same bytes.

Null and empty texts are one sequence with the end id. Rows without an id, or of one id, are told
apart by a hash of their text, so however many they are, they spread over all shards; rows that agree
in that too have the same permuted number and follow one another. No rows give no shards. Only doc_id
and text are read.
"""

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steadfast.llm.common import new_path, partitions, saved, texts_of
from steadfast.llm.tokens import encoder, ids_of

SIZE = 512
KEY = 20_240_607
ROUNDS = 6
HEADER = "<qqii"
HEADER_BYTES = struct.calcsize(HEADER)
SHARD_BYTES = 128 << 20
BATCH_BYTES = 16 << 20
#: Numbers for the texts of one id.
TEXTS = 2**24
MASK = 2**64 - 1
MANIFEST = "shard int, path string, sequences long, stride long, width int, sha256 string"
SEQUENCES = "slot long, shard int, doc_id long, start long, length long, ids_crc32 long"


def _round_keys(key: int) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(struct.pack("<qq", key, i), digest_size=8).digest(), "little") for i in range(ROUNDS)]


class Permutation:
    """A keyed permutation of the numbers below `domain` (at most 2**128)."""

    def __init__(self, domain: int, key: int = KEY):
        self.domain, self.keys = domain, _round_keys(key)
        self.half = max(1, ((domain - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1

    def _once(self, number: int) -> int:
        left, right = number >> self.half, number & self.mask
        for key in self.keys:
            x = (right + key) * 0x9E3779B97F4A7C15 & MASK
            x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & MASK
            left, right = right, (left ^ x ^ x >> 32) & self.mask
        return left << self.half | right

    def __call__(self, number: int) -> int:
        while True:
            number = self._once(number)
            if number < self.domain:
                return number


def _dealt(path, size, end_id, kind, first, null_place, pieces, shards, key, domain):
    """Sequences by shard; those of some megabytes of text that go to one shard are one row."""
    def run(batches):
        ids_in, moved = ids_of(path), Permutation(domain, key)
        waiting: dict[int, list[bytes]] = {}
        held = 0

        def rows():
            names = list(waiting)
            data = [zstandard.compress(b"".join(waiting[n]), 1) for n in names]
            waiting.clear()
            return pa.record_batch([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = np.array([*ids_in(text), end_id], kind)
                place = null_place if doc is None else doc - first
                own_text = zlib.crc32((text or "").encode()) % TEXTS
                for piece, start in enumerate(range(0, len(ids), size)):
                    own = ids[start:start + size].tobytes()
                    number = moved((place * pieces + piece) * TEXTS + own_text)
                    shard = number * shards // domain
                    head = number.to_bytes(16, "big") + struct.pack(HEADER, doc or 0, start, len(own) // ids.itemsize, doc is None)
                    waiting.setdefault(shard, []).append(head + own)
                held += len(text)
            if held >= BATCH_BYTES:
                yield rows()
                held = 0
        if waiting:
            yield rows()

    return run


def _records(data: bytes, width: int):
    """(permuted number, record without padding) of a row's sequences."""
    at = 0
    while at < len(data):
        length = struct.unpack_from(HEADER, data, at + 16)[2]
        end = at + 16 + HEADER_BYTES + length * width
        yield data[at:at + 16], data[at + 16:end]
        at = end


def _written(folder, width, stride):
    def run(batches):
        rows: dict[int, list[bytes]] = {}
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist()):
                rows.setdefault(shard, []).append(data)
        for shard in sorted(rows):
            records = sorted(r for data in rows.pop(shard) for r in _records(zstandard.decompress(data), width))
            store, base = pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder else (pyarrow.fs.LocalFileSystem(), folder)
            name = f"shard-{shard:08d}.bin"
            path, trial, digest = f"{base}/{name}", f"{base}/trial-{uuid.uuid4().hex}", hashlib.sha256()
            store.create_dir(base)
            with store.open_output_stream(trial) as out:
                for _, record in records:
                    record = record.ljust(stride, b"\0")
                    digest.update(record)
                    out.write(record)
            store.move(trial, path)
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(records)]), pa.array([stride]),
                                   pa.array([width], pa.int32()), pa.array([digest.hexdigest()])],
                                  names=["shard", "path", "sequences", "stride", "width", "sha256"])

    return run


def write(docs: DataFrame, path: str, folder: str, size: int = SIZE, end_id: int = 0, key: int = KEY) -> DataFrame:
    """Write the shards to `folder`, which all executors share. Returns the manifest: shard, path,
    sequences, stride, width of an id, sha256 and the shard's first global slot."""
    spark = docs.sparkSession
    width = 2 if encoder(path).max_token_value < 2**16 else 4
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")  # no text has more ids than bytes
    has = docs.agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum(long).alias("bytes"), F.max(long).alias("longest")).first()
    first, last = (has["first"], has["last"]) if has["first"] is not None else (0, -1)
    pieces = -(-((has["longest"] or 0) + 1) // size)
    domain = (last - first + 2) * pieces * TEXTS
    shards = max(partitions(spark), -(-(has["bytes"] or 0) * width // SHARD_BYTES))
    stride = HEADER_BYTES + size * width
    dealt = docs.mapInArrow(_dealt(path, size, end_id, f"<u{width}", first, last - first + 1, pieces, shards, key, domain), "shard int, data binary")
    manifest = saved(dealt.repartitionById(shards, F.col("shard")).mapInArrow(_written(folder, width, stride), MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.withColumn("first_slot", F.coalesce(F.sum("sequences").over(before), F.lit(0)))


def read(manifest: DataFrame, from_slot: int = 0, block: int = 4096) -> DataFrame:
    """The sequences from a slot on: each shard is read from where that is, in stride order."""
    shards = manifest.agg(F.max("shard")).first()[0]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                skip = max(0, from_slot - row["first_slot"])
                stride = row["stride"]
                store, path = pyarrow.fs.FileSystem.from_uri(row["path"]) if ":" in row["path"] else (pyarrow.fs.LocalFileSystem(), row["path"])
                with store.open_input_file(path) as data:
                    data.seek(skip * stride)
                    slot = row["first_slot"] + skip
                    while part := data.read(block * stride):
                        rows = []
                        for at in range(0, len(part), stride):
                            doc, start, length, unknown = struct.unpack_from(HEADER, part, at)
                            ids = np.frombuffer(part, f"<u{row['width']}", length, at + HEADER_BYTES).astype("<u4")
                            rows.append((slot, row["shard"], None if unknown else doc, start, length, zlib.crc32(ids.tobytes())))
                            slot += 1
                        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                              names=["slot", "shard", "doc_id", "start", "length", "ids_crc32"])

    wanted = manifest.where(F.col("first_slot") + F.col("sequences") > from_slot)
    return wanted.repartitionById(1 + (shards or 0), F.col("shard")).mapInArrow(run, SEQUENCES)


def materialised(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Write the shards to a new folder of the shared one and read every sequence back."""
    return read(write(docs, path, new_path(docs.sparkSession, "shards"), size))
