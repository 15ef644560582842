"""Byte-level BPE encoding of long texts in overlapping chunks, and decoding.

A text of up to `chunk` code points is one chunk. A longer one is cut into chunks that overlap;
chunks of one text are pre-tokenised and encoded by different tasks. A chunk starts anywhere, so
its first pre-tokens may be wrong, but pre-tokens depend only on what follows their start: from
the first boundary that two neighbours share, both have the same pre-tokens. Every overlap runs
on until it holds a word end followed by a blank, a letter followed by a mark or digit, or a digit
followed by a mark or letter. These are boundaries however one gets there, so neighbours always meet.
There they are stitched; what lies before in the later chunk and after in the earlier one is
dropped. Only a text whose rest is one run of letters, of digits or of marks can't be cut on: as far
as it is letters or digits it is one pre-token.

Nulls and empty texts have no ids. Repeated rows each give a row. Order of rows is free.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.llm.common import partitions, texts_of
from steadfast.llm.tokens import PATTERN, encoder

CHUNK = 32_768
OVERLAP = 256
# Only characters that every engine and Unicode version counts as letters, digits and neither.
LETTER = r"A-Za-z\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0904-\u0939\u0e01-\u0e30\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
DIGIT = r"0-9\uff10-\uff19"
SIGN = r"!-/:-@\[-`{-~\u00ab\u00bb\u060c\u061b\u061f\u0964\u2013\u2014\u2018-\u201d\u2026\u3001\u3002\u3008-\u3011\uff01-\uff0f\uff1a-\uff20"
#: The last character of a pre-token, whatever comes before, and the next one's first.
WORD_END = re.compile(rf"\S[ \n\t]|[{LETTER}][{SIGN}{DIGIT}]|[{DIGIT}][{SIGN}{LETTER}]")
ENCODED = "doc_id long, n_tokens long, ids binary, text_bytes binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CUT = "row long, doc_id long, part int, start long, piece string"
PART = "row long, doc_id long, part int, marks binary, ids binary"


def cuts(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans (start, stop) of overlapping chunks."""
    spans, start = [], 0
    while start + chunk < len(text):
        end = start + chunk
        meeting = WORD_END.search(text, end)
        if meeting is None:
            break
        spans.append((start, min(len(text), max(meeting.end(), end + overlap))))
        start = end
    return [*spans, (start, len(text))]


def encode_chunk(piece: str, start: int, path: str) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's ids, and pairs (boundary in the text, ids before it)."""
    one = encoder(path)._core_bpe.encode_single_piece
    known: dict[str, list[int]] = {}
    ids: list[int] = []
    marks = [(start, 0)]
    at = start
    for word in regex.findall(PATTERN, piece):
        if word not in known:
            known[word] = one(word.encode())
        ids += known[word]
        at += len(word)
        marks.append((at, len(ids)))
    return np.array(ids, "<u4"), np.array(marks, np.int64)


def stitch(parts):
    """Slices of ids that make up one text, from its chunks (marks, ids) in order."""
    before = None
    for marks, ids in parts:
        first = 0
        if before is not None:
            common, i, j = np.intersect1d(before[0][:, 0], marks[:, 0], assume_unique=True, return_indices=True)
            if not len(common):
                raise ValueError("neighbouring chunks share no boundary")
            yield before[1][before[2]:before[0][i[0], 1]]
            first = marks[j[0], 1]
        before = (marks, ids, first)
    if before is not None:
        yield before[1][before[2]:]


def _cut_rows(chunk, overlap):
    def run(batches):
        for batch in batches:
            rows, docs = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
            for row, doc, text in zip(rows, docs, texts_of(batch)):
                spans = cuts(text, chunk, overlap)
                yield pa.record_batch([
                    pa.array([row] * len(spans), pa.int64()), pa.array([doc] * len(spans), pa.int64()),
                    pa.array(range(len(spans)), pa.int32()), pa.array([a for a, _ in spans], pa.int64()),
                    pa.array([text[a:b] for a, b in spans], pa.string()),
                ], names=["row", "doc_id", "part", "start", "piece"])

    return run


def _encode_rows(path):
    def run(batches):
        for batch in batches:
            made = [encode_chunk(piece, start, path) for piece, start in
                    zip(batch.column("piece").to_pylist(), batch.column("start").to_pylist())]
            yield pa.record_batch([
                batch.column("row"), batch.column("doc_id"), batch.column("part"),
                pa.array([m.tobytes() for _, m in made], pa.binary()),
                pa.array([i.tobytes() for i, _ in made], pa.binary()),
            ], names=["row", "doc_id", "part", "marks", "ids"])

    return run


def _texts_in_parts(batches):
    """(doc_id, chunks) for each text of a stream sorted by row and part."""
    def rows():
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "marks", "ids"))):
                yield row

    stream = rows()
    here = next(stream, None)
    while here is not None:
        row, doc = here[:2]

        def parts():
            nonlocal here
            while here is not None and here[0] == row:
                yield np.frombuffer(here[2], np.int64).reshape(-1, 2), np.frombuffer(here[3], "<u4")
                here = next(stream, None)

        yield doc, parts()


def _digest(slices, path):
    """Number of ids, digest of the ids, digest of the decoded bytes; a slice at a time."""
    n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
    for ids in slices:
        n += len(ids)
        ids_hash.update(ids.tobytes())
        text_hash.update(decode(ids, path))
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def decode(ids, path: str) -> bytes:
    """Ids to bytes: each id's own bytes, one after another."""
    return encoder(path).decode_bytes(list(ids) if not isinstance(ids, np.ndarray) else ids.tolist())


def _whole(slices, path):
    ids = np.concatenate([np.zeros(0, "<u4"), *slices])
    return len(ids), ids.tobytes(), decode(ids, path)


def _batch(rows, digests):
    kind = pa.string() if digests else pa.binary()
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "text_bytes"]
    docs, counts, first, second = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
    return pa.record_batch([pa.array(docs, pa.int64()), pa.array(counts, pa.int64()),
                            pa.array(first, kind), pa.array(second, kind)], names=["doc_id", "n_tokens", *names])


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, digests: bool = False) -> DataFrame:
    """Per document: its ids (little-endian unsigned 32-bit) and the bytes that they decode to,
    or the digests of both, for which no task holds more than a chunk of a long text."""
    finish, schema = (_digest, DIGESTS) if digests else (_whole, ENCODED)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk

    def short_rows(batches):
        one = encoder(path)
        for batch in batches:
            ids = (np.array(one.encode_ordinary(t), "<u4") for t in texts_of(batch))
            yield _batch([(d, *finish([i], path)) for d, i in zip(batch.column("doc_id").to_pylist(), ids)], digests)

    def stitched_rows(batches):
        for doc, parts in _texts_in_parts(batches):
            yield _batch([(doc, *finish(stitch(parts), path))], digests)

    n = partitions(docs.sparkSession)
    pieces = (docs.where(long).withColumn("row", F.monotonically_increasing_id())
              .mapInArrow(_cut_rows(chunk, overlap), CUT).repartition(n, "row", "part"))
    stitched = (pieces.mapInArrow(_encode_rows(path), PART).repartition(n, "row")
                .sortWithinPartitions("row", "part").mapInArrow(stitched_rows, schema))
    return docs.where(~long).mapInArrow(short_rows, schema).unionByName(stitched)
