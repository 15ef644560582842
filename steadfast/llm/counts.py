"""Token counts of whole texts, huge ones in overlapping chunks.

A text of up to `chunk` code points is encoded at once. A longer one is cut into chunks, each of which
runs `overlap` code points into the next; chunks of one text are encoded by different tasks, with
offsets. Two neighbours are spliced at a boundary that both have and that is proven stable:

- it lies between two pre-tokens, and the later one's first code point neither composes with nor moves
  before what precedes it (no mark, no conjoining letter, none that Unicode hasn't assigned), so both
  sides are normalised by themselves;
- it is farther from the earlier chunk's end than an added token or a contraction reaches, so nothing
  that the chunk doesn't show can undo it;
- the earlier chunk is right up to there: it begins at the text's start or at such a boundary itself.

Pre-tokens depend only on what follows their start, so from a shared boundary on the later chunk is right
as well. Where neighbours share none (a run of letters longer than the overlap), the overlap is widened:
what follows the last good boundary is encoded anew together with the whole next chunk, and so on until
one is found. This holds for tokenizer files whose pre-tokeniser looks ahead by less than MARGIN code
points and never behind, and whose normaliser works code point by code point but for composition.

Added tokens inside texts are cut out as the file says; none are added. Nulls and empty texts have no
tokens. Repeated rows each give a row, a null id stays null. Only doc_id and text are read.
"""

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.llm.common import partitions, texts_of

CHUNK = 32_768
OVERLAP = 256
#: Longer than an added token or a contraction.
MARGIN = 32
LIMIT = 2048
#: Texts encoded at once in a task.
BATCH = 256
CUT = "row long, doc_id long, n_bytes long, part int, start long, piece string"
PART = CUT + ", n long, places binary, before binary"
COUNTED = "doc_id long, n_bytes long, n_tokens long"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """A worker's tokenizer for a file; the task is its only thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def cuts(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Spans (start, stop) of overlapping chunks."""
    starts = range(0, max(1, length - overlap), chunk)
    return [(a, length if a == starts[-1] else a + chunk + overlap) for a in starts]


def stands_alone(character: str) -> bool:
    """Whether normalisation never joins this code point to what precedes it."""
    kind = unicodedata.category(character)
    jamo = 0x1160 <= ord(character) <= 0x11FF
    return not (kind[0] == "M" or kind in ("Cn", "Co", "Cs") or jamo or (kind == "Lo" and ord(character) > 0x16000 and ord(character) < 0x17000))


def encode_piece(piece: str, start: int, path: str) -> tuple[int, np.ndarray, np.ndarray]:
    """A piece's number of tokens, its stable boundaries as places in the text, and the tokens before each."""
    made = tokenizer(path).encode(piece, add_special_tokens=False)
    n = len(made)
    if not n:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.array(made.offsets, np.int64)
    words = np.array(made.word_ids, np.int64)
    begins, ends = offsets[:, 0], np.maximum.accumulate(offsets[:, 1])
    first = np.flatnonzero((words[1:] != words[:-1]) & (begins[1:] >= ends[:-1])) + 1
    if begins[0] == 0:
        first = np.concatenate([[0], first])
    first = first[[stands_alone(piece[i]) for i in begins[first]]] if len(first) else first
    return n, begins[first] + start, first.astype(np.int64)


class Piece:
    """An encoded stretch of a text, right from `good` on, a place with `skipped` tokens before it."""

    def __init__(self, start, piece, n, places, before):
        self.start, self.piece, self.n, self.places, self.before = start, piece, n, places, before
        self.good, self.skipped = start, 0

    @property
    def stop(self):
        return self.start + len(self.piece)

    def meeting(self, later) -> tuple[int, int] | None:
        """Positions in both lists of the first boundary on which both agree and this one can be trusted."""
        common, i, j = np.intersect1d(self.places, later.places, assume_unique=True, return_indices=True)
        fit = np.flatnonzero((common >= self.good) & (common <= self.stop - MARGIN))
        return (int(i[fit[0]]), int(j[fit[0]])) if len(fit) else None

    def widened(self, later, path):
        """From the last good boundary to the end of the later piece, encoded anew."""
        text = self.piece[self.good - self.start:] + later.piece[self.stop - later.start:]
        return Piece(self.good, text, *encode_piece(text, self.good, path))


def splice(pieces, path: str) -> int:
    """The number of tokens of a text, from its encoded pieces in order."""
    total, here = 0, None
    for later in pieces:
        if here is None:
            here = later
            continue
        met = here.meeting(later)
        if met is None:
            here = here.widened(later, path)
            continue
        i, j = met
        total += int(here.before[i]) - here.skipped
        later.good, later.skipped = int(later.places[j]), int(later.before[j])
        here = later
    return total + (here.n - here.skipped if here else 0)


def _cut_rows(chunk, overlap):
    def run(batches):
        for batch in batches:
            known = zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "n_bytes")))
            for (row, doc, n_bytes), text in zip(known, texts_of(batch)):
                for part, (a, b) in enumerate(cuts(len(text), chunk, overlap)):
                    yield pa.record_batch([pa.array([v], t) for v, t in (
                        (row, pa.int64()), (doc, pa.int64()), (n_bytes, pa.int64()), (part, pa.int32()),
                        (a, pa.int64()), (text[a:b], pa.string()))],
                        names=["row", "doc_id", "n_bytes", "part", "start", "piece"])

    return run


def _near_edges(piece: str, start: int, places: np.ndarray, before: np.ndarray, overlap: int):
    """The boundaries within reach of a neighbour."""
    near = (places - start <= overlap) | (start + len(piece) - places <= overlap)
    return places[near], before[near]


def _encode_rows(path, overlap):
    def run(batches):
        for batch in batches:
            made = []
            for piece, start in zip(batch.column("piece").to_pylist(), batch.column("start").to_pylist()):
                n, places, before = encode_piece(piece, start, path)
                places, before = _near_edges(piece, start, places, before, overlap)
                made.append((n, places.tobytes(), before.tobytes()))
            columns = zip(*made) if made else ([], [], [])
            yield pa.record_batch([*batch.columns, *(pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary())))],
                                  names=[*batch.schema.names, "n", "places", "before"])

    return run


def _texts_in_pieces(batches):
    """(doc_id, n_bytes, pieces) for each text of a stream sorted by row and part."""
    def rows():
        for batch in batches:
            yield from batch.to_pylist()

    stream = rows()
    here = next(stream, None)
    while here is not None:
        row = here["row"]

        def pieces():
            nonlocal here
            while here is not None and here["row"] == row:
                yield Piece(here["start"], here["piece"], here["n"], np.frombuffer(here["places"], np.int64), np.frombuffer(here["before"], np.int64))
                here = next(stream, None)

        yield here["doc_id"], here["n_bytes"], pieces()


def count(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether these are more than `limit`."""
    if overlap <= MARGIN or chunk <= overlap:
        raise ValueError(f"chunk > overlap > {MARGIN} is needed")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk

    def short_rows(batches):
        one = tokenizer(path)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                some = batch.slice(a, BATCH)
                n = [len(e) for e in one.encode_batch_fast(texts_of(some), add_special_tokens=False)]
                yield pa.record_batch([some.column("doc_id"), some.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def spliced_rows(batches):
        for doc, n_bytes, pieces in _texts_in_pieces(batches):
            yield pa.record_batch([pa.array([v], pa.int64()) for v in (doc, n_bytes, splice(pieces, path))], names=["doc_id", "n_bytes", "n_tokens"])

    n = partitions(docs.sparkSession)
    pieces = (docs.where(long).withColumn("row", F.monotonically_increasing_id())
              .mapInArrow(_cut_rows(chunk, overlap), CUT).repartition(n, "row", "part"))
    spliced = (pieces.mapInArrow(_encode_rows(path, overlap), PART).repartition(n, "row")
               .sortWithinPartitions("row", "part").mapInArrow(spliced_rows, COUNTED))
    counted = docs.where(~long).mapInArrow(short_rows, COUNTED).unionByName(spliced)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
