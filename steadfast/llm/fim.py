"""Fill-in-middle: a text cut at two of its token boundaries and put together in another order.

Tokens are runs of ASCII letters and single other code points. The boundaries of a text, as offsets in
code points, are a set of integers held as compressed bitmaps are: by their high bits in containers of
2**16 places, each an array of low bits, a bitmap, or runs, whichever is smallest, with the containers'
cumulative cardinalities beside them. The k-th boundary is found by a search in these and a select
inside one container; both cuts of a text come from the set, without a list of its tokens.

Choices hang on a digest of seed and id only, so a retry or another partitioning changes nothing. A null
or empty text is left plain, and so is one that holds a marker, as its parts couldn't be told apart
later; `restore` gives back the text exactly. A null id counts as the empty text in the digest.
Repeated rows each give a row. Only doc_id and text are read. A row is held by one task, with a few
bytes a code point beside it; nothing is shuffled.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.llm.common import texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLACES = 1 << 16
#: Of 100 documents each: left plain, and of the rest with the suffix first.
PLAIN_PCT, SPM_PCT = 10, 20
SEED = 1
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
TEXTS = MADE + ", output string"
DIGESTS = MADE + ", output_sha256 string, restored_sha256 string"


class Array:
    """Few places: their low bits, in order."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    @staticmethod
    def size(low: np.ndarray, runs: int) -> int:
        return 2 * len(low)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    """Many places: a bit each."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(PLACES, bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")

    @staticmethod
    def size(low: np.ndarray, runs: int) -> int:
        return PLACES // 8

    def select(self, k: int) -> int:
        upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        word = int(np.searchsorted(upto, k, "right"))
        inside = k - (int(upto[word - 1]) if word else 0)
        bits = np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[inside])


class Runs:
    """Stretches of neighbouring places: first place and number of each."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.concatenate([[True], np.diff(low) != 1]))
        self.first = low[first].astype(np.uint16)
        self.upto = np.append(first[1:], len(low))

    @staticmethod
    def size(low: np.ndarray, runs: int) -> int:
        return 4 * runs

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.upto, k, "right"))
        return int(self.first[run]) + k - (int(self.upto[run - 1]) if run else 0)


class Boundaries:
    """A set of integers from 0 on, built from sorted ones."""

    def __init__(self, places: np.ndarray):
        high = places >> 16
        starts = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(places) else np.zeros(0, np.int64)
        stops = np.append(starts[1:], len(places))
        self.keys = high[starts]
        self.upto = stops.astype(np.int64)
        self.containers = [self._container(places[a:b] & (PLACES - 1)) for a, b in zip(starts, stops)]

    @staticmethod
    def _container(low: np.ndarray):
        runs = 1 + int(np.count_nonzero(np.diff(low) != 1))
        return min((Array, Bitmap, Runs), key=lambda kind: kind.size(low, runs))(low)

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The k-th smallest, from 0."""
        at = int(np.searchsorted(self.upto, k, "right"))
        return (int(self.keys[at]) << 16) + self.containers[at].select(k - (int(self.upto[at - 1]) if at else 0))


def boundaries(text: str) -> Boundaries:
    """Where the tokens of a text end."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = ((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128)
    goes_on = letter[:-1] & letter[1:]
    return Boundaries(np.flatnonzero(np.append(~goes_on, True)[:len(points)]) + 1)


@dataclass
class Cut:
    """A text in its form. `prefix` and `middle` are None in a plain one."""

    n: int
    form: str
    prefix: str | None
    middle: str | None
    output: str


def transform(doc_id, text: str, seed: int = SEED) -> Cut:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    ends = boundaries(text)
    n = len(ends)
    if not text or h3 % 100 >= 100 - PLAIN_PCT or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(n, "plain", None, None, text)
    a, b = (ends.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_PCT:
        return Cut(n, "spm", prefix, middle, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Cut(n, "psm", prefix, middle, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restore(output: str, form: str) -> str:
    """The text from an output and its form."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, seed: int = SEED, digests: bool = False) -> DataFrame:
    """Per document: tokens, form, lengths of prefix and middle, and the output text, or the digests of
    the output and of the text restored from it."""
    ends = [("output_sha256", pa.string()), ("restored_sha256", pa.string())] if digests else [("output", pa.string())]
    kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), *ends]

    def row(doc, text):
        cut = transform(doc, text, seed)
        last = (sha256(cut.output), sha256(restore(cut.output, cut.form))) if digests else (cut.output,)
        lengths = (None if part is None else len(part) for part in (cut.prefix, cut.middle))
        return doc, cut.n, cut.form, *lengths, *last

    def rows(batches):
        for batch in batches:
            made = [row(d, t) for d, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch))]
            columns = list(zip(*made)) if made else [[]] * len(kinds)
            yield pa.record_batch([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, DIGESTS if digests else TEXTS)
