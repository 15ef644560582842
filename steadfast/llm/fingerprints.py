"""Threshold-scaled document fingerprints.

A text's shingles are all its runs of `WIDTH` code points (a shorter text is one shingle). Each is
hashed to 32 bits, and every hash below a fixed fraction of the range is retained. So sketches of
texts of very unequal length keep the same shingles, can be merged by union, and tell containment
as well as likeness. A text with fewer than `FLOOR` retained hashes also keeps its next smallest
ones up to `FLOOR`; below its own bound each sketch is complete, and two are compared below the
smaller bound. Texts of fewer than `FLOOR` shingles are compared exactly.

Null text counts as empty; its sketch is empty, and two empty sketches have likeness 1. Documents
are ordered by doc_id (nulls first), then text, so repeated ids have a defined order; repeated rows
give a row each. No rows give no rows. Only doc_id and text are read.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.llm.common import partitions, texts_of

WIDTH = 12
FRACTION = 16
FLOOR = 32
LIMIT = 2**32 // FRACTION
ROWS_PER_RANGE = 20_000
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
PAIRS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double")


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 2**64))


def _mixed(h: np.ndarray) -> np.ndarray:
    """The upper 32 bits of a 64-bit finaliser."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype(np.uint32)


def shingle_hashes(text: str) -> np.ndarray:
    """A hash for each run of WIDTH code points, by doubling the width of a polynomial hash."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if len(a) < WIDTH:
        whole = 0
        for c in a.tolist():
            whole = (whole * BASE + c) % 2**64
        return _mixed(np.array([whole], np.uint64)) if len(a) else np.zeros(0, np.uint32)
    two = a[:-1] * _power(1) + a[1:]
    four = two[:-2] * _power(2) + two[2:]
    eight = four[:-4] * _power(4) + four[4:]
    return _mixed(eight[:-4] * _power(4) + four[8:])


def sketch(text: str) -> np.ndarray:
    """Retained hashes, ascending. Long texts go through in overlapping blocks."""
    blocks = [text[i:i + BLOCK + WIDTH - 1] for i in range(0, max(1, len(text) - WIDTH + 1), BLOCK)]
    kept, rest = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    for block in blocks:
        hashes = shingle_hashes(block)
        kept = np.union1d(kept, hashes[hashes < LIMIT])
        if len(kept) < FLOOR:  # distinct ones: a repeated shingle fills no second place
            rest = np.unique(np.concatenate([rest, hashes]))[:FLOOR]
    return kept if len(kept) >= FLOOR else rest


def to_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def complete_below(hashes: np.ndarray) -> int:
    """Every shingle hash of the text below this bound is in its sketch."""
    if len(hashes) < FLOOR:
        return 2**32
    return LIMIT if len(hashes) > FLOOR else max(LIMIT, int(hashes[-1]) + 1)


def _comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bound = min(complete_below(a), complete_below(b))
    return (a, b) if bound == 2**32 else (a[:np.searchsorted(a, bound)], b[:np.searchsorted(b, bound)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all shingles of two texts."""
    a, b = _comparable(a, b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first text's shingles that the second has too."""
    a, b = _comparable(a, b)
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    bound = min(complete_below(a), complete_below(b))
    union = np.union1d(a, b)
    kept = union[union < LIMIT]
    return kept if len(kept) >= FLOOR else union[union < bound][:max(FLOOR, len(kept))]


def _each(function, kind):
    """A column function that applies `function` to each row's values."""
    def apply(*columns):
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([function(*row) for row in zip(*series)], dtype=object if kind == "string" else "float64")

        return F.pandas_udf(lambda a: run(a), kind)(*columns) if len(columns) == 1 else \
            F.pandas_udf(lambda a, b: run(a, b), kind)(*columns)

    return apply


fingerprint = _each(lambda text: to_text(sketch(text or "")), "string")
likeness_of = _each(lambda a, b: likeness(from_text(a), from_text(b)), "double")
containment_of = _each(lambda a, b: containment(from_text(a), from_text(b)), "double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its length in code points and its fingerprint. A map over the rows."""
    return docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
                       fingerprint("text").alias("fingerprint"))


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much from the head of the following one."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _pairs(batches):
    """A stream sorted by range, then document; at a range's end come rows of the next one."""
    before = None  # (range, doc_id, text, sketch)
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id"))
        for part, ahead, doc, text in zip(*columns, texts_of(batch)):
            if ahead and (before is None or before[0] != part):
                continue
            own = sketch(text)
            if before is not None and before[0] == part:
                _, its_doc, its_text, its_own = before
                changed = edited(its_text, text)
                other = sketch(changed)
                rows.append((its_doc, len(its_text), hashlib.sha256(changed.encode()).hexdigest(), to_text(its_own),
                             to_text(other), likeness(its_own, other), likeness(its_own, own)))
            before = None if ahead else (part, doc, text, own)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=names)


def with_neighbour(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness of the first to
    the second and to the next document's (after the last comes the first).

    Whole texts are shuffled once, to ranges of doc_id. A range starts at an id that is there, so
    the row which follows a range's last one is known beforehand and is sent along.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).first()
    if not size["n"]:
        return spark.createDataFrame([], PAIRS)
    wanted = max(partitions(spark), size["n"] // ROWS_PER_RANGE)
    cuts = []
    if size["first"] is not None:
        shares = [i / wanted for i in range(1, wanted)]
        found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * wanted))).first()[0] if shares else []
        cuts = sorted({size["first"], *(found or [])})
    starts, last = np.array(cuts, np.int64), max(1, len(cuts)) - 1

    @F.pandas_udf("array<int>")
    def places(doc: pd.Series) -> pd.Series:
        """Twice the row's range; and once more, plus one, for the range before."""
        known = doc.notna().to_numpy()
        ids = doc.astype("Int64").fillna(0).to_numpy(np.int64)
        part = np.where(known, np.searchsorted(starts, ids, "right") - 1, 0).clip(0)
        opens = (starts[part] == ids) & known if len(starts) else np.zeros(len(ids), bool)
        return pd.Series([[2 * p, 2 * (p - 1 if p else last) + 1] if o or not k else [2 * p]
                          for p, o, k in zip(part.tolist(), opens.tolist(), known.tolist())])

    dealt = (docs.withColumn("place", F.explode(places("doc_id")))
             .select(F.floor(F.col("place") / 2).cast("int").alias("part"), (F.col("place") % 2 == 1).alias("ahead"),
                     "doc_id", "text"))
    return (dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "ahead", "doc_id", "text")
            .mapInArrow(_pairs, PAIRS))
