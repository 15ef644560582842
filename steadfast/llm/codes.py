"""Product codes of vectors, with nearest entries found through memoised grid cells.

Components become floor(256 * x); a vector is cut into `parts` equal consecutive parts, and each part
position has a codebook of `entries` integer points. To find the nearest entry of a part, its coarse
cell is taken (components divided by `cell`, rounded down). For the box of a cell, an entry whose least
distance from the box is more than some entry's greatest distance is dominated: no point in the box is
nearest to it. The others are worked out once per cell and task and kept; only these are evaluated
exactly, ties to the lower index. Ties are safe, as an entry is left out only if it is strictly farther.
A task's memory of cells is emptied when it holds `memo` cells of a position, and filled anew.

A codebook starts as that part of the first kept vectors by vec_id (of repeated ids by vector, rows
without an id last). Each round assigns every part and replaces each entry by the componentwise
floor(sum / count) of its parts: partial sums per task, then one shuffle of these; only the codebooks
(parts x entries x components) reach the driver. Arithmetic is exact: 64-bit integers where the
components allow it, else integers of any size.

Rows whose vector is null or holds null or non-finite components are left out. A row whose vector is
empty, or of another length than the first kept vector's, or of a length that `parts` doesn't divide,
can't be coded with the rest: it is returned with null code and error. An error or sum of errors beyond
a long is null. Repeated rows each give a row, and a null id stays null. No rows give no rows. Only
vec_id, embedding and label are read.
"""

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.llm.common import saved

PARTS = 16
ENTRIES = 64
ROUNDS = 2
CELL = 16
#: Cells of one part position that a task remembers at once.
MEMO = 16_384
#: Vectors coded at once in a task.
ROWS = 1024
CODED = "vec_id long, label string, code string, error decimal(38,0)"
SUMS = "part int, entry int, n long, sums array<string>"


def usable(vector) -> F.Column:
    """Not null, and every component finite."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def integers(vectors) -> np.ndarray:
    """floor(256 * x) of finite numbers, as 64-bit integers if squared distances times entries fit, else
    as integers of any size."""
    x = np.asarray(vectors, np.float64)
    largest = 256 * float(np.abs(x).max(initial=0) / 2**30)  # scaled down, so as not to overflow
    if largest * 2**30 < 2**22 and x.shape[-1] < 256:
        return np.floor(256 * x).astype(np.int64)
    flat = [int(v) * 256 if abs(v) >= 2**53 else math.floor(256 * v) for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


class Cells:
    """The undominated entries of the cells met so far, for one part position."""

    def __init__(self, book: np.ndarray, cell: int, memo: int):
        self.book, self.cell, self.memo = book, cell, memo
        self.evaluated = 0
        self._forget()

    def _forget(self):
        self.slot: dict[tuple, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.lists = np.zeros((0, len(self.book)), np.int16)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """Per cell and entry: whether the entry may be nearest to a point of the cell's box."""
        nearest = farthest = 0
        for j in range(cells.shape[1]):
            low = cells[:, j, None] * self.cell
            below, above = low - self.book[:, j], self.book[:, j] - (low + self.cell - 1)
            outside = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))  # the box's other side
            nearest, farthest = nearest + outside * outside, farthest + far * far
        return nearest <= farthest.min(1, keepdims=True)

    def _learn(self, cells: list[tuple], kind):
        """Keep the undominated entries of these cells, each cell's in ascending order."""
        fits = np.concatenate([self.undominated(np.array(cells[a:a + ROWS], kind)) for a in range(0, len(cells), ROWS)])
        self.slot |= zip(cells, range(len(self.slot), len(self.slot) + len(cells)))
        self.sizes = np.concatenate([self.sizes, fits.sum(1)])
        self.lists = np.concatenate([self.lists, np.argsort(~fits, axis=1, kind="stable").astype(np.int16)])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point and its squared distance."""
        cells = list(map(tuple, (points // self.cell).tolist()))
        new = [c for c in dict.fromkeys(cells) if c not in self.slot]
        if len(self.slot) + len(new) > self.memo:
            self._forget()
            new = list(dict.fromkeys(cells))
        if new:
            self._learn(new, points.dtype)
        at = np.fromiter((self.slot[c] for c in cells), np.int64, len(cells))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        self.evaluated += int(ends[-1])
        # one line for each point and undominated entry
        point = np.repeat(np.arange(len(points)), sizes)
        entry = self.lists[at[point], np.arange(ends[-1]) - begins[point]]
        far = 0
        for j in range(points.shape[1]):
            apart = points[point, j] - self.book[entry, j]
            far = far + apart * apart
        best = np.minimum.reduceat(far * len(self.book) + entry, begins)  # of equal distances the lowest index
        return (best % len(self.book)).astype(np.int64), best // len(self.book)


class Coder:
    """Codes vectors by a codebook of shape (parts, entries, width)."""

    def __init__(self, books: np.ndarray, cell: int = CELL, memo: int = MEMO):
        self.width = books.shape[2]
        self.cells = [Cells(book, cell, memo) for book in books]

    def assign(self, vectors: np.ndarray):
        """(indices, squared distances), both of shape (rows, parts), and the parts themselves."""
        points = vectors.reshape(len(vectors), len(self.cells), self.width)
        if points.dtype == object:
            for one in self.cells:
                one.book = one.book.astype(object)
        found = [one.nearest(points[:, p]) for p, one in enumerate(self.cells)]
        return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1), points


def _slices(batches, length):
    """(slice, vectors) of the rows whose vector has this length."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            some = batch.slice(a, ROWS)
            vectors = some.column("vector").to_pylist()
            fit = np.array([len(v) == length for v in vectors], bool)
            yield some, fit, integers([v for v, f in zip(vectors, fit) if f]) if fit.any() else None


def _sum_rows(books, cell, memo):
    def run(batches):
        coder = Coder(books, cell, memo)
        sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for _, _, vectors in _slices(batches, books.shape[0] * books.shape[2]):
            if vectors is None:
                continue
            indices, _, points = coder.assign(vectors)
            for p in range(books.shape[0]):
                some = np.zeros(books.shape[1:], points.dtype)
                np.add.at(some, indices[:, p], points[:, p])
                sums[p] += some
                counts[p] += np.bincount(indices[:, p], minlength=books.shape[1])
        part, entry = np.nonzero(counts)
        yield pa.record_batch([
            pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
            pa.array([[str(v) for v in row] for row in sums[part, entry].tolist()], pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    return run


def _total(table: pa.Table) -> pa.Table:
    """One line of sums of a part and entry from all tasks' lines."""
    sums = [sum(map(int, column)) for column in zip(*table.column("sums").to_pylist())]
    return pa.table({
        "part": table.column("part").slice(0, 1), "entry": table.column("entry").slice(0, 1),
        "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "sums": pa.array([[str(v) for v in sums]], pa.list_(pa.string()))})


def _as_books(rows: list) -> np.ndarray:
    """Nested lists of Python integers as an array, of 64-bit integers if distances fit."""
    largest = max((abs(v) for book in rows for entry in book for v in entry), default=0)
    return np.array(rows, np.int64 if largest < 2**22 else object)


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The codebooks to start from, or None if no vector can be coded."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(1).collect()
    length = len(first[0][0]) if first else 0
    if not length or length % parts:
        return None
    rows = vectors.where(F.size("vector") == length).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    start = integers([r["vector"] for r in rows]).reshape(len(rows), parts, length // parts)
    return _as_books(start.transpose(1, 0, 2).tolist())


def improved(vectors: DataFrame, books: np.ndarray, cell: int, memo: int) -> np.ndarray:
    """The codebooks after a round."""
    lines = (vectors.mapInArrow(_sum_rows(books, cell, memo), SUMS)
             .groupBy("part", "entry").applyInArrow(_total, SUMS).collect())  # at most parts x entries lines
    made = books.tolist()
    for line in lines:
        made[line["part"]][line["entry"]] = [int(s) // line["n"] for s in line["sums"]]
    return _as_books(made)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL, memo: int = MEMO):
    """Codebooks of shape (parts, entries, width), or None if no vector can be coded."""
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = improved(vectors, books, cell, memo)
    return books


def _code_rows(books, cell, memo):
    def run(batches):
        coder = Coder(books, cell, memo)
        for some, fit, vectors in _slices(batches, books.shape[0] * books.shape[2]):
            codes, errors = [None] * len(fit), [None] * len(fit)
            if vectors is not None:
                indices, far, _ = coder.assign(vectors)
                for at, code, error in zip(np.flatnonzero(fit), indices.tolist(), far.sum(1).tolist()):
                    codes[at] = "".join(f"{i:02x}" for i in code)
                    errors[at] = Decimal(error) if error < 10**30 else None
            yield pa.record_batch([some.column("vec_id"), some.column("label"), pa.array(codes, pa.string()),
                                   pa.array(errors, pa.decimal128(38, 0))], names=["vec_id", "label", "code", "error"])

    return run


def encode(vectors: DataFrame, books: np.ndarray, cell: int = CELL, memo: int = MEMO) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every vector."""
    return vectors.mapInArrow(_code_rows(books, cell, memo), CODED)


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p][int(code[2 * p:2 * p + 2], 16)] for p in range(len(books))])


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL, memo: int = MEMO) -> DataFrame:
    """Per vector its code and error, the errors summed over its label, and the digest of the codebooks.
    Sums by label are joined back; Spark broadcasts them if they are few and else splits hot labels."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold 256 entries")
    vectors = embeddings.where(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"))
    books = fit(vectors, parts, entries, rounds, cell, memo)
    if books is None:
        coded = vectors.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("decimal(38,0)").alias("error"))
    else:
        coded = encode(vectors, books, cell, memo)
    coded = saved(coded, "codes")
    too_large = F.count_if(F.col("code").isNotNull() & F.col("error").isNull())
    sums = saved(coded.groupBy(F.col("label").alias("of_label")).agg(F.when(too_large == 0, F.sum("error")).alias("label_error")), "label-errors")

    def as_long(name):
        return F.when(F.col(name) <= F.lit(2**63 - 1), F.col(name)).cast("long").alias(name)

    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", as_long("error"), as_long("label_error"),
        F.lit(digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))
