"""Exact top-k by integer inner product, block at a time.

Components become floor(256 * x). Rows lie in ranges of vec_id; within a range, rows that lie near
each other share blocks of BLOCK rows (halved again and again across the direction in which they spread
most), as narrow blocks have bounds that rule them out; a block keeps each component's maximum and minimum, and its rows as they are (its forward index).
For a query, the sum of its components times a block's matching extremes bounds every score in the
block. Blocks are taken by falling bound and scored until the bound is below the k-th score so far;
equal bounds are still scored, as a smaller id may be in there. Where vectors have no structure that blocks could share, all are scored. Each range gives its k best and the
ranges' are merged. Queries are dealt to all ranges in groups, so that a task has one range and
at most QUERIES queries whatever the table's size.

Vectors that are null or empty, or hold null or non-finite components, take no part. Vectors of different
lengths aren't compared. Products are exact at any size: in floating point or 64-bit integers where they
fit, else in integers of any size; a score beyond a long is given as the nearest long. Rows that share an
id are rows of their own, as candidates and as queries, whose results are then merged by that id; a row
is no candidate for its own id. A range of more than ROWS rows of one id is dealt to several tasks. A null
id takes no part. No rows give no rows. Only vec_id and the vector are read.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
BLOCK = 64
STEPS = 3
ROWS = 8192
QUERIES = 100_000
LONG = 2**63 - 1
FOUND = "query_id long, vec_id long, score long"


def scaled(vector: Column) -> Column:
    """floor(256 * x), as doubles: these hold it exactly whatever its size."""
    return F.transform(vector, lambda x: F.when(F.abs(x) < 2**44, F.floor(256 * x.cast("double")).cast("double")).otherwise(256 * x.cast("double")))


def usable(vector: Column) -> Column:
    """Not null or empty, and every component finite, scaled too."""
    fits = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fits), F.lit(False))


def whole(rows) -> np.ndarray:
    """Whole numbers in doubles as 64-bit integers, or as integers of any size."""
    x = np.asarray(rows, np.float64)
    if np.abs(x).max(initial=0) < 2**53:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def by_nearness(rows: np.ndarray) -> np.ndarray:
    """An order in which each block of rows lies close together: rows are halved, at a multiple of
    BLOCK, by their place along the direction of most spread, which a few power steps find."""
    near = rows / max(1.0, np.abs(rows).max(initial=0))
    order, parts = np.arange(len(rows)), [(0, len(rows))]
    while parts:
        a, z = parts.pop()
        if z - a <= BLOCK:
            continue
        centred = near[order[a:z]] - near[order[a:z]].mean(axis=0)
        along = centred[np.argmax((centred * centred).sum(axis=1))]
        for _ in range(STEPS):
            along = (centred @ along) @ centred
            along = along / max(np.linalg.norm(along), 1e-300)
        half = -(-(z - a) // (2 * BLOCK)) * BLOCK
        order[a:z] = order[a:z][np.argpartition(centred @ along, half - 1)]
        parts += [(a, a + half), (a + half, z)]
    return order


class Blocks:
    """A range's vectors of one length, in blocks with their extremes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        # sums of products are exact in floating point while they stay below 2**53
        order = by_nearness(rows.astype(float))
        ids, rows = ids[order], rows[order]
        self.ids, self.largest, self.scored = ids, int(np.abs(rows).max()), 0
        self.rows, self.floats = rows, rows.astype(float)
        self.starts = np.arange(0, len(ids), BLOCK)
        self.top = np.maximum.reduceat(rows, self.starts).astype(float)
        self.low = np.minimum.reduceat(rows, self.starts).astype(float)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        slack = 1 + 1e-12  # floating sums of large numbers may fall short
        value = self.top @ np.maximum(query, 0) + self.low @ np.minimum(query, 0)
        return value + np.abs(value) * (slack - 1)

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        most = self.largest * int(np.abs(query).sum())
        if most < 2**53:
            rows, query = self.floats, query.astype(float)
        else:
            kind = np.int64 if most < 2**63 else object
            rows, query = self.rows.astype(kind), query.astype(kind)
        bounds = self.bounds(query.astype(float))
        ids, scores = np.zeros(0, np.int64), np.zeros(0, object if most >= 2**63 else np.int64)
        for b in np.argsort(-bounds, kind="stable"):
            if len(scores) == k and bounds[b] < scores[-1]:
                break
            at = slice(self.starts[b], self.starts[b] + BLOCK)
            self.scored += 1
            own = (rows[at] @ query).astype(scores.dtype)
            other = self.ids[at] != query_id
            if len(scores) == k:
                other &= own >= scores[-1]
                if not other.any():
                    continue
            ids, scores = np.concatenate([ids, self.ids[at][other]]), np.concatenate([scores, own[other]])
            first = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[first], scores[first]
        return ids, np.clip(scores, -LONG - 1, LONG).astype(np.int64)


def _search(k):
    def run(batches):
        kept: dict[int, tuple[list, list]] = {}
        blocks: dict[int, Blocks] | None = None
        for batch in batches:
            found = ([], [], [])
            columns = (batch.column(c) for c in ("asks", "vec_id", "vector"))
            for asks, vec_id, vector in zip(*(c.to_pylist() for c in columns)):
                if not asks:
                    ids, rows = kept.setdefault(len(vector), ([], []))
                    ids.append(vec_id)
                    rows.append(vector)
                    continue
                if blocks is None:
                    blocks = {n: Blocks(np.array(ids, np.int64), whole(rows)) for n, (ids, rows) in kept.items()}
                    kept.clear()
                if len(vector) in blocks:
                    ids, scores = blocks[len(vector)].best(vec_id, whole(vector), k)
                    found[0].append(np.full(len(ids), vec_id, np.int64))
                    found[1].append(ids)
                    found[2].append(scores)
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in found],
                                  names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k best of `vectors` for each of `queries` (vec_id, vector), itself excluded: query_id,
    rank from 1, vec_id, score; ties to the smaller id. Vectors are integers."""
    spark = vectors.sparkSession
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first")).first()
    n_queries = queries.count()
    if not size["n"] or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wanted, teams = -(-size["n"] // ROWS), -(-n_queries // QUERIES)
    shares = [i / wanted for i in range(1, wanted)]
    cuts = vectors.agg(F.percentile_approx("vec_id", shares, max(10_000, 4 * wanted))).first()[0] if shares else []
    starts = np.array(sorted({size["first"], *cuts}), np.int64)
    @F.pandas_udf("int")
    def range_of(vec_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, vec_id.to_numpy(np.int64), "right") - 1)

    # a range is cut between ids; where one id fills more than a range, its rows are dealt to several
    sizes = np.zeros(len(starts), np.int64)
    for row in vectors.groupBy(range_of("vec_id").alias("range")).count().collect():  # a line a range
        sizes[row["range"]] = row["count"]
    pieces = np.maximum(1, sizes // (2 * ROWS))
    first = np.cumsum(pieces) - pieces
    ranges = int(pieces.sum())

    @F.pandas_udf("int")
    def piece_of(vec_id: pd.Series, row: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, vec_id.to_numpy(np.int64), "right") - 1
        return pd.Series(first[at] + row.to_numpy(np.int64) % pieces[at])

    held = vectors.select("vec_id", "vector", piece_of("vec_id", F.monotonically_increasing_id()).alias("range")).select(
        F.explode(F.sequence(F.lit(0), F.lit(teams - 1))).alias("team"), F.lit(False).alias("asks"), "vec_id", "vector", "range")
    asking = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(teams)).cast("int").alias("team"), F.lit(True).alias("asks"), "vec_id", "vector",
                            F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"))
    both = held.unionByName(asking).withColumn("task", F.col("team") * ranges + F.col("range"))
    found = (both.repartitionById(ranges * teams, F.col("task")).sortWithinPartitions("asks", "vec_id", "vector")
             .select("asks", "vec_id", "vector").mapInArrow(_search(k), FOUND))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(embeddings: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """Queries are the rows whose id is divisible by `every`, candidates all rows but the own."""
    vectors = (embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
               .select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("vector")))
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)
