"""Seeded samples, splits, folds and dense ranks.

Rows are ordered by the digest of their id. Digests are spread evenly whatever the data
looks like, so a digest prefix is a skew-free bucket. Counting per (stratum, prefix) finds
the one bucket that holds the cut; only that bucket's rows are ranked. The wide table is
then filtered in place against one cut row per stratum: it is never shuffled or sorted.
Where the cut falls within the rows of a repeated id, these are told apart by their content,
and equal rows by their number.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.functions import hashing as H
from steadfast.operators.metrics import running, sliced
from steadfast.operators.support import pinned

PREFIX_DIGITS = 4


def _keyed(df: DataFrame, id_col: str, strata: Sequence[str], seed) -> DataFrame:
    """Narrow (strata, id, digest, prefix) projection."""
    digest = H.digest(seed, F.col(id_col))
    return df.select(
        F.lit(0).alias("_one"), *strata, F.col(id_col).cast("string").alias("_id"),
        digest.alias("_digest"),
    ).withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))


def _prefix_totals(keyed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running counts over prefixes; at most 16^digits rows per stratum."""
    per_stratum = Window.partitionBy(*keys)
    running = per_stratum.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.groupBy(*keys, "_prefix").agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_total", F.sum("_n").over(per_stratum))
    )


def hash_cut(
    df: DataFrame, id_col: str, take: Callable[[Column], Column],
    strata: Sequence[str] = (), seed=L.SEED,
) -> DataFrame:
    """Per stratum, the last (digest, id) of its first take(total) rows in digest order, how
    many rows have this id, and how many of them are still taken."""
    keys = ["_one", *strata]
    keyed = _keyed(df, id_col, strata, seed)
    totals = _prefix_totals(keyed, keys).withColumn(
        "_take", F.least(take(F.col("_total")).cast("long"), F.col("_total"))
    )
    before = F.col("_upto") - F.col("_n")
    edge = pinned(
        totals.where((before < F.col("_take")) & (F.col("_upto") >= F.col("_take")))
        .select(*keys, "_prefix", (F.col("_take") - before).alias("_need"))
    )
    upto = Window.partitionBy(*keys).orderBy("_digest", "_id").rowsBetween(Window.unboundedPreceding, 0)
    ids = keyed.join(edge, [*keys, "_prefix"]).groupBy(*keys, "_need", "_digest", "_id").agg(F.count("*").alias("_have"))
    cut = ids.withColumn("_left", F.col("_need") - F.sum("_have").over(upto) + F.col("_have")).where(
        (F.col("_left") > 0) & (F.col("_left") <= F.col("_have"))
    )
    return pinned(cut.select(
        *keys, F.col("_digest").alias("_cut_digest"), F.col("_id").alias("_cut_id"), F.col("_have").alias("_cut_have"),
        F.col("_left").alias("_cut_left"),
    ))


def _inside(df: DataFrame, id_col: str, cut: DataFrame, strata, seed, how: str) -> tuple:
    """(rows, condition, condition): which rows fall before their stratum's cut, and which
    have the id within whose rows the cut falls."""
    digest, row_id = H.digest(seed, F.col(id_col)), F.col(id_col).cast("string")
    names = ("_cut_digest", "_cut_id", "_cut_have", "_cut_left")
    if strata:
        rows = df.withColumn("_one", F.lit(0)).join(cut, ["_one", *strata], how)
    else:  # one cut: constants, no join
        row = cut.first()
        rows = df.withColumns({n: F.lit(row[n] if row else None).cast(cut.schema[n].dataType) for n in names})
    last_digest, last_id, have, left = map(F.col, names)
    at_cut = (digest == last_digest) & (row_id == last_id)
    inside = (digest < last_digest) | ((digest == last_digest) & (row_id < last_id)) | (at_cut & (left == have))
    return rows, F.coalesce(inside, F.lit(False)), F.coalesce(at_cut & (left < have), F.lit(False))


def _divided(rows: DataFrame, columns: Sequence[str], strata: Sequence[str]) -> DataFrame:
    """Rows of ids that the cut divides, with `_in`: the first ones by content are in. Equal
    rows are counted, not ranked, so an id with very many rows is no bottleneck."""
    keys = ["_one", *strata]
    content = F.md5(F.to_json(F.struct(*columns)))
    equal = rows.withColumn("_one", F.lit(0)).groupBy(*dict.fromkeys([*keys, *columns]), "_cut_left", content.alias("score")).agg(F.count("*").alias("_n"))
    ranked = running(sliced(equal, keys), keys, "_n", ("_le", "_all"))
    taken = F.least(F.greatest(F.col("_cut_left") - (F.col("_le") - F.col("_n")), F.lit(0)), F.col("_n"))
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_n")), lambda i: i <= taken)
    return ranked.withColumn("_in", F.explode(copies)).select(*columns, "_in")


def seeded_sample(
    df: DataFrame, id_col: str, n: int | Column, strata: Sequence[str] = (), seed=L.SEED
) -> DataFrame:
    """The n rows first in digest order (per stratum). A smaller n gives a prefix."""
    size = n if isinstance(n, Column) else F.lit(n)
    cut = hash_cut(df, id_col, lambda total: size, strata, seed)
    joined, inside, divided = _inside(df, id_col, cut, strata, seed, "inner")
    whole = joined.where(inside).select(*df.columns)
    if not cut.where("_cut_left < _cut_have").take(1):
        return whole
    return whole.unionByName(_divided(joined.where(divided), df.columns, strata).where("_in").drop("_in"))


def stratified_split(
    df: DataFrame, id_col: str, label_col: str = "label",
    test_fraction: float = L.TEST_FRACTION, seed=L.SEED,
) -> DataFrame:
    """Adds split = test for ceil(fraction * n) rows of each label, train for the rest."""
    cut = hash_cut(
        df, id_col, lambda total: F.ceil(total * F.lit(test_fraction)), [label_col], seed
    )
    joined, inside, divided = _inside(df, id_col, cut, [label_col], seed, "left")
    named = lambda test: F.when(test, "test").otherwise("train").alias("split")
    columns = [c for c in df.columns if c != "split"]
    if not cut.where("_cut_left < _cut_have").take(1):
        return joined.select(*columns, named(inside))
    parted = _divided(joined.where(divided), columns, [label_col])
    return joined.where(~divided).select(*columns, named(inside)).unionByName(parted.select(*columns, named(F.col("_in"))))


def hash_ranks(
    df: DataFrame, id_col: str, strata: Sequence[str] = (), seed=L.SEED, name: str = "rank"
) -> DataFrame:
    """Dense 1-based rank of every row within its stratum, in digest order. The window runs
    inside a digest prefix; a count table supplies what came before."""
    keys = ["_one", *strata, "_prefix"]
    digest = H.digest(seed, F.col(id_col))
    rows = df.withColumns({
        "_one": F.lit(0), "_digest": digest, "_prefix": F.substring(digest, 1, PREFIX_DIGITS),
    })
    offsets = _prefix_totals(_keyed(df, id_col, strata, seed), keys[:-1]).select(
        *keys, (F.col("_upto") - F.col("_n")).alias("_before")
    )
    local = Window.partitionBy(*keys).orderBy("_digest", F.col(id_col).cast("string"))
    return (
        rows.withColumn("_local", F.row_number().over(local))
        .join(offsets, keys)
        .select(*df.columns, (F.col("_before") + F.col("_local")).alias(name))
    )


def stratified_folds(
    df: DataFrame, id_col: str, label_col: str = "label", k: int = L.CV_FOLDS, seed=L.SEED
) -> DataFrame:
    ranked = hash_ranks(df, id_col, [label_col], seed, "_fold_rank")
    fold = ((F.col("_fold_rank") - 1) % F.lit(k)).cast("int")
    return ranked.select(*df.columns, fold.alias("fold"))
