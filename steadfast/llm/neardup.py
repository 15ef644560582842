"""Near duplicates by a multi-index Hamming join over minwise signatures.

A text's set holds its distinct runs of five words. Texts with equal sets form a class, found by
the set's digest. A class's signature has `width` symbols of 16 bits for each of `chunks` chunks,
each symbol taken from the smallest of the set under another hash. Two signatures that differ in
fewer than 2 * chunks symbols have, by the pigeonhole principle, a chunk that differs in one symbol
at most; so each chunk is indexed once for each symbol left out, and every pair below that distance
shares an index entry. `chunks_for` takes so many chunks that a pair of the required similarity has
a shared entry but for one pair in a million; in fact more do, as far pairs often share one too.

Pairs are not listed within an entry. First each class is held against the entry's centre only, on
full sets: the class that shares most entries with others. What is linked so needs no more
comparison among itself. In entries whose other members are still in different components, pairs
across components are compared, but for those that can't be links by two bounds on what they have
in common. A shingle that only one class has is in no intersection. And of the centre's shingles,
two classes share those that neither lacks; what each lacks is kept as bits from its comparison
with the centre. So near copies that differ from their centre in different places are told apart
without their texts. Components of all confirmed links give the groups.

Null, empty and blank texts have an empty set and stand alone. Rows with equal sets are one class,
so copies and repeated rows cost a row each. Only doc_id and text are read.
"""

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfast.llm.common import dealt, saved, slices
from steadfast.llm.components import components

WORDS = 5
WIDTH = 6
#: A pair of the required similarity shares no index entry less often than this.
MISSED = 1e-6
PIECE = 4096


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Ascending 64-bit hashes of a text's distinct runs of five words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    run = min(WORDS, len(words))
    h = np.full(len(words) - run + 1, run, np.uint64)
    for i in range(run):
        h = _mixed(h + hashes[i:len(hashes) - run + 1 + i])
    return np.unique(h)


@lru_cache(maxsize=4)
def _multipliers(symbols: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, symbols: int) -> np.ndarray:
    """The 16-bit symbols of a set that isn't empty."""
    by, least = _multipliers(symbols)[:, None], np.full(symbols, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), PIECE):
        h = by * hashes[None, at:at + PIECE]
        np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=1), out=least)
    return (_mixed(least) >> np.uint64(48)).astype("<u2")


def chunks_for(similarity: float) -> int:
    """So many chunks that a pair of this similarity shares an entry but for MISSED of all."""
    shared = similarity**WIDTH + WIDTH * (1 - similarity) * similarity ** (WIDTH - 1)
    return math.ceil(math.log(MISSED) / math.log(1 - shared)) // 2 * 2 + 2


def row_key() -> Column:
    """A digest of a row's id and text, null or not."""
    known = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(known, F.coalesce(F.concat(F.lit(":"), F.col("text")), F.lit("")))))


def sets(docs: DataFrame, symbols: int) -> DataFrame:
    """Per row: its id and key, the size and digest of its set, and the set's signature."""
    def run(batches):
        for batch in slices(batches):
            made = []
            for text in batch.column("text").to_pylist():
                h = shingles(text)
                made.append((len(h), xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63 if len(h) else None,
                             signature(h, symbols).view("<i8") if len(h) else None))
            n, node, sig = zip(*made) if made else ([], [], [])
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                                   pa.array(sig, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "node", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text").mapInArrow(
        run, "doc_id long, key binary, n_shingles long, node long, sig array<long>")


def entries(classes: DataFrame, chunks: int) -> DataFrame:
    """(entry, node): each chunk of each signature, once for each symbol left out."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            flat = batch.column("sig").flatten().to_numpy(zero_copy_only=False)
            sig = flat.view("<u2").reshape(n, chunks, WIDTH).astype(np.uint64)
            keys = np.empty((n, chunks, WIDTH), np.uint64)
            for out in range(WIDTH):
                h = np.arange(chunks, dtype=np.uint64)[None, :] * np.uint64(WIDTH) + np.uint64(out + 1)
                h = np.broadcast_to(h, (n, chunks))
                for i in range(WIDTH):
                    if i != out:
                        h = _mixed(h * np.uint64(65537) + sig[:, :, i])
                keys[:, :, out] = h
            yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)),
                                   pa.array(np.repeat(batch.column("node").to_numpy(), chunks * WIDTH))],
                                  names=["entry", "node"])

    return classes.select("node", "sig").mapInArrow(run, "entry long, node long")


def compared(pairs: DataFrame, texts: DataFrame, similarity_pct: int) -> DataFrame:
    """Pairs (a, b) on full sets: whether they are similar enough, the size of a's set, the bits
    of its ascending shingles that b lacks, and how many b has besides."""
    def run(batches):
        @lru_cache(maxsize=64)
        def known(text):
            return shingles(text)

        for batch in slices(batches):
            linked, size, lacks, extra = [], [], [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = known(x), shingles(y)
                missing = ~np.isin(x, y, assume_unique=True)
                both = len(x) - int(missing.sum())
                linked.append(100 * both >= similarity_pct * (len(x) + len(y) - both))
                size.append(len(x))
                lacks.append(np.packbits(np.pad(missing, (0, -len(x) % 64))).view(np.int64))
                extra.append(len(y) - both)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(size, pa.int64()),
                                   pa.array(lacks, pa.list_(pa.int64())), pa.array(extra, pa.int64())],
                                  names=["a", "b", "linked", "size", "lacks", "extra"])

    joined = (pairs.join(dealt(texts.select(F.col("node").alias("b"), F.col("text").alias("y"))), "b")
              .join(dealt(texts.select(F.col("node").alias("a"), F.col("text").alias("x"))), "a"))
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean, size long, lacks array<long>, extra long")


def texts_for(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """One text for each class in a pair."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(dealt(classes.select("node", "key")), "node")
    rows = docs.select(row_key().alias("key"), "text").join(dealt(wanted), "key").select("node", "text")
    return saved(rows.dropDuplicates(["node"]), "texts")


def _across(rows: DataFrame) -> DataFrame:
    """Rows of entries whose members are in different components."""
    mixed = (rows.groupBy("entry").agg(F.min("root").alias("lowest"), F.max("root").alias("highest"))
             .where("lowest != highest").select("entry"))
    return rows.join(dealt(mixed), "entry")


def own_shingles(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, own): how many shingles of a class no other class of `rows` has, centres included."""
    def run(batches):
        for batch in slices(batches):
            made = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(np.repeat(batch.column("node").to_numpy(), [len(h) for h in made])),
                                   pa.array(np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64))],
                                  names=["node", "shingle"])

    wanted = rows.select(F.explode(F.array("node", "centre")).alias("node")).distinct()
    spread = texts.join(dealt(wanted), "node").select("node", "text").mapInArrow(run, "node long, shingle long")
    return (spread.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
            .where("node = last").groupBy("node").agg(F.count(F.lit(1)).alias("own")))


def _rooted(docs: DataFrame, similarity_pct: int) -> tuple[DataFrame, DataFrame]:
    """Per row: doc_id, key, n_shingles, node. Per class: node, its smallest doc_id `rep`, the key
    of its first row, whether that has no id, and `root`, which the classes of a group share."""
    similarity = similarity_pct / 100
    chunks = chunks_for(similarity)
    symbols = chunks * WIDTH
    rows = saved(sets(docs, symbols), "sets")
    classes = saved(rows.where("node is not null").groupBy("node")
                    .agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("first"),
                         F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
                    .select("node", "first.unknown", F.col("first.doc_id").alias("rep"), "first.key", "n", "sig"), "classes")
    index = entries(classes, chunks)
    crowded = index.groupBy("entry").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = saved(index.join(dealt(crowded), "entry"), "shared")

    # each class against the centre of its entries: the class that shares most
    reach = shared.groupBy("node").agg(F.sum("members").alias("reach"))
    centres = (shared.join(dealt(reach), "node").groupBy("entry").agg(F.max(F.struct("reach", "node")).alias("most"))
               .select("entry", F.col("most.node").alias("centre")))
    centred = saved(shared.join(dealt(centres), "entry"), "centred")
    sizes = classes.select("node", "n")
    possible = 100 * F.least("n_a", "n_b") >= similarity_pct * F.greatest("n_a", "n_b")
    first = saved(centred.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
                  .join(dealt(sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a"))), "a")
                  .join(dealt(sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b"))), "b").where(possible).select("a", "b"), "pairs")
    several = centred.where("members > 2 and node != centre").select("entry", "node", "centre")
    texts = texts_for(several.select(F.col("centre").alias("a"), F.col("node").alias("b")).unionByName(first), classes, docs)
    tested = saved(compared(first, texts, similarity_pct), "tested")
    links = tested.where("linked").select("a", "b")
    roots = components(links)

    # what entries have left: pairs across components, but for those that can't be similar enough
    placed = several.join(dealt(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_rows = saved(_across(placed), "open")
    sized = (open_rows.join(dealt(sizes), "node").join(dealt(own_shingles(open_rows, texts)), "node", "left")
             .withColumn("own", F.coalesce("own", F.lit(0))).withColumn("common", F.col("n") - F.col("own")))
    least = sized.groupBy("entry").agg(F.min("n").alias("least"))
    hopeful = saved(sized.join(dealt(least), "entry")
                    .where(100 * F.col("common") >= similarity_pct * (F.col("own") + F.col("least"))).drop("least"), "hopeful")
    left = saved(_across(hopeful).join(dealt(tested.select(F.col("a").alias("centre"), F.col("b").alias("node"), "size", "lacks", "extra")),
                                       ["centre", "node"], "left").withColumn("extra", F.col("extra") - F.col("own")), "left")
    # members of an entry's largest component are compared with all others, not with each other
    counts = left.groupBy("entry", "root").agg(F.count(F.lit(1)).alias("members"))
    largest = counts.groupBy("entry").agg(F.max(F.struct("members", "root")).alias("most")).select("entry", F.col("most.root").alias("main"))
    sided = left.join(dealt(largest), "entry").withColumn("outside", F.col("root") != F.col("main"))
    side = lambda s: sided.select("entry", *(F.col(c).alias(f"{c}_{s}") for c in
                                             ("node", "root", "n", "common", "size", "lacks", "extra", "outside")))
    enough = lambda both: 100 * both >= similarity_pct * (F.col("n_a") + F.col("n_b") - both)
    lacked = F.aggregate(F.zip_with("lacks_a", "lacks_b", lambda p, q: F.bit_count(p.bitwiseOR(q))), F.lit(0), lambda n, v: n + v)
    shared_most = F.col("size_a") - lacked + F.least("extra_a", "extra_b")
    across = (side("a").where("outside_a").join(dealt(side("b")), "entry")
              .where((F.col("root_a") != F.col("root_b")) & (~F.col("outside_b") | (F.col("node_a") < F.col("node_b")))
                     & enough(F.least("common_a", "common_b")) & F.coalesce(enough(shared_most), F.lit(True))))
    second = (across.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
              .join(dealt(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), ["a", "b"], "left_anti"))
    second = saved(second, "pairs")
    more = saved(compared(second, texts, similarity_pct).where("linked").select("a", "b"), "links")
    if more.take(1):
        roots = components(links.unionByName(more))

    # a class without links stands for its own copies
    return rows, (classes.select("node", "unknown", "rep", "key").join(dealt(roots), "node", "left")
                  .withColumn("root", F.coalesce("root", "node")))


def groups(docs: DataFrame, similarity_pct: int = 80) -> DataFrame:
    """Per row: doc_id, the size of its set, the smallest doc_id of its group and whether that is
    its own."""
    rows, of_class = _rooted(docs, similarity_pct)
    least = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = of_class.join(dealt(least), "root").select("node", "component_id")
    found = (rows.where("node is not null").select("doc_id", "n_shingles", "node").join(dealt(named), "node")
             .select("doc_id", "n_shingles", "component_id"))
    alone = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def kept_keys(docs: DataFrame, similarity_pct: int = 80) -> DataFrame:
    """The key of one row of each group: of the smallest id, or of no id if none has any."""
    rows, of_class = _rooted(docs, similarity_pct)
    first = of_class.groupBy("root").agg(F.min(F.struct("unknown", "rep", "key")).alias("first")).select("first.key")
    return first.unionByName(rows.where("node is null").select("key")).distinct()
