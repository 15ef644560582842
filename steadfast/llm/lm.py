"""Language-model scores by deleted interpolation.

A word's probability mixes the maximum-likelihood estimates of the bigram and of the word with a
uniform share; the mixture weights depend on how often the context was seen (buckets by powers of
two) and are learned by expectation-maximisation on a part of the training documents, under counts
from which that part is deleted. A text's context before its first word is the end token.

Counting and looking up are one exchange. Documents are gathered into chunks of some megabytes,
written once as sequences of local word numbers. Each chunk asks for its distinct words and bigrams
only, as sorted hashes with the chunk's own counts; a bucket of the hash range adds up the counts
of all chunks and answers each chunk in the order asked. Words are told apart by 64-bit hashes,
bigrams by 56-bit ones. A frequent word costs one number a chunk, so no key is hot.

Null and empty texts consist of the end token. A null id falls into fold 0 and is held out.
Repeated rows each count and give a row each. Without training documents every text has
probability 1. Only doc_id and text are read.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.llm.common import fold, partitions, saved, slices, texts_of

CHUNK_BYTES = 6 << 20
REQUESTS_PER_BUCKET = 1_500_000
STEPS = 12
PART = 1  # this fold's documents are the deleted part that the weights are learned on
CONTEXTS = 65
END = xxhash.xxh3_64_intdigest(b"\n")
CHUNK = "chunk string, part boolean, tokens long, docs array<long>, folds binary, sizes binary, words binary, seq binary"
REQUEST = "bucket int, chunk string, part boolean, words binary, word_counts binary, pairs binary, pair_counts binary"
REPLY = "chunk string, part boolean, bucket int, words binary, pairs binary, tokens long, part_tokens long, kinds long"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def packed_sorted(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


class Numbers(dict):
    """Local numbers of words, in order of first sight. The end token is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def _chunks(batches):
    task = TaskContext.get()
    name = f"{task.partitionId()}"
    made = 0

    class Open:
        def __init__(self):
            self.known, self.docs, self.folds, self.seqs, self.bytes = Numbers(), [], [], [], 0

    def closed(open_, part):
        nonlocal made
        made += 1
        words = [END, *map(xxhash.xxh3_64_intdigest, open_.known)]
        seq = np.concatenate(open_.seqs)
        return pa.record_batch([
            pa.array([f"{name}-{made}"]), pa.array([part]), pa.array([len(seq)]), pa.array([open_.docs], pa.list_(pa.int64())),
            pa.array([bytes(open_.folds)], pa.binary()), pa.array([packed(np.array([len(s) for s in open_.seqs]))], pa.binary()),
            pa.array([np.array(words, "<u8").tobytes()], pa.binary()), pa.array([packed(seq)], pa.binary()),
        ], names=["chunk", "part", "tokens", "docs", "folds", "sizes", "words", "seq"])

    opened = {True: Open(), False: Open()}
    for batch in slices(batches):
        columns = batch.column("doc_id").to_pylist(), batch.column("fold").to_pylist(), texts_of(batch)
        for doc, fold_, text in zip(*columns):
            part, raw = fold_ == PART, text.encode()
            here = opened[part]
            here.docs.append(doc)
            here.folds.append(fold_)
            here.seqs.append(np.array([*map(here.known.__getitem__, raw.lower().split()), 0], np.uint32))
            here.bytes += len(raw)
            if here.bytes >= CHUNK_BYTES:
                yield closed(here, part)
                opened[part] = Open()
    for part, here in opened.items():
        if here.docs:
            yield closed(here, part)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Grams:
    """The distinct words and bigrams of a chunk in order of their hashes, and where the chunk's
    tokens have theirs."""

    def __init__(self, row: dict):
        words = np.frombuffer(row["words"], "<u8")
        seq = unpacked(row["seq"]).astype(np.int64)
        sizes = unpacked(row["sizes"]).astype(np.int64)
        self.ends = np.cumsum(sizes)
        before = np.empty_like(seq)
        before[1:] = seq[:-1]
        before[self.ends - sizes] = 0
        pairs, place = np.unique(before * len(words) + seq, return_inverse=True)
        hashes = _mixed(words[pairs // len(words)] * np.uint64(3) + _mixed(words[pairs % len(words)])) >> np.uint64(8)
        self.words, self.pairs = self._ordered(words), self._ordered(hashes)
        self.word_at, self.before_at, self.pair_at = self.words[1][seq], self.words[1][before], self.pairs[1][place]
        self.docs, self.sizes = row["docs"], sizes
        self.folds = np.frombuffer(row["folds"], np.uint8)

    @staticmethod
    def _ordered(hashes):
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return hashes[order], rank


def _edges(hashes: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket of the hash range begins among sorted hashes, and the end."""
    starts = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, starts), [len(hashes)]]).astype(np.int64)


def _requests(buckets):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row)
                taught = np.repeat((grams.folds != 0).astype(float), grams.sizes)
                counts = [np.bincount(at, taught, len(h)).astype(np.int64) for (h, _), at in
                          ((grams.words, grams.word_at), (grams.pairs, grams.pair_at))]
                spans = [_edges(grams.words[0], 64, buckets), _edges(grams.pairs[0], 56, buckets)]
                rows = []
                for b in range(buckets):
                    (a, z), (c, y) = spans[0][b:b + 2], spans[1][b:b + 2]
                    if z > a or y > c:
                        rows.append((b, packed_sorted(grams.words[0][a:z]), packed(counts[0][a:z]),
                                     packed_sorted(grams.pairs[0][c:y]), packed(counts[1][c:y])))
                columns = list(zip(*rows))
                yield pa.record_batch([
                    pa.array(columns[0], pa.int32()), pa.array([row["chunk"]] * len(rows)), pa.array([row["part"]] * len(rows)),
                    *(pa.array(c, pa.binary()) for c in columns[1:])],
                    names=["bucket", "chunk", "part", "words", "word_counts", "pairs", "pair_counts"])

    return run


def _added(asked: list[tuple[np.ndarray, np.ndarray, bool]]):
    """For each request, its hashes' counts over all requests, and those of the deleted part."""
    hashes, place = np.unique(np.concatenate([h for h, _, _ in asked]), return_inverse=True)
    every = np.bincount(place, np.concatenate([n for _, n, _ in asked]), len(hashes)).astype(np.int64)
    part = np.bincount(place, np.concatenate([n * p for _, n, p in asked]), len(hashes)).astype(np.int64)
    cuts = np.cumsum([len(h) for h, _, _ in asked])[:-1]
    return every, part, np.split(place, cuts)


def _replies(batches):
    """One bucket: all its requests, added up and answered."""
    rows = [row for batch in batches for row in batch.to_pylist()]
    for bucket in sorted({r["bucket"] for r in rows}):
        own = [r for r in rows if r["bucket"] == bucket]
        words = _added([(unpacked_sorted(r["words"]), unpacked(r["word_counts"]).astype(float), r["part"]) for r in own])
        pairs = _added([(unpacked_sorted(r["pairs"]), unpacked(r["pair_counts"]).astype(float), r["part"]) for r in own])
        for r, w, p in zip(own, words[2], pairs[2]):
            # the deleted part's chunks also learn how much of each count is the part's
            sent = [packed(np.concatenate([every[at], part[at]]) if r["part"] else every[at])
                    for every, part, at in ((words[0], words[1], w), (pairs[0], pairs[1], p))]
            yield _reply(r["chunk"], r["part"], bucket, *sent, None, None, None)
        yield _reply("", False, bucket, None, None, int(words[0].sum()), int(words[1].sum()), int((words[0] > 0).sum()))


def _reply(*values):
    kinds = [pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)],
                           names=["chunk", "part", "bucket", "words", "pairs", "tokens", "part_tokens", "kinds"])


def _answered(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """Chunks with their replies, together in a partition and in order; the chunk comes last."""
    last = F.lit(2**31 - 1).cast("int")
    asked = chunks.select("chunk", "part", last.alias("bucket"), "docs", "folds", "sizes", "words", "seq", F.lit(None).cast("binary").alias("pairs"))
    told = replies.select("chunk", "part", "bucket", F.lit(None).cast("array<long>").alias("docs"), *(
        F.lit(None).cast("binary").alias(c) for c in ("folds", "sizes")), "words", F.lit(None).cast("binary").alias("seq"), "pairs")
    n = partitions(chunks.sparkSession)
    return asked.unionByName(told).repartition(n, "chunk").sortWithinPartitions("chunk", "bucket")


def _with_counts(batches):
    """(grams, counts of words, counts of pairs) of each chunk; the counts by all and by part."""
    words, pairs = [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["seq"] is None:
                words.append(unpacked(row["words"]).astype(np.int64))
                pairs.append(unpacked(row["pairs"]).astype(np.int64))
                continue
            both = [[np.concatenate(x) for x in zip(*(np.split(v, 2) if row["part"] else (v, v[:0]) for v in values))]
                    for values in (words, pairs)]
            words, pairs = [], []
            yield Grams(row), both[0], both[1]


def _held_out(batches):
    """The deleted part's distinct events: counts without the part, and how often they occur."""
    for grams, (words, own_words), (pairs, own_pairs) in _with_counts(batches):
        words, pairs = words - own_words, pairs - own_pairs
        events, times = np.unique(np.stack([pairs[grams.pair_at], words[grams.before_at], words[grams.word_at]]), axis=1, return_counts=True)
        yield pa.record_batch([pa.array([packed(x)], pa.binary()) for x in (*events, times)],
                              names=["pair", "context", "word", "times"])


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for unseen, else one more than the power of two below the count."""
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def estimates(pair, context, word, tokens: int, kinds: int) -> np.ndarray:
    """Rows: bigram, word and uniform estimates."""
    return np.stack([pair / np.maximum(context, 1), word / max(tokens, 1), np.full(len(word), 1 / (kinds + 1))])


def _expect(weights, tokens, kinds):
    def run(batches):
        sums = np.zeros((CONTEXTS, 3))
        for batch in batches:
            for row in batch.to_pylist():
                pair, context, word, times = (unpacked(row[c]).astype(float) for c in ("pair", "context", "word", "times"))
                at = context_bucket(context)
                share = weights[at].T * estimates(pair, context, word, tokens, kinds)
                share *= times / share.sum(axis=0)
                for i in range(3):
                    sums[:, i] += np.bincount(at, share[i], CONTEXTS)
        used = np.flatnonzero(sums.any(axis=1))
        yield pa.record_batch([pa.array(used, pa.int32()), *(pa.array(sums[used, i]) for i in range(3))], names=["at", "s0", "s1", "s2"])

    return run


def learn_weights(events: DataFrame, tokens: int, kinds: int, steps: int = STEPS) -> np.ndarray:
    """Mixture weights by context bucket. An event counts once more in each estimate, so that none
    vanishes; buckets without events take those of the next lower one. An unseen context has no
    bigram estimate."""
    weights = np.full((CONTEXTS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    for _ in range(steps):
        rows = (events.mapInArrow(_expect(weights, tokens, kinds), "at int, s0 double, s1 double, s2 double")
                .groupBy("at").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(3))).collect())  # a row a bucket
        sums = np.zeros((CONTEXTS, 3))
        for r in rows:
            sums[r["at"]] = r["s0"], r["s1"], r["s2"]
        seen = sums.sum(axis=1) > 0
        sums += 1
        sums[0, 0] = 0
        weights = sums / sums.sum(axis=1, keepdims=True)
        for b in range(2, CONTEXTS):
            if not seen[b]:
                weights[b] = weights[b - 1]
    if not tokens:
        weights[:] = 0, 0, 1
    return weights


def _score(weights, tokens, kinds):
    def run(batches):
        for grams, (words, _), (pairs, _) in _with_counts(batches):
            word, context, pair = words[grams.word_at], words[grams.before_at], pairs[grams.pair_at]
            base = np.log10((word + 0.1) / (tokens + 0.1 * (kinds + 1)))
            value = np.log10((weights[context_bucket(context)].T * estimates(pair, context, word, tokens, kinds)).sum(axis=0))
            starts = grams.ends - grams.sizes
            yield pa.record_batch([
                pa.array(grams.docs, pa.int64()), pa.array(grams.folds == 0), pa.array(grams.sizes),
                pa.array(np.add.reduceat((word > 0).astype(np.int64), starts)), pa.array(np.full(len(starts), tokens, np.int64)),
                pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(value, starts))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """Per document: its tokens, those known from training, the add-a-tenth unigram score and the
    model's log10 probability. Fold 0 of the ids' checksum is held out from training."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(modulus).cast("int").alias("fold"), "text")
    chunks = saved(rows.mapInArrow(_chunks, CHUNK), "chunks")
    size = chunks.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(partitions(spark), size // REQUESTS_PER_BUCKET)
    asked = chunks.mapInArrow(_requests(buckets), REQUEST)
    replies = saved(asked.repartitionById(buckets, F.col("bucket")).mapInArrow(_replies, REPLY), "replies")
    total = replies.where("chunk = ''").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "part_tokens", "kinds"))).first()
    tokens, part_tokens, kinds = total
    told = replies.where("chunk != ''")
    events = saved(_answered(chunks.where("part"), told.where("part"))
                   .mapInArrow(_held_out, "pair binary, context binary, word binary, times binary"), "events")
    weights = learn_weights(events, tokens - part_tokens, kinds)
    if not tokens:
        weights[:] = 0, 0, 1
    return _answered(chunks, told).mapInArrow(_score(weights, tokens, kinds), SCORES)
