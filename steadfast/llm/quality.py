"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Words (runs of word characters, runs of signs, and a mark for words in capitals) are hashed to
SLOTS places. A place's index vector is a few signed ones; its word vector is the sum of the index
vectors of all neighbours within WINDOW places, over all documents. A document is the mean and the
spread of its words' vectors. A two-layer network in numpy is fitted on at most `sample` labelled
rows, the smallest by a hash of their id; its logits are divided by a temperature fitted on a part
that the weights haven't seen.

Null and empty texts have zero vectors and the score the network gives these. Labels that are null
teach nothing; with no label at all, every score is 0.5. A document with several labels teaches
each of them. Repeated rows give a row each. Only doc_id and text of documents are read.
"""

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.llm.common import dealt, fold, saved, slices, texts_of

SLOTS = 4096
WIDTH = 48
ONES = 4
WINDOW = 2
SAMPLE = 20_000
HIDDEN = 32
THRESHOLD = 0.3
WORD = re.compile(r"\w+|[^\w\s]+")
CAPITALS = 0
KNOWN = 400_000
SUMS = "slot int, " + ", ".join(f"v{i} long" for i in range(WIDTH))


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Of each place: the dimensions of its ones, and their signs. Fixed by a seed."""
    rng = np.random.default_rng(20)
    return rng.integers(0, WIDTH, (SLOTS, ONES)), rng.choice([-1, 1], (SLOTS, ONES))


class Words(dict):
    """Places of words, remembered up to a limit."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        place = 1 + zlib.crc32(word.lower().encode()) % (SLOTS - 1)
        place = -place if len(word) > 1 and word.isupper() else place
        self[word] = place
        return place


def places(text: str, known: Words) -> np.ndarray:
    """A text's words as places; a word in capitals is followed by the mark for that."""
    words = np.array([known[w] for w in WORD.findall(text)], np.int64)
    capital = words < 0
    if not capital.any():
        return words
    return np.insert(np.abs(words), np.flatnonzero(capital) + 1, CAPITALS)


def _contexts(batches):
    dims, signs = _index()
    known, sums = Words(), np.zeros(SLOTS * WIDTH)
    for batch in slices(batches):
        flat, weight = [], []

        def add():
            if flat:
                sums[:] += np.bincount(np.concatenate(flat), np.concatenate(weight), SLOTS * WIDTH)
                flat.clear(), weight.clear()

        for text in texts_of(batch):
            here = places(text, known)
            for shift in range(1, WINDOW + 1):
                for a, b in ((here[:-shift], here[shift:]), (here[shift:], here[:-shift])):
                    if len(a):
                        flat.append((a[:, None] * WIDTH + dims[b]).ravel())
                        weight.append(signs[b].ravel())
            if sum(map(len, flat[-4:])) * 4 > 100_000 or len(flat) > 400:
                add()
        add()
    table = sums.astype(np.int64).reshape(SLOTS, WIDTH)
    used = np.flatnonzero(table.any(axis=1))
    yield pa.record_batch([pa.array(used, pa.int32()), *(pa.array(table[used, i]) for i in range(WIDTH))],
                          names=["slot", *(f"v{i}" for i in range(WIDTH))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """SLOTS x WIDTH, of unit length. Each task sums its own texts; Spark adds the sums."""
    sums = (docs.select("text").mapInArrow(_contexts, SUMS).groupBy("slot")
            .agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(WIDTH))).toArrow())
    table = np.zeros((SLOTS, WIDTH))
    for i in range(WIDTH):
        table[sums.column("slot").to_numpy(), i] = sums.column(f"v{i}").to_numpy()
    table -= table.sum(axis=0) / max(1.0, np.abs(table).sum()) * np.abs(table).sum(axis=1, keepdims=True)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled_vector(text: str | None, known: Words, table: np.ndarray) -> np.ndarray:
    """Mean and spread of a text's word vectors."""
    found, times = np.unique(places(text or "", known), return_counts=True)
    if not len(found):
        return np.zeros(2 * WIDTH, "<f4")
    own, share = table[found], (times / times.sum()).astype(np.float32)
    mean = share @ own
    spread = np.sqrt(np.maximum(share @ (own * own) - mean * mean, 0))
    return np.concatenate([mean, spread]).astype("<f4")


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """Per document: its pooled vector, as 32-bit floats."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # SLOTS x WIDTH numbers

    def run(batches):
        known = Words()
        for batch in slices(batches):
            rows = [pooled_vector(t, known, shared.value).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "pooled"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, pooled binary")


def logits(x: np.ndarray, net: dict) -> np.ndarray:
    hidden = np.maximum((x - net["mean"]) / net["scale"] @ net["w1"] + net["b1"], 0)
    return hidden @ net["w2"] + net["b2"]


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, seed: int = 5) -> dict:
    """Two layers by Adam on log-loss; then the temperature, on a fifth left aside."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    aside, use = order[:len(x) // 5], order[len(x) // 5:]
    net = {"mean": x[use].mean(axis=0), "scale": x[use].std(axis=0) + 1e-4,
           "w1": rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), "b1": np.zeros(hidden),
           "w2": rng.normal(0, hidden ** -0.5, hidden), "b2": 0.0, "temperature": 1.0}
    names = ("w1", "b1", "w2", "b2")
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    z = (x - net["mean"]) / net["scale"]
    for _ in range(epochs):
        rng.shuffle(use)
        for at in range(0, len(use), 128):
            rows = use[at:at + 128]
            inner = z[rows] @ net["w1"] + net["b1"]
            active = np.maximum(inner, 0)
            error = (1 / (1 + np.exp(-np.clip(active @ net["w2"] + net["b2"], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, net["w2"]) * (inner > 0)
            slopes = {"w1": z[rows].T @ back + 1e-4 * net["w1"], "b1": back.sum(axis=0),
                      "w2": active.T @ error + 1e-4 * net["w2"], "b2": error.sum()}
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * slopes[k]
                second[k] = 0.999 * second[k] + 0.001 * slopes[k] ** 2
                net[k] = net[k] - 2e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    if len(aside):
        raw, sign = logits(x[aside], net), np.where(y[aside] > 0.5, 1, -1)
        trials = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        net["temperature"] = float(min(trials, key=lambda t: np.logaddexp(0, -sign * raw / t).mean()))
    return net


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pool=None) -> dict | None:
    """The network from at most `sample` labelled documents, the smallest by a hash of their id; None
    if there is no label. `pool` makes (doc_id, pooled) of those documents that come into question; None
    if they hold their vectors. The number of labelled rows tells below which hash to look, so hardly
    more than `sample` rows are pooled, joined and sorted; where they are too few, the bound is doubled."""
    taught = (labels.where(F.col("quality").isNotNull())
              .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")))
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    known, place = docs.select("doc_id").join(dealt(taught), "doc_id").count(), F.xxhash64("doc_id", F.lit(7))
    share = 1.25 * sample / max(1, known)
    while True:
        near, named = ((docs, taught) if share >= 1 else
                       (rows.where(place <= F.lit(int(share * 2**64) - 2**63)) for rows in (docs, taught)))
        rows = ((near if pool is None else pool(near)).join(dealt(named), "doc_id").orderBy(place, "doc_id", "pooled", "quality")
                .limit(sample).select("pooled", "quality").toArrow())
        if rows.num_rows >= min(sample, known) or share >= 1:
            break
        share *= 2
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows.column("pooled").to_pylist()), "<f4").reshape(rows.num_rows, -1).astype(float)
    return fit(x, (rows.column("quality").to_numpy() > 0.5).astype(float))


def probability(x: np.ndarray, net: dict | None) -> np.ndarray:
    if net is None:
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip(logits(x, net) / net["temperature"], -40, 40)))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, whether it is held out, its probability of good quality, and the
    decision. Labels count only for documents whose id's checksum isn't divisible by `modulus`."""
    vectors = saved(pooled(docs, word_vectors(docs)), "pooled")
    net = learn(vectors.where(fold(modulus) != 0), labels, sample)

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("pooled").to_pylist()), "<f4").reshape(batch.num_rows, -1)
            p = probability(x, net)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()),
                                   pa.array((p >= THRESHOLD).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    held_out = (fold(modulus) == 0).alias("held_out")
    return vectors.select("doc_id", held_out, "pooled").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def scorer(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A column function from text to the probability of good quality, learned from all labels."""
    vectors = word_vectors(docs)
    net = learn(docs.select("doc_id", "text"), labels, sample, lambda chosen: pooled(chosen, vectors))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(text: pd.Series) -> pd.Series:
        known = Words()
        x = np.stack([pooled_vector(t, known, shared.value) for t in text]) if len(text) else np.zeros((0, 2 * WIDTH))
        return pd.Series(probability(x, net))

    return F.pandas_udf(run, "double")
