"""Language identification as inference of a mixture.

Each learned language is a distribution over hashed letter trigrams, counted over all training
texts. A text's language proportions are those that maximise the likelihood of its trigrams under
the mixture, found by expectation-maximisation; languages are then taken in order of their share
for as long as each raises the likelihood by more than a penalty that grows with the log of the
text's length. The text's language is the largest share within that set.

Texts that are null or have no letter are `und` with score 0, as is every text when nothing was
learned. Rows with a null language or text teach nothing. Ties go to the first language by name.
Repeated rows give a row each. Only doc_id, text and, for learning, lang are read.
"""

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.llm.common import fold

SLOTS = 1 << 15
SMOOTHING = 0.05
STEPS = 12
PENALTY = 4.0
NONE = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Slots of the letter trigrams of a text; word ends are blanks."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.concatenate([[32], np.where(_letters()[points], points, 32), [32]]).astype(np.uint64)
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    h = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(49)).astype(np.int64)


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if lang not in counts:
                counts[lang] = np.zeros(SLOTS, np.int64)
            if len(text):
                counts[lang] += np.bincount(grams(text), minlength=SLOTS)
    for lang, n in counts.items():
        slots = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()),
                               pa.array(n[slots], pa.int64())], names=["lang", "slot", "n"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of each slot in each: at most SLOTS numbers a language,
    however large the corpus. Each task sums its own texts before anything is shuffled."""
    rows = (docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
            .mapInArrow(_count, "lang string, slot int, n long")
            .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(rows.column("lang").to_pylist()))
    place = {lang: i for i, lang in enumerate(langs)}
    table = np.full((SLOTS, len(langs)), SMOOTHING)
    columns = [place[x] for x in rows.column("lang").to_pylist()]
    table[rows.column("slot").to_numpy(), columns] += rows.column("n").to_numpy()
    return langs, table / table.sum(axis=0)


def proportions(likely: np.ndarray, times: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Mixture weights of the columns by expectation-maximisation, and the log-likelihood."""
    share = np.full(likely.shape[1], 1 / likely.shape[1])
    total = times.sum()
    for _ in range(steps):
        each = likely @ share
        share = share * ((times / each) @ likely) / total
    return share, float(times @ np.log(likely @ share))


def mixture(slots: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Proportions of all languages, and the chosen set in order of share."""
    found, times = np.unique(slots, return_counts=True)
    likely, times = table[found], times.astype(float)
    share, _ = proportions(likely, times)
    order = np.argsort(-share, kind="stable")
    chosen, best = [int(order[0])], float(times @ np.log(likely[:, order[0]]))
    weights = np.array([1.0])
    for k in order[1:]:
        trial, value = proportions(likely[:, [*chosen, k]], times)
        if value - best <= PENALTY * np.log(times.sum() + 1):
            break
        chosen, best, weights = [*chosen, int(k)], value, trial
    return share, [chosen[i] for i in np.argsort(-weights, kind="stable")]


def _predicted(text: str | None, langs: list[str], table: np.ndarray) -> tuple[str, float, str]:
    slots = grams(text) if text else np.zeros(0, np.int64)
    if not langs or not len(slots):
        return NONE, 0.0, ""
    share, chosen = mixture(slots, table)
    return langs[chosen[0]], min(1.0, float(share[chosen[0]])), ",".join(langs[i] for i in chosen)


def predicted(spark, model: tuple[list[str], np.ndarray]):
    """A column function from text to struct (lang_pred, score, languages)."""
    langs, table = model
    shared = spark.sparkContext.broadcast(table)  # SLOTS numbers a language

    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_predicted(t, langs, shared.value) for t in text], columns=["lang_pred", "score", "languages"])

    return F.pandas_udf(run, "lang_pred string, score double, languages string")


def identify(docs: DataFrame, modulus: int = 4, out: int = 2) -> DataFrame:
    """Per document: its language, that language's share and the set that was selected. Learns
    from the documents outside the held-out fold, predicts all."""
    held_out = fold(modulus) == out
    found = predicted(docs.sparkSession, learn(docs.where(~held_out)))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), found("text").alias("found"))
            .select("doc_id", "held_out", "found.*"))
