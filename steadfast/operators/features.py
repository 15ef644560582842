"""TF-IDF and handcrafted features in relational form."""

import json
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadfast import lexicons as L
from steadfast.functions import terms as G
from steadfast.functions import text as X
from steadfast.operators.support import pinned

VECTOR_ROW = T.StructType([T.StructField("v", VectorUDT())])


def tokenised(df: DataFrame, text_col: str = "text", name: str = "tokens") -> DataFrame:
    """Adds the unigrams of a text. Texts that need more than a character-by-character folding are the
    only ones that are folded in Python."""
    low = F.lower(X.or_empty(F.col(text_col)))
    def made(rows, fold):
        return rows.withColumn(name, X.tokens(fold(low)))

    simple = X.folds_in_place(low)
    return made(df.where(simple), X.fold_in_place).unionByName(made(df.where(~simple), X.fold_any))


def grams(df: DataFrame, text_col: str = "text", name: str = "grams") -> DataFrame:
    """Adds the unigrams and bigrams of a text."""
    return tokenised(df, text_col, name).withColumn(name, X.with_bigrams(F.col(name)))


def term_counts(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, term, tf). Grams are counted as numbers, some texts at a time, within the task that reads them."""
    kind = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return tokenised(df.select(id_col, text_col), text_col, "_tokens").select(id_col, "_tokens").mapInArrow(G.by_text, kind)


def term_occurrences(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, tf) of some texts at a time, not told apart: where a sum is all that is wanted, documents needn't be
    counted first."""
    return tokenised(df.select(text_col), text_col, "_tokens").select("_tokens").mapInArrow(G.by_part, "term string, tf long")


def term_statistics(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(
        F.count("*").alias("doc_freq"), F.sum("tf").alias("corpus_count")
    )


#: Buckets of the sketch. A task sends at most so many counts, whatever its texts hold.
SKETCH_WIDTH = 2**20


def frequent_terms(
    counts: DataFrame, max_terms: int, min_doc_freq: int, width: int = SKETCH_WIDTH, occurrences: DataFrame | None = None,
) -> DataFrame:
    """Statistics of all terms that occur at least some number of times, a number low enough for
    max_terms of them to be in at least min_doc_freq documents (or all terms, if there are fewer).

    Counts per hash bucket are a sketch that bounds every term from above. Only terms of buckets
    that reach the threshold are counted exactly; a term elsewhere can't reach it. If too few
    do, the threshold was too high and is lowered. So the long tail of rare terms is never
    shuffled, and the result is exact."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(width)).alias("bucket")
    bucketed = counts.select("term", "tf", bucket)
    sketch = pinned((counts if occurrences is None else occurrences).groupBy(bucket).agg(F.sum("tf").alias("n")))
    filled = sketch.count()
    share = max(0.0, 1.0 - 2.0 * max_terms / max(1, filled))
    least = sketch.agg(F.percentile_approx("n", share, 100_000)).first()[0] if share else 1
    while True:
        # written, so that its own few bytes count and not the sketch's: where it is small it is broadcast
        heavy = pinned(sketch.where(F.col("n") >= least).select("bucket"))
        stats = pinned(term_statistics(bucketed.join(heavy, "bucket") if least > 1 else bucketed).where(
            (F.col("doc_freq") >= min_doc_freq) & (F.col("corpus_count") >= least)))
        if least <= 1 or stats.count() >= max_terms:
            return stats
        least = max(1, least // 4)


def most_frequent(stats: DataFrame, max_terms: int) -> DataFrame:
    """The max_terms most frequent terms, ties by term. Counts settle all but the terms of the last
    count; these are dealt to ranges in term order, and one range is cut."""
    sizes = stats.groupBy("corpus_count").count().orderBy(F.desc("corpus_count")).limit(max_terms).collect()
    room = max_terms
    for last, n in sizes:
        if n >= room:
            break
        room -= n
    else:
        return stats
    sure, tied = stats.where(F.col("corpus_count") > last), stats.where(F.col("corpus_count") == last)
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = pinned(tied.repartitionByRange(parts, "term").withColumn("_part", F.spark_partition_id()))
    for part, n in tied.groupBy("_part").count().orderBy("_part").collect():
        if n >= room:
            break
        room -= n
    whole = tied.where(F.col("_part") < part)
    cut = tied.where(F.col("_part") == part).orderBy("term").limit(room)
    return sure.unionByName(whole.unionByName(cut).drop("_part"))


def vocabulary(
    counts: DataFrame, max_terms: int = L.MAX_TERMS, min_doc_freq: int = L.MIN_DOC_FREQ, width: int = SKETCH_WIDTH,
    occurrences: DataFrame | None = None,
) -> DataFrame:
    """Most frequent terms, ties by term, numbered in term order. At most max_terms rows. `occurrences` may
    give the same totals in a cheaper form."""
    top = most_frequent(frequent_terms(counts, max_terms, min_doc_freq, width, occurrences), max_terms)
    by_term = Window.orderBy("term")
    return top.withColumn("term_id", F.row_number().over(by_term) - 1)


def with_idf(vocab: DataFrame, n_docs: int | Column) -> DataFrame:
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return vocab.withColumn("idf", F.log((n + 1.0) / (F.col("doc_freq") + 1.0)) + 1.0)


def constants(values: Sequence[float]) -> Column:
    """One constant array of doubles, indexed without a search. Its length is bounded by the vocabulary."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def tfidf_rows(df: DataFrame, vocab: DataFrame, text_col: str = "text", name: str = "terms") -> DataFrame:
    """Adds terms: array<struct<term_id, weight>>, L2-normalised, in term_id order; empty where no term
    is known. A document is counted and weighed in its own row against the vocabulary, which is
    bounded by construction and sent to every executor: nothing is shuffled."""
    known = vocab.select("term", "idf").orderBy("term_id").collect()
    kind = "array<struct<term_id:int,weight:double>>"
    if not known:
        return df.withColumn(name, F.array().cast(kind))
    weights = G.weigher([r["term"] for r in known], [r["idf"] for r in known])

    @F.arrow_udf(kind)
    def weighed(tokens: pa.Array) -> pa.Array:
        return weights(tokens)

    # said not to be deterministic, so that a filter on the result isn't pushed below it, where texts would be weighed again
    return tokenised(df, text_col, "_tokens").withColumn(name, weighed.asNondeterministic()(F.col("_tokens"))).drop("_tokens")


def tfidf_long(df: DataFrame, vocab: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    return (
        tfidf_rows(df.select(id_col, text_col), vocab, text_col, "_terms")
        .select(id_col, F.explode("_terms").alias("_e")).select(id_col, "_e.term_id", "_e.weight")
    )


def handcrafted_features(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    return df.select(id_col, *X.handcrafted(F.col(text_col), F.col("had_html")))


def scale_factors(features: DataFrame) -> DataFrame:
    """One row: population deviation per column, 1 where a column is constant."""
    def factor(name):
        spread = F.stddev_pop(name)
        return F.when(spread > 0, spread).otherwise(1.0).alias(name)

    return features.agg(*[factor(c) for c in L.HANDCRAFTED])


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (classes * n_class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_class"))
    everything = Window.partitionBy(F.lit(0))  # one row per class
    return counts.select(
        label, "n_class",
        (F.sum("n_class").over(everything) / (F.count("*").over(everything) * F.col("n_class"))).alias("weight"),
    )


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    weights = pinned(class_weights(df, label).select(label, "weight"))
    return df.join(weights, label)


def linear_score(
    df: DataFrame, vocab: DataFrame, coefficients: DataFrame, id_col: str, intercept: float = 0.0, text_col: str = "text",
) -> DataFrame:
    """Sigmoid of a sparse dot product, inside the row; `coefficients` (term_id, coefficient) holds a row per
    vocabulary term. Texts without any known term have no score."""
    known = {r["term_id"]: r["coefficient"] for r in coefficients.select("term_id", "coefficient").collect()}
    by_id = constants([known.get(i, 0.0) for i in range(max(known, default=-1) + 1)])
    weighed = tfidf_rows(df.select(id_col, text_col), vocab, text_col, "_terms").where(F.size("_terms") > 0)
    z = F.aggregate("_terms", F.lit(0.0), lambda acc, t: acc + t["weight"] * F.coalesce(F.get(by_id, t["term_id"]), F.lit(0.0)))
    return weighed.select(id_col, (1.0 / (1.0 + F.exp(-(z + intercept)))).alias("score"))


def sparse_vector(indices: Column, values: Column, size: int) -> Column:
    """A sparse ML vector from two arrays, built by the JSON reader: no Python per row."""
    body = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
        indices.alias("indices"), values.alias("values"),
    )
    return F.from_json(F.to_json(F.struct(body.alias("v"))), VECTOR_ROW)["v"]


def entries(vector: Column) -> Column:
    """array<struct<index, value>> of an ML vector, read off in the JVM; of a dense one, all places."""
    read = F.from_json(F.to_json(F.struct(vector.alias("v"))), "v struct<indices:array<int>,values:array<double>>")["v"]

    def pairs(v):
        places = F.coalesce(v["indices"], F.when(F.size(v["values"]) > 0, F.sequence(F.lit(0), F.size(v["values"]) - 1)), F.array().cast("array<int>"))
        return F.zip_with(places, v["values"], lambda i, x: F.struct(i.alias("index"), x.alias("value")))

    return X.let(read, pairs)


@dataclass
class Featurizer:
    """Vocabulary and scale factors learnt on training rows only."""

    vocab: DataFrame
    n_terms: int
    scales: dict[str, float]
    masked: bool

    @property
    def width(self) -> int:
        return self.n_terms + len(L.HANDCRAFTED)

    def _text(self) -> Column:
        return X.mask_urls(F.col("text")) if self.masked else X.or_empty(F.col("text"))

    def added(self, df: DataFrame, name: str = "features") -> DataFrame:
        """df with its feature vector: terms, then the eight scaled numbers. Rows without any known term
        keep these."""
        source = df.withColumn("_text", self._text())
        hand = {"_" + c.lower(): v for c, v in zip(L.HANDCRAFTED, X.handcrafted(F.col("_text"), F.col("had_html")))}
        joined = tfidf_rows(source, self.vocab, "_text", "_terms").withColumns(hand)
        tail = F.array(*[F.col(n) / F.lit(self.scales[c]) for n, c in zip(hand, L.HANDCRAFTED)])
        indices = F.concat(
            F.transform("_terms", lambda t: t["term_id"]),
            F.array(*[F.lit(self.n_terms + i) for i in range(len(L.HANDCRAFTED))]),
        )
        values = F.concat(F.transform("_terms", lambda t: t["weight"]), tail)
        return joined.withColumn(name, sparse_vector(indices, values, self.width)).drop("_text", "_terms", *hand)

    def transform(self, df: DataFrame, id_col: str = "row_id", keep: Sequence[str] = ()) -> DataFrame:
        """(id, keep..., features)."""
        return self.added(df.select(id_col, *keep, "text", "had_html")).select(id_col, *keep, "features")


def fit_featurizer(
    train: DataFrame, id_col: str = "row_id", masked: bool = False, max_terms: int = L.MAX_TERMS,
    min_doc_freq: int = L.MIN_DOC_FREQ,
) -> Featurizer:
    text = X.mask_urls(F.col("text")) if masked else X.or_empty(F.col("text"))
    source = pinned(train.select(id_col, text.alias("text"), "had_html"))
    n_docs = source.count()
    vocab = pinned(
        with_idf(vocabulary(term_counts(source, id_col), max_terms, min_doc_freq, occurrences=term_occurrences(source)), n_docs)
    )
    scales = scale_factors(handcrafted_features(source, id_col)).first().asDict()
    return Featurizer(vocab, vocab.count(), scales, masked)
