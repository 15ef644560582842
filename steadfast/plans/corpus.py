"""Corpus build: raw messages to the labelled, deduplicated, split table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.functions import text as X
from steadfast.operators import cleaning as C
from steadfast.operators.sampling import stratified_split
from steadfast.operators.support import pinned
from steadfast.schemas import EMAIL_COLUMNS


def build_corpus(
    parsed: DataFrame, test_fraction: float = L.TEST_FRACTION, seed=L.SEED,
) -> DataFrame:
    """From parsed messages carrying source, source_rank and label. Sources are ranked: of
    exact copies the lowest (rank, id) stays, whatever its label.

    Copies, split and counts are settled on narrow rows, written once; the texts are then
    read a second time and shuffled a single time, on their own unique ids.
    """
    order = ["source_rank", "original_id"]
    rows = C.with_dedup_key(C.drop_low_content(C.unify(parsed)))
    first = pinned(
        C.first_copies(rows.select("dedup_key", *order, "label"), "dedup_key", order, ["label"])
        .select(*order, "label")
    )
    split = stratified_split(first, "original_id", "label", test_fraction, seed)
    return (
        rows.drop("split").join(split.select(*order, "split"), order)
        .withColumn("id", stable_id()).select(*EMAIL_COLUMNS)
    )


def stable_id():
    """Row id from content identity, so it survives re-reading in another order."""
    return F.concat(F.col("source"), F.lit("-"), F.sha1("original_id"))


def build_external(
    raw: DataFrame, corpus: str, year: int, test_fraction: float = L.TEST_FRACTION, seed=L.SEED,
) -> DataFrame:
    """Same-year rows of a subject / body / date / label table. `raw` needs a unique
    original_id."""
    same = C.same_year(raw, "date", year)
    text = X.unified_text(F.col("subject"), F.col("body"))
    rows = same.select(
        F.concat(F.lit(f"{corpus}_"), F.sha1("original_id")).alias("id"),
        "original_id", F.lit(corpus).alias("source"), text.alias("text"),
        X.has_listed_tag(F.col("body")).alias("had_html"), F.col("label").cast("int").alias("label"),
    )
    return stratified_split(C.non_empty(rows), "original_id", "label", test_fraction, seed)
