"""Inputs derived from the given tables, built with Spark. `checks.views` states the same
views in SQL for the oracle."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.functions import hashing as H
from steadfast.functions import text as X

MODELS = ("logreg", "random_forest", "gradient_boosting")
CONDITIONS = ("original", "url_masked")
TRAININGS = ("baseline", "adv_trained")
GENERATORS = ("g1", "g2")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lit_array(values) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def h(*parts):
    return H.hash32(L.SEED, *[p if not isinstance(p, str) else F.lit(p) for p in parts])


def source_number():
    return F.substring("source", 4, 10).cast("int")


def doc_original_id():
    era = F.when(source_number() < 10, ".mbox").otherwise("")
    return F.concat(F.lit("doc:"), F.col("source"), era, F.lit(":"), F.col("doc_id").cast("string"))


def docs(spark, sf) -> DataFrame:
    """Every document as a message: subject = first line, body = the rest."""
    cut = F.instr("text", "\n")
    return table(spark, sf, "documents").select(
        "doc_id", "source", source_number().alias("source_rank"), doc_original_id().alias("original_id"),
        F.substring_index("text", "\n", 1).alias("subject"),
        F.when(cut > 0, F.substr("text", cut + 1)).otherwise("").alias("body"),
        (F.col("doc_id") % 2 == 0).alias("had_html"),
    )


def _link(position: int, page: str):
    kind = h("u", F.col("doc_id"), F.lit(position)) % 8
    url, n = F.col(f"_url{position}"), F.col(page).cast("string")
    return F.when(url.isNotNull(), (
        F.when(kind == 1, F.concat(F.lit("http://10.9.2.3/login?x="), n))
        .when(kind == 2, F.concat(url, F.lit("/unsubscribe")))
        .when(kind == 3, F.concat(F.lit("https://www.paypal.com/p"), n))
        .when(kind == 4, F.concat(F.lit("http://facebook.com/u"), n))
        .when(kind == 5, F.upper(url))
        .when(kind == 6, F.concat(url, F.lit("),")))
        .when(kind == 7, F.concat(F.lit("www.site"), n, F.lit(".com/verify")))
        .otherwise(url)
    ))


def emails(spark, sf, positives: bool = False) -> DataFrame:
    """Every document with up to two URLs appended; one without a label counts as negative.
    Only the positives, if these alone are asked for."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    n_pages = pages.count()
    doc = F.col("doc_id")
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    marked = (labels.where(F.col("toxic") == 1), "inner") if positives else (labels, "left")
    documents = table(spark, sf, "documents")
    keyed = documents.join(marked[0], "doc_id", marked[1])
    # Pages are looked up for numbers alone: texts are dealt out once, by their id, and documents without
    # a page (most, for the second one) don't meet in one task.
    ids = documents.select("doc_id").distinct()
    for i, page in enumerate((F.when(doc % 5 < 4, doc % n_pages), F.when(doc % 3 == 0, (doc + 7) % n_pages))):
        side = pages.select(F.col("page_id").alias(f"_p{i}"), F.col("url").alias(f"_url{i}"))
        found = ids.withColumn(f"_p{i}", page).where(F.col(f"_p{i}").isNotNull()).join(side, f"_p{i}")
        keyed = keyed.join(found, "doc_id", "left")
    linked = keyed.withColumns({"url0": _link(0, "_p0"), "url1": _link(1, "_p1")})
    return linked.select(
        "doc_id", "source", F.coalesce("toxic", F.lit(0)).alias("label"), doc_original_id().alias("original_id"),
        F.col("text").alias("doc_text"), "url0", "url1",
        F.concat_ws(" ", "text", "url0", "url1").alias("text"), (doc % 2 == 0).alias("had_html"),
    )


def rewrite_log(spark, sf) -> DataFrame:
    """Append log of rewrites of the positives: some pairs are written twice."""
    base = emails(spark, sf, positives=True)
    grid = (
        base.withColumn("severity", F.explode(lit_array(L.REWRITE_SEVERITIES)))
        .withColumn("generator", F.explode(lit_array(GENERATORS)))
        .withColumn("sev", F.format_string("%.2f", F.col("severity")))
    )
    again = h("w", F.col("doc_id"), F.col("sev"), F.col("generator")) % 3 == 0
    grid = grid.withColumn("pos", F.explode(F.when(again, lit_array((1, 2))).otherwise(lit_array((1,)))))
    key = [F.col(c) for c in ("doc_id", "sev", "generator", "pos")]

    def kept(i):
        draw = h(*key, F.lit(i)) % 10
        url = F.col(f"url{i}")
        return F.when(draw < 1 + 2 * F.col("severity"), F.lit(None).cast("string")).when(
            draw == 9, F.concat(url, F.lit("/x"))
        ).otherwise(url)

    tokens = F.split("doc_text", " ")
    n = F.ceil(F.size(tokens) * (1 - F.col("severity") / 2)).cast("int")
    refusal = F.when(h("r", *key) % 20 == 0, "I am unable to do that.")
    body = F.concat_ws(" ", refusal, F.array_join(F.slice(tokens, 1, n), " "), kept(0), kept(1))
    return grid.select(
        "doc_id", "original_id", "source", "generator", "severity", "sev", "pos",
        F.concat(F.lit("Subject: re "), F.col("doc_id").cast("string"), F.lit("\n"), body).alias("raw"),
        F.lit(False).alias("had_html"), F.col("text").alias("original_text"),
    )


def rewrites(spark, sf) -> DataFrame:
    """Last record per pair with parsed text and both verdicts."""
    from steadfast.operators.rewrites import latest_rewrites, with_verdicts

    last = latest_rewrites(
        rewrite_log(spark, sf), ["original_id", "severity", "generator"], ["pos"]
    )
    return with_verdicts(last.withColumn("rewrite_text", X.parse_rewrite(F.col("raw"))["text"]))


def _combos(df):
    for name, values in (("model", MODELS), ("condition", CONDITIONS), ("training", TRAININGS)):
        df = df.withColumn(name, F.explode(lit_array(values)))
    return df


def negatives(spark, sf) -> DataFrame:
    """Scores of the fixed negatives, one per detector."""
    base = _labels_with_id(spark, sf).where(F.col("label") == 0)
    u = h("n", *[F.col(c) for c in ("model", "condition", "training", "row_id")]) / F.lit(4294967296.0)
    return _combos(base.select("row_id", "label")).withColumn("score", F.floor(u * 0.6 * 10000) / 10000.0)


def positives(spark, sf) -> DataFrame:
    """Scores of the positives per detector, generator and severity."""
    base = _labels_with_id(spark, sf).where(F.col("label") == 1)
    grid = (
        _combos(base.select("row_id", "label"))
        .withColumn("generator", F.explode(lit_array(GENERATORS)))
        .withColumn("severity", F.explode(lit_array(L.SEVERITIES)))
    )
    sev, gen = F.col("severity"), F.when(F.col("severity") > 0, F.col("generator")).otherwise("na")
    u = h(
        "p", *[F.col(c) for c in ("model", "condition", "training")], gen,
        F.format_string("%.2f", sev), F.col("row_id"),
    ) / F.lit(4294967296.0)
    slope = F.when(F.col("condition") == "url_masked", 0.5).otherwise(0.3) * F.when(
        F.col("training") == "adv_trained", 0.25
    ).otherwise(1.0)
    return grid.withColumn("score", F.floor((0.35 + 0.65 * u - sev * slope) * 10000) / 10000.0)


def _labels_with_id(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source").join(
        table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id"
    ).select(doc_original_id().alias("row_id"), F.col("toxic").alias("label"), "doc_id", "source")
