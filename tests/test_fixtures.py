"""Inputs of the queries: their rows, and how these are dealt out."""

from pyspark.sql import functions as F

from checks import fixtures as fx

HELD = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40"}


def tables(spark, folder, n=600):
    ids = [*range(n), 3, 3, None, None]
    docs = [(i, f"src{(i or 0) % 20}", None if i == 5 else f"text {i}") for i in ids]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    pages = [(i, f"http://h{i}.com/a") for i in (*range(50), 7, None)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    labels = [(i, (i or 0) % 2) for i in (*range(0, n, 3), 9, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def expected(spark, sf):
    """The page numbers of each document looked up one by one."""
    docs, labels = (fx.table(spark, sf, t).collect() for t in ("documents", "labels"))
    pages = fx.table(spark, sf, "pages").collect()

    def found(number):
        return [p["url"] for p in pages if p["page_id"] == number and number is not None] or [None]

    rows = []
    for d in docs:
        i = d["doc_id"]
        p0 = i % len(pages) if i is not None and i % 5 < 4 else None
        p1 = (i + 7) % len(pages) if i is not None and i % 3 == 0 else None
        toxic = [r["toxic"] for r in labels if r["doc_id"] == i and i is not None] or [0]
        rows += [(i, t, u is not None, v is not None) for t in toxic for u in found(p0) for v in found(p1)]
    return sorted(rows, key=str)


def test_mail_with_repeated_and_missing_keys(spark, tmp_path):
    sf = tables(spark, tmp_path)
    got = fx.emails(spark, sf).select("doc_id", "label", F.col("url0").isNotNull(), F.col("url1").isNotNull())
    assert sorted(map(tuple, got.collect()), key=str) == expected(spark, sf)
    marked = fx.emails(spark, sf, positives=True).select("doc_id", "label", F.col("url0").isNotNull(), F.col("url1").isNotNull())
    want = [r for r in expected(spark, sf) if r[1] == 1]
    assert sorted(map(tuple, marked.collect()), key=str) == want


def test_documents_without_a_page_are_dealt_out(spark, tmp_path):
    """Two thirds of the documents have no second page: they may not share a task."""
    sf = tables(spark, tmp_path)
    kept = {k: spark.conf.get(k) for k in HELD}
    try:
        for k, v in HELD.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in fx.emails(spark, sf).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert max(sizes) < sum(sizes) / 8
