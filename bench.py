"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]. Prints one JSON line.

The given tables have one row group each, which no split divides: a scan would be one task, whatever the
cores. So each table is first written anew, untimed, in row groups of about ROW_GROUP bytes.
"""

import glob
import json
import os
import sys
import tempfile
import time

ROW_GROUP = 2**20

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "retention_funnel", "retention_definitions", "dedup_first", "cleaning_funnel", "stratified_split",
    "handcrafted_features", "vocabulary", "tfidf_weights", "linear_score", "defang_roundtrip",
    "html_text", "degradation_curve", "url_ablation", "mitigation_grid", "bootstrap_ci",
    "significance_table", "mime_ingest", "corpus_build", "release_rewrites",
)


def relaid(sf: str) -> str:
    """A copy of the tables in small row groups."""
    import pyarrow.parquet as pq

    folder = tempfile.mkdtemp(prefix="bench-tables-")
    for path in glob.glob(f"{sf}/*.parquet"):
        table = pq.read_table(path)
        rows = max(1, int(table.num_rows * ROW_GROUP / max(1, table.nbytes)))
        pq.write_table(table, f"{folder}/{os.path.basename(path)}", row_group_size=rows)
    return folder


def main() -> None:
    from pyspark.sql import SparkSession

    from checks.registry import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names, given = sys.argv[1:] or HEADLINE, sf
    sf = relaid(sf)
    QUERIES["stable_ids"][0](spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(given.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
