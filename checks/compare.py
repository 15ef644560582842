"""Run queries on Spark and their oracle on DuckDB and compare the rows.

    python -m checks.compare [--sf /root/testdata/sf0.01] [name ...]
"""

import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def canonical(frame):
    """Column-sorted, row-sorted list of tuples with uniform scalar types."""
    import math

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return round(float(v), 6)
        if type(v).__name__ == "Decimal":
            return round(float(v), 6)
        return str(v)

    cols = sorted(frame.column_names)
    data = [frame.column(c).to_pylist() for c in cols]
    rows = [tuple(cell(v) for v in row) for row in zip(*data)] if cols else []
    return cols, sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def compare(spark, con, sf: str, name: str) -> tuple[bool, str]:
    from checks.registry import QUERIES

    fn, sql = QUERIES[name]
    start = time.time()
    result = fn(spark, sf).toArrow()
    took = time.time() - start
    if sql is None:
        return True, f"rows-only {result.num_rows} ({took:.1f}s)"
    start = time.time()
    want = con.execute(sql).to_arrow_table()
    sql_took = time.time() - start
    (c1, r1), (c2, r2) = canonical(result), canonical(want)
    if c1 != c2:
        return False, f"columns {c1} != {c2}"
    types = {
        c: (str(result.schema.field(c).type), str(want.schema.field(c).type))
        for c in c1 if str(result.schema.field(c).type).replace("large_", "") != str(want.schema.field(c).type).replace("large_", "")
    }
    note = f" types {types}" if types else ""
    if len(r1) != len(r2):
        return False, f"rows {len(r1)} != {len(r2)}{note}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        return False, f"{len(bad)}/{len(r1)} rows differ, e.g.\n   {str(bad[0][0])[:600]}\n   {str(bad[0][1])[:600]}{note}"
    return True, f"{len(r1)} rows (spark {took:.1f}s, sql {sql_took:.1f}s){note}"


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    from checks.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf), []
    for name in argv or QUERIES:
        try:
            ok, note = compare(spark, con, sf, name)
        except Exception as error:  # report and go on to the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
        failed += [] if ok else [name]
    print(f"{len(failed)} failed: {' '.join(failed)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
