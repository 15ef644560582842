"""The last write of each key, kept by a stream."""

import random
from datetime import datetime, timedelta, timezone

from steadfast.schemas import REWRITE
from steadfast.sources import tables
from steadfast.streaming import latest


def record(key, severity, second, text):
    row = dict.fromkeys(REWRITE.names)
    ts = None if second is None else datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)
    return {**row, "original_id": key, "severity": severity, "rewrite_text": text, "ts": ts}


def test_late_and_replayed_records(spark, tmp_path):
    rng = random.Random(1)
    rows = [record(rng.choice(["a", "b", "c"]), rng.choice([0.0, 0.25, 1.0]), rng.choice([None, 0, 1, 2, 3, 10_000]), f"t{i}") for i in range(60)]
    rows += [record("hot", 0.5, i % 7, f"h{i:03}") for i in range(300)] + [record("one", 1.0, None, "only")]
    want = {}
    for r in rows:  # later, or at the same time greater
        known = want.get((r["original_id"], r["severity"]))
        place = lambda x: (x["ts"] is not None, x["ts"], x["rewrite_text"])
        if known is None or place(r) > place(known):
            want[r["original_id"], r["severity"]] = r
    rng.shuffle(rows)
    log, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    for start in range(0, len(rows), 120):
        part = spark.createDataFrame(rows[start:start + 120], REWRITE).repartition(3)
        tables.append_rewrites(part, log)
        latest.follow(spark, log, out, check, files_a_batch=2).awaitTermination()
    seen = {(r["original_id"], r["severity"]): r["rewrite_text"] for r in latest.read_latest(spark, out).collect()}
    assert seen == {k: r["rewrite_text"] for k, r in want.items()}
    n = spark.read.parquet(out).count()
    tables.append_rewrites(spark.createDataFrame(rows, REWRITE), log)  # all of it again
    latest.follow(spark, log, out, check).awaitTermination()
    assert spark.read.parquet(out).count() == n
    assert latest.read_latest(spark, out).count() == len(want)
