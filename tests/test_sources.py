"""Readers, writers and the incremental log, on small files."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from steadfast.operators import rewrites as R
from steadfast.sources import archives, mail, tables
from steadfast.streaming.retention import stream_verdicts

MULTI = b"""Subject: Multi  part
MIME-Version: 1.0
Content-Type: multipart/alternative; boundary=b

--b
Content-Type: text/plain; charset=utf-8

plain words here
--b
Content-Type: text/html

<p>html words</p>
--b--
"""
HTML = b"""Subject: H
Content-Type: text/html

<html><script>var x</script><style>p{}</style><body><p>Hi&amp;bye</p><a href=" http://evil.com/x ">click</a>
<a href="mailto:a@b.c">mail</a><form action="http://post.example/f">go</form><map><area href="http://area.example/"></map></body></html>
"""
MESSAGES = {
    "multi": (MULTI, ("Multi part", "plain words here", True)),
    "html": (HTML, ("H", "Hi&bye click http://evil.com/x mail go http://post.example/f http://area.example/", True)),
    "markup_in_plain": (b"Subject: s\n\nsee <a href='http://e.org'>this</a> now", ("s", "see this http://e.org now", True)),
    "address": (b"Subject: s\n\nmail <joe@x.org> now", ("s", "mail now", True)),
    "undecodable": (b"Subject: s\nContent-Type: text/plain; charset=nope\n\ncaf\xff end", ("s", "caf� end", False)),
    "empty": (b"", ("", "", False)),
    "latin": ("Subject: s\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\ncafé".encode("latin-1"), ("s", "café", False)),
}


def test_parse_messages(spark):
    rows = [(k, bytearray(v[0]), 7) for k, v in MESSAGES.items()]
    df = spark.createDataFrame(rows, "original_id string, raw binary, tag int")
    got = {r["original_id"]: r for r in mail.parse_messages(df).collect()}
    for name, (_, want) in MESSAGES.items():
        assert (got[name]["subject"], got[name]["body"], got[name]["had_html"]) == want, name
        assert got[name]["tag"] == 7


def _tar(path, members, mode="w", **options):
    with tarfile.open(path, mode, **options) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            if data is None:
                info.type = tarfile.DIRTYPE
            tar.addfile(info, io.BytesIO(data))


def _scanned(spark, paths, **options):
    return sorted((r["original_id"], bytes(r["raw"])) for r in archives.read_archives(spark, [str(p) for p in paths], "sa", **options).collect())


@pytest.mark.parametrize("kind", ["", "gz", "bz2", "xz"])
def test_archives(spark, tmp_path, kind):
    path = tmp_path / f"ham.tar.{kind or 'plain'}"
    _tar(path, (("ham/1", MULTI), ("ham/.index", b"skip"), ("ham/2", HTML), ("empty", b"")), f"w:{kind}")
    assert _scanned(spark, [path]) == [(f"sa:{path.name}:{n}", d) for n, d in (("empty", b""), ("ham/1", MULTI), ("ham/2", HTML))]


@pytest.mark.parametrize("form", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT])
@pytest.mark.parametrize("range_bytes", [1, 2_000, 50_000, 2**26])
def test_plain_archives_are_split_by_members(spark, tmp_path, form, range_bytes):
    """Long names, headers for the whole archive, an archive within the archive, contents of any length."""
    inner = tmp_path / "inner.tar"
    _tar(inner, [("not/a/member", b"x" * 700)])
    members = [(f"d/{'long' * (40 * (i % 3))}{i}", bytes([65 + i % 26]) * (i * 37 % 5_000)) for i in range(60)] + [("inner", inner.read_bytes()), (".hid", b"n")]
    path = tmp_path / "a.tar"
    _tar(path, members, format=form, pax_headers={"comment": "for all members"} if form == tarfile.PAX_FORMAT else None)
    want = sorted((f"sa:a.tar:{n}", d) for n, d in members if n != ".hid")
    assert _scanned(spark, [path], range_bytes=range_bytes) == want
    ranges = list(archives.ranges_of(str(path), range_bytes))
    assert sum(r[4] for r in ranges) == len(want) and (len(ranges) > 10) == (range_bytes < 10_000)
    assert all(a[2] == b[1] for a, b in zip(ranges, ranges[1:]))


def test_archives_written_and_read(spark, tmp_path):
    rows = [(f"m/{i}", bytes([i % 256]) * i) for i in range(200)] + [("null", None)]
    messages = spark.createDataFrame(rows, "member string, raw binary").repartition(5)
    for kind in ("", "gz"):
        written = archives.write_archives(messages, str(tmp_path / f"out{kind}"), kind)
        assert sum(r["members"] for r in written.collect()) == 201
        got = _scanned(spark, [r["path"] for r in written.collect()], range_bytes=3_000)
        assert sorted((i.split(":", 2)[2], b) for i, b in got) == sorted((n, d or b"") for n, d in rows)
    assert archives.read_archives(spark, [], "sa").count() == 0
    _tar(tmp_path / "none.tar", [])
    assert _scanned(spark, [tmp_path / "none.tar"]) == []


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "1").write_bytes(b"Subject: a\n\nx")
    (tmp_path / "sub" / ".hidden").write_bytes(b"no")
    got = mail.read_directory(spark, str(tmp_path), "enron").collect()
    assert [r["original_id"] for r in got] == [f"enron:{tmp_path}/sub/1"]


@pytest.mark.parametrize("split_bytes", ["128m", "64"])
def test_mailboxes_even_when_split(spark, tmp_path, split_bytes):
    import mailbox

    (tmp_path / "in").mkdir()
    for name, n in (("one.mbox", 30), ("two.mbox", 3)):
        text = "".join(f"From a@b Thu Jan  1 00:00:00 2024\nSubject: {name} {i}\n\nbody {i} of {name}\n\n" for i in range(n))
        (tmp_path / "in" / name).write_text(text)
    (tmp_path / "in" / "pre.mbox").write_text("junk line\nFrom a@b\nSubject: kept\n\nx\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        rows = mail.parse_messages(mail.read_mailboxes(spark, str(tmp_path / "in"), "naz")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {r["original_id"]: r["subject"] for r in rows}
    want = {}
    for name in ("one.mbox", "two.mbox", "pre.mbox"):
        for i, m in enumerate(mailbox.mbox(str(tmp_path / "in" / name))):
            want[f"naz:{name}:{i}"] = m["subject"]
    assert got == want


def test_csv_dataset_and_external(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        "id,text,subject,body,label,source,split,original_id,had_html\n"
        'a,"line one\nline ""two""",s,b,1,src,train,o1,True\nb,,,,0,src,test,o2,\n'
    )
    rows = {r["id"]: r for r in tables.read_dataset(spark, str(tmp_path / "d.csv")).collect()}
    assert rows["a"]["text"] == 'line one\nline "two"' and rows["a"]["had_html"] is True
    assert rows["b"]["text"] == "" and rows["b"]["had_html"] is False
    (tmp_path / "x.csv").write_text('subject,body,date,label\nhi,"a\nb",2008-01-01,1\n,,,0\n')
    ext = tables.read_external(spark, str(tmp_path / "x.csv"), "ceas08").orderBy("original_id").collect()
    assert [r["original_id"] for r in ext] == ["ceas08:x.csv:0", "ceas08:x.csv:1"]
    assert ext[0]["body"] == "a\nb" and ext[1]["subject"] == ""


def record(oid, severity, text, ts, **extra):
    return json.dumps({
        "original_id": oid, "severity": severity, "rewrite_text": text, "ts": ts,
        "usage": {"input_tokens": 5}, "missing_urls": [], **extra,
    })


def test_rewrite_log(spark, tmp_path):
    lines = [
        record("a", 0.5, "old", "2024-01-01T00:00:00+00:00"), "", record("a", 0.5, "new", "2024-01-02T00:00:00+00:00", refused=True),
        record("b", 0.5, "same1", "2024-01-01T00:00:00+00:00"), record("b", 0.5, "same2", "2024-01-01T00:00:00+00:00"),
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    log = tables.read_rewrites(spark, str(tmp_path / "log.jsonl"))
    assert log.count() == 4
    last = {r["original_id"]: r for r in R.latest_rewrites(log, order=tables.WRITE_ORDER).collect()}
    assert last["a"]["rewrite_text"] == "new" and last["b"]["rewrite_text"] == "same2"
    assert last["a"]["usage"]["input_tokens"] == 5 and last["b"]["retained_urls"] is None
    assert tables.read_rewrites(spark, str(tmp_path / "none"), missing_ok=True).count() == 0
    with pytest.raises(Exception):
        tables.read_rewrites(spark, str(tmp_path / "none")).count()
    out = str(tmp_path / "out")
    tables.append_rewrites(log, out)
    tables.append_rewrites(log.limit(1), out)
    assert tables.read_rewrites(spark, out).count() == 5


def test_stream_judges_only_new_files(spark, tmp_path):
    log, out, ckpt = (str(tmp_path / n) for n in ("log", "out", "ck"))
    (tmp_path / "log").mkdir()
    originals = spark.createDataFrame([("a", "see http://evil.com/x"), ("b", "none")], "original_id string, text string")
    (tmp_path / "log" / "1.json").write_text(record("a", 0.5, "see http://evil.com/x", "2024-01-01T00:00:00Z") + "\n")
    stream_verdicts(spark, log, originals, out, ckpt).awaitTermination(60)
    (tmp_path / "log" / "2.json").write_text(
        record("a", 1.0, "gone", "2024-01-01T00:00:00Z") + "\n" + record("b", 0.5, "as an ai", "2024-01-01T00:00:00Z") + "\n"
    )
    stream_verdicts(spark, log, originals, out, ckpt).awaitTermination(60)
    got = {(r["original_id"], r["severity"]): (r["retained_urls"], r["refused"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 0.5): (True, False), ("a", 1.0): (False, False), ("b", 0.5): (None, True)}


def test_a_worker_holds_few_parsed_messages(spark, monkeypatch):
    from steadfast.sources import mail

    monkeypatch.setattr(mail, "MESSAGES", 3)
    rows = [(str(i), b"Subject: s%d\n\nbody" % i if i % 4 else None, i) for i in range(20)]
    out = mail.parse_messages(spark.createDataFrame(rows, "original_id string, raw binary, extra long").coalesce(1))
    got = out.orderBy("extra").collect()
    assert [(r["original_id"], r["subject"], r["body"], r["had_html"], r["extra"]) for r in got] == [
        (str(i), f"s{i}" if i % 4 else "", "body" if i % 4 else "", False, i) for i in range(20)]
    assert "MapInArrow" in out._jdf.queryExecution().toString()
