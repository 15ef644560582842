"""CSV in splits: states against a character-by-character reading, rows against Spark's whole-file reader."""

import gzip
import io
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from steadfast.schemas import EXTERNAL_CSV
from steadfast.sources import quoted

SCRAPS = st.lists(st.sampled_from(['"', ",", "\n", "\r\n", "\r", "a", 'b"', '""', "é "]), max_size=40).map("".join)


def plain_records(data: bytes) -> list[bytes]:
    """Records by one look at every byte."""
    found, begin, state, blank = [], 0, "start", True
    for i, c in enumerate(data):
        c = bytes([c])
        if state == "closing":
            state = "quoted" if c == b'"' else "plain"
            if state == "quoted":
                continue
        if state == "quoted":
            state = "closing" if c == b'"' else state
        elif c == b"\n":
            found.append(data[begin:i].removesuffix(b"\r"))
            begin, state = i + 1, "start"
        elif c == b",":
            state = "start"
        elif state == "start":
            state = "quoted" if c == b'"' else "plain"
    rest = data[begin:]
    return [r for r in [*found, rest.removesuffix(b"\r") if rest.strip(b"\r") else b""] if r]


def in_splits(data: bytes, size: int, block: int) -> list[tuple[int, bytes]]:
    walked = []
    for start in range(0, len(data), size):
        file = io.BytesIO(data)
        file.seek(start)
        stop = min(len(data), start + size)
        ends, ended = quoted.walk(file.read, stop - start)
        walked.append({"path": "p", "start": start, "stop": stop, "ends": ends, "ended": ended})
    rows = []
    for r in quoted.settled(walked):
        file = io.BytesIO(data)
        file.seek(r.start)
        rows += quoted.records(file.read, r.state, r.stop - r.start, r.before, block)
    return rows


@settings(max_examples=200, deadline=None)
@given(SCRAPS, st.integers(1, 30), st.integers(1, 12))
def test_splits_give_the_records_of_the_whole(text, size, block):
    data = text.encode()
    want = plain_records(data)
    assert in_splits(data, size, block) == list(enumerate(want))
    assert list(quoted.records(io.BytesIO(data).read, "R", float("inf"), block=block)) == list(enumerate(want))


def test_a_record_longer_than_many_splits():
    data = b'h,i\nx,"' + b'line, ""quoted""\n' * 5_000 + b'"\ny,z\n'
    rows = in_splits(data, 1_000, 512)
    assert [n for n, _ in rows] == [0, 1, 2] and rows[2][1] == b"y,z" and len(rows[1][1]) > 80_000


def write(path, rows, end=b"\n"):
    path.write_bytes(b"".join([b"subject,body,date,label\n", *rows]).replace(b"\n", end))


def test_rows_equal_those_of_a_whole_read(spark, tmp_path):
    rows = [
        b'hi,"two\nlines, a comma and ""quotes""\n",2008-01-01,1\n', b",,,0\n", b"\n", b'"",x,"",\n', "é,漢字 😀,d,7\n".encode(),
        b'inch 5",stray "quote" here,d,3\n', b"short,row\n", b"bad,label,d,x\n", b' padded , "not quoted" ,d,2\n', b'back\\slash,"a\\",d,5\n', b'"mid"dle,"a" b,d,5\n',
    ]
    folder = tmp_path / "in put"
    folder.mkdir()
    write(folder / "a b.csv", rows * 4)
    write(folder / "crlf.csv", rows, b"\r\n")
    write(folder / "none.csv", [])
    (folder / "empty.csv").write_bytes(b"")
    write(folder / "open.csv", [b"last,without end,d,9"])
    names = EXTERNAL_CSV.names
    want = Counter(map(tuple, spark.read.schema(EXTERNAL_CSV).option("header", True).option("multiLine", True).option("escape", '"')
                       .csv(str(folder)).collect()))
    for size in (37, 10**6):
        got = quoted.read_csv(spark, str(folder), EXTERNAL_CSV, size)
        table = got.collect()
        # the whole-file reader turns line ends within quotes into \n where a file's own are \r\n
        assert Counter(tuple(v.replace("\r\n", "\n") if isinstance(v, str) else v for v in (r[n] for n in names)) for r in table) == want
        assert sum("\r\n" in (r["body"] or "") for r in table) == 1
        assert sorted(r["index"] for r in table if r["_file"].endswith("a b.csv")) == list(range(40))
    assert quoted.read_csv(spark, str(folder), EXTERNAL_CSV, 100).rdd.getNumPartitions() > 10


def test_compressed_and_empty_folders(spark, tmp_path):
    (tmp_path / "z").mkdir()
    assert quoted.read_csv(spark, str(tmp_path / "z"), EXTERNAL_CSV).collect() == []
    with gzip.open(tmp_path / "z" / "x.csv.gz", "wb") as out:
        out.write(b'subject,body,date,label\n"a\nb",c,d,1\ne,f,g,2\n')
    got = quoted.read_csv(spark, str(tmp_path / "z"), EXTERNAL_CSV, 5).orderBy("index").collect()
    assert [(r["index"], r["subject"], r["label"]) for r in got] == [(0, "a\nb", 1), (1, "e", 2)]
