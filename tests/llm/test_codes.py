"""Product codes against a search through all entries."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import canonical, connect
from steadfast.llm import codes
from steadfast.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, row int, code string, error long"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) if abs(x) < 2**53 else int(x) * 256 for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))
    length = len(first[0][1]) if first else 0
    if not length or length % parts:
        return Counter((i, None, None, None, None) for i, _, _ in kept)
    fit = [r for r in first if len(r[1]) == length]
    width = length // parts
    part = lambda v, p: v[p * width:(p + 1) * width]
    books = [[part(v, p) for _, v, _ in fit[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        made = []
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in fit:
                members[nearest(v, p)[1]].append(part(v, p))
            made.append([[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else entry for e, entry in enumerate(books[p])])
        books = made
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    found, sums = [], defaultdict(int)
    for i, v, label in kept:
        if len(v) != length:
            found.append((i, None, None, label))
            continue
        best = [nearest(v, p) for p in range(parts)]
        error = sum(d for d, _ in best)
        sums[label] += error
        found.append((i, "".join(f"{e:02x}" for _, e in best), error, label))
    as_long = lambda x: x if x is not None and x < 2**63 else None
    return Counter((i, code, as_long(error), as_long(sums.get(label)), digest) for i, code, error, label in found)


def coded(spark, rows, **options):
    table = spark.createDataFrame([(i, v, label, 1, "x", 2) for i, v, label in rows], SCHEMA).repartition(3)
    return Counter(map(tuple, codes.compress(table, **options).collect()))


def vectors(seed, n, spread=0.2, length=32):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(length)], rng.choice([0, 1, 1, None])) for i in range(n)]


def test_awkward_rows(spark):
    rows = vectors(1, 150)
    one = rows[3][1]
    rows += [(None, one, 1), (None, one, None), (7, one, 2), (7, one, 2), (500, None, 1), (501, [None] * 32, 1), (502, [float("nan")] * 32, 1),
             (503, [float("inf")] + [0.0] * 31, 1), (504, [0.0] * 31, 3), (505, [], 3), (506, [0.1] * 64, 0), (507, [-0.0, 1e-9, -1e-9] + [0.5] * 29, 0)]
    assert coded(spark, rows) == brute(rows)
    assert coded(spark, rows, cell=1, memo=3) == brute(rows)
    assert coded(spark, rows, parts=4, entries=200, rounds=3) == brute(rows, 4, 200, 3)


def test_a_hot_vector_and_ties(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(16)], 1) for i in range(120)] + [(1000 + i, [0.25] * 16, 1) for i in range(100)]
    assert coded(spark, rows) == brute(rows)


def test_components_of_any_size_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1e-3, 3e5, -7e9, 1e18, 1e200][:size]) * rng.random() for _ in range(16)], i % 2) for size in (2, 3, 5) for i in range(size * 100, size * 100 + 30)]
    assert coded(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)], [(1, [0.5] * 15, 1), (2, [0.5] * 16, 1)], [(1, [0.5] * 16, None)]])
def test_few_rows(spark, rows):
    assert coded(spark, rows) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-40, 40)] * 3), min_size=1, max_size=40), st.lists(st.tuples(*[st.integers(-40, 40)] * 3), min_size=1, max_size=12), st.integers(1, 30))
def test_cells_find_what_a_full_search_finds(points, book, cell):
    cells = codes.Cells(np.array(book, np.int64), cell, memo=4)
    for _ in range(2):  # the second time from memory
        index, far = cells.nearest(np.array(points, np.int64))
        want = [min((sum((a - b) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(book)) for p in points]
        assert list(zip(far.tolist(), index.tolist())) == want


def test_cells_spare_exact_evaluations():
    rng = np.random.default_rng(4)
    book, points = rng.normal(0, 32, (64, 4)).astype(np.int64), rng.normal(0, 32, (20_000, 4)).astype(np.int64)
    cells = codes.Cells(book, codes.CELL, codes.MEMO)
    cells.nearest(points)
    assert cells.evaluated < 0.5 * len(points) * len(book)


def test_decode(spark):
    rows = vectors(6, 40)
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>, label string")
    books = codes.fit(table)
    for row in codes.encode(table, books).collect():
        exact = codes.integers([rows[row.vec_id][1]])[0]
        assert int(((codes.decode(row.code, books) - exact) ** 2).sum()) == row.error


def test_query_against_sql(spark):
    fn, sql = QUERIES["op13_codes"]
    sf = "/root/testdata/sf0.001"
    assert canonical(fn(spark, sf).toArrow()) == canonical(connect(sf).execute(sql).to_arrow_table())
