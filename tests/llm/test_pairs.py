"""Near duplicates, components and exact search, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from steadfast.llm import common, neardup, topk
from steadfast.llm import components as components_module
from steadfast.llm.components import components
from tests.llm import helpers


def words_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(rows, pct):
    """Row for row: (doc_id, size, smallest id). Rows without an id are left to their class."""
    sets = [words_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= pct * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return Counter((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    """Families of near copies with one to eight changed words, in rising numbers."""
    rng, rows = random.Random(seed), []
    for family in range(6):
        base = helpers.sentence(1000 * seed + family, rng.choice([30, 80, 150])).split()
        for _ in range(rng.choice([2, 5, 40])):
            words = base[:]
            for _ in range(rng.randrange(9)):
                words[rng.randrange(len(words))] = rng.choice(["new", "other", f"w{rng.randrange(10**6)}"])
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows, 50))


@pytest.mark.parametrize("pct, seed", [(85, 1), (80, 2)])
def test_groups(spark, pct, seed):
    rows = [r[:2] for r in helpers.rows()] + corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as sig", "2 as entry")
    got = neardup.groups(docs, pct).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, pct)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


@pytest.mark.parametrize("stage", ["groups", "pipeline"])
def test_no_join_goes_through_the_driver(spark, monkeypatch, tmp_path, stage):
    """Spark takes the files of an index or of node numbers for smaller than their rows are."""
    plans, saved = [], common.saved

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (neardup, components_module):
        monkeypatch.setattr(module, "saved", lambda df, what: saved(planned(df), what))
    docs = helpers.parquet(spark, tmp_path, "documents", spark.createDataFrame(corpus(1), "doc_id long, text string"))
    planned(neardup.groups(docs, 85) if stage == "groups" else corpus_pipeline.no_near_duplicates(spark, docs, "")).collect()
    assert sum("SortMergeJoin" in p for p in plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)


def test_no_documents(spark):
    assert neardup.groups(helpers.nothing(spark)).count() == 0
    assert neardup.groups(helpers.documents(spark).where("text is null or trim(text) = ''")).where("kept").count() == 2


def test_signature_distance_guarantees_an_entry(spark):
    rng = np.random.default_rng(3)
    chunks = 4
    base = rng.integers(0, 2**16, chunks * neardup.WIDTH).astype("<u2")
    rows = [(0, base)]
    for i in range(1, 40):
        other = base.copy()
        other[rng.choice(len(base), 2 * chunks - 1, replace=False)] ^= 1
        rows.append((i, other))
    df = spark.createDataFrame([(i, s.view("<i8").tolist()) for i, s in rows], "node long, sig array<long>")
    found = neardup.entries(df, chunks).toPandas().groupby("entry").node.apply(set)
    assert set().union(*(s for s in found if 0 in s)) == set(range(40))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node in got:
        seen, todo = {node}, [node]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        assert got[node] == min(seen)
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def brute_search(rows, every, k):
    """Every row against every row of another id; rows of one id are queries together."""
    ints = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ints if i % every == 0}):
        scores = [(-min(sum(a * b for a, b in zip(w, v)), 2**63 - 1), i) for j, w in ints if j == q for i, v in ints if i != q and len(v) == len(w)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("rows_per_range, queries", [(8192, 100_000), (40, 3)])
def test_search(spark, monkeypatch, rows_per_range, queries):
    monkeypatch.setattr(topk, "ROWS", rows_per_range)
    monkeypatch.setattr(topk, "QUERIES", queries)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) / 4]) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(30)]  # ties
    rows += [(100, rows[100][1]), (401, None), (402, []), (403, [1.0, None] * 4), (404, [float("nan")] * 8), (405, [float("inf")] * 8),
             (None, rows[3][1]), (450, [0.5, 0.5]), (500, [0.25, -0.5]), (-50, [1000.0] * 8), (550, [3e5] * 8), (551, [1e8] * 8),
             (150, [0.125] * 8), (150, rows[7][1]), *[(77, rows[i][1]) for i in range(200)]]
    df = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, label int, range int")
    got = sorted(tuple(r) for r in topk.nearest(df).collect())
    assert got == sorted(brute_search(rows, 50, 5))
    assert topk.nearest(df.where("1 = 0")).count() == 0
    assert topk.nearest(df.where("vec_id = 100")).count() == 0


def test_blocks_of_near_rows_are_left_out():
    """Clustered vectors: most blocks can't hold one of the best, and the best are those of a full search."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    rows = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) / 20)).astype(np.int64)
    order = topk.by_nearness(rows.astype(float))
    assert sorted(order) == list(range(4000))
    blocks = topk.Blocks(np.arange(4000), rows)
    for q in range(0, 4000, 50):
        ids, scores = blocks.best(q, rows[q], 5)
        every = rows @ rows[q]
        first = np.lexsort((np.arange(4000), -every))
        assert ids.tolist() == [i for i in first if i != q][:5] and scores.tolist() == every[ids].tolist()
    assert blocks.scored < 0.5 * 80 * len(blocks.starts)


def test_blocks_of_equal_rows():
    rows = np.full((500, 4), 7)
    assert topk.Blocks(np.arange(500), rows).best(3, rows[3], 5)[0].tolist() == [0, 1, 2, 4, 5]
