"""Fill-in-middle against a plain list of tokens, and the boundary set against a plain array."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import canonical, connect
from steadfast.llm import fim
from steadfast.llm.queries import QUERIES
from tests.llm import helpers

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plainly(doc, text):
    """(n, form, prefix, middle, output) from the list of all tokens."""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", p, m, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**6) | st.none(), st.text(alphabet="aZ0 \n<>PSM@[`{é😀\x00", max_size=60))
def test_transform_and_restore(doc, text):
    cut = fim.transform(doc, text)
    assert (cut.n, cut.form, cut.prefix, cut.middle, cut.output) == plainly(doc, text)
    assert fim.restore(cut.output, cut.form) == text


SETS = {
    "none": [], "one": [0], "array": range(3, 60_000, 37), "bitmap": [i for i in range(65_536) if i % 3],
    "runs": [*range(5_000, 40_000), *range(50_000, 65_536)], "bits at the ends": [0, 65_535, 65_536, 131_071, 131_072],
    "gap of containers": [7, 10 * 65_536 + 1, *range(40 * 65_536, 40 * 65_536 + 70_000), *range(50 * 65_536, 51 * 65_536, 2)],
}


@pytest.mark.parametrize("name", SETS)
def test_select(name):
    places = np.array(list(SETS[name]), np.int64)
    held = fim.Boundaries(places)
    assert len(held) == len(places)
    for k in sorted({*range(0, len(places), max(1, len(places) // 500)), *([len(places) - 1] if len(places) else [])}):
        assert held.select(k) == places[k]


def test_each_kind_of_container_is_used():
    kinds = {type(c).__name__ for name in SETS for c in fim.Boundaries(np.array(list(SETS[name]), np.int64)).containers}
    assert kinds == {"Array", "Bitmap", "Runs"}
    assert [type(c).__name__ for c in fim.boundaries("a" * 70_000 + "0" * 70_000).containers] == ["Runs", "Runs"]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 200_000), min_size=1, max_size=300), st.data())
def test_select_any(places, data):
    ordered = sorted(places)
    k = data.draw(st.integers(0, len(ordered) - 1))
    assert fim.Boundaries(np.array(ordered, np.int64)).select(k) == ordered[k]


def test_documents(spark):
    want, digests = Counter(), Counter()
    for doc, text, *_ in helpers.rows():
        n, form, p, m, output = plainly(doc, text or "")
        lengths = (None if p is None else len(p), None if m is None else len(m))
        want[doc, n, form, *lengths, output] += 1
        digests[doc, n, form, *lengths, fim.sha256(output), fim.sha256(text or "")] += 1
    assert Counter(map(tuple, fim.fill_in_middle(helpers.documents(spark)).collect())) == want
    assert Counter(map(tuple, fim.fill_in_middle(helpers.documents(spark), digests=True).collect())) == digests
    assert fim.fill_in_middle(helpers.nothing(spark)).count() == 0


def test_query_against_sql(spark):
    fn, sql = QUERIES["op12_fim"]
    sf = "/root/testdata/sf0.001"
    assert canonical(fn(spark, sf).toArrow()) == canonical(connect(sf).execute(sql).to_arrow_table())
