"""Pages built around known text."""

import random

import pytest
from pyspark.sql import functions as F

from steadfast.functions import html as HT
from steadfast.functions import pages as PG

PAGES = {
    # page: visible text, destinations
    """<p>read <a href="http://notes.test/o'k">this note</a> now""": ("read this note http://notes.test/o'k now", ["http://notes.test/o'k"]),
    """<a href='http://notes.test/a b'>two words</a>""": ("two words http://notes.test/a b", ["http://notes.test/a b"]),
    "<p>open <a href=http://notes.test/left>never closed": ("open never closed http://notes.test/left", ["http://notes.test/left"]),
    """<a title="a>b" href="http://notes.test/q">quoted</a> sign""": ("quoted http://notes.test/q sign", ["http://notes.test/q"]),
    "&copy; 2020 &#8217;caf&eacute;&#x27; &amp;lt; 5&nbsp;&gt; 4": ("\u00a9 2020 \u2019caf\u00e9' &lt; 5 > 4", []),
    """<form action="http://forms.test/go">name <input> </form>end""": ("name http://forms.test/go end", ["http://forms.test/go"]),
    """<form action=http://forms.test/f><a href="#top">up</a><area href=http://maps.test/1>""": (
        "up http://maps.test/1 http://forms.test/f", ["http://maps.test/1", "http://forms.test/f"]),
    "<style>p { color: red }</style><script>if (a < b) go('<p>')</script>seen<!-- not > this -->": ("seen", []),
    "<A HREF='MAILTO:me@x.test'>mail</A> 1 < 2": ("mail 1 < 2", []),
    "": ("", []),
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    text, links = HT.read_page(page)
    assert (" ".join(text.split()), links) == PAGES[page]


def test_columns(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*PAGES, None])], "i int, page string")
    got = df.orderBy("i").select(HT.to_text(F.col("page")).alias("text"), HT.link_targets(F.col("page")).alias("links")).collect()
    assert [(r.text, r.links) for r in got] == [*PAGES.values(), ("", [])]


# Pieces of pages, well formed or not, for the expressions to be held against the parser.
BITS = [
    "<a href='http://a.test/1'>", "<A HREF=http://b.test/2>", "</a>", "</A >", "</p>", "<b>", "</b>", "<br/>", "<a>", "<a href=x/>",
    "<a href='/self'/>", '<form action="http://f.test/?a=1&amp;b=2">', "</form>", "<area href=http://m.test/1 />", "<a name=x href = 'y' href=z>",
    "<a href='#t'>", "<a href=' mailto:q'>", "<a\nhref=\"http://n.test/\n\">", "<abbr href=no>", '<p title="x>y">', "<!-- c > d -->",
    "<!DOCTYPE html>", "<script>if(a<b) '<a href=x>'</script>", "<style>p{}</style>", "<script src=x></script>", "text ", " < ", "\n",
    "\u00e9", "\U0001d49c", "more&amp;", "&", "&copy;", "&copy2", "&notit;", "&lt", "&ltfoo;", "&NotEqualTilde;", "&bogus;",
    "&#x41;", "&#8217;", "&#150;", "&#13;", "&#0;", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#xfdd0;",
]


def _native(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, page string")
    out = df.select("i", PG.visible_text(F.col("page")).alias("text"), PG.destinations(F.col("page")).alias("links"))
    return {r.i: (r.text, r.links) for r in out.collect()}


def test_expressions_read_the_pages(spark):
    got = _native(spark, [*PAGES, None])
    assert [got[i] for i in range(len(got))] == [*PAGES.values(), ("", [])]


def test_expressions_equal_the_parser_on_mixed_pages(spark):
    rng = random.Random(3)
    pages = ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    got, df = _native(spark, pages), spark.createDataFrame(list(enumerate(pages)), "i int, page string")
    told = df.select("i", HT.to_text(F.col("page")).alias("text"), HT.link_targets(F.col("page")).alias("links")).collect()
    assert [(pages[r.i], got[r.i]) for r in told if got[r.i] != (r.text, r.links)] == []


def test_expressions_on_long_pages(spark):
    """No stack is exhausted by long tags, and a page with very many links costs about its length."""
    page = "<p>" + "<a href='/x'>word</a> &amp; " * 20_000 + "<b " + "q='1' " * 50_000 + ">end" + "<!--" + "x" * 1_000_000
    text, links = _native(spark, [page])[0]
    assert text == "word /x & " * 20_000 + "end" and links == ["/x"] * 20_000


def test_expressions_need_no_python(spark):
    df = spark.createDataFrame([], "page string").select(PG.visible_text(F.col("page")), PG.destinations(F.col("page")))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()
