"""URL extraction, ask-strength scoring and retention verdicts, all inside one row:
arrays and higher-order functions, no explode and no shuffle."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.functions.text import FOLD, let, or_empty



def greedy_urls(text: Column) -> Column:
    return F.regexp_extract_all(or_empty(text), F.lit(FOLD + L.GREEDY_URL), F.lit(0))


def strict_urls(text: Column) -> Column:
    return F.regexp_extract_all(or_empty(text), F.lit(FOLD + L.STRICT_URL), F.lit(0))


def normalized(url: Column) -> Column:
    return F.lower(F.rtrim(url, F.lit(L.URL_TRAILING)))


def anchor_urls(text: Column) -> Column:
    """Normalised strict URLs, first occurrence kept."""
    return F.array_distinct(F.transform(strict_urls(text), normalized))


def host_of(url: Column) -> Column:
    def whole_without(low):
        return let(F.regexp_extract(low, L.URL_HOST, 1), lambda host: F.when(host == "", low).otherwise(host))

    return let(F.lower(url), whole_without)


# What a list is searched for is bound first: each of its names would compute it anew.
def _host_listed(host: Column, names) -> Column:
    listed = F.array(*[F.lit(n) for n in names])
    return let(host, lambda h: F.exists(listed, lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d))))


def _holds_any(text: Column, needles) -> Column:
    return let(text, lambda t: F.exists(F.array(*[F.lit(n) for n in needles]), lambda k: F.contains(t, k)))


def is_ipv4_host(host: Column) -> Column:
    return F.rlike(host, F.lit(L.IPV4_HOST))


def is_known_brand(host: Column) -> Column:
    return _host_listed(host, L.KNOWN_BRANDS)


def _incidental(low: Column, host: Column) -> Column:
    return (
        _host_listed(host, L.INCIDENTAL_HOSTS)
        | (F.startswith(host, F.lit("click")) & F.contains(host, F.lit("ebay")))
        | F.rlike(low, F.lit(L.ASSET_SUFFIX))
        | _holds_any(low, L.INCIDENTAL_PATHS)
    )


def is_incidental(url: Column) -> Column:
    return let(F.lower(url), lambda low: let(host_of(low), lambda host: _incidental(low, host)))


def url_strength(url: Column) -> Column:
    """Lower case and host are found once for each URL."""
    def strength(low, host):
        points = (
            F.when(is_ipv4_host(host), 3).otherwise(0)
            + F.when(_holds_any(low, L.ASK_PATHS), 2).otherwise(0)
            + F.when(is_known_brand(host), 0).otherwise(1)
        )
        return F.when(_incidental(low, host), F.lit(-1)).otherwise(points)

    return let(F.lower(url), lambda low: let(host_of(low), lambda host: strength(low, host)))


def scored_urls(urls: Column) -> Column:
    return F.transform(urls, lambda u: F.struct(u.alias("url"), url_strength(u).alias("strength")))


def top_tier(scored: Column) -> Column:
    """URLs of the highest non-incidental strength present."""
    def pick(all_urls):
        best = F.array_max(F.transform(all_urls, lambda s: s["strength"]))
        return let(best, lambda top: F.transform(
            F.filter(all_urls, lambda s: (s["strength"] >= 0) & (s["strength"] == top)),
            lambda s: s["url"],
        ))

    return let(scored, pick)


def primary_urls(text: Column) -> Column:
    return top_tier(scored_urls(anchor_urls(text)))


def missing_from(originals: Column, rewritten: Column) -> Column:
    """Originals that no rewritten URL equals, contains or is contained in."""
    return F.filter(
        originals,
        lambda u: ~F.exists(rewritten, lambda r: F.contains(r, u) | F.contains(u, r)),
    )


def match_kind(originals: Column, rewritten: Column, missing: Column) -> Column:
    """How the whole set was matched: none / exact / substring / missing."""
    exact = F.size(F.array_except(originals, rewritten)) == 0
    return (
        F.when(F.size(originals) == 0, "none").when(exact, "exact")
        .when(F.size(missing) > 0, "missing").otherwise("substring")
    )


def verdict(originals: Column, missing: Column) -> Column:
    """True / False, or null when there is nothing to check."""
    return F.when(F.size(originals) > 0, F.size(missing) == 0)


def retention(original: Column, rewrite: Column) -> Column:
    """Struct of both verdicts for a pair of texts. Each text is scanned once."""
    def judge(s):
        return F.struct(
            F.size(s["o"]).alias("n_orig_urls"),
            s["gone"].alias("missing_urls"),
            verdict(s["o"], s["gone"]).alias("retained_urls"),
            match_kind(s["o"], s["r"], s["gone"]).alias("match_kind"),
            F.size(s["p"]).alias("n_primary_urls"),
            s["p"].alias("primary_urls"),
            s["gone_p"].alias("missing_primary_urls"),
            verdict(s["p"], s["gone_p"]).alias("retained_primary"),
        )

    urls = F.struct(
        anchor_urls(original).alias("o"),
        F.array_distinct(F.transform(strict_urls(rewrite), normalized)).alias("r"),
    )
    tiers = let(urls, lambda s: F.struct(
        s["o"].alias("o"), s["r"].alias("r"), top_tier(scored_urls(s["o"])).alias("p")
    ))
    gaps = let(tiers, lambda s: F.struct(
        s["o"].alias("o"), s["r"].alias("r"), s["p"].alias("p"),
        missing_from(s["o"], s["r"]).alias("gone"), missing_from(s["p"], s["r"]).alias("gone_p"),
    ))
    return let(gaps, judge)
