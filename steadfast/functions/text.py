"""Text expressions. All but the folding of rare characters are built-in Spark expressions."""

import sys
import unicodedata
from functools import lru_cache

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from steadfast import lexicons as L

# Workers get the folding with the task, whether or not they can import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLD = "(?iu)"
# Marks the start of a URL token while it is being defanged. A Unicode noncharacter:
# it has no meaning in text interchange.
TOKEN_MARK = "\ufdd0"


def let(value: Column, body) -> Column:
    """body(value) with value computed once. Filters are pushed below projections by
    substitution, which would otherwise repeat a costly input at every mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(L.SPACE_LIST))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, L.SPACES, " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, L.SPACES, -1), lambda w: w != "")


def unified_text(subject: Column, body: Column) -> Column:
    return strip(F.concat(or_empty(subject), F.lit("\n"), or_empty(body)))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_within(text: Column, outside: str) -> Column:
    """Characters that are not in the class `outside`: what is left without its runs. Nothing is made for each match."""
    return F.length(F.regexp_replace(text, outside + "+", ""))


def count_substring(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (gone / F.lit(len(needle))).cast("long")


def content_tokens(subject: Column, body: Column) -> Column:
    """Tokens that hold at least two letters."""
    tokens = F.split(F.concat(or_empty(subject), F.lit(" "), or_empty(body)), L.SPACES, -1)
    return F.size(
        F.filter(tokens, lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 2)
    )


def is_low_content(subject: Column, body: Column, minimum: int = L.MIN_CONTENT_TOKENS) -> Column:
    return content_tokens(subject, body) < minimum


def head(text: Column, n_tokens: int) -> Column:
    """First n whitespace tokens of the whole text."""
    return F.array_join(F.slice(words(or_empty(text)), 1, n_tokens), " ")


def clip(text: Column, n_chars: int) -> Column:
    return F.substring(or_empty(text), 1, n_chars)


def looks_like_refusal(text: Column) -> Column:
    def any_marker(low):
        hit = F.lit(False)
        for marker in L.REFUSAL_MARKERS:
            hit = hit | F.contains(low, F.lit(marker))
        return hit

    return let(F.lower(or_empty(text)), any_marker)


def parse_rewrite(raw: Column) -> Column:
    """struct(subject, body, text): an optional leading 'Subject:' line is split off."""
    def parts(text):
        headed = F.lower(F.substring(text, 1, 8)) == "subject:"
        cut = F.instr(text, "\n")
        rest = F.when(cut > 0, F.substr(text, cut + 1)).otherwise(F.lit(""))
        first = F.substring_index(text, "\n", 1)
        return F.struct(
            F.when(headed, strip(F.substr(first, F.lit(9)))).otherwise(F.lit("")).alias("subject"),
            F.when(headed, strip(rest)).otherwise(text).alias("body"),
        )

    return let(let(strip(or_empty(raw)), parts), lambda p: F.struct(
        p["subject"].alias("subject"), p["body"].alias("body"),
        unified_text(p["subject"], p["body"]).alias("text"),
    ))


def mask_urls(text: Column) -> Column:
    return F.regexp_replace(or_empty(text), FOLD + L.GREEDY_URL, " ")


def defang(text: Column) -> Column:
    """Make every URL unclickable: the leading scheme or www of each URL token, then any
    lower-case scheme nested deeper in a token."""
    out = F.regexp_replace(or_empty(text), f"{FOLD}({L.GREEDY_URL})", TOKEN_MARK + "$1")
    for pattern, safe in (("https://", "hxxps://"), ("http://", "hxxp://"), (r"www\.", "www[.]")):
        out = F.regexp_replace(out, f"{FOLD}{TOKEN_MARK}{pattern}", safe)
    for live, safe in (("https://", "hxxps://"), ("http://", "hxxp://")):
        out = F.replace(out, F.lit(live), F.lit(safe))
    return out


def refang(text: Column) -> Column:
    out = F.regexp_replace(or_empty(text), f"{FOLD}({L.GREEDY_URL_DEFANGED})", TOKEN_MARK + "$1")
    for pattern, live in (("hxxps://", "https://"), ("hxxp://", "http://"), (r"www\[\.\]", "www.")):
        out = F.regexp_replace(out, f"{FOLD}{TOKEN_MARK}{pattern}", live)
    for safe, live in (("hxxps://", "https://"), ("hxxp://", "http://")):
        out = F.replace(out, F.lit(safe), F.lit(live))
    return out


def live_scheme_left(text: Column) -> Column:
    """Any scheme, in any case, that defanging did not reach."""
    return F.regexp_count(text, F.lit(FOLD + "https?://")) > 0


def has_any_tag(text: Column) -> Column:
    return F.rlike(or_empty(text), F.lit(L.ANY_TAG))


def has_listed_tag(text: Column) -> Column:
    return F.rlike(or_empty(text), F.lit("(?iu)" + L.LISTED_TAG))


def urgency_count(text: Column) -> Column:
    low = F.lower(text)
    total = F.lit(0).cast("long")
    for word in L.URGENCY_WORDS:
        total = total + count_substring(low, word)
    return total


def handcrafted(text: Column, had_html: Column) -> list[Column]:
    """The eight numeric features, in table order."""
    body = or_empty(text)
    n_chars = F.length(body)
    n_letters = count_within(body, r"\P{L}")
    zero = F.lit(0.0)
    values = (
        n_chars.cast("double"),
        F.size(words(body)).cast("double"),
        count_matches(body, FOLD + L.GREEDY_URL).cast("double"),
        urgency_count(body).cast("double"),
        count_substring(body, "!").cast("double"),
        F.when(n_chars > 0, count_within(body, r"\P{Nd}") / n_chars).otherwise(zero),
        F.when(n_letters > 0, count_within(body, r"\P{Lu}") / n_letters).otherwise(zero),
        F.coalesce(had_html, F.lit(False)).cast("double"),
    )
    return [v.alias(name) for v, name in zip(values, L.HANDCRAFTED)]


def fold_accents(text: str) -> str:
    """Compatibility decomposition without the combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


#: Last of the accented Latin letters that stand together. No range of rare characters goes across it.
LATIN = 0x24F


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, str]:
    """From the Unicode tables: characters that fold to a single one, what they fold to, and a
    pattern of those that fold to several or to none. The pattern turns ASCII away first, then accented Latin
    letters, which would otherwise be held against every range."""
    source, target, ranges = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        bare = fold_accents(char)
        if bare == char:
            continue
        if len(bare) == 1:
            source.append(char)
            target.append(bare)
        elif ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    latin, others = (
        "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges if (b <= LATIN) == low) for low in (True, False))
    return "".join(source), "".join(target), rf"[[^\x00-\x7f]&&[[{latin}][[^\x00-\x{{{LATIN:x}}}]&&[{others}]]]]"


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def folds_in_place(text: Column) -> Column:
    """Whether every character folds to exactly one, so that built-in expressions do it."""
    return _is_ascii(text) | ~F.rlike(text, F.lit(_folding()[2]))


def fold_in_place(text: Column) -> Column:
    """Accent folding of texts that fold in place."""
    source, target, _ = _folding()
    return F.when(_is_ascii(text), text).otherwise(F.translate(text, source, target))


def fold_any(text: Column) -> Column:
    """Accent folding of any text, in Arrow batches."""
    return F.pandas_udf(lambda texts: texts.map(fold_accents, na_action="ignore"), "string")(text)


def strip_accents(text: Column) -> Column:
    """Accent folding over all of Unicode. Texts whose characters fold one to one stay in the
    JVM; the others, say with ligatures, Hangul or loose marks, are folded in Arrow batches."""
    return F.coalesce(fold_any(F.when(~folds_in_place(text), text)), fold_in_place(text))


def tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(L.TERM), F.lit(0))


def terms(text: Column) -> Column:
    """Unigrams of the folded text."""
    return tokens(strip_accents(F.lower(or_empty(text))))


def with_bigrams(unigrams: Column) -> Column:
    def extend(u):
        n = F.greatest(F.size(u) - 1, F.lit(0))
        pairs = F.zip_with(
            F.slice(u, 1, n), F.slice(u, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)
        )
        return F.concat(u, pairs)

    return let(unigrams, extend)


def percent(value: Column) -> Column:
    """One decimal place, e.g. 12.3%."""
    return F.format_string("%.1f%%", value * 100.0)


def era_of(original_id: Column) -> Column:
    tag = F.coalesce(F.get(F.split(original_id, ":", -1), F.lit(1)), original_id)
    return F.when(F.endswith(tag, F.lit(".mbox")), F.lit("legacy_mbox")).otherwise(
        F.lit("modern_year")
    )


def mail_year(text: Column) -> Column:
    """Year in UTC of a mail date header or an ISO stamp; null when it cannot be read."""
    cleaned = F.regexp_replace(F.trim(text), r"\s*\([^)]*\)\s*$", "")
    cleaned = F.regexp_replace(cleaned, r"^[A-Za-z]{3,9},?\s+", "")
    cleaned = F.regexp_replace(cleaned, r"(?i)\s(?:GMT|UTC|UT|Z)$", " +0000")
    attempts = [
        F.try_to_timestamp(cleaned, F.lit(fmt))
        for fmt in (
            "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy",
        )
    ]
    stamp = F.coalesce(*attempts, F.try_to_timestamp(F.trim(text)))
    return F.year(F.to_utc_timestamp(stamp, F.current_timezone()))
