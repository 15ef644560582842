"""Personal data: fixed patterns, and identifiers that bootstrapped contexts discover.

Fixed patterns find e-mail addresses, IP addresses, payment cards and phone numbers. They are the
seeds of a graph of lexical patterns (the two words before) and instances (the identifiers that
stand there, found or not). In turns, a pattern's confidence is the weight of its known instances
over all its instances, and an unknown instance's weight is the highest confidence among its
patterns; a pattern needs `SUPPORT` instances. Unknown identifiers behind patterns of at least
`CONFIDENCE` are spans of the pattern's kind. Everything is column expressions, joins and grouped
sums; texts are read once and never shuffled, only their spans are.

Positions are code points, ends exclusive. Null text is empty; texts without spans have an empty
list and the digest of the empty string. Repeated rows give a row each. An identifier on equal
terms in several kinds takes the first kind as listed. Columns of `docs` are never looked at
beyond doc_id and text.

The patterns below find what the plain ones in `PLAIN` find. They start at run ends only and hold
no repeated groups, so neither long runs nor long lists cost more than their length.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfast.llm.common import saved

KINDS = ("email", "ip", "card", "phone")
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARK = "\u0001"  # stands for a separator that joins nothing; such characters in a text count as blanks
LONE_DOT = r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])"
LONE_SEPARATOR = r"(?<![0-9])[ -]|[ -](?![0-9])"
EMAIL = r"(?:(?<![A-Za-z0-9._%+\x01-])|\G)[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]++"
PHONE = PLAIN["phone"]
#: A token with a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Two words at the end of what stands before.
BEFORE = r"(\S+\s+\S+)\s*$"
REACH = 48
BLOCK = 256
SUPPORT = 5.0
CONFIDENCE = 0.8
ROUNDS = 2
SPAN = "struct<start:bigint,end:bigint,kind:int,value:string,before:string>"


def _bound(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _in_blocks(values: Column, body) -> Column:
    """`body(block, values before it)` of each BLOCK values, joined. Lists grow within a block
    only, so long lists take hardly more than linear time."""
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")))
    each = F.transform(blocks, lambda b: body(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), b * BLOCK))
    return F.when(F.size(values) > 0, F.flatten(each)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _matches(text: Column, pattern: str, kind: int, whole: Column | None = None) -> Column:
    """All matches with their places: what lies between them gives the places. What stands before
    a match comes from `whole`, a text of the same places (`text` itself if None); it is cut from
    the part of `whole` that the match's block covers, so that long texts aren't walked per match."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    whole = text if whole is None else whole
    sized = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda n, v: n + F.length(v))
    cut = lambda value, begin, n: F.substring(value, (begin + 1).cast("int"), n.cast("int"))

    def block(both, values, before):
        at = sized(F.slice(both["pieces"], F.lit(1), before)) + sized(F.slice(both["found"], F.lit(1), before))
        long = sized(F.slice(both["pieces"], before + 1, F.size(values))) + sized(values)

        def spans(near):
            start = F.struct(near["at"].alias("at"), (before + 1).alias("i"), F.array().cast(f"array<{SPAN}>").alias("spans"))

            def add(state, value):
                begin = state["at"] + F.length(F.element_at(both["pieces"], state["i"]))
                end = begin + F.length(value)
                ahead = begin - near["from"]
                context = cut(near["text"], F.greatest(F.lit(0), ahead - REACH), F.least(ahead, F.lit(REACH)))
                span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"),
                                context.alias("before"))
                return F.struct(end.alias("at"), (state["i"] + 1).alias("i"), F.concat(state["spans"], F.array(span)).alias("spans"))

            return F.aggregate(values, start, add, lambda state: state["spans"])

        def near(at):
            since = F.greatest(F.lit(0), at - REACH)
            return F.struct(at.alias("at"), since.alias("from"), cut(whole, since, long + REACH).alias("text"))

        return _bound(at, lambda at: _bound(near(at), spans))

    return _bound(F.struct(pieces.alias("pieces"), found.alias("found")),
                  lambda both: _in_blocks(both["found"], lambda values, before: block(both, values, before)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    def small(part):
        own = F.ltrim(part, F.lit("0"))
        return F.when(F.length(own) <= 3, F.coalesce(F.expr("0") + own.try_cast("int"), F.lit(0)) <= 255).otherwise(False)

    return F.forall(F.split(value, r"\."), small)


def _is_card(value: Column) -> Column:
    def valid(digits):
        def weighed(i):
            d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
            twice = 2 * d
            return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

        total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + weighed(i))
        return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)

    return _bound(_digits(value), valid)


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    clean = F.translate(text, MARK, " ")
    parts = [
        F.when(F.contains(text, F.lit("@")), _matches(F.regexp_replace(clean, LONE_DOT, MARK), EMAIL, 0, text)),
        F.when(F.rlike(text, F.lit(IP)), F.filter(_matches(text, IP, 1), lambda s: _is_ip(s["value"]))),
        F.when(F.rlike(text, F.lit("[0-9](?:[ -]?[0-9]){11}")),
               F.filter(_matches(F.regexp_replace(clean, LONE_SEPARATOR, MARK), CARD, 2, text), lambda s: _is_card(s["value"]))),
        F.when(F.contains(text, F.lit("+")), F.filter(_matches(text, PHONE, 3), lambda s: _is_phone(s["value"]))),
    ]
    every = F.concat(*(F.coalesce(p, none) for p in parts))
    return F.when(F.rlike(text, F.lit("[0-9@]")), _in_order(every)).otherwise(none)


def _in_order(spans: Column) -> Column:
    return F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                                                           s["value"].alias("value"), s["before"].alias("before")))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"),
                           s["before"].alias("before")))


def unknown_identifiers(text: Column, base: Column) -> Column:
    """Tokens of at least four digits, or with an at sign, that no base span touches."""
    none = F.array().cast(f"array<{SPAN}>")

    def trimmed(s):
        front = F.regexp_extract(s["value"], r"^[(\[{\"'<]*", 0)
        back = F.regexp_extract(s["value"], r"[)\]}\"'>.,;:!?]*$", 0)
        begin, end = s["start"] + F.length(front), s["end"] - F.length(back)
        return F.struct(begin.alias("start"), F.greatest(begin, end).alias("end"), F.lit(-1).alias("kind"),
                        F.substring(s["value"], F.length(front) + 1, F.greatest(F.lit(0), (end - begin).cast("int"))).alias("value"),
                        F.right(F.concat(s["before"], front), F.lit(REACH)).alias("before"))

    tokens = F.transform(_matches(text, TOKEN, -1), trimmed)
    kept = F.filter(tokens, lambda s: (F.contains(s["value"], F.lit("@")) & (F.length(s["value"]) > 4)
                                       | (F.length(_digits(s["value"])) >= 4)))
    touch = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def free(block, _):
        low, high = F.element_at(block, 1)["start"], F.element_at(block, -1)["end"]
        near = F.filter(base, lambda b: (b["start"] < high) & (low < b["end"]))
        return _bound(near, lambda near: F.filter(block, lambda s: ~F.exists(near, lambda b: touch(b, s))))

    apart = _bound(kept, lambda kept: _in_blocks(kept, free))
    return F.when(F.rlike(text, F.lit("[0-9@]")), apart).otherwise(none)


def found_in(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Per row: a number, the named columns, its base spans and its unknown identifiers."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.struct(*(F.col(c) for c in carry)).alias("doc"), text.alias("text"))
    based = own.select(F.monotonically_increasing_id().alias("row"), "doc", "text", base_spans(F.col("text")).alias("base"))
    return based.select("row", "doc", "base", unknown_identifiers(F.col("text"), F.col("base")).alias("unknown"))


def _context(span: Column) -> Column:
    """The pattern of a span: the two words before, in lower case; empty if there are none."""
    return F.lower(F.regexp_replace(F.regexp_extract(span["before"], BEFORE, 1), r"\s+", " "))


def _edges(found: DataFrame, column: str) -> DataFrame:
    return (found.select("row", F.explode(column).alias("span"))
            .select("row", "span", _context(F.col("span")).alias("pattern"), F.lower(F.col("span.value")).alias("instance"),
                    F.col("span.kind").alias("kind")).where("pattern != ''"))


def learned_patterns(found: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of patterns that are trusted, after ROUNDS turns."""
    graph = saved(_edges(found, "base").select("pattern", "instance", "kind")
                  .unionByName(_edges(found, "unknown").select("pattern", "instance", "kind")).distinct(), "graph")
    sizes = graph.groupBy("pattern").agg(F.countDistinct("instance").alias("instances"))
    known = graph.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("weight")).distinct()
    weights = known
    for turn in range(ROUNDS):
        scored = (graph.select("pattern", "instance").distinct().join(weights, "instance")
                  .groupBy("pattern", "kind").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= SUPPORT)
                  .join(sizes, "pattern").select("pattern", "kind", (F.col("weight") / F.col("instances")).alias("confidence")))
        scored = saved(scored, "patterns")
        guessed = (graph.where("kind < 0").select("pattern", "instance").join(scored, "pattern")
                   .groupBy("instance", "kind").agg(F.max("confidence").alias("weight")))
        weights = known.unionByName(guessed)
    return scored.where(F.col("confidence") >= CONFIDENCE)


def with_spans(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Per row: `doc` (the named columns), `base` spans, and `spans`: these and the discovered ones."""
    found = saved(found_in(docs, carry), "found")
    patterns = learned_patterns(found)
    new = (_edges(found, "unknown").select("row", "span", "pattern").join(patterns, "pattern")
           .groupBy("row", F.col("span.start").alias("start"), F.col("span.end").alias("end"))
           .agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("kind").alias("kind"))).alias("best"))
           .groupBy("row").agg(F.collect_list(F.struct("start", "end", F.col("best.kind").alias("kind"), F.lit("").alias("value"),
                                                       F.lit("").alias("before")).cast(SPAN)).alias("new")))
    return found.join(new, "row", "left").select(
        "doc", "base", F.when(F.col("new").isNull(), F.col("base")).otherwise(
            _in_order(F.concat("base", F.coalesce("new", F.array().cast(f"array<{SPAN}>"))))).alias("spans"))


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: numbers of base spans by kind, their digest, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return with_spans(docs, ["doc_id"]).select(
        F.col("doc.doc_id").cast("long").alias("doc_id"), *(count(k) for k in range(4)),
        F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def redacted_text(text: Column, spans: Column) -> Column:
    """A text with its spans replaced by their kind in brackets; overlapping spans by the first's."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(done, s):
        gap = F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(done["out"], gap, F.element_at(kinds, s["kind"] + 1)).alias("out"))
        inside = F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))
        return F.when(s["start"] >= done["at"], fresh).otherwise(inside)

    rest = lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state, add, rest))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with all spans redacted; same columns. Texts without a digit or an at sign
    can't hold a span, so only the others are written and joined with their spans."""
    may = F.coalesce(F.rlike("text", F.lit("[0-9@]")), F.lit(False))
    own = {c: F.col("doc").getField(c) for c in docs.columns}
    own["text"] = redacted_text(own["text"], F.col("spans"))
    changed = with_spans(docs.where(may), docs.columns).select(*(value.alias(c) for c, value in own.items()))
    return changed.unionByName(docs.where(~may))
