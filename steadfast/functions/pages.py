"""HTML to text and link destinations by built-in expressions alone.

One pattern cuts a page into tokens: comments, scripts and styles with all they hold, tags (a sign
within a quoted value doesn't end one), declarations, text. A state folded over the tags of links,
image maps and forms keeps those that are open, and notes behind which token each destination goes.
Text and destinations are then sorted into place and joined, so a page costs about its length; only
the tags that carry destinations are folded. Entities are decoded by number or by name.

Null is an empty page. A `<` that begins no tag is text, as is a tag that never ends. `functions.html`
reads the same pages with a parser, in Python.
"""

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.functions.text import collapse_spaces, let, or_empty, strip

# Every repeated group is possessive: Java matches these in a loop, so that long tags and pages
# can't exhaust its stack.
ATTRIBUTE = r"""[^\s/>][^\s/=>]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+"""
ATTRIBUTES = rf"(?:[\s/]*+{ATTRIBUTE})*+"
VALUE = r"""(?s)\A[^=]*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(.*+))\z"""
LINK_TAGS = "|".join(tag for tag, _ in L.LINK_ATTRIBUTES)
UNSEEN = "|".join(rf"<(?i:{tag})(?=[\s/>]){ATTRIBUTES}\s*+>(?s:.*?)(?:</(?i:{tag})\s*+>|\z)" for tag in ("script", "style"))
TOKEN = (rf"<!--(?s:.*?)(?:-->|\z)|{UNSEEN}"
         rf"|(</?+(?i:{LINK_TAGS})(?=[\s/>]){ATTRIBUTES}[\s/]*+>)"  # group 1: a tag with a destination, or its end
         rf"|<[A-Za-z][^\s/>]*+{ATTRIBUTES}[\s/]*+>|<[!?/][^>]*+>"
         r"|([^<]++|<[A-Za-z!?/][^<]*+|<)")  # group 2: text
SELF_CLOSED = rf"\A<[A-Za-z]++{ATTRIBUTES}\s*+/[\s/]*+>\z"
LAST = 2**31 - 1

COMMON = ("nbsp;", "amp;", "lt;", "gt;", "quot;", "apos;", "copy;")
NAMES = json.dumps({name: html5[name] for name in (*COMMON, *html5)})  # common ones first: maps are searched in order
UNCLOSED = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True))
ENTITY = r"&(?:#[0-9]++;?+|#[xX][0-9A-Fa-f]++;?+|[A-Za-z][A-Za-z0-9]{1,31}+;?+)"
REPLACEMENT = "�"
#: What pages mean by the numbers of control characters: those of the Windows code page, where it has one.
CONTROLS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0: REPLACEMENT}


def _character(digits: Column, base: int) -> Column:
    """The character of a number's digits; none for numbers that no text may hold."""
    def of(n):
        hole = (n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF)
                | (n.bitwiseAND(0xFFFF) >= 0xFFFE))
        known = F.create_map(*(F.lit(x) for pair in CONTROLS.items() for x in pair))
        return (F.when(n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), REPLACEMENT)
                .when((n == 0) | n.between(0x80, 0x9F), F.element_at(known, n.cast("int")))
                .when(hole, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))

    own = F.ltrim(digits, F.lit("0"))
    number = F.when(own == "", F.lit(0).cast("long")).when(F.length(own) <= 7, F.conv(own, base, 10).cast("long"))
    return let(number, of)


def _decoded(entity: Column, names: Column) -> Column:
    """An entity's text. A name without semicolon may be followed by letters; unknown ones stay."""
    name = F.substr(entity, F.lit(2))
    begun = F.regexp_extract(name, rf"\A(?:{UNCLOSED})", 0)
    named = F.coalesce(F.element_at(names, name), F.when(
        begun != "", F.concat(F.element_at(names, begun), F.substr(name, F.length(begun) + 1))), entity)
    return (F.when(F.rlike(entity, F.lit("\\A&#[xX]")), _character(F.regexp_extract(entity, "[xX]([0-9A-Fa-f]+)", 1), 16))
            .when(F.startswith(entity, F.lit("&#")), _character(F.regexp_extract(entity, "([0-9]+)", 1), 10))
            .otherwise(named))


def decode_entities(text: Column) -> Column:
    """Entities by number and by name as the characters they stand for."""
    def joined(found, names):
        pieces = F.transform(F.split(text, ENTITY, -1), lambda gap, i: F.concat(
            gap, F.coalesce(_decoded(F.get(found, i), names), F.lit(""))))
        return F.array_join(pieces, "")

    names = F.from_json(F.lit(NAMES), "map<string,string>")
    whole = let(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), lambda found: let(names, lambda names: joined(found, names)))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def _destination(tag: Column, name: Column) -> Column:
    """The first attribute of its kind; empty where it has none, or one that leads nowhere."""
    wanted = F.create_map(*(F.lit(x) for pair in L.LINK_ATTRIBUTES for x in pair))
    attributes = F.regexp_extract_all(F.regexp_replace(tag, r"\A<[A-Za-z]++", ""), F.lit(ATTRIBUTE), F.lit(0))
    first = F.get(F.filter(attributes, lambda a: F.lower(F.regexp_extract(a, r"\A[^\s/=>]++", 0)) == F.element_at(wanted, name)), F.lit(0))
    value = let(first, lambda a: F.concat(*(F.regexp_extract(a, VALUE, i) for i in (1, 2, 3))))

    def kept(target):
        skipped = [F.startswith(F.lower(target), F.lit(start)) for start in L.SKIPPED_LINKS]
        return F.when(F.array_contains(F.array(*skipped), True), "").otherwise(target)

    return F.coalesce(let(strip(decode_entities(value)), kept), F.lit(""))


def _link_tags(html: Column) -> Column:
    """Tags that carry destinations, and their ends: place among all tokens, name, how, target."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(1)), lambda tag, i: F.struct(i.alias("at"), tag.alias("tag")))

    def parsed(t):
        ends = F.startswith(t["tag"], F.lit("</"))
        name = F.lower(F.regexp_extract(t["tag"], r"\A</?([A-Za-z]+)", 1))
        return F.struct(t["at"].alias("at"), name.alias("name"), ends.alias("ends"),
                        F.rlike(t["tag"], F.lit(SELF_CLOSED)).alias("closed"),
                        F.when(ends, "").otherwise(let(name, lambda name: _destination(t["tag"], name))).alias("target"))

    return F.transform(F.filter(tags, lambda t: t["tag"] != ""), parsed)


def _placed(tags: Column) -> Column:
    """Each destination and its place: that of the token that ends its link or form; of a tag that
    closes several, innermost first; of tags left open, behind everything."""
    none = F.array().cast("array<struct<at:int,sub:int,value:string>>")
    start = F.struct(F.array().cast("array<struct<name:string,target:string>>").alias("open"), none.alias("placed"))

    def spots(at, values):
        return F.transform(values, lambda v, k: F.struct(at.alias("at"), k.alias("sub"), v["target"].alias("value")))

    def step(state, tag):
        own = F.array(F.struct(tag["name"].alias("name"), tag["target"].alias("target")))
        size = F.size(state["open"])
        depth = F.array_position(F.transform(F.reverse(state["open"]), lambda o: o["name"]), tag["name"]).cast("int")

        def ended(depth):
            gone = F.reverse(F.slice(state["open"], size - depth + 1, depth))
            return F.struct(F.slice(state["open"], F.lit(1), size - depth).alias("open"),
                            F.concat(state["placed"], spots(tag["at"], gone)).alias("placed"))

        at_once = F.struct(state["open"].alias("open"), F.concat(state["placed"], spots(tag["at"], own)).alias("placed"))
        opened = F.struct(F.concat(state["open"], own).alias("open"), state["placed"].alias("placed"))
        return (F.when(tag["ends"], let(depth, lambda d: F.when(d > 0, ended(d)).otherwise(state)))
                .when((tag["name"] == "area") | tag["closed"], at_once).otherwise(opened))

    return F.aggregate(tags, start, step, lambda s: F.concat(s["placed"], spots(F.lit(LAST), F.reverse(s["open"]))))


def visible_text(html: Column) -> Column:
    """Visible text with link destinations placed after their anchor text."""
    def joined(page):
        texts = F.transform(F.regexp_extract_all(page, F.lit(TOKEN), F.lit(2)), lambda text, i: F.struct(
            i.alias("at"), F.lit(0).alias("sub"), decode_entities(text).alias("value")))
        pieces = F.sort_array(F.filter(F.concat(texts, _placed(_link_tags(page))), lambda p: p["value"] != ""))
        return F.array_join(F.transform(pieces, lambda p: p["value"]), " ")

    return collapse_spaces(let(or_empty(html), joined))


def destinations(html: Column) -> Column:
    """Destinations of links, image-map areas and forms, in that order."""
    def ordered(tags):
        def of(name):
            return F.filter(tags, lambda t: (t["name"] == name) & (t["target"] != ""))

        return F.transform(F.concat(*(of(name) for name, _ in L.LINK_ATTRIBUTES)), lambda t: t["target"])

    return let(_link_tags(or_empty(html)), ordered)
