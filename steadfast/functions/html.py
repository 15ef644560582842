"""HTML to text and link destinations.

Attributes, entities and tags left open need a parser, not patterns, so pages go through the
standard library's parser in Arrow batches. Columns and mail parts share the one reader.
"""

import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.functions.text import collapse_spaces, or_empty

# Workers get the reader with the task, whether or not they can import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINKS = dict(L.LINK_ATTRIBUTES)
SKIPPED = tuple(L.SKIPPED_LINKS)
UNSEEN = ("script", "style")


class Reader(HTMLParser):
    """Collects visible text in order. A destination follows the text of its link or form; one
    whose tag is never closed comes last."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces, self.links, self.open, self.unseen = [], [], [], 0

    def handle_starttag(self, tag, attrs):
        self.unseen += tag in UNSEEN
        if tag not in LINKS:
            return
        target = next((value or "" for name, value in attrs if name == LINKS[tag]), "").strip()
        if target.lower().startswith(SKIPPED):
            target = ""
        if target:
            self.links.append((tag, target))
        if tag == "area":
            self.pieces.append(target)
        else:
            self.open.append((tag, target))

    def handle_endtag(self, tag):
        self.unseen -= tag in UNSEEN and self.unseen > 0
        if tag in (name for name, _ in self.open):
            name = None
            while name != tag:
                name, target = self.open.pop()
                self.pieces.append(target)

    def handle_data(self, data):
        if not self.unseen:
            self.pieces.append(data)


def read_page(html: str) -> tuple[str, list[str]]:
    """(visible text with destinations, destinations of links, then areas, then forms)."""
    reader = Reader()
    reader.feed(html)
    reader.close()
    ends = [target for _, target in reversed(reader.open)]
    links = [target for tag in LINKS for name, target in reader.links if name == tag]
    return " ".join(filter(None, reader.pieces + ends)), links


def link_targets(html: Column) -> Column:
    """Destinations of links, image-map areas and forms, in that order."""
    return F.pandas_udf(lambda pages: pd.Series([read_page(p)[1] for p in pages], dtype=object), "array<string>")(or_empty(html))


def to_text(html: Column) -> Column:
    """Visible text with link destinations placed after their anchor text."""
    return collapse_spaces(F.pandas_udf(lambda pages: pd.Series([read_page(p)[0] for p in pages], dtype=object), "string")(or_empty(html)))
