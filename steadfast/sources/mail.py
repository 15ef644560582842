"""Raw mail: folders, mailboxes and MIME parsing.

Parsing one message is a small Python helper (standard library only) applied to Arrow
batches; reading, splitting, numbering and everything after parsing is Spark.
"""

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.functions.html import read_page
from steadfast.schemas import PARSED_MESSAGE

# Workers get these helpers with the task, whether or not they can import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TAG_PATTERN = L.ANY_TAG
#: Messages that a worker holds in parsed form at once.
MESSAGES = 64


# ------------------------------------------------------------------------- reading
def read_directory(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(original_id, raw) for every file below a folder; dotfiles are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~F.startswith(name, F.lit("."))).select(
        F.concat(F.lit(f"{prefix}:"), F.regexp_replace("path", "^[a-z]+:/+", "/")).alias("original_id"),
        F.col("content").alias("raw"),
    )


def with_file_position(df: DataFrame, name: str = "index", preamble: Column | None = None) -> DataFrame:
    """Zero-based position of each row in its file. Rows are numbered inside one split of
    the file; the counts of earlier splits are added, so a huge file is never one task.
    Where `preamble` holds for a file's first row, that row is dropped and not counted."""
    tagged = df.withColumns({
        "_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
        "_seq": F.monotonically_increasing_id(),
    })
    skip = F.lit(0) if preamble is None else F.when(preamble, 1).otherwise(0)
    splits = tagged.groupBy("_file", "_block").agg(
        F.count("*").alias("_n"), F.min_by(skip, F.col("_seq")).alias("_skip")
    )
    by_block = Window.partitionBy("_file").orderBy("_block")
    earlier = F.sum("_n").over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select(
        "_file", "_block",
        (F.coalesce(earlier, F.lit(0)) - F.first("_skip").over(by_block)).alias("_before"),
    )
    in_split = Window.partitionBy("_file", "_block").orderBy("_seq")
    numbered = tagged.withColumn("_local", F.row_number().over(in_split))
    position = F.col("_before") + F.col("_local") - 1
    return numbered.join(offsets, ["_file", "_block"]).select(
        *df.columns, F.col("_file"), position.alias(name)
    ).where(F.col(name) >= 0)


def read_mailboxes(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(original_id, raw) per message, id prefix:file:index. Splits at lines that begin
    with 'From '; text before the first such line is not a message."""
    chunks = spark.read.option("lineSep", "\nFrom ").text(path)
    kept = with_file_position(chunks, preamble=~F.startswith("value", F.lit("From ")))
    name = F.element_at(F.split("_file", "/"), -1)
    cut = F.instr("value", "\n")
    body = F.when(cut > 0, F.substr("value", cut + 1)).otherwise(F.lit(""))
    return kept.select(
        F.concat_ws(":", F.lit(prefix), name, F.col("index").cast("string")).alias("original_id"),
        body.cast("binary").alias("raw"),
    )


# ------------------------------------------------------------------------- parsing
def decoded(part) -> str:
    """A leaf's text: transfer encoding undone, then its declared charset, or UTF-8 where that
    is missing, unknown or wrong; bytes that fit neither become replacement characters."""
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8")
    except (LookupError, ValueError):
        return data.decode("utf-8", "replace")


def leaves(message):
    """(is HTML, text) of the text leaves. A message that is a single leaf counts as plain
    text unless it says that it is HTML."""
    single = not message.is_multipart()
    for part in message.walk():
        kind = part.get_content_type()
        if kind == "text/html" or kind == "text/plain" or single:
            yield kind == "text/html", decoded(part)


def subject_of(message) -> str:
    try:
        return str(message["subject"] or "")
    except Exception:  # the header parser gives up on some broken encodings
        return ""


def parse_message(raw: bytes) -> tuple[str, str, bool]:
    """(subject, body, had_html). Plain leaves win over HTML leaves; markup inside plain ones
    is cleaned too, and counts as HTML."""
    import email
    import re
    from email import policy

    message = email.message_from_bytes(raw or b"", policy=policy.default)
    found = list(leaves(message))
    had_html = any(html for html, _ in found)
    wants_html = all(html for html, _ in found)
    texts = [text for html, text in found if html == wants_html and text]
    if wants_html:
        texts = (read_page(text)[0] for text in texts)
    body = "\n".join(texts)
    if not wants_html and re.search(TAG_PATTERN, body):
        had_html, body = True, read_page(body)[0]
    return *(" ".join(text.split()) for text in (subject_of(message), body)), had_html


def parse_messages(raw: DataFrame) -> DataFrame:
    """(original_id, subject, body, had_html) plus any further columns of the input."""
    extra = [c for c in raw.columns if c not in ("original_id", "raw")]
    schema = PARSED_MESSAGE.__class__([*PARSED_MESSAGE.fields, *[raw.schema[c] for c in extra]])

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, MESSAGES):
                some = batch.slice(a, MESSAGES)
                fields = [parse_message(r.as_py() or b"") for r in some.column("raw")]
                # A stray surrogate cannot leave Python as UTF-8.
                clean = [[s.encode("utf-8", "replace").decode("utf-8") for s in f[:2]] + [f[2]] for f in fields]
                made = [pa.array([c[i] for c in clean], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))]
                kept = [some.column(name) for name in extra]
                yield pa.record_batch([some.column("original_id"), *made, *kept], names=schema.names)

    return raw.select("original_id", "raw", *extra).mapInArrow(parse, schema)
