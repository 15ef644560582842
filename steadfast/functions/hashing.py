"""Portable hashes. Everything random in this package is a function of a seed and a
row's own identity, so results do not depend on partitioning, ordering or retries."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = (1 << 31) - 1


def _joined(seed, parts) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])


def digest(seed, *parts: Column) -> Column:
    """Hex md5 of `seed|part|part...`: the ordering key of every seeded sample."""
    return F.md5(_joined(seed, parts))


def hash32(seed, *parts: Column) -> Column:
    """First eight hex digits of the digest, as a whole number below 2^32."""
    return F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("long")


def uniform(seed, *parts: Column) -> Column:
    return hash32(seed, *parts) / F.lit(4294967296.0)


def row_hashes(seed, *parts: Column) -> tuple[Column, Column]:
    """Two independent residues per row, inputs of `replicate_uniform`."""
    text = digest(seed, *parts)

    def piece(start):
        return F.conv(F.substring(text, start, 8), 16, 10).cast("long") % F.lit(MODULUS)

    return piece(1), piece(9)


def replicate_uniform(h1: Column, h2: Column, r1: Column, r2: Column, r3: Column) -> Column:
    """Uniform draw for (row, replicate): a linear form in the row residues whose
    coefficients belong to the replicate. Draws of different rows are pairwise
    independent; one multiply-add per draw, no digest per draw, no overflow."""
    return ((r1 * h1 + r2 * h2 + r3) % F.lit(MODULUS)) / F.lit(float(MODULUS))


def replicate_coefficients(seed, replicate: Column) -> tuple[Column, Column, Column]:
    text = digest(seed, F.lit("replicate"), replicate)

    def piece(start):
        return F.conv(F.substring(text, start, 8), 16, 10).cast("long") % F.lit(MODULUS)

    return piece(1), piece(9), piece(17)


def dedup_key(subject: Column, body: Column) -> Column:
    return F.sha1(F.concat(F.lower(subject), F.lit("\n"), F.lower(body)))


def text_sha(text: Column) -> Column:
    return F.sha2(text, 256)


def prompt_hash(*parts: Column) -> Column:
    """sha256 over parts, each followed by a NUL byte."""
    pieces = []
    for part in parts:
        pieces += [part.cast("string"), F.lit("\0")]
    return F.sha2(F.concat(*pieces), 256)


def cache_key(original_id: Column, severity: Column) -> Column:
    return F.format_string("%s|%.2f", original_id, severity.cast("double"))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, "[^a-zA-Z0-9]+", "-"), F.lit("-"))
