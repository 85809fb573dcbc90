"""Key, hash and text canonicalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_hash(*columns: Column) -> Column:
    """16-byte hash of a row; null, the empty text and every other value stay apart.

    Each value is written as its length and its text, null as ``-``, so that no two different
    rows share the hashed text.
    """
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-;")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text, F.lit(";"))))
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def digest_text(column: Column) -> Column:
    """A delivered content hash in canonical form: lower case, without a leading ``sha256:``."""
    return F.regexp_replace(F.lower(column), "^sha256:", "")


def folded(column: Column) -> Column:
    """Free text for comparison: without outer white space, in lower case; null stays null."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def micros(column: Column) -> Column:
    """Epoch microseconds of a timestamp."""
    return F.unix_micros(column)


def salted(n: int, *columns: Column) -> Column:
    """A stable number in [0, n) from the given columns; the same rows get it on every retry."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
