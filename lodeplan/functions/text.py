"""Tokens, excerpts and ids of searchable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What a token is: a run of letters a-z, digits and underscores of the lower-case text.
TOKEN = "[a-z0-9_]+"


def tokens(text: Column) -> Column:
    """The tokens of a text in order; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def excerpt(text: Column, length: int = 600) -> Column:
    return F.substring(text, 1, length)


def short_id(*parts: Column) -> Column:
    """Ten hexadecimal digits that stand for the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 10)


def prefixes(id: Column) -> Column:
    """A dotted id and all ids above it: ``a.b.c`` gives a, a.b and a.b.c."""
    parts = F.split(id, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
