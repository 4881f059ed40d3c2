"""Text expressions: search tokens, snippets and word counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased alphanumeric runs of more than one byte; null texts have none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.filter(parts, lambda x: F.octet_length(x) > 1)


def query_tokens(query: str) -> list[str]:
    """The tokens of a query string, by the same rules."""
    out, run = [], ""
    for c in query.lower() + " ":
        if c.isalnum():
            run += c
        else:
            if len(run.encode()) > 1:
                out.append(run)
            run = ""
    return out


def joined(*cols: str) -> Column:
    """Text of several columns in order, with a space between; nulls are left out."""
    return F.concat_ws(" ", *cols)


def snippet(text: Column, chars: int = 200) -> Column:
    """The first ``chars`` characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
