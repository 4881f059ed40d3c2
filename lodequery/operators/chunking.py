"""Markdown chunkers: by heading, size, paragraph, code block, and heading then size.

Each gives one row a chunk: the document's other columns, ``index`` and ``total``
within the document, ``content``, ``heading``, ``level``, ``type`` and
``language``; a document's column of one of these names gives way. Repeated documents
are cut each for itself. Cutting is array work within a row; only cutting by size, where each
cut depends on the one before, is a vectorised Python function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.errors import InvalidConfig
from lodequery.functions.batches import slices


@dataclass(frozen=True)
class ChunkConfig:
    max_size: int = 2000
    min_size: int = 100
    overlap: int = 50
    id_prefix: str = "chunk"


PIECE_CHARS = 64  # what a list of texts takes besides each text
OWN_COLUMNS = frozenset("chunk_id index total content heading level type language start end".split())


def _rows(df: DataFrame, chunks: Column, text: str, prefix: str) -> DataFrame:
    """``df`` without its text, exploded to one row for each struct of ``chunks``."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != text and c not in OWN_COLUMNS]
    rows = df.select(*keep, chunks.alias("_c")).withColumn("total", F.size("_c"))
    # The outer form, as the optimizer puts a filter before the other one that computes the chunks once more.
    rows = rows.select(*keep, "total", F.posexplode_outer("_c").alias("index", "_x")).where(F.col("_x").isNotNull())
    return rows.withColumn("chunk_id", F.concat(F.lit(f"{prefix}-"), F.col("index"))).select("*", "_x.*").drop("_x")


def _chunk(content: Column, kind: str, heading: Column | None = None, level: Column | None = None, language: Column | None = None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.struct(
        content.alias("content"),
        (none("string") if heading is None else heading).alias("heading"),
        (none("int") if level is None else level.cast("int")).alias("level"),
        F.lit(kind).alias("type"),
        (none("string") if language is None else language).alias("language"),
    )


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _sections(text: Column, max_level: int) -> Column:
    """Structs of the sections that begin at headings up to a level; blank ones are left out."""
    heading = rf"^(#{{1,{max_level}}})[^\S\n]+([^\n]+)"

    def section(x: Column) -> Column:
        title = F.regexp_extract(x, heading, 2)
        there = title != ""
        return _chunk(x, "heading", F.when(there, F.trim(title)), F.when(there, F.length(F.regexp_extract(x, heading, 1))))

    return F.transform(_trimmed(F.split(text, rf"(?m)^(?=#{{1,{max_level}}}[^\S\n]+[^\n])")), section)


def by_heading(df: DataFrame, max_level: int = 2, text: str = "text", prefix: str = "chunk") -> DataFrame:
    """Sections from a heading of at most ``max_level`` to the next; what comes before the first is one too."""
    if not 1 <= max_level <= 6:
        raise InvalidConfig("a heading level is from 1 to 6")
    return _rows(df, _sections(F.col(text), max_level), text, prefix)


def by_paragraph(df: DataFrame, least: int = 1, most: int = 5, text: str = "text", prefix: str = "chunk") -> DataFrame:
    """Groups of ``most`` paragraphs; a last group of fewer than ``least`` joins the one before."""
    if most < 1:
        raise InvalidConfig("a chunk has at least one paragraph")

    def grouped(p: Column) -> Column:
        n = F.size(p)
        groups = F.greatest(F.lit(1), F.ceil(n / most).cast("int"))
        tail = n - (groups - 1) * most
        kept = F.when((groups > 1) & (tail < least), groups - 1).otherwise(groups)
        return F.transform(
            F.sequence(F.lit(0), kept - 1),
            lambda g: F.array_join(F.slice(p, g * most + 1, F.when(g == kept - 1, F.greatest(n - g * most, F.lit(0))).otherwise(F.lit(most))), "\n\n"),
        )

    parts = F.get(F.transform(F.array(_trimmed(F.split(F.col(text), "\n\n"))), grouped), F.lit(0))
    return _rows(df, F.transform(F.filter(parts, lambda x: x != ""), lambda x: _chunk(x, "paragraph")), text, prefix)


def by_code_block(df: DataFrame, text: str = "text", prefix: str = "chunk") -> DataFrame:
    """Prose and fenced code in turn; code that is not closed is the last chunk."""

    def part(x: Column, i: Column) -> Column:
        code = i % 2 == 1
        language = F.trim(F.regexp_extract(x, r"\A([^\n]*)", 1))
        body = F.when(code, F.regexp_replace(x, r"\A[^\n]*\n?", "")).otherwise(x)
        return F.struct(
            F.regexp_replace(body, r"^\s+|\s+$", "").alias("content"),
            F.lit(None).cast("string").alias("heading"),
            F.lit(None).cast("int").alias("level"),
            F.when(code, "code").otherwise("text").alias("type"),
            F.when(code & (language != ""), language).alias("language"),
        )

    parts = F.filter(F.transform(F.split(F.col(text), r"(?m)^[^\S\n]*```", -1), part), lambda x: x["content"] != "")
    return _rows(df, parts, text, prefix)


def cut_by_size(text: str, target: int, overlap: int) -> list[tuple[str, int, int]]:
    """Pieces of at most ``target`` UTF-8 bytes with their byte offsets.

    A piece ends after the last blank line within reach, else after the last sentence, else where the
    bytes run out, and never within a character; the next begins ``overlap`` bytes before.
    """
    raw, out, start = text.encode(), [], 0
    while start < len(raw):
        end = min(start + target, len(raw))
        if end < len(raw):
            while end > start and raw[end] & 0xC0 == 0x80:
                end -= 1
            if end == start:  # one character is longer than the target
                end = start + 1
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end += 1
            else:
                for mark in (b"\n\n", b". "):
                    at = raw.rfind(mark, start, end)
                    if at > start:
                        end = at + len(mark)
                        break
        out.append((raw[start:end].decode(), start, end))
        if end >= len(raw):
            break
        back = end - overlap if overlap and end - overlap > start else end
        while back < end and raw[back] & 0xC0 == 0x80:
            back += 1
        start = back
    return out


def _sized(text: Column, target: int, overlap: int) -> Column:
    if target < 1 or overlap < 0:
        raise InvalidConfig("a chunk has at least one byte and no negative overlap")

    @F.pandas_udf("array<struct<content:string,start:int,end:int>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in slices(batches):
            rows = [[{"content": c, "start": a, "end": b} for c, a, b in cut_by_size(t or "", target, overlap)] for t in texts]
            yield pd.Series(rows, index=texts.index, dtype=object)

    return cut(text)


def by_size(df: DataFrame, target: int = 2000, overlap: int = 50, text: str = "text", prefix: str = "chunk") -> DataFrame:
    """Pieces of at most ``target`` bytes; see :func:`cut_by_size`. Also has ``start`` and ``end``."""
    return _rows(df, _sized(F.col(text), target, overlap), text, prefix)


def _cut_sections(contents: Column, max_size: int, overlap: int) -> Column:
    """The pieces of each section: those of more than ``max_size`` bytes are cut by size."""
    if max_size < 1 or overlap < 0:
        raise InvalidConfig("a chunk has at least one byte and no negative overlap")

    @F.pandas_udf("array<array<string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = lambda t: [t] if len(t.encode()) <= max_size else [c for c, _, _ in cut_by_size(t, max_size, overlap)]
        for sections in slices(batches, lambda own: sum(map(len, own)) + PIECE_CHARS * len(own)):
            yield pd.Series([[pieces(t) for t in own] if own is not None else [] for own in sections], index=sections.index, dtype=object)

    return cut(contents)


def hybrid(df: DataFrame, max_level: int = 2, max_size: int = 2000, overlap: int = 50, text: str = "text", prefix: str = "chunk") -> DataFrame:
    """Sections, of which those of more than ``max_size`` bytes are cut by size and keep their heading."""
    if not 1 <= max_level <= 6:
        raise InvalidConfig("a heading level is from 1 to 6")
    cut = df.withColumn("_sections", _sections(F.col(f"`{text}`"), max_level))
    cut = cut.withColumn("_pieces", _cut_sections(F.col("_sections.content"), max_size, overlap))
    chunks = F.zip_with("_sections", "_pieces", lambda s, own: F.transform(own, lambda c: s.withField("content", c)))
    return _rows(cut, F.flatten(chunks), text, prefix).drop("_sections", "_pieces")


def stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, their bytes and the mean, rounded down."""
    n, size = F.count("*"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long")
    return chunks.agg(n.alias("total_chunks"), size.alias("total_size")).withColumn(
        "average_size", F.when(F.col("total_chunks") > 0, F.floor(F.col("total_size") / F.col("total_chunks"))).otherwise(F.lit(0))
    )
