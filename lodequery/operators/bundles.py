"""Knowledge bundles: markdown files with a front matter, cut into searchable chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions.text import snippet

from . import bm25, chunking

FULLTEXT = ("content", "title", "description", "heading", "tags_text")
_KNOWN = ("type", "title", "description", "resource", "tags", "timestamp")


def read_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """``concept`` (path below the folder, without suffix) and ``text`` of every markdown file but index.md and log.md."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).withColumn("_path", F.col("_metadata.file_path"))
    name = F.lower(F.regexp_extract("_path", r"([^/]+)$", 1))
    files = files.where(name.endswith(".md") & ~name.isin("index.md", "log.md"))
    root = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    concept = F.regexp_replace(F.regexp_replace("_path", r"(?i)\.md$", ""), "^.*" + re.escape(root) + "/", "")
    return files.select(concept.alias("concept"), F.col("value").alias("text"))


def parse_front_matter(raw: str) -> dict[str, list[str]]:
    """Scalars and lists of strings of a small YAML subset; other nesting is left out. A scalar is a list of one with a mark."""
    out: dict[str, list[str]] = {}
    key = None
    for line in raw.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item = re.match(r"\s*-\s+(.*)$", line)
        pair = re.match(r"([A-Za-z0-9_.-]+)\s*:\s*(.*)$", line)
        if pair:
            key, value = pair[1], _bare(pair[2])
            if value.startswith("[") and value.endswith("]"):
                out[key], key = ["l", *[_unquoted(x) for x in value[1:-1].split(",") if x.strip()]], None
            elif value:
                out[key], key = ["s", _unquoted(value)], None
        elif item and key is not None and not re.match(r"[A-Za-z0-9_.-]+\s*:\s", item[1]):
            out.setdefault(key, ["l"]).append(_unquoted(_bare(item[1])))
        elif not line[0].isspace():
            key = None
    return out


def _bare(value: str) -> str:
    value = value.strip()
    if value[:1] in ("'", '"') and value.find(value[0], 1) > 0:
        return value[: value.find(value[0], 1) + 1]
    return re.sub(r"\s+#.*$", "", value)


def _unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def concepts(files: DataFrame, concept: str = "concept", text: str = "text") -> DataFrame:
    """Each file with its front matter's fields, its ``body`` and ``skipped``, the reason if it can't be taken.

    ``extra`` has other keys as ``x_<key>``; lists are joined by commas.
    """
    fence = r"(?s)\A---[^\S\n]*\n(.*?)(?:\A|(?<=\n))(?:---|\.\.\.)[^\S\n]*(?:\n(.*))?\z"

    @F.pandas_udf("map<string,array<string>>")
    def parsed(raw: pd.Series) -> pd.Series:
        return pd.Series([parse_front_matter(x) if x is not None else None for x in raw], index=raw.index, dtype=object)

    whole = F.col(text).rlike(fence)
    opened = F.col(text).rlike(r"\A---[^\S\n]*(?:\n|\z)")
    rows = files.withColumn("_m", parsed(F.when(whole, F.regexp_extract(text, fence, 1)))).withColumn("body", F.when(whole, F.regexp_extract(text, fence, 2)))
    scalar = lambda k: F.when(F.get(F.col("_m")[k], F.lit(0)) == "s", F.get(F.col("_m")[k], F.lit(1)))
    listed = lambda v: F.array_join(F.slice(v, 2, 1 << 30), ",")
    extra = F.transform_keys(F.map_filter("_m", lambda k, _: ~k.isin(*_KNOWN)), lambda k, _: F.concat(F.lit("x_"), k))
    return rows.select(
        concept,
        "body",
        scalar("type").alias("concept_type"),
        *[scalar(k).alias(k) for k in ("title", "description", "resource", "timestamp")],
        listed(F.col("_m")["tags"]).alias("tags_text"),
        F.transform_values(extra, lambda _, v: listed(v)).alias("extra"),
        F.when(~opened, "no frontmatter")
        .when(~whole, "broken frontmatter (no closing delimiter)")
        .when(scalar("type").isNull(), "missing 'type' field")
        .alias("skipped"),
    )


def ingest(files: DataFrame, max_size: int = 2000, overlap: int = 50, concept: str = "concept", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Chunks of the files that can be taken, with ids ``concept#n``, and the others with the reason."""
    rows = concepts(files, concept, text)
    good = rows.where(F.col("skipped").isNull()).drop("skipped").withColumnRenamed("title", "doc_title")
    chunks = chunking.by_size(good.withColumnRenamed("body", "text"), max_size, overlap)
    chunks = chunks.withColumn("id", F.concat(F.col(concept), F.lit("#"), F.col("index"))).withColumnRenamed("doc_title", "title")
    return chunks.drop("chunk_id"), rows.where(F.col("skipped").isNotNull()).select(concept, "skipped")


def search(chunks: DataFrame, query: str, k: int, concept_type: str | None = None, concept: str = "concept") -> DataFrame:
    """The best chunks by keyword, with a snippet of their content."""
    cols = [c for c in FULLTEXT if c in chunks.columns]
    indexed = bm25.index(chunks, F.concat_ws(" ", *cols), "id")
    hits = bm25.scored(indexed, query).select("id", "bm25")
    rows = chunks if concept_type is None else chunks.where(F.col("concept_type") == concept_type)
    out = rows.join(hits, "id").orderBy(F.desc("bm25"), "id").limit(k)
    return out.select("id", concept, "concept_type", "title", snippet(F.col("content")).alias("snippet"), (-F.col("bm25")).alias("score"))


def remove_concept(chunks: DataFrame, name: str, concept: str = "concept") -> DataFrame:
    return chunks.where(F.col(concept) != name)


def upsert(chunks: DataFrame, new: DataFrame, concept: str = "concept") -> DataFrame:
    """The new chunks in place of all chunks of their concepts."""
    return chunks.join(new.select(concept).distinct(), concept, "left_anti").unionByName(new)
