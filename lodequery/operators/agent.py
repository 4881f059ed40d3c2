"""Agent memory: typed records, their recalls, statistics and retention."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodequery.functions import filters as fl
from lodequery.functions.batches import slices

from . import vectors
from .hybrid import Documents, Search

KINDS = ("episode", "code", "api", "error_solution")
# Columns whose texts make up what a record of a kind is searched by.
SEARCHED = {
    "episode": ("task", "code", "learnings"),
    "code": ("description", "code", "use_case"),
    "api": ("library", "function", "description", "example"),
    "error_solution": ("error_message", "root_cause", "solution"),
}
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "golang": "go", "c++": "cpp", "cs": "csharp", "c#": "csharp", "rb": "ruby"}
# How a kind's ids begin, how lists are joined, and how many turns and errors a context keeps.
PREFIXES = {"episode": "episode", "code": "code", "api": "api", "error_solution": "error"}
JOINED = {"learnings": "\n", "errors": "\n", "tags": ",", "dependencies": ","}
TURNS, ERRORS = 20, 10
EMBEDDED_BYTES = 1 << 16  # of a text, which are added up at once
CONTEXT_ID, INTERNAL = "__working_context__", "__internal__"


def parse_language(name: str) -> str:
    """The canonical name of a programming language or alias; unknown names stay."""
    low = name.lower()
    return LANGUAGES.get(low, low)


def records(rows: DataFrame, kind: str, embed=None) -> DataFrame:
    """Rows of a kind with ``type`` and, if a function from a text column to vectors is given, their ``vector``."""
    cols = [c for c in SEARCHED[kind] if c in rows.columns]
    out = rows.withColumn("type", F.lit(kind))
    return out if embed is None else out.withColumn("vector", embed(F.concat_ws(" ", *cols)))


def learned(rows: DataFrame, kind: str, key: str, now: int, project: str | None = None, embed=None) -> DataFrame:
    """Rows of a kind as records: ``id`` by the kind and ``key``, ``type``, ``description``, the ``timestamp`` of learning.

    Lists become texts and are left null where empty. What describes an episode is its task, and an error its message.
    Records without a project of their own get the current ``project``; vectors follow from the searched texts.
    """
    lists = {c: s for c, s in JOINED.items() if c in rows.columns and dict(rows.dtypes)[c].startswith("array")}
    out = rows.withColumns({c: F.when(F.size(c) > 0, F.array_join(c, s)) for c, s in lists.items()})
    described = {"episode": "task", "error_solution": "error_message"}.get(kind)
    if described:
        out = out.withColumn("description", F.col(described))
    if project is not None:
        out = out.withColumn("project", F.coalesce("project", F.lit(project)) if "project" in rows.columns else F.lit(project))
    out = out.withColumn("id", F.concat(F.lit(f"{PREFIXES[kind]}-"), F.col(key).cast("string")))
    return records(out.withColumn("timestamp", F.lit(now).cast("long")), kind, embed)


def byte_embedding(text: Column, dimensions: int = 384) -> Column:
    """A deterministic embedding for tests: bytes over 255 added up by place, normalised."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in slices(batches):
            out = [_embedded((t or "").encode(), dimensions) for t in texts]
            yield pd.Series(out, index=texts.index, dtype=object)

    return embed(text)


def _embedded(raw: bytes, dimensions: int) -> np.ndarray:
    """The embedding of a text's bytes, which are added up in blocks of whole rounds of places."""
    v, step = np.zeros(dimensions), max(1, EMBEDDED_BYTES // dimensions) * dimensions
    for i in range(0, len(raw), step):
        b = np.frombuffer(raw, np.uint8, min(step, len(raw) - i), i)
        v += np.bincount(np.arange(len(b)) % dimensions, b / 255, dimensions)
    n = np.linalg.norm(v)
    return (v / n if n > 1e-10 else v).astype(np.float32)


def recall_similar(memory: Documents, query: Sequence[float], text: str, k: int) -> DataFrame:
    return memory.search(Search.hybrid(query, text, k))


def recall_kind(memory: DataFrame, query: Sequence[float], k: int, kind: str, outcome: str | None = None, language: str | None = None) -> DataFrame:
    """The nearest records of a kind, of an outcome (success, failure) and a language if given."""
    f = fl.eq("type", kind)
    if outcome is not None:
        f = f & fl.eq("outcome", outcome)
    if language is not None:
        f = f & fl.eq("language", parse_language(language))
    return vectors.knn(memory, query, k, where=fl.compile_filter(f, fl.Columns(memory)))


def recall_in_project(memory: DataFrame, query: Sequence[float], k: int, project: str) -> DataFrame:
    return vectors.knn(memory, query, k, where=fl.compile_filter(fl.eq("project", project), fl.Columns(memory)))


def type_stats(memory: DataFrame, kind: str = "type") -> DataFrame:
    """Records by kind, without internal ones."""
    return memory.where(F.coalesce(F.col(kind), F.lit("")) != INTERNAL).groupBy(kind).agg(F.count("*").alias("n"))


def forget(memory: DataFrame, ids: DataFrame) -> DataFrame:
    return memory.join(ids.select("id").distinct(), "id", "left_anti")


def cleanup_old(memory: DataFrame, now: int, days: int, timestamp: str = "timestamp") -> DataFrame:
    """The records that are not older than so many days; those without a time stay."""
    return memory.where(F.col(timestamp).isNull() | (F.col(timestamp) >= now - days * 86_400))


def recent_turns(turns: DataFrame, conversation: str, order: str, keep: int = TURNS) -> DataFrame:
    """The last turns of each conversation: its working context."""
    w = W.partitionBy(conversation).orderBy(F.desc(order))
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def focus_project(memory: Documents, project: str) -> Documents:
    """The view of one project's records, searched as the whole is."""
    return memory.view(fl.eq("project", project))


def context_text(turns: DataFrame, conversation: str, order: str, role: str = "role", text: str = "text", keep: int = TURNS) -> DataFrame:
    """Each conversation's last turns as one text, a line a turn."""
    last = recent_turns(turns, conversation, order, keep)
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.col(role), F.lit(": "), F.col(text)).alias("line"))))
    return last.groupBy(conversation).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def working_contexts(events: DataFrame, session: str = "session", order: str = "order") -> DataFrame:
    """The working context of each session after its events (``kind``, ``value``, ``role`` of turns) in their order.

    Kinds are project, task, file, goal, done (a goal is reached), turn, error and clear. ``project`` and ``task`` are the
    last ones, ``files`` each once and ``goals`` those not reached since, both as they came, ``turns`` the last 20 and
    ``errors`` the last 10. A clear empties all; sessions with nothing left have no row. Each part is settled by
    aggregations before a session's rows meet, so no task holds all of a session's events.
    """
    rows = events.select(F.col(session).alias("session"), F.col(order).alias("at"), "kind", "value", "role")
    cleared = rows.where("kind = 'clear'").groupBy("session").agg(F.max("at").alias("cleared"))
    rows = rows.join(cleared, "session", "left").where("cleared IS NULL OR at > cleared").drop("cleared")
    last = rows.where("kind IN ('project', 'task')").groupBy("session", "kind").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    files = rows.where("kind = 'file'").groupBy("session", "kind", "value").agg(F.min("at").alias("at"))
    done = rows.where("kind = 'done'").groupBy("session", "value").agg(F.max("at").alias("done"))
    goals = rows.where("kind = 'goal'").join(done, ["session", "value"], "left").where("done IS NULL OR at > done")
    w = W.partitionBy("session").orderBy(F.desc("at"))
    newest = [rows.where(F.col("kind") == k).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n") for k, n in (("turn", TURNS), ("error", ERRORS))]
    cols = ["session", "kind", "at", "value"]
    parts = [x.select(*cols, F.lit(None).cast("string").alias("role")) for x in (last, files, goals)] + [x.select(*cols, "role") for x in newest]
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.unionByName(part)
    listed = lambda k, *f: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("at", *f)))), lambda x: F.struct(*[x[c].alias(c) for c in f]) if len(f) > 1 else x[f[0]])
    only = lambda k: F.max(F.when(F.col("kind") == k, F.col("value")))
    return kept.groupBy("session").agg(
        only("project").alias("project"), only("task").alias("task"), listed("goal", "value").alias("goals"), listed("file", "value").alias("files"),
        listed("turn", "role", "value").alias("turns"), listed("error", "value").alias("errors"),
    )


def context_string() -> Column:
    """A context's project, task, goals and files as the text that is embedded, a line each; empty ones have none."""
    some = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, ", ")))
    return F.concat_ws("\n", F.concat(F.lit("Project: "), "project"), F.concat(F.lit("Task: "), "task"), some("Goals", F.col("goals")), some("Files", F.col("files")))


CONTEXT_SCHEMA = "project string, task string, goals array<string>, files array<string>, turns array<struct<role:string,value:string>>, errors array<string>"


def saved_contexts(contexts: DataFrame) -> DataFrame:
    """Contexts as internal documents, one a session, for a store."""
    fields = [c.split(" ")[0] for c in CONTEXT_SCHEMA.split(", ")]
    return contexts.select(
        F.concat(F.lit(f"{CONTEXT_ID}:"), F.col("session").cast("string")).alias("id"), F.lit(INTERNAL).alias("type"), F.to_json(F.struct(*fields)).alias("__data__")
    )


def loaded_contexts(stored: DataFrame) -> DataFrame:
    """The contexts of stored documents; what can't be read gives an empty one. ``session`` is a text."""
    rows = stored.where((F.col("type") == INTERNAL) & F.col("id").startswith(f"{CONTEXT_ID}:"))
    c = F.from_json("__data__", CONTEXT_SCHEMA)
    return rows.select(F.substring("id", len(CONTEXT_ID) + 2, 1 << 30).alias("session"), c.alias("c")).select("session", "c.*")
