"""Memory ranking: usage, decay, priority and transfer scores, and the recalls that combine them.

All scoring is column arithmetic against an explicit clock. A recall is a pure
plan; bumping the counters of what was recalled is a separate step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.errors import InvalidConfig
from lodequery.functions.distance import COSINE

from . import vectors
from .hybrid import Documents, Search

DAY = 86_400.0
WEEK_HOURS = 168.0
PRIORITY_SCORES = {"critical": 1.0, "high": 0.75, "normal": 0.5, "low": 0.25}
LEVEL_SCORES = {"instance": 0.25, "context": 0.5, "domain": 0.75, "universal": 1.0}
LEVEL_ORDER = {"instance": 0, "context": 1, "domain": 2, "universal": 3}


@dataclass(frozen=True)
class Decay:
    """Halves a score every ``half_life`` seconds down to ``least``; immune priorities keep theirs."""

    half_life: float = 30 * DAY
    least: float = 0.1
    immune: tuple[str, ...] = ("critical",)

    @staticmethod
    def fast() -> Decay:
        return Decay(7 * DAY, 0.2, ("critical", "high"))

    @staticmethod
    def slow() -> Decay:
        return Decay(90 * DAY, 0.05, ("critical",))

    def factor(self, age: Column, priority: Column) -> Column:
        faded = F.greatest(F.pow(F.lit(0.5), age / self.half_life), F.lit(self.least))
        return F.when(priority.isin(*self.immune), 1.0).otherwise(faded)


@dataclass(frozen=True)
class Weights:
    """Weights of the base priority, the frequency, the usefulness and the recency."""

    base: float = 0.4
    frequency: float = 0.2
    usefulness: float = 0.25
    recency: float = 0.15

    @staticmethod
    def manual_focused() -> Weights:
        return Weights(0.6, 0.15, 0.15, 0.1)

    @staticmethod
    def usage_focused() -> Weights:
        return Weights(0.2, 0.4, 0.25, 0.15)

    @staticmethod
    def recency_focused() -> Weights:
        return Weights(0.25, 0.15, 0.2, 0.4)


@dataclass(frozen=True)
class Context:
    """What a recall is for: an instance, its context (a language, a tone, a tier) and its domain."""

    instance_id: str = ""
    context: str = ""
    domain: str = ""


# Knowledge domains that can use each other's knowledge, languages that resemble each other.
RELATED_DOMAINS = {
    "web_backend": ("database", "security", "devops"),
    "web_frontend": ("mobile", "web_backend"),
    "cli": ("systems", "devops"),
    "data_science": ("database", "systems"),
    "systems": ("embedded", "security"),
    "mobile": ("web_frontend",),
    "devops": ("security", "systems"),
    "security": ("web_backend", "systems"),
    "database": ("web_backend", "data_science"),
    "gamedev": ("systems", "web_frontend"),
    "embedded": ("systems",),
    "general": (),
}
DOMAIN_ALIASES = {
    "web_backend": ("webbackend", "backend"),
    "web_frontend": ("webfrontend", "frontend"),
    "cli": ("command_line",),
    "data_science": ("datascience", "data", "ml"),
    "systems": ("system",),
    "mobile": ("ios", "android"),
    "devops": ("ops", "infra"),
    "security": ("sec",),
    "database": ("db",),
    "gamedev": ("game", "games"),
    "embedded": ("iot",),
}
LANGUAGE_GROUPS = (
    ("typescript", "javascript", "js", "ts"),
    ("python", "ruby", "perl"),
    ("rust", "go", "c", "cpp", "c++", "zig"),
    ("java", "kotlin", "scala", "groovy"),
    ("csharp", "c#", "fsharp", "f#"),
    ("swift", "objective-c", "objc"),
    ("haskell", "ocaml", "elm", "purescript"),
    ("clojure", "lisp", "scheme", "racket"),
    ("php", "hack"),
    ("elixir", "erlang"),
)


def knowledge_domain(name: str) -> str:
    """The canonical domain; an unknown name is general."""
    low = name.lower()
    return next((d for d, more in DOMAIN_ALIASES.items() if low == d or low in more), "general")


def knowledge_domain_of(name: Column) -> Column:
    low, out = F.lower(name), F.lit("general")
    for d, more in DOMAIN_ALIASES.items():
        out = F.when(low.isin(d, *more), d).otherwise(out)
    return out


def language_compatibility(language: str, stored: Column) -> Column:
    """1 for the same language, 0.7 for one of its group, else 0.2."""
    low = language.lower()
    near = sorted({x for g in LANGUAGE_GROUPS if low in g for x in g})
    same = F.lower(stored) == low
    return F.when(same, 1.0).when(F.lower(stored).isin(*near) if near else F.lit(False), 0.7).otherwise(0.2)


def _mapped(values: dict[str, float], c: Column, other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def frequency_score(accesses: Column) -> Column:
    return F.when(accesses > 0, F.least(F.log2(accesses + 1) / 10, F.lit(1.0))).otherwise(0.0)


def usefulness_score(useful: Column, accesses: Column) -> Column:
    return F.when(accesses > 0, F.least(useful / accesses, F.lit(1.0))).otherwise(0.5)


def recency_score(seconds: Column) -> Column:
    return F.exp(-(seconds / 3600.0) / WEEK_HOURS)


def priority_score(now: int, decay: Decay, weights: Weights, priority: str = "priority") -> Column:
    """Weighted sum, clamped and faded, over the columns ``_access_count, _useful_count, _last_accessed, _created_at``."""
    p = F.coalesce(F.when(F.col(priority).isin(*PRIORITY_SCORES), F.col(priority)), F.lit("normal"))
    accesses = F.col("_access_count")
    since = lambda c: F.greatest(F.lit(now) - F.col(c), F.lit(0)).cast("double")
    raw = (
        weights.base * _mapped(PRIORITY_SCORES, p, 0.5)
        + weights.frequency * frequency_score(accesses)
        + weights.usefulness * usefulness_score(F.col("_useful_count"), accesses)
        + weights.recency * recency_score(since("_last_accessed"))
    )
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)) * decay.factor(since("_created_at"), p)


def transfer_score(preset, context: Context | None, level: Column) -> Column:
    """How far a memory serves the current context, by its level and the columns ``instance_id, context, domain``."""
    if context is None:
        return _mapped(LEVEL_SCORES, level, LEVEL_SCORES["instance"])
    stored = lambda c: F.coalesce(F.col(c), F.lit(""))
    instance = F.when(stored("instance_id") == context.instance_id, 1.0).otherwise(0.0)
    by_preset = preset.compatibility(context.context, stored("context"))
    fit = by_preset
    if context.context:
        fit = F.when(stored("context") != "", F.greatest(language_compatibility(context.context, stored("context")), by_preset)).otherwise(by_preset)
    by_class = preset.relatedness(context.domain, stored("domain"))
    near = by_class
    if context.domain:
        own = knowledge_domain(context.domain)
        kd = knowledge_domain_of(stored("domain"))
        related = kd.isin(*RELATED_DOMAINS[own]) if RELATED_DOMAINS[own] else F.lit(False)
        near = F.when(stored("domain") == "", by_class).when(kd == own, 1.0).when(related, 0.7).otherwise(by_class)
    return (
        F.when(level == "universal", 1.0)
        .when(level == "context", fit * 0.5 + near * 0.3 + 0.2)
        .when(level == "domain", near * 0.6 + 0.4)
        .otherwise(instance * 0.6 + fit * 0.2 + near * 0.2)
    )


def learned(rows: DataFrame, preset, now: int, context: Context | None = None, description: str = "description", outcome: str = "outcome") -> DataFrame:
    """Rows with ``content`` and an embedding, with what a memory keeps of them; columns that are there already win."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    concepts = preset.extract(text(description), F.col("content"))
    made = {
        "concepts": F.array_join(concepts, ","),
        "transfer_level": preset.transfer_level(concepts, F.col("content")),
        "priority": preset.priority(text(description), F.col("content"), text(outcome)),
        "timestamp": F.lit(now).cast("long"),
        "instance_id": F.lit(context.instance_id if context else None).cast("string"),
        "context": F.lit(context.context if context else None).cast("string"),
        "domain": F.lit(context.domain) if context and context.domain else preset.classify(F.col("content")),
        "_access_count": F.lit(0).cast("long"),
        "_useful_count": F.lit(0).cast("long"),
        "_last_accessed": F.lit(now).cast("long"),
        "_created_at": F.lit(now).cast("long"),
    }
    return rows.withColumns({k: F.coalesce(F.col(k), v) if k in rows.columns else v for k, v in made.items()})


@dataclass(frozen=True)
class Recall:
    """Weights of a recall, brought to a sum of 1, and its threshold."""

    relevance: float = 0.4
    transfer: float = 0.3
    priority: float = 0.3
    threshold: float = 0.3

    def __post_init__(self):
        if not 0 < self.relevance + self.transfer + self.priority < float("inf"):
            raise InvalidConfig("the weights of a recall must have a positive sum")

    def combined(self, relevance: Column, transfer: Column, priority: Column) -> Column:
        total = self.relevance + self.transfer + self.priority
        return relevance * (self.relevance / total) + transfer * (self.transfer / total) + priority * (self.priority / total)


def recall(
    memories: DataFrame, query: Sequence[float], k: int, preset, now: int, context: Context | None = None, how: Recall | None = None, metric: str = COSINE, where: Column | None = None
) -> DataFrame:
    """The best of the 3k nearest memories that pass the threshold, by the combined score."""
    how = how or Recall()
    near = vectors.knn(memories, query, 3 * k, metric, where)
    level = F.coalesce(F.when(F.col("transfer_level").isin(*LEVEL_SCORES), F.col("transfer_level")), F.lit("instance"))
    rows = near.withColumns(
        {"relevance": 1 - F.col("distance"), "transfer_score": transfer_score(preset, context, level), "priority_score": priority_score(now, preset.decay, preset.weights)}
    ).where(F.col("transfer_score") >= how.threshold)
    rows = rows.withColumn("combined_score", how.combined(F.col("relevance"), F.col("transfer_score"), F.col("priority_score")))
    return rows.orderBy(F.desc("combined_score"), "id").limit(k)


def recall_where(memories: DataFrame, query: Sequence[float], k: int, where: Column, metric: str = COSINE) -> DataFrame:
    """The nearest memories that pass; relevance is their combined score."""
    return vectors.knn(memories, query, k, metric, where).withColumn("combined_score", 1 - F.col("distance"))


def recall_universal(memories: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    return recall_where(memories, query, k, F.col("transfer_level") == "universal")


def recall_same_domain(memories: DataFrame, query: Sequence[float], k: int, domain: str) -> DataFrame:
    return recall_where(memories, query, k, F.col("domain") == domain)


def recall_same_context(memories: DataFrame, query: Sequence[float], k: int, context: str) -> DataFrame:
    return recall_where(memories, query, k, F.col("context") == context)


def recall_critical(memories: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    return recall_where(memories, query, k, F.col("priority") == "critical")


def recall_high_priority(memories: DataFrame, query: Sequence[float], k: int, preset, now: int) -> DataFrame:
    """Of the 2k nearest critical or high ones, the k with the highest priority score."""
    near = recall_where(memories, query, 2 * k, F.col("priority").isin("critical", "high"))
    return near.withColumn("priority_score", priority_score(now, preset.decay, preset.weights)).orderBy(F.desc("priority_score"), "id").limit(k)


def recall_by_keywords(memories: Documents, text: str, k: int) -> DataFrame:
    """The best memories by keyword; relevance is the search's score, lower for better."""
    return memories.search(Search.by_keyword(text, k)).withColumn("relevance", F.col("score"))


def update_priority(memories: DataFrame, ids: DataFrame, priority: str) -> DataFrame:
    """The memories with the priority of the given ids overwritten."""
    if priority not in PRIORITY_SCORES:
        raise InvalidConfig(f"unknown priority {priority!r}")
    marks = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return memories.join(marks, "id", "left").withColumn("priority", F.when(F.col("_hit"), priority).otherwise(F.col("priority"))).drop("_hit")


def record_access(memories: DataFrame, ids: DataFrame, now: int, useful: bool = False) -> DataFrame:
    """The memories with the counters of the given ids bumped."""
    marks = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    rows = memories.join(marks, "id", "left")
    if useful:
        return rows.withColumn("_useful_count", F.col("_useful_count") + hit.cast("long")).drop("_hit")
    return rows.withColumns(
        {"_access_count": F.col("_access_count") + hit.cast("long"), "_last_accessed": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("_last_accessed"))}
    ).drop("_hit")


def memory_stats(memories: DataFrame) -> DataFrame:
    """One row: memories, accesses, useful ones, and the mean usefulness of those ever accessed."""
    used = F.when(F.col("_access_count") > 0, F.col("_useful_count") / F.col("_access_count"))
    return memories.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum("_access_count"), F.lit(0)).cast("long").alias("accesses"),
        F.coalesce(F.sum("_useful_count"), F.lit(0)).cast("long").alias("useful"),
        F.coalesce(F.avg(used), F.lit(0.5)).alias("avg_usefulness"),
    )
