"""Transferable memory: concepts by keyword tables, levels, and recalls ranked by what carries over."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import LEVEL_SCORES, RELATED_DOMAINS, _mapped, knowledge_domain, language_compatibility

# Keywords and the names of their concepts.
PATTERNS = {
    "factory": "Factory Pattern", "singleton": "Singleton Pattern", "observer": "Observer Pattern", "strategy": "Strategy Pattern",
    "decorator": "Decorator Pattern", "adapter": "Adapter Pattern", "facade": "Facade Pattern", "proxy": "Proxy Pattern",
    "builder": "Builder Pattern", "prototype": "Prototype Pattern", "middleware": "Middleware Pattern", "repository": "Repository Pattern",
    "unit of work": "Unit of Work Pattern", "dependency injection": "Dependency Injection", "event sourcing": "Event Sourcing",
    "cqrs": "CQRS Pattern", "saga": "Saga Pattern", "circuit breaker": "Circuit Breaker",
}
DOMAIN_CONCEPTS = {
    "authentication": "Authentication", "authorization": "Authorization", "jwt": "JWT Tokens", "oauth": "OAuth", "session": "Session Management",
    "rate limit": "Rate Limiting", "throttl": "Throttling", "cache": "Caching", "pagination": "Pagination", "validation": "Input Validation",
    "sanitiz": "Input Sanitization", "error handling": "Error Handling", "logging": "Logging", "monitoring": "Monitoring", "testing": "Testing",
    "mocking": "Mocking", "serializ": "Serialization", "deserializ": "Deserialization", "encryption": "Encryption", "hashing": "Hashing",
    "compression": "Compression", "streaming": "Data Streaming", "websocket": "WebSockets", "graphql": "GraphQL", "rest": "REST API",
    "grpc": "gRPC", "queue": "Message Queue", "pub sub": "Pub/Sub", "batch": "Batch Processing", "concurrency": "Concurrency",
    "parallelism": "Parallelism", "async": "Async Programming",
}
PRINCIPLES = {
    "solid": "SOLID Principles", "dry": "DRY Principle", "kiss": "KISS Principle", "yagni": "YAGNI Principle",
    "separation of concern": "Separation of Concerns", "single responsibility": "Single Responsibility", "open closed": "Open/Closed Principle",
    "liskov": "Liskov Substitution", "interface segregation": "Interface Segregation", "dependency inversion": "Dependency Inversion",
    "composition over inheritance": "Composition over Inheritance", "fail fast": "Fail Fast", "defensive programming": "Defensive Programming",
}


@dataclass(frozen=True)
class Project:
    """What knowledge is to be carried over to."""

    name: str
    language: str
    domain: str
    patterns: tuple[str, ...] = ()


def concepts(*texts: Column) -> Column:
    """The distinct names of the concepts of which a keyword occurs, sorted."""
    low = F.lower(F.concat_ws(" ", *texts))
    found = [F.when(low.contains(k), F.lit(v)) for k, v in (PATTERNS | DOMAIN_CONCEPTS | PRINCIPLES).items()]
    return F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())))


def level(found: Column) -> Column:
    """Universal with a principle, domain with any other concept, else context."""
    principle = F.exists(found, lambda c: c.isin(*PRINCIPLES.values()))
    return F.when(principle, "universal").when(F.size(found) > 0, "domain").otherwise("context")


def tags(found: Column, transfer_level: Column, domain: Column) -> Column:
    """The tags that a transferable memory is kept with."""
    named = F.transform(found, lambda c: F.concat(F.lit("concept:"), F.replace(F.lower(c), F.lit(" "), F.lit("_"))))
    return F.array_join(F.concat(F.array(F.concat(F.lit("transfer:"), transfer_level), F.concat(F.lit("domain:"), domain)), named), ",")


def overlap(found: Column, patterns: tuple[str, ...]) -> Column:
    """Share of the concepts that contain a pattern of the project, or are contained in one."""
    if not patterns:
        return F.lit(0.0)
    low = [p.lower() for p in patterns]

    def hit(c: Column) -> Column:
        out = F.lit(False)
        for p in low:
            out = out | F.lower(c).contains(p) | F.contains(F.lit(p), F.lower(c))
        return out

    n = F.size(F.filter(found, hit))
    return F.when(F.size(found) == 0, 0.0).otherwise(n / F.greatest(F.size(found), F.lit(len(patterns))))


def transfer_score(project: Project | None, found: Column, transfer_level: Column, tag_text: Column, language: Column) -> Column:
    """Level, domain, language and shared concepts, at most 1; 0.5 without a project."""
    if project is None:
        return F.lit(0.5)
    own = knowledge_domain(project.domain)
    text = F.coalesce(tag_text, F.lit(""))
    related = F.lit(False)
    for d in RELATED_DOMAINS[own]:
        related = related | text.contains(f"domain:{d}")
    domain = F.when(text.contains(f"domain:{own}"), 0.25).when(related, 0.12).otherwise(0.0)
    fits = F.when(language.isNull(), 0.5).otherwise(language_compatibility(project.language, language))
    total = _mapped(LEVEL_SCORES, transfer_level, 0.25) * 0.3 + domain + fits * 0.3 + overlap(found, project.patterns) * 0.15
    return F.least(total, F.lit(1.0))


# What has to change between two languages.
ADAPTATIONS = {
    ("python", "rust"): "Cambiar a tipado estatico, usar Result para errores, ownership",
    ("javascript", "typescript"): "Anadir tipos, interfaces",
    ("typescript", "javascript"): "Remover tipos",
    ("java", "kotlin"): "Simplificar sintaxis, usar null-safety",
    ("python", "javascript"): "Adaptar sintaxis y async model",
    ("javascript", "python"): "Adaptar sintaxis y async model",
    ("rust", "go"): "Simplificar ownership, usar goroutines",
    ("go", "rust"): "Anadir ownership, Result types, macros",
}


def adaptation(language: Column, target: str) -> Column:
    """What has to change for the target language; null for the same one."""
    low, out = F.lower(language), F.concat(F.lit("Adaptar sintaxis de "), language, F.lit(f" a {target}"))
    for (a, b), text in ADAPTATIONS.items():
        if b == target.lower():
            out = F.when(low == a, text).otherwise(out)
    return F.when(low != target.lower(), out)


def ranked(hits: DataFrame, project: Project | None, k: int, text: tuple[str, ...] = ("task", "code"), relevance_weight: float = 0.6, threshold: float = 0.3) -> DataFrame:
    """Hits (``id, relevance`` and text, tag and language columns) by relevance and what carries over.

    ``relevance`` is taken as it is; of a hybrid search it is the score, lower for better, whose part is small.
    """
    rows = hits.withColumn("concepts", concepts(*[F.col(c) for c in text]))
    tagged = F.regexp_extract(F.coalesce("tags", F.lit("")), r"transfer:(\w+)", 1)
    rows = rows.withColumn("transfer_level", F.when(tagged.isin(*LEVEL_SCORES), tagged).otherwise(level(F.col("concepts"))))
    rows = rows.withColumn("transfer_score", transfer_score(project, F.col("concepts"), F.col("transfer_level"), F.col("tags"), F.col("language")))
    rows = rows.withColumn("combined_score", F.col("relevance") * relevance_weight + F.col("transfer_score") * (1 - relevance_weight))
    rows = rows.withColumn("applicable", F.col("transfer_score") >= threshold)
    if project is not None:
        rows = rows.withColumn("adaptation_needed", adaptation(F.col("language"), project.language))
    return rows.orderBy(F.desc("combined_score"), "id").limit(k)


def recall_universal(hits: DataFrame, project: Project | None, k: int, **how) -> DataFrame:
    """Of the 2k best, at most ``k`` universal ones."""
    return ranked(hits, project, 2 * k, **how).where(F.col("transfer_level") == "universal").orderBy(F.desc("combined_score"), "id").limit(k)


def recall_same_domain(hits: DataFrame, project: Project, k: int, **how) -> DataFrame:
    """Of the 2k best, at most ``k`` that are tagged with the project's domain."""
    own = F.coalesce("tags", F.lit("")).contains(f"domain:{knowledge_domain(project.domain)}")
    return ranked(hits, project, 2 * k, **how).where(own).orderBy(F.desc("combined_score"), "id").limit(k)


def recall_same_stack(hits: DataFrame, project: Project, k: int, least: float = 0.6, **how) -> DataFrame:
    """Of the 2k best, at most ``k`` in a language that is close to the project's."""
    fits = F.when(F.col("language").isNull(), 0.5).otherwise(language_compatibility(project.language, F.col("language")))
    return ranked(hits, project, 2 * k, **how).where(fits >= least).orderBy(F.desc("combined_score"), "id").limit(k)
