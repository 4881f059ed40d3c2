"""Domain presets of a memory: what a text is about, its concepts, how contexts and domains relate, and its priority."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .memory import Decay, Weights


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text, already in lower case, has one of the words anywhere."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


@dataclass(frozen=True)
class Preset:
    """Ordered keyword rules and tables, compiled to Column expressions."""

    name: str
    domains: tuple[tuple[str, tuple[str, ...]], ...]
    other_domain: str
    related: tuple[tuple[str, ...], ...]
    concepts: tuple[tuple[str, tuple[str, ...]], ...]
    universal: tuple[str, ...]
    families: dict[str, tuple[str, ...]]
    same_family: float
    other_family: float
    critical: tuple[str, ...]
    high: tuple[str, ...]
    low: tuple[str, ...]
    decay: Decay
    weights: Weights

    def classify(self, content: Column) -> Column:
        """The first domain of which a keyword occurs."""
        low, out = F.lower(content), F.lit(self.other_domain)
        for domain, words in reversed(self.domains):
            out = F.when(has_any(low, words), domain).otherwise(out)
        return out

    def extract(self, description: Column, content: Column) -> Column:
        """The concepts of which a keyword occurs, in the preset's order."""
        low = F.lower(F.concat_ws(" ", description, content))
        return F.filter(F.array(*[F.when(has_any(low, words), F.lit(c)) for c, words in self.concepts]), lambda x: x.isNotNull())

    def priority(self, *texts: Column) -> Column:
        low = F.lower(F.concat_ws(" ", *texts))
        found = F.when(has_any(low, self.critical), "critical").when(has_any(low, self.high), "high").when(has_any(low, self.low), "low")
        return found.otherwise("normal")

    def transfer_level(self, concepts: Column, content: Column) -> Column:
        """Universal from two universal concepts on; else instance by its phrases; else domain or context."""
        n = F.size(F.filter(concepts, lambda c: c.isin(*self.universal)))
        own = has_any(F.lower(content), INSTANCE_PHRASES)
        return F.when(n >= 2, "universal").when(own, "instance").when(n >= 1, "domain").otherwise("context")

    def compatibility(self, context: str, stored: Column) -> Column:
        """How well a stored context serves the current one."""
        family = next((f for f, names in self.families.items() if context.lower() in names), None)
        same = F.lower(stored).isin(*self.families[family]) if family else F.lit(False)
        return F.when(stored == context, 1.0).when(same, self.same_family).otherwise(self.other_family)

    def relatedness(self, domain: str, stored: Column) -> Column:
        """1 for the same domain, 0.7 for a related one, else 0.3."""
        near = sorted({d for group in self.related if domain in group for d in group})
        return F.when(stored == domain, 1.0).when(stored.isin(*near) if near else F.lit(False), 0.7).otherwise(0.3)


# Phrases that tie a text to its project.
INSTANCE_PHRASES = ("this project", "este proyecto", "specific to", "only here", "custom", "our", "nuestra")

# Keyword rules of the three presets.
SOFTWARE = Preset(
    "Software Development",
    domains=(
        ("web_backend", ("api", "endpoint", "rest")),
        ("web_frontend", ("react", "vue", "css")),
        ("cli", ("cli", "terminal", "command")),
        ("data_science", ("pandas", "numpy", "ml")),
        ("devops", ("docker", "kubernetes", "ci/cd")),
        ("security", ("auth", "security", "encrypt")),
        ("database", ("sql", "database", "query")),
        ("mobile", ("android", "ios", "mobile")),
        ("systems", ("kernel", "memory", "syscall")),
        ("gamedev", ("game", "render", "sprite")),
        ("embedded", ("embedded", "mcu", "firmware")),
    ),
    other_domain="general",
    related=(("web_backend", "web_frontend"), ("systems", "embedded"), ("data_science", "database")),
    concepts=(
        ("error handling", ("error", "exception", "try", "catch", "result")),
        ("validation", ("valid", "check", "verify", "sanitize")),
        ("caching", ("cache", "memoize", "ttl")),
        ("async", ("async", "await", "future", "promise")),
        ("testing", ("test", "mock", "assert", "spec")),
        ("logging", ("log", "trace", "debug", "info")),
        ("authentication", ("auth", "login", "jwt", "token")),
        ("pagination", ("page", "limit", "offset", "cursor")),
        ("rate limiting", ("rate", "throttle", "limit")),
        ("middleware", ("middleware", "interceptor", "filter")),
    ),
    universal=("error handling", "validation", "caching", "logging", "testing"),
    families={
        "js_family": ("javascript", "typescript"),
        "systems": ("c", "cpp", "rust"),
        "jvm": ("java", "kotlin", "scala"),
        "dynamic": ("python", "ruby"),
        "apple": ("swift", "objective-c"),
    },
    same_family=0.8,
    other_family=0.3,
    critical=("security", "vulnerability", "cve", "injection", "xss", "csrf", "production", "outage", "data loss", "corruption", "breach", "critical", "urgent", "emergency", "hotfix"),
    high=("bug", "error", "exception", "crash", "failure", "broken", "performance", "slow", "memory leak", "timeout", "important", "priority", "blocking"),
    low=("style", "formatting", "comment", "typo", "rename", "refactor", "cleanup", "todo", "nice to have"),
    decay=Decay.slow(),
    weights=Weights(0.3, 0.25, 0.35, 0.1),
)
CONVERSATIONAL = Preset(
    "Conversational",
    domains=(
        ("support", ("help", "problem", "issue")),
        ("sales", ("buy", "price", "offer", "cost")),
        ("entertainment", ("joke", "fun", "play")),
        ("education", ("learn", "explain", "how")),
        ("professional", ("meeting", "report", "deadline")),
    ),
    other_domain="casual",
    related=(("support", "sales", "professional"), ("entertainment", "casual"), ("education", "support")),
    concepts=(
        ("greeting", ("hello", "hi", "hey", "good morning", "hola")),
        ("farewell", ("bye", "goodbye", "see you", "adios")),
        ("gratitude", ("thank", "thanks", "gracias", "appreciate")),
        ("apology", ("sorry", "apologize", "excuse", "disculpa")),
        ("empathy", ("understand", "feel", "sorry to hear")),
        ("clarification", ("mean", "clarify", "explain", "what do you")),
        ("confirmation", ("yes", "correct", "right", "exactly")),
        ("negation", ("no", "not", "don't", "can't")),
        ("urgency", ("urgent", "asap", "immediately", "now")),
        ("frustration", ("angry", "upset", "frustrated", "annoyed")),
    ),
    universal=("greeting", "farewell", "gratitude", "empathy", "clarification"),
    families={"formal": ("formal", "professional", "technical"), "informal": ("informal", "friendly", "casual"), "supportive": ("empathetic",)},
    same_family=0.8,
    other_family=0.4,
    critical=("never", "always", "hate", "love", "allergy", "allergic", "important", "remember", "don't forget", "must", "preference", "please don't", "stop"),
    high=("frustrated", "angry", "upset", "disappointed", "happy", "excited", "grateful", "thank", "favorite", "prefer", "like", "dislike"),
    low=("ok", "fine", "sure", "maybe", "whatever", "casual", "just", "random"),
    decay=Decay.fast(),
    weights=Weights.recency_focused(),
)
SERVICE = Preset(
    "Customer Service",
    domains=(
        ("billing", ("bill", "charge", "payment")),
        ("technical", ("broken", "not working", "bug")),
        ("returns", ("return", "refund", "exchange")),
        ("shipping", ("ship", "deliver", "tracking")),
        ("account", ("account", "password", "login")),
        ("product_info", ("product", "feature", "spec")),
        ("complaints", ("complain", "unhappy", "terrible")),
    ),
    other_domain="general",
    related=(("billing", "returns"), ("shipping", "returns"), ("technical", "account")),
    concepts=(
        ("escalation needed", ("manager", "supervisor", "escalate")),
        ("resolution", ("solved", "fixed", "resolved", "done")),
        ("compensation", ("refund", "credit", "discount", "free")),
        ("verification", ("verify", "confirm", "check identity")),
        ("policy reference", ("policy", "terms", "conditions")),
        ("empathy response", ("understand", "sorry", "apologize")),
        ("follow up needed", ("follow up", "callback", "contact again")),
        ("urgent", ("urgent", "emergency", "asap")),
    ),
    universal=("empathy response", "verification", "resolution", "follow up needed"),
    families={"high_value": ("vip", "premium"), "regular": ("standard", "new"), "retention": ("at_risk", "churned")},
    same_family=0.7,
    other_family=0.5,
    critical=("vip", "enterprise", "legal", "lawyer", "sue", "escalate", "manager", "supervisor", "ceo", "fraud", "breach", "unauthorized"),
    high=("complaint", "unhappy", "refund", "cancel", "broken", "defective", "wrong", "missing", "urgent", "immediately", "asap"),
    low=("question", "inquiry", "information", "how to", "general", "routine", "standard"),
    decay=Decay(),
    weights=Weights.manual_focused(),
)
