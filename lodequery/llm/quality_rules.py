"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets counts over its whole text. For each language and source a
quantile sketch of each rate is kept; sketches of sources merge into one for
their language, which stands in where a source has few documents, and those of
languages into one for all. A rate has two fences, its median plus and minus
``SPREAD`` times the distance from there to the ``OUTER`` quantile of either side, so
the same rate may pass in one source and fail in another; no cutoff is fixed
beforehand. ``ALLOWED`` counts a document beyond a fence are forgiven, which matters
in short texts only. A document is kept where it passes the base rules and all its
rates lie within their fences. The sketch of a small group holds a number a document.

Null and empty texts have counts of 0 and fail the base rules; null languages
and sources are groups of their own; repeated rows and ties have equal results;
very long texts are counted whole; an empty table gives an empty result; other
columns are left out by :func:`quality_rules` and kept by :func:`quality_filter`.
Windows of eight words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, materialise, named, table

# The base rules.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30

SPREAD = 6.0
OUTER = 0.2
# Counts beyond a fence that are forgiven, and the count that the rate is a share of.
ALLOWED = {"symbol_rate": (4, "n_words"), "dup_line_rate": (3, "n_lines"), "repeat_rate": (32, "n_words"), "upper_rate": (8, "word_chars"), "word_length": (8, "n_words")}
LEAST_GROUP = 30
SKETCH_K = 2048
BROADCAST_ROWS = 1_000_000  # of a number each; with more, Spark picks the join
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column, n: Column) -> Column:
    """Words that stand in a window found twice or more."""
    own = F.transform(words, lambda x: F.xxhash64(x))
    hashes = _let(own, lambda w: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))

    def covered(sorted_: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(sorted_, a)["h"] == F.get(sorted_, b)["h"], F.lit(False))
        twice = F.filter(sorted_, lambda _, i: same(i, i - 1) | same(i, i + 1))
        places = F.sort_array(F.transform(twice, lambda s: s["i"]))
        return _let(
            places,
            lambda p: F.aggregate(
                p,
                F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
            )["n"],
        )

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(pairs, covered))

    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(_let(hashes, count))


def counts_column(text_col: str) -> Column:
    """Struct of the base counts of a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    without = lambda chars: F.length(F.translate(text, chars, ""))
    fields = lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        without(" \t\n\x0b\f\r").cast("long").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(words, F.size(words)).cast("long").alias("n_repeat_words"),
        _let(lines, F.size).cast("long").alias("n_lines"),
        (F.length(text) - without(_UPPER)).cast("long").alias("n_upper"),
    )
    return _let(F.array_remove(F.split(text, SPACE), ""), fields)


def _rates(c: Callable[[str], Column]) -> dict[str, Column]:
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    return {
        "symbol_rate": per("n_symbols", "n_words"),
        "dup_line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"),
        "upper_rate": per("n_upper", "word_chars"),
        "word_length": per("word_chars", "n_words"),
    }


def fences(counted: DataFrame, lang_col: str = "lang", source_col: str = "source", counts: str = "_lodequery_counts") -> DataFrame:
    """A row for each language and source with two fences for each rate.

    Sketches are built per task and merged by the shuffle, so a source with most of the rows is no larger there than others.
    """
    rates = _rates(lambda x: F.col(f"{counts}.{x}"))
    rows = counted.where(F.col(f"{counts}.n_words") >= LEAST_WORDS).select(
        named(lang_col).alias("lang"), named(source_col).alias("source"), *[r.alias(k) for k, r in rates.items()]
    )
    by_source = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(k, F.lit(SKETCH_K)).alias(k) for k in rates])
    by_lang = by_source.groupBy("lang").agg(F.sum("n").alias("lang_n"), *[F.kll_merge_agg_double(k).alias(f"lang_{k}") for k in rates])
    overall = by_lang.agg(*[F.kll_merge_agg_double(f"lang_{k}").alias(f"all_{k}") for k in rates])
    merged = by_source.join(by_lang.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))).join(F.broadcast(overall))

    def two(k: str) -> list[Column]:
        sketch = F.when(F.col("n") >= LEAST_GROUP, F.col(k)).when(F.col("lang_n") >= LEAST_GROUP, F.col(f"lang_{k}")).otherwise(F.col(f"all_{k}"))
        low, mid, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (OUTER, 0.5, 1 - OUTER))
        return [(mid - SPREAD * (mid - low)).alias(f"_lodequery_min_{k}"), (mid + SPREAD * (high - mid)).alias(f"_lodequery_max_{k}")]

    return merged.select(F.col("lang").alias("_lodequery_lang"), F.col("source").alias("_lodequery_source"), *[c for k in rates for c in two(k)])


def _judged(counted: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """``counted`` with the two decisions."""
    limits = fences(counted, lang_col, source_col)
    c = lambda x: F.col(f"_lodequery_counts.{x}")
    failed = (c("n_words") < LEAST_WORDS) | (100 * c("n_repeat_words") > REPEAT_PERCENT * c("n_words"))
    own = named(lang_col).eqNullSafe(F.col("_lodequery_lang")) & named(source_col).eqNullSafe(F.col("_lodequery_source"))
    joined = counted.join(limits, own, "left")
    beyond = F.lit(False)
    for k, r in _rates(c).items():
        allowed = ALLOWED[k][0] / F.greatest(c(ALLOWED[k][1]), F.lit(1))
        outside = (r > F.col(f"_lodequery_max_{k}") + allowed) | (r < F.col(f"_lodequery_min_{k}") - allowed)
        beyond = beyond | F.coalesce(outside, F.lit(False))
    return joined.withColumn("_lodequery_failed", failed).withColumn("_lodequery_kept", ~failed & ~beyond)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of ``df``: its id, base counts, ``base_failed`` and ``kept``."""
    counted = materialise(df.select(id_col, F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), counts_column(text_col).alias("_lodequery_counts")), "quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = _judged(counted, "lang", "source")
    return out.select(id_col, *[f"_lodequery_counts.{x}" for x in names], F.col("_lodequery_failed").alias("base_failed"), F.col("_lodequery_kept").alias("kept"))


def quality_filter(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` that are kept, with their columns.

    Texts are not written again: only counts are, with a 64-bit hash of what the decision follows from, and rows with the
    hashes of those that fail are left out.
    """
    key = F.xxhash64(named(text_col), named(lang_col), named(source_col), named(lang_col).isNull())  # the hash passes over nulls
    counted = df.select(key.alias("key"), named(lang_col).alias("lang"), named(source_col).alias("source"), counts_column(text_col).alias("_lodequery_counts"))
    judged = _judged(materialise(counted, "quality"), "lang", "source")
    gone = materialise(judged.where("not _lodequery_kept").select(F.col("key").alias("_lodequery_key")).distinct(), "failed")
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return df.join(gone, key == F.col("_lodequery_key"), "left_anti").select(*columns(df))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


# The sketches hold all values of a group of up to SKETCH_K documents, as in the tables that this SQL is run on.
COUNTS_SQL = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS m FROM d WHERE len(w) > 8),
k AS (SELECT rid, i, m, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o || ' '
    || lead(x, 5) OVER o || ' ' || lead(x, 6) OVER o || ' ' || lead(x, 7) OVER o AS v FROM g WINDOW o AS (PARTITION BY rid ORDER BY i)),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS c FROM k WHERE i <= m - 7),
r AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM h WHERE c > 1) GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper FROM d LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbol_rate,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_rate, n_repeat_words / greatest(n_words, 1) AS repeat_rate,
    n_upper / greatest(word_chars, 1) AS upper_rate, word_chars / greatest(n_words, 1) AS word_length FROM c)"""


def oracle() -> str:
    def limits(name: str, by: str) -> str:
        mid = "quantile_disc({0}, 0.5)"
        low = f"{mid} - {SPREAD} * ({mid} - quantile_disc({{0}}, {OUTER})) AS min_{{0}}"
        high = f"{mid} + {SPREAD} * (quantile_disc({{0}}, {1 - OUTER}) - {mid}) AS max_{{0}}"
        both = ", ".join(x.format(k) for k in ALLOWED for x in (low, high))
        return f"{name} AS (SELECT {by}count(*) AS n, {both} FROM f WHERE n_words >= 20 {'GROUP BY ALL' if by else ''})"

    limit = lambda x: f"CASE WHEN s.n >= {LEAST_GROUP} THEN s.{x} WHEN l.n >= {LEAST_GROUP} THEN l.{x} ELSE a.{x} END"
    allowed = {k: f"{n} / greatest(f.{d}, 1)" for k, (n, d) in ALLOWED.items()}
    over = " OR ".join(f"f.{k} > {limit(f'max_{k}')} + {v} OR f.{k} < {limit(f'min_{k}')} - {v}" for k, v in allowed.items())
    return f"""WITH {COUNTS_SQL}, {limits("s", "lang, source, ")}, {limits("l", "lang, ")}, {limits("a", "")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({over}, false) AS kept
FROM f LEFT JOIN s ON f.lang IS NOT DISTINCT FROM s.lang AND f.source IS NOT DISTINCT FROM s.source
LEFT JOIN l ON f.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a"""


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {"op5_quality_rules": oracle()}
