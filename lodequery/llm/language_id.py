"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed character trigrams. A document is
taken for a mixture of languages; expectation-maximisation estimates its
proportions, and among the nested sets of its likeliest languages the one with
the highest penalised likelihood is kept.

The distributions are learned from a bounded sample of labelled rows: of each
language about ``rows_per_lang`` rows (5,000 by default), chosen by a hash of
their id, or all of them where there are fewer. Everything else reads all rows
and whole texts.

A text that is null or has no letter is ``und`` with score 0, as is every text
where nothing could be learned; equal texts have equal results; an empty table
gives an empty result; other columns of the input are left out. Ties between
languages go to the first in alphabetical order.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, table

BUCKETS = 1 << 16
SMOOTHING = 0.1
EM_ROUNDS = 12
LEAST_SHARE = 0.02
PENALTY = 8.0

RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("langs", T.ArrayType(T.StringType())),
        T.StructField("shares", T.ArrayType(T.DoubleType())),
    ]
)


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray | None:
    """Hashed trigrams of the lower-cased text; runs of other characters count as one gap. None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(0))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate(([0], c[keep], [0])).astype(np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    return (h >> np.uint32(16)).astype(np.uint16)


def _counts(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(grams, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[at], np.diff(np.append(at, len(g))).astype(np.float64)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_lang: int = 5000) -> tuple[list[str], np.ndarray]:
    """Languages and the table of log-likelihoods (bucket by language) learned from labelled rows."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_lang / n))])
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("lang", "text")

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if (g := trigrams(text)) is not None:
                    found[lang] = found.get(lang, 0) + np.bincount(g, minlength=BUCKETS)
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "gram": at.astype("int32"), "n": n[at].astype("int64")})

    got = chosen.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(got["lang"]))
    n = np.zeros((BUCKETS, len(langs)))
    n[got["gram"].to_numpy(), [langs.index(x) for x in got["lang"]]] = got["n"].to_numpy()
    n += SMOOTHING
    return langs, np.log(n / n.sum(0)).astype(np.float32)


def _em(p: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Shares and log-likelihood; ``p`` has a likelihood by trigram and language, up to a factor by trigram."""
    total = n.sum()
    for _ in range(rounds):
        share = share * ((n / (p @ share)) @ p) / total
    return share, float(n @ np.log(p @ share))


def infer(log_p: np.ndarray, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The kept languages, by falling share, and their shares; None for a text without a letter."""
    grams = trigrams(text)
    if grams is None or not log_p.shape[1]:
        return None
    g, n = _counts(grams)
    rows = log_p[g]
    p = np.exp(rows - rows.max(1, keepdims=True)).astype(np.float64)
    langs = p.shape[1]
    share, _ = _em(p, n, np.full(langs, 1 / langs), EM_ROUNDS)
    order = np.argsort(-share, kind="stable")
    order = order[: max(1, int((share >= LEAST_SHARE).sum()))]
    best, kept = -np.inf, None
    for k in range(1, len(order) + 1):
        own = order[:k]
        part = share[own] / share[own].sum() if k > 1 else np.ones(1)
        part, value = _em(p[:, own], n, part, EM_ROUNDS // 2 if k > 1 else 0)
        value -= PENALTY * (k - 1) * np.log(1 + n.sum())
        if value > best:
            best, kept = value, (own, part)
    own, part = kept
    by = np.lexsort((own, -part))
    return own[by], part[by]


def language_column(spark: SparkSession, text_col: str, model: tuple[list[str], np.ndarray]) -> Column:
    """Struct column with the prediction for the texts in ``text_col``.

    The model has a fixed number of buckets by the number of languages and is broadcast.
    """
    langs, log_p = model
    shared = spark.sparkContext.broadcast(log_p)

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        table_, rows = shared.value, []
        for text in texts:
            found = infer(table_, text)
            if found is None:
                rows.append(("und", 0.0, [], []))
            else:
                own, part = found
                rows.append((langs[own[0]], float(min(1.0, part[0])), [langs[i] for i in own], [float(x) for x in part]))
        return pd.DataFrame(rows, columns=RESULT.names)

    return predict(F.col(text_col))


def learnable(id_col: str = "doc_id") -> Column:
    """True for the rows that may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 5000) -> DataFrame:
    """One row for each row of ``docs``: its id, whether it was held out, and the prediction. A null id is held out."""
    learn = F.coalesce(learnable(id_col), F.lit(False))
    model = fit(docs.where(learn), id_col, text_col, lang_col, rows_per_lang)
    found = docs.select(id_col, (~learn).alias("held_out"), language_column(docs.sparkSession, text_col, model).alias("_lodequery_found"))
    return found.select(id_col, "held_out", "_lodequery_found.*")


def language_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_share: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose text has letters and a language with at least ``least_share`` of it, with their columns."""
    model = fit(docs.where(F.coalesce(learnable(id_col), F.lit(False))), id_col, text_col, lang_col)
    found = docs.withColumn("_lodequery_found", language_column(docs.sparkSession, text_col, model))
    return found.where((F.col("_lodequery_found.lang_pred") != "und") & (F.col("_lodequery_found.score") >= least_share)).select(*columns(docs))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
