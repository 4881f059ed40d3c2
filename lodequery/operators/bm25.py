"""BM25 keyword search.

The statistics of a query are those of its own terms, so a search is two scans of
the text: one that counts documents, their lengths and the documents of each term
into a single row, and one that scores and keeps the best. Nothing is exploded or
shuffled by term.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.functions.text import query_tokens, tokens

K1, B = 1.2, 0.75


def index(df: DataFrame, text: Column, id_col: str = "id") -> DataFrame:
    """``id, tokens, dl`` of every document: written as Parquet once, it saves tokenising in each search."""
    return df.select(id_col, tokens(text).alias("tokens")).withColumn("dl", F.size("tokens"))


def stats(indexed: DataFrame) -> DataFrame:
    """One row: documents, distinct terms, tokens and the mean length."""
    terms = indexed.select(F.explode_outer("tokens").alias("t")).agg(F.countDistinct("t").alias("unique_terms"))
    sizes = indexed.agg(
        F.count("*").alias("total_documents"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_tokens"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_length")
    )
    return sizes.join(F.broadcast(terms))


def scored(indexed: DataFrame, query: str, where: Column | None = None) -> DataFrame:
    """``indexed`` with ``bm25`` for the documents that have a term of the query.

    Repeated query terms add up. The statistics are over all documents, the filter is for the result only.
    """
    wanted = Counter(query_tokens(query))
    if not wanted:
        return indexed.where(F.lit(False)).withColumn("bm25", F.lit(0.0))
    names = list(wanted)
    # Generating a row from the counts keeps them from being computed again by each expression that uses them.
    occurrences = [F.size("tokens") - F.size(F.array_remove("tokens", t)) for t in names]
    rows = indexed.select("*", F.explode(F.array(F.array(*occurrences))).alias("_tf"))
    seen = [F.count_if(F.get("_tf", F.lit(i)) > 0).cast("double").alias(f"df{i}") for i in range(len(names))]
    whole = rows.agg(F.struct(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *seen).alias("_s"))
    hits = rows.where(reduce(lambda a, b: a | b, [F.get("_tf", F.lit(i)) > 0 for i in range(len(names))]))
    hits = (hits if where is None else hits.where(where)).join(F.broadcast(whole))
    score = F.lit(0.0)
    for i, t in enumerate(names):
        n, df, f = F.col("_s.n"), F.col(f"_s.df{i}"), F.get("_tf", F.lit(i))
        idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
        part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("_s.avgdl")))
        score = score + F.when(f > 0, part * wanted[t]).otherwise(0.0)
    return hits.withColumn("bm25", score).drop("_tf", "_s")


def search(indexed: DataFrame, query: str, k: int, where: Column | None = None, id_col: str = "id") -> DataFrame:
    """The ``k`` best documents, ties by id."""
    return scored(indexed, query, where).orderBy(F.desc("bm25"), id_col).limit(k)
