"""Reranking of a bounded list of hits by a user's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[str, list[str]], list[float]]


def rerank(hits: DataFrame, query: str, text_col: str, scorer: Scorer, distance: str = "distance", id_col: str = "id") -> DataFrame:
    """Hits with text by falling score, their distance 1 - score; then those without text as they were.

    ``hits`` is a top-k result, so its texts fit one task, which the scorer may need to see together.
    """
    schema = T.StructType([*hits.schema.fields, T.StructField("_group", T.IntegerType()), T.StructField("_place", T.DoubleType())])
    ordered = hits.withColumn("_seq", F.monotonically_increasing_id()).coalesce(1)
    wide = T.StructType([f for f in schema.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        if not len(pdf):
            return
        pdf = pdf.sort_values("_seq").reset_index(drop=True)
        has = pdf[text_col].map(lambda x: isinstance(x, str))
        pdf["_group"], pdf["_place"] = 1, pdf.index.astype("float64")
        if has.any():
            scores = scorer(query, list(pdf.loc[has, text_col]))
            pdf.loc[has, "_group"], pdf.loc[has, "_place"] = 0, [-float(s) for s in scores]
            pdf.loc[has, distance] = [1 - float(s) for s in scores]
        yield pdf.drop(columns="_seq")

    return ordered.mapInPandas(run, wide).orderBy("_group", "_place", id_col).drop("_group", "_place")


def overlap_scorer(query: str, texts: list[str]) -> list[float]:
    """Share of the query's distinct words that a text has: a simple scorer for tests."""
    words = set(query.lower().split())
    return [len(words & set(t.lower().split())) / max(1, len(words)) for t in texts]
