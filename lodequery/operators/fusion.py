"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60


def rank_first(df: DataFrame, order: list, limit: int, name: str) -> DataFrame:
    """The first ``limit`` rows with their 0-based rank.

    The limit comes before the window, so only that many rows meet in one task.
    """
    return df.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(W.orderBy(*order)) - 1)


def rrf(lists: list[tuple[DataFrame, str, float]], id_col: str = "id", k: int = RRF_K) -> DataFrame:
    """``id, rrf`` by falling score, ties by id; a list is a DataFrame, the name of its 0-based rank and its weight."""
    parts = [df.select(id_col, (F.lit(float(w)) / (k + F.col(rank) + 1)).alias("s")) for df, rank, w in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.sum("s").alias("rrf")).orderBy(F.desc("rrf"), id_col)
