"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``root``, the smallest id of its component, of every node with an edge to another.

    Distributed union-find: in turn each node's larger neighbours, then its smaller
    ones, are hung below its smallest neighbour, until nothing changes. Minima are
    pre-aggregated by task and each round is written to the shared folder, so
    neither a component nor a node with many edges has to fit anywhere.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = materialise(e, "edges")
    state = _state(e)
    for _ in range(ROUNDS):
        if state[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _state(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    r = e.agg(F.count("*").alias("n"), F.sum(F.shiftright(h, 24)).alias("s"), F.bit_xor(h).alias("x")).first()
    return r["n"], r["s"], r["x"]
