"""Approximate search by clusters: train, assign, probe; and the recall of a result."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.errors import InvalidConfig
from lodequery.functions.distance import COSINE, check_query, distance
from lodequery.functions.quantize import decoded

from .vectors import BLOCK_CELLS, knn, knn_batch

MAX_CLUSTERS = 65_536


def train(df: DataFrame, clusters: int, vector: str = "vector", max_iter: int = 20, seed: int = 42) -> np.ndarray:
    """Centroids by k-means|| and Lloyd rounds over all vectors, at most ``max_iter``, with a fixed seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if not 0 < clusters <= MAX_CLUSTERS:
        raise InvalidConfig(f"between 1 and {MAX_CLUSTERS} clusters")
    rows = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=clusters, maxIter=max_iter, seed=seed, initMode="k-means||").fit(rows)
    return np.array(model.clusterCenters())


def assign(df: DataFrame, centroids: np.ndarray, vector: str = "vector", name: str = "cid") -> DataFrame:
    """Rows with the number of their nearest centroid by Euclidean distance, ties to the first.

    The centroids, a bounded table, go to every task; blocks of vectors are multiplied with them.
    """
    c = np.asarray(centroids, np.float64)
    if len(c) > MAX_CLUSTERS:
        raise InvalidConfig(f"at most {MAX_CLUSTERS} centroids")
    half = (c * c).sum(1)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        out = pd.Series(np.zeros(len(v), np.int32), index=v.index)
        there = v.notna()
        if there.any():
            step = max(1, BLOCK_CELLS // max(1, *c.shape))
            rows = v[there].to_numpy()
            blocks = (np.stack(rows[i : i + step]).astype(np.float64) for i in range(0, len(rows), step))
            out[there] = np.concatenate([(half - 2 * m @ c.T).argmin(1).astype(np.int32) for m in blocks])
        return out

    return df.withColumn(name, nearest(F.col(vector)))


def probes(centroids: np.ndarray, query: Sequence[float], n: int) -> list[int]:
    """The ``n`` clusters whose centroids are nearest to the query."""
    d = ((np.asarray(centroids, np.float64) - np.asarray(query, np.float64)) ** 2).sum(1)
    return np.argsort(d, kind="stable")[:n].tolist()


def probe_search(assigned: DataFrame, centroids: np.ndarray, query: Sequence[float], k: int, n_probes: int, metric: str = COSINE, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """Exact distances within the nearest clusters; may give fewer than ``k`` rows.

    A table that was written with ``partitionBy("cid")`` is read in the probed folders only.
    """
    return knn(assigned.where(F.col("cid").isin(probes(centroids, query, n_probes))), query, k, metric, id_col=id_col, vector=vector)


def probe_batch(assigned: DataFrame, centroids: np.ndarray, queries: np.ndarray, query_ids: Sequence[int], k: int, n_probes: int, metric: str = COSINE) -> DataFrame:
    """Like :func:`probe_search` for a block of queries, in one pass: each cluster is searched for the queries that probe it."""
    probed = np.zeros((len(centroids), len(queries)), bool)
    for i, q in enumerate(queries):
        probed[probes(centroids, q, n_probes), i] = True
    return knn_batch(assigned, queries, query_ids, k, metric, cluster="cid", probed=probed)


def recall(found: DataFrame, exact: DataFrame, id_col: str | Sequence[str] = "id") -> DataFrame:
    """One row: how many of the exact hits were found, of how many, as a share. Hits are told apart by ``id_col``."""
    key = [id_col] if isinstance(id_col, str) else list(id_col)
    hit = exact.select(*key).join(found.select(*key).distinct(), key, "left_semi")
    n, m = hit.agg(F.count("*").alias("hits")), exact.agg(F.count("*").alias("wanted"))
    return n.join(F.broadcast(m)).withColumn("recall", F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("hits") / F.col("wanted")))


def lsh_candidates(df: DataFrame, query: Sequence[float], tables: int, bits: int, vector: str = "vector", seed: int = 7) -> DataFrame:
    """Rows that share a bucket of random hyperplanes with the query in any of the tables."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, len(query)))
    q = ((planes @ np.asarray(query, np.float64)) > 0).reshape(tables, bits)

    @F.pandas_udf("boolean")
    def meets(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, len(query)))
        sides = (m @ planes.T > 0).reshape(len(v), tables, bits)
        return pd.Series((sides == q).all(2).any(1), index=v.index)

    return df.where(F.col(vector).isNotNull()).where(meets(F.col(vector)))


def quantised_knn(df: DataFrame, codes: str, kind: str, dimensions: int, query: Sequence[float], k: int, metric: str = COSINE, id_col: str = "id") -> DataFrame:
    """The ``k`` nearest rows of a table that keeps codes: each row is decoded once and compared with the query as it is."""
    literal = F.array(*[F.lit(x) for x in check_query(query, dimensions)])
    away = F.get(F.transform(F.array(decoded(kind, F.col(codes), dimensions)), lambda v: distance(metric, v, literal)), F.lit(0))
    return df.withColumn("distance", away).orderBy("distance", id_col).limit(k)
