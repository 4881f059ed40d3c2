"""Exact nearest-neighbour search: top-k, filtered, paged, and for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodequery.errors import InvalidConfig
from lodequery.functions.distance import COSINE, DOT, EUCLIDEAN, MANHATTAN, distance_to, parse_distance

MAX_QUERIES = 4096
BLOCK_CELLS = 1 << 20  # distances that a task has at once
TILE_CELLS = 1 << 15
SLACK = 1e-12  # what a matrix product may be off, as a share of the sizes


def ranked(df: DataFrame, query: Sequence[float], metric: str, vector: str = "vector") -> DataFrame:
    """Rows that have a vector, with their ``distance`` to the query."""
    return df.where(F.col(vector).isNotNull()).withColumn("distance", distance_to(metric, F.col(vector), query))


def knn(
    df: DataFrame, query: Sequence[float], k: int, metric: str = COSINE, where: Column | None = None, offset: int = 0, id_col: str = "id", vector: str = "vector"
) -> DataFrame:
    """The ``k`` nearest rows after ``offset``, ties by id. A filter is applied before, so k of the rows that pass are found."""
    rows = df if where is None else df.where(where)
    out = ranked(rows, query, metric, vector).orderBy("distance", id_col)
    return out.offset(offset).limit(k) if offset else out.limit(k)


def page(df: DataFrame, query: Sequence[float], limit: int, offset: int, metric: str = COSINE, id_col: str = "id", vector: str = "vector") -> tuple[DataFrame, int]:
    """A page of the nearest rows and the number of rows that have a vector."""
    return knn(df, query, limit, metric, None, offset, id_col, vector), df.where(F.col(vector).isNotNull()).count()


def knn_batch(
    df: DataFrame,
    queries: np.ndarray,
    query_ids: Sequence[int],
    k: int,
    metric: str = COSINE,
    id_col: str = "id",
    vector: str = "vector",
    cluster: str | None = None,
    probed: np.ndarray | None = None,
) -> DataFrame:
    """``query_id, id, distance, rank`` of the ``k`` nearest rows of each query.

    The queries are a stated set of at most ``MAX_QUERIES`` and go to every task. A task multiplies
    blocks of vectors with them and keeps k rows a query, so the shuffle has k rows a query and task,
    however many rows there are; a block has at most ``BLOCK_CELLS`` distances. With ``cluster``, the
    number of a row's cluster, a query meets only rows of clusters for which ``probed`` (clusters x queries) is true.
    """
    metric = parse_distance(metric)
    if len(queries) > MAX_QUERIES:
        raise InvalidConfig(f"at most {MAX_QUERIES} queries at a time")
    q = np.asarray(queries, np.float64)
    names = np.asarray(query_ids)
    id_type = df.schema[id_col].dataType.simpleString()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Nearest(q, k, metric)
        for pdf in batches:
            groups = [(pdf, None)] if cluster is None else [(own, np.flatnonzero(probed[c])) for c, own in pdf.groupby("c")]
            for own, asked in groups:
                found.add(own["v"], own["id"].to_numpy(), asked)
        qi, ids, distances = found.rows()
        if len(qi):
            yield pd.DataFrame({"query_id": names[qi], "id": ids, "distance": distances})

    columns = [F.col(id_col).alias("id"), F.col(vector).alias("v")] + ([] if cluster is None else [F.col(cluster).alias("c")])
    partial = df.where(F.col(vector).isNotNull()).select(*columns).mapInPandas(best, f"query_id long, id {id_type}, distance double")
    w = W.partitionBy("query_id").orderBy("distance", "id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Nearest:
    """The k nearest of the rows seen so far for each of a block of queries, ties by id, in bounded memory.

    Matrix products of small blocks tell which rows may be among them; the distances of these are then
    summed place by place, as SQL does it, so that equal vectors are equally far away.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = queries, k, metric
        self.places = np.ascontiguousarray(queries.T)
        self.squares = _summed(self.places * self.places)
        self.kth = np.full(len(queries), np.inf)
        self.found: tuple | None = None

    def add(self, vectors: pd.Series, ids: np.ndarray, asked: np.ndarray | None = None) -> None:
        """More rows, for the queries ``asked`` (all if None)."""
        asked = np.arange(len(self.q)) if asked is None else asked
        step = max(1, BLOCK_CELLS // max(1, len(asked), self.q.shape[1] if self.q.ndim > 1 else 1))
        for i in range(0, len(vectors) if len(asked) and self.k > 0 else 0, step):
            self._block(np.stack(vectors.iloc[i : i + step].to_numpy()).astype(np.float64), ids[i : i + step], asked)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, ids and distances."""
        return self.found or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _block(self, m: np.ndarray, ids: np.ndarray, asked: np.ndarray) -> None:
        places = np.ascontiguousarray(m.T)
        squares = _summed(places * places)
        near, slack = self._about(m, squares, asked)
        kth = self.kth[asked, None]
        take = ~(near > (kth * kth if self.metric == EUCLIDEAN else kth) + slack)
        many = np.flatnonzero(take.sum(1) > self.k)
        if len(many):
            some = near[many]
            take[many] &= ~(some > np.partition(some, self.k - 1, 1)[:, self.k - 1 : self.k] + 2 * slack[many])
        qi, ri = np.nonzero(take)
        part = max(1, BLOCK_CELLS // 8)
        for i in range(0, len(qi), part):
            self._keep(asked[qi[i : i + part]], ri[i : i + part], places, squares, ids)

    def _about(self, m: np.ndarray, squares: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances (Euclidean ones squared) of queries and rows, and how far off a query's may be."""
        q, own = self.q[asked], self.squares[asked, None]
        if self.metric == MANHATTAN:
            near, step = np.zeros((len(m), len(q))), max(1, TILE_CELLS // len(q))
            own, tile = np.ascontiguousarray(q.T), np.empty((min(step, len(m)), len(q)))
            for i in range(0, len(m), step):  # in tiles that stay in a core's cache
                part = near[i : i + step]
                x = tile[: len(part)]
                for j, place in enumerate(own):
                    np.subtract(m[i : i + step, j, None], place, out=x)
                    part += np.abs(x, out=x)
            near = near.T
            return near, np.zeros((len(q), 1))
        near = q @ m.T
        largest = squares.max()
        if self.metric == EUCLIDEAN:
            near *= -2
            near += own
            near += squares
            return near, SLACK * (own + largest)
        if self.metric == DOT:
            return np.negative(near, out=near), SLACK * (own + largest)
        with np.errstate(invalid="ignore", divide="ignore"):
            near /= np.sqrt(own)
            near /= np.sqrt(squares)
        np.subtract(1, near, out=near)
        near[(own == 0)[:, 0]] = 1
        near[:, squares == 0] = 1
        return near, np.full((len(q), 1), SLACK)

    def _keep(self, qi: np.ndarray, ri: np.ndarray, places: np.ndarray, squares: np.ndarray, ids: np.ndarray) -> None:
        """Takes up those of the pairs that are among the k nearest of their query."""
        d = np.zeros(len(qi))
        for a, b in zip(self.places, places):
            x, y = a[qi], b[ri]
            d += np.abs(x - y) if self.metric == MANHATTAN else (x - y) ** 2 if self.metric == EUCLIDEAN else x * y
        if self.metric == EUCLIDEAN:
            d = np.sqrt(d)
        elif self.metric == DOT:
            d = -d
        elif self.metric == COSINE:
            sizes = np.sqrt(self.squares[qi] * squares[ri])
            with np.errstate(invalid="ignore", divide="ignore"):
                d = np.where(sizes == 0, 1.0, 1 - np.clip(d / sizes, -1, 1))
        new = ~(d > self.kth[qi])
        qi, found_ids, d = qi[new], ids[ri[new]], d[new]
        if not len(qi):
            return
        if self.found is not None:
            qi, found_ids, d = (np.concatenate(x) for x in zip(self.found, (qi, found_ids, d)))
        by_id = found_ids if found_ids.dtype != object else pd.Series(found_ids).rank(method="min", na_option="top").to_numpy()
        order = np.lexsort((by_id, d, qi))
        qi, found_ids, d = qi[order], found_ids[order], d[order]
        first = np.searchsorted(qi, qi, "left")
        rank = np.arange(len(qi)) - first
        self.kth[qi[rank == self.k - 1]] = d[rank == self.k - 1]
        stay = rank < self.k
        self.found = qi[stay], found_ids[stay], d[stay]


def _summed(rows: np.ndarray) -> np.ndarray:
    """The sum of the rows, one after the other."""
    out = np.zeros(rows.shape[1])
    for x in rows:
        out += x
    return out
