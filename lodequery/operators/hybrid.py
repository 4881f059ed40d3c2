"""The four search modes, their filters, orders and pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.errors import FulltextNotEnabled, InvalidConfig
from lodequery.functions.distance import COSINE, check_query, distance_to
from lodequery.functions.filters import Columns, Filter, compile_filter

from . import bm25
from .fusion import RRF_K, rank_first


@dataclass(frozen=True)
class OrderBy:
    """One top-level field; missing values come last ascending and first descending."""

    field: str
    descending: bool = False

    def columns(self, id_col: str) -> list[Column]:
        c = F.col(f"`{self.field}`")
        return [c.desc_nulls_first() if self.descending else c.asc_nulls_last(), F.col(id_col)]


@dataclass(frozen=True)
class Search:
    """What to search for. ``mode`` is vector, keyword, hybrid or filter."""

    mode: str
    k: int
    vector: tuple[float, ...] | None = None
    text: str | None = None
    where: Filter | None = None
    offset: int = 0
    order_by: OrderBy | None = None
    vector_weight: float = 0.5
    keyword_weight: float = 0.5
    rrf_k: int = RRF_K

    @staticmethod
    def by_vector(vector: Sequence[float], k: int) -> Search:
        return Search("vector", k, vector=tuple(vector))

    @staticmethod
    def by_keyword(text: str, k: int) -> Search:
        return Search("keyword", k, text=text)

    @staticmethod
    def hybrid(vector: Sequence[float], text: str, k: int) -> Search:
        return Search("hybrid", k, vector=tuple(vector), text=text)

    @staticmethod
    def filter_only(where: Filter, k: int) -> Search:
        return Search("filter", k, where=where)

    def with_filter(self, where: Filter) -> Search:
        return replace(self, where=where)

    def with_offset(self, offset: int) -> Search:
        return replace(self, offset=offset)

    def with_order(self, order_by: OrderBy) -> Search:
        return replace(self, order_by=order_by)

    def with_weights(self, vector_weight: float, keyword_weight: float) -> Search:
        return replace(self, mode="hybrid", vector_weight=vector_weight, keyword_weight=keyword_weight)


@dataclass(frozen=True)
class Page:
    """A page of a listing with the number of all rows; a limit of 0 has no pages."""

    items: DataFrame
    total: int
    offset: int
    limit: int

    @property
    def has_more(self) -> bool:
        return self.offset + self.limit < self.total

    @property
    def total_pages(self) -> int:
        return -(-self.total // self.limit) if self.limit else 0

    @property
    def current_page(self) -> int:
        return self.offset // self.limit if self.limit else 0


class Documents:
    """A table of documents with an optional vector, optional text columns and any metadata columns."""

    def __init__(
        self,
        df: DataFrame,
        id_col: str = "id",
        vector: str | None = None,
        dimensions: int | None = None,
        metric: str = COSINE,
        text: Sequence[str] = (),
        deleted: str | None = None,
        indexed: DataFrame | None = None,
    ):
        self.df, self.id, self.vector, self.dimensions, self.metric = df, id_col, vector, dimensions, metric
        self.text, self.deleted, self._indexed = tuple(text), deleted, indexed

    def live(self) -> Column:
        """False for rows that are marked as deleted."""
        return ~F.coalesce(F.col(self.deleted), F.lit(False)) if self.deleted else F.lit(True)

    def passes(self, where: Filter | None) -> Column:
        return self.live() & compile_filter(where, Columns(self.df)) if where is not None else self.live()

    def indexed(self) -> DataFrame:
        if not self.text:
            raise FulltextNotEnabled("no text columns were named")
        if self._indexed is not None:
            return self._indexed
        return bm25.index(self.df, F.concat_ws(" ", *self.text), self.id)

    def search(self, s: Search) -> DataFrame:
        """``id, score`` (lower is better), distances, BM25 scores and ranks from 0, with all columns of the documents."""
        if s.vector is not None:
            check_query(s.vector, self.dimensions)
        run = {"vector": self._by_vector, "keyword": self._by_keyword, "hybrid": self._hybrid, "filter": self._filter_only}.get(s.mode)
        if run is None:
            raise InvalidConfig(f"unknown mode {s.mode!r}")
        out = run(s).orderBy(*(s.order_by.columns(self.id) if s.order_by else [F.col("score"), F.col(self.id)]))
        return (out.offset(s.offset) if s.offset else out).limit(s.k)

    def _shaped(self, df: DataFrame, **cols: Column) -> DataFrame:
        empty = {"vector_distance": "double", "bm25_score": "double", "vector_rank": "int", "keyword_rank": "int"}
        return df.withColumns({k: F.lit(None).cast(t) for k, t in empty.items()} | cols)

    def _by_vector(self, s: Search) -> DataFrame:
        if s.vector is None or self.vector is None:
            raise InvalidConfig("vector mode takes a vector")
        rows = self.df.where(self.passes(s.where)).where(F.col(self.vector).isNotNull())
        rows = rows.withColumn("_d", distance_to(self.metric, F.col(self.vector), s.vector))
        if s.order_by:
            return self._shaped(rows, score=F.col("_d"), vector_distance=F.col("_d")).drop("_d")
        rows = rank_first(rows, ["_d", self.id], s.k + s.offset, "_r")
        return self._shaped(rows, score=F.col("_d"), vector_distance=F.col("_d"), vector_rank=F.col("_r")).drop("_d", "_r")

    def _by_keyword(self, s: Search) -> DataFrame:
        if s.text is None:
            raise InvalidConfig("keyword mode takes a text")
        hits = bm25.scored(self.indexed(), s.text).select(self.id, "bm25")
        if s.where is None and self.deleted is None and s.order_by is None:
            hits = rank_first(hits, [F.desc("bm25"), self.id], s.k + s.offset, "_r")
            rows = self.df.join(F.broadcast(hits), self.id)
            return self._shaped(rows, score=-F.col("bm25"), bm25_score=F.col("bm25"), keyword_rank=F.col("_r")).drop("bm25", "_r")
        rows = self.df.where(self.passes(s.where)).join(hits, self.id)
        return self._shaped(rows, score=-F.col("bm25"), bm25_score=F.col("bm25")).drop("bm25")

    def _filter_only(self, s: Search) -> DataFrame:
        return self._shaped(self.df.where(self.passes(s.where)), score=F.lit(0.0))

    def _hybrid(self, s: Search) -> DataFrame:
        """Both lists are cut at a level before the filter; the level doubles until enough rows pass."""
        need = s.k + s.offset
        sizes = self.df.agg(F.count("*").alias("n"), F.count_if(F.col(self.vector).isNotNull() if self.vector else F.lit(False)).alias("v")).first()
        ceiling = max(sizes["n"] if self.text else 0, sizes["v"])
        level = min(2 * need, ceiling) or 1
        if s.order_by:
            level = max(ceiling, 1)
        sure = s.where is None and self.deleted is None and s.vector is not None and sizes["v"] >= need
        while True:
            last = sure or level >= ceiling
            found = self._fused(s, level, not last)
            if last or found.limit(need).count() >= need:
                return found
            level = min(2 * level, ceiling)

    def _fused(self, s: Search, level: int, again: bool = False) -> DataFrame:
        """The rows that pass of both lists; with ``again`` the lists, of at most ``level`` rows each, are kept for a second use."""
        lists = []
        if s.vector is not None and self.vector is not None:
            near = self.df.where(F.col(self.vector).isNotNull()).select(self.id, distance_to(self.metric, F.col(self.vector), s.vector).alias("vector_distance"))
            lists.append(rank_first(near, ["vector_distance", self.id], level, "vector_rank"))
        if s.text is not None and self.text:
            hits = bm25.scored(self.indexed(), s.text).select(self.id, F.col("bm25").alias("bm25_score"))
            lists.append(rank_first(hits, [F.desc("bm25_score"), self.id], level, "keyword_rank"))
        if not lists:
            return self._shaped(self.df.where(F.lit(False)), score=F.lit(0.0))
        both = lists[0] if len(lists) == 1 else lists[0].join(lists[1], self.id, "full_outer")
        score = F.lit(0.0)
        for rank, weight in (("vector_rank", s.vector_weight), ("keyword_rank", s.keyword_weight)):
            if rank in both.columns:
                score = score + F.when(F.col(rank).isNotNull(), weight / (s.rrf_k + F.col(rank) + 1)).otherwise(0.0)
        both = both.withColumn("score", -score)
        both = both.persist() if again else both
        rows = self.df.where(self.passes(s.where)).join(F.broadcast(both) if level <= 100_000 else both, self.id)
        missing = {k: F.lit(None).cast(t) for k, t in {"vector_distance": "double", "bm25_score": "double", "vector_rank": "int", "keyword_rank": "int"}.items() if k not in both.columns}
        return rows.withColumns(missing) if missing else rows

    def list(self, where: Filter | None = None, order_by: OrderBy | None = None, limit: int = 100, offset: int = 0) -> Page:
        """A page of the live rows that pass, by the order and then by id."""
        rows = self.df.where(self.passes(where))
        out = rows.orderBy(*(order_by.columns(self.id) if order_by else [F.col(self.id)]))
        return Page((out.offset(offset) if offset else out).limit(limit), rows.count(), offset, limit)

    def page(self, vector: Sequence[float], limit: int, offset: int = 0) -> Page:
        """A page of the nearest rows, deleted ones included, as plain search has them."""
        query = check_query(vector, self.dimensions)
        rows = self.df.where(F.col(self.vector).isNotNull())
        out = rows.withColumn("distance", distance_to(self.metric, F.col(self.vector), query)).orderBy("distance", self.id)
        return Page((out.offset(offset) if offset else out).limit(limit), rows.count(), offset, limit)

    def view(self, where: Filter, metric: str | None = None) -> Documents:
        """A partial index: the rows that pass a filter, searched by a metric of their own."""
        return Documents(self.df.where(compile_filter(where, Columns(self.df))), self.id, self.vector, self.dimensions, metric or self.metric, self.text, None, None)
