"""Registered queries: changes of stored tables and metadata indexes as layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodequery.functions import filters as fl
from lodequery.sources.store import Config, Store

from .changes import _folder
from .search import embeddings

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _store(spark, sf_dir, quantization: str = "none", rows: str = "true") -> Store:
    store = Store.create(spark, f"{_folder(spark)}/store", Config(64, "cosine", quantization), "label int")
    store.insert(_rows(spark, sf_dir).where(rows))
    return store


def _rows(spark, sf_dir):
    return embeddings(spark, sf_dir).withColumn("id", F.col("id").cast("string"))


@register("store_crud", "SELECT vec_id::VARCHAR AS id, CASE WHEN label = 3 THEN -1 ELSE label END AS label FROM embeddings WHERE label <> 2")
def store_crud(spark, sf_dir):
    s = _store(spark, sf_dir, rows="label <> 1")
    rows = _rows(spark, sf_dir)
    s.insert(rows.where("label = 1"))
    s.delete(rows.where("label = 2").select("id"))
    s.upsert(rows.where("label = 3").withColumn("label", F.lit(-1)))
    return Store.open(spark, s.path).df().select("id", "label")


@register("store_json_roundtrip", "SELECT vec_id::VARCHAR AS id, label, 64 AS dimensions FROM embeddings")
def store_json_roundtrip(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.export_json(f"{s.path}-export")
    s.clear()
    s.import_json(f"{s.path}-export")
    return s.df().select("id", "label", F.size("vector").alias("dimensions"))


@register("store_quantised_search", None)
def store_quantised_search(spark, sf_dir):
    s = _store(spark, sf_dir, "int8")
    q = list(_rows(spark, sf_dir).where("id = '0'").first()["vector"])
    return s.documents().page(q, 10).items.select("id", F.round("distance", 6).alias("distance"))


@register("metadata_index_lookup", "SELECT vec_id AS id FROM embeddings WHERE label = 4")
def metadata_index_lookup(spark, sf_dir):
    """A metadata index is a layout: rows in a folder for each value, of which a filter reads only its own."""
    path = f"{_folder(spark)}/by_label"
    embeddings(spark, sf_dir).write.partitionBy("label").parquet(path)
    df = spark.read.parquet(path)
    return df.where(fl.compile_filter(fl.eq("label", 4), fl.Columns(df))).select("id")
