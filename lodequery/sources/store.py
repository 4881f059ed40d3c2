"""A table of documents on Parquet: create, open, change, look up, and exchange as JSON.

The table has ``id`` (unique), ``vector`` (array of floats, may be null) and any
metadata columns. Every change is a plan that writes a new version folder; a
reader sees the newest finished one. Checks run before anything is written.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.errors import AlreadyExists, DimensionMismatch, InvalidConfig, InvalidVector, NotFound
from lodequery.functions.distance import COSINE, all_finite, first_bad_index, parse_distance
from lodequery.functions.quantize import decoded, encoded
from lodequery.operators.hybrid import Documents


@dataclass(frozen=True)
class Config:
    """Dimensions, distance, quantisation (none, int8, int3, binary or polar) and text columns."""

    dimensions: int
    metric: str = COSINE
    quantization: str = "none"
    text: tuple[str, ...] = ()

    def __post_init__(self):
        if self.dimensions < 1:
            raise InvalidConfig("a vector has at least one dimension")
        parse_distance(self.metric)
        if self.quantization not in ("none", "int8", "int3", "binary", "polar"):
            raise InvalidConfig(f"unknown quantisation {self.quantization!r}")
        if self.quantization == "polar" and self.dimensions % 2:
            raise InvalidConfig("polar quantisation takes an even number of dimensions")


class Store:
    """Documents under one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, config: Config):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    # Files

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def _versions(self) -> list[int]:
        path, fs, root = self._fs()
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
        return sorted(int(p.getName()[2:]) for p in found if fs.exists(path(p, "_SUCCESS")))

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: Config, metadata: str = "") -> Store:
        """A new, empty table; ``metadata`` is a DDL list of further columns."""
        store = cls(spark, path, config)
        if store._versions():
            raise AlreadyExists(path)
        kind = "array<float>" if config.quantization == "none" else "array<int>"
        schema = f"id string, vector {kind}" + (f", {metadata}" if metadata else "")
        spark.createDataFrame([(json.dumps(asdict(config)),)], "config string").coalesce(1).write.mode("overwrite").json(f"{store.path}/config")
        store._write(spark.createDataFrame([], schema))
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        """The table that :meth:`create` made at ``path``."""
        store = cls(spark, path, Config(1))
        if not store._versions():
            raise NotFound(path)
        kept = json.loads(spark.read.json(f"{store.path}/config").first()["config"])
        store.config = Config(**(kept | {"text": tuple(kept["text"])}))
        return store

    def _write(self, df: DataFrame) -> None:
        number = (self._versions() or [-1])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={number}")

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the newest versions; running readers of older ones fail."""
        path, fs, _ = self._fs()
        for v in self._versions()[:-keep]:
            fs.delete(path(f"{self.path}/v={v}"), True)

    # Reading

    def stored(self) -> DataFrame:
        """The rows as they are kept, with codes for vectors where the table is quantised."""
        versions = self._versions()
        if not versions:
            raise NotFound(self.path)
        return self.spark.read.parquet(f"{self.path}/v={versions[-1]}")

    def df(self) -> DataFrame:
        """The rows with their vectors, decoded."""
        rows = self.stored()
        if self.config.quantization == "none":
            return rows
        v = F.when(F.col("vector").isNotNull(), decoded(self.config.quantization, F.col("vector"), self.config.dimensions).cast("array<float>"))
        return rows.withColumn("vector", v)

    def documents(self, deleted: str | None = None) -> Documents:
        """The table as something to search in."""
        return Documents(self.df(), "id", "vector", self.config.dimensions, self.config.metric, self.config.text, deleted)

    def get(self, id_: str) -> DataFrame:
        """The row with an id, if there is one; the id reaches the scan as a filter."""
        return self.df().where(F.col("id") == id_).limit(1)

    def contains(self, id_: str) -> bool:
        return not self.stored().where(F.col("id") == id_).isEmpty()

    def count(self) -> int:
        return self.stored().count()

    def is_empty(self) -> bool:
        return self.stored().isEmpty()

    def ids(self) -> DataFrame:
        return self.stored().select("id")

    # Changes

    def _checked(self, rows: DataFrame) -> DataFrame:
        """Rows with the table's columns, after one job that looks for wrong lengths, values and repeated ids."""
        if "vector" not in rows.columns:
            rows = rows.withColumn("vector", F.lit(None).cast("array<float>"))
        rows = rows.withColumn("vector", F.col("vector").cast("array<float>"))
        has = F.col("vector").isNotNull()
        bad = rows.select(
            F.when(has & (F.size("vector") != self.config.dimensions), F.size("vector")).alias("size"),
            F.when(has & ~all_finite(F.col("vector")), first_bad_index(F.col("vector"))).alias("at"),
        ).where("size IS NOT NULL OR at IS NOT NULL")
        found = bad.first()
        if found is not None and found["size"] is not None:
            raise DimensionMismatch(self.config.dimensions, found["size"])
        if found is not None:
            raise InvalidVector(f"value {found['at']} of a vector is not finite")
        twice = rows.groupBy("id").count().where("count > 1").first()
        if twice is not None:
            raise AlreadyExists(f"{twice['id']} is given more than once")
        if self.config.quantization != "none":
            rows = rows.withColumn("vector", F.when(has, encoded(self.config.quantization, F.col("vector"), self.config.dimensions)))
        return rows

    def insert(self, rows: DataFrame) -> None:
        """Add rows, all or none; an id that is there already is an error."""
        new, old = self._checked(rows), self.stored()
        clash = new.select("id").join(old.select("id"), "id", "left_semi").first()
        if clash is not None:
            raise AlreadyExists(clash["id"])
        self._write(old.unionByName(new, allowMissingColumns=True))

    def upsert(self, rows: DataFrame) -> None:
        """Put rows in the place of those with their ids, in full; others are added."""
        new = self._checked(rows)
        self._write(self.stored().join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True))

    update = upsert

    def delete(self, ids: DataFrame) -> int:
        """Remove the rows with the ids and tell how many there were."""
        old = self.stored()
        hit = old.join(ids.select("id").distinct(), "id", "left_semi").count()
        if hit:
            self._write(old.join(ids.select("id"), "id", "left_anti"))
        return hit

    def clear(self) -> None:
        """Remove all rows; columns and configuration stay."""
        self._write(self.stored().limit(0))

    # Exchange

    def export_json(self, path: str) -> None:
        """All rows as JSON lines of id, vector and metadata."""
        rows = self.df()
        meta = [c for c in rows.columns if c not in ("id", "vector")]
        out = rows.select("id", "vector", F.struct(*meta).alias("metadata")) if meta else rows.select("id", "vector")
        out.write.mode("overwrite").option("ignoreNullFields", True).json(path)

    def import_json(self, path: str) -> None:
        """Replace all rows by those of an export; it is checked as a whole before anything is replaced."""
        old = self.stored()
        meta = [f for f in old.schema.fields if f.name not in ("id", "vector")]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in meta)
        schema = "id string, vector array<float>" + (f", metadata struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in meta)}>" if kinds else "")
        rows = self.spark.read.schema(schema).json(path)
        rows = rows.select("id", "vector", *[F.col(f"metadata.`{f.name}`").alias(f.name) for f in meta])
        self._write(self._checked(rows).select(*old.columns))

    def ingest_markdown(self, files: DataFrame, chunk=None) -> int:
        """Cut files (``concept`` or ``name`` and ``text``) into chunks and add them without vectors; tells how many."""
        from lodequery.operators import chunking

        key = "concept" if "concept" in files.columns else "name"
        chunks = (chunk or chunking.by_heading)(files)
        rows = chunks.withColumn("id", F.concat(F.col(key), F.lit("#"), F.col("index"))).drop("chunk_id")
        keep = [c for c in self.stored().columns if c in rows.columns and c != "vector"]
        rows = rows.select(*keep)
        n = rows.count()
        self.insert(rows)
        return n


def read_markdown(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``name`` (the file's base name) and ``text`` of markdown files."""
    files = spark.read.text(paths, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))
