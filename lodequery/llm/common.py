"""What several operators of this subpackage need: scratch tables and table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of an input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset and all tasks run on this machine, as in tests, a folder is made; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="lodequery-"))
    return _own_root[0]


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [named(c) for c in df.columns]


def named(name: str) -> Column:
    """The column of just this name, which may have dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    This cuts the lineage, survives the loss of executors and keeps what Python
    code yielded from being computed twice.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lodequery-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_hashes(df: DataFrame, name: str, **options: str) -> DataFrame:
    """:func:`materialise` for tables of hashes, which differ in most rows: no dictionary of them is made and looked up."""
    return materialise(df, name, **{"parquet.enable.dictionary": "false"}, **options)
