"""The registered queries of the retrieval engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


Query = Callable[[SparkSession, str], DataFrame]
from . import ann, changes, memories, search, stores

MODULES: list = [search, ann, changes, memories, stores]


def queries() -> dict[str, Query]:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
