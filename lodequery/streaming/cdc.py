"""Write-ahead logs, change logs and replication: folds of ordered operations, in batch and in micro-batches.

A log has ``seq, op, id`` (op: insert, update, delete, clear), any payload columns,
and for replication ``ts`` (milliseconds) and ``origin``. Folds keep the last
operation of each id by aggregation, which is combined before the shuffle, so an
id with very many operations is no burden.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodequery.errors import InvalidConfig

STRATEGIES = ("keep_local", "apply_remote", "last_write_wins")


def _payload(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in ("seq", "op", "id")]


def _last(log: DataFrame) -> DataFrame:
    """The last operation of each id, one row an id."""
    cols = ["seq", "op", *_payload(log)]
    last = log.groupBy("id").agg(F.max_by(F.struct(*cols), "seq").alias("_x"))
    return last.select("id", *[F.col(f"_x.{c}").alias(c) for c in cols])


def fold(log: DataFrame) -> DataFrame:
    """The state after a replay: after the last clear, the last operation of each id that is no delete.

    Insert and update alike replace the row, so a replay may be repeated.
    """
    cleared = log.where("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_cleared"))
    after = log.where("op <> 'clear'").join(F.broadcast(cleared)).where(F.col("seq") > F.col("_cleared")).drop("_cleared")
    return _last(after).where("op <> 'delete'")


def valid_prefix(log: DataFrame, ok: str = "ok") -> DataFrame:
    """A log without its last record where that failed its check, as a torn tail does.

    A damaged record before the last is no torn tail: reading the result is an error, as the records behind it would be lost.
    """
    ends = log.agg(F.min(F.when(~F.col(ok), F.col("seq"))).alias("_broken"), F.max("seq").alias("_last"))
    damaged = F.raise_error(F.lit("a record before the last of the log is damaged")).cast("boolean")
    whole = F.when(F.col("_broken") < F.col("_last"), damaged).otherwise(F.col("_broken").isNull() | (F.col("seq") < F.col("_broken")))
    return log.join(F.broadcast(ends)).where(whole).drop("_broken", "_last")


def export_since(log: DataFrame, since: int) -> DataFrame:
    return log.where(F.col("seq") >= since)


def compact(log: DataFrame, exported: int, above: int = 10_000, keep: int = 5_000) -> DataFrame:
    """Beyond ``above`` entries, the newest ``keep`` exported ones and all that are not exported yet."""
    if log.limit(above + 1).count() <= above:
        return log
    done = F.col("seq") < exported
    newest = log.where(done).select("seq").orderBy(F.desc("seq")).limit(keep)
    oldest = newest.agg(F.min("seq").alias("_from"))
    return log.join(F.broadcast(oldest)).where(~done | (F.col("seq") >= F.col("_from"))).drop("_from")


def effective(log: DataFrame, base: DataFrame | None = None, has_vector: str | None = None) -> DataFrame:
    """The log with ``effective``: an insert of an id that is there is skipped, and so is a delete of one that is not.

    Whether an id is there before an operation follows from the operation before it. Inserts and updates
    without a vector have no effect and none on the others.
    """
    rows = log
    usable = F.lit(True) if has_vector is None else (F.col("op") == "delete") | F.coalesce(F.col(has_vector), F.lit(False))
    rows = rows.withColumn("_usable", usable)
    if base is not None:
        rows = rows.join(base.select("id").distinct().withColumn("_there", F.lit(True)), "id", "left")
    else:
        rows = rows.withColumn("_there", F.lit(None).cast("boolean"))
    before = F.lag("op").over(W.partitionBy("id", "_usable").orderBy("seq"))
    there = F.when(before.isNotNull(), before.isin("insert", "update")).otherwise(F.coalesce("_there", F.lit(False)))
    took = F.when(F.col("op") == "update", F.lit(True)).when(F.col("op") == "insert", ~there).otherwise(there)
    return rows.withColumn("effective", F.col("_usable") & took).drop("_usable", "_there")


def apply_changes(log: DataFrame, base: DataFrame | None = None, has_vector: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The state after the log is applied to ``base`` (id and payload columns), and one row: applied and skipped."""
    rows = effective(log, base, has_vector)
    counts = rows.agg(F.count_if("effective").alias("applied"), F.count_if(~F.col("effective")).alias("skipped"))
    last = _last(rows.where("effective").drop("effective"))
    state = last.where("op <> 'delete'").drop("op")
    if base is not None:
        kept = base.join(last.select("id"), "id", "left_anti")
        state = state.unionByName(kept, allowMissingColumns=True)
    return state, counts


def sync(remote: DataFrame, local: DataFrame, last_synced: int | None, strategy: str = "last_write_wins") -> DataFrame:
    """Remote changes after ``last_synced`` (None: all) that are to be applied, with ``conflict``.

    A change conflicts when the local log has an operation on its id. Of those, keep_local drops,
    apply_remote takes, and last_write_wins takes the ones that are not older.
    """
    if strategy not in STRATEGIES:
        raise InvalidConfig(f"unknown strategy {strategy!r}")
    new = remote if last_synced is None else remote.where(F.col("seq") > last_synced)
    pending = local.groupBy("id").agg(F.max_by("ts", "seq").alias("_local_ts"))
    rows = new.join(pending, "id", "left").withColumn("conflict", F.col("_local_ts").isNotNull())
    if strategy == "keep_local":
        rows = rows.where(~F.col("conflict"))
    elif strategy == "last_write_wins":
        rows = rows.where(~F.col("conflict") | (F.col("ts") >= F.col("_local_ts")))
    return rows.drop("_local_ts")


def tracked(changes: DataFrame, origin: str, start: int = 0, ts: str = "ts", ties: Sequence[str] = ("id", "op"), span_ms: int = 60_000) -> DataFrame:
    """Changes with ``origin`` and ``seq``, numbered without gaps from ``start`` by time and then by ``ties``.

    Rows are numbered within spans of time, whose counts are added up, so no task sees more than a span.
    """
    spans = changes.withColumn("_span", F.floor(F.col(ts) / span_ms))
    counts = spans.groupBy("_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_span").alias("_of"), before.alias("_before"))
    place = F.row_number().over(W.partitionBy("_span").orderBy(ts, *ties))
    numbered = spans.withColumn("_place", place).join(offsets, F.col("_span").eqNullSafe(F.col("_of")))
    return numbered.withColumns({"seq": start + F.col("_before") + F.col("_place") - 1, "origin": F.lit(origin)}).drop("_span", "_of", "_before", "_place")


def snapshot(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """What a replica starts from: the rows that have a vector."""
    return rows.where(F.col(vector).isNotNull())


def apply_snapshot(base: DataFrame, taken: DataFrame) -> DataFrame:
    """``base`` with the rows of a snapshot in place of its own of equal id."""
    return base.join(taken.select("id"), "id", "left_anti").unionByName(taken, allowMissingColumns=True)


def replication_state(known: DataFrame, synced: DataFrame) -> DataFrame:
    """How far each remote is: ``remote`` and ``last_synced``, from what was ``known`` and the changes ``synced`` (remote, seq)."""
    rows = known.select("remote", "last_synced").unionByName(synced.select("remote", F.col("seq").alias("last_synced")))
    return rows.groupBy("remote").agg(F.max("last_synced").alias("last_synced"))


def to_json(log: DataFrame) -> DataFrame:
    """One JSON document a change."""
    return log.select("seq", F.to_json(F.struct(*log.columns)).alias("json"))


def from_json(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("json", schema).alias("_j")).select("_j.*")


class StateTable:
    """A folded state in versioned Parquet folders, fed by batches.

    A version holds the last operation of every id, deletes included, so that a batch that is
    delivered again changes nothing. The newest version is named by the highest number; writing one
    is atomic, as a version without Spark's ``_SUCCESS`` is not read.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("v=")]
        return sorted(int(p.getName()[2:]) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def operations(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v={versions[-1]}") if versions else None

    def state(self) -> DataFrame | None:
        """The rows that are there, by the newest version."""
        ops = self.operations()
        return None if ops is None else ops.where("op <> 'delete' AND op <> 'clear'")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch of the log; a batch id that is not newer than the last version is ignored."""
        versions = self._versions()
        if versions and batch_id <= versions[-1]:
            return
        known = self.operations()
        rows = batch if known is None else known.unionByName(batch)
        cleared = rows.where("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_c"))
        live = _last(rows.join(F.broadcast(cleared)).where(F.col("seq") >= F.col("_c")).drop("_c"))
        live.select(*batch.columns).write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")


def stream_fold(changes: DataFrame, target: StateTable, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Start a query that merges a streaming log into ``target`` and ends when all input is read."""

    def each(batch: DataFrame, batch_id: int) -> None:
        target.upsert(batch, batch_id)
        if on_batch:
            on_batch(batch, batch_id)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
