"""Registered queries: chunking, bundles, change logs and streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from lodequery.operators import bundles, chunking
from lodequery.session import table
from lodequery.errors import InvalidConfig
from lodequery.streaming import cdc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


TRIM = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
PARTS = f"list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {TRIM}), lambda x: x <> '')"


@register("chunk_paragraph", f"""WITH p AS (SELECT doc_id AS id, {PARTS} AS p FROM documents), g AS (SELECT id, p, len(p) AS n, greatest(1, ceil(len(p) / 3.0)::INTEGER) AS g FROM p WHERE len(p) > 0),
k AS (SELECT *, CASE WHEN g > 1 AND n - (g - 1) * 3 < 2 THEN g - 1 ELSE g END AS kept FROM g), c AS (SELECT *, unnest(range(kept)) AS i FROM k)
SELECT id, i::INTEGER AS "index", kept::INTEGER AS total, array_to_string(CASE WHEN i = kept - 1 THEN p[i * 3 + 1:] ELSE p[i * 3 + 1:i * 3 + 3] END, chr(10) || chr(10)) AS content FROM c""")
def chunk_paragraph(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunking.by_paragraph(d, 2, 3).select("id", "index", "total", "content")


@register("chunk_heading", rf"""WITH l AS (SELECT doc_id AS id, string_split('# D' || doc_id || chr(10) || replace(text, chr(10), chr(10) || '## part' || chr(10)), chr(10)) AS l FROM documents),
u AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM l), s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,2}}[ \t]+.') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS sec FROM u),
c AS (SELECT id, sec, {TRIM.replace('(x', "(string_agg(line, chr(10) ORDER BY pos)")} AS content, min_by(line, pos) AS first FROM s GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sec) - 1 AS i, count(*) OVER (PARTITION BY id) AS total FROM c WHERE content <> '')
SELECT id, i::INTEGER AS "index", total::INTEGER AS total, content, trim(regexp_extract(first, '^#{{1,2}}[ \t]+(.+)', 1)) AS heading, length(regexp_extract(first, '^(#+)', 1))::INTEGER AS level FROM n""")
def chunk_heading(spark, sf_dir):
    text = F.concat(F.lit("# D"), F.col("id"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## part\n")))
    return chunking.by_heading(_docs(spark, sf_dir).withColumn("text", text), 2).select("id", "index", "total", "content", "heading", "level")


@register("chunk_code", rf"""WITH t AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'intro' || chr(10) || '```py' || chr(10) || text || chr(10) || '```' || chr(10) || 'end' ELSE text END AS t, doc_id % 7 = 0 AS fenced, text FROM documents),
c AS (SELECT id, 0 AS i, 'intro' AS content, 'text' AS type, NULL AS language FROM t WHERE fenced UNION ALL SELECT id, 1, {TRIM.replace('(x', '(text')}, 'code', 'py' FROM t WHERE fenced UNION ALL SELECT id, 2, 'end', 'text', NULL FROM t WHERE fenced
UNION ALL SELECT id, 0, {TRIM.replace('(x', '(text')}, 'text', NULL FROM t WHERE NOT fenced)
SELECT id, i::INTEGER AS "index", content, type, language FROM c WHERE content <> ''""")
def chunk_code(spark, sf_dir):
    text = F.when(F.col("id") % 7 == 0, F.concat(F.lit("intro\n```py\n"), F.col("text"), F.lit("\n```\nend"))).otherwise(F.col("text"))
    return chunking.by_code_block(_docs(spark, sf_dir).withColumn("text", text)).select("id", "index", "content", "type", "language")


@register("chunk_size", None)
def chunk_size(spark, sf_dir):
    return chunking.by_size(_docs(spark, sf_dir), 500, 40).select("id", "index", "total", "content", "start", "end")


@register("chunk_size_rejoined", "SELECT doc_id AS id, sha256(text) AS digest FROM documents WHERE text <> ''")
def chunk_size_rejoined(spark, sf_dir):
    """Pieces without overlap give the text back."""
    c = chunking.by_size(_docs(spark, sf_dir), 300, 0)
    joined = c.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "content"))), lambda x: x["content"]), "").alias("t"))
    return joined.select("id", F.sha2("t", 256).alias("digest"))


@register("chunk_hybrid", None)
def chunk_hybrid(spark, sf_dir):
    text = F.concat(F.lit("# D"), F.col("id"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## part\n")))
    return chunking.hybrid(_docs(spark, sf_dir).withColumn("text", text), 1, 800, 20).select("id", "index", "total", "content", "heading", "level")


@register("chunk_stats", "WITH c AS (SELECT unnest(string_split(text, chr(10))) AS x FROM documents), t AS (SELECT strlen(" + TRIM + ") AS n FROM c) SELECT count(*) AS total_chunks, sum(n)::BIGINT AS total_size, (sum(n) // count(*))::BIGINT AS average_size FROM t WHERE n > 0")
def chunk_stats(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunking.stats(chunking.by_paragraph(d, 1, 1))


def _bundle(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("type: "), F.col("lang"), F.lit("\n")))
    head = F.concat(F.lit("---\n"), kind, F.lit('title: "T'), F.col("doc_id"), F.lit('"\ntags: [a, b]\nowner: me\n---\n'), F.col("text"))
    text = F.when(F.col("doc_id") % 17 == 0, F.col("text")).otherwise(head)
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id")).alias("concept"), text.alias("text"))


@register("bundle_ingest", """SELECT 'c' || doc_id AS concept, CASE WHEN doc_id % 17 = 0 THEN 'no frontmatter' WHEN doc_id % 10 = 0 THEN 'missing ''type'' field' END AS skipped,
CASE WHEN doc_id % 17 <> 0 AND doc_id % 10 <> 0 THEN lang END AS concept_type, CASE WHEN doc_id % 17 <> 0 THEN 'T' || doc_id END AS title, CASE WHEN doc_id % 17 <> 0 THEN 'a,b' END AS tags_text, CASE WHEN doc_id % 17 <> 0 THEN 'me' END AS owner FROM documents""")
def bundle_ingest(spark, sf_dir):
    c = bundles.concepts(_bundle(spark, sf_dir))
    return c.select("concept", "skipped", "concept_type", "title", "tags_text", F.col("extra")["x_owner"].alias("owner"))


@register("bundle_search", None)
def bundle_search(spark, sf_dir):
    chunks, _ = bundles.ingest(_bundle(spark, sf_dir), 1000, 0)
    return bundles.search(chunks, "license rights", 10, "en").select("id", "concept", "concept_type", "title", "snippet", F.round("score", 6).alias("score"))


@register("bundle_concepts", "SELECT DISTINCT 'c' || doc_id AS concept FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 10 <> 0 AND doc_id <> 11 AND text <> ''")
def bundle_concepts(spark, sf_dir):
    chunks, _ = bundles.ingest(_bundle(spark, sf_dir), 100_000, 0)
    return bundles.remove_concept(chunks, "c11").select("concept").distinct()


OPS = "CASE event_type WHEN 'purchase' THEN 'insert' WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END"
LOG = f"log AS (SELECT event_id AS seq, {OPS} AS op, user_id AS id, value, epoch_us(ts) // 1000 AS ts FROM events)"


def change_log(spark, sf_dir):
    """The events as a change log: the event's number, an operation by its type, and the user as the document."""
    op = F.when(F.col("event_type").isin("purchase", "signup"), "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("id"), "value", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ts")
    )


FOLD = "SELECT id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM {0} GROUP BY id HAVING arg_max(op, seq) <> 'delete'"


@register("cdc_fold", f"WITH {LOG} {FOLD.format('log')}")
def cdc_fold(spark, sf_dir):
    return cdc.fold(change_log(spark, sf_dir)).select("id", "seq", "op", "value")


@register("wal_clear_fold", f"WITH {LOG}, m AS (SELECT max(seq) // 2 AS c FROM log), l AS (SELECT log.* FROM log, m WHERE seq > c) {FOLD.format('l')}")
def wal_clear_fold(spark, sf_dir):
    log = change_log(spark, sf_dir)
    clear = log.agg(F.floor(F.max("seq") / 2).alias("seq")).select("seq", F.lit("clear").alias("op"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("ts"))
    return cdc.fold(log.unionByName(clear)).select("id", "seq", "op", "value")


@register("wal_torn_tail", f"WITH {LOG} SELECT count(*) AS n, max(seq) AS last FROM log WHERE seq < (SELECT max(seq) FROM log)")
def wal_torn_tail(spark, sf_dir):
    log = change_log(spark, sf_dir)
    torn = log.join(F.broadcast(log.agg(F.max("seq").alias("torn")))).withColumn("ok", F.col("seq") != F.col("torn")).drop("torn")
    return cdc.valid_prefix(torn).agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@register("cdc_track", f"WITH {LOG} SELECT 7 + row_number() OVER (ORDER BY ts, id, op, value) - 1 AS seq, ts, id, op, value, 'here' AS origin FROM log")
def cdc_track(spark, sf_dir):
    changes = change_log(spark, sf_dir).drop("seq")
    return cdc.tracked(changes, "here", 7, ties=("id", "op", "value"), span_ms=3_600_000).select("seq", "ts", "id", "op", "value", "origin")


@register("cdc_snapshot", "SELECT vec_id AS id, CASE WHEN label < 3 THEN -1 ELSE label END AS label FROM embeddings")
def cdc_snapshot(spark, sf_dir):
    """A replica that has old rows of all documents takes a snapshot of those of which the vector is known."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    held = rows.withColumn("vector", F.when(F.col("label") >= 3, F.col("vector")))
    return cdc.apply_snapshot(rows.withColumn("label", F.lit(-1)), cdc.snapshot(held)).select("id", "label")


@register("cdc_replication_state", f"WITH {LOG} SELECT op AS remote, greatest(max(seq), 500) AS last_synced FROM log GROUP BY op")
def cdc_replication_state(spark, sf_dir):
    log = change_log(spark, sf_dir).withColumn("remote", F.col("op"))
    known = log.select("remote", F.lit(500).cast("long").alias("last_synced")).distinct()
    return cdc.replication_state(known, log)


APPLY = f"""{LOG}, b AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 3 = 0), u AS (SELECT *, op = 'delete' OR seq % 5 <> 0 AS usable FROM log),
p AS (SELECT u.*, lag(op) OVER (PARTITION BY u.id, usable ORDER BY seq) AS before, b.id IS NOT NULL AS base FROM u LEFT JOIN b ON b.id = u.id),
f AS (SELECT *, usable AND CASE op WHEN 'update' THEN true WHEN 'insert' THEN NOT coalesce(before IN ('insert', 'update'), base) ELSE coalesce(before IN ('insert', 'update'), base) END AS eff FROM p)"""


def _applied(spark, sf_dir):
    log = change_log(spark, sf_dir).withColumn("vec", F.col("seq") % 5 != 0)
    base = table(spark, sf_dir, "events").where("user_id % 3 = 0").select(F.col("user_id").alias("id"), F.lit(-1.0).alias("value")).distinct()
    return cdc.apply_changes(log, base, "vec")


@register("cdc_apply_state", f"WITH {APPLY}, l AS (SELECT id, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM f WHERE eff GROUP BY id) SELECT id, value FROM l WHERE op <> 'delete' UNION ALL SELECT id, -1.0 FROM b WHERE id NOT IN (SELECT id FROM l)")
def cdc_apply_state(spark, sf_dir):
    return _applied(spark, sf_dir)[0].select("id", "value")


@register("cdc_apply_counts", f"WITH {APPLY} SELECT count(*) FILTER (eff) AS applied, count(*) FILTER (NOT eff) AS skipped FROM f")
def cdc_apply_counts(spark, sf_dir):
    return _applied(spark, sf_dir)[1]


SYNC = f"WITH {LOG}, l AS (SELECT id, arg_max(ts, seq) AS lts FROM log WHERE seq % 2 = 0 AND id % 4 = 0 GROUP BY id), r AS (SELECT log.*, lts IS NOT NULL AS conflict, lts FROM log LEFT JOIN l USING (id) WHERE seq % 2 = 1 AND seq > 100)"


def _sync(strategy):
    def run(spark, sf_dir):
        log = change_log(spark, sf_dir)
        local = log.where("seq % 2 = 0 AND id % 4 = 0")
        return cdc.sync(log.where("seq % 2 = 1"), local, 100, strategy).select("seq", "id", "op", "conflict")

    return run


register("cdc_lww", f"{SYNC} SELECT seq, id, op, conflict FROM r WHERE NOT conflict OR ts >= lts")(_sync("last_write_wins"))
register("cdc_keep_local", f"{SYNC} SELECT seq, id, op, conflict FROM r WHERE NOT conflict")(_sync("keep_local"))
register("cdc_apply_remote", f"{SYNC} SELECT seq, id, op, conflict FROM r")(_sync("apply_remote"))


@register("cdc_compact", f"WITH {LOG}, n AS (SELECT seq FROM log WHERE seq < 600 ORDER BY seq DESC LIMIT 200) SELECT seq, op, id FROM log WHERE seq >= 600 OR seq IN (SELECT seq FROM n)")
def cdc_compact(spark, sf_dir):
    return cdc.compact(change_log(spark, sf_dir), 600, 500, 200).select("seq", "op", "id")


@register("cdc_export_since", f"WITH {LOG} SELECT seq, op, id FROM log WHERE seq >= 900")
def cdc_export_since(spark, sf_dir):
    return cdc.export_since(change_log(spark, sf_dir), 900).select("seq", "op", "id")


@register("cdc_json_roundtrip", f"WITH {LOG} SELECT seq, op, id, value, ts FROM log")
def cdc_json_roundtrip(spark, sf_dir):
    return cdc.from_json(cdc.to_json(change_log(spark, sf_dir)), "seq long, op string, id long, value double, ts long")


def _folder(spark) -> str:
    """A new folder in the shared place that the cluster names; where all tasks run on this machine, a local one will do."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise InvalidConfig("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodequery-stream-")
    return f"{root}/lodequery-stream-{uuid.uuid4().hex}"


@register("stream_cdc_upsert", f"WITH {LOG} {FOLD.format('log')}")
def stream_cdc_upsert(spark, sf_dir):
    folder = _folder(spark)
    change_log(spark, sf_dir).repartition(4, "seq").write.parquet(f"{folder}/log")
    stream = spark.readStream.schema("seq long, op string, id long, value double, ts long").option("maxFilesPerTrigger", 2).parquet(f"{folder}/log")
    target = cdc.StateTable(spark, f"{folder}/state")
    cdc.stream_fold(stream, target, f"{folder}/checkpoint").awaitTermination()
    return target.state().select("id", "seq", "op", "value")
