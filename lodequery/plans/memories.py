"""Registered queries: memory scores and recalls, presets, transfer and agent records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodequery.operators import agent, memory, presets, transfer
from lodequery.operators.hybrid import Documents
from lodequery.session import table

from .search import METRICS, Q0, bm25_sql, vector_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = 1_706_745_600  # 2024-02-01T00:00:00Z
CONTEXT = memory.Context("7", "user", "education")


def register(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def memories(spark, sf_dir):
    """Conversation turns as memories: counters and times follow from the turn, the embedding from the conversation."""
    c = table(spark, sf_dir, "conversations").withColumn("vec_id", F.col("conv_id") % 500)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    t = F.col("turn")
    rows = c.join(e, "vec_id").select(
        (F.col("conv_id") * 100 + t).alias("id"), F.col("text").alias("content"), "vector", F.col("role").alias("context"),
        (F.col("conv_id") % 10).cast("string").alias("instance_id"), t.alias("_access_count"), F.floor(t / 2).alias("_useful_count"),
        (F.lit(NOW) - t * 86_400).alias("_last_accessed"), (F.lit(NOW) - t * 864_000).alias("_created_at"),
    )
    return memory.learned(rows, presets.CONVERSATIONAL, NOW)


def any_sql(text: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def classify_sql(p, text: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(text, w)} THEN '{d}'" for d, w in p.domains) + f" ELSE '{p.other_domain}' END"


def concepts_sql(p, text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {any_sql(text, w)} THEN '{c}' END" for c, w in p.concepts) + "], lambda x: x IS NOT NULL)"


def priority_sql(p, text: str) -> str:
    return f"CASE WHEN {any_sql(text, p.critical)} THEN 'critical' WHEN {any_sql(text, p.high)} THEN 'high' WHEN {any_sql(text, p.low)} THEN 'low' ELSE 'normal' END"


def level_sql(p, text: str) -> str:
    own = any_sql(text, presets.INSTANCE_PHRASES)
    n = f"len(list_filter(cs, lambda x: x IN {p.universal!r}))"
    return f"CASE WHEN {n} >= 2 THEN 'universal' WHEN {own} THEN 'instance' WHEN {n} >= 1 THEN 'domain' ELSE 'context' END"


P = presets.CONVERSATIONAL
BASE = f"""c0 AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, text, role, embedding, ' ' || lower(text) AS low, lower(text) AS plain FROM conversations JOIN embeddings ON vec_id = conv_id % 500),
c1 AS (SELECT *, {classify_sql(P, 'plain')} AS domain, {concepts_sql(P, 'low')} AS cs, {priority_sql(P, "low || ' '")} AS priority FROM c0),
c2 AS (SELECT *, {level_sql(P, 'plain')} AS level FROM c1),
c3 AS (SELECT *, greatest(0, least(1, 0.25 * CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 0.75 WHEN 'low' THEN 0.25 ELSE 0.5 END + 0.15 * least(log2(turn + 1) / 10, 1)
  + 0.2 * CASE WHEN turn > 0 THEN (turn // 2) / turn ELSE 0.5 END + 0.4 * exp(-turn * 24 / 168.0)))::DOUBLE * CASE WHEN priority IN ('critical', 'high') THEN 1 ELSE greatest(pow(0.5, turn * 10 / 7.0), 0.2) END AS pscore FROM c2)"""


@register("memory_learned", f"WITH {BASE} SELECT id, domain, array_to_string(cs, ',') AS concepts, priority, level AS transfer_level FROM c2")
def memory_learned(spark, sf_dir):
    return memories(spark, sf_dir).select("id", "domain", "concepts", "priority", "transfer_level")


@register("memory_priority_score", f"WITH {BASE} SELECT id, round(pscore, 6) AS score FROM c3")
def memory_priority_score(spark, sf_dir):
    score = memory.priority_score(NOW, P.decay, P.weights)
    return memories(spark, sf_dir).select("id", F.round(score, 6).alias("score"))


TRANSFER = """CASE level WHEN 'universal' THEN 1 WHEN 'context' THEN cc * 0.5 + dd * 0.3 + 0.2 WHEN 'domain' THEN dd * 0.6 + 0.4 ELSE CASE WHEN conv_id % 10 = 7 THEN 0.6 ELSE 0 END + cc * 0.2 + dd * 0.2 END::DOUBLE"""
# The context is a role, of no language group or family; education is no knowledge domain, so any stored domain that is none either counts as the same.
COMPAT = "c4 AS (SELECT *, CASE WHEN role = 'user' THEN 1.0 ELSE 0.4 END::DOUBLE AS cc, 1.0::DOUBLE AS dd FROM c3)"


@register("memory_transfer_score", f"WITH {BASE}, {COMPAT} SELECT id, round({TRANSFER}, 6) AS score FROM c4")
def memory_transfer_score(spark, sf_dir):
    return memories(spark, sf_dir).select("id", F.round(memory.transfer_score(P, CONTEXT, F.col("transfer_level")), 6).alias("score"))


RECALL = f"""WITH {BASE}, {COMPAT}, d AS (SELECT id, level, conv_id, cc, dd, pscore, {METRICS['cosine']} AS d FROM c4, (SELECT {Q0} AS q)), n AS (SELECT * FROM d ORDER BY d, id LIMIT 30),
s AS (SELECT id, d, pscore, {TRANSFER} AS t FROM n) SELECT id, round((1 - d) * 0.4 + t * 0.3 + pscore * 0.3, 6) AS score FROM s WHERE t >= 0.3 ORDER BY (1 - d) * 0.4 + t * 0.3 + pscore * 0.3 DESC, id LIMIT 10"""


@register("memory_recall", RECALL)
def memory_recall(spark, sf_dir):
    out = memory.recall(memories(spark, sf_dir), vector_of(spark, sf_dir, 0), 10, P, NOW, CONTEXT)
    return out.select("id", F.round("combined_score", 6).alias("score"))


@register("memory_high_priority", f"WITH {BASE}, d AS (SELECT id, pscore, {METRICS['cosine']} AS d FROM c3, (SELECT {Q0} AS q) WHERE priority IN ('critical', 'high')), n AS (SELECT * FROM d ORDER BY d, id LIMIT 10) SELECT id, round(pscore, 6) AS score FROM n ORDER BY pscore DESC, id LIMIT 5")
def memory_high_priority(spark, sf_dir):
    out = memory.recall_high_priority(memories(spark, sf_dir), vector_of(spark, sf_dir, 0), 5, P, NOW)
    return out.select("id", F.round("priority_score", 6).alias("score"))


def _where(name: str, where: str, f):
    sql = f"WITH {BASE}, d AS (SELECT id, {METRICS['cosine']} AS d FROM c3, (SELECT {Q0} AS q) WHERE {where}) SELECT id, round(1 - d, 6) AS score FROM d ORDER BY d, id LIMIT 8"

    @register(name, sql)
    def run(spark, sf_dir):
        return f(memories(spark, sf_dir), vector_of(spark, sf_dir, 0)).select("id", F.round("combined_score", 6).alias("score"))


_where("memory_recall_universal", "level = 'universal'", lambda m, q: memory.recall_universal(m, q, 8))
_where("memory_recall_domain", "domain = 'casual'", lambda m, q: memory.recall_same_domain(m, q, 8, "casual"))
_where("memory_recall_context", "role = 'system'", lambda m, q: memory.recall_same_context(m, q, 8, "system"))
_where("memory_recall_critical", "priority = 'critical'", lambda m, q: memory.recall_critical(m, q, 8))


@register("memory_record_access", f"WITH {BASE} SELECT id, turn + CASE WHEN turn = 1 THEN 1 ELSE 0 END AS accesses, CASE WHEN turn = 1 THEN {NOW} ELSE {NOW} - turn * 86400 END AS last FROM c0")
def memory_record_access(spark, sf_dir):
    m = memories(spark, sf_dir)
    out = memory.record_access(m, m.where("_access_count = 1").select("id"), NOW)
    return out.select("id", F.col("_access_count").alias("accesses"), F.col("_last_accessed").alias("last"))


@register("memory_stats", "SELECT count(*) AS total, sum(turn)::BIGINT AS accesses, sum(turn // 2)::BIGINT AS useful, round(avg(CASE WHEN turn > 0 THEN (turn // 2) / turn END), 6) AS avg_usefulness FROM conversations JOIN embeddings ON vec_id = conv_id % 500")
def memory_stats(spark, sf_dir):
    return memory.memory_stats(memories(spark, sf_dir)).withColumn("avg_usefulness", F.round("avg_usefulness", 6))


DECAYS = {"default": (memory.Decay(), "CASE WHEN p = 'critical' THEN 1 ELSE greatest(pow(0.5, age / 2592000), 0.1) END"),
          "fast": (memory.Decay.fast(), "CASE WHEN p IN ('critical', 'high') THEN 1 ELSE greatest(pow(0.5, age / 604800), 0.2) END"),
          "slow": (memory.Decay.slow(), "CASE WHEN p = 'critical' THEN 1 ELSE greatest(pow(0.5, age / 7776000), 0.05) END")}


@register("memory_decay_presets", "WITH a AS (SELECT event_id AS id, (1706745600 - epoch_us(ts) // 1000000)::DOUBLE AS age, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' ELSE 'normal' END AS p FROM events) SELECT id, " + ", ".join(f"round(({s})::DOUBLE, 6) AS d_{k}" for k, (_, s) in DECAYS.items()) + " FROM a")
def memory_decay_presets(spark, sf_dir):
    age = (F.lit(NOW) - F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).cast("double")
    p = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").otherwise("normal")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), *[F.round(d.factor(age, p), 6).alias(f"d_{k}") for k, (d, _) in DECAYS.items()])


# Texts with words of the presets in them, so that every rule is met: the words of all rules, cut into rows of three.
def _samples() -> list[tuple[int, str]]:
    words = []
    for p in (presets.SOFTWARE, presets.CONVERSATIONAL, presets.SERVICE):
        for group in (*[w for _, w in p.domains], *[w for _, w in p.concepts], p.critical, p.high, p.low):
            words += group
    words += [*transfer.PATTERNS, *transfer.DOMAIN_CONCEPTS, *transfer.PRINCIPLES, *presets.INSTANCE_PHRASES]
    return [(i, f"Text {w} {words[(i * 7 + 3) % len(words)].upper()}") for i, w in enumerate(words)]


SAMPLES = "(VALUES " + ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in _samples()) + ") s(id, text)"


def _preset(key: str, p):
    text = "SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - id, text FROM " + SAMPLES

    def rows(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
        made = spark.createDataFrame(_samples(), "id long, text string").select((-1 - F.col("id")).alias("id"), "text")
        return docs.unionByName(made)

    @register(f"preset_{key}_classify", f"WITH t AS (SELECT id, lower(text) AS low FROM ({text})) SELECT id, {classify_sql(p, 'low')} AS domain FROM t")
    def classify(spark, sf_dir):
        return rows(spark, sf_dir).select("id", p.classify(F.col("text")).alias("domain"))

    @register(f"preset_{key}_concepts", f"WITH t AS (SELECT id, lower(text) AS plain, ' ' || lower(text) AS low FROM ({text})), c AS (SELECT *, {concepts_sql(p, 'low')} AS cs FROM t) SELECT id, array_to_string(cs, ',') AS concepts, {level_sql(p, 'plain')} AS level FROM c")
    def concepts(spark, sf_dir):
        found = p.extract(F.lit(""), F.col("text"))
        return rows(spark, sf_dir).withColumn("c", found).select("id", F.array_join("c", ",").alias("concepts"), p.transfer_level(F.col("c"), F.col("text")).alias("level"))

    @register(f"preset_{key}_priority", f"WITH t AS (SELECT id, lower(text) AS low FROM ({text})) SELECT id, {priority_sql(p, 'low')} AS priority FROM t")
    def priority(spark, sf_dir):
        return rows(spark, sf_dir).select("id", p.priority(F.col("text")).alias("priority"))


for _key, _p in (("software", presets.SOFTWARE), ("conversational", presets.CONVERSATIONAL), ("service", presets.SERVICE)):
    _preset(_key, _p)

TABLE = transfer.PATTERNS | transfer.DOMAIN_CONCEPTS | transfer.PRINCIPLES
CONCEPTS = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{v}' END" for k, v in TABLE.items()) + "], lambda x: x IS NOT NULL)))"
XLEVEL = f"CASE WHEN list_has_any(cs, {list(transfer.PRINCIPLES.values())!r}) THEN 'universal' WHEN len(cs) > 0 THEN 'domain' ELSE 'context' END"


def _texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 3 == 0, "go").when(F.col("doc_id") % 3 == 1, "python").alias("language"))
    return docs.unionByName(spark.createDataFrame(_samples(), "id long, text string").select((-1 - F.col("id")).alias("id"), "text", F.lit("rust").alias("language")))


XROWS = "SELECT doc_id AS id, text, CASE doc_id % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'python' END AS language FROM documents UNION ALL SELECT -1 - id, text, 'rust' FROM " + SAMPLES


@register("transfer_concepts", f"WITH x AS ({XROWS}), c AS (SELECT id, {CONCEPTS} AS cs FROM x) SELECT id, array_to_string(cs, ',') AS concepts, {XLEVEL} AS level FROM c")
def transfer_concepts(spark, sf_dir):
    c = _texts(spark, sf_dir).select("id", transfer.concepts(F.col("text")).alias("c"))
    return c.select("id", F.array_join("c", ",").alias("concepts"), transfer.level(F.col("c")).alias("level"))


OVERLAP = "len(list_filter(cs, lambda x: contains(lower(x), 'caching') OR contains('caching', lower(x)) OR contains(lower(x), 'pattern') OR contains('pattern', lower(x)))) / greatest(len(cs), 2)"


@register("transfer_combined", f"""WITH x AS ({XROWS}), c AS (SELECT id, language, {CONCEPTS} AS cs, -id / 100000.0::DOUBLE AS rel FROM x), l AS (SELECT *, {XLEVEL} AS lv FROM c),
t AS (SELECT *, least(1, CASE lv WHEN 'universal' THEN 1 WHEN 'domain' THEN 0.75 ELSE 0.5 END * 0.3 + CASE WHEN id % 2 = 0 THEN 0.25 WHEN id % 5 = 0 THEN 0.12 ELSE 0 END
  + 0.3 * CASE language WHEN 'rust' THEN 1 WHEN 'go' THEN 0.7 WHEN 'python' THEN 0.2 ELSE 0.5 END + CASE WHEN len(cs) = 0 THEN 0 ELSE {OVERLAP} END * 0.15)::DOUBLE AS ts FROM l)
SELECT id, round(ts, 6) AS transfer_score, round(rel * 0.6 + ts * 0.4, 6) AS combined_score FROM t ORDER BY rel * 0.6 + ts * 0.4 DESC, id LIMIT 50""")
def transfer_combined(spark, sf_dir):
    hits = _texts(spark, sf_dir).withColumn("relevance", -F.col("id") / 100000.0)
    hits = hits.withColumn("tags", F.when(F.col("id") % 2 == 0, "domain:web_backend").when(F.col("id") % 5 == 0, "domain:security"))
    out = transfer.ranked(hits, transfer.Project("p", "rust", "web_backend", ("caching", "pattern")), 50, ("text",))
    return out.select("id", F.round("transfer_score", 6).alias("transfer_score"), F.round("combined_score", 6).alias("combined_score"))


@register("transfer_adaptation", "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'Anadir ownership, Result types, macros' WHEN 1 THEN 'Cambiar a tipado estatico, usar Result para errores, ownership' END AS adaptation FROM documents")
def transfer_adaptation(spark, sf_dir):
    return _texts(spark, sf_dir).where("id >= 0").select("id", transfer.adaptation(F.col("language"), "rust").alias("adaptation"))


@register("agent_type_stats", "SELECT role AS type, count(*) AS n FROM conversations GROUP BY role")
def agent_type_stats(spark, sf_dir):
    return agent.type_stats(table(spark, sf_dir, "conversations").withColumnRenamed("role", "type"))


@register("agent_cleanup_old", "SELECT event_id AS id FROM events WHERE epoch_us(ts) // 1000000 >= 1706745600 - 10 * 86400")
def agent_cleanup_old(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("timestamp"))
    return agent.cleanup_old(e, NOW, 10).select("id")


@register("agent_recent_turns", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def agent_recent_turns(spark, sf_dir):
    return agent.recent_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn")


@register("agent_recall_kind", f"WITH d AS (SELECT conv_id * 100 + turn AS id, {METRICS['cosine']} AS d FROM conversations JOIN embeddings ON vec_id = conv_id % 500, (SELECT {Q0} AS q) WHERE role = 'assistant') SELECT id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 10")
def agent_recall_kind(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn("type", F.col("context"))
    return agent.recall_kind(m, vector_of(spark, sf_dir, 0), 10, "assistant").select("id", F.round("distance", 6).alias("distance"))


@register("agent_context_text", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM t WHERE n <= 4 GROUP BY conv_id")
def agent_context_text(spark, sf_dir):
    c = agent.context_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", keep=4)
    return c.select("conv_id", F.sha2("context", 256).alias("digest"))


@register("memory_recall_keywords", f"WITH {bm25_sql(['the', 'of'], '(SELECT c.conv_id * 100 + turn AS id, text FROM conversations c JOIN embeddings ON vec_id = conv_id % 500)', 'id')} SELECT id, round(-bm25, 6) AS score FROM hits ORDER BY bm25 DESC, id LIMIT 10")
def memory_recall_keywords(spark, sf_dir):
    d = Documents(memories(spark, sf_dir), text=["content"])
    return memory.recall_by_keywords(d, "the of", 10).select("id", F.round("relevance", 6).alias("score"))


@register("transfer_same_stack", None)
def transfer_same_stack(spark, sf_dir):
    hits = _texts(spark, sf_dir).withColumn("relevance", F.lit(0.0)).withColumn("tags", F.lit("domain:web_backend"))
    return transfer.recall_same_stack(hits, transfer.Project("p", "rust", "web_backend", ("caching",)), 20, text=("text",)).select("id", "language")


@register("agent_recall_similar", None)
def agent_recall_similar(spark, sf_dir):
    d = Documents(memories(spark, sf_dir), vector="vector", text=["content"])
    return agent.recall_similar(d, vector_of(spark, sf_dir, 0), "the of", 10).select("id", F.round("score", 8).alias("score"))


SESSIONS = """ev AS (SELECT user_id AS s, event_id AS o, CASE event_type WHEN 'click' THEN 'file' WHEN 'purchase' THEN 'goal' WHEN 'error' THEN 'error' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'turn' END
  ELSE CASE event_id % 5 WHEN 0 THEN 'clear' WHEN 1 THEN 'project' ELSE 'task' END END AS kind,
  CASE WHEN event_type = 'click' THEN 'f' || event_id % 7 WHEN event_type = 'purchase' OR event_type = 'view' AND event_id % 2 = 0 THEN 'g' || event_id // 2 % 4 ELSE 'v' || event_id END AS value FROM events)"""


def _session_events(spark, sf_dir):
    """The events as those of sessions, a session a user."""
    e, kind = F.col("event_id"), F.col("event_type")
    done = (kind == "view") & (e % 2 == 0)
    other = F.when(e % 5 == 0, "clear").when(e % 5 == 1, "project").otherwise("task")
    kinds = F.when(kind == "click", "file").when(kind == "purchase", "goal").when(kind == "error", "error").when(done, "done").when(kind == "view", "turn").otherwise(other)
    value = F.when(kind == "click", F.concat(F.lit("f"), e % 7)).when((kind == "purchase") | done, F.concat(F.lit("g"), F.floor(e / 2) % 4)).otherwise(F.concat(F.lit("v"), e))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), e.alias("order"), kinds.alias("kind"), value.alias("value"), F.lit("user").alias("role"))


@register("agent_working_context", f"""WITH {SESSIONS}, c AS (SELECT s, max(o) AS cl FROM ev WHERE kind = 'clear' GROUP BY s), live AS (SELECT ev.* FROM ev LEFT JOIN c USING (s) WHERE cl IS NULL OR o > cl),
p AS (SELECT s, kind, min(o) AS o, value FROM live WHERE kind = 'file' GROUP BY s, kind, value
  UNION ALL SELECT s, kind, o, value FROM live g WHERE kind = 'goal' AND NOT EXISTS (SELECT 1 FROM live d WHERE d.s = g.s AND d.kind = 'done' AND d.value = g.value AND d.o > g.o)
  UNION ALL SELECT s, kind, max(o), max_by(value, o) FROM live WHERE kind IN ('project', 'task') GROUP BY s, kind
  UNION ALL (SELECT s, kind, o, value FROM live WHERE kind IN ('turn', 'error') QUALIFY row_number() OVER (PARTITION BY s, kind ORDER BY o DESC) <= CASE kind WHEN 'turn' THEN 20 ELSE 10 END))
SELECT s::VARCHAR AS session, concat_ws(chr(10), 'Project: ' || max(value) FILTER (WHERE kind = 'project'), 'Task: ' || max(value) FILTER (WHERE kind = 'task'),
  'Goals: ' || string_agg(value, ', ' ORDER BY o) FILTER (WHERE kind = 'goal'), 'Files: ' || string_agg(value, ', ' ORDER BY o) FILTER (WHERE kind = 'file')) AS context,
  coalesce(string_agg('user ' || value, ',' ORDER BY o) FILTER (WHERE kind = 'turn'), '') AS turns, coalesce(string_agg(value, ',' ORDER BY o) FILTER (WHERE kind = 'error'), '') AS errors FROM p GROUP BY s""")
def agent_working_context(spark, sf_dir):
    """The contexts as they are read back from internal documents."""
    c = agent.loaded_contexts(agent.saved_contexts(agent.working_contexts(_session_events(spark, sf_dir))))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(" "), x["value"])), ",")
    return c.select("session", agent.context_string().alias("context"), turns.alias("turns"), F.array_join("errors", ",").alias("errors"))


@register("agent_learned", f"SELECT 'episode-' || doc_id AS id, 'episode' AS type, source AS description, CASE WHEN doc_id % 3 > 0 THEN lang || chr(10) || source END AS learnings, CASE WHEN doc_id % 3 > 0 THEN lang || ',' || source END AS tags, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE 'current' END AS project, {NOW}::BIGINT AS timestamp FROM documents")
def agent_learned(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    noted = F.when(F.col("doc_id") % 3 > 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    rows = d.select("doc_id", F.col("source").alias("task"), noted.alias("learnings"), noted.alias("tags"), F.when(F.col("doc_id") % 2 == 0, "own").alias("project"))
    return agent.learned(rows, "episode", "doc_id", NOW, "current").select("id", "type", "description", "learnings", "tags", "project", "timestamp")


@register("byte_embedding", """WITH b AS (SELECT doc_id AS id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents), u AS (SELECT id, unnest(h) AS x, (generate_subscripts(h, 1) - 1) % 64 AS d FROM b),
v AS (SELECT id, d, sum(('0x' || x)::INTEGER / 255.0::DOUBLE) AS v FROM u GROUP BY ALL), n AS (SELECT id, sum(v) FILTER (WHERE d = 0) / sqrt(sum(v * v)) AS f FROM v GROUP BY id)
SELECT doc_id AS id, round(coalesce(f, 0)::FLOAT::DOUBLE, 5) AS first FROM documents LEFT JOIN n ON id = doc_id""")
def byte_embedding(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), agent.byte_embedding(F.col("text"), 64).alias("v"))
    return d.select("id", F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"))
