"""Registered queries: vector search, filters, listings, keyword and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions import filters as fl
from lodequery.functions.distance import distance, matryoshka
from lodequery.functions.text import snippet, tokens, word_count
from lodequery.operators import bm25, fusion, rerank, vectors
from lodequery.operators.hybrid import Documents, OrderBy, Search
from lodequery.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """The embedding that a query searches with."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the embedding of the same number, if there is one, and their labels."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return docs.join(vecs, "id", "left").join(labels, "id", "left").withColumn("deleted", F.col("toxic") == 1)


Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
METRICS = {
    "cosine": "list_cosine_distance(embedding::DOUBLE[], q)",
    "euclidean": "list_distance(embedding::DOUBLE[], q)",
    "dot": "list_negative_inner_product(embedding::DOUBLE[], q)",
    "manhattan": "list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: abs(z[1] - z[2])))",
}


def _knn(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = vectors.knn(embeddings(spark, sf_dir), vector_of(spark, sf_dir, 0), 10, metric)
        return out.select("id", F.round("distance", 6).alias("distance"))

    return run


for _m, _sql in METRICS.items():
    register(
        f"knn_{_m}",
        f"WITH d AS (SELECT vec_id AS id, {_sql} AS d FROM embeddings, (SELECT {Q0} AS q)) SELECT id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 10",
    )(_knn(_m))


def _pairwise(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = embeddings(spark, sf_dir)
        nxt = e.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
        return e.join(nxt, "id").select("id", F.round(distance(metric, F.col("vector"), F.col("other")), 6).alias("distance"))

    return run


for _m, _sql in METRICS.items():
    register(
        f"distance_columns_{_m}",
        f"SELECT a.vec_id AS id, round({_sql.replace('embedding::DOUBLE[]', 'a.embedding::DOUBLE[]').replace(' q)', ' b.embedding::DOUBLE[])')}, 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    )(_pairwise(_m))


def query_blocks(spark: SparkSession, sf_dir: str) -> Iterator[tuple[list[int], np.ndarray]]:
    """The ids and vectors of the stated queries, every row whose id is divisible by 50, in blocks."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").orderBy("vec_id").select("vec_id", "embedding").toLocalIterator()
    while block := list(islice(rows, vectors.MAX_QUERIES)):
        yield [r["vec_id"] for r in block], np.array([r["embedding"] for r in block], np.float64)


def _batch(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        blocks = [vectors.knn_batch(embeddings(spark, sf_dir), q, ids, 5, metric) for ids, q in query_blocks(spark, sf_dir)]
        return reduce(DataFrame.unionByName, blocks).select("query_id", "id", F.round("distance", 5).alias("distance"), "rank")

    return run


for _m in ("cosine", "euclidean", "manhattan"):
    register(
        "knn_batch" if _m == "cosine" else f"knn_batch_{_m}",
        f"""WITH d AS (SELECT qs.vec_id AS query_id, e.vec_id AS id, {METRICS[_m].replace('embedding::DOUBLE[]', 'e.embedding::DOUBLE[]')} AS d
FROM embeddings e, (SELECT vec_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0) qs),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d)
SELECT query_id, id, abs(round(d, 5)) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 5""",
    )(lambda spark, sf_dir, run=_batch(_m): run(spark, sf_dir).withColumn("distance", F.abs("distance")))


@register("knn_filtered", f"WITH d AS (SELECT vec_id AS id, label, {METRICS['cosine']} AS d FROM embeddings, (SELECT {Q0} AS q) WHERE label IN (1, 3, 5)) SELECT id, label, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 10")
def knn_filtered(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    where = fl.compile_filter(fl.isin("label", [1, 3, 5]), fl.Columns(e))
    return vectors.knn(e, vector_of(spark, sf_dir, 0), 10, where=where).select("id", "label", F.round("distance", 6).alias("distance"))


@register("knn_paged", f"WITH d AS (SELECT vec_id AS id, {METRICS['euclidean']} AS d FROM embeddings, (SELECT {Q0} AS q)) SELECT id, round(d, 6) AS distance, (SELECT count(*) FROM embeddings) AS total FROM d ORDER BY d, id LIMIT 10 OFFSET 20")
def knn_paged(spark, sf_dir):
    out, total = vectors.page(embeddings(spark, sf_dir), vector_of(spark, sf_dir, 0), 10, 20, "euclidean")
    return out.select("id", F.round("distance", 6).alias("distance"), F.lit(total).cast("long").alias("total"))


@register("knn_partial_view", f"WITH d AS (SELECT vec_id AS id, {METRICS['manhattan']} AS d FROM embeddings, (SELECT {Q0} AS q) WHERE label = 2) SELECT id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 5")
def knn_partial_view(spark, sf_dir):
    view = Documents(embeddings(spark, sf_dir), vector="vector").view(fl.eq("label", 2), "manhattan")
    return vectors.knn(view.df, vector_of(spark, sf_dir, 0), 5, view.metric).select("id", F.round("distance", 6).alias("distance"))


@register("matryoshka_knn", """WITH v AS (SELECT vec_id AS id, list_slice(embedding::DOUBLE[], 1, 16) AS s FROM embeddings),
n AS (SELECT id, list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y)))) AS u FROM v),
d AS (SELECT id, list_distance(u, (SELECT u FROM n WHERE id = 0)) AS d FROM n) SELECT id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 10""")
def matryoshka_knn(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", matryoshka(F.col("vector"), 16).alias("vector"))
    q = np.array(vector_of(spark, sf_dir, 0)[:16])
    return vectors.knn(e, list(q / np.linalg.norm(q)), 10, "euclidean").select("id", F.round("distance", 6).alias("distance"))


# One query for each filter operator over typed columns, and the same rules over JSON documents.
FILTERS = {
    "eq": ("customer", "c_custkey", fl.eq("c_mktsegment", "BUILDING"), "c_mktsegment = 'BUILDING'"),
    "eq_float": ("events", "event_id", fl.eq("value", 1), "abs(value - 1) < 2.220446049250313e-16"),
    "ne": ("documents", "doc_id", fl.ne("lang", "en"), "coalesce(lang, '') <> 'en'"),
    "gt": ("orders", "o_orderkey", fl.gt("o_totalprice", 200000.0), "o_totalprice > 200000"),
    "gte": ("part", "p_partkey", fl.gte("p_size", 40), "p_size >= 40"),
    "lt": ("customer", "c_custkey", fl.lt("c_acctbal", 0), "c_acctbal < 0"),
    "lte": ("part", "p_partkey", fl.lte("p_retailprice", 1000.5), "p_retailprice <= 1000.5"),
    "range": ("part", "p_partkey", fl.between("p_size", 10, 20), "p_size BETWEEN 10 AND 20"),
    "in": ("events", "event_id", fl.isin("event_type", ["click", "error"]), "event_type IN ('click', 'error')"),
    "nin": ("events", "event_id", fl.nin("event_type", ["view", "click"]), "event_type NOT IN ('view', 'click')"),
    "contains": ("part", "p_partkey", fl.contains("p_name", "A"), "contains(lower(p_name), 'a')"),
    "starts_with": ("part", "p_partkey", fl.starts_with("p_type", "s"), "starts_with(lower(p_type), 's')"),
    "ends_with": ("documents", "doc_id", fl.ends_with("text", "THE."), "ends_with(lower(text), 'the.')"),
    "regex": ("documents", "doc_id", fl.regex("text", "[0-9]{3}"), "regexp_matches(text, '[0-9]{3}')"),
    "exists": ("documents", "doc_id", fl.exists("lang"), "lang IS NOT NULL"),
    "and": ("orders", "o_orderkey", fl.eq("o_orderstatus", "F") & fl.gt("o_totalprice", 100000), "o_orderstatus = 'F' AND o_totalprice > 100000"),
    "or": ("orders", "o_orderkey", fl.eq("o_orderstatus", "P") | fl.lt("o_totalprice", 5000), "o_orderstatus = 'P' OR o_totalprice < 5000"),
    "not": ("customer", "c_custkey", fl.not_(fl.gt("c_acctbal", 0) & fl.ne("c_mktsegment", "MACHINERY")), "NOT (c_acctbal > 0 AND c_mktsegment <> 'MACHINERY')"),
    "empty_or": ("nation", "n_nationkey", fl.any_of(), "true"),
    "mismatch": ("part", "p_partkey", fl.eq("p_size", "5") | fl.gt("p_name", 3), "false"),
}


def _filtered(name: str, key: str, f: fl.Filter):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return df.where(fl.compile_filter(f, fl.Columns(df))).select(F.col(key).alias("id"))

    return run


for _k, (_t, _key, _f, _sql) in FILTERS.items():
    register(f"filter_{_k}", f"SELECT {_key} AS id FROM {_t} WHERE {_sql}")(_filtered(_t, _key, _f))


@register("filter_json", "SELECT event_id FROM events WHERE (props->>'$.k')::BIGINT >= 50 AND event_type = 'view'")
def filter_json(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.parse_json(F.concat(F.lit('{"p":'), "props", F.lit(',"t":"'), "event_type", F.lit('"}'))).alias("m"))
    f = fl.parse_filter('{"p.k": {"$gte": 50}, "t": "view"}')
    return df.where(fl.compile_filter(f, fl.Variant("m"))).select("event_id")


VARIANT_ROWS = [
    (1, '{"a":5,"tags":["x","y"]}'), (2, '{"a":"5"}'), (3, '{"a":5.0}'), (4, '{"a":null}'), (5, "{}"), (6, '{"a":true}'), (7, '{"a":[5]}'), (8, '{"a":{"b":"Deep"}}'), (9, '{"a":-1e300}'), (10, '{"a":7}'),
]
VARIANT_FILTERS = {
    "eq5": fl.eq("a", 5), "eq_text": fl.eq("a", "5"), "ne5": fl.ne("a", 5), "gt": fl.gt("a", 4), "not_gt": fl.not_(fl.gt("a", 4)), "exists": fl.exists("a"),
    "missing": fl.exists("a", False), "true": fl.eq("a", True), "null": fl.eq("a", "null"), "path": fl.contains("a.b", "dEE"), "index": fl.eq("tags.1", "y"), "in": fl.isin("a", ["5", 7]),
}
_EXPECTED = {"eq5": [1, 3], "eq_text": [2], "ne5": [2, 4, 5, 6, 7, 8, 9, 10], "gt": [1, 3, 10], "not_gt": [2, 4, 5, 6, 7, 8, 9], "exists": [1, 2, 3, 4, 6, 7, 8, 9, 10],
             "missing": [5], "true": [6], "null": [4], "path": [8], "index": [1], "in": [2, 10]}


@register("filter_variant", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i}::BIGINT)" for k, v in _EXPECTED.items() for i in v) + ") t(filter, id)")
def filter_variant(spark, sf_dir):
    df = spark.createDataFrame(VARIANT_ROWS, "id long, j string").select("id", F.parse_json("j").alias("m"))
    hits = [F.when(fl.compile_filter(f, fl.Variant("m")), F.lit(k)) for k, f in VARIANT_FILTERS.items()]
    return df.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("filter"), "id")


@register("order_nulls_asc", "SELECT doc_id AS id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS LAST, doc_id LIMIT 300")
def order_nulls_asc(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), "quality")
    return df.orderBy(*OrderBy("quality").columns("id")).limit(300)


@register("order_nulls_desc", "SELECT doc_id AS id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST, doc_id LIMIT 300")
def order_nulls_desc(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), "quality")
    return df.orderBy(*OrderBy("quality", True).columns("id")).limit(300)


LIVE = "coalesce(toxic, 0) <> 1"


@register("list_documents_page", f"SELECT doc_id AS id, n_chars, count(*) OVER () AS total FROM documents LEFT JOIN labels USING (doc_id) WHERE {LIVE} AND lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def list_documents_page(spark, sf_dir):
    page = Documents(documents(spark, sf_dir), deleted="deleted").list(fl.eq("lang", "en"), OrderBy("n_chars", True), 20, 40)
    return page.items.select("id", "n_chars", F.lit(page.total).cast("long").alias("total"))


@register("filter_ordered_page", "SELECT o_orderkey AS id, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 15 OFFSET 5")
def filter_ordered_page(spark, sf_dir):
    page = Documents(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")).list(fl.eq("o_orderstatus", "O"), OrderBy("o_totalprice"), 15, 5)
    return page.items.select("id", "o_totalprice", F.lit(page.total).cast("long").alias("total"))


@register("soft_delete_live", f"SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE {LIVE}")
def soft_delete_live(spark, sf_dir):
    d = Documents(documents(spark, sf_dir), deleted="deleted")
    return d.df.where(d.live()).select("id")


@register("filter_only_search", f"SELECT doc_id AS id, 0.0::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id) WHERE {LIVE} AND lang = 'de' ORDER BY doc_id LIMIT 25 OFFSET 5")
def filter_only_search(spark, sf_dir):
    d = Documents(documents(spark, sf_dir), deleted="deleted")
    return d.search(Search.filter_only(fl.eq("lang", "de"), 25).with_offset(5)).select("id", "score")


@register("vector_search_filtered", f"""WITH d AS (SELECT doc_id AS id, {METRICS['cosine']} AS d FROM documents JOIN embeddings ON vec_id = doc_id LEFT JOIN labels USING (doc_id), (SELECT {Q0} AS q)
WHERE {LIVE} AND lang <> 'fr'), r AS (SELECT *, row_number() OVER (ORDER BY d, id) - 1 AS r FROM d) SELECT id, round(d, 6) AS score, r::INTEGER AS vector_rank FROM r ORDER BY d, id LIMIT 10 OFFSET 3""")
def vector_search_filtered(spark, sf_dir):
    d = Documents(documents(spark, sf_dir), vector="vector", dimensions=64, deleted="deleted")
    s = Search.by_vector(vector_of(spark, sf_dir, 0), 10).with_filter(fl.ne("lang", "fr")).with_offset(3)
    return d.search(s).select("id", F.round("score", 6).alias("score"), "vector_rank")


TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: strlen(x) > 1)"


def bm25_sql(words: list[str], source: str = "documents", key: str = "doc_id") -> str:
    """CTEs of which ``hits`` has id and bm25."""
    wanted = ", ".join(f"('{w}')" for w in words)
    return f"""docs AS (SELECT {key} AS id, {TOKENS} AS toks FROM {source}), st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM docs),
tf AS (SELECT id, tok, count(*) AS tf FROM (SELECT id, unnest(toks) AS tok FROM docs) GROUP BY ALL), dfs AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
qt AS (SELECT tok, count(*) AS qtf FROM (VALUES {wanted}) v(tok) GROUP BY tok),
hits AS (SELECT tf.id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))) AS bm25
  FROM qt JOIN tf USING (tok) JOIN dfs USING (tok) JOIN docs ON docs.id = tf.id, st GROUP BY tf.id)"""


def _bm25_index(spark, sf_dir):
    return bm25.index(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), F.col("text"))


def _bm25(query: str):
    return lambda spark, sf_dir: bm25.search(_bm25_index(spark, sf_dir), query, 20).select("id", F.round("bm25", 6).alias("score"))


register("bm25_topk", f"WITH {bm25_sql(['license', 'rights', 'ist'])} SELECT id, round(bm25, 6) AS score FROM hits ORDER BY bm25 DESC, id LIMIT 20")(_bm25("License rights ist"))
register("bm25_dup_query_terms", f"WITH {bm25_sql(['license', 'license', 'the'])} SELECT id, round(bm25, 6) AS score FROM hits ORDER BY bm25 DESC, id LIMIT 20")(_bm25("license the license"))


@register("bm25_filtered", f"WITH {bm25_sql(['license', 'the'])} SELECT hits.id, round(bm25, 6) AS score FROM hits JOIN documents ON doc_id = id LEFT JOIN labels USING (doc_id) WHERE lang = 'en' AND {LIVE} ORDER BY bm25 DESC, hits.id LIMIT 10")
def bm25_filtered(spark, sf_dir):
    d = Documents(documents(spark, sf_dir), text=["text"], deleted="deleted", indexed=_bm25_index(spark, sf_dir))
    out = d.search(Search.by_keyword("license the", 10).with_filter(fl.eq("lang", "en")))
    return out.select("id", F.round(-F.col("score"), 6).alias("score"))


@register("bm25_keyword_rank", f"WITH {bm25_sql(['license'])} SELECT id, round(-bm25, 6) AS score, (row_number() OVER (ORDER BY bm25 DESC, id) - 1)::INTEGER AS keyword_rank FROM hits ORDER BY bm25 DESC, id LIMIT 10")
def bm25_keyword_rank(spark, sf_dir):
    d = Documents(documents(spark, sf_dir), text=["text"], indexed=_bm25_index(spark, sf_dir))
    return d.search(Search.by_keyword("license", 10)).select("id", F.round("score", 6).alias("score"), "keyword_rank")


@register("bm25_stats", f"WITH docs AS (SELECT {TOKENS} AS toks FROM documents) SELECT count(*) AS total_documents, (SELECT count(DISTINCT t) FROM (SELECT unnest(toks) AS t FROM docs)) AS unique_terms, sum(len(toks))::BIGINT AS total_tokens, round(avg(len(toks)), 6) AS avg_length FROM docs")
def bm25_stats(spark, sf_dir):
    return bm25.stats(_bm25_index(spark, sf_dir)).withColumn("avg_length", F.round("avg_length", 6))


@register("tokenize_counts", f"SELECT doc_id AS id, len({TOKENS})::INTEGER AS n FROM documents")
def tokenize_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.size(tokens(F.col("text"))).alias("n"))


@register("text_snippets", r"SELECT doc_id AS id, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS snippet, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::INTEGER AS words, strlen(text)::INTEGER AS bytes FROM documents")
def text_snippets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), snippet(F.col("text")).alias("snippet"), word_count(F.col("text")).alias("words"), F.octet_length("text").alias("bytes"))


HYBRID_LISTS = f"""vr AS (SELECT *, row_number() OVER (ORDER BY d, id) - 1 AS vrank FROM (SELECT doc_id AS id, {METRICS['cosine']} AS d FROM documents JOIN embeddings ON vec_id = doc_id, (SELECT {Q0} AS q))),
kr AS (SELECT id, bm25, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS krank FROM hits)"""


def _rrf(v: float, k: float):
    def run(spark, sf_dir):
        near = vectors.knn(documents(spark, sf_dir), vector_of(spark, sf_dir, 0), 50)
        near = fusion.rank_first(near, ["distance", "id"], 50, "r")
        hits = fusion.rank_first(bm25.scored(_bm25_index(spark, sf_dir), "license the"), [F.desc("bm25"), "id"], 50, "r")
        return fusion.rrf([(near, "r", v), (hits, "r", k)]).limit(20).select("id", F.round("rrf", 8).alias("rrf"))

    return run


for _n, _v, _k in (("rrf_unweighted", 1.0, 1.0), ("rrf_weighted", 0.7, 0.3)):
    register(
        _n,
        f"""WITH {bm25_sql(['license', 'the'])}, {HYBRID_LISTS}, u AS (SELECT id, {_v} / (61 + vrank) AS s FROM vr WHERE vrank < 50 UNION ALL SELECT id, {_k} / (61 + krank) FROM kr WHERE krank < 50)
SELECT id, round(sum(s)::DOUBLE, 8) AS rrf FROM u GROUP BY id ORDER BY sum(s) DESC, id LIMIT 20""",
    )(_rrf(_v, _k))


def hybrid_sql(words: list[str], k: int, offset: int, where: str, v: float = 0.5, w: float = 0.5) -> str:
    need = k + offset
    return f"""WITH {bm25_sql(words)}, {HYBRID_LISTS}, c AS (SELECT coalesce(vr.id, kr.id) AS id, d, vrank, bm25, krank, least(vrank, krank) AS best FROM vr FULL JOIN kr ON vr.id = kr.id),
p AS (SELECT c.*, lang, toxic FROM c JOIN documents ON doc_id = c.id LEFT JOIN labels USING (doc_id) WHERE {LIVE} AND {where}),
ceil AS (SELECT greatest(count(*), (SELECT count(*) FROM vr)) AS m FROM documents), lv AS (SELECT DISTINCT least(2 * {need} * (1 << i), m) AS f, m FROM range(30) t(i), ceil WHERE i < 25),
pick AS (SELECT min(f) AS f FROM lv WHERE f = m OR (SELECT count(*) FROM p WHERE best < f) >= {need}),
s AS (SELECT id, CASE WHEN vrank < f THEN d END AS d, CASE WHEN krank < f THEN bm25 END AS b, CASE WHEN vrank < f THEN vrank END AS vr, CASE WHEN krank < f THEN krank END AS kr,
  -(CASE WHEN vrank < f THEN {v}::DOUBLE / (61 + vrank) ELSE 0 END + CASE WHEN krank < f THEN {w}::DOUBLE / (61 + krank) ELSE 0 END) AS score FROM p, pick WHERE best < f)
SELECT id, round(score, 8) AS score, round(d, 6) AS vector_distance, round(b, 6) AS bm25_score, vr::INTEGER AS vector_rank, kr::INTEGER AS keyword_rank FROM s ORDER BY score, id LIMIT {k} OFFSET {offset}"""


def _hybrid(s):
    def run(spark, sf_dir):
        d = Documents(documents(spark, sf_dir), vector="vector", text=["text"], deleted="deleted", indexed=_bm25_index(spark, sf_dir))
        out = d.search(s(vector_of(spark, sf_dir, 0)))
        return out.select("id", F.round("score", 8).alias("score"), F.round("vector_distance", 6).alias("vector_distance"), F.round("bm25_score", 6).alias("bm25_score"), "vector_rank", "keyword_rank")

    return run


register("hybrid_topk", hybrid_sql(["license", "the"], 10, 0, "true"))(_hybrid(lambda q: Search.hybrid(q, "license the", 10)))
register("hybrid_filtered_offset", hybrid_sql(["license", "the"], 10, 5, "lang = 'es'"))(_hybrid(lambda q: Search.hybrid(q, "license the", 10).with_filter(fl.eq("lang", "es")).with_offset(5)))
register("hybrid_weighted", hybrid_sql(["rights"], 8, 0, "true", 0.2, 0.8))(_hybrid(lambda q: Search.hybrid(q, "rights", 8).with_weights(0.2, 0.8)))


@register("rerank_topk", f"""WITH d AS (SELECT doc_id AS id, text, {METRICS['cosine']} AS d FROM documents JOIN embeddings ON vec_id = doc_id, (SELECT {Q0} AS q)), t AS (SELECT * FROM d ORDER BY d, id LIMIT 20),
s AS (SELECT id, len(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x IN ('the', 'of', 'license')))) / 3.0::DOUBLE AS s FROM t) SELECT id, round(1 - s, 6) AS distance FROM s""")
def rerank_topk(spark, sf_dir):
    near = vectors.knn(documents(spark, sf_dir).select("id", "text", "vector"), vector_of(spark, sf_dir, 0), 20).select("id", "text", "distance")
    return rerank.rerank(near, "the of license", "text", rerank.overlap_scorer).select("id", F.round("distance", 6).alias("distance"))


@register("facet_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def facet_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@register("hit_doc_join", f"WITH {bm25_sql(['license'])}, t AS (SELECT * FROM hits ORDER BY bm25 DESC, id LIMIT 30) SELECT id, lang, source, n_chars FROM t JOIN documents ON doc_id = id")
def hit_doc_join(spark, sf_dir):
    hits = bm25.search(_bm25_index(spark, sf_dir), "license", 30).select("id")
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id").join(F.broadcast(hits), "id").select("id", "lang", "source", "n_chars")
