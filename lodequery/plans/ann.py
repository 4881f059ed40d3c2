"""Registered queries: quantisation and clustered search."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.functions import quantize as qz
from lodequery.operators import ann, vectors

from .search import METRICS, Q0, embeddings, query_blocks, vector_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


E = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
RND = "CASE WHEN {x} < 0 THEN -floor(-({x}) + 0.5) ELSE floor({x} + 0.5) END"
INT8 = "list_transform(v, lambda x: greatest(-128, least(127, " + RND.format(x="((greatest(-1.0, least(1.0, x)) + 1.0) * 127.0 - 128)") + "))::INTEGER)"
INT3 = "list_transform(v, lambda x: greatest(0, least(7, " + RND.format(x="((x + 1.0) / 2.0 * 7)") + "))::INTEGER)"


@register("quant_int8_roundtrip", f"WITH c AS (SELECT id, v, {INT8} AS c FROM {E}) SELECT id, array_to_string(c, ',') AS codes, round(list_max(list_transform(list_zip(v, c), lambda z: abs(z[1] - ((z[2] + 128) / 127.0 - 1.0)))), 6) AS max_error FROM c")
def quant_int8_roundtrip(spark, sf_dir):
    e = embeddings(spark, sf_dir).withColumn("c", qz.int8(F.col("vector")))
    error = F.array_max(F.zip_with("vector", qz.int8_decoded(F.col("c")), lambda a, b: F.abs(a.cast("double") - b)))
    return e.select("id", _text("c").alias("codes"), F.round(error, 6).alias("max_error"))


@register("quant_int8_knn", f"WITH c AS (SELECT id, list_transform({INT8}, lambda z: (z + 128) / 127.0 - 1.0) AS u FROM {E}), d AS (SELECT id, list_distance(u, q) AS d FROM c, (SELECT {Q0} AS q)) SELECT id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 10")
def quant_int8_knn(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", qz.int8(F.col("vector")).alias("codes"))
    return ann.quantised_knn(e, "codes", "int8", 64, vector_of(spark, sf_dir, 0), 10, "euclidean").select("id", F.round("distance", 6).alias("distance"))


@register("quant_int3_roundtrip", f"WITH c AS (SELECT id, v, {INT3} AS c FROM {E}) SELECT id, array_to_string(c, ',') AS codes, round(list_max(list_transform(list_zip(v, c), lambda z: abs(z[1] - (z[2] / 7.0 * 2.0 - 1.0)))), 6) AS max_error FROM c")
def quant_int3_roundtrip(spark, sf_dir):
    e = embeddings(spark, sf_dir).withColumn("c", qz.unpacked(qz.packed(qz.int3(F.col("vector")), 3), 3, 64))
    error = F.array_max(F.zip_with("vector", qz.int3_decoded(F.col("c")), lambda a, b: F.abs(a.cast("double") - b)))
    return e.select("id", _text("c").alias("codes"), F.round(error, 6).alias("max_error"))


@register("quant_int3_codes_distance", f"WITH c AS (SELECT id, list_transform({INT3}, lambda x: x::DOUBLE) AS c FROM {E}) SELECT a.id, round(list_cosine_distance(a.c, b.c), 6) AS cosine, round(list_distance(a.c, b.c), 6) AS euclidean FROM c a, c b WHERE b.id = 0")
def quant_int3_codes_distance(spark, sf_dir):
    c = embeddings(spark, sf_dir).select("id", qz.int3(F.col("vector")).alias("c"))
    first = c.where("id = 0").select(F.col("c").alias("q"))
    both = c.join(F.broadcast(first))
    return both.select("id", *[F.round(qz.codes_distance(m, F.col("c"), F.col("q")), 6).alias(m) for m in ("cosine", "euclidean")])


@register("quant_binary_hamming", f"WITH c AS (SELECT id, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS c FROM {E}), h AS (SELECT a.id, list_sum(list_transform(list_zip(a.c, b.c), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::BIGINT AS h FROM c a, c b WHERE b.id = 0) SELECT id, h AS hamming, round(h / 64.0::DOUBLE, 6) AS cosine FROM h")
def quant_binary_hamming(spark, sf_dir):
    c = embeddings(spark, sf_dir).select("id", qz.packed(qz.binary(F.col("vector")), 1).alias("w"))
    both = c.join(F.broadcast(c.where("id = 0").select(F.col("w").alias("q"))))
    return both.select("id", qz.hamming(F.col("w"), F.col("q")).alias("hamming"), F.round(qz.binary_distance("cosine", F.col("w"), F.col("q"), 64), 6).alias("cosine"))


@register("quant_pair_distance", f"""WITH c AS (SELECT id, v, list_transform({INT8}, lambda z: z::DOUBLE) AS c8, list_transform({INT3}, lambda z: z::DOUBLE) AS c3, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END::DOUBLE) AS s FROM {E}),
p AS (SELECT a.id, a.v, a.c8, a.c3, a.s, b.c8 AS q8, b.c3 AS q3, b.s AS qs FROM c a, c b WHERE b.id = 0)
SELECT id, round(-list_inner_product(c8, q8), 6) AS int8_dot, round(list_sum(list_transform(list_zip(c8, q8), lambda z: abs(z[1] - z[2]))), 6) AS int8_manhattan,
round(-list_inner_product(c3, q3), 6) AS int3_dot, round(list_sum(list_transform(list_zip(c3, q3), lambda z: abs(z[1] - z[2]))), 6) AS int3_manhattan,
-list_sum(list_transform(list_zip(s, qs), lambda z: CASE WHEN z[1] = z[2] THEN 1.0 ELSE 0.0 END))::DOUBLE AS binary_dot,
round(list_distance(list_transform(c8, lambda z: (z + 128) / 127.0 - 1.0)::DOUBLE[], qs), 6) AS int8_binary_euclidean,
round(list_cosine_distance(v, list_transform(q3, lambda z: z / 7.0 * 2.0 - 1.0)::DOUBLE[]), 6) AS none_int3_cosine FROM p""")
def quant_pair_distance(spark, sf_dir):
    kinds = ("int8", "int3", "binary")
    c = embeddings(spark, sf_dir).select("id", F.col("vector").alias("none"), *[qz.encoded(k, F.col("vector"), 64).alias(k) for k in kinds])
    both = c.join(F.broadcast(c.where("id = 0").select(*[F.col(k).alias(f"q_{k}") for k in kinds])))  # one row
    d = lambda metric, a, b: F.round(qz.quantised_distance(metric, F.col(a), a, F.col(f"q_{b}"), b, 64), 6)
    found = {
        "int8_dot": d("dot", "int8", "int8"), "int8_manhattan": d("manhattan", "int8", "int8"), "int3_dot": d("dot", "int3", "int3"), "int3_manhattan": d("manhattan", "int3", "int3"),
        "binary_dot": d("dot", "binary", "binary"), "int8_binary_euclidean": d("euclidean", "int8", "binary"), "none_int3_cosine": d("cosine", "none", "int3"),
    }
    return both.select("id", *[v.alias(k) for k, v in found.items()])


def _polar_sql() -> str:
    signs, order = qz.rotation(64)
    at = lambda i: f"(n[{order[i] + 1}] * {signs[order[i]]})"
    bins = ", ".join(f"(floor((atan2({at(2 * p + 1)}, {at(2 * p)}) + {math.pi!r}) / {2 * math.pi!r} * 8)::INTEGER % 8)" for p in range(32))
    return f"""WITH u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS n FROM {E}), c AS (SELECT id, [{bins}] AS b FROM u)
SELECT a.id, array_to_string(a.b, ',') AS bins, round(1 - list_sum(list_transform(list_zip(a.b, b.b), lambda z: cos((z[1] - z[2]) * {math.pi / 4!r}))) / 32, 6) AS distance FROM c a, c b WHERE b.id = 0"""


@register("quant_polar_encode", _polar_sql())
def quant_polar_encode(spark, sf_dir):
    c = embeddings(spark, sf_dir).select("id", qz.polar(F.col("vector"), 64).alias("b"))
    both = c.join(F.broadcast(c.where("id = 0").select(F.col("b").alias("q"))))
    return both.select("id", _text("b").alias("bins"), F.round(qz.polar_distance(F.col("b"), F.col("q")), 6).alias("distance"))


@register("quant_polar_knn", None)
def quant_polar_knn(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", qz.polar(F.col("vector"), 64).alias("codes"))
    return ann.quantised_knn(e, "codes", "polar", 64, vector_of(spark, sf_dir, 0), 10).select("id", F.round("distance", 6).alias("distance"))


@register("quant_trained_params", "SELECT min(list_min(embedding::DOUBLE[])) AS low, max(list_max(embedding::DOUBLE[])) AS high FROM embeddings")
def quant_trained_params(spark, sf_dir):
    low, high, _ = qz.trained(embeddings(spark, sf_dir))
    return spark.createDataFrame([(low, high)], "low double, high double")


def _centroids(spark, sf_dir) -> np.ndarray:
    """The mean embedding of each label: centroids that both engines can compute."""
    rows = embeddings(spark, sf_dir).select("label", F.posexplode("vector")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("x")).collect()
    labels = sorted({r["label"] for r in rows})
    out = np.zeros((len(labels), 64))
    for r in rows:
        out[labels.index(r["label"]), r["pos"]] = r["x"]
    return out


CENTROIDS = """m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
cen AS (SELECT (row_number() OVER (ORDER BY label) - 1)::INTEGER AS cid, list(x ORDER BY i) AS c FROM m GROUP BY label)"""
ASSIGNED = "asg AS (SELECT vec_id AS id, embedding::DOUBLE[] AS embedding, arg_min(cid, list_distance(embedding::DOUBLE[], c)) AS cid FROM embeddings, cen GROUP BY ALL)"


@register("ivf_assign", f"WITH {CENTROIDS}, {ASSIGNED} SELECT id, cid FROM asg")
def ivf_assign(spark, sf_dir):
    return ann.assign(embeddings(spark, sf_dir), _centroids(spark, sf_dir)).select("id", "cid")


@register("ivf_probe_search", f"WITH {CENTROIDS}, {ASSIGNED}, p AS (SELECT cid FROM cen, (SELECT {Q0} AS q) ORDER BY list_distance(c, q), cid LIMIT 3), d AS (SELECT id, cid, {METRICS['cosine']} AS d FROM asg JOIN p USING (cid), (SELECT {Q0} AS q)) SELECT id, cid, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 10")
def ivf_probe_search(spark, sf_dir):
    c = _centroids(spark, sf_dir)
    out = ann.probe_search(ann.assign(embeddings(spark, sf_dir), c), c, vector_of(spark, sf_dir, 0), 10, 3)
    return out.select("id", "cid", F.round("distance", 6).alias("distance"))


@register("ivf_kmeans_recall", None)
def ivf_kmeans_recall(spark, sf_dir):
    """Of all stated queries; where vectors lie as if at random, most clusters have to be probed."""
    e = embeddings(spark, sf_dir)
    c = ann.train(e, 8)
    assigned, blocks = ann.assign(e, c), list(query_blocks(spark, sf_dir))
    found = [ann.probe_batch(assigned, c, q, ids, 10, 7) for ids, q in blocks]
    exact = [vectors.knn_batch(e, q, ids, 10) for ids, q in blocks]
    return ann.recall(reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, exact), ("query_id", "id"))


@register("lsh_recall", None)
def lsh_recall(spark, sf_dir):
    e, q = embeddings(spark, sf_dir), vector_of(spark, sf_dir, 0)
    return ann.recall(vectors.knn(ann.lsh_candidates(e, q, 32, 4), q, 10), vectors.knn(e, q, 10))
