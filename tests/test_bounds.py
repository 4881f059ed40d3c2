"""Work in bounded memory gives the results of brute force."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodequery.functions.batches import slices
from lodequery.operators import agent, ann, chunking, vectors


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot", "manhattan"])
def test_many_queries_in_bounded_memory(metric):
    """10,000 rows a batch and 2,000 queries: 160 MB of distances if taken at once."""
    rng = np.random.default_rng(3)
    m, q = rng.standard_normal((10_000, 8)).astype(np.float32), rng.standard_normal((2_000, 8))
    rows = pd.Series(list(m))
    tracemalloc.start()
    found = vectors.Nearest(q, 3, metric)
    found.add(rows, np.arange(len(m)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    qi, ids, d = found.rows()
    assert len(qi) == 3 * len(q)
    for i in range(0, len(q), 100):
        e, dots = m.astype(float) - q[i], m.astype(float) @ q[i]
        want = {
            "cosine": 1 - dots / np.linalg.norm(m.astype(float), axis=1) / np.linalg.norm(q[i]), "euclidean": np.linalg.norm(e, axis=1), "dot": -dots, "manhattan": np.abs(e).sum(1),
        }[metric]
        assert ids[qi == i].tolist() == np.argsort(want, kind="stable")[:3].tolist()
        assert np.allclose(d[qi == i], np.sort(want)[:3])


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot", "manhattan"])
def test_copies_of_a_vector_tie_by_id(spark, metric):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((37, 24)).round(3)
    ids = rng.permutation(37 * 11)
    df = spark.createDataFrame([(f"r{i:03d}", base[i % 37].tolist()) for i in ids.tolist()] + [(None, base[0].tolist()), ("z", [0.0] * 24)], "id string, vector array<double>")
    got = vectors.knn_batch(df.repartition(3), base, list(range(37)), 4, metric).collect()
    for i in range(37):
        mine = [r["id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])]
        first = int({"dot": (-(base @ base[i])).argmin()}.get(metric, i))
        copies = [f"r{j:03d}" for j in range(first, 37 * 11, 37)]
        assert mine == ([None] * (first == 0) + copies)[:4]


def test_centroids_in_bounded_memory(spark):
    rng = np.random.default_rng(5)
    c, m = rng.standard_normal((3_000, 4)), rng.standard_normal((900, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(m.tolist())] + [(900, None)], "id long, vector array<float>")
    got = {r["id"]: r["cid"] for r in ann.assign(df, c).collect()}
    want = ((m[:, None].astype(float) - c[None]) ** 2).sum(2).argmin(1).tolist()
    assert [got[i] for i in range(900)] == want and got[900] == 0


def test_a_batch_of_probes_is_one_pass(spark):
    rng = np.random.default_rng(6)
    m, c = rng.standard_normal((400, 4)).astype(np.float32), rng.standard_normal((6, 4))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(m.tolist())], "id long, vector array<float>")
    assigned = ann.assign(df, c)
    found = ann.probe_batch(assigned, c, m[:5].astype(float), list(range(5)), 7, 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    for i in range(5):
        want = [r["id"] for r in ann.probe_search(assigned, c, m[i].tolist(), 7, 2).collect()]
        assert [r["id"] for r in found.where(F.col("query_id") == i).orderBy("rank").collect()] == want


def _peak_of(udf, batch):
    """The rows that a task's function gives for a batch, and the most memory that it took besides the rows so far."""
    tracemalloc.start()
    out, most = [], 0
    for part in udf.func(iter([batch])):
        most = max(most, tracemalloc.get_traced_memory()[1])
        out.append(len(part))
        del part
        tracemalloc.reset_peak()
    tracemalloc.stop()
    return out, most


def _function(monkeypatch, module, make):
    """The Python function in a Column that ``make`` builds with ``module``."""
    held = []
    real = F.pandas_udf

    def keep(kind):
        def wrap(f):
            held.append(real(f, kind))
            return held[-1]

        return wrap

    monkeypatch.setattr(module.F, "pandas_udf", keep)
    make()
    return held[0]


@pytest.mark.parametrize("name", ["size", "sections", "bytes"])
def test_texts_of_a_batch_in_bounded_memory(spark, monkeypatch, name):
    texts = pd.Series([f"Line {i}. " * 300 for i in range(6_000)] + [None, ""])
    made = {
        "size": (chunking, lambda: chunking._sized(F.col("t"), 100, 0), texts),
        "sections": (chunking, lambda: chunking._cut_sections(F.col("t"), 100, 0), pd.Series([None if t is None else [t, "a"] for t in texts], dtype=object)),
        "bytes": (agent, lambda: agent.byte_embedding(F.col("t"), 64), pd.Series(["x" * 5_000_000, "y"])),
    }[name]
    sizes, most = _peak_of(_function(monkeypatch, *made[:2]), made[2])
    assert sum(sizes) == len(made[2]) and most < 20e6


def test_slices_keep_every_row():
    batches = [pd.Series(["a" * n for n in (5, 3_000_000, 1, 0)] + [None] * 3_000), pd.Series([], dtype=object)]
    got = list(slices(iter(batches)))
    assert pd.concat(got).tolist() == pd.concat(batches).tolist() and max(map(len, got)) <= 1024
    assert [x for x in map(len, got)][:2] == [1, 1]


def test_long_texts_are_cut_and_embedded_as_before(spark):
    texts = ["", None, "é" * 70_001, "ab. cd\n\n" * 40_000, *(f"Text {i}. " * (i % 50) for i in range(2_500))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got: dict = {}
    for r in chunking.by_size(df, 90, 10).orderBy("id", "index").collect():
        got.setdefault(r["id"], []).append((r["content"], r["start"], r["end"]))
    assert got == {i: chunking.cut_by_size(t, 90, 10) for i, t in enumerate(texts) if t}
    for r in df.select("text", agent.byte_embedding(F.col("text"), 7).alias("v")).collect():
        b = np.frombuffer((r["text"] or "").encode(), np.uint8) / 255
        v = np.array([b[k::7].sum() for k in range(7)])
        assert np.allclose(r["v"], v / (np.linalg.norm(v) or 1), atol=1e-6)
