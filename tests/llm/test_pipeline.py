"""The pipeline's stages, each against what its operator says of its own input."""

import pytest
from support import SF
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodequery.llm import ngram_join, quality_rules


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, f in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "t")
        f(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_stages(stages):
    first = stages["quality rules"][0]
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == first.columns, name
        assert after.count() > 0.6 * first.count()
    before, after = stages["quality rules"]
    kept = {r["doc_id"] for r in quality_rules.quality_rules(before).where("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept
    before, after = stages["n-gram Jaccard join"]
    kept = {r["component_id"] for r in ngram_join.ngram_join(before).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(kept)
    before, after = stages["packing"]
    assert after.groupBy("doc_id").agg(F.max("doc_tokens").alias("n"), F.sum("length").alias("m")).where("n <> m").count() == 0
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_run_on_unusual_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, rank int"
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", 1), (3, "word " * 100, "en", None, 5, None, 2), (None, " ".join(f"w{i}" for i in range(90)), None, "s", 3, "", 3)]
    for i, own in enumerate(([], rows + rows)):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        assert cp.run(spark, f"{tmp_path}/{i}").columns[0] == "doc_id"
    assert cp.run(spark, f"{tmp_path}/0").count() == 0


def test_near_copies_are_of_five_words_and_four_fifths(spark):
    """A text with one word changed has 41 of 51 five-word shingles in common with the first, and 42 of 50 four-word ones."""
    words = [f"w{i}" for i in range(50)]
    copy = [*words[:20], "x", *words[21:]]
    other = [f"v{i}" for i in range(50)]
    rows = [(1, words), (2, copy), (1, other), (None, [f"u{i}" for i in range(50)]), (None, [*(f"u{i}" for i in range(49)), "x"]), (None, None)]
    docs = spark.createDataFrame([(i, w and " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r["doc_id"], r["text"] and r["text"].split()[0]) for r in cp.near_copies(spark, docs, SF).collect()}
    assert got == {(1, "w0"), (1, "v0"), (None, "u0"), (None, None)} and cp.near_copies(spark, docs, SF).count() == 4
