import json
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodequery import errors
from lodequery.functions import distance as ds
from lodequery.functions import filters as fl
from lodequery.functions import quantize as qz
from lodequery.functions.text import query_tokens, tokens
from lodequery.operators import agent, bm25, bundles, chunking, memory, presets, rerank
from lodequery.operators.hybrid import Documents, OrderBy, Page, Search
from lodequery.sources.store import Config, Store, read_markdown
from lodequery.streaming import cdc

BATTERY = [{"cat": ["tech", "news", "sports", "food"][i % 4], "n": i, "score": i / 10, "active": i % 2 == 0, "tag_list": [f"t{i % 5}", "rust"]} for i in range(60)]
NAMED = [
    fl.eq("cat", "tech"), fl.ne("cat", "tech"), fl.gt("n", 20), fl.gte("score", 2), fl.lt("n", 5.5), fl.lte("score", 0.3), fl.between("n", 3, 9), fl.between("n"),
    fl.isin("cat", ["tech", "food"]), fl.nin("n", [1, 2]), fl.contains("cat", "EC"), fl.starts_with("cat", "S"), fl.ends_with("cat", "ws"), fl.regex("cat", "^t|d$"),
    fl.exists("n"), fl.exists("nope"), fl.exists("nope", False), fl.eq("active", True), fl.gt("active", False), fl.eq("n", "5"), fl.eq("tag_list.1", "rust"), fl.eq("tag_list.0", "t3"),
    fl.not_(fl.gt("nope", 3)), fl.all_of(), fl.any_of(), fl.eq("cat", "news") & (fl.lt("n", 30) | fl.gt("score", 5.5)), ~fl.eq("tag_list", "rust"), fl.ne("nope", 1),
]


def test_filter_battery(spark):
    df = spark.createDataFrame([(b["cat"], b["n"], b["score"], b["active"], b["tag_list"]) for b in BATTERY], "cat string, n long, score double, active boolean, tag_list array<string>")
    docs = spark.createDataFrame([(b["n"], json.dumps(b)) for b in BATTERY], "id long, j string").select("id", F.parse_json("j").alias("m"))
    for f in NAMED:
        want = [b["n"] for b in BATTERY if fl.matches(f, b)]
        assert [r["n"] for r in df.where(fl.compile_filter(f, fl.Columns(df))).orderBy("n").collect()] == want, f
        assert [r["id"] for r in docs.where(fl.compile_filter(f, fl.Variant("m"))).orderBy("id").collect()] == want, f


def test_filter_nan_and_nulls(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 5.0), (4, float("inf"))], "id long, x double")
    ids = lambda f: [r["id"] for r in df.where(fl.compile_filter(f, fl.Columns(df))).orderBy("id").collect()]
    assert ids(fl.gt("x", 1)) == [3, 4]
    assert ids(fl.eq("x", 5)) == [3]
    assert ids(fl.ne("x", 5)) == [1, 2, 4]
    assert ids(fl.not_(fl.gt("x", 1))) == [1, 2]


def test_filter_errors():
    for bad in ("[]", '{"a":{}}', '{"$and":{}}', '{"a":{"$near":1}}', '{"a":{"$regex":5}}', "{"):
        with pytest.raises(errors.InvalidFilter):
            fl.parse_filter(bad)
    with pytest.raises(errors.InvalidFilter):
        fl.parse_filter({})
    with pytest.raises(errors.InvalidFilter):
        fl.validate(fl.not_(fl.any_of(fl.regex("a", "("))))
    assert fl.parse_filter("{}") is None
    assert fl.parse_filter('{"a":1,"b":{"$gt":2,"$lt":5}}') == fl.And((fl.eq("a", 1), fl.gt("b", 2), fl.lt("b", 5)))


def test_distances(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = df.select(*[ds.distance_to(m, F.col("v"), [0.0, 0.0]) for m in ("l2", "l1", "cos", "inner")]).collect()
    assert [list(r) for r in got] == [[5, 7, 1, 0], [0, 0, 1, 0]]
    with pytest.raises(errors.InvalidVector):
        ds.check_query([1.0, math.nan])
    with pytest.raises(errors.DimensionMismatch):
        ds.check_query([1.0], 2)
    with pytest.raises(errors.InvalidConfig):
        ds.parse_distance("hamming2")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1, 1, width=32), min_size=2, max_size=70).filter(lambda v: len(v) % 2 == 0))
def test_quantised_round_trips(spark, v):
    df = spark.createDataFrame([(v,)], "v array<float>")
    c = F.col("v")
    r = df.select(
        qz.int8_decoded(qz.int8(c)).alias("a"), qz.int3(c).alias("b"), qz.unpacked(qz.packed(qz.int3(c), 3), 3, len(v)).alias("b2"), qz.binary(c).alias("d"),
        qz.unpacked(qz.packed(qz.binary(c), 1), 1, len(v)).alias("d2"), qz.polar(c, len(v)).alias("p"), qz.polar_decoded(qz.polar(c, len(v)), len(v)).alias("u"),
    ).first()
    assert max(abs(x - y) for x, y in zip(v, r["a"], strict=True)) < 0.02
    assert r["b"] == r["b2"] and r["d"] == r["d2"]
    assert all(0 <= x < 8 for x in r["p"]) and abs(sum(x * x for x in r["u"]) - len(v) / 2) < 1e-6


def test_rotation_is_a_signed_permutation():
    signs, order = qz.rotation(64)
    assert sorted(order) == list(range(64)) and set(signs) == {1, -1}


def test_tokens(spark):
    text = "Hello, é中 WORLD-42 a b_c ǅ"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(tokens(F.col("t")).alias("x")).collect()
    assert got[0]["x"] == query_tokens(text) and got[1]["x"] == []


def test_bm25_order_is_term_frequency(spark):
    df = spark.createDataFrame([(i, "rust " * (i + 1) + "pad " * (19 - i)) for i in range(20)], "id long, text string")
    hits = bm25.search(bm25.index(df, F.col("text")), "rust", 5)
    assert [r["id"] for r in hits.collect()] == [19, 18, 17, 16, 15]
    assert bm25.search(bm25.index(df, F.col("text")), "", 5).count() == 0


def _line(spark, n=20):
    return spark.createDataFrame([(i, [float(i), 0.0, 0.0, 0.0], f"term {'x ' * i}", i < 5) for i in range(n)], "id long, vector array<float>, text string, deleted boolean")


def test_offsets_limits_and_soft_delete(spark):
    d = Documents(_line(spark), vector="vector", dimensions=4, metric="euclidean", text=["text"])
    s = Search.by_vector([0.0] * 4, 5)
    assert [r["id"] for r in d.search(s.with_offset(18)).collect()] == [18, 19]
    assert d.search(s.with_offset(50)).count() == 0
    gone = Documents(_line(spark), vector="vector", dimensions=4, metric="euclidean", text=["text"], deleted="deleted")
    assert min(r["id"] for r in gone.search(s).collect()) == 5
    hybrid = gone.search(Search.hybrid([0.0] * 4, "term", 10).with_filter(fl.gte("id", 12)))
    assert sorted(r["id"] for r in hybrid.collect()) == list(range(12, 20))
    assert [r["id"] for r in gone.search(s.with_order(OrderBy("id", True))).collect()] == [19, 18, 17, 16, 15]
    with pytest.raises(errors.FulltextNotEnabled):
        Documents(_line(spark)).search(Search.by_keyword("x", 1))
    page = gone.list(limit=4, offset=8)
    assert (page.total, page.has_more, page.total_pages, page.current_page) == (15, True, 4, 2)
    assert Page(None, 3, 0, 0).total_pages == 0


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "a", 0.1), (2, None, 0.2), (3, "b", 0.3)], "id long, text string, distance double")
    out = rerank.rerank(hits, "q", "text", lambda q, ts: [0.2 if t == "a" else 0.9 for t in ts]).collect()
    assert [r["id"] for r in out] == [3, 1, 2] and abs(out[0]["distance"] - 0.1) < 1e-9
    assert [r["id"] for r in rerank.rerank(hits.where("text IS NULL"), "q", "text", lambda q, ts: []).collect()] == [2]


def test_cut_by_size_multibyte():
    text = "你好世界" * 3
    parts = chunking.cut_by_size(text, 7, 0)
    assert "".join(p for p, _, _ in parts) == text and all(len(p.encode()) <= 7 for p, _, _ in parts)
    for target, overlap in ((5, 2), (3, 5), (1, 0)):
        parts = chunking.cut_by_size("ááá ñññ 你好 😀😀. \n\nend", target, overlap)
        assert parts[-1][2] == len("ááá ñññ 你好 😀😀. \n\nend".encode())


def test_chunkers(spark):
    text = "intro\n\n# A\ntext a\n### deep\nx\n## B\n\n```py\ncode\n```\ntail\n```\nopen"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "   ")], "id long, text string")
    heads = chunking.by_heading(df).orderBy("index").collect()
    assert [(r["heading"], r["level"], r["id"]) for r in heads] == [(None, None, 1), ("A", 1, 1), ("B", 2, 1)]
    assert "### deep" in heads[1]["content"] and heads[0]["total"] == 3
    code = chunking.by_code_block(df).orderBy("index").collect()
    assert [(r["type"], r["language"]) for r in code] == [("text", None), ("code", "py"), ("text", None), ("code", None)] and code[3]["content"] == "open"
    assert [r["content"] for r in chunking.by_paragraph(df, 2, 2).orderBy("index").collect()][0].startswith("intro")
    assert chunking.hybrid(df, 2, 10, 0).where("id = 1").count() > 3


def test_bundle(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text('---\ntype: note\ntitle: "A: b" # c\ntags:\n  - x\n  - y\nnested:\n  k: v\n---\nbody rust here')
    (tmp_path / "sub" / "B.MD").write_text("no front")
    (tmp_path / "sub" / "c.md").write_text("---\ntype: note\nnever closed")
    (tmp_path / "sub" / "d.md").write_text("---\ntitle: t\n---\nx")
    (tmp_path / "index.md").write_text("---\ntype: x\n---\n")
    chunks, skipped = bundles.ingest(bundles.read_bundle(spark, str(tmp_path)))
    row = chunks.collect()[0]
    assert (row["concept"], row["concept_type"], row["title"], row["tags_text"], row["id"]) == ("a", "note", "A: b", "x,y", "a#0")
    assert {r["concept"]: r["skipped"][:6] for r in skipped.collect()} == {"sub/B": "no fro", "sub/c": "broken", "sub/d": "missin"}
    assert bundles.search(chunks, "rust", 5).count() == 1 and bundles.search(chunks, "rust", 5, "other").count() == 0
    assert bundles.upsert(chunks, chunks).count() == 1


def _model(ops, base):
    state, applied, skipped = dict(base), 0, 0
    for op, key, value in ops:
        if op == "insert" and key not in state or op == "update":
            state[key] = value
        elif op == "delete" and key in state:
            del state[key]
        else:
            skipped += 1
            continue
        applied += 1
    return state, applied, skipped


def test_apply_changes_against_a_model(spark):
    rng = random.Random(5)
    for _ in range(3):
        ops = [(rng.choice(["insert", "update", "delete"]), rng.randrange(6), float(i)) for i in range(40)]
        base = {k: -1.0 for k in range(0, 6, 2)}
        log = spark.createDataFrame([(i, *o) for i, o in enumerate(ops)], "seq long, op string, id long, value double")
        state, counts = cdc.apply_changes(log, spark.createDataFrame(list(base.items()), "id long, value double"))
        want, applied, skipped = _model(ops, base)
        assert {r["id"]: r["value"] for r in state.collect()} == want
        assert tuple(counts.first()) == (applied, skipped)


def test_state_table_ignores_repeated_batches(spark, tmp_path):
    t = cdc.StateTable(spark, str(tmp_path / "s"))
    b = spark.createDataFrame([(0, "insert", 1, "a"), (1, "delete", 1, "a"), (2, "insert", 2, "b")], "seq long, op string, id long, v string")
    t.upsert(b, 0)
    t.upsert(b, 0)
    t.upsert(spark.createDataFrame([(3, "clear", None, None), (4, "insert", 3, "c")], b.schema), 1)
    assert [(r["id"], r["v"]) for r in t.state().collect()] == [(3, "c")]


def test_store(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "t"), Config(2, text=("note",)), "note string")
    rows = spark.createDataFrame([("a", [1.0, 0.0], "rust one"), ("b", None, "two")], "id string, vector array<float>, note string")
    s.insert(rows)
    with pytest.raises(errors.AlreadyExists):
        s.insert(rows)
    with pytest.raises(errors.DimensionMismatch):
        s.upsert(spark.createDataFrame([("z", [1.0])], "id string, vector array<float>"))
    with pytest.raises(errors.InvalidVector):
        s.upsert(spark.createDataFrame([("z", [1.0, float("inf")])], "id string, vector array<float>"))
    s.upsert(spark.createDataFrame([("a", [0.0, 1.0], "new")], rows.schema))
    again = Store.open(spark, s.path)
    assert again.config == s.config and again.count() == 2 and again.contains("b") and not again.contains("q")
    assert again.get("a").first()["note"] == "new"
    assert again.documents().search(Search.by_keyword("two", 3)).first()["id"] == "b"
    md = tmp_path / "x.md"
    md.write_text("# T\nbody")
    assert again.ingest_markdown(read_markdown(spark, str(md)).withColumnRenamed("name", "concept")) == 1
    assert again.delete(spark.createDataFrame([("a",), ("nope",)], "id string")) == 1
    again.vacuum()
    again.clear()
    assert again.is_empty()
    with pytest.raises(errors.NotFound):
        Store.open(spark, str(tmp_path / "none"))
    with pytest.raises(errors.InvalidConfig):
        Config(3, quantization="polar")


def test_memory_rules(spark):
    p = presets.SOFTWARE
    df = spark.createDataFrame([("validate input and handle error in our api",), ("nothing",)], "content string")
    rows = memory.learned(df, p, 1000).collect()
    assert (rows[0]["domain"], rows[0]["transfer_level"], rows[0]["priority"]) == ("web_backend", "universal", "high")
    assert (rows[1]["domain"], rows[1]["transfer_level"], rows[1]["priority"]) == ("general", "context", "normal")
    score = spark.range(1).select(memory.language_compatibility("rust", F.lit("go")), p.relatedness("systems", F.lit("embedded")), p.compatibility("rust", F.lit("cpp"))).first()
    assert list(score) == [0.7, 0.7, 0.8]
    with pytest.raises(errors.InvalidConfig):
        memory.Recall(0, 0, 0)
    assert agent.parse_language("RS") == "rust" and memory.knowledge_domain("iot") == "embedded"


def test_log_damaged_before_its_last_record_is_an_error(spark):
    log = lambda bad: spark.createDataFrame([(i, i != bad) for i in range(6)], "seq long, ok boolean")
    assert cdc.valid_prefix(log(5)).count() == 5 and cdc.valid_prefix(log(9)).count() == 6
    with pytest.raises(Exception, match="before the last"):
        cdc.valid_prefix(log(3)).collect()
    assert cdc.valid_prefix(log(3).limit(0)).count() == 0


def test_chunks_of_repeated_documents_and_clashing_columns(spark):
    text = "# A\n" + "one two. " * 4 + "\n# B\nshort"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "y")], "id long, text string, content string")
    rows = chunking.hybrid(df, 1, 30, 0).collect()
    assert len(rows) == 2 * rows[0]["total"] and {r["id"] for r in rows} == {1}
    assert sorted(r["index"] for r in rows) == sorted([*range(rows[0]["total"])] * 2)
    assert {r["heading"] for r in rows} == {"A", "B"} and "x" not in {r["content"] for r in rows}
    assert {r["heading"] for r in chunking.by_heading(df).collect()} == {"A", "B"}


def test_working_contexts(spark):
    rows = [
        (1, 1, "goal", "lost", None), (1, 2, "clear", None, None), (1, 3, "goal", "a", None), (1, 4, "done", "a", None), (1, 5, "goal", "b", None), (1, 6, "goal", "a", None),
        (1, 7, "file", "x", None), (1, 8, "file", "y", None), (1, 9, "file", "x", None), (1, 10, "project", "p", None), (1, 11, "project", "q", None),
        *[(1, 20 + i, "turn", f"t{i}", "user") for i in range(25)], *[(1, 50 + i, "error", f"e{i}", None) for i in range(12)], (2, 1, "task", "gone", None), (2, 2, "clear", None, None),
    ]
    events = spark.createDataFrame(rows, "session long, order long, kind string, value string, role string")
    stored = agent.saved_contexts(agent.working_contexts(events))
    assert {r["type"] for r in stored.collect()} == {agent.INTERNAL}
    [c] = agent.loaded_contexts(stored).withColumn("text", agent.context_string()).collect()
    assert c["session"] == "1" and c["text"] == "Project: q\nGoals: b, a\nFiles: x, y"
    assert [t["value"] for t in c["turns"]] == [f"t{i}" for i in range(5, 25)] and c["errors"] == [f"e{i}" for i in range(2, 12)]
