"""The ten operators: brute force, round trips, accuracy, and unusual input."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from support import SF, same_as_sql
from pyspark.sql import functions as F

from lodequery.llm import (
    chat_format,
    flac_media,
    html_extract,
    language_id,
    license_scan,
    line_dedup,
    ngram_join,
    packing,
    quality_rules,
    queries,
    sentence_pieces,
)
from lodequery.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, labels string, kept boolean, score double"
LONG = "the quick brown fox jumps over " * 9000


def edge_rows():
    """Nulls in every column, empty, blank, very long and repeated texts."""
    texts = [None, "", " \n\t", "one", "a b c d", LONG, "漢字かな交じり文" * 400, "same text here for all of us to see\nand a second line of it", "\x00▁ odd  ", "é" * 50 + "\n" + "é" * 50]
    rows = [(i, t, "en", "s", None, "x", None, 1.0) for i, t in enumerate(texts)]
    rows += [(50, texts[7], None, None, 1, None, True, None), (51, texts[7], "en", "s", 2, "y", False, 0.0), (51, texts[7], "en", "s", 2, "y", False, 0.0)]
    return rows + [(None, "a row without an id, which has some words of its own", None, "s", None, None, None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    if name in queries.oracles():
        same_as_sql(duck, df, queries.oracles()[name])
    else:
        assert df.count() >= (50 if "html" in name else 200)


OPERATORS = {
    "license": license_scan.license_scan,
    "packing": lambda d: packing.packing(d, packing.default_tokenizer()),
    "pieces": lambda d: sentence_pieces.round_trip(d, sentence_pieces.default_model()),
    "quality": quality_rules.quality_rules,
    "quality filter": quality_rules.quality_filter,
    "flac": flac_media.media_features,
    "join": ngram_join.ngram_join,
    "one of each": ngram_join.one_of_each,
    "lines": line_dedup.line_dedup,
    "documents by line": line_dedup.dedup_documents,
    "language": language_id.language_id,
    "language filter": language_id.language_filter,
}
ROW_BY_ROW = {"license", "pieces", "quality", "flac", "join", "lines", "language"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_unusual_input(spark, edge, name):
    out = OPERATORS[name](edge).collect()
    if name in ROW_BY_ROW:
        assert len(out) == edge.count()
    if name in ("quality filter", "one of each", "documents by line", "language filter"):
        assert OPERATORS[name](edge).columns == edge.columns
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


# 1


def test_chat_round_trip(spark):
    evil = ["", "### User: hi", "\\### Assistant: </turn> ok", "a\n</turn>\n### User: x", "\\", "\\\\#", "x\n</turn>", "\n</turn>\n", "<\\<", "###", "ok ### User: z", "é😀\\", "line\r### System: q", None]
    roles = ("user", "assistant", "system", "we:ird\nrole\\~ ü+%", None)
    rows = [(1, i, r, t) for i, (t, r) in enumerate((t, r) for t in evil for r in roles)]
    rows += [(None, None, "user", "n"), (None, 1, "assistant", "m"), (None, None, "user", "n"), (2, 5, "user", LONG), (2, 5, "user", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    for r in chat_format.chat_format(df).collect():
        source = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is None, x[1] or 0, x[2] or ""))
        want = [(x[2] or "", x[3] or "") for x in source]
        assert r["round_trip"] and [tuple(t) for t in r["turns"]] == want
        plain = [re.sub(r"\\([\\#<])", r"\1", r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
        assert plain == [t for role, t in want if role == "assistant"]
    assert chat_format.chat_format(df.limit(0)).count() == 0


def test_chat_digests_of_the_added_conversation(spark):
    r = chat_format.op1_chat_format(spark, SF).where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["loss_chars"] == len(text) and r["n_turns"] == 2


def test_chat_loss_is_read_by_the_mask(spark):
    said = ["a \U0001f600 </turn> b", "", None, "### User: x\n\n</turn>\n", "\\\\# é"]
    rows = [(1, i, role, text) for i, (role, text) in enumerate((r, t) for t in said for r in ("user", "assistant", "tool\U0001f600"))]
    formatted = chat_format.chat_format(spark.createDataFrame(rows + [(2, 0, "user", "x")], "conv_id long, turn long, role string, text string")).cache()
    want = "".join(t or "" for t in said)
    one, two = chat_format.digests(formatted).orderBy("conv_id").collect()
    assert one["loss_chars"] == len(want) and one["loss_sha256"] == hashlib.sha256(want.encode()).hexdigest() and one["round_trip"]
    assert two["loss_chars"] == 0 and two["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    first = formatted.withColumn("loss_spans", F.slice("loss_spans", 1, 1)).where("conv_id = 1")
    assert chat_format.digests(first).first()["loss_chars"] == len(said[0])


# 2


def test_template_automata():
    s = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES)
    labels = lambda t: s.scan(t)[5]
    assert labels("Released under the MIT License.") == "mit"
    assert labels("under the terms of the MIT license") == "mit" and labels("under the terms MIT license") == ""
    assert labels("GNU General Public License, version 3") == "gpl,gpl-3.0"
    assert labels("gnu general public license as published by the free software foundation either one or version 3") == "gpl,gpl-3.0"
    assert labels("Copyright (c) 2020 Some One. All rights reserved") == "copyright-notice,reserved"
    assert labels("copyright c a b c d e all rights reserved") == "reserved"
    assert labels("CC BY-NC-SA 4.0") == "cc-by,cc-by-nc"
    scan = s.scan("cc by x cc by")
    assert scan[:5] == (5, 2, 0, 3, "cc-by") and s.scan(None)[:4] == (0, 0, None, None)
    for bad in ("[[a]] b", "{{2}} b", "a [[b", "a ]] b", ""):
        with pytest.raises(ValueError):
            license_scan.compile_template("x", bad)


def _written(markup: str, optional: bool, fill: str | None = None) -> str:
    """The licence text that a template stands for, with or without its optional regions."""
    if optional:
        markup = re.sub(r"<<(begin|end)Optional>>", "", markup)
    while "<<begin" in markup:
        markup = re.sub(r"<<beginOptional>>((?!<<begin).)*?<<endOptional>>", "", markup, flags=re.S)
    return re.sub(r'<<var;.*?original="(.*?)".*?>>', lambda m: m[1] if fill is None else fill, markup, flags=re.S)


@pytest.mark.parametrize("label", sorted(license_scan.MARKUP))
def test_whole_licence_texts(label):
    s = license_scan.Scanner(license_scan.PHRASES, license_scan.all_templates())
    named = lambda t: set(s.scan(t)[5].split(",")) & set(license_scan.MARKUP)
    markup = license_scan.MARKUP[label]
    for optional in (True, False):
        text = _written(markup, optional)
        assert named(text) == {label} == named("/*\n * " + text.upper().replace("\n", "\n * ") + "\n */ int main")
        span = next(x for x in s.scan("one two " + text + " end")[7] if x["label"] == label)
        assert (span["start"], span["end"]) == (2, 2 + len(license_scan.words_of(text)))
        assert named(_written(markup, optional, "X")) == {label}
    if "<<var" in markup:
        assert named(_written(markup, True, "x " * 21)) == set()
    words = [w.decode() for w in license_scan.words_of(_written(re.sub(r"<<var.*?>>", "", markup, flags=re.S), False))]
    kept = [w.decode() for w in license_scan.words_of(_written(markup, False))]
    mandatory = [i for i, w in enumerate(kept) if w in words and kept.count(w) == words.count(w)]
    for i in mandatory:
        assert label not in named(" ".join(kept[:i] + ["zzz"] + kept[i + 1 :])), kept[i]
        assert label not in named(" ".join(kept[:i] + kept[i + 1 :])), kept[i]


def test_sql_on_whole_licence_texts():
    """The documents of the test tables hold no whole licence: the query's SQL and the operator on texts that do."""
    import duckdb

    s = license_scan.Scanner(license_scan.PHRASES, license_scan.all_templates())
    texts = [_written(m, o, f) for m in license_scan.MARKUP.values() for o in (True, False) for f in (None, "x y", "x " * 21)]
    texts += ["(c) me. All rights reserved. " + t + "\n\n" + t for t in texts[::4]] + [None, "", "under the MIT license"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    found = con.sql(license_scan.oracle()).order("doc_id").fetchall()
    assert [r[1:] for r in found] == [s.scan(t)[:7] for t in texts]
    assert {x for r in found for x in r[6].split(",")} >= set(license_scan.MARKUP)


def test_markup():
    assert license_scan.from_markup('A <<beginOptional>>b, <<var;name="x";match=".+">><<endOptional>> C-d') == "a [[ b {{1,20}} ]] c d"
    assert license_scan.from_markup('a <<var;name="x";original="y";match=".{2,3}">>') == "a {{2,3}}"
    assert license_scan.from_markup('a <<var;name="x";original="y";match=".*">> b') == "a {{0,20}} b"
    with pytest.raises(ValueError):
        license_scan.from_markup("a <<other>> b")


def test_automaton_against_regex():
    rng, words = random.Random(3), ["a", "b", "c", "d"]
    for template in ("a [[b]] c", "a {{2}} d", "a {{1,3}} d", "a {{2,2}}", "a [[b {{1}} c]] d [[a]]", "a [[b [[c]] d]] a"):
        auto = license_scan.compile_template("x", template)
        rx = re.compile(license_scan._as_regex(template))
        for _ in range(300):
            text = [rng.choice(words) for _ in range(rng.randrange(1, 9))]
            joined = "".join(w + " " for w in text)
            ends = [k for k in range(len(text) + 1) if rx.fullmatch("".join(w + " " for w in text[:k]))]
            assert auto.longest([w.encode() for w in text], 0) == (max(ends) if ends else None), (template, joined)


# 3


def test_packing(spark, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = edge.where("doc_id IS NOT NULL AND doc_id <> 51").unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"), allowMissingColumns=True)
    texts = {r["doc_id"]: r["text"] or "" for r in rows.select("doc_id", "text").collect()}
    out = packing.packing(rows, packing.default_tokenizer()).toPandas()
    by_doc = dict(tuple(out.groupby("doc_id")))
    for doc_id, text in texts.items():
        ids, at = np.array(tok.encode(text, add_special_tokens=False).ids + [1], "<u4"), 0
        for p in by_doc[doc_id].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.concatenate(([0], np.cumsum(s["length"])[:-1]))).all()
        n = int(s["length"].sum())
        assert n == 2048 or n < 2048 and n & (n - 1) == 0


def test_least_squares_counts():
    hist = np.zeros(64, np.int64)
    hist[[10, 54, 20, 44, 30, 4]] = [7, 5, 3, 3, 2, 2]
    combos = packing.combinations(hist, 64)
    assert (10, 54) in combos and (4, 30, 30) in combos and all(sum(c) == 64 for c in combos)
    x = packing.solve(hist, combos)
    assert (x >= 0).all()
    plan = packing.Plan(hist, 64)
    pieces = collections.defaultdict(int)
    for length in np.flatnonzero(hist):
        for rank in range(hist[length]):
            for _, n, sequence, _ in plan.place(int(length), rank):
                pieces[sequence] += n
    assert sum(pieces.values()) == int((hist * np.arange(64)).sum()) and all(n == 64 or n & (n - 1) == 0 for n in pieces.values())


# 4


def test_pieces_equal_the_library(docs):
    import sentencepiece

    own, lib = sentence_pieces.load(sentence_pieces.default_model()), sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    texts = [r["text"] for r in docs.select("text").collect()] + [r[1] or "" for r in edge_rows()] + ["  a  b \n c\t", "😀 ▁x", "x" * 300 + "  " * 30, "\u0007é"]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert ids.tolist() == lib.encode(text)
        assert own.decode(ids) == lib.decode(lib.encode(text))


def test_viterbi_against_brute_force():
    rng = random.Random(1)
    letters = "abc"
    table = [("<unk>", 0.0, "unknown")] + [(c, -rng.random() * 5, "normal") for c in "ab"]
    table += [("".join(rng.choice(letters) for _ in range(n)), -rng.random() * 8, "normal") for n in (2, 2, 2, 3, 3, 4)]
    table = list({t[0]: t for t in table}.values())
    p = sentence_pieces.Pieces(table, "unigram", dummy_prefix=False)
    scores = {t: (i, s) for i, (t, s, k) in enumerate(table) if k == "normal"}
    unknown = min(s for _, s in scores.values()) - 10

    def best(w):
        if not w:
            return 0.0
        return max((scores[w[:k]][1] if w[:k] in scores else unknown if k == 1 else -np.inf) + best(w[k:]) for k in range(1, len(w) + 1))

    for n in (1, 3, 6):
        words = sorted({"".join(rng.choice(letters) for _ in range(n)) for _ in range(30)})
        cuts, count, found = p.viterbi(words)
        for r, w in enumerate(words):
            value = sum(table[i][1] if i >= 0 else unknown for i in found[r, : count[r]])
            assert abs(value - best(w)) < 1e-9
            assert all(i < 0 or table[i][0] == w[a:b] for i, a, b in zip(found[r, : count[r]], cuts[r], cuts[r, 1:], strict=False))


# 5


def _quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines, seen, dup = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


def test_quality_counts(spark, docs, edge):
    rows = docs.select("doc_id", "text", "lang", "source").unionByName(edge.select("doc_id", "text", "lang", "source"))
    extra = spark.createDataFrame([(-1, "a b c d e f g h i a b c d e f g h i x", None, None), (-2, "w " * 30, None, None), (-3, "l x\n\nl x\n \nl x", None, None)], rows.schema)
    rows = rows.unionByName(extra)
    want = collections.Counter((r["doc_id"], *_quality(r["text"])) for r in rows.collect())
    got = quality_rules.quality_rules(rows).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"])


def test_quality_keeps_clean_and_drops_junk(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules.quality_rules(d).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r["quality"]: r["share"] for r in got}
    assert share[1] > 0.99 and share[0] < 0.1


# 6


def _scalar_decode(media):
    """A plain bit-by-bit decoder of the streams, apart from the operator's own."""
    pos, last = 4, False
    while not last:
        last, kind, size = media[pos] >> 7, media[pos] & 127, int.from_bytes(media[pos + 1 : pos + 4], "big")
        if kind == 0:
            samples = int.from_bytes(media[pos + 14 : pos + 22], "big") & (1 << 36) - 1
        pos += 4 + size
    at, out = pos * 8, []

    def bits(n):
        nonlocal at
        v = 0
        for _ in range(n):
            v = v << 1 | media[at >> 3] >> (7 - (at & 7)) & 1
            at += 1
        return v

    def signed(n):
        v = bits(n)
        return v - (1 << n) if v >> (n - 1) else v

    while len(out) < samples:
        assert bits(16) == 0xFFF8
        size_code = bits(4)
        bits(12)
        first = bits(8)
        for _ in range(0 if first < 128 else 8 - (first ^ 0xFF).bit_length() - 1):
            bits(8)
        n = bits(16) + 1 if size_code == 7 else 512
        bits(8)
        kind = bits(8) >> 1
        if kind == 0:
            block = [signed(8)] * n
        elif kind == 1:
            block = [signed(8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            block = [signed(8) for _ in range(order)]
            coef, shift = flac_media.FIXED.get(order, ()), 0
            if kind >= 32:
                precision = bits(4) + 1
                shift = bits(5)
                coef = [signed(precision) for _ in range(order)]
            assert bits(6) == 0
            k = bits(4)
            for _ in range(n - order):
                q = 0
                while not bits(1):
                    q += 1
                u = q << k | bits(k)
                block.append((u >> 1 ^ -(u & 1)) + (sum(c * x for c, x in zip(coef, block[::-1], strict=False)) >> shift))
        out += block
        at = (at + 7) // 8 * 8 + 16
    return bytes(x + 128 for x in out)


def test_flac_streams(docs):
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()] + [None, "", "a" * 2000, "ab" * 900]
    payloads = [flac_media.payload_of(t) for t in texts] + [bytes(range(256)) * 3, random.Random(2).randbytes(64 * 700)]
    media = flac_media.encode_all(payloads)
    assert flac_media.decode_all(media) == payloads
    for p, m in list(zip(payloads, media, strict=True))[::5] + [(payloads[-2], media[-2])]:
        assert _scalar_decode(m) == p


def test_flac_damage_is_found():
    media = bytearray(flac_media.encode_all([flac_media.payload_of("some text " * 200)])[0])
    for at in (len(media) - 1, len(media) // 2):
        bad = bytearray(media)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac_media.decode_all([bytes(bad)])
    with pytest.raises(ValueError):
        flac_media.decode_all([b"RIFF"])


def test_flac_query_against_plain_python(spark, docs):
    rows = {r["doc_id"]: r for r in flac_media.op6_flac_media(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert rows.keys() == texts.keys()
    media = flac_media.encode_all([flac_media.payload_of(texts[k]) for k in rows])
    for (k, r), m in zip(rows.items(), media, strict=True):
        raw = (texts[k] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        samples = [b - 128 for b in payload]
        mean, rms = sum(samples) / len(samples), (sum(s * s for s in samples) / len(samples)) ** 0.5
        crossings = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest())
        assert r["feature"] == f"mean={mean:.4f};rms={rms:.4f};crossings={crossings}" and r["error"] is None


def test_flac_damage_is_an_error_of_its_row(spark):
    good = flac_media.encode_all([flac_media.payload_of("some text " * 200)])[0]
    bad = [good[:-1] + bytes([good[-1] ^ 4]), good[: len(good) // 2], good[:3], b"RIFF", b"fLaC", good[:30]]
    rows = [(0, good), *enumerate(bad, 1), (9, good), (10, None)]
    blocks = flac_media.pcm_blocks(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert {b["doc_id"] for b in blocks if b["error"] is None} == {0, 9}
    assert sorted(b["doc_id"] for b in blocks if b["error"]) == [1, 2, 3, 4, 5, 6]
    assert all(b["pcm"] is None and b["sample_offset"] is None for b in blocks if b["error"])


def test_pcm_blocks_are_seekable(spark):
    df = spark.createDataFrame([(1, "abc " * 5000), (2, None)], "doc_id long, text string")
    stored = df.select("doc_id", flac_media.flac_column("text").alias("media"))
    blocks = flac_media.pcm_blocks(stored).orderBy("doc_id", "sample_offset").collect()
    joined = collections.defaultdict(bytes)
    for b in blocks:
        assert b["sample_offset"] == len(joined[b["doc_id"]])
        joined[b["doc_id"]] += bytes(b["pcm"])
    assert joined[1] == flac_media.payload_of("abc " * 5000) and joined[2] == bytes(64)


# 7


def _components(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=4, groups=12, most=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(60)]
    texts, i = {}, 0
    for g in range(groups):
        base = [word() for _ in range(rng.choice([4, 7, 9, 12, 30, 80, 200]))]
        for _ in range(rng.randrange(1, most)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = word()
            texts[i] = " ".join(shared + w if g % 4 == 0 else w).title() if g % 3 else " ".join(w)
            i += 1
    texts |= {i: "", i + 1: None, i + 2: "one two", i + 3: "ONE two", i + 4: "one two three four five six seven eight nine ten", i + 5: "one two three four five six seven eight nine"}
    return texts


@pytest.mark.parametrize("blocks, boundary", [(False, None), (True, 0), (False, 31), (False, 1 << 30)])
def test_join_against_all_pairs(spark, monkeypatch, blocks, boundary):
    """All sets heavy, some, or all light: the results are the same."""
    if blocks:
        monkeypatch.setattr(ngram_join, "BLOCK_VALUES", 150)
    if boundary is not None:
        monkeypatch.setattr(ngram_join, "_boundary", lambda *_: boundary)
    texts = near_copies()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df).collect()}
    assert got == _components(texts)


@pytest.mark.parametrize("percent", [70, 100])
def test_join_at_other_thresholds(spark, percent):
    texts = near_copies(6, 6, 8)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df, percent=percent).collect()}
    assert got == _components(texts, percent)
    with pytest.raises(ValueError):
        ngram_join.ngram_join(df, percent=50)


def test_join_boundary_by_cost(spark):
    """Sets whose lists are long are light, those whose lists are short heavy, and none beyond the bound on subsets."""
    sized = lambda rows: spark.createDataFrame(rows, "n long, keys2 int, scanned long")
    assert ngram_join._boundary(sized([(20, 5, 4), (40, 8, 7)]), 85) == 0
    assert 20 < ngram_join._boundary(sized([(20, 5, 400), (40, 8, 7)]), 85) <= 40
    limit = ngram_join._largest_light(85)
    assert ngram_join._boundary(sized([(20, 5, 400), (limit, 10, 1 << 40)]), 85) <= limit
    assert limit - ngram_join._need(limit, 85) + 2 > ngram_join.LIGHT_KEYS
    assert ngram_join._boundary(sized([]), 85) == 0


def test_one_of_each(spark, edge):
    kept = [r["doc_id"] for r in ngram_join.one_of_each(edge).collect()]
    assert kept.count(7) == 1 and 50 not in kept and 51 not in kept and None in kept and 0 in kept and 1 in kept
    twice = spark.createDataFrame([(1, "a b c d e")] * 2 + [(2, "x y")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(twice).collect()) == [1, 2]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8


def test_lines_against_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 8)))
    bases = [[word() for _ in range(rng.randrange(8, 40))] for _ in range(25)]
    docs = {}
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = word()
            lines.append(" ".join(w) if rng.random() < 0.9 else "short")
        docs[i] = "\n".join(lines)
    grams = lambda x: {x[k : k + 5] for k in range(len(x) - 4)}
    first = {}
    for i in sorted(docs):
        for k, x in enumerate(docs[i].split("\n")):
            if len(x.strip()) >= 20:
                first.setdefault(x, (i, k))
    names, root = list(first), {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(names):
        for b in names[:n]:
            ga, gb = grams(a), grams(b)
            if len(ga & gb) >= 0.8 * len(ga | gb):
                root[find(a)] = find(b)
    keep = {}
    for x in names:
        keep[find(x)] = min(keep.get(find(x), (1 << 30, 0)), first[x])
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if len(x.strip()) < 20 or keep[find(x)] == (i, k)) for i, t in docs.items()}
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_lines_of_equal_and_short_texts(spark, edge):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(edge).collect()}
    assert got[0]["n_lines"] == 0 and got[2]["n_dropped"] == 0 and got[3]["text"] == "one"
    assert got[7]["n_dropped"] == 0 and got[50]["text"] == "" and got[9]["n_dropped"] == 1
    kept = [r["doc_id"] for r in line_dedup.dedup_documents(edge).collect()]
    assert 7 in kept and 50 not in kept and 0 in kept


# 9

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- ad --><div class="cookie-notice">We use cookies</div>
<main><article><h1>The  title &amp; more</h1><p>First&nbsp;<b>bold</b> text,<br>next.<p>Second</p><div class="ad">Buy now</div><form><p>Sign up</p></form>
<p><a href=/x>A link</a></p><ul><li>item one</li></ul><aside>side</aside><section id="comments"><p>Nice post</p></section><p>Last &lt;one&gt;</p></article></main>
<footer><p>&copy; all</p></footer></body></html>"""


def test_html_article():
    assert html_extract.main_text(PAGE) == "The title & more\nFirst bold text, next.\nSecond\nA link\nitem one\nLast <one>"
    assert [html_extract.main_text(x) for x in (None, "", "<p", "<script>x", "</div></p>")] == [""] * 5 or html_extract.main_text("<p") in ("", "<p")


def test_html_without_article():
    good = "The cat is on the mat and it was one of the many that they had seen in the house of the king. " * 3
    page = f"<nav><a href=1>One</a> <a href=2>Two</a></nav><div><h2>Short head</h2><p>{good}</p><p>Short line.</p><p>{good}</p></div><div><a href=3>more of the links</a> x</div><p>© x</p>"
    assert html_extract.main_text(page) == f"Short head\n{good.strip()}\nShort line.\n{good.strip()}"


def test_html_pages(spark):
    import html

    def article(page):
        inner = re.search(r"(?s)<article>(.*)</article>", page)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)(?: [^>]*)?>", inner)]
        return "\n".join(x for x in parts if x)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = html_extract.html_extract(pages.withColumn("text", F.lit("clash"))).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)
    odd = spark.createDataFrame([(None, None, None), (1, None, ""), (2, "u", "<p>" * 5000 + "x")], "page_id long, url string, html string")
    assert [r["n_chars"] for r in html_extract.html_extract(odd).orderBy(F.col("page_id").asc_nulls_first()).collect()][:2] == [0, 0]


# 10


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_id(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_mixture():
    langs = {"aa": "abc cab bca ", "bb": "xyz zyx yxz ", "cc": "mno onm nom "}
    n = np.full((language_id.BUCKETS, 3), language_id.SMOOTHING)
    for j, t in enumerate(langs.values()):
        n[:, j] += np.bincount(language_id.trigrams(t * 200), minlength=language_id.BUCKETS)
    model = np.log(n / n.sum(0)).astype(np.float32)
    own, share = language_id.infer(model, "abc cab bca " * 60 + "xyz zyx yxz " * 40)
    assert own.tolist() == [0, 1] and abs(share[0] - 0.6) < 0.05
    own, share = language_id.infer(model, "mno onm " * 30)
    assert own.tolist() == [2] and share[0] == 1
    assert language_id.infer(model, "12 34") is None and language_id.infer(model, None) is None


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "text here", None), (2, "123", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.language_id(df).collect()} == {"und"}


def test_line_dedup_finds_copies_among_lines_with_common_boilerplate(spark):
    """Every line of a band is a neighbour of few others; links must not be lost where most of each line is the same."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
    head, lines = " ".join(word() for _ in range(15)), []
    for _ in range(60):
        tail = [word() for _ in range(7)]
        lines += [" ".join([head, *tail]), " ".join([head, *tail[:-1], word()])]
    grams = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    label = list(range(len(lines)))
    for i, g in enumerate(grams):
        for j in range(i):
            if len(g & grams[j]) >= 0.8 * len(g | grams[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    wanted = {i for i, x in enumerate(label) if x != i}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert len(wanted) > 40
    assert {r["id"] for r in line_dedup.dropped_lines(docs).collect()} == wanted


def test_line_dedup_compares_lines_of_one_or_few_shingles(spark):
    """Long first words, text without spaces, and rulers have few distinct shingles at their words, or few at all."""
    pairs = [("Subscription services", "Subscription services."), ("本网站使用饼干来改善您的浏览体验请点击同意继续", "本网站使用饼干来改善您的浏览体验请点击同意继续。"), ("-" * 40, "-" * 60), ("=-" * 15, "=-" * 90)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(x for p in pairs for x in p)], "doc_id long, text string")
    assert {r["id"] for r in line_dedup.dropped_lines(docs).collect()} == {1, 3, 5, 7}


def test_line_dedup_compares_all_lines_of_crowded_bands(spark, monkeypatch):
    """Copies that share a band, and each prefix list, with many lines of one template; bands are cut into blocks."""
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 50)
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 8)))
    head, names = " ".join(word() for _ in range(12)), [word() for _ in range(24)]
    lines = list(dict.fromkeys(" ".join([head, *(rnd.choice(names) for _ in range(9))]) for _ in range(400)))
    lines += [x.rsplit(" ", 1)[0] + " " + word() for x in lines[:150]]
    grams = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    label = list(range(len(lines)))
    for i, g in enumerate(grams):
        for j in range(i):
            if label[i] != label[j] and len(g & grams[j]) >= 0.8 * len(g | grams[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    wanted = {i for i, x in enumerate(label) if x != i}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert len(wanted) >= 150
    assert {r["id"] for r in line_dedup.dropped_lines(docs).collect()} == wanted


def test_line_dedup_compares_lines_with_few_words_in_common(spark):
    """One long word and several short ones: most words differ, few shingles do."""
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120))
    docs = spark.createDataFrame([(0, f"{long} 1 2 3 4 5"), (1, f"{long} 6 7 8 9 5")], "doc_id long, text string")
    assert {r["id"] for r in line_dedup.dropped_lines(docs).collect()} == {1}


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "with-header", "search-page", "sidebar", "banner"])
def test_html_article_in_a_wrapper_with_a_bad_name(name):
    page = f"<body><div class='{name}'><article><header class='entry-header header'><h1>Head</h1></header><p>Some text.</p></article><div class='ad-box'>Buy</div></div></body>"
    assert html_extract.main_text(page) == "Head\nSome text."


def test_html_names_of_other_places():
    good = "The cat is on the mat and it was one of the many that they had seen in the house of the king. " * 3
    assert html_extract.main_text(f"<div class='promo'><p>{good}</p></div>") == good.strip()
    page = "<main><p>Text.</p><div class='ad-box'>Buy</div><p class='ad'>Buy</p></main><div id='comments'><article><p>Nice post</p></article></div>"
    assert html_extract.main_text(page) == "Text."


def test_line_dedup_recall(spark):
    """Of planted pairs at and above the threshold, of any length of line and word, at least 95 in 100 are found, and no other."""
    rnd = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    grams = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}

    def line(chars, longest):
        x = ""
        while len(x) < chars[0] or len(x) < chars[1] and rnd.random() < 0.9:
            x += "".join(rnd.choice(letters) for _ in range(rnd.randint(2, longest))) + " "
        return x[: chars[1] - 1] + "."

    def changed(x):
        y = x
        for _ in range(rnd.randint(1, 8)):
            i = rnd.choice([rnd.randrange(len(y)), len(y) - 1, 0])
            z = y[:i] + rnd.choice(["", rnd.choice(letters), rnd.choice(letters) + y[i : i + 1]]) + y[i + 1 :]
            a, b = grams(x), grams(z)
            if z != x and len(z) >= 20 and len(a & b) >= 0.8 * len(a | b):
                y = z
        return y

    kinds = [(c, n) for c in ((20, 30), (40, 60), (80, 120), (200, 400)) for n in (4, 9, 24)]
    rows, kind_of = [], {}
    for k in kinds:
        found = 0
        while found < 150:
            x = line(*k)
            if (y := changed(x)) != x:
                kind_of[len(rows) + 1] = k
                rows += [x, y]
                found += 1
    gone = [r["id"] for r in line_dedup.dropped_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()]
    share = {k: sum(kind_of.get(i) == k for i in gone) / 150 for k in kinds}
    assert set(gone) <= set(kind_of) and min(share.values()) >= 0.95, share


def test_html_hostile_pages_take_linear_time():
    import time

    began = time.process_time()
    assert html_extract.main_text('<a "' * 250_000) == ""
    assert html_extract.main_text("<a href='" * 250_000) == ""
    html_extract.main_text("<div>" * 100_000 + "</section>" * 100_000)
    assert html_extract.main_text("<main><p>Text.</p></main><!-- " + "<a '" * 100_000) == "Text."
    assert time.process_time() - began < 20


def test_quality_fences_follow_each_source(spark):
    """The same rates pass in a source where they are usual and fail in one where they are not, on either side."""
    rnd = random.Random(2)
    plain = lambda n, length: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(length + rnd.choice((-1, 0, 1)))) for _ in range(n))
    rows = [(i, plain(200, 4), "en", "narrow") for i in range(100)] + [(100 + i, plain(200, 3 + i % 6), "en", "wide") for i in range(100)]
    rows += [(1000, plain(200, 8), "en", "narrow"), (1001, plain(200, 8), "en", "wide"), (1002, plain(200, 2), "en", "narrow")]
    rows += [(1003, plain(150, 4) + " #" * 50, "en", "narrow"), (1004, plain(40, 4) + " # #", "en", "narrow")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df).collect()}
    assert [kept[i] for i in range(1000, 1005)] == [False, True, False, False, True]
    assert sum(kept[i] for i in range(200)) >= 198


def test_columns_with_dots_and_clashing_names_are_kept(spark):
    schema = "doc_id long, text string, lang string, source string, `a.b` string, line string, h long, root long, keys string"
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "en", "s", "x", "y", 3, 4, "z"), (2, "other " + text[::-1], "en", "s", None, None, None, None, None)], schema)
    for f in (quality_rules.quality_filter, language_id.language_filter, line_dedup.dedup_documents, ngram_join.one_of_each):
        got = f(df)
        assert got.columns == df.columns
        assert [r["a.b"] for r in got.where("doc_id = 1").collect()] == ["x"]


def test_a_pair_of_crowded_bands_meets_once(spark):
    from lodequery.llm import line_dedup

    bands = {1: [1, 2, 3, 4], 2: [1, 2, 3], 3: [2, 3, 4, 5]}
    sketch = [10, 3, *[0] * line_dedup.SKETCH]
    rows = [(key, h, h, *sketch) for key, own in bands.items() for h in own]
    kind = "key long, h long, root long, n long, blocks int, " + ", ".join(f"p{i} long" for i in range(line_dedup.SKETCH))
    got = line_dedup._all_pairs(spark.createDataFrame(rows, kind)).select("x.h", "y.h").collect()
    pairs = sorted((min(r), max(r)) for r in got)
    assert pairs == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)]


def test_quality_filter_writes_no_text(spark, docs, monkeypatch):
    from lodequery.llm import quality_rules

    written = []
    real = quality_rules.materialise
    monkeypatch.setattr(quality_rules, "materialise", lambda df, name: (written.append(df.columns), real(df, name))[1])
    df = docs.select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("source"))
    df = df.unionByName(df.where("doc_id % 7 = 0"))
    kept = sorted(r["doc_id"] for r in quality_rules.quality_rules(df).where("kept").collect())
    for rows in (quality_rules.BROADCAST_ROWS, 0):
        monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", rows)
        written.clear()
        assert sorted(r["doc_id"] for r in quality_rules.quality_filter(df).collect()) == kept
        assert written and not any("text" in columns for columns in written)


def test_line_signatures_cost_no_conversion_and_hashes_no_dictionary(spark):
    import glob

    import pyarrow.parquet as pq

    lines = spark.createDataFrame([(1, "a line of some twenty characters or more"), (1, "a line of some twenty characters or more"), (2, "漢字かな交じり文" * 3)], "h long, line string")
    found = line_dedup.signatures(lines)
    assert "encode(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["h"]: (r["n"], len(r["s"])) for r in found.collect()} == {1: (2, 6), 2: (1, 6)}
    written = line_dedup.materialise(lines.select("h"), "test").inputFiles()
    for path in (p for f in written for p in glob.glob(f.removeprefix("file://"))):
        kinds = pq.ParquetFile(path).metadata
        assert not any("DICTIONARY" in e for g in range(kinds.num_row_groups) for e in kinds.row_group(g).column(0).encodings)


def test_line_bands_are_of_common_values_and_one_of_equal_ones(spark):
    from lodequery.llm import line_dedup

    signatures = {1: [10, 20, 30], 2: [10, 20, 40], 3: [50, 60, 70], 4: [10, 80, 90], 5: [99], 6: [99]}
    signatures |= {h: [1, 2, 3] for h in (11, 12, 13, 14)} | {h: [5, 6, 7] for h in (21, 22)} | {h: [100 + h, 8, 9][::-1] for h in (31, 32, 33)}
    signatures |= {h: [15, 16] for h in range(41, 46)} | {h: [16, 17] for h in range(46, 50)}
    found = spark.createDataFrame([(h, 1, sorted(s)) for h, s in signatures.items()], "h long, n long, s array<long>")
    bands = line_dedup._bands(found)
    of = {}
    for r in bands.collect():
        of.setdefault(r["key"], []).append(r["h"])
    four, five = list(range(46, 50)), list(range(41, 46))
    assert sorted(map(sorted, of.values())) == sorted([[1, 2], [5, 6], *[[11, 12, 13, 14]] * 3, *[[21, 22]] * 3, [31, 32, 33], four, five])
    small, crowded = line_dedup._meeting(bands, "bands", one_of_equal=True)
    assert sorted((r["a"], r["b"], r["c"]) for r in small.collect() if r["c"] is None) == [(1, 2, None), (5, 6, None), (21, 22, None)]
    assert [(r["a"], r["b"], r["c"]) for r in small.collect() if r["c"] is not None] == [(31, 33, 32)]
    groups = {}
    for r in crowded.collect():
        groups.setdefault(r["key"], []).append(r["h"])
    assert sorted(map(sorted, groups.values())) == [[11, 12, 13, 14], five, four]


def test_lines_just_at_the_threshold_are_links(spark):
    """Of two lines with 4 of 5 shingles in common, and multiples of it, whatever the rounding of 0.8."""
    from lodequery.llm import line_dedup

    alphabet = [chr(0x4E00 + i) for i in range(2000)]
    pairs = []
    for k in range(1, 40):  # the longer line has 5 k shingles, the shorter one the first 4 k of them
        long = "".join(alphabet[: 5 * k + 4])
        pairs += [(long[: 4 * k + 4], long, 9 * k), (long[: 4 * k + 3], long, 9 * k - 1)]
    df = spark.createDataFrame(pairs, "x string, y string, shingles long")
    got = df.select(line_dedup._similar(F.col("x"), F.col("y"), F.col("shingles")).alias("link")).collect()
    assert [r["link"] for r in got] == [True, False] * 39
