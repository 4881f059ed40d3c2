"""Fuzzy line deduplication by MinHash over character shingles.

Lines (cut at ``\\n``) of at least ``LEAST_CHARS`` characters take part. Equal lines
are merged first, so that all that follows costs a row a distinct line. A line's
signature is the ``SIGNATURE`` smallest hashes of its twelve-byte shingles, one
from each start, among the smallest in each of ``BINS`` bins; each pair of
signature values is a band, and so is the only value of a line of one; bands are made of
the values that other lines have too, and one of those with the same lines is looked at. Lines whose
five-character shingles have a Jaccard index of 0.8 or more share two of six values
with a probability of 0.97 where changes lie scattered, of 0.99 where they lie
together. In a band, lines are paired with the one before in hash order and with
the first one, and a pair is a link where the Jaccard index of its five-character
shingles is at least 0.8. In bands of more than three lines, all pairs that links
have not connected then meet: a few lines of a band with all others first, which
connects groups of near copies, then the rest block by block. Bit sketches of the shingle sets tell
pairs apart before their texts are read; they give a lower bound on the shingles that
only one line has, which never parts a link. Of each connected component of equal or
linked lines, the first line stays, by document id and place; the others are removed.

All of it is DataFrame functions, and no join but that with a bounded number of band keys is forced to be a broadcast. Arrays, none
of which is empty, are exploded in the outer form, before which the optimizer puts no
filter that would compute each of them once more. Rows with
equal id and text are one document; null and empty texts stay as they are; short and
blank lines always stay; very long lines are compared whole; of equal lines the first
by id, text hash and place stays, null ids before others; an empty table gives an
empty result; :func:`line_dedup` leaves other columns out, :func:`dedup_documents`
keeps them, whatever their names. Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, materialise_hashes as materialise, named, table
from .graph import components

LEAST_CHARS = 20
SIGNATURE_BYTES = 12
SIGNATURE = 6
SAMPLED = 16  # hashes of a line that are expected below the bound up to which they are looked at
BINS = 16
SHINGLE_CHARS = 5
SIMILARITY = 0.8
BLOCK_LINES = 512  # of a band, of which all pairs are made in one task
BROADCAST_KEYS = 4_000_000  # of a number each; with more crowded bands, Spark picks the join
PIVOTS = (8,)  # lines of a crowded band that meet all others, in turn
SKETCH = 16  # longs, a power of two
_LARGEST = (1 << 63) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where it is needed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingled(lines: DataFrame) -> DataFrame:
    """A row for each start of a signature shingle of each line (h, line): ``h``, ``m`` starts, ``i`` from 1 and ``x``, the hash.

    Shingles are of the bytes of a line as they are stored, which costs no conversion: twelve characters, or fewer where
    these take several bytes, so that similar lines share more of them. Nothing is computed with ``i``, as checked
    arithmetic is dearer than the hash.
    """
    rows = lines.select("h", F.col("line").cast("binary").alias("bytes")).withColumn("m", F.octet_length("bytes") - (SIGNATURE_BYTES - 1))
    rows = rows.select("h", F.expr(f"if(m <= {SAMPLED}, {_LARGEST}, {_LARGEST} div m * {SAMPLED})").alias("low"), "bytes", F.explode_outer(F.sequence(F.lit(1), "m")).alias("i"))
    return rows.select("h", "low", "i", F.xxhash64(F.substring("bytes", F.col("i"), F.lit(SIGNATURE_BYTES))).alias("x"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = named(text_col)
    return docs.select(named(id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text")).where("text <> ''")


def _lines(rows: DataFrame) -> DataFrame:
    lines = rows.select("id", "row", F.posexplode_outer(F.split("text", "\n")).alias("place", "line"))
    long = (F.octet_length(F.trim("line")) >= 4 * LEAST_CHARS) | (F.length(F.trim("line")) >= LEAST_CHARS)  # bytes need no count
    return lines.where(long).withColumn("h", F.xxhash64("line"))


def signatures(lines: DataFrame) -> DataFrame:
    """``h``, ``n`` copies and the signature ``s`` of each distinct line of ``lines`` (h, line).

    Of a long line only hashes in the lowest part of the range are looked at, which holds its smallest ones, and those of
    the first starts, as a line that repeats a short unit has few different ones, which may all be higher.
    """
    rows = _shingled(lines).withColumn("y", F.shiftrightunsigned("x", 1))
    rows = rows.where((F.col("i") <= SIGNATURE_BYTES) | (F.col("y") <= F.col("low")))
    rows = rows.select("h", (F.col("i") == 1).alias("begins"), "y", F.expr(f"cast(y & {BINS - 1} as int)").alias("bin"))
    # What is never null takes a fraction of the code, and the bin is computed once a row.
    bins = [F.min(F.expr(f"if(bin = {k}, y, {_LARGEST})")).alias(f"b{k}") for k in range(BINS)]
    found = rows.groupBy("h").agg(F.count_if("begins").alias("n"), *bins)
    # Empty bins are sorted behind and removed without a lambda, which would keep the aggregation out of generated code.
    values = F.sort_array(F.array(*[f"b{k}" for k in range(BINS)]))
    return found.select("h", "n", F.array_remove(F.slice(values, 1, SIGNATURE), _LARGEST).alias("s"))


def _meeting(rows: DataFrame, name: str, one_of_equal: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (key, h) the keys that several lines have, as small groups of lines and as crowded ones.

    Groups of two or three lines are rows ``a``, ``b`` and ``c``, their smallest, largest and other line, if any, beside
    ``key``; groups of more are rows (key, h). Most keys are of one line: they take no more than a place in a hash aggregation.
    With ``one_of_equal``, one of the keys that the same lines have stands for them.
    """
    ends = rows.repartition("key").groupBy("key").agg(
        F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("b"), F.bit_xor("h").alias("x"),
    )
    groups = ends.where("n > 1")
    if one_of_equal:
        groups = groups.groupBy("n", "a", "b", "x").agg(F.min("key").alias("key"))
    third = F.when(F.col("n") == 3, F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b")))
    ends = [F.when(F.col("n") <= 3, F.col(c)).alias(c) for c in "ab"]  # of crowded ones, only the key is written
    groups = materialise(groups.select("key", *ends, third.alias("c")), name)
    small, keys = groups.where("a IS NOT NULL"), groups.where("a IS NULL").select("key")
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return small, rows.join(keys, "key").select("key", "h")


def _bands(found: DataFrame) -> DataFrame:
    """The bands (key, h) in which lines can meet: of each line the pairs of values that other lines have too, or its only value.

    Most values are of one line, which is found out at the price of six rows a line, where all pairs would be fifteen.
    """
    small, crowded = _meeting(found.select(F.explode_outer("s").alias("key"), "h"), "values")
    common = small.select("key", F.explode_outer(F.array("a", "b", "c")).alias("h")).where("h IS NOT NULL").unionByName(crowded)
    x, y = common.alias("x"), common.alias("y")
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.key") < F.col("y.key")))
    pairs = pairs.select(F.xxhash64("x.key", "y.key").alias("key"), "x.h")
    return pairs.unionByName(found.where(F.size("s") == 1).select(F.get("s", F.lit(0)).alias("key"), "h"))


def _pairs(small: DataFrame, crowded: DataFrame) -> DataFrame:
    """Candidate pairs ``a < b`` of line hashes: all of small bands, each line with the first and the one before of crowded ones."""
    three = small.where("c IS NOT NULL")
    w = W.partitionBy("key").orderBy("h")
    others = F.array(F.first("h").over(w), F.lag("h").over(w))
    rows = crowded.select("h", others.alias("others")).select("h", F.explode("others").alias("o")).where("o < h")
    parts = [
        small.select("a", "b"),
        three.select("a", F.col("c").alias("b")),
        three.select(F.col("c").alias("a"), "b"),
        rows.select(F.col("o").alias("a"), F.col("h").alias("b")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def _points(line: Column) -> Column:
    """The code points of a line, four bytes each, so that a shingle is cut at once wherever it begins."""
    return F.encode(line, "UTF-32")


def _hashed(line: Column) -> Column:
    """The shingles of a line, hashed, at each place."""
    width = 4 * SHINGLE_CHARS
    starts = lambda p: F.sequence(F.lit(1), F.length(p) - (width - 1), F.lit(4))
    return _let(_points(line), lambda p: F.transform(starts(p), lambda i: F.xxhash64(F.substring(p, i, F.lit(width)))))


def _similar(x: Column, y: Column, shingles: Column) -> Column:
    """Whether the Jaccard index of two lines' character shingles reaches the threshold; ``shingles`` is the sum of their counts.

    Sets are made once, by the intersection, which is compiled outside of lambdas.
    """
    return F.size(F.array_intersect(_hashed(x), _hashed(y))) * (1 + SIMILARITY) >= SIMILARITY * shingles - 1e-6


def _sketches(texts: DataFrame) -> DataFrame:
    """Of each line (h, line) the count ``n`` of its shingles and, in ``SKETCH`` longs, the parity of those that fall on each bit."""
    parts = [F.expr(f"bit_xor(if(part = {i}, bit, 0L))").alias(f"p{i}") for i in range(SKETCH)]
    # Without lambdas around them, the removal of copies and the explode are compiled.
    hashed = texts.select("h", F.array_distinct(_hashed(F.col("line"))).alias("xs")).select("h", F.explode_outer("xs").alias("x"))
    bits = hashed.select("h", F.expr(f"cast(x & {SKETCH - 1} as int)").alias("part"), F.expr("shiftleft(1L, cast(shiftright(x, 8) & 63 as int))").alias("bit"))
    return bits.groupBy("h").agg(F.count("*").alias("n"), *parts)


def _may_be_similar(x: str, y: str) -> Column:
    """Whether the sketches ``x`` and ``y`` are of lines that can reach the threshold.

    Each bit that differs is a shingle of one line only, and links have a limited number of these. Counts are doubles, whose
    sums Spark does not check one by one.
    """
    m, n = F.col(f"{x}.n").cast("double"), F.col(f"{y}.n").cast("double")
    apart = sum((F.bit_count(F.col(f"{x}.p{i}").bitwiseXOR(F.col(f"{y}.p{i}"))).cast("double") for i in range(SKETCH)), F.lit(0.0))
    return (F.least(m, n) >= SIMILARITY * F.greatest(m, n)) & (apart * (1 + SIMILARITY) <= (1 - SIMILARITY) * (m + n) + 1e-6)


def _sketched(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches don't tell them apart."""
    x, y = sketches.alias("x"), sketches.alias("y")
    return pairs.join(x, F.col("a") == F.col("x.h")).join(y, F.col("b") == F.col("y.h")).where(_may_be_similar("x", "y")).select("a", "b", _shingles("x", "y"))


def _shingles(x: str, y: str) -> Column:
    """How many shingles the sketches ``x`` and ``y`` are of, together."""
    return (F.col(f"{x}.n") + F.col(f"{y}.n")).alias("shingles")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, shingles) that are links."""
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    return both.where(_similar(F.col("x"), F.col("y"), F.col("shingles"))).select("a", "b")


def _open(crowded: DataFrame, linked: DataFrame, sketches: DataFrame) -> DataFrame:
    """The lines (key, h) of bands whose lines are not all of one component, with ``root``, their sketches and ``blocks`` of the band."""
    labelled = materialise(crowded.join(linked, "h", "left").withColumn("root", F.coalesce("root", "h")), "crowded")
    blocks = F.ceil(F.count("*") / BLOCK_LINES).cast("int").alias("blocks")
    opened = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), blocks).where("low <> high")
    return materialise(labelled.join(opened.select("key", "blocks"), "key").join(sketches, "h"), "open")


def _with_pivots(lines: DataFrame, n: int) -> DataFrame:
    """Pairs of each line of an open band with ``n`` of its lines that are of another component."""
    order = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("h", F.lit(n))))
    pivots = lines.withColumn("order", order).where(F.col("order") <= n)
    x, y = lines.alias("x"), pivots.alias("y")
    return x.join(y, [F.col("x.key") == F.col("y.key"), F.col("x.root") != F.col("y.root"), _may_be_similar("x", "y")])


def _all_pairs(lines: DataFrame) -> DataFrame:
    """Pairs of the lines of each open band that are of different components, in blocks of lines; each in the first band of both."""
    bands = lines.groupBy("h").agg(F.collect_set("key").alias("keys"))  # as many as a signature has pairs
    lines = lines.join(bands, "h").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    x = lines.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1))).alias("x")
    y = lines.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), "block"))).alias("y")
    met = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("key", "i", "j")]
    once = (F.col("x.i") < F.col("x.j")) | (F.col("x.h") < F.col("y.h"))
    first = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    return x.join(y, [*met, once, F.col("x.root") != F.col("y.root"), _may_be_similar("x", "y"), first])


def _closed(linked: DataFrame, crowded: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """``linked`` (h, root) after all pairs of crowded bands (key, h) are verified or known to be connected.

    A few lines of each open band meet all others first, which connects groups of near copies; only lines that these
    leave apart meet in pairs.
    """
    for pivots in (*PIVOTS, None):
        lines = _open(crowded, linked, sketches)
        if lines.isEmpty():
            break
        pairs = (_with_pivots(lines, pivots) if pivots else _all_pairs(lines)).select(
            F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b"), _shingles("x", "y"),
        )
        links = _verified(materialise(pairs.distinct(), "pairs"), texts)
        ends = [links.select(F.col(c).alias("h"), F.xxhash64("a", "b").alias("link")) for c in "ab"]
        met = ends[0].unionByName(ends[1]).join(linked, "h", "left").select("link", F.coalesce("root", "h").alias("root"))
        edges = met.groupBy("link").agg(F.min("root").alias("a"), F.max("root").alias("b"))
        above = _with_roots(components(edges))
        joined = above.select(F.col("h").alias("root"), F.col("root").alias("above"))
        new = above.join(linked, "h", "left_anti")
        linked = linked.join(joined, "root", "left").select("h", F.coalesce("above", "root").alias("root"))
        linked = materialise(linked.unionByName(new), "linked")
    return linked


def _with_roots(found: DataFrame) -> DataFrame:
    """``h`` and ``root`` of all nodes of components, the roots among them."""
    return found.unionByName(found.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("id", "h")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``row`` (a hash of the text) and ``places`` of the lines that are to be removed."""
    rows = _rows(docs, id_col, text_col)
    found = materialise(signatures(_lines(rows).select("h", "line")), "signatures")
    small, crowded = _meeting(materialise(_bands(found), "keys"), "bands", one_of_equal=True)
    crowded = materialise(crowded, "crowded")
    pairs = materialise(_pairs(small, crowded), "pairs")
    # Only lines that stand twice or meet another need further work.
    met = small.select(F.explode(F.array("a", "b", "c")).alias("h")).where("h IS NOT NULL").unionByName(crowded.select("h"))
    meeting = met.select("h", F.lit(True).alias("meets")).distinct()
    twice = found.where("n > 1").select("h", F.lit(False).alias("meets"))
    wanted = meeting.unionByName(twice).groupBy("h").agg(F.max("meets").alias("meets"))
    occurrences = _lines(rows).join(wanted, "h").withColumn("line", F.when(F.col("meets"), F.col("line")))
    occurrences = materialise(occurrences.select("h", "id", "row", "place", "line"), "occurrences", compression="zstd")
    texts = materialise(occurrences.where("line IS NOT NULL").select("h", "line").dropDuplicates(["h"]), "texts", compression="zstd")
    sketches = materialise(_sketches(texts), "sketches")
    links = materialise(_verified(materialise(_sketched(pairs, sketches), "alike"), texts), "links")
    linked = _closed(materialise(_with_roots(components(links)), "linked"), crowded, sketches, texts)
    place = F.struct("id", "row", "place")
    lines = occurrences.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    grouped = lines.join(linked, "h", "left").where("root IS NOT NULL OR n > 1").withColumn("root", F.coalesce("root", "h"))
    grouped = materialise(grouped.select("h", "root", "first"), "keepers")
    keepers = grouped.groupBy("root").agg(F.min("first").alias("keeper"))
    known = grouped.select("h", "root").join(keepers, "root").select("h", "keeper")
    gone = occurrences.select("h", "id", "row", "place").join(known, "h").where(~place.eqNullSafe(F.col("keeper")))
    return gone.select("id", "row", "place").groupBy("id", "row").agg(F.collect_set("place").alias("places"))


def _with_drops(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with its lines, those that stay and the places of the others."""
    drops = materialise(dropped_lines(docs, id_col, text_col), "drops")
    drops = drops.select(F.col("id").alias("_lodequery_id"), F.col("row").alias("_lodequery_row"), F.col("places").alias("_lodequery_places"))
    own = named(id_col).eqNullSafe(F.col("_lodequery_id")) & (F.xxhash64(named(text_col)) == F.col("_lodequery_row"))
    joined = docs.join(drops, own, "left").withColumn("_lodequery_lines", F.split(named(text_col), "\n"))
    gone = F.col("_lodequery_places")
    kept = F.when(gone.isNull(), F.col("_lodequery_lines")).otherwise(F.filter("_lodequery_lines", lambda _, i: ~F.array_contains(gone, i)))
    return joined.withColumn("_lodequery_kept", kept)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``n_lines``, ``n_dropped`` and the remaining ``text``."""
    joined = _with_drops(docs.select(named(id_col), named(text_col)), id_col, text_col)
    return joined.select(
        named(id_col).alias("doc_id"),
        F.coalesce(F.size("_lodequery_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_lodequery_places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_lodequery_places").isNull(), named(text_col)).otherwise(F.array_join("_lodequery_kept", "\n")).alias("text"),
    )


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` without the removed lines; the count of characters follows, and documents of which no word is left go."""
    joined = _with_drops(docs, id_col, text_col)
    joined = joined.where(F.col("_lodequery_places").isNull() | F.exists("_lodequery_kept", lambda x: F.trim(x) != "")).withColumn(text_col, F.array_join("_lodequery_kept", "\n"))
    if chars_col in docs.columns:
        counted = F.when(F.col("_lodequery_places").isNull(), named(chars_col)).otherwise(F.length(named(text_col)))
        joined = joined.withColumn(chars_col, counted.cast(docs.schema[chars_col].dataType))
    return joined.select(*columns(docs))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES: dict[str, str] = {}
