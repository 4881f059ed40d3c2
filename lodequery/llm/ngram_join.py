"""N-gram Jaccard self-join: a size-aware heavy-light join of shingle sets.

A text's set is its distinct word shingles as 64-bit hashes. Texts with equal
sets are one class from the start, so copies cost nothing. Classes link when the
Jaccard index of their sets reaches the threshold; the result is each document's
component under these links.

1. A set that has a partner shares with it at least k elements of a prefix that
   is k - 1 elements longer than the part a partner may lack, in any order. With
   hash order and a k in proportion to the set, sets without enough shared prefix
   elements are ruled out.
2. The others' elements are counted. In order of rarity, each set's prefix is
   the elements of which a partner must have one (scanned as inverted lists: heavy
   sets) or two (enumerated as subsets of two: light sets). A boundary on the size,
   chosen by the cost of both from the sizes' distribution, says which sets are
   heavy; sets about the boundary take part in both.
3. Sets that meet in a list or subset are gathered by connected components, in
   blocks of bounded volume, and linked by exact verification; pairs that are
   connected already are not compared again, so a large group of near copies costs
   a few comparisons a set and yields one row a set.

No candidate, list or partner is capped. Null and empty texts and texts without
a word have an empty set, link with nothing and are their own component; a
null id is never a component's id unless it has no other; repeated rows share a
class; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, materialise, named, table
from .graph import components

SHINGLE = 4
PERCENT = 85
LIGHT_KEYS = 9  # prefix elements of a light set, at most: 36 subsets
EXTRA_PERCENT = 7  # prefix elements beyond the necessary, of a set's size
BLOCK_VALUES = 4_000_000  # set elements that one verification task may hold of a block
BROADCAST_ROWS = 1_000_000  # of two numbers each; with more, Spark picks the join
SLICE_BYTES = 1 << 21

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_RANDOM = np.random.RandomState(20240229).randint(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; words are cut at ASCII white space, A-Z in lower case."""
    raw = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    lengths = np.array([len(r) + 1 for r in raw], np.int64)
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [np.empty(0, np.int64)] * len(texts)
    n = ends - starts
    powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(n.max()) - 1, _MULTIPLIER))))
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    at = np.arange(int(n.sum())) - np.repeat(first, n)
    hashes = _mix(np.add.reduceat(_RANDOM[data[word]] * powers[at], first) + n.astype(np.uint64))
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    salts = [_mix(np.array([i + 1], np.uint64) * _MULTIPLIER)[0] | np.uint64(1) for i in range(size)]
    m = len(hashes) - size + 1
    grams = _mix(sum((hashes[i : i + m] * salts[i] for i in range(1, size)), hashes[:m] * salts[0])) if m > 0 else np.empty(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            own = grams[a : b - size + 1]
        elif b > a:
            own = _mix(sum((hashes[a + i : a + i + 1] * salts[i] for i in range(b - a)), np.array([b - a], np.uint64)))
        else:
            own = np.empty(0, np.uint64)
        out.append(np.unique(own.view(np.int64)))
    return out


def _set_id(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _slices(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    held = np.cumsum(pdf["_text"].str.len().fillna(0).to_numpy() + 1) // SLICE_BYTES
    yield from (part for _, part in pdf.groupby(held, sort=False))


def _need(n, percent: int):
    """Elements that a set of size ``n`` has in common with any partner, at least."""
    return (percent * n + 99) // 100


def _keys(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Id, set id, set size and the prefix in hash order of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _slices(batch):
                sets = shingle_sets(list(pdf["_text"]), size)
                n = np.array([len(s) for s in sets], np.int64)
                prefix = np.where(n > 0, n - _need(n, percent) + np.maximum(1, n * EXTRA_PERCENT // 100), 0)
                yield pd.DataFrame(
                    {"doc_id": pdf["_id"].to_numpy(), "sid": [_set_id(s) for s in sets], "n": n, "prefix": [s[:p] for s, p in zip(sets, prefix, strict=True)]}
                )

    rows = docs.select(named(id_col).cast("string").alias("_id"), named(text_col).alias("_text"))
    return rows.mapInPandas(run, "doc_id string, sid long, n long, prefix array<long>").withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """The sets of the classes in ``wanted`` (rep, sid), from the texts of their representatives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _slices(batch):
                for sid, values in zip(pdf["sid"], shingle_sets(list(pdf["_text"]), size), strict=True):
                    if _set_id(values) == sid:
                        yield pd.DataFrame({"sid": [sid], "n": [len(values)], "elements": [values]})

    rows = docs.select(named(id_col).alias("rep"), named(text_col).alias("_text")).join(wanted, "rep").select("sid", "_text")
    return rows.mapInPandas(run, "sid long, n long, elements array<long>")


def _largest_light(percent: int) -> int:
    """The size below which a set's prefix has ``LIGHT_KEYS`` elements at most, so that its subsets are a few times these."""
    n = 1
    while n - _need(n, percent) + 2 <= LIGHT_KEYS:
        n += 1
    return n


def _boundary(sized: DataFrame, percent: int) -> int:
    """The size from which sets are heavy: where subsets of two and scanned lists cost least together.

    A light set costs a row a subset, a heavy one a row a list and a visit of each other set in it. Costs are summed
    over sizes below the largest that may be light, so a few dozen rows reach the driver.
    """
    limit = _largest_light(percent)
    rows = (
        sized.where(F.col("n") < limit)
        .groupBy("n")
        .agg(F.sum(F.col("keys2") * (F.col("keys2") - 1) / 2).alias("subsets"), F.sum("scanned").alias("scanned"))
        .collect()
    )
    subsets, scanned = ({r["n"]: r[k] for r in rows} for k in ("subsets", "scanned"))

    def cost(edge: int) -> float:
        # Sets just below the boundary are scanned too.
        return sum(v for n, v in subsets.items() if n < edge) + sum(v for n, v in scanned.items() if n >= _need(edge, percent))

    return min(range(limit + 1), key=cost)


def _link(pdf: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Edges that connect the linked sets of one block or pair of blocks, one fewer than each component has sets."""
    pdf = pdf.drop_duplicates("sid").sort_values(["n", "sid"], kind="stable")
    sids, sizes, sets = pdf["sid"].tolist(), pdf["n"].tolist(), [np.asarray(x) for x in pdf["elements"]]
    root = list(range(len(sids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    lists: dict[int, dict[int, list[int]]] = {}
    for x, prefix in enumerate(pdf["prefix"]):
        least, mine, tested = _need(sizes[x], percent), x, set()
        for element in prefix:
            for group, members in lists.get(element, {}).items():
                if find(group) == mine:
                    continue
                for y in members:
                    if y in tested or sizes[y] < least:
                        continue
                    tested.add(y)
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                        root[mine] = find(group)
                        mine = find(group)
                        break
        for element in prefix:
            lists.setdefault(element, {}).setdefault(mine, []).append(x)
    return [(sids[i], sids[find(i)]) for i in range(len(sids)) if find(i) != i]


def _linked(blocks: DataFrame, percent: int) -> DataFrame:
    """Edges found in each group of ``blocks`` (gathered, i, j, sid, n, elements, prefix)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_link(pdf, percent), columns=["a", "b"], dtype="int64")

    return blocks.groupBy("gathered", "i", "j").applyInPandas(run, "a long, b long")


def _of_many(rows: DataFrame, key: str) -> DataFrame:
    """The rows (sid, key) of keys that several sets have, with ``first``, the key's smallest set, and ``df``, its sets.

    Keys are counted by partial sums and joined back, so that a very common one is split like any skewed join.
    """
    counted = rows.groupBy(key).agg(F.min("sid").alias("first"), F.count("*").alias("df")).where("df > 1")
    return rows.join(counted, key)


def class_links(sets: DataFrame, percent: int, boundary: int | None = None) -> DataFrame:
    """``id`` and ``root`` of the sets that are linked with another; ``boundary`` replaces the chosen one."""
    sets = materialise(sets, "sets")
    counted = _of_many(sets.select("sid", "n", F.explode("elements").alias("element")), "element")
    by_set = counted.groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("shared"))
    need = F.floor((percent * F.col("n") + 99) / 100)
    keys2 = (F.size("shared") - need + 2).cast("int")
    ranked = by_set.where(F.size("shared") >= need).select("sid", "n", F.slice("shared", F.lit(1), keys2).alias("keys"), keys2.alias("keys2"))
    scanned = F.aggregate(F.slice("keys", F.lit(1), F.greatest(F.col("keys2") - 1, F.lit(1))), F.lit(0).cast("long"), lambda a, x: a + x["df"])
    ranked = materialise(ranked.select("sid", "n", "keys2", scanned.alias("scanned"), F.col("keys.element").alias("keys")), "prefixes")
    edge = _boundary(ranked, percent) if boundary is None else boundary
    light = ranked.where(F.col("n") < edge).select("sid", F.explode(_subsets("keys")).alias("key"))
    heavy = ranked.where(F.col("n") >= _need(edge, percent)).select(
        "sid", F.explode(F.expr("slice(keys, 1, greatest(keys2 - 1, 1))")).alias("element")
    ).select("sid", F.xxhash64("element").alias("key"))
    met = _of_many(light.unionByName(heavy), "key").where("sid <> first")
    gathered = components(met.select(F.col("sid").alias("a"), F.col("first").alias("b")))
    gathered = gathered.unionByName(gathered.select(F.col("root").alias("id"), "root").distinct())
    members = sets.join(gathered.withColumnRenamed("id", "sid").withColumnRenamed("root", "gathered"), "sid")
    members = members.join(ranked.select("sid", F.expr("slice(keys, 1, greatest(keys2 - 1, 1))").alias("prefix")), "sid")
    volume = members.groupBy("gathered").agg(F.ceil(F.sum("n") / BLOCK_VALUES).cast("int").alias("blocks"))
    volume = materialise(volume, "volumes")
    own = members.join(volume, "gathered").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    large = volume.where("blocks > 1").limit(1).count() > 0
    if not large:
        found = _linked(own.withColumns({"i": F.lit(0), "j": F.lit(0)}), percent)
        return components(found)
    own = materialise(own, "members")
    # First each block by itself and against the first block, then the pairs of blocks that are not of one component yet.
    near = own.withColumn("j", F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.col("block")))))
    found = materialise(_linked(near.withColumn("i", F.lit(0)), percent), "links")
    known = components(found).withColumnRenamed("id", "sid")
    labelled = own.select("sid", "gathered", "block", "blocks").join(known, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    span = labelled.groupBy("gathered", "block", "blocks").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    x, y = span.alias("x"), span.alias("y")
    open_pairs = x.join(y, (F.col("x.gathered") == F.col("y.gathered")) & (F.col("x.block") < F.col("y.block")) & (F.col("x.block") > 0)).where(
        "x.low <> y.low or x.high <> y.high or x.low <> x.high"
    ).select(F.col("x.gathered").alias("gathered"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = open_pairs.select("gathered", "i", "j", F.explode(F.array("i", "j")).alias("block"))
    more = _linked(own.join(sides, ["gathered", "block"]), percent)
    return components(found.unionByName(more))


def _subsets(keys: str):
    """Hashes of the subsets of two of an array of longs."""
    return F.expr(
        f"flatten(transform({keys}, (x, i) -> transform(slice({keys}, i + 2, size({keys})), y -> xxhash64(least(x, y), greatest(x, y)))))"
    )


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    ``percent`` is from 67 to 100: below, linked sets may share a single element, of which there is no subset of two.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must be from 67 to 100")
    keys = materialise(_keys(docs, id_col, text_col, size, percent), "keys")
    classes = materialise(keys.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # 1. A prefix element counts where two classes have it. Copies count alike, so the count of a class is its copies times its elements.
    # A set links with another only if it is large enough to differ by one element.
    pairs = keys.where(100 * F.col("n") >= percent * (F.col("n") + 1)).select("sid", F.explode("prefix").alias("element"))
    common = pairs.groupBy("element").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("element")
    shared = pairs.join(common, "element").groupBy("sid").agg(F.count("*").alias("shared"))
    least = F.greatest(F.lit(1), F.floor(percent * F.floor(F.col("n") * EXTRA_PERCENT / 100) / 100))
    wanted = materialise(shared.join(classes, "sid").where(F.col("shared") >= F.col("copies") * least).select("rep", "sid"), "candidates")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    linked = class_links(_sets(docs, wanted, id_col, text_col, size), percent)
    reps = classes.select("sid", "rep").join(linked.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    reps = materialise(reps, "roots")
    least_id = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = reps.join(least_id, "root").select("sid", "component_id")
    out = keys.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(labels, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kinds) -> DataFrame:
    """The first row of each component of ``docs``, by id; rows are told apart by id and text.

    Rows without an id come last in a component; those without a word too link with nothing and stay.
    """
    key = "_lodequery_key"
    keyed = docs.withColumn(key, F.xxhash64(named(id_col), named(text_col)))
    labels = ngram_join(keyed, key, text_col, **kinds).select(F.col("doc_id").alias(key), "n_shingles", "component_id").distinct()
    rows = keyed.groupBy(key).agg(F.min(named(id_col)).alias("id"), F.count("*").alias("count"))
    labels = materialise(rows.join(labels, key), "labels")
    first = labels.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", key)).alias("first"), F.count("*").alias("members"))
    gone = labels.join(first.where("members > 1"), "component_id").where(F.col(key) != F.col(f"first.{key}")).select(key)
    again = labels.where("count > 1 and (n_shingles > 0 or id is not null)").select(key)
    gone, again = (F.broadcast(x) if x.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else x for x in (gone, again))
    left = keyed.join(gone, key, "left_anti")
    twice = left.join(again, key, "left_semi").withColumn("_lodequery_first", F.row_number().over(W.partitionBy(key).orderBy(named(text_col))))
    return left.join(again, key, "left_anti").select(*columns(docs)).unionByName(twice.where("_lodequery_first = 1").select(*columns(docs)))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


QUERIES = {"op7_ngram_join": op7_ngram_join}
ORACLES: dict[str, str] = {}
