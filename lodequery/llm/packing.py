"""Packing of documents into token sequences by non-negative least squares.

A document is its token ids and an end id. Its full windows are sequences of
their own; what remains of each document is shorter than a window. A histogram
of these lengths, one entry a length whatever the number of documents, goes to
the driver, which enumerates pairs and triples of lengths that fill a window,
solves for non-negative repeat counts by least squares against the histogram,
rounds them down and fills up greedily. Lengths left over are laid end to end and
cut at window borders; the last, partial window is cut into powers of two, which
need no padding. So nothing is padded.

A document's place follows from its rank among those of its length. Ranks are
counted per task while tokenising, and tasks' counts are summed before them, so
no key gathers many rows, and a text is tokenised once.

Null and empty texts are the end id alone; a null id stays null; repeated rows
are packed each; very long texts are cut into many windows; an empty table gives
an empty result; other columns are left out.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

WINDOW = 2048
END_ID = 1
TRIPLE_LENGTHS = 64  # triples are enumerated over so many of the commonest lengths
SWEEPS = 60
BROADCAST_ROWS = 1_000_000  # rows of 24 bytes; with more, Spark picks the join

# Fixed value: the pattern by which byte-level BPE cuts texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(2)
def encoder(path: str):
    """A function from text to ids of the byte-level BPE in a tokenizers file.

    The file's vocabulary is run by tiktoken, which gives the ids that tokenizers gives, several
    times faster; a sample is compared when it is loaded.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    fast = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    for sample in ("It's  a\n\n test, äöü 漢字 1234!? <|endoftext|>\t", "x" * 50):
        if fast.encode_ordinary(sample) != slow.encode(sample, add_special_tokens=False).ids:
            raise ValueError(f"{path}: not a byte-level BPE that can be run by ranks")
    return lambda text: fast.encode_to_numpy(text, disallowed_special=())


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each document: ids of its remainder, checksums, and its counts within the task."""
    schema = "doc_id string, doc_tokens long, task long, first_window long, window_crcs array<long>, rest int, rank long, rest_crc long, rest_ids binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        ranks, windows = np.zeros(window, np.int64), 0
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["_id"], pdf["_text"], strict=True):
                ids = np.append(encode(text) if text else np.empty(0, np.uint32), np.uint32(end_id)).astype("<u4")
                full, rest = divmod(len(ids), window)
                crcs = [_crc(ids[i * window : (i + 1) * window]) for i in range(full)]
                tail = ids[full * window :]
                raw = tail.astype("<u2").tobytes() if not rest or int(tail.max()) < 1 << 16 else tail.tobytes()
                rows.append((doc_id, len(ids), task, windows, crcs, rest, ranks[rest], _crc(tail), raw))
                ranks[rest] += 1
                windows += full
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return docs.select(docs[id_col].cast("string").alias("_id"), docs[text_col].alias("_text")).mapInPandas(run, schema)


def combinations(hist: np.ndarray, window: int = WINDOW, common: int = TRIPLE_LENGTHS) -> list[tuple[int, ...]]:
    """Pairs and triples of lengths that occur and fill a window; ``hist[n]`` counts the length n."""
    there = hist > 0
    out = [(a, window - a) for a in range(1, window // 2 + 1) if there[a] and there[window - a]]
    top = sorted(np.argsort(-hist, kind="stable")[:common].tolist())
    triples = {tuple(sorted((a, b, window - a - b))) for a in top for b in top if a <= b and 0 < window - a - b}
    return out + sorted(t for t in triples if all(there[x] for x in t))


def solve(hist: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative repeat counts that fit the histogram best, by coordinate descent on the squared residuals."""
    x, left = np.zeros(len(combos)), hist.astype(np.float64).copy()
    columns = [np.unique(c, return_counts=True) for c in combos]
    norms = [float((m * m).sum()) for _, m in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, (rows, m) in enumerate(columns):
            new = max(0.0, x[j] + float((left[rows] * m).sum()) / norms[j])
            if (step := new - x[j]) != 0.0:
                left[rows] -= step * m
                x[j] = new
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


class Plan:
    """Where the remainder with a given length and rank goes; its size depends on the window alone."""

    def __init__(self, hist: np.ndarray, window: int = WINDOW):
        self.window = window
        combos = combinations(hist, window)
        counts = np.floor(solve(hist, combos)).astype(np.int64)
        left, used = hist.astype(np.int64).copy(), np.zeros(window, np.int64)
        slots: dict[int, list[tuple[int, int, int]]] = {}
        sequence = 0
        rounded = sorted(range(len(combos)), key=lambda j: -counts[j])
        for j, wanted in [(j, int(counts[j])) for j in rounded] + [(j, None) for j in rounded]:
            rows, m = np.unique(combos[j], return_counts=True)
            n = int((left[rows] // m).min())
            n = n if wanted is None else min(n, wanted)
            if n <= 0:
                continue
            offset = 0
            for length in combos[j]:
                slots.setdefault(length, []).append((int(used[length]), sequence, offset))
                used[length] += n
                left[length] -= n
                offset += length
            sequence += n
        self.slots = {k: tuple(np.array(v, np.int64).T) for k, v in slots.items()}
        self.used, self.stream_sequence = used, sequence
        lengths = left * np.arange(window)
        self.base = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        total = int(lengths.sum())
        self.whole = total // window
        cuts, at = [self.whole * window], self.whole * window
        for power in reversed(range(window.bit_length())):
            if (total - self.whole * window) >> power & 1:
                at += 1 << power
                cuts.append(at)
        self.tail_cuts = cuts

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces as (first id, length, sequence, offset)."""
        if rank < self.used[length]:
            starts, sequences, offsets = self.slots[length]
            i = int(np.searchsorted(starts, rank, side="right")) - 1
            return [(0, length, int(sequences[i] + rank - starts[i]), int(offsets[i]))]
        at = int(self.base[length] + (rank - self.used[length]) * length)
        end, first, out = at + length, at, []
        while at < end:
            if at < self.tail_cuts[0]:
                number, begin = at // self.window, at // self.window * self.window
                stop = begin + self.window
            else:
                i = int(np.searchsorted(self.tail_cuts, at, side="right")) - 1
                number, begin, stop = self.whole + i, self.tail_cuts[i], self.tail_cuts[i + 1]
            n = min(end, stop) - at
            out.append((at - first, n, self.stream_sequence + number, at - begin))
            at += n
        return out


def packing(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: document, first id, length, checksum, and place in a sequence.

    ``sequence_id`` is unique and not dense: full windows of a document are numbered by task.
    """
    spark = docs.sparkSession
    rows = materialise(tokenised(docs, path, id_col, text_col, window, end_id), "tokens")
    counts = rows.where("rest > 0").groupBy("task", "rest").agg((F.max("rank") + 1).alias("n"))
    counts = materialise(counts, "lengths")
    hist = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        hist[r["rest"]] = r["n"]
    plan = spark.sparkContext.broadcast(Plan(hist, window))
    before = W.partitionBy("rest").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("task", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = plan.value
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                full = len(r.window_crcs)
                base = (int(r.task) + 1 << 40) + int(r.first_window)
                out += [(r.doc_id, i * window, window, int(c), r.doc_tokens, base + i, 0) for i, c in enumerate(r.window_crcs)]
                if r.rest:
                    pieces = own.place(int(r.rest), int(r.rank + r.before))
                    ids = None if len(pieces) == 1 else np.frombuffer(r.rest_ids, "<u2" if len(r.rest_ids) == 2 * r.rest else "<u4")
                    for first, n, sequence, offset in pieces:
                        crc = r.rest_crc if ids is None else _crc(ids[first : first + n])
                        out.append((r.doc_id, full * window + first, n, int(crc), r.doc_tokens, sequence, offset))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    found = rows.join(offsets, ["task", "rest"], "left").fillna(0, ["before"])
    pieces = found.mapInPandas(assign, PIECES)
    return pieces.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
