"""SentencePiece encoding and decoding in batches of equal-length words.

A text is cut into words (a run of spaces and what follows it) where no piece of
the vocabulary can reach across, and very long words once more between characters
that no piece has side by side. Distinct words of equal length advance together
as rows of a matrix: prefix hashes give the hash of any substring, which is looked
up by binary search among the sorted hashes of the pieces.

Unigram models are segmented by Viterbi: for each end, a vectorised maximum over
the pieces that end there keeps score and backpointer. A model of the merge kind
(BPE) has ranks for scores, and the segmentation of the highest sum is not the one
that its merges give, so for such a model the same batches and look-ups run the
merges instead: in each step every word merges its best pair, the leftmost of
equals. Ids are those of the sentencepiece library.

Null and empty texts have no ids and decode to an empty text; repeated rows give
equal rows; very long texts are encoded whole; an empty table gives an empty
result; other columns are left out. U+2581 in a text is read as a space, as the
library does. Models with a character map or that squeeze spaces are refused.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SPACE = "▁"
LONG_WORD = 48
CACHED_WORDS = 500_000
SLICE_CHARS = 1 << 21
ROWS = 4096
_BASE = np.uint64(0x100000001B3)
_WORDS = re.compile(" *[^ ]+| +")


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Row by row, the hashes of all prefixes of equal-length words."""
    h = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        h[:, i + 1] = h[:, i] * _BASE + (codes[:, i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return h


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class Pieces:
    """A vocabulary: sorted hashes of the pieces with their ids and scores."""

    def __init__(self, pieces: list[tuple[str, float, str]], kind: str, dummy_prefix: bool = True):
        """``pieces`` are text, score and type: normal, unknown, control or byte; ``kind`` is unigram or bpe."""
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.scores = np.array([s for _, s, _ in pieces])
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == "unknown"), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == "byte"}
        self.raw = [bytes([int(p[3:5], 16)]) if t == "byte" else " ⁇ ".encode() if t == "unknown" else b"" if t == "control" else p.encode() for p, _, t in pieces]
        normal = [(p, i) for i, (p, _, t) in enumerate(pieces) if t == "normal"]
        if any(SPACE in p.lstrip(SPACE) for p, _ in normal):
            raise ValueError("pieces that reach over a space are not supported")
        self.longest = max(len(p) for p, _ in normal)
        powers = np.full(max(self.longest, 2) + 1, _BASE)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        keys, ids, pairs = [], [], set()
        for p, i in normal:
            keys.append(_prefix_hashes(_codes([p]))[0, -1])
            ids.append(i)
            pairs.update(zip(p, p[1:], strict=False))
        order = np.argsort(np.array(keys, np.uint64))
        self.keys, self.ids = np.array(keys, np.uint64)[order], np.array(ids)[order]
        self.beside = pairs
        self.cache: dict[str, bytes] = {}

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], -1)

    def _between(self, h: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the substrings from ``a`` to ``b``; longer ones than any piece are none."""
        n = b - a
        found = self.lookup(h[rows, b] - h[rows, a] * self.powers[np.minimum(n, self.longest)])
        return np.where(n <= self.longest, found, -1)

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segmentation of equal-length words with the highest sum of scores: cuts, numbers of pieces, ids (-1: none)."""
        h = _prefix_hashes(_codes(words))
        w, n = len(words), h.shape[1] - 1
        best = np.full((w, n + 1), -np.inf)
        best[:, 0] = 0
        back, rows = np.zeros((w, n + 1), np.int64), np.arange(w)
        unknown = self.scores[self.ids].min() - 10
        for end in range(1, n + 1):
            starts = np.arange(max(0, end - self.longest), end)
            found = self.lookup(h[:, end : end + 1] - h[:, starts] * self.powers[end - starts])
            value = np.where(found >= 0, self.scores[found], np.where(starts == end - 1, unknown, -np.inf)) + best[:, starts]
            pick = value.argmax(1)
            best[:, end], back[:, end] = value[rows, pick], starts[pick]
        ends, at = np.zeros((w, n + 1), bool), np.full(w, n)
        while at.any():
            ends[rows, at] = True
            at = back[rows, at]
        ends[:, 0] = True
        count = ends.sum(1) - 1
        cuts = np.full((w, n + 1), n)
        cuts[np.arange(n + 1) <= count[:, None]] = np.nonzero(ends)[1]
        return cuts, count, self._between(h, rows[:, None], cuts[:, :-1], cuts[:, 1:])

    def merges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segmentation of equal-length words by merging the best pair of each in every step, as :meth:`viterbi` returns it."""
        h = _prefix_hashes(_codes(words))
        w, n = len(words), h.shape[1] - 1
        cuts, count = np.tile(np.arange(n + 1), (w, 1)), np.full(w, n)
        rows = np.arange(w)  # the words that still merge; c and value are theirs
        c = cuts.copy()

        def scored(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            found = self._between(h, rows, a, b)
            return np.where(found >= 0, self.scores[found], -np.inf)

        value = np.full((w, n), -np.inf)
        value[:, : n - 1] = scored(rows[:, None], c[:, : n - 1], c[:, 2:])
        while len(rows):
            pick = value.argmax(1)
            go = value[np.arange(len(rows)), pick] > -np.inf
            if not go.all():
                cuts[rows[~go]] = c[~go]
                rows, c, value, pick = rows[go], c[go], value[go], pick[go]
                if not len(rows):
                    break
            one, at = np.arange(len(rows)), np.arange(n + 1)
            c = np.take_along_axis(c, np.minimum(at + (at > pick[:, None]), n), 1)
            value = np.take_along_axis(value, np.minimum(at[:-1] + (at[:-1] > pick[:, None]), n - 1), 1)
            count[rows] -= 1
            left, last = np.maximum(pick - 1, 0), count[rows] - 1
            value[one, left] = np.where(pick > 0, scored(rows, c[one, left], c[one, left + 2]), value[one, left])
            value[one, pick] = np.where(pick < last, scored(rows, c[one, pick], c[one, np.minimum(pick + 2, n)]), -np.inf)
        return cuts, count, self._between(h, np.arange(w)[:, None], cuts[:, :-1], cuts[:, 1:])

    def _ids_of(self, word: str, cuts: list[int], found: list[int]) -> bytes:
        """The ids of a word that has a part which is no piece."""
        out: list[int] = []
        for a, b, i in zip(cuts, cuts[1:], found, strict=False):
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[x] for x in word[a:b].encode("utf-8", "replace")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def _segmented(self, words: list[str]) -> list[bytes]:
        """The ids of equal-length words."""
        cuts, count, found = (self.viterbi if self.kind == "unigram" else self.merges)(words)
        there = np.arange(found.shape[1]) < count[:, None]
        raw = found[there].astype("<u4").tobytes()
        ends = np.cumsum(count) * 4
        whole = ((found >= 0) | ~there).all(1)
        return [
            raw[e - 4 * k : e] if ok else self._ids_of(words[r], cuts[r, : k + 1].tolist(), found[r, :k].tolist())
            for r, (e, k, ok) in enumerate(zip(ends.tolist(), count.tolist(), whole.tolist(), strict=True))
        ]

    def _safe_parts(self, word: str) -> list[str]:
        """A long word, cut between characters that no piece has side by side."""
        if len(word) <= LONG_WORD or not self.bytes:
            return [word]
        cuts = [0, *(i for i, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in self.beside), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, words: set[str]) -> None:
        parts = {w: self._safe_parts(w) for w in words}
        by_length: dict[int, list[str]] = {}
        for p in {p for ps in parts.values() for p in ps}:
            by_length.setdefault(len(p), []).append(p)
        done: dict[str, bytes] = {}
        for length, own in by_length.items():
            step = max(1, ROWS * 8 // length)
            for c in range(0, len(own), step):
                done.update(zip(own[c : c + step], self._segmented(own[c : c + step]), strict=True))
        for w, ps in parts.items():
            self.cache[w.replace(SPACE, " ")] = done[ps[0]] if len(ps) == 1 else b"".join(map(done.__getitem__, ps))

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; texts are taken by slices, so that few words are held at a time."""
        out, begin, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= SLICE_CHARS or i == len(texts) - 1:
                out += self._encode_slice(texts[begin : i + 1])
                begin, held = i + 1, 0
        return out

    def _encode_slice(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [_WORDS.findall(((" " if self.dummy_prefix else "") + t).replace(SPACE, " ")) if t else [] for t in texts]
        new = {w for ws in cut for w in ws if w not in self.cache}
        if new:
            if len(self.cache) > CACHED_WORDS:
                self.cache.clear()
                new = {w for ws in cut for w in ws}
            self._learn({w.replace(" ", SPACE) for w in new})
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<u4") for ws in cut]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


@lru_cache(2)
def load(path: str) -> Pieces:
    """The vocabulary of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n = model.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: the normalisation of this model is not supported")
    types = {1: "normal", 2: "unknown", 3: "control", 6: "byte"}
    if unsupported := {p.type for p in model.pieces} - set(types):
        raise ValueError(f"{path}: pieces of the types {sorted(unsupported)} are not supported")
    pieces = [(p.piece, p.score, types[p.type]) for p in model.pieces]
    return Pieces(pieces, {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type], n.add_dummy_prefix)


def encode_column(text_col: str, path: str) -> Column:
    """The ids of the texts in ``text_col``; never null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([x.astype(np.int32) for x in load(path).encode_all(list(texts))], dtype=object)

    return encode(F.col(text_col))


def decode_column(ids_col: str, path: str) -> Column:
    """The texts of the ids in ``ids_col``; null ids are an empty text."""

    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        own = load(path)
        return pd.Series([own.decode(np.asarray(x)) if x is not None else "" for x in ids], dtype=object)

    return decode(F.col(ids_col))


DIGEST = T.StructType(
    [T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded", T.StringType())]
)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: id, number of ids, their CRC-32 as little-endian 32-bit numbers, and whether the text came back."""

    @F.pandas_udf(DIGEST)
    def run(texts: pd.Series) -> pd.DataFrame:
        own = load(path)
        ids = own.encode_all(list(texts))
        rows = [(len(x), zlib.crc32(x.tobytes()), own.decode(x)) for x in ids]
        return pd.DataFrame(rows, columns=DIGEST.names)

    found = df.select(id_col, text_col, run(F.col(text_col)).alias("_d"))
    return found.select(
        id_col,
        "_d.n_pieces",
        "_d.ids_crc32",
        F.length("_d.decoded").cast("long").alias("decoded_chars"),
        (F.col("_d.decoded") == F.coalesce(text_col, F.lit(""))).alias("same_text"),
    )


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_model())


QUERIES = {"op4_sentence_pieces": op4_sentence_pieces}
ORACLES: dict[str, str] = {}
