"""Vector quantisation: 8-bit, 3-bit, sign bits and polar angles, with their distances.

Codes are arrays of small integers or, packed, of 64-bit words: 21 three-bit
values or 64 bits a word. Distances between codes work on the raw codes; search
in a quantised table decodes the rows and compares them with the query as it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.errors import InvalidConfig

from .distance import COSINE, DOT, fold, normalised, parse_distance

# The untrained parameters, the packing and the seed of the rotation.
DEFAULT_MIN, DEFAULT_MAX, DEFAULT_SCALE = -1.0, 1.0, 127.0
PER_WORD = 21
BINS = 8
SEED = 42


def trained(df: DataFrame, vector: str = "vector") -> tuple[float, float, float]:
    """Smallest and largest value of all vectors and the scale for 8 bits; NaN is left out."""
    v = F.filter(vector, lambda x: ~F.isnan(x))
    r = df.agg(F.min(F.array_min(v)).alias("low"), F.max(F.array_max(v)).alias("high")).first()
    low, high = float(r["low"]), float(r["high"])
    return low, high, 255.0 / (high - low) if high > low else 1.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _round(x: Column) -> Column:
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5))


def int8(v: Column, low: float = DEFAULT_MIN, high: float = DEFAULT_MAX, scale: float = DEFAULT_SCALE) -> Column:
    """8-bit codes from -128 to 127; all 0 where the range is empty."""
    if high <= low:
        return F.transform(v, lambda _: F.lit(0))
    clamped = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x.cast("double")))
    return F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), _round((clamped(x) - low) * scale - 128))).cast("int"))


def int8_decoded(codes: Column, low: float = DEFAULT_MIN, high: float = DEFAULT_MAX, scale: float = DEFAULT_SCALE) -> Column:
    if high <= low:
        return F.transform(codes, lambda _: F.lit(low))
    return F.transform(codes, lambda q: (q + 128) / F.lit(scale) + low)


def int3(v: Column, low: float = DEFAULT_MIN, high: float = DEFAULT_MAX) -> Column:
    """3-bit codes from 0 to 7; all 3 where the range is empty."""
    if high <= low:
        return F.transform(v, lambda _: F.lit(3))
    return F.transform(v, lambda x: F.greatest(F.lit(0), F.least(F.lit(7), _round((x.cast("double") - low) / (high - low) * 7))).cast("int"))


def int3_decoded(codes: Column, low: float = DEFAULT_MIN, high: float = DEFAULT_MAX) -> Column:
    return F.transform(codes, lambda q: q / F.lit(7.0) * (high - low) + low)


def binary(v: Column) -> Column:
    """1 for values over 0, else 0."""
    return F.transform(v, lambda x: F.when(x > 0, 1).otherwise(0))


def binary_decoded(codes: Column) -> Column:
    return F.transform(codes, lambda b: F.when(b == 1, 1.0).otherwise(-1.0))


def packed(codes: Column, bits: int) -> Column:
    """Codes of 1 or 3 bits as 64-bit words, the first code lowest."""
    per = 64 if bits == 1 else PER_WORD

    def words(c: Column) -> Column:
        word = lambda w: F.aggregate(
            F.transform(F.slice(c, w * per + 1, F.lit(per)), lambda x, i: F.call_function("shiftleft", x.cast("long"), i * bits)),
            F.lit(0).cast("long"),
            lambda a, x: a.bitwiseOR(x),
        )
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(c) / per).cast("int") - 1), word)

    return F.when(F.size(codes) > 0, _let(codes, words)).otherwise(F.array().cast("array<bigint>"))


def unpacked(words: Column, bits: int, dimensions: int) -> Column:
    per, mask = (64, 1) if bits == 1 else (PER_WORD, 7)
    at = F.sequence(F.lit(0), F.lit(dimensions - 1))
    shifted = lambda w, i: F.call_function("shiftrightunsigned", F.get(w, F.floor(i / per).cast("int")), (i % per) * bits)
    return _let(words, lambda w: F.transform(at, lambda i: shifted(w, i).bitwiseAND(mask).cast("int")))


def rotation(dimensions: int, seed: int = SEED) -> tuple[list[int], list[int]]:
    """Signs by value and the order of values of the fixed rotation, from 32-bit xorshift numbers."""

    def numbers(state: int):
        while True:
            for left, by in ((True, 13), (False, 17), (True, 5)):
                state = (state ^ (state << by if left else state >> by)) & 0xFFFFFFFF
            yield state

    draw = numbers(seed)
    signs = [1 if next(draw) & 1 else -1 for _ in range(dimensions)]
    order, draw = list(range(dimensions)), numbers((seed * 7 + 13) & 0xFFFFFFFF)
    for last in range(dimensions - 1, 0, -1):
        other = next(draw) % (last + 1)
        order[last], order[other] = order[other], order[last]
    return signs, order


def polar(v: Column, dimensions: int) -> Column:
    """Angle bins from 0 to 7 of pairs of values of the normalised, rotated vector."""
    if dimensions % 2:
        raise InvalidConfig("polar quantisation takes an even number of dimensions")
    signs, order = rotation(dimensions)
    pick = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(signs[i])).alias("s")) for i in order])
    at = lambda n, p: F.get(n, F.get(pick, p)["i"]) * F.get(pick, p)["s"]

    def bins(n: Column) -> Column:
        angle = lambda p: F.atan2(at(n, p * 2 + 1), at(n, p * 2))
        return F.transform(F.sequence(F.lit(0), F.lit(dimensions // 2 - 1)), lambda p: (F.floor((angle(p) + math.pi) / (2 * math.pi) * BINS) % BINS).cast("int"))

    return _let(normalised(v), bins)


def polar_decoded(bins: Column, dimensions: int) -> Column:
    """Vector of unit pairs at the middles of the bins, rotated back."""
    signs, order = rotation(dimensions)
    place = [0] * dimensions
    for i, j in enumerate(order):
        place[j] = i
    where = F.array(*[F.struct(F.lit(p // 2).alias("p"), F.lit(p % 2).alias("odd"), F.lit(float(signs[j])).alias("s")) for j, p in enumerate(place)])
    middle = lambda b: F.lit(-math.pi) + (b + 0.5) * (2 * math.pi / BINS)
    angle = lambda b, w: middle(F.get(b, w["p"]))
    return _let(bins, lambda b: F.transform(where, lambda w: F.when(w["odd"] == 1, F.sin(angle(b, w))).otherwise(F.cos(angle(b, w))) * w["s"]))


def codes_distance(metric: str, a: Column, b: Column) -> Column:
    """Distance of 8-bit or 3-bit codes as they are; cosine of a zero code is 1."""
    from .distance import distance

    return distance(metric, a, b)


def hamming(a: Column, b: Column) -> Column:
    """Different bits of packed words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def binary_distance(metric: str, a: Column, b: Column, dimensions: int) -> Column:
    metric = parse_distance(metric)
    h = hamming(a, b).cast("double")
    if metric == COSINE:
        return h / dimensions if dimensions else F.lit(0.0)
    return h - dimensions if metric == DOT else h


def polar_distance(a: Column, b: Column) -> Column:
    """1 minus the mean cosine of the angles between paired bins."""
    cosines = F.zip_with(a, b, lambda x, y: F.cos((x - y) * F.lit(2 * math.pi / BINS)))
    return 1 - fold(cosines) / F.size(a)


def quantised_distance(metric: str, a: Column, kind_a: str, b: Column, kind_b: str, dimensions: int) -> Column:
    """Distance of two vectors stored in any kinds; ``none`` is a plain vector.

    Codes of one kind are compared as they are; two kinds, and polar codes by anything but the cosine, as decoded vectors.
    """
    metric = parse_distance(metric)
    if kind_a == kind_b:
        if kind_a in ("none", "int8", "int3"):
            return codes_distance(metric, a, b)
        if kind_a == "binary":
            return binary_distance(metric, packed(a, 1), packed(b, 1), dimensions)
        if kind_a == "polar" and metric == COSINE:
            return polar_distance(a, b)
    from .distance import distance

    plain = lambda v, kind: v if kind == "none" else decoded(kind, v, dimensions)
    return distance(metric, plain(a, kind_a), plain(b, kind_b))


def memory_bytes(kind: str, dimensions: int) -> int:
    """Bytes of one stored vector of a kind."""
    sizes = {"none": 4 * dimensions, "int8": dimensions, "int3": 8 * -(-dimensions // PER_WORD), "binary": 8 * -(-dimensions // 64)}
    sizes["polar"] = 8 * -(-(dimensions // 2) // PER_WORD)
    if kind not in sizes:
        raise InvalidConfig(f"unknown quantisation {kind!r}")
    return sizes[kind]


def decoded(kind: str, codes: Column, dimensions: int) -> Column:
    """The stored codes of a kind as a vector."""
    found = {"int8": int8_decoded, "int3": int3_decoded, "binary": binary_decoded}.get(kind)
    if found:
        return found(codes)
    if kind == "polar":
        return polar_decoded(codes, dimensions)
    raise InvalidConfig(f"unknown quantisation {kind!r}")


def encoded(kind: str, v: Column, dimensions: int) -> Column:
    """The codes of a vector in a kind."""
    if kind == "polar":
        return polar(v, dimensions)
    found = {"int8": int8, "int3": int3, "binary": binary}.get(kind)
    if not found:
        raise InvalidConfig(f"unknown quantisation {kind!r}")
    return found(v)


