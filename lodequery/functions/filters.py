"""Metadata filters with two-valued logic, compiled to Column expressions.

A missing field makes a leaf false, except ``ne``, ``nin`` and ``exists(False)``;
``not_`` inverts that. Types are not coerced: a leaf of another type than the
stored value is false. Bare predicates are emitted where null and false are the
same to a filter, so they reach the Parquet scan; below ``not_`` they are closed
with ``coalesce``.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodequery.errors import InvalidFilter

EPSILON = 2.220446049250313e-16
Scalar = str | int | float | bool


@dataclass(frozen=True)
class Filter:
    def __and__(self, other: Filter) -> Filter:
        return And((*(self.parts if isinstance(self, And) else (self,)), other))

    def __or__(self, other: Filter) -> Filter:
        return Or((*(self.parts if isinstance(self, Or) else (self,)), other))

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass(frozen=True)
class Leaf(Filter):
    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class And(Filter):
    parts: tuple[Filter, ...]


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple[Filter, ...]


@dataclass(frozen=True)
class Not(Filter):
    part: Filter


def eq(field: str, value: Scalar) -> Filter:
    return Leaf(field, "eq", value)


def ne(field: str, value: Scalar) -> Filter:
    return Leaf(field, "ne", value)


def gt(field: str, value: Scalar) -> Filter:
    return Leaf(field, "gt", value)


def gte(field: str, value: Scalar) -> Filter:
    return Leaf(field, "gte", value)


def lt(field: str, value: Scalar) -> Filter:
    return Leaf(field, "lt", value)


def lte(field: str, value: Scalar) -> Filter:
    return Leaf(field, "lte", value)


def between(field: str, low: Scalar | None = None, high: Scalar | None = None) -> Filter:
    """Both ends inclusive; without bounds always true."""
    ends = [f(field, v) for f, v in ((gte, low), (lte, high)) if v is not None]
    return ends[0] if len(ends) == 1 else And(tuple(ends))


def isin(field: str, values: list[Scalar]) -> Filter:
    return Leaf(field, "in", tuple(values))


def nin(field: str, values: list[Scalar]) -> Filter:
    return Leaf(field, "nin", tuple(values))


def contains(field: str, value: str) -> Filter:
    return Leaf(field, "contains", value)


def starts_with(field: str, value: str) -> Filter:
    return Leaf(field, "starts_with", value)


def ends_with(field: str, value: str) -> Filter:
    return Leaf(field, "ends_with", value)


def regex(field: str, pattern: str) -> Filter:
    return Leaf(field, "regex", pattern)


def exists(field: str, there: bool = True) -> Filter:
    return Leaf(field, "exists", there)


def all_of(*parts: Filter) -> Filter:
    return And(parts)


def any_of(*parts: Filter) -> Filter:
    return Or(parts)


def not_(part: Filter) -> Filter:
    return Not(part)


def validate(f: Filter) -> None:
    """Raise InvalidFilter for a pattern that does not compile, however deep it stands."""
    if isinstance(f, And | Or):
        for p in f.parts:
            validate(p)
    elif isinstance(f, Not):
        validate(f.part)
    elif f.op == "regex":
        try:
            re.compile(f.value)
        except re.error as e:
            raise InvalidFilter(f"invalid regex {f.value!r}: {e}") from None


# Operators of the JSON grammar; those of the second line are extensions.
_JSON_OPS = {"$eq": "eq", "$ne": "ne", "$gt": "gt", "$gte": "gte", "$lt": "lt", "$lte": "lte", "$contains": "contains", "$regex": "regex"}
_JSON_MORE = {"$in": "in", "$nin": "nin", "$exists": "exists", "$startsWith": "starts_with", "$endsWith": "ends_with"}


def parse_filter(source: str | dict) -> Filter | None:
    """A filter from its JSON form; an empty string or ``{}`` as a string is no filter."""
    if isinstance(source, str):
        if source.strip() in ("", "{}"):
            return None
        try:
            source = json.loads(source)
        except ValueError as e:
            raise InvalidFilter(f"not JSON: {e}") from None
    return _parse(source)


def _parse(node: Any) -> Filter:
    if not isinstance(node, dict) or not node:
        raise InvalidFilter("a filter is an object with at least one key")
    parts: list[Filter] = []
    for key, value in node.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list):
                raise InvalidFilter(f"{key} takes an array")
            parts.append((And if key == "$and" else Or)(tuple(_parse(v) for v in value)))
        elif key == "$not":
            parts.append(Not(_parse(value)))
        elif key.startswith("$"):
            raise InvalidFilter(f"unknown operator {key}")
        elif isinstance(value, dict):
            if not value:
                raise InvalidFilter(f"{key}: no operator")
            parts += [_leaf(key, op, v) for op, v in value.items()]
        else:
            parts.append(Leaf(key, "eq", _scalar(value)))
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def _scalar(value: Any) -> Any:
    return "null" if value is None else value


def _leaf(field: str, op: str, value: Any) -> Filter:
    name = (_JSON_OPS | _JSON_MORE).get(op)
    if name is None:
        raise InvalidFilter(f"unknown operator {op}")
    if name in ("contains", "regex", "starts_with", "ends_with") and not isinstance(value, str):
        raise InvalidFilter(f"{op} takes a string")
    if name in ("in", "nin"):
        if not isinstance(value, list):
            raise InvalidFilter(f"{op} takes an array")
        value = tuple(_scalar(v) for v in value)
    return Leaf(field, name, _scalar(value))


@dataclass(frozen=True)
class Found:
    """What a path leads to: a presence test and, by kind, a typed value; ``always`` has the kind of a typed column."""

    there: Column
    text: Column | None = None
    number: Column | None = None
    flag: Column | None = None
    whole: bool = False


class Columns:
    """Resolves dot paths among the typed columns of a DataFrame."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema

    def __call__(self, path: str) -> Found | None:
        kind: T.DataType = self.schema
        col: Column | None = None
        for part in path.split("."):
            if isinstance(kind, T.StructType):
                if part not in kind.names:
                    return None
                col, kind = (F.col(f"`{part}`") if col is None else col.getField(part)), kind[part].dataType
            elif isinstance(kind, T.MapType):
                col, kind = F.try_element_at(col, F.lit(part)), kind.valueType
            elif isinstance(kind, T.ArrayType) and part.isdigit():
                col, kind = F.get(col, F.lit(int(part))), kind.elementType
            else:
                return None
        if isinstance(kind, T.VariantType):
            return _variant_value(col, "$")
        there = col.isNotNull()
        if isinstance(kind, T.StringType):
            return Found(there, text=col)
        if isinstance(kind, T.BooleanType):
            return Found(there, flag=col)
        if isinstance(kind, T.NumericType):
            return Found(there, number=col, whole=isinstance(kind, T.IntegralType))
        return Found(there)


class Variant:
    """Resolves dot paths within one VARIANT column."""

    def __init__(self, column: str):
        self.column = F.col(column)

    def __call__(self, path: str) -> Found:
        steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
        return _variant_value(self.column, "$" + steps)


def _variant_value(col: Column, path: str) -> Found:
    value = F.try_variant_get(col, path, "variant")
    kind = F.schema_of_variant(value)
    numeric = (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")
    typed = lambda test, name: F.when(test, F.try_variant_get(col, path, name))
    text = F.when(kind == "STRING", F.try_variant_get(col, path, "string")).when(kind == "VOID", F.lit("null"))
    return Found(value.isNotNull(), text=text, number=typed(numeric, "double"), flag=typed(kind == "BOOLEAN", "boolean"))


def compile_filter(f: Filter | None, resolve: Any) -> Column:
    """The filter as one boolean Column for ``where``; ``resolve`` is :class:`Columns` or :class:`Variant`."""
    if f is None:
        return F.lit(True)
    validate(f)
    return _compile(f, resolve, False)


def _compile(f: Filter, resolve: Any, closed: bool) -> Column:
    if isinstance(f, And | Or):
        parts = [_compile(p, resolve, closed) for p in f.parts]
        return reduce(lambda a, b: a & b if isinstance(f, And) else a | b, parts) if parts else F.lit(True)
    if isinstance(f, Not):
        return ~_compile(f.part, resolve, True)
    found = resolve(f.field)
    if f.op in ("ne", "nin"):
        return ~_compile(Leaf(f.field, "eq" if f.op == "ne" else "in", f.value), resolve, True)
    test = _leaf_test(f, found)
    return F.coalesce(test, F.lit(False)) if closed else test


def _leaf_test(f: Leaf, found: Found | None) -> Column:
    no = F.lit(False)
    if f.op == "exists":
        there = found.there if found is not None else no
        return there if f.value else ~there
    if found is None:
        return no
    if f.op == "eq":
        return _equal(found, f.value)
    if f.op == "in":
        return reduce(lambda a, b: a | b, [_equal(found, v) for v in f.value], no)
    if f.op in ("gt", "gte", "lt", "lte"):
        return _ordered(found, f.op, f.value)
    if found.text is None or not isinstance(f.value, str):
        return no
    if f.op == "regex":
        return found.text.rlike(f.value)
    low, want = F.lower(found.text), F.lower(F.lit(f.value))
    return {"contains": low.contains, "starts_with": low.startswith, "ends_with": low.endswith}[f.op](want)


def _equal(found: Found, value: Any) -> Column:
    if isinstance(value, bool):
        return found.flag == value if found.flag is not None else F.lit(False)
    if isinstance(value, str):
        return found.text == value if found.text is not None else F.lit(False)
    if not isinstance(value, int | float) or found.number is None:
        return F.lit(False)
    if found.whole and isinstance(value, int):
        return found.number == value
    x = found.number
    return (x >= value - EPSILON) & (x <= value + EPSILON) & (F.abs(x - F.lit(float(value))) < EPSILON)


def _ordered(found: Found, op: str, value: Any) -> Column:
    if isinstance(value, bool):
        return F.lit(False)
    if isinstance(value, str):
        x, extra = found.text, None
    elif isinstance(value, int | float):
        x, extra = found.number, None if found.whole or found.number is None else ~F.isnan(found.number)
        if value != value:
            return F.lit(False)
    else:
        return F.lit(False)
    if x is None:
        return F.lit(False)
    test = {"gt": x > value, "gte": x >= value, "lt": x < value, "lte": x <= value}[op]
    return test if extra is None else test & extra


def matches(f: Filter | None, row: dict) -> bool:
    """The same rules for one row in plain Python, for tests and small results on the driver."""
    if f is None:
        return True
    if isinstance(f, And):
        return all(matches(p, row) for p in f.parts)
    if isinstance(f, Or):
        return not f.parts or any(matches(p, row) for p in f.parts)
    if isinstance(f, Not):
        return not matches(f.part, row)
    value: Any = row
    for part in f.field.split("."):
        if isinstance(value, dict):
            value = value.get(part)
        elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            value = None
    if f.op == "exists":
        return (value is not None) == f.value
    if f.op in ("ne", "nin"):
        return not matches(Leaf(f.field, "eq" if f.op == "ne" else "in", f.value), row)
    if f.op == "in":
        return any(_same(value, v) for v in f.value)
    if f.op == "eq":
        return _same(value, f.value)
    if f.op in ("gt", "gte", "lt", "lte"):
        numbers = all(isinstance(v, int | float) and not isinstance(v, bool) for v in (value, f.value))
        if not numbers and not (isinstance(value, str) and isinstance(f.value, str)):
            return False
        return {"gt": value > f.value, "gte": value >= f.value, "lt": value < f.value, "lte": value <= f.value}[f.op]
    if not isinstance(value, str) or not isinstance(f.value, str):
        return False
    if f.op == "regex":
        return re.search(f.value, value) is not None
    low, want = value.lower(), f.value.lower()
    return {"contains": want in low, "starts_with": low.startswith(want), "ends_with": low.endswith(want)}[f.op]


def _same(a: Any, b: Any) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, str) or isinstance(b, str):
        return isinstance(a, str) and isinstance(b, str) and a == b
    if isinstance(a, int) and isinstance(b, int):
        return a == b
    return isinstance(a, int | float) and isinstance(b, int | float) and abs(a - b) < EPSILON
