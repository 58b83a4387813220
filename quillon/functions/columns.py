"""Column helpers: strings, identity, vectors, citations and metadata filters. All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)\s+"


def strip(text: Column | str) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column | str) -> Column:
    """Lower-case words between white space; a blank text has none, null stays null."""
    return F.array_remove(F.split(F.lower(text), _SPACE), "")


def content_id(text: Column | str) -> Column:
    """Identity by content: hex SHA-256 of the UTF-8 text."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Similarity; 0 where either vector is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """l2sq: squared Euclidean; cosine: 1 - similarity; dot: negative inner product. Vectors of unlike length: null."""
    if metric == "l2sq":
        d = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    elif metric == "cosine":
        d = 1 - cosine(a, b)
    elif metric == "dot":
        d = -dot(a, b)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return F.when(F.size(a) == F.size(b), d)


def citation(metadata: Column, doc_id: Column, chunk_index: Column | None = None) -> Column:
    """Source, else file name, else the first 12 characters of the id; with the number of the chunk if there is one."""
    base = F.coalesce(F.element_at(metadata, "source"), F.element_at(metadata, "filename"), F.substring(doc_id, 1, 12))
    index = F.element_at(metadata, "chunk_index") if chunk_index is None else F.coalesce(chunk_index.cast("string"), F.element_at(metadata, "chunk_index"))
    return F.concat(base, F.coalesce(F.concat(F.lit("#chunk"), index), F.lit("")))


def _compare(field: Column, op: str, value: Any) -> Column:
    if op in ("$in", "$nin"):
        # a list with None also matches missing values
        values = [str(v) for v in value if v is not None]
        inside = F.coalesce(field.isin(values), F.lit(False))
        inside = inside | field.isNull() if None in value else inside
        return inside if op == "$in" else ~inside
    if op in ("$eq", "$ne"):
        same = field.eqNullSafe(F.lit(None if value is None else _text(value)))
        return same if op == "$eq" else ~same
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    left, right = (field.try_cast("double"), F.lit(float(value))) if number else (field, F.lit(str(value)))
    tests = {"$gt": left > right, "$gte": left >= right, "$lt": left < right, "$lte": left <= right}
    if op not in tests:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(tests[op], F.lit(False))


def _text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def condition(where: dict[str, Any] | None, metadata: Column, columns: dict[str, Column] | None = None) -> Column:
    """Filter from a dict: field to value (equal, None matching a missing field) or to {operator: value}, joined by
    and; $and and $or take lists of such dicts. `columns` names fields that are columns of their own, so that
    conditions on them reach the scan."""
    if not where:
        return F.lit(True)
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            inner = [condition(w, metadata, columns) for w in value]
            parts.append(reduce(Column.__and__ if key == "$and" else Column.__or__, inner, F.lit(key == "$and")))
            continue
        field = (columns or {}).get(key)
        field = F.element_at(metadata, key) if field is None else field.cast("string")
        tests = value if isinstance(value, dict) else {"$eq": value}
        parts += [_compare(field, op, v) for op, v in tests.items()]
    return reduce(Column.__and__, parts)
