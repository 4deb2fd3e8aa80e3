"""The predicate language of match stages, compiled to one boolean Column that Catalyst can push down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweir.functions.expressions import Json, Scope, compile_expression, family, literal, truthy, type_name
from docweir.functions.paths import lookup_type

_RANGE: dict[str, Callable[[Column, Column], Column]] = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


def compile_match(query: Json, scope: Scope) -> Column:
    """True for documents that match. Values of another type family than the field's match nothing."""
    if not isinstance(query, dict):
        raise ValueError("a match is an object")
    parts = [_clause(k, v, scope) for k, v in query.items()]
    return _all(parts)


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for i, p in enumerate(parts):
        out = p if not i else out & p
    return out


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for i, p in enumerate(parts):
        out = p if not i else out | p
    return out


def _clause(key: str, v: Json, scope: Scope) -> Column:
    if key == "$and":
        return _all([compile_match(q, scope) for q in v])
    if key == "$or":
        return _any([compile_match(q, scope) for q in v])
    if key == "$nor":
        return ~F.coalesce(_any([compile_match(q, scope) for q in v]), F.lit(False))
    if key == "$expr":
        return truthy(scope, compile_expression(v, scope))
    if key.startswith("$"):
        raise ValueError(f"unknown query operator {key}")
    kind = lookup_type(scope.schema, key)
    return _tests(scope.read(key), kind, v, scope)


def _tests(col: Column, kind: T.DataType | None, v: Json, scope: Scope) -> Column:
    if isinstance(v, dict) and v and all(k.startswith("$") for k in v):
        return _all([_test(col, kind, op, x, v, scope) for op, x in v.items() if op != "$options"])
    return _equal(col, kind, v)


def _value_family(v: Json) -> str | None:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "number"
    return {str: "string", list: "array", dict: "object"}.get(type(v))


def _comparable(kind: T.DataType | None, v: Json) -> bool:
    a, b = family(kind), _value_family(v)
    return a == b or b is None or a is None or (a == "date" and b == "string")


def _equal(col: Column, kind: T.DataType | None, v: Json) -> Column:
    if v is None:
        return col.isNull()
    if isinstance(kind, T.ArrayType) and not isinstance(v, list):
        return F.coalesce(F.exists(col, lambda x: _equal(x, kind.elementType, v)), F.lit(False))
    if kind is None or not _comparable(kind, v):
        return F.lit(False)
    return F.coalesce(col == literal(v), F.lit(False)) if isinstance(v, list | dict) else col == F.lit(v)


def _test(col: Column, kind: T.DataType | None, op: str, v: Json, whole: dict, scope: Scope) -> Column:
    array = isinstance(kind, T.ArrayType)
    if op == "$eq":
        return _equal(col, kind, v)
    if op == "$ne":
        return ~F.coalesce(_equal(col, kind, v), F.lit(False))
    if op in _RANGE:
        if array and not isinstance(v, list):
            return F.coalesce(F.exists(col, lambda x: _test(x, kind.elementType, op, v, whole, scope)), F.lit(False))
        return _RANGE[op](col, F.lit(v)) if kind is not None and v is not None and _comparable(kind, v) else F.lit(False)
    if op == "$in":
        return _in(col, kind, v)
    if op == "$nin":
        return ~F.coalesce(_in(col, kind, v), F.lit(False))
    if op == "$exists":
        return col.isNotNull() if v else col.isNull()
    if op == "$type":
        names = v if isinstance(v, list) else [v]
        own = type_name(kind)
        return (col.isNotNull() & F.lit(own in names or ("number" in names and family(kind) == "number"))) | (col.isNull() & F.lit("null" in names))
    if op == "$regex":
        flags = whole.get("$options", "")
        pattern = (f"(?{flags})" if flags else "") + v
        if array:
            return F.coalesce(F.exists(col, lambda x: x.rlike(pattern)), F.lit(False))
        return col.rlike(pattern) if family(kind) == "string" else F.lit(False)
    if op == "$size":
        return F.size(col) == v if array else F.lit(False)
    if op == "$all":
        return _all([_equal(col, kind, x) for x in v])
    if op == "$elemMatch":
        return F.coalesce(F.exists(col, lambda x: _element(x, kind.elementType, v, scope)), F.lit(False)) if array else F.lit(False)
    if op == "$mod":
        return F.coalesce(F.try_mod(col, F.lit(v[0])) == v[1], F.lit(False)) if family(kind) == "number" else F.lit(False)
    if op == "$not":
        return ~F.coalesce(_tests(col, kind, v, scope), F.lit(False))
    raise ValueError(f"unknown query operator {op}")


def _in(col: Column, kind: T.DataType | None, values: list) -> Column:
    plain = [v for v in values if v is not None and not isinstance(v, list | dict)]
    if not isinstance(kind, T.ArrayType) and kind is not None:
        own = [v for v in plain if _comparable(kind, v)]
        parts = [col.isin(*own)] if own else []
    else:
        parts = [_equal(col, kind, v) for v in plain]
    parts += [_equal(col, kind, v) for v in values if v is None or isinstance(v, list | dict)]
    return _any(parts)


def _element(x: Column, kind: T.DataType, v: dict, scope: Scope) -> Column:
    if all(k.startswith("$") for k in v):
        return _tests(x, kind, v, scope)
    if not isinstance(kind, T.StructType):
        return F.lit(False)
    return _all([_tests(x.getField(k) if k in kind.fieldNames() else F.lit(None), lookup_type(kind, k), t, scope) for k, t in v.items()])
