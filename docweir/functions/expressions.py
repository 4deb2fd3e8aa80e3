"""The expression language, compiled to Columns: JVM-side, visible to Catalyst, no Python at run time.

An expression is a literal, "$path", "$$variable", {"$operator": argument} or an object of expressions, which makes a
struct. Missing fields are null. Values of different type families are never equal, and are ordered null < number <
string < object < array < boolean < date, which is decided at plan time from the schema.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweir.functions.paths import lookup_type, quoted

Json = object


@dataclass(frozen=True)
class Scope:
    """What names mean: the document's fields, its schema, variables, and the caller's own functions."""

    frame: DataFrame
    schema: T.StructType
    root: Column | None = None  # a struct to read fields from; the row itself if None
    variables: dict[str, tuple[Column, T.DataType | None]] = field(default_factory=dict)
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)
    inner: bool = False  # inside a function of an array
    known: dict[int, tuple[Column, T.DataType | None]] = field(default_factory=dict)  # types of columns read so far

    @staticmethod
    def of(df: DataFrame, functions: dict | None = None, variables: dict | None = None) -> Scope:
        return Scope(df, df.schema, None, variables or {}, functions or {})

    def document(self) -> Column:
        return self.root if self.root is not None else F.struct(*[F.col(quoted(c)) for c in self.schema.fieldNames()])

    def read(self, path: str) -> Column:
        if lookup_type(self.schema, path) is None:
            return F.lit(None)
        head, *rest = path.split(".")
        return self.note(_walk(self.root.getField(head) if self.root is not None else F.col(quoted(head)), self.schema[head].dataType, rest), lookup_type(self.schema, path))

    def note(self, col: Column, kind: T.DataType | None) -> Column:
        self.known[id(col)] = (col, kind)
        return col

    def bind(self, inner: bool = True, /, **names: tuple[Column, T.DataType | None]) -> Scope:
        return replace(self, variables={**self.variables, **names}, inner=self.inner or inner)

    def type_of(self, col: Column) -> T.DataType | None:
        """A column's type, by analysis; inside a function of an array only its arguments' types are known."""
        for c, kind in self.variables.values():
            if c is col:
                return kind
        if id(col) in self.known:
            return self.known[id(col)][1]
        return None if self.inner else self.frame.select(col).schema[0].dataType


def _walk(col: Column, kind: T.DataType | None, parts: list[str]) -> Column:
    for i, p in enumerate(parts):
        if isinstance(kind, T.VariantType):
            return F.try_variant_get(col, "$." + ".".join(parts[i:]), "variant")
        if isinstance(kind, T.ArrayType):
            rest, element = parts[i:], kind.elementType
            return F.transform(col, lambda x: _walk(x, element, rest))
        if kind is None or isinstance(kind, T.StructType | T.MapType):
            col = col.getField(p) if not isinstance(kind, T.MapType) else col.getItem(p)
            kind = None if kind is None else kind.valueType if isinstance(kind, T.MapType) else kind[p].dataType if p in kind.fieldNames() else T.NullType()
        else:
            return F.lit(None)
    return col


_FAMILY = ((T.NumericType, "number"), (T.StringType, "string"), (T.BooleanType, "boolean"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "date"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object"), (T.NullType, "null"))
RANK = {n: i for i, n in enumerate(("null", "number", "string", "object", "array", "boolean", "date"))}


def family(kind: T.DataType | None) -> str | None:
    return next((name for types, name in _FAMILY if isinstance(kind, types)), None)


def literal(v: Json) -> Column:
    if isinstance(v, list):
        return F.array(*[literal(x) for x in v])
    if isinstance(v, dict):
        return F.struct(*[literal(x).alias(k) for k, x in v.items()])
    return F.lit(v)


def equal(scope: Scope, a: Column, b: Column) -> Column:
    fa, fb = family(scope.type_of(a)), family(scope.type_of(b))
    if fa and fb and fa != fb:
        return a.isNull() & b.isNull()
    return a.eqNullSafe(b)


def ordered(scope: Scope, op: str, a: Column, b: Column) -> Column:
    """a op b in the total order; null is the smallest value."""
    fa, fb = family(scope.type_of(a)), family(scope.type_of(b))
    strict, less = op in ("$lt", "$gt"), op in ("$lt", "$lte")
    if not less:
        a, b, fa, fb = b, a, fb, fa
    if fa and fb and fa != fb and "null" not in (fa, fb):
        by_type = F.lit(RANK[fa] < RANK[fb])
        return F.when(a.isNull(), b.isNotNull() | F.lit(not strict)).when(b.isNull(), F.lit(False)).otherwise(by_type)
    nulls = a.isNull() & (b.isNotNull() if strict else F.lit(True))
    if "null" in (fa, fb):
        return nulls
    return nulls | F.coalesce(a < b if strict else a <= b, F.lit(False))


def truthy(scope: Scope, c: Column) -> Column:
    kind = family(scope.type_of(c))
    if kind == "number":
        return F.coalesce(c != 0, F.lit(False))
    if kind in ("boolean", None):
        return F.coalesce(c, F.lit(False))
    return c.isNotNull()


def compile_expression(expr: Json, scope: Scope) -> Column:
    if isinstance(expr, str) and expr.startswith("$$"):
        return _variable(expr[2:], scope)
    if isinstance(expr, str) and expr.startswith("$"):
        return scope.read(expr[1:])
    if isinstance(expr, list):
        return F.array(*[compile_expression(x, scope) for x in expr])
    if isinstance(expr, dict):
        if len(expr) == 1 and (op := next(iter(expr))).startswith("$"):
            return _operator(op, expr[op], scope)
        if any(k.startswith("$") for k in expr):
            raise ValueError(f"an expression has one operator: {sorted(expr)}")
        return F.struct(*[compile_expression(v, scope).alias(k) for k, v in expr.items()])
    return scope.note(F.lit(expr), _LITERALS.get(type(expr)))


_LITERALS = {bool: T.BooleanType(), int: T.IntegerType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}


def _variable(name: str, scope: Scope) -> Column:
    head, *rest = name.split(".")
    if head in scope.variables:
        col, kind = scope.variables[head]
        return _walk(col, kind, rest)
    if head in ("ROOT", "CURRENT"):
        return scope.read(".".join(rest)) if rest else scope.document()
    if head in ("KEEP", "PRUNE", "DESCEND"):
        return F.lit(head)
    if head == "REMOVE":
        return F.lit(None)
    if head == "NOW":
        return F.current_timestamp()
    raise ValueError(f"unknown variable $${head}")


def _operator(op: str, arg: Json, scope: Scope) -> Column:
    if op in _SPECIAL:
        return _SPECIAL[op](arg, scope)
    args = [compile_expression(a, scope) for a in (arg if isinstance(arg, list) else [arg])]
    if op in scope.functions:
        return scope.functions[op](*args)
    if op in _TYPED:
        return _TYPED[op](scope, *args)
    if op in _PLAIN:
        return _PLAIN[op](*args)
    raise ValueError(f"unknown operator {op}")


# ---------------------------------------------------------------------------------------------- operators


def _fold(f: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    def run(*args: Column) -> Column:
        out = args[0]
        for a in args[1:]:
            out = f(out, a)
        return out

    return run


def _trim(side: Callable[..., Column]) -> Callable[[Json, Scope], Column]:
    def run(arg: Json, scope: Scope) -> Column:
        c = compile_expression(arg["input"], scope)
        return side(c, compile_expression(arg["chars"], scope)) if "chars" in arg else side(c)

    return run


def _cond(arg: Json, scope: Scope) -> Column:
    a, b, c = (arg["if"], arg["then"], arg["else"]) if isinstance(arg, dict) else arg
    return F.when(truthy(scope, compile_expression(a, scope)), compile_expression(b, scope)).otherwise(compile_expression(c, scope))


def _switch(arg: Json, scope: Scope) -> Column:
    out = None
    for b in arg["branches"]:
        test, then = truthy(scope, compile_expression(b["case"], scope)), compile_expression(b["then"], scope)
        out = F.when(test, then) if out is None else out.when(test, then)
    return out.otherwise(compile_expression(arg["default"], scope)) if "default" in arg else out


def _element(scope: Scope, col: Column) -> T.DataType | None:
    kind = scope.type_of(col)
    return kind.elementType if isinstance(kind, T.ArrayType) else None


def _element_test(scope: Scope, xs: Column) -> Callable[[Column], Column]:
    kind = _element(scope, xs)
    return lambda x: truthy(scope.bind(this=(x, kind)), x)


def _map(arg: Json, scope: Scope) -> Column:
    c = compile_expression(arg["input"], scope)
    kind, name = _element(scope, c), arg.get("as", "this")
    return F.transform(c, lambda x: compile_expression(arg["in"], scope.bind(**{name: (x, kind)})))


def _filter(arg: Json, scope: Scope) -> Column:
    c = compile_expression(arg["input"], scope)
    kind, name = _element(scope, c), arg.get("as", "this")

    def test(x: Column) -> Column:
        own = scope.bind(**{name: (x, kind)})
        return truthy(own, compile_expression(arg["cond"], own))

    return F.filter(c, test)


def _reduce(arg: Json, scope: Scope) -> Column:
    c, start = compile_expression(arg["input"], scope), compile_expression(arg["initialValue"], scope)
    element = _element(scope, c)
    first = scope.type_of(start)
    if isinstance(first, T.IntegerType) and isinstance(element, T.NumericType):
        start, first = start.cast(element), element
    return F.aggregate(c, start, lambda acc, x: compile_expression(arg["in"], scope.bind(value=(acc, first), this=(x, element))))


def _let(arg: Json, scope: Scope) -> Column:
    own = {k: compile_expression(v, scope) for k, v in arg["vars"].items()}
    return compile_expression(arg["in"], scope.bind(False, **{k: (c, scope.type_of(c)) for k, c in own.items()}))


def _get_field(arg: Json, scope: Scope) -> Column:
    if isinstance(arg, str):
        return scope.read(arg)
    c = compile_expression(arg.get("input", "$$ROOT"), scope)
    return _walk(c, scope.type_of(c), [arg["field"]])


def _set_field(arg: Json, scope: Scope) -> Column:
    return compile_expression(arg["input"], scope).withField(arg["field"], compile_expression(arg["value"], scope))


def _merge_objects(scope: Scope, *args: Column) -> Column:
    if len(args) == 1 and isinstance(scope.type_of(args[0]), T.ArrayType):
        raise ValueError("$mergeObjects needs its objects one by one")
    fields: dict[str, Column] = {}
    for a in args:
        kind = scope.type_of(a)
        for n in kind.fieldNames() if isinstance(kind, T.StructType) else []:
            # A null object brings no fields.
            fields[n] = F.when(a.isNotNull(), a.getField(n)).otherwise(fields[n]) if n in fields else a.getField(n)
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _object_to_array(scope: Scope, c: Column) -> Column:
    kind = scope.type_of(c)
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return F.when(c.isNotNull(), F.array(*[F.struct(F.lit(n).alias("k"), c.getField(n).alias("v")) for n in kind.fieldNames()]))


def _concat_arrays(scope: Scope, *args: Column) -> Column:
    return F.concat(*args)


def _in(scope: Scope, x: Column, xs: Column) -> Column:
    return F.coalesce(F.array_contains(xs, x), F.lit(False)) | (x.isNull() & F.coalesce(F.exists(xs, lambda e: e.isNull()), F.lit(False)))


def _is_array(scope: Scope, c: Column) -> Column:
    return c.isNotNull() & F.lit(isinstance(scope.type_of(c), T.ArrayType))


def _at(xs: Column, i: Column) -> Column:
    return F.try_element_at(xs, F.when(i >= 0, i + 1).otherwise(i).cast("int"))


def _slice(xs: Column, *n: Column) -> Column:
    if len(n) == 1:
        return F.when(n[0] >= 0, F.slice(xs, F.lit(1), n[0])).otherwise(F.slice(xs, F.greatest(F.size(xs) + n[0] + 1, F.lit(1)), F.least(F.abs(n[0]), F.size(xs))))
    start = F.when(n[0] >= 0, n[0] + 1).otherwise(F.greatest(F.size(xs) + n[0] + 1, F.lit(1)))
    return F.slice(xs, start, n[1])


def _range(a: Column, b: Column, step: Column | None = None) -> Column:
    step = F.lit(1) if step is None else step
    last = F.when(step > 0, b - 1).otherwise(b + 1)
    return F.when((step > 0) & (a <= last) | (step < 0) & (a >= last), F.sequence(a, F.when((step > 0) & (a <= last) | (step < 0) & (a >= last), last).otherwise(a), F.when((step > 0) == (a <= last), step).otherwise(F.lit(1)))).otherwise(F.array().cast("array<int>"))


_FORMAT = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS", "%j": "DDD", "%%": "%"}


def _pattern(text: str) -> str:
    parts = re.split(r"(%[A-Za-z%])", text)
    return "".join(_FORMAT.get(p, p) if p.startswith("%") else re.sub(r"[A-Za-z]+", r"'\g<0>'", p) for p in parts)


def _date_to_string(arg: Json, scope: Scope) -> Column:
    return F.date_format(compile_expression(arg["date"], scope), _pattern(arg.get("format", "%Y-%m-%dT%H:%M:%S.%LZ")))


def _date_from_string(arg: Json, scope: Scope) -> Column:
    c = compile_expression(arg["dateString"], scope)
    return F.try_to_timestamp(c, F.lit(_pattern(arg["format"]))) if "format" in arg else F.try_to_timestamp(c)


def _date_trunc(arg: Json, scope: Scope) -> Column:
    return F.date_trunc(arg["unit"], compile_expression(arg["date"], scope))


def _regex(arg: Json) -> tuple[str, str]:
    pattern, options = arg["regex"], arg.get("options", "")
    return pattern, f"(?{''.join(o for o in options if o in 'ims')})" if options else ""


def _regex_match(arg: Json, scope: Scope) -> Column:
    pattern, flags = _regex(arg)
    return F.coalesce(compile_expression(arg["input"], scope).rlike(flags + pattern), F.lit(False))


def _replace(arg: Json, scope: Scope) -> Column:
    return F.replace(*[compile_expression(arg[k], scope) for k in ("input", "find", "replacement")])


def _convert(kind: str) -> Callable[[Scope, Column], Column]:
    def run(scope: Scope, c: Column) -> Column:
        if kind == "boolean" and family(scope.type_of(c)) == "string":
            return F.when(c.isNotNull(), F.lit(True))
        return c.try_cast(kind)

    return run


_TYPE_NAMES = ((T.BooleanType, "bool"), (T.LongType, "long"), (T.IntegralType, "int"), (T.DecimalType, "decimal"), (T.NumericType, "double"), (T.StringType, "string"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "date"))


def type_name(kind: T.DataType | None) -> str:
    return next((n for k, n in _TYPE_NAMES if isinstance(kind, k)), "null")


def _type(scope: Scope, c: Column) -> Column:
    return F.when(c.isNull(), "null").otherwise(F.lit(type_name(scope.type_of(c))))


def _parse_json(arg: Json, scope: Scope) -> Column:
    """{"input": expr, "schema": DDL}: typed; {"input": expr}: a variant."""
    c = compile_expression(arg["input"], scope)
    return F.from_json(c, arg["schema"]) if "schema" in arg else F.try_parse_json(c)


def _variant_get(arg: Json, scope: Scope) -> Column:
    return F.try_variant_get(compile_expression(arg["input"], scope), arg["path"], arg.get("type", "string"))


_SPECIAL: dict[str, Callable[[Json, Scope], Column]] = {
    "$literal": lambda a, s: literal(a),
    "$cond": _cond,
    "$switch": _switch,
    "$map": _map,
    "$filter": _filter,
    "$reduce": _reduce,
    "$let": _let,
    "$getField": _get_field,
    "$setField": _set_field,
    "$trim": _trim(F.btrim),
    "$ltrim": _trim(F.ltrim),
    "$rtrim": _trim(F.rtrim),
    "$dateToString": _date_to_string,
    "$dateFromString": _date_from_string,
    "$dateTrunc": _date_trunc,
    "$regexMatch": _regex_match,
    "$replaceAll": _replace,
    "$parseJson": _parse_json,
    "$variantGet": _variant_get,
}

_TYPED: dict[str, Callable[..., Column]] = {
    "$eq": equal,
    "$ne": lambda s, a, b: ~equal(s, a, b),
    "$gt": lambda s, a, b: ordered(s, "$gt", a, b),
    "$gte": lambda s, a, b: ordered(s, "$gte", a, b),
    "$lt": lambda s, a, b: ordered(s, "$lt", a, b),
    "$lte": lambda s, a, b: ordered(s, "$lte", a, b),
    "$cmp": lambda s, a, b: F.when(equal(s, a, b), 0).when(ordered(s, "$lt", a, b), -1).otherwise(1),
    "$and": lambda s, *a: _fold(lambda x, y: x & y)(F.lit(True), *[truthy(s, x) for x in a]),
    "$or": lambda s, *a: _fold(lambda x, y: x | y)(F.lit(False), *[truthy(s, x) for x in a]),
    "$not": lambda s, a: ~truthy(s, a),
    "$in": _in,
    "$isArray": _is_array,
    "$mergeObjects": _merge_objects,
    "$objectToArray": _object_to_array,
    "$concatArrays": _concat_arrays,
    "$type": _type,
    "$toInt": _convert("int"),
    "$toLong": _convert("bigint"),
    "$toDouble": _convert("double"),
    "$toString": _convert("string"),
    "$toBool": _convert("boolean"),
    "$toDate": _convert("timestamp"),
    "$anyElementTrue": lambda s, a: F.coalesce(F.exists(a, _element_test(s, a)), F.lit(False)),
    "$allElementsTrue": lambda s, a: F.forall(a, _element_test(s, a)),
}

_PLAIN: dict[str, Callable[..., Column]] = {
    "$ifNull": F.coalesce,
    "$add": _fold(lambda a, b: a + b),
    "$subtract": lambda a, b: a - b,
    "$multiply": _fold(lambda a, b: a * b),
    "$divide": lambda a, b: F.try_divide(a, b),
    "$mod": lambda a, b: F.try_mod(a, b),
    "$abs": F.abs,
    "$ceil": F.ceil,
    "$floor": F.floor,
    "$round": lambda a, n=None: F.bround(a, 0) if n is None else F.bround(a, n),
    "$trunc": lambda a: F.when(a >= 0, F.floor(a)).otherwise(F.ceil(a)),
    "$sqrt": F.sqrt,
    "$pow": F.pow,
    "$exp": F.exp,
    "$ln": F.ln,
    "$log": lambda a, b: F.ln(a) / F.ln(b),
    "$log10": F.log10,
    "$concat": lambda *a: F.concat(*a),
    "$toUpper": lambda a: F.coalesce(F.upper(a), F.lit("")),
    "$toLower": lambda a: F.coalesce(F.lower(a), F.lit("")),
    "$substrCP": lambda a, i, n: F.substring(a, i + 1, n),
    "$strLenCP": F.length,
    "$split": lambda a, b: F.split(a, F.concat(F.lit("\\Q"), b, F.lit("\\E"))),
    "$indexOfCP": lambda a, b: F.instr(a, b) - 1,
    "$year": F.year,
    "$month": F.month,
    "$dayOfMonth": F.dayofmonth,
    "$dayOfWeek": F.dayofweek,
    "$dayOfYear": F.dayofyear,
    "$hour": F.hour,
    "$minute": F.minute,
    "$second": F.second,
    "$size": F.size,
    "$arrayElemAt": _at,
    "$first": lambda a: _at(a, F.lit(0)),
    "$last": lambda a: _at(a, F.lit(-1)),
    "$slice": _slice,
    "$reverseArray": F.reverse,
    "$range": _range,
    "$setUnion": _fold(F.array_union),
    "$setIntersection": _fold(F.array_intersect),
    "$setDifference": F.array_except,
    "$arrayToObject": lambda a: F.map_from_entries(a),
    "$max": F.greatest,
    "$min": F.least,
    "$sum": _fold(lambda a, b: a + b),
}

