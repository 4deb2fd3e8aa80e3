"""Dotted paths over Spark schemas: reading, setting and removing nested fields by rewriting structs at plan time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(path: str) -> str:
    return ".".join(f"`{p}`" for p in path.split("."))


def lookup_type(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a path; through arrays of structs it is an array. None if there is no such field."""
    kind: T.DataType = schema
    wraps = 0
    for p in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind, wraps = kind.elementType, wraps + 1
        if isinstance(kind, T.MapType):
            kind = kind.valueType
            continue
        if isinstance(kind, T.VariantType):
            return kind
        if not isinstance(kind, T.StructType) or p not in kind.fieldNames():
            return None
        kind = kind[p].dataType
    for _ in range(wraps):
        kind = T.ArrayType(kind)
    return kind


def tree_of(paths: dict[str, object]) -> dict:
    """{"a.b": x} as {"a": {"b": x}}; leaves are wrapped so that they can be told from branches."""
    out: dict = {}
    for path, v in paths.items():
        at = out
        *parents, last = path.split(".")
        for p in parents:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ValueError(f"{path} is below another path that is set")
        at[last] = (v,)
    return out


def set_fields(kind: T.DataType | None, old: Column | None, tree: dict) -> Column:
    """A struct: the old fields, replaced or extended by the tree's. A value that is no struct gives way to one."""
    fields, seen = [], set()
    names = kind.fieldNames() if isinstance(kind, T.StructType) else []
    for n in names:
        seen.add(n)
        fields.append(_set(kind[n].dataType, old.getField(n), tree[n]).alias(n) if n in tree else old.getField(n).alias(n))
    fields += [_set(None, None, v).alias(n) for n, v in tree.items() if n not in seen]
    return F.struct(*fields)


def _set(kind: T.DataType | None, old: Column | None, v) -> Column:
    return v[0] if isinstance(v, tuple) else set_fields(kind, old, v)


def with_paths(df: DataFrame, paths: dict[str, Column]) -> DataFrame:
    """df with values at paths. All values are computed from df as it was."""
    tree = tree_of(paths)
    out = {}
    for n, v in tree.items():
        if isinstance(v, tuple):
            out[n] = v[0]
        else:
            kind = df.schema[n].dataType if n in df.columns else None
            out[n] = set_fields(kind, F.col(quoted(n)) if kind is not None else None, v)
    kept = [out.pop(c).alias(c) if c in out else F.col(quoted(c)) for c in df.columns]
    return df.select(*kept, *[v.alias(n) for n, v in out.items()])


def drop_tree(kind: T.DataType, col: Column, tree: dict) -> Column:
    """A struct, or each struct of an array, without the tree's leaves; it may end up without fields."""
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: drop_tree(kind.elementType, x, tree))
    if not isinstance(kind, T.StructType):
        return col
    fields = []
    for n in kind.fieldNames():
        if n not in tree:
            fields.append(col.getField(n).alias(n))
        elif not isinstance(tree[n], tuple):
            fields.append(drop_tree(kind[n].dataType, col.getField(n), tree[n]).alias(n))
    return F.when(col.isNotNull(), F.struct(*fields))


def keep_tree(kind: T.DataType, col: Column, tree: dict) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: keep_tree(kind.elementType, x, tree))
    if not isinstance(kind, T.StructType):
        return col
    fields = [(col.getField(n) if isinstance(tree[n], tuple) else keep_tree(kind[n].dataType, col.getField(n), tree[n])).alias(n) for n in kind.fieldNames() if n in tree]
    return F.when(col.isNotNull(), F.struct(*fields))


def without_paths(df: DataFrame, paths: list[str]) -> DataFrame:
    tree = tree_of(dict.fromkeys(paths))
    cols = []
    for c in df.columns:
        if c not in tree:
            cols.append(F.col(quoted(c)))
        elif not isinstance(tree[c], tuple):
            cols.append(drop_tree(df.schema[c].dataType, F.col(quoted(c)), tree[c]).alias(c))
    return df.select(*cols)
