"""Stages on one document at a time: match, set, project, unset, replace, key, unwind, redact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweir.functions.expressions import Json, Scope, compile_expression
from docweir.functions.paths import keep_tree, lookup_type, quoted, tree_of, with_paths, without_paths
from docweir.functions.predicates import compile_match
from docweir.plans.context import KEY, Context


def must(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def scope_of(df: DataFrame, ctx: Context) -> Scope:
    return Scope.of(df, ctx.functions)


def match(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    must(isinstance(spec, dict), "$match takes an object")
    return df.filter(compile_match(spec, scope_of(df, ctx)))


def add_fields(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """All expressions see the document as it came in."""
    must(isinstance(spec, dict), "$addFields takes an object")
    scope = scope_of(df, ctx)
    return with_paths(df, {k: compile_expression(v, scope) for k, v in spec.items()})


def _flat(spec: dict, at: str = "") -> dict[str, Json]:
    """{"a": {"b": 1}} is a.b; {"a": {"$op": ..}} is an expression at a."""
    out: dict[str, Json] = {}
    for k, v in spec.items():
        if isinstance(v, dict) and len(v) == 1 and not next(iter(v)).startswith("$"):
            out |= _flat(v, f"{at}{k}.")
        else:
            out[at + k] = v
    return out


def _flag(v: Json) -> bool | None:
    if isinstance(v, bool):
        return v
    return bool(v) if isinstance(v, int | float) and v in (0, 1) else None


def project(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    must(isinstance(spec, dict) and bool(spec), "$project takes an object with fields")
    flat = _flat(spec)
    without = [k for k, v in flat.items() if _flag(v) is False]
    include = [k for k, v in flat.items() if _flag(v) is True]
    update = {k: v for k, v in flat.items() if _flag(v) is None}
    if any(k != "_id" for k in without):
        must(not include and not update, "$project either leaves fields out or names those to keep")
        return without_paths(df, without)
    if not include and not update:
        return without_paths(df, without)
    scope = scope_of(df, ctx)
    removed = {k for k, v in update.items() if v == "$$REMOVE"}
    values = {k: compile_expression(v, scope) for k, v in update.items() if k not in removed}
    kept = [k for k in include if lookup_type(df.schema, k) is not None]
    if "_id" in df.columns and "_id" not in without and "_id" not in kept:
        kept.insert(0, "_id")
    if KEY in df.columns and KEY not in kept:
        kept.insert(0, KEY)
    shown = [k for k in kept if k not in values]
    # What is computed takes its place among what is kept: first the kept parts, then the values set into them.
    tree = tree_of(dict.fromkeys(_tops(shown + [k for k in values if "." in k and lookup_type(df.schema, k) is not None])))
    cols = []
    for c in df.columns:
        if c in tree:
            cols.append((F.col(quoted(c)) if isinstance(tree[c], tuple) else keep_tree(df.schema[c].dataType, F.col(quoted(c)), tree[c])).alias(c))
    temp = {k: f"__v{i}" for i, k in enumerate(values)}
    staged = df.select(*cols, *[v.alias(temp[k]) for k, v in values.items()])
    out = with_paths(staged, {k: F.col(t) for k, t in temp.items()})
    return out.drop(*temp.values())


def _tops(paths: list[str]) -> list[str]:
    """Paths without those below another one."""
    return [p for p in dict.fromkeys(paths) if not any(p != q and p.startswith(q + ".") for q in paths)]


def unset(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    must(isinstance(spec, str | list), "$unset takes a field or an array of fields")
    return without_paths(df, [f for f in (spec if isinstance(spec, list) else [spec]) if isinstance(f, str)])


def replace_with(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """The expression's object, a row; its string _id becomes the key. A null object leaves no fields to keep: the row
    stays, with nulls. An expression that isn't an object leaves documents as they are."""
    col = compile_expression(spec, scope_of(df, ctx))
    inner = df.select(*[F.col(KEY)] * (KEY in df.columns), col.alias("__new"))
    kind = inner.schema["__new"].dataType
    if not isinstance(kind, T.StructType):
        return df
    names = kind.fieldNames()
    out = inner.select(*[F.col(KEY)] * (KEY in df.columns), *[F.col(f"__new.`{n}`").alias(n) for n in names if n != KEY])
    if KEY in df.columns and "_id" in names and isinstance(kind["_id"].dataType, T.StringType):
        out = out.withColumn(KEY, F.coalesce("_id", KEY))
    return out


def replace_root(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    must(isinstance(spec, dict) and "newRoot" in spec, "$replaceRoot takes an object with newRoot")
    return replace_with(df, spec["newRoot"], ctx)


def key_text(c: Column) -> Column:
    return c.cast("string")


def set_key(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    return df.withColumn(KEY, key_text(compile_expression(spec, scope_of(df, ctx))))


def unwind(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """A row for each element. Other values than arrays, missing and empty ones give none, or one row if preserved."""
    must(isinstance(spec, str) or isinstance(spec, dict) and "path" in spec, "$unwind takes a path or an object with path")
    full = {"path": spec} if isinstance(spec, str) else spec
    path, keep = full["path"].removeprefix("$"), bool(full.get("preserveNullAndEmptyArrays"))
    index, fresh = full.get("includeArrayIndex"), bool(full.get("newIds"))
    kind = lookup_type(df.schema, path)
    if not isinstance(kind, T.ArrayType):
        if not keep:
            return df.limit(0)
        out = df
        if index:
            out = out.withColumn(index, F.lit(None).cast("long"))
    else:
        explode = F.posexplode_outer if keep else F.posexplode
        out = df.select("*", explode(F.col(quoted(path))).alias("__pos", "__item"))
        out = with_paths(out, {path: F.col("__item")})
        if index:
            out = out.withColumn(index.removeprefix("$"), F.col("__pos").cast("long"))
        out = out.drop("__pos", "__item")
    if fresh:
        out = out.withColumn("_id", F.expr("uuid()")).withColumn(KEY, F.col("_id"))
    return out


def redact(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """KEEP keeps a document whole, DESCEND looks into its objects and arrays of objects, anything else removes it.

    The recursion is over the schema, at plan time: a removed object is null, a removed array element is gone.
    """
    scope = scope_of(df, ctx)
    root = compile_expression(spec, scope)

    def below(kind: T.DataType, col: Column) -> Column:
        if isinstance(kind, T.StructType):
            own = Scope(df, kind, col, scope.variables, scope.functions, inner=True)
            said = compile_expression(spec, own)
            inner = F.struct(*[below(f.dataType, col.getField(f.name)).alias(f.name) for f in kind.fields])
            return F.when(col.isNull(), F.lit(None)).when(said == "KEEP", col).when(said == "DESCEND", inner)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            kept = F.transform(col, lambda x: below(kind.elementType, x))
            return F.filter(kept, lambda x: x.isNotNull())
        return col

    said = F.coalesce(root, F.lit("PRUNE"))
    out = df.withColumn("__said", said).where(F.col("__said").isin("KEEP", "DESCEND"))
    cols = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        plain = not isinstance(f.dataType, T.StructType | T.ArrayType)
        cols.append(c if plain else F.when(F.col("__said") == "KEEP", c).otherwise(below(f.dataType, c)).alias(f.name))
    return out.select(*cols)
