"""Lookup: left or inner joins with a collection, as an array of matches or unwound, by equal fields or a pipeline."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweir.functions.expressions import Json, Scope, compile_expression
from docweir.functions.paths import lookup_type, quoted
from docweir.functions.predicates import compile_match
from docweir.operators import fields, grouping
from docweir.operators.fields import must, scope_of
from docweir.plans.context import KEY, Context


def _foreign(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    store = ctx.collections() if not (spec.get("connectionString") and spec.get("database")) else ctx.stores[(spec["connectionString"], spec["database"])]
    out = store.read(spec["from"])
    return out.drop(KEY)


def lookup(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """Reads the collection as it is when the plan is made. foreignField comes before pipeline, localField before let.

    A local array matches by any of its elements. With unwind, matches are told one by one and the join is inner. With
    null_safe, a null local value matches foreign nulls; else it matches nothing.
    """
    must(isinstance(spec, dict) and "as" in spec and "from" in spec, "$lookup takes an object with from and as")
    foreign = _foreign(df, spec, ctx)
    if "foreignField" in spec:
        return _equal(df, foreign, spec, ctx)
    must("pipeline" in spec, "$lookup needs foreignField or pipeline")
    return _correlated(df, foreign, spec, ctx)


def _whole(foreign: DataFrame) -> Column:
    return F.struct(*[F.col(quoted(c)) for c in foreign.columns])


def _equal(df: DataFrame, foreign: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    local, name = spec["localField"], spec["as"]
    kind = lookup_type(df.schema, local)
    right = foreign.select(F.col(quoted(spec["foreignField"])).alias("__fk"), _whole(foreign).alias("__doc"))
    same = (lambda a, b: a.eqNullSafe(b)) if spec.get("null_safe") else (lambda a, b: a == b)
    kept = [c for c in df.columns if c != name]
    many = isinstance(kind, T.ArrayType)
    left = df.withColumn("__lk", F.col(quoted(local)) if kind is not None else F.lit(None).cast(right.schema["__fk"].dataType))
    if spec.get("unwind"):
        if many:
            left = left.withColumn("__lk", F.explode(F.array_distinct("__lk")))
        return left.join(right, same(F.col("__lk"), F.col("__fk"))).select(*[F.col(quoted(c)) for c in kept], F.col("__doc").alias(name))
    how = "inner" if spec.get("inner") else "left"
    empty = F.array().cast(T.ArrayType(right.schema["__doc"].dataType))
    if not many:
        # Foreign rows are gathered by key once, then joined: not once for each local row.
        grouped = right.groupBy("__fk").agg(F.collect_list("__doc").alias("__docs"))
        out = left.join(grouped, same(F.col("__lk"), F.col("__fk")), how)
        return out.select(*[F.col(quoted(c)) for c in kept], F.coalesce("__docs", empty).alias(name))
    # The array itself is the key: its matches are the same whatever row it stands in, and wherever that row lies.
    arrays = left.select(F.col("__lk").alias("__ka")).where("__ka is not null").distinct()
    keys = arrays.select("__ka", F.explode(F.array_distinct("__ka")).alias("__k"))
    found = keys.join(right, same(F.col("__k"), F.col("__fk"))).groupBy("__ka").agg(F.collect_list("__doc").alias("__docs"))
    out = left.join(found, F.col("__lk") == F.col("__ka"), how)
    return out.select(*[F.col(quoted(c)) for c in kept], F.coalesce("__docs", empty).alias(name))


def _correlated(df: DataFrame, foreign: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """What the pipeline finds depends on the values of `let` alone, so it is run once for each distinct combination
    of them, and rows get the result of theirs.

    Leading matches become the join's condition, equalities its keys; what follows runs on the joined rows, or, if it
    needs all matches of a combination, inside its group. Without an equality among the leading matches each
    combination meets each foreign row; without `let` the pipeline runs once.
    """
    name, scope = spec["as"], scope_of(df, ctx)
    let = {k: compile_expression(v, scope) for k, v in spec.get("let", {}).items()}
    held = {k: f"__let_{k}" for k in let}
    left = df.select("*", *[c.alias(held[k]) for k, c in let.items()])
    kept = [c for c in df.columns if c != name]
    combinations = left.select(*held.values()).distinct() if let else df.sparkSession.range(1).select()
    names = {c: f"__f_{c}" for c in foreign.columns}
    right = foreign.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()])
    variables = {k: (F.col(held[k]), left.schema[held[k]].dataType) for k in let}
    inside = T.StructType([T.StructField(c, foreign.schema[c].dataType) for c in foreign.columns])
    seen = combinations.join(right, F.lit(True))  # for types only; it is never run

    class Renamed(Scope):
        def read(self, path: str) -> Column:
            if lookup_type(self.schema, path) is None:
                return F.lit(None)
            head, *rest = path.split(".")
            col = F.col(quoted(names[head]))
            for p in rest:
                col = col.getField(p)
            return col

        def document(self) -> Column:
            return F.struct(*[F.col(quoted(n)).alias(c) for c, n in names.items()])

    own = Renamed(seen, inside, None, variables, ctx.functions)
    stages, condition = list(spec["pipeline"]), None
    while stages and "$match" in stages[0]:
        part = compile_match(stages.pop(0)["$match"], own)
        condition = part if condition is None else condition & part
    joined = combinations.join(right, F.lit(True) if condition is None else condition)
    rows = joined.select(*held.values(), F.struct(*[F.col(quoted(n)).alias(c) for c, n in names.items()]).alias("__doc"))
    rows = _inner_stages(rows, stages, held, variables, ctx)
    mine = F.lit(True)
    for i, c in enumerate(held.values()):
        rows = rows.withColumnRenamed(c, f"__r{i}")
        mine = mine & F.col(c).eqNullSafe(F.col(f"__r{i}"))
    if spec.get("unwind"):
        return left.join(rows, mine).select(*[F.col(quoted(c)) for c in kept], F.col("__doc").alias(name))
    keys = [f"__r{i}" for i in range(len(held))]
    found = rows.groupBy(*keys).agg(F.collect_list("__doc").alias("__docs"))
    if not keys:
        # One row, with an empty array, for all rows of the input: an inner join must drop them.
        found = found.where(F.size("__docs") > 0)
    empty = F.array().cast(T.ArrayType(rows.schema["__doc"].dataType))
    out = left.join(found, mine, "inner" if spec.get("inner") else "left")
    return out.select(*[F.col(quoted(c)) for c in kept], F.coalesce("__docs", empty).alias(name))


#: Stages that look at one document at a time.
_SINGLE = {
    "$project": fields.project,
    "$addFields": fields.add_fields,
    "$set": fields.add_fields,
    "$unset": fields.unset,
    "$replaceWith": fields.replace_with,
    "$replaceRoot": fields.replace_root,
    "$unwind": fields.unwind,
    "$redact": fields.redact,
}


def _inner_stages(rows: DataFrame, stages: list[dict], held: dict[str, str], variables: dict, ctx: Context) -> DataFrame:
    """Stages on the matches (__doc) of each combination of variables; sort, skip, limit, group and count are within
    a combination."""
    order: list[Column] = []
    carried = list(held.values())
    for stage in stages:
        (op, arg), = stage.items()
        kind = rows.schema["__doc"].dataType
        scope = Scope(rows, kind, F.col("__doc"), variables, ctx.functions)
        if op == "$sort":
            order = [F.col(f"__doc.{quoted(k)}").asc() if v > 0 else F.col(f"__doc.{quoted(k)}").desc() for k, v in arg.items()]
        elif op in ("$limit", "$skip"):
            w = Window.partitionBy(*carried).orderBy(*(order or [F.lit(1)]))
            ranked = rows.withColumn("__rank", F.row_number().over(w))
            rows = ranked.where(F.col("__rank") <= arg if op == "$limit" else F.col("__rank") > arg).drop("__rank")
        elif op == "$match":
            rows = rows.where(compile_match(arg, scope))
        elif op in _SINGLE:
            # The variables travel as one field that the stage doesn't touch, under the key's name.
            inner = _SINGLE[op](rows.select(F.struct(*carried, F.lit(0).alias("__z")).alias(KEY), "__doc.*"), arg, replace(ctx))
            kept = [c for c in inner.columns if c != KEY]
            rows = inner.select(*[F.col(f"{KEY}.{quoted(c)}").alias(c) for c in carried], F.struct(*[F.col(quoted(c)) for c in kept]).alias("__doc"))
        elif op in ("$group", "$bucket", "$count"):
            rows = _grouped(rows, op, arg, carried, scope, order, ctx)
            order = []
        else:
            raise ValueError(f"{op} can't be used inside $lookup")
    return rows


def _grouped(rows: DataFrame, op: str, arg: Json, carried: list[str], scope: Scope, order: list[Column], ctx: Context) -> DataFrame:
    """Groups within each combination of variables. $first, $last and $push follow a $sort by one field before them."""
    if op == "$count":
        must(isinstance(arg, str) and bool(arg), "$count takes a field")
        arg = {"_id": None, arg: {"$sum": 1}}
    if op == "$bucket":
        arg = grouping.bucket_spec(arg)
    ident, own = grouping.parts(arg, scope, ctx)
    if isinstance(rows.select(ident.alias("i")).schema["i"].dataType, T.ArrayType):
        return rows.select(*carried, F.struct(ident.alias("_id"), *[F.lit(None).alias(n) for n in own]).alias("__doc")).limit(0)
    if order:
        rows = rows.withColumn("__o", F.row_number().over(Window.partitionBy(*carried).orderBy(*order)))
    else:
        rows = rows.withColumn("__o", F.lit(0))
    flat = rows.select(*carried, ident.alias("_id"), F.col("__o").alias(grouping.SEQ), *[c.alias(f"__x{i}") for i, (_, c, _) in enumerate(own.values())])
    aggs = [f(F.col(f"__x{i}"), F.col(grouping.SEQ)).alias(n) for i, (n, (_, _, f)) in enumerate(own.items())]
    keys = flat.groupBy(*carried, "_id")
    out = keys.agg(*aggs) if aggs else flat.select(*carried, "_id").distinct()
    shown = [*own] if op == "$count" else ["_id", *own]
    return out.select(*carried, F.struct(*[F.col(quoted(n)) for n in shown]).alias("__doc"))
