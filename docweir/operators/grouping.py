"""Grouping stages: final aggregates, or the log of every change of a group's aggregates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweir.functions.expressions import RANK, Json, Scope, compile_expression, family
from docweir.functions.paths import quoted
from docweir.operators.fields import must, scope_of
from docweir.plans.context import KEY, Context
from docweir.shared import staged

SEQ = "__seq"


@dataclass(frozen=True)
class Accumulator:
    """whole(x, seq) is the aggregate; state(x, seq, all) is what must change for a change to be told."""

    whole: Callable[[Column, Column], Column]
    state: Callable[[Column, Column], Column] | None = None


def _numbers(scope: Scope, c: Column) -> Column:
    """Numbers count, all else is ignored."""
    return c if family(scope.type_of(c)) == "number" else F.lit(None).cast("double")


def _pushed(x: Column, seq: Column) -> Column:
    # Nulls are kept, in order of arrival.
    return F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("s"), x.alias("x")))), lambda e: e["x"])


def _merged(scope: Scope, c: Column) -> Callable[[Column, Column], Column]:
    kind = scope.type_of(c)
    if isinstance(kind, T.MapType):
        empty = F.create_map().cast(kind)
        fold = lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.array_contains(F.map_keys(m), k)), m)
        return lambda x, seq: F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("s"), F.coalesce(x, empty).alias("x")))), lambda e: e["x"]), empty, fold)
    must(isinstance(kind, T.StructType), "$mergeObjects takes objects")
    later = lambda x, seq, n: F.max_by(x.getField(n), F.when(x.getField(n).isNotNull(), seq)).alias(n)
    return lambda x, seq: F.struct(*[later(x, seq, n) for n in kind.fieldNames()])


def accumulator(op: str, arg: Json, scope: Scope, strict_nulls: bool = False) -> tuple[Column, Callable[[Column, Column], Column]] | None:
    """(the argument's column, its aggregate); None for an unknown accumulator."""
    if op == "$count":
        must(arg == {}, "$count takes an empty object")
        return F.lit(1), lambda x, seq: F.count(x)
    if op not in _OPS:
        return None
    col = compile_expression(arg, scope)
    if op in ("$sum", "$avg", "$stdDevPop", "$stdDevSamp"):
        col = _numbers(scope, col)
    if op == "$mergeObjects":
        return col, _merged(scope, col)
    if op in ("$min", "$max") and strict_nulls:
        f = _OPS[op]
        lowest = (lambda x, seq: F.when(F.bool_or(x.isNull()), F.lit(None)).otherwise(f(x, seq))) if op == "$min" else f
        return col, lowest
    return col, _OPS[op]


_OPS: dict[str, Callable[[Column, Column], Column] | None] = {
    "$sum": lambda x, seq: F.sum(x),
    "$avg": lambda x, seq: F.avg(x),
    "$min": lambda x, seq: F.min(x),
    "$max": lambda x, seq: F.max(x),
    "$last": lambda x, seq: F.max_by(x, seq),
    "$first": lambda x, seq: F.min_by(x, seq),
    "$push": _pushed,
    "$addToSet": lambda x, seq: F.sort_array(F.collect_set(x)),
    "$stdDevPop": lambda x, seq: F.stddev_pop(x),
    "$stdDevSamp": lambda x, seq: F.stddev_samp(x),
    "$mergeObjects": None,
}
_ORDERED = {"$last", "$first", "$push", "$mergeObjects"}


def _is_literal(v: Json) -> bool:
    return v is None or isinstance(v, bool | int | float) or isinstance(v, str) and not v.startswith("$")


def parts(spec: dict, scope: Scope, ctx: Context) -> tuple[Column, dict[str, tuple[str, Column, Callable]]]:
    """The id of a $group and, by field, its accumulators: (operator, argument, aggregate)."""
    ident = spec["_id"]
    key = F.lit(None).cast("string") if _is_literal(ident) else compile_expression(ident, scope)
    own: dict[str, tuple[str, Column, Callable]] = {}
    for name, v in spec.items():
        if name in ("_id", "_collection"):
            continue
        known = isinstance(v, dict) and len(v) == 1 and accumulator(*next(iter(v.items())), scope, ctx.strict_nulls)
        if not known:
            must(not ctx.strict, f"unknown accumulator {name}: {v}")
            continue
        own[name] = (next(iter(v)), *known)
    return key, own


def group(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """_id is a literal (one group, _id null), an expression, or an object of expressions; the rest are accumulators.

    Without accumulators the result is the distinct ids. With ctx.carry see _carried. A changelog needs ctx.order_by: each row's aggregates are
    those of the rows so far, and a row is told only if they are other than before.
    """
    must(isinstance(spec, dict) and "_id" in spec, "$group takes an object with _id")
    scope = scope_of(df, ctx)
    ident = spec["_id"]
    key, own = parts(spec, scope, ctx)
    # An id that is an array updates its group, which is never told.
    if not _is_literal(ident) and isinstance(scope.type_of(key), T.ArrayType):
        return df.select(key.alias("_id")).limit(0)
    if ctx.carry:
        must(ctx.mode == "final", "a changelog over a stream is docweir.streaming.stateful.group_changes")
        return _carried(df, spec, key, own, ctx)
    if ctx.mode == "changelog" and ctx.order_by:
        return _changelog(df, key, _is_literal(ident), own, ctx)
    needs = any(op in _ORDERED for op, _, _ in own.values())
    seq = F.col(ctx.order_by) if ctx.order_by else F.monotonically_increasing_id()
    rows = df.select(key.alias("_id"), *[seq.alias(SEQ)] * needs, *[c.alias(f"__x{i}") for i, (_, c, _) in enumerate(own.values())])
    aggs = [f(F.col(f"__x{i}"), F.col(SEQ)).alias(n) for i, (n, (_, _, f)) in enumerate(own.items())]
    if _is_literal(ident):
        if not aggs:
            return rows.select("_id").limit(1)
        # No input, no group.
        out = rows.agg(F.count(F.lit(1)).alias("__n"), *aggs).where("__n > 0").drop("__n").select(F.lit(None).cast("string").alias("_id"), *own)
    else:
        out = rows.groupBy("_id").agg(*aggs) if aggs else rows.select("_id").distinct()
    return out.withColumn(KEY, F.col("_id").cast("string")) if KEY in df.columns else out


def state_name(spec: dict, ctx: Context) -> str:
    """The collection of a stage's state: equal stages of one app share it."""
    return spec.get("_collection") or f"{ctx.app}-{hashlib.md5(json.dumps(spec, sort_keys=True).encode()).hexdigest()}"


def _first_state(op: str, x: Column, seq: Column) -> dict[str, Column]:
    """The columns of an accumulator's state over some rows."""
    if op in ("$avg", "$stdDevPop", "$stdDevSamp"):
        n = F.count(x)
        return {"n": n, "mean": F.avg(x.cast("double")), "m2": F.coalesce(F.var_pop(x.cast("double")), F.lit(0.0)) * n}
    if op in ("$last", "$first"):
        return {"x": _OPS[op](x, seq)}
    if op in ("$min", "$max"):
        return {"x": _OPS[op](x, seq), "null": F.bool_or(x.isNull())}
    return {}


def _next_state(op: str, old: dict[str, Column], turn: Column) -> dict[str, Column]:
    """The columns of the state of what came before (turn 0) and since (turn 1)."""
    x = old.get("x")
    if op in ("$avg", "$stdDevPop", "$stdDevSamp"):
        n, part = F.sum(old["n"]), F.sum(old["n"] * old["mean"])
        spread = F.sum(old["m2"]) + F.sum(old["n"] * old["mean"] * old["mean"]) - part * part / n
        return {"n": n, "mean": part / n, "m2": F.when(n > 0, F.greatest(spread, F.lit(0.0))).otherwise(0.0)}
    if op in ("$sum", "$count"):
        return {"x": F.sum(x)}
    if op in ("$min", "$max"):
        return {"x": _OPS[op](x, turn), "null": F.bool_or(old["null"])}
    if op in ("$last", "$first"):
        return {"x": _OPS[op](x, turn)}
    parts = F.transform(F.array_sort(F.collect_list(F.struct(turn.alias("t"), x.alias("x")))), lambda e: e["x"])
    if op == "$push":
        return {"x": F.flatten(parts)}
    return {"x": F.array_sort(F.array_distinct(F.flatten(parts)))}


def _shown(op: str, state: dict[str, Column], strict_nulls: bool) -> Column:
    if op == "$avg":
        return F.when(state["n"] > 0, state["mean"])
    if op == "$stdDevPop":
        return F.when(state["n"] > 0, F.sqrt(state["m2"] / state["n"]))
    if op == "$stdDevSamp":
        return F.when(state["n"] > 1, F.sqrt(state["m2"] / (state["n"] - 1)))
    if op == "$min" and strict_nulls:
        return F.when(~state["null"], state["x"])
    return state["x"]


def _carried(df: DataFrame, spec: dict, key: Column, own: dict, ctx: Context) -> DataFrame:
    """Groups of this input, with all that the collection remembers of them; the collection then remembers this input.

    Of a numbered micro-batch the state goes from one of two collections to the other, by turns: a batch that Spark
    runs again starts from the state that it started from before. Averages and deviations are doubles.
    """
    store, name = ctx.collections(), state_name(spec, ctx)
    before, after = (name, name) if ctx.batch is None else (f"{name}.{(ctx.batch + 1) % 2}", f"{name}.{ctx.batch % 2}")
    seq = F.col(quoted(ctx.order_by)) if ctx.order_by else F.monotonically_increasing_id()
    rows = df.select(key.alias("_id"), seq.alias(SEQ), *[c.alias(f"__x{i}") for i, (_, c, _) in enumerate(own.values())])
    columns: list[Column] = []
    for i, (op, _, whole) in enumerate(own.values()):
        x = F.col(f"__x{i}")
        kind = _first_state(op, x, F.col(SEQ)) or {"x": whole(x, F.col(SEQ))}
        columns += [c.alias(f"s{i}_{k}") for k, c in kind.items()]
    new = rows.groupBy("_id").agg(*columns) if columns else rows.select("_id").distinct()
    new = staged(new.withColumn("_turn", F.lit(1)), "group")

    def change() -> DataFrame:
        both = new
        if store.exists(before):
            both = store.read(before).drop("_timestamp").withColumn("_turn", F.lit(0)).unionByName(new)
        merged: list[Column] = []
        for i, (op, _, whole) in enumerate(own.values()):
            state = {c.removeprefix(f"s{i}_"): F.col(c) for c in both.columns if c.startswith(f"s{i}_")}
            if op == "$mergeObjects":
                merged.append(whole(state["x"], F.col("_turn")).alias(f"s{i}_x"))
            else:
                merged += [c.alias(f"s{i}_{k}") for k, c in _next_state(op, state, F.col("_turn")).items()]
        return both.groupBy("_id").agg(F.max("_turn").cast("boolean").alias("_changed"), *merged).withColumn("_timestamp", F.current_timestamp())

    kept: list[DataFrame] = []

    def settled() -> DataFrame:
        kept[:] = [staged(change(), "state")]
        return kept[0].drop("_changed")

    store.update(after, settled)
    state = kept[0].where("_changed")
    shown = []
    for i, (n, (op, _, _)) in enumerate(own.items()):
        shown.append(_shown(op, {c.removeprefix(f"s{i}_"): F.col(c) for c in state.columns if c.startswith(f"s{i}_")}, ctx.strict_nulls).alias(n))
    out = state.select("_id", *shown)
    return out.withColumn(KEY, F.col("_id").cast("string")) if KEY in df.columns else out


def _changelog(df: DataFrame, key: Column, single: bool, own: dict, ctx: Context) -> DataFrame:
    """Running frames, one window for all aggregates; a group's rows are sorted, spilling if they must."""
    rows = df.select(key.alias("_id"), F.col(ctx.order_by).alias(SEQ), *[c.alias(f"__x{i}") for i, (_, c, _) in enumerate(own.values())])
    w = Window.partitionBy(*[] if single else ["_id"]).orderBy(SEQ)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols, states = [], []
    for i, (n, (op, _, f)) in enumerate(own.items()):
        x = F.col(f"__x{i}")
        if op == "$last":
            value = x
        elif op == "$push":
            value = F.transform(F.collect_list(F.struct(x.alias("x"))).over(upto), lambda e: e["x"])
        elif op == "$addToSet":
            value = F.sort_array(F.collect_set(x).over(upto))
        elif op == "$mergeObjects":
            value = F.struct(*[F.last(x.getField(k), ignorenulls=True).over(upto).alias(k) for k in df.select(x_of(own, i)).schema[0].dataType.fieldNames()])
        elif op == "$first":
            value = F.first(x).over(upto)
        else:
            value = f(x, F.col(SEQ)).over(upto)
        cols.append(value.alias(n))
        # Averages and deviations change with every number, even if their value doesn't.
        if op in ("$avg", "$stdDevPop", "$stdDevSamp"):
            states.append(F.count(x).over(upto))
        elif op == "$push":
            states.append(F.row_number().over(w))
        else:
            states.append(F.col(n))
    out = rows.select("*", *cols)
    state = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(states)]) if states else F.lit(0)
    out = out.withColumn("__state", state)
    out = out.withColumn("__before", F.lag("__state").over(w)).withColumn("__n", F.row_number().over(w))
    told = (F.col("__n") == 1) | ~F.col("__state").eqNullSafe(F.col("__before"))
    return out.where(told).select(F.col(SEQ).alias(ctx.order_by), "_id", *own)


def x_of(own: dict, i: int) -> Column:
    return list(own.values())[i][1]


def bucket(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """A group for each interval [lower, upper) of the boundaries, named by its lower end, and one for the rest."""
    return group(df, bucket_spec(spec), ctx)


def bucket_spec(spec: Json) -> dict:
    """The $group that a $bucket stands for."""
    must(isinstance(spec, dict), "$bucket takes an object")
    bounds = spec.get("boundaries") or []
    rank = [(RANK[{bool: "boolean", int: "number", float: "number", str: "string"}.get(type(b), "object")], b) for b in bounds]
    must(len(bounds) >= 2 and all(a < b for a, b in zip(rank, rank[1:], strict=False)), "$bucket needs two or more ascending boundaries")
    must("groupBy" in spec and "output" in spec, "$bucket needs groupBy and output")
    branches = [{"case": {"$and": [{"$gte": [spec["groupBy"], lo]}, {"$lt": [spec["groupBy"], hi]}]}, "then": lo} for lo, hi in zip(bounds, bounds[1:], strict=False)]
    ident: dict = {"branches": branches}
    if "default" in spec:
        mixed = type(spec["default"]) is not type(bounds[0]) and not isinstance(spec["default"], int | float)
        if mixed:
            branches = [{**b, "then": str(b["then"])} for b in branches]
        ident = {"branches": branches, "default": str(spec["default"]) if mixed else spec["default"]}
    return {"_id": {"$switch": ident}, **spec["output"]}


def count(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    must(isinstance(spec, str) and bool(spec), "$count takes a field")
    return group(df, {"_id": None, spec: {"$sum": 1}}, ctx).drop("_id")
