"""Stages that write collections: merge, out, delete, deduplicate.

A batch is applied as a set: per id, the rows of a batch are taken in ctx.order_by, the last one wins, and merging
folds their fields. Without ctx.order_by, "last" is the last as the rows are read. The new state of the collection is one join and a rewrite. As an error must leave the collection
as it was, "fail" is tested before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweir.functions.expressions import Json, compile_expression
from docweir.functions.paths import quoted
from docweir.operators.fields import must, scope_of
from docweir.plans.context import KEY, Context
from docweir.shared import staged


class MergeFailed(RuntimeError):
    pass


def _on(spec: dict) -> list[str]:
    on = spec.get("on", "_id")
    return on if isinstance(on, list) else [on]


def _newest(df: DataFrame, on: list[str], ctx: Context, last: bool = True) -> DataFrame:
    """One row for each value of on: the latest, or the first, in order."""
    order = F.col(ctx.order_by) if ctx.order_by else F.monotonically_increasing_id()
    w = Window.partitionBy(*[F.col(quoted(c)) for c in on]).orderBy(order.desc() if last else order.asc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _match(on: list[str], left: str, right: str) -> Column:
    cond = None
    for c in on:
        part = F.col(f"{left}.{quoted(c)}").eqNullSafe(F.col(f"{right}.{quoted(c)}"))
        cond = part if cond is None else cond & part
    return cond


def _folded(df: DataFrame, on: list[str], ctx: Context) -> DataFrame:
    """Rows of one id as merges apply them: each field's last value that isn't null."""
    names = [c for c in df.columns if c not in on]
    seq = F.col(quoted(ctx.order_by)) if ctx.order_by else F.monotonically_increasing_id()
    rows = df.withColumn("__s", seq)
    return rows.groupBy(*[F.col(quoted(c)) for c in on]).agg(*[F.max_by(F.col(quoted(c)), F.when(F.col(quoted(c)).isNotNull(), F.col("__s"))).alias(c) for c in names]).select(*df.columns)


def _merged_state(one: DataFrame, body: DataFrame, stored: DataFrame, name: str, on: list[str], fields: list[str], matched: str, other: str) -> DataFrame:
    """The collection after a merge of one row for each value of on."""
    flag = F.lit(True)
    both = one.withColumn("__new", flag).alias("n").join(stored.withColumn("__old", flag).alias("o"), _match(on, "n", "o"), "full")
    old, new = F.col("o.__old").isNotNull(), F.col("n.__new").isNotNull()
    if matched == "fail" and not both.where(old & new).isEmpty():
        raise MergeFailed(f"a document is in {name} already")
    if other == "fail" and not both.where(new & ~old).isEmpty():
        raise MergeFailed(f"a document isn't in {name}")

    def value(c: str, side: str) -> Column:
        frame = body if side == "n" else stored
        if c in frame.columns:
            return F.col(f"{side}.{quoted(c)}")
        kind = (stored if side == "n" else body).schema[c].dataType
        return F.lit(None).cast(kind)

    cols = []
    for c in fields:
        n, o = value(c, "n"), value(c, "o")
        if c == "_id":
            cols.append(F.when(old, o).otherwise(F.col("n.__key").cast(stored.schema["_id"].dataType)).alias("_id"))
            continue
        then = {"merge": F.coalesce(n, o), "replace": n, "keepExisting": o, "fail": o}[matched]
        cols.append(F.when(old & new, then).when(old, o).otherwise(n).alias(c))
    return (both.where(old) if other == "discard" else both).select(*cols)


def merge(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """whenMatched: merge, replace, keepExisting, fail; whenNotMatched: insert, discard, fail.

    Tells, for each incoming row, the document as stored, but with the incoming _id, which is also the key. Incoming
    rows must have the fields of on.
    """
    must(isinstance(spec, dict) and "into" in spec, "$merge takes an object with into")
    on, matched, other = _on(spec), spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert")
    must(matched in ("merge", "replace", "keepExisting", "fail"), f"whenMatched can't be {matched}")
    must(other in ("insert", "discard", "fail"), f"whenNotMatched can't be {other}")
    must(all(c in df.columns for c in on), "$merge needs the fields of on")
    store, name = ctx.collections(), spec["into"]
    body = df.drop(KEY)
    ident = compile_expression(spec.get("key", "$_id"), scope_of(df, ctx)) if "_id" in df.columns or "key" in spec else None
    incoming = body.withColumn("__key", ident if ident is not None else F.expr("uuid()"))
    one = _folded(incoming, on, ctx) if matched == "merge" else _newest(incoming, on, ctx)
    fields: list[str] = []

    def change() -> DataFrame:
        stored = store.read(name, T.StructType([f for f in body.schema.fields]))
        must(all(c in stored.columns for c in on), f"{name} lacks fields of on")
        fields[:] = dict.fromkeys([*stored.columns, *body.columns])
        return _merged_state(one, body, stored, name, on, fields, matched, other)

    store.update(name, change)
    written = store.read(name)
    # The echo: incoming rows meet what is stored now; keys of inserted rows may be other than their _id.
    echo = df.alias("n").join(written.alias("o"), _match(on, "n", "o") if "_id" not in on or "key" not in spec else F.col("o._id").eqNullSafe(F.col("n._id")))
    out = [F.col("n._id").alias("_id") if c == "_id" and "_id" in body.columns else F.col(f"o.{quoted(c)}").alias(c) for c in fields]
    told = echo.select(*out)
    return told.withColumn(KEY, F.col("_id").cast("string")) if KEY in df.columns and "_id" in fields else told


def out(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """An upsert by _id that replaces: the collection isn't emptied first."""
    must(isinstance(spec, str), "$out takes the name of a collection")
    return merge(df, {"into": spec, "whenMatched": "replace", "whenNotMatched": "insert"}, ctx)


def delete(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """Deletes all that match in on; rows that lack one of its fields (or have null there) are dropped, others pass."""
    must(isinstance(spec, dict) and "from" in spec and bool(spec.get("on")), "$delete takes an object with from and on")
    on = _on(spec)
    if not all(c in df.columns for c in on):
        return df.limit(0)
    has = None
    for c in on:
        has = F.col(quoted(c)).isNotNull() if has is None else has & F.col(quoted(c)).isNotNull()
    own, store = df.where(has), ctx.collections()
    keys = own.select(*[F.col(quoted(c)) for c in on]).distinct()

    def change() -> DataFrame | None:
        if not store.exists(spec["from"]):
            return None
        return store.read(spec["from"]).alias("o").join(keys.alias("n"), _match(on, "n", "o"), "left_anti")

    store.update(spec["from"], change)
    return own


def deduplicate(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """The first row of each value of expression, in order, unless the collection has that value; it then gets it.

    cacheWindow (ms, 3000 if absent) bounds what a stream remembers beside the collection; a batch needs none.
    """
    must(isinstance(spec, dict) and "collection" in spec and "expression" in spec, "$deduplicate takes an object with expression and collection")
    store, name = ctx.collections(), spec["collection"]
    rows = df.withColumn("__value", compile_expression(spec["expression"], scope_of(df, ctx)))
    first = _newest(rows, ["__value"], ctx, last=False)
    settled: list[DataFrame] = []

    def change() -> DataFrame:
        passed, values = first, None
        if store.exists(name):
            known = store.read(name)
            passed = first.join(known.select(F.col("value").alias("__known")), F.col("__value").eqNullSafe(F.col("__known")), "left_anti")
            values = known.select("value", "_timestamp")
        # What passes is settled before the collection changes.
        settled[:] = [staged(passed, "passed")]
        new = settled[0].select(F.col("__value").alias("value"), F.current_timestamp().alias("_timestamp"))
        return new if values is None else values.unionByName(new)

    store.update(name, change)
    return settled[0].drop("__value")
