"""Structured Streaming forms of the stateful stages, and the running of whole pipelines by micro-batch.

State lives in Spark's state store. Rows of one micro-batch and key are taken in the order of order_by.
"""

from __future__ import annotations

import datetime
import decimal
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweir.functions.expressions import Json, family
from docweir.functions.paths import quoted
from docweir.operators import fields, grouping
from docweir.operators.fields import must, scope_of
from docweir.plans.context import Context
from docweir.plans.pipeline import create

#: Stages that a streaming DataFrame takes as they are.
STATELESS = frozenset("$addFields $set $match $project $unset $replaceRoot $replaceWith $setKey $unwind $redact $jq $jslt $http $lookup $trace $backTrace $throttle".split())


def _default(v):
    """Dates and decimals in JSON, with their kind."""
    if isinstance(v, decimal.Decimal):
        return {"$decimal": str(v)}
    if isinstance(v, datetime.date):
        return {"$date" if isinstance(v, datetime.datetime) else "$day": v.isoformat()}
    raise TypeError(type(v))


def _hook(v: dict):
    if len(v) == 1:
        (k, x), = v.items()
        if k in ("$decimal", "$date", "$day"):
            return {"$decimal": decimal.Decimal, "$date": datetime.datetime.fromisoformat, "$day": datetime.date.fromisoformat}[k](x)
    return v


def _plain(v):
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if hasattr(v, "tolist"):
        return v.tolist()
    return None if v is None or v is pd.NaT or isinstance(v, float) and v != v else v.item() if hasattr(v, "item") else v


def _next(op: str, old, x):
    """(new state, changed): one accumulator's step."""
    number = isinstance(x, int | float | decimal.Decimal) and not isinstance(x, bool)
    if op in ("$sum", "$count"):
        return ((old or 0) + x, x != 0 or old is None) if number else (old, False)
    if op == "$avg":
        return ({"n": (old or {}).get("n", 0) + 1, "s": (old or {}).get("s", 0) + x}, True) if number else (old, False)
    if op == "$stdDevPop":
        o = old or {"n": 0, "s": 0.0, "q": 0.0}
        return ({"n": o["n"] + 1, "s": o["s"] + x, "q": o["q"] + x * x}, True) if number else (old, False)
    if op in ("$min", "$max"):
        if x is None:
            return old, False
        new = x if old is None else min(old, x) if op == "$min" else max(old, x)
        return new, new != old
    if op == "$last":
        return x, x != old
    if op == "$push":
        return (old or []) + [x], True
    if op == "$addToSet":
        return (old or [], False) if x is None or x in (old or []) else (sorted([*(old or []), x]), True)
    if op == "$mergeObjects":
        new = {**(old or {}), **{k: v for k, v in (x or {}).items() if v is not None}}
        return new, new != (old or {})
    raise ValueError(f"{op} has no streaming form")


def _shown(op: str, state):
    if op == "$avg":
        return None if state is None else state["s"] / state["n"]
    if op == "$stdDevPop":
        return None if state is None else max(0.0, state["q"] / state["n"] - (state["s"] / state["n"]) ** 2) ** 0.5
    return state


def group_changes(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """The changelog of $group over a stream: a row for each change of a group's aggregates, not one for each batch."""
    must(isinstance(spec, dict) and "_id" in spec and bool(ctx.order_by), "a changelog takes an object with _id, and an order")
    scope = scope_of(df, ctx)
    literal = grouping._is_literal(spec["_id"])
    key = F.lit("all") if literal else fields.compile_expression(spec["_id"], scope)
    ops = {n: next(iter(v.items())) for n, v in spec.items() if n not in ("_id", "_collection")}
    cols, kinds = [], []
    for i, (n, (op, arg)) in enumerate(ops.items()):
        col, f = grouping.accumulator(op, arg, scope)
        cols.append(col.alias(f"x{i}"))
        final = df.select(col.alias("x"), F.lit(1).alias("s")).agg(f(F.col("x"), F.col("s")).alias(n))
        kinds.append(final.schema[n])
    rows = df.select(key.alias("_id"), F.col(quoted(ctx.order_by)).alias("seq"), *cols)
    out = T.StructType([T.StructField("seq", rows.schema["seq"].dataType), T.StructField("_id", rows.schema["_id"].dataType), *kinds])
    names, kind_of = list(ops), [op for op, _ in ops.values()]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0], object_hook=_hook) if state.exists else None
        told = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
            values = [_plain(getattr(r, f"x{i}")) for i in range(len(names))]
            before = held or [None] * len(names)
            stepped = [_next(op, o, x) for op, o, x in zip(kind_of, before, values, strict=True)]
            if held is None or any(c for _, c in stepped):
                told.append([r.seq, k[0], *[_shown(op, s) for op, (s, _) in zip(kind_of, stepped, strict=True)]])
            held = [s for s, _ in stepped]
        state.update((json.dumps(held, default=_default),))
        yield pd.DataFrame(told, columns=["seq", "_id", *names])

    grouped = rows.groupBy("_id").applyInPandasWithState(step, out, "state string", "append", GroupStateTimeout.NoTimeout)
    return grouped.withColumn("_id", F.lit(None).cast("string")) if literal else grouped


def group_totals(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """$group over a stream for update or complete mode: a row for each group that a batch changed."""
    return grouping.group(df, spec, replace(ctx, mode="final"))


def deduplicated(df: DataFrame, spec: Json, ctx: Context, time_col: str | None = None) -> DataFrame:
    """The first row of each value; with an event time, values are forgotten after cacheWindow (3000 ms)."""
    rows = df.withColumn("__value", fields.compile_expression(spec["expression"], scope_of(df, ctx)))
    if time_col is None:
        return rows.dropDuplicates(["__value"]).drop("__value")
    window = f"{int(spec.get('cacheWindow', 3000))} milliseconds"
    return rows.withWatermark(time_col, window).dropDuplicatesWithinWatermark(["__value"]).drop("__value")


def batches_of(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """$per over a stream: arrays of `amount` documents as JSON text; with a timeout, smaller ones when it passes."""
    names = [c for c in df.columns if c != "_key"]
    rows = df.select(F.lit(0).alias("k"), F.col(quoted(ctx.order_by)).alias("seq"), F.to_json(F.struct(*names)).alias("doc"))
    n, timeout = int(spec["amount"]), spec.get("timeout")

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        out = []
        if state.hasTimedOut:
            out, held = ([held] if held else []), []
        else:
            for p in [pd.concat(list(parts)).sort_values("seq")]:
                held += p["doc"].tolist()
            out, held = [held[i : i + n] for i in range(0, len(held) - n + 1, n)], held[len(held) // n * n :]
        state.update((json.dumps(held),))
        if timeout and held:
            state.setTimeoutDuration(int(timeout))
        yield pd.DataFrame({spec["as"]: out})

    mode = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return rows.groupBy("k").applyInPandasWithState(step, f"`{spec['as']}` array<string>", "state string", "append", mode)


def delayed(df: DataFrame, spec: Json, ctx: Context, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """$delay over a stream: (documents that pass, (topic, doc) of the others, as JSON text, when they are due).

    Documents wait in Spark's state store under one of `salts` keys, by their own hash, and are told by a batch that
    runs once they are due: timers are of processing time, so that the query must go on running.
    """
    must(isinstance(spec, dict) and "duration" in spec and "topic" in spec, "$delay takes an object with duration and topic")
    scope = scope_of(df, ctx)
    topic, wait = (fields.compile_expression(spec[k], scope) for k in ("topic", "duration"))
    topic = topic if family(scope.type_of(topic)) == "string" else F.lit(None).cast("string")
    wait = wait.cast("long") if family(scope.type_of(wait)) == "number" else F.lit(None).cast("long")
    due = topic.isNotNull() & wait.isNotNull()
    doc = F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns if c != "_key"]))
    rows = df.where(due).select(topic.alias("topic"), wait.alias("ms"), doc.alias("doc")).withColumn("k", F.pmod(F.xxhash64("doc"), F.lit(salts)))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = time.time() * 1000, json.loads(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            for p in parts:
                held += [[now + int(ms), t, d] for t, ms, d in zip(p["topic"], p["ms"], p["doc"], strict=True)]
        told, held = [h for h in held if h[0] <= now], [h for h in held if h[0] > now]
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutDuration(max(1, int(min(h[0] for h in held) - now)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"topic": [h[1] for h in told], "doc": [h[2] for h in told]})

    later = rows.groupBy("k").applyInPandasWithState(step, "topic string, doc string", "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return df.where(~due), later


def probed(df: DataFrame, spec: Json, time_col: str) -> DataFrame:
    """$probe's counts over a stream, by minutes of event time; df needs a watermark on time_col."""
    counts = df.groupBy(F.window(time_col, "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.lit(spec["name"]).alias("name"), F.col("w.start").alias("minute"), "count")


def rate_options(spec: Json, seconds: int = 1) -> tuple[dict[str, str], str]:
    """$throttle: options of a source that counts offsets, and the trigger's interval, that together hold the rate."""
    return {"maxOffsetsPerTrigger": str(int(spec["maxPerSecond"]) * seconds)}, f"{seconds} seconds"


def stateless(df: DataFrame, pipeline: list, ctx: Context | None = None) -> DataFrame:
    """A pipeline of stages without state, on a streaming DataFrame."""
    names = [next(k for k in s if k != "_trace") for s in pipeline]
    must(all(n in STATELESS for n in names), f"these need a micro-batch: {[n for n in names if n not in STATELESS]}")
    return create(pipeline, ctx)(df)


def by_batch(df: DataFrame, pipeline: list, ctx: Context, then: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Any pipeline, once for each micro-batch, in foreachBatch: collections carry the state from batch to batch, that
    of $group, $bucket and $count too, which tell the totals of the groups that a batch changed.

    A batch that Spark runs again is applied again; groups, upserts by _id, deletions and first-of-value stages come to
    the same collection then. $per would end its last array with each batch: batches_of carries the rest over. then
    gets the result and the batch's number.
    """
    names = [k for s in pipeline for k in s if k != "_trace"]
    must("$per" not in names, "$per over a stream is batches_of")
    must(ctx.mode == "final" or not {"$group", "$bucket", "$count"} & set(names), "a changelog over a stream is group_changes")

    def each(batch: DataFrame, number: int) -> None:
        then(create(pipeline, replace(ctx, carry=True, batch=number))(batch), number)

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


__all__ = ["batches_of", "by_batch", "deduplicated", "delayed", "group_changes", "group_totals", "probed", "rate_options", "stateless"]
