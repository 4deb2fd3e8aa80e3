"""Stages on the flow of documents: per, probe, send, delay, throttle, trace, backTrace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweir.functions.expressions import Json, compile_expression, family
from docweir.functions.paths import quoted
from docweir.operators.fields import must, scope_of
from docweir.plans.context import KEY, Context
from docweir.shared import staged


def per(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """Batches of `amount` documents in order, the last one possibly smaller, as arrays in the field `as`.

    Positions come from sorted partitions and the counts of those before them, so that no task sorts the whole input.
    Without ctx.order_by the order is that in which the rows are read. A timeout can't end batches of a finite input
    early; streams have it (docweir.streaming).
    """
    must(isinstance(spec, dict) and "amount" in spec and "as" in spec, "$per takes an object with amount and as")
    n = int(spec["amount"])
    must(n > 0, "$per needs a positive amount")
    names = [c for c in df.columns if c != KEY]
    doc = F.struct(*[F.col(quoted(c)) for c in names])
    order = [F.col(quoted(ctx.order_by)).alias("__s")] if ctx.order_by else []
    rows = numbered(df.select(doc.alias("__doc"), *order), "__s" if order else None)
    groups = rows.groupBy(F.floor(F.col("__at") / n).alias("__g")).agg(F.array_sort(F.collect_list(F.struct(F.col("__at").alias("a"), F.col("__doc").alias("d")))).alias("__docs"))
    out = groups.select(F.transform("__docs", lambda e: e["d"]).alias(spec["as"]), "__g")
    return (out.withColumn(KEY, F.expr("uuid()")) if KEY in df.columns else out).drop("__g")


def numbered(rows: DataFrame, by: str | None) -> DataFrame:
    """rows with __at: each row's place, from 0, in the order of a column, or as they are read.

    A row id names its partition and its place there. It is written with its row: planned anew for each reader, rows
    may lie in other partitions.
    """
    spread = rows.repartitionByRange(F.col(by)).sortWithinPartitions(by) if by else rows
    fixed = staged(spread.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__row", 33), F.col("__row").bitwiseAND((1 << 33) - 1)
    counts = fixed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    # One row for each partition.
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__base"))
    return fixed.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn("__at", place + F.col("__base")).drop("__p", "__row", "__base")


def probe(df: DataFrame, spec: Json, ctx: Context, time_col: str = "ts") -> DataFrame:
    """Tells {name, minute, count} for each minute of event time to a topic; documents pass."""
    must(isinstance(spec, dict) and "name" in spec and "topic" in spec, "$probe takes an object with name and topic")
    col = spec.get("time", time_col)
    minute = F.date_trunc("minute", F.col(quoted(col))).cast(df.schema[col].dataType) if col in df.columns else F.date_trunc("minute", F.current_timestamp())
    counts = df.groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("count"))
    ctx.aside("probe", spec["topic"], counts.select(F.lit(spec["name"]).alias("name"), "minute", "count"))
    return df


def _routed(df: DataFrame, topic: Json, ctx: Context) -> DataFrame:
    scope = scope_of(df, ctx)
    c = compile_expression(topic, scope)
    return df.withColumn("__topic", c if family(scope.type_of(c)) == "string" else F.lit(None).cast("string"))


def send(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """Documents whose topic is a string go to that topic, all others pass."""
    must(isinstance(spec, dict) and "topic" in spec, "$send takes an object with topic")
    rows = _routed(df, spec["topic"], ctx)
    ctx.aside("send", "topic", rows.where("__topic is not null").withColumnRenamed("__topic", "topic"))
    return rows.where("__topic is null").drop("__topic")


def delay(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """Documents with a number of milliseconds and a topic are due there later; all others pass."""
    must(isinstance(spec, dict) and "duration" in spec and "topic" in spec, "$delay takes an object with duration and topic")
    rows = _routed(df, spec["topic"], ctx)
    scope = scope_of(df, ctx)
    wait = compile_expression(spec["duration"], scope)
    number = family(scope.type_of(wait)) == "number"
    rows = rows.withColumn("__ms", wait.cast("long") if number else F.lit(None).cast("long"))
    start = F.col(quoted(spec["time"])) if spec.get("time") in df.columns else F.current_timestamp()
    due = rows.where("__topic is not null and __ms is not null").withColumn("due_at", start + F.make_dt_interval(secs=F.col("__ms") / 1000))
    ctx.aside("delay", "topic", due.withColumnRenamed("__topic", "topic").drop("__ms"))
    return rows.where("__topic is null or __ms is null").drop("__topic", "__ms")


def throttle(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """A batch has no rate. In a stream the source and the trigger hold it: see docweir.streaming.rate_options."""
    must(isinstance(spec, dict) and isinstance(spec.get("maxPerSecond"), int), "$throttle takes an object with an integer maxPerSecond")
    return df


def trace(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """Counts rows, and those for which the expression isn't null, as the query runs; the figures are metrics of the
    observation, logged at its end, not a line for each document."""
    scope = scope_of(df, ctx)
    what = compile_expression(spec, scope) if spec is not None else F.lit(1)
    return df.observe("trace", F.count(F.lit(1)).alias("rows"), F.count(what).alias("values"))


def back_trace(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """Spark has no demand to log: the rows that were asked for are the rows that were read."""
    must(spec is None or isinstance(spec, dict), "$backTrace takes an object")
    return df.observe((spec or {}).get("name", "backTrace"), F.count(F.lit(1)).alias("rows"))

