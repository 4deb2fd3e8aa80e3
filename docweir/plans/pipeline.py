"""Pipelines: a JSON array of stages, compiled to one chain of DataFrame operations."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from docweir.functions.expressions import Json
from docweir.operators import fields, flow, grouping, http, joins, scripts, writes
from docweir.plans.context import Context

Stage = Callable[[DataFrame, Json, Context], DataFrame]
log = logging.getLogger("docweir")

STAGES: dict[str, Stage] = {
    "$addFields": fields.add_fields,
    "$backTrace": flow.back_trace,
    "$bucket": grouping.bucket,
    "$count": grouping.count,
    "$deduplicate": writes.deduplicate,
    "$delay": flow.delay,
    "$delete": writes.delete,
    "$group": grouping.group,
    "$http": http.http,
    "$jq": scripts.filters,
    "$jslt": scripts.templates,
    "$lookup": joins.lookup,
    "$match": fields.match,
    "$merge": writes.merge,
    "$out": writes.out,
    "$per": flow.per,
    "$probe": flow.probe,
    "$project": fields.project,
    "$redact": fields.redact,
    "$replaceRoot": fields.replace_root,
    "$replaceWith": fields.replace_with,
    "$send": flow.send,
    "$set": fields.add_fields,
    "$setKey": fields.set_key,
    "$throttle": flow.throttle,
    "$trace": flow.trace,
    "$unset": fields.unset,
    "$unwind": fields.unwind,
}


def create(pipeline: str | list, ctx: Context | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function for DataFrame.transform. Entries that aren't objects are passed over; no stage at all is identity."""
    ctx = ctx or Context()
    spec = json.loads(pipeline) if isinstance(pipeline, str) else pipeline
    steps: list[tuple[str, Stage, Json, bool]] = []
    for entry in spec:
        names = [k for k in entry if k != "_trace"] if isinstance(entry, dict) else []
        if not names:
            continue
        stage = STAGES.get(names[0]) or ctx.stages.get(names[0])
        if stage is None:
            if ctx.strict:
                raise ValueError(f"unknown stage {names[0]}")
            continue
        steps.append((names[0], stage, entry[names[0]], bool(entry.get("_trace")) or ctx.trace))

    def run(df: DataFrame) -> DataFrame:
        for name, stage, arg, traced in steps:
            began = time.time()
            df = stage(df, arg, ctx)
            if traced:
                log.info("%s was planned in %.0f ms", name, 1000 * (time.time() - began))
        return df

    return run


def run(df: DataFrame, pipeline: str | list, ctx: Context | None = None) -> DataFrame:
    return df.transform(create(pipeline, ctx))
