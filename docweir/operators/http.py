"""Enrichment over HTTP: requests are made from partitions by Arrow batches, answers come back as JSON text."""

from __future__ import annotations

import json
import os
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweir.functions.expressions import Json, compile_expression, family
from docweir.operators.fields import must, scope_of
from docweir.plans.context import Context

Answer = tuple[int, dict[str, str], bytes]
Transport = Callable[[str, str, list[tuple[str, str]], bytes | None], Answer]

# Content types besides text/* that are text.
_TEXT = ("application/rtf", "application/x-www-form-urlencoded", "application/xhtml+xml", "image/svg+xml")


def over_network(method: str, url: str, headers: list[tuple[str, str]], body: bytes | None, context: ssl.SSLContext | None = None) -> Answer:
    request = urllib.request.Request(url, data=body, method=method)
    for k, v in headers:
        request.add_header(k, v)
    try:
        with urllib.request.urlopen(request, timeout=60, context=context) as r:
            return r.status, dict(r.headers.items()), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers.items()), e.read()


@lru_cache(16)
def _certificate(store: str, password: str | None, changed: float) -> ssl.SSLContext:
    context = ssl.create_default_context()
    context.load_cert_chain(store, password=password)
    return context


def with_certificate(spec: dict) -> Transport:
    """Requests with a client certificate: keyStore is a PEM file with its key, on every executor, read again when it
    has changed; password is the key's."""
    store, password = spec["keyStore"], spec.get("password")
    return lambda *request: over_network(*request, _certificate(store, password, os.path.getmtime(store)))


def _content_type(headers: dict[str, str]) -> str:
    return next((v for k, v in headers.items() if k.lower() == "content-type"), "").split(";")[0].strip().lower()


def _is_json(kind: str) -> bool:
    return kind == "application/json" or kind.endswith("+json")


def read_answer(answer: Answer) -> tuple[int, str, list[str]]:
    """(status, kind, values as JSON): of JSON only objects are kept, text is joined line by line, other bodies are none."""
    status, headers, body = answer
    kind = _content_type(headers)
    if _is_json(kind):
        try:
            value = json.loads(body) if body else []
        except ValueError:
            return status, "other", []
        own = [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]
        return status, "json", [json.dumps(v, separators=(",", ":")) for v in own]
    if kind.startswith("text/") or kind in _TEXT:
        return status, "text", [json.dumps("".join(body.decode(errors="replace").splitlines()))]
    return status, "other", []


def call(transport: Transport, method: str | None, url: str | None, headers: str | None, body: str | None, body_kind: str, retries: int, wait: float) -> tuple[int, str, list[str]]:
    if not method or not url or "://" not in url:
        return 400, "other", []
    own = []
    for k, v in (json.loads(headers) if headers else {}).items():
        own += [(k, str(x)) for x in (v if isinstance(v, list) else [v]) if x is not None]
    if body is not None and not any(k == "Content-Type" for k, _ in own):
        own.append(("Content-Type", "text/plain" if body_kind == "text" else "application/json"))
    for attempt in range(retries + 1):
        try:
            return read_answer(transport(method, url, own, None if body is None else body.encode()))
        except OSError:
            if attempt == retries:
                raise
            time.sleep(wait)
    raise AssertionError


def _text(df: DataFrame, c: Column | None) -> tuple[Column, str]:
    if c is None:
        return F.lit(None).cast("string"), "none"
    kind = df.select(c).schema[0].dataType
    if isinstance(kind, T.StructType | T.ArrayType | T.MapType | T.VariantType):
        return F.to_json(c), "json"
    return c.cast("string"), "text"


def http(df: DataFrame, spec: Json, ctx: Context) -> DataFrame:
    """method, url, headers, body are expressions; as gets the answer, as a variant, or typed by `schema` (DDL).

    One JSON object is told as itself, others as an array; with unwind each is a row. A status of 300 or more, and a
    bad request, give httpError {statusCode, body}. ctx.transport replaces the network; failures of connections are
    retried `retries` times (3), then fail the task, which Spark retries. A task has `concurrency` requests (8) under
    way at a time, and answers in the order of its rows. sslContext {keyStore, password}: see with_certificate.
    """
    must(isinstance(spec, dict) and "method" in spec and "url" in spec, "$http takes an object with method and url")
    must("as" in spec or not spec.get("unwind"), "$http unwinds the field as")
    context = spec.get("sslContext")
    must(context is None or isinstance(context, dict) and "keyStore" in context, "sslContext takes an object with keyStore")
    scope, transport = scope_of(df, ctx), ctx.transport or (with_certificate(context) if context else over_network)
    concurrency = int(spec.get("concurrency", 8))
    must(concurrency > 0, "concurrency is positive")
    retries, wait = int(spec.get("retries", 3)), float(spec.get("retryWait", 5.0))
    part = lambda k: compile_expression(spec[k], scope) if k in spec else None
    body, body_kind = _text(df, part("body"))
    method = compile_expression(spec["method"], scope)
    if family(scope.type_of(method)) != "string":
        method = F.lit(None).cast("string")
    request = [method.alias("__method"), part("url").cast("string").alias("__url"), _text(df, part("headers"))[0].alias("__headers"), body.alias("__body")]
    rows = df.select("*", *request)
    added = T.StructType([T.StructField("__status", T.IntegerType()), T.StructField("__kind", T.StringType()), T.StructField("__values", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                asked = zip(*(b.column(n).to_pylist() for n in ("__method", "__url", "__headers", "__body")), strict=True)
                got = list(pool.map(lambda a: call(transport, *a, body_kind, retries, wait), asked))
                columns = [*b.columns, pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "__status", "__kind", "__values"])

    told = rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))
    value = (lambda c: F.from_json(c, spec["schema"])) if "schema" in spec else F.try_parse_json
    good = F.col("__status") < 300
    first = F.try_element_at("__values", F.lit(1))
    joined = F.concat(F.lit("["), F.array_join("__values", ","), F.lit("]"))
    one = F.when((F.size("__values") == 1) | (F.col("__kind") == "text"), first).when(F.col("__kind") == "json", joined)
    error = F.when(~good, F.struct(F.col("__status").alias("statusCode"), F.try_parse_json(one).alias("body")))
    keep = [c for c in df.columns if c not in (spec.get("as"), "httpError")]
    if spec.get("unwind"):
        each = F.when(good & (F.col("__kind") == "json"), F.col("__values")).otherwise(F.array(F.when(good, F.lit(None).cast("string"))))
        told = told.withColumn("__one", F.explode(each))
        return told.select(*keep, value(F.col("__one")).alias(spec["as"]), error.alias("httpError"))
    named = [value(F.when(good, one)).alias(spec["as"])] if "as" in spec else []
    return told.select(*keep, *named, error.alias("httpError"))
