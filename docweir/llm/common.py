"""What the operators share: the shared folder, shipping of code, bounded batches, skew-safe lookups."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.shared import shared_dir, staged  # noqa: F401

#: Rows of an Arrow batch that Spark hands to Python. Texts are long: 10,000 of them need not fit a worker.
ARROW_ROWS = 1000
#: Its bytes, about: a batch ends with the row that goes beyond.
ARROW_BYTES = 16 << 20
#: A key is hot from this share of all rows on, so that at most 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 1 / 1000

_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Gives executors this package, as a zip, once per application, and sets the Arrow batch size, for the session."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        top = Path(__file__).resolve().parents[1]
        into = tempfile.mkdtemp(prefix="docweir-code-")
        atexit.register(shutil.rmtree, into, True)
        path = os.path.join(into, "docweir_code.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(path)
    return spark


def forget(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of finished queries now, not when the driver happens to collect garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text, null text as empty text, under the fixed names doc_id and text."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column's bytes stay below `most`, or one row if that row alone is longer."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_pylist()
        first = total = 0
        for i, n in enumerate(sizes):
            if total + n > most and i > first:
                yield b.slice(first, i - first)
                first, total = i, 0
            total += n
        yield b.slice(first)
    tidy()


def tidy() -> None:
    """Gives memory that a task has freed back to the system: Spark keeps its Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def with_end(batches: Iterator) -> Iterator:
    """What batches yields, then None, so that a loop can tell what it has kept back."""
    yield from batches
    yield None


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[list[np.ndarray]]:
    own, n = [], 0
    for b in batches:
        own.append([c.to_numpy().astype(np.int64) for c in b.columns])
        n += b.num_rows
        if n >= rows:
            yield [np.concatenate(x) for x in zip(*own, strict=True)]
            own, n = [], 0
    if own:
        yield [np.concatenate(x) for x in zip(*own, strict=True)]
    tidy()


def lookup(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """left with right's columns; right has each key once. `rows`: left's row count, or more.

    Keys that hold over a thousandth of left's rows (there can be no more than a thousand such keys, whatever the
    input) are joined by broadcasting their few rows of right; all others by an ordinary shuffle join. `counts` has
    the count n of left's rows for each key, of all that may be hot at least; it is counted if it isn't given.
    left is read twice, so hand over a staged table. Null keys are looked up like any other value.
    """
    extra = [c for c in right.columns if c not in keys]
    most = max(1000, int(rows * HOT_SHARE))
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = staged(counts.where(F.col("n") > F.lit(most)).select(*keys), "hot")
    if hot.isEmpty():
        return _join(left, right, keys, extra, how)
    flag = hot.withColumn("__hot", F.lit(True))
    found = _join(right, F.broadcast(flag), keys, ["__hot"], "inner").drop("__hot")
    marked = _join(left, F.broadcast(flag), keys, ["__hot"], "left")
    one = _join(marked.where("__hot").drop("__hot"), F.broadcast(found), keys, extra, how)
    two = _join(marked.where("__hot is null").drop("__hot"), right, keys, extra, how)
    return one.unionByName(two)


def free_names(docs: DataFrame, *names: str) -> dict[str, str]:
    """A name for each given one that no column of docs has, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, {}
    for n in names:
        own = f"__{n}"
        while own in taken:
            own += "_"
        out[n] = own
    return out


def _join(left: DataFrame, right: DataFrame, keys: list[str], extra: list[str], how: str) -> DataFrame:
    """left joined with right's extra columns by keys, null keys like any other value; right's keys go by free names."""
    free = free_names(left, *[f"r_{k}" for k in keys])
    r = right.select(*[F.col(f"`{k}`").alias(free[f"r_{k}"]) for k in keys], *extra)
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{free[f'r_{k}']}`")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(r, cond, how).select(*[F.col(f"`{c}`") for c in left.columns], *extra)


def with_docs(docs: DataFrame, info: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs left-joined with one row per id of info; ids may be null."""
    return _join(docs, info, [key], [c for c in info.columns if c != key], "left")
