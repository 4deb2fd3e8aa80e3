"""Packing of documents into sequences: cutting stock by column generation over a length histogram.

1. Documents are encoded and cut into pieces of at most `size` ids; only a remainder is shorter.
2. Piece lengths are rounded up to classes of `grain` ids; the histogram of classes is all the driver sees.
3. A linear program over patterns (multisets of classes that fit a sequence) is solved by revised simplex; an
   unbounded-knapsack dynamic program over the duals prices the next pattern, until none improves or the gap to
   the bound obj / price is below `gap`.
4. Pattern counts are rounded down; what they leave (fewer pieces than classes times pieces of a pattern, however
   many documents there are) goes best-fit into further patterns.
5. Pieces are ranked inside their class; a rank determines pattern, copy and slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweir.llm.common import batch, id_text, ready, slices, staged
from docweir.llm.tokens import END_ID, WORD_BPE, encoder, with_end

SIZE = 4096
GRAIN = 8
#: Pieces of a class that are ranked in one part, about.
RANKED = 20_000

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


def cut_pieces(docs: DataFrame, size: int = SIZE, vocab: str = WORD_BPE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): pieces of at most size ids; ids are little-endian unsigned 32-bit.

    Null text counts as empty and gives the end id alone; null and repeated ids are kept as they are; very long
    texts give many pieces; an empty table gives none.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        for b in slices(batches):
            ids, off = with_end(*enc.encode(b.column(1)), end_id)
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            n = np.diff(off)
            row = np.repeat(np.arange(len(n)), -(-n // size))
            k = np.arange(len(row)) - np.searchsorted(row, row)
            start = k * size
            length = np.minimum(size, n[row] - start)
            at = (off[:-1][row] + start) * 4
            yield batch(schema, b.column(0).take(pa.array(row)), start, length, n[row], [bytes(raw[i:j]) for i, j in zip(at.tolist(), (at + length * 4).tolist(), strict=True)])
        enc.rest()

    return id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------------------------------------- the plan


def knapsack(value: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best multiset by value whose weights fit room: (value, how many of each)."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(weight, kind="stable")
    w, v = weight[order], value[order]
    for r in range(1, room + 1):
        n = int(np.searchsorted(w, r, side="right"))
        best[r] = best[r - 1]
        if n:
            got = best[r - w[:n]] + v[:n]
            i = int(np.argmax(got))
            if got[i] > best[r] + 1e-12:
                best[r], took[r] = got[i], i
    count, r = np.zeros(len(value)), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            count[order[took[r]]] += 1
            r -= int(w[took[r]])
    return float(best[room]), count


def greedy_basis(weight: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible start: first-fit patterns over what is left, each used until a class of it runs out.

    Each pattern belongs to the class that ran out with it, and no later one has that class: so the patterns are a
    triangular, invertible basis.
    """
    m, left = len(weight), demand.astype(float).copy()
    rows, counts = np.zeros((m, m)), np.zeros(m)
    down = np.argsort(-weight, kind="stable")
    for i in range(m):
        if left[i] <= 0:
            rows[i, i] = room // weight[i]
    while (open_ := down[left[down] > 0]).size:
        p, free = np.zeros(m), room
        for i in open_:
            if free >= weight[i]:
                p[i] = free // weight[i] if i != open_[0] else 1
                free -= int(p[i] * weight[i])
        has = np.nonzero(p)[0]
        use = left[has] / p[has]
        n = float(use.min())
        out = has[int(np.argmin(use))]
        left[has] -= n * p[has]
        left[out] = 0
        rows[out], counts[out] = p, n
        for i in has[left[has] <= 1e-9]:
            if i != out:
                left[i] = 0
                rows[i, i] = room // weight[i]
    return rows, counts


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps. The driver has forked to start its JVM, after which threaded LAPACK calls
    may never return; these are plain array operations."""
    n = len(a)
    both = np.concatenate([a.astype(float), np.eye(n)], axis=1)
    for i in range(n):
        k = i + int(np.argmax(np.abs(both[i:, i])))
        if k != i:
            both[[i, k]] = both[[k, i]]
        both[i] /= both[i, i]
        rest = np.nonzero(both[:, i])[0]
        rest = rest[rest != i]
        both[rest] -= both[rest, i, None] * both[i]
    return both[:, n:]


def solve_patterns(weight: np.ndarray, demand: np.ndarray, room: int, gap: float = 2e-4, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The covering linear program min sum(x), A x = demand: (patterns by row, x)."""
    patterns, x = greedy_basis(weight, demand, room)
    inverse = inverted(patterns.T)
    filled = weight @ demand / room  # no cover needs fewer sequences
    for _ in range(rounds):
        if x.sum() <= (1 + gap) * filled:
            break
        duals = inverse.sum(axis=0)
        value, new = knapsack(np.maximum(duals, 0), weight, room)
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) <= gap * x.sum():
            break
        u = (inverse * new).sum(axis=1)
        ok = u > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, np.maximum(x, 0) / np.where(ok, u, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        x = x - step * u
        x[out] = step
        pivot = inverse[out] / u[out]
        inverse -= np.outer(u, pivot)
        inverse[out] = pivot
        patterns[out] = new
    return patterns, np.maximum(x, 0)


def best_fit(weight: np.ndarray, demand: np.ndarray, room: int) -> list[np.ndarray]:
    """Best fit decreasing over what rounding left: a pattern for each further sequence."""
    left: list[list[int]] = [[] for _ in range(room + 1)]  # open sequences by room left
    out: list[np.ndarray] = []
    for c in np.argsort(-weight, kind="stable"):
        for _ in range(int(demand[c])):
            w = int(weight[c])
            r = next((r for r in range(w, room + 1) if left[r]), None)
            if r is None:
                out.append(np.zeros(len(weight), np.int64))
                k, r = len(out) - 1, room
            else:
                k = left[r].pop()
            out[k][c] += 1
            left[r - w].append(k)
    return out


def plan(histogram: dict[int, int], room: int) -> dict[int, np.ndarray]:
    """By class, rows (first rank, pieces of this class in the pattern, first sequence, first slot), ranks ascending."""
    weight = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[c] for c in weight.tolist()], np.int64)
    chosen: list[tuple[np.ndarray, int]] = []
    if len(weight):
        patterns, x = solve_patterns(weight, demand.astype(float), room)
        rest = demand.copy()
        for p, n in zip(patterns.astype(np.int64), np.floor(x + 1e-9).astype(np.int64), strict=True):
            has = p > 0
            n = int(min(n, (rest[has] // p[has]).min())) if has.any() else 0
            if n > 0:
                rest -= n * p
                chosen.append((p, n))
        grouped: dict[bytes, int] = {}
        for p in best_fit(weight, rest, room):
            grouped[p.tobytes()] = grouped.get(p.tobytes(), 0) + 1
        chosen += [(np.frombuffer(p, np.int64), n) for p, n in grouped.items()]
    table: dict[int, list[tuple[int, int, int, int]]] = {int(c): [] for c in weight}
    used, sequence = dict.fromkeys(table, 0), 0
    for p, n in chosen:
        slot = 0
        for i in np.nonzero(p)[0]:
            c, a = int(weight[i]), int(p[i])
            table[c].append((used[c], a, sequence, slot))
            used[c] += a * n
            slot += a
        sequence += n
    return {c: np.array(rows, np.int64).reshape(-1, 4) for c, rows in table.items()}


def assign_sequences(pieces: DataFrame, size: int = SIZE, grain: int = GRAIN) -> DataFrame:
    """pieces, with sequence_id and offset. Needs columns doc_id, start, length; others are carried along.

    Offsets are gapless from 0 in each sequence. pieces is read several times: hand over a written table. Ranks are
    counted in parts of a class, as many as its size asks for, so that no task sorts a whole class. Pieces of one
    (doc_id, start) are in the order of all their columns, so that a task that is run again ranks them as before.
    An empty table gives an empty result.
    """
    spark, room = pieces.sparkSession, size // grain
    ready(spark)
    cls = F.ceil(F.col("length") / grain).cast("int")
    # At most size / grain rows come to the driver.
    histogram = {r["c"]: r["n"] for r in pieces.groupBy(cls.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    table = plan(histogram, room)
    carried = pieces.columns
    parts = F.create_map(*[F.lit(x) for c, n in histogram.items() for x in (c, 1 + n // RANKED)]) if histogram else F.create_map(F.lit(0), F.lit(1))
    rows = pieces.withColumn("__c", cls)
    rows = rows.withColumn("__s", F.pmod(F.xxhash64(*carried), F.element_at(parts, F.col("__c"))).cast("int"))
    counts = rows.groupBy("__c", "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__c", "__s", (F.sum("__n").over(Window.partitionBy("__c").orderBy("__s")) - F.col("__n")).alias("__base"))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__c", "__s").orderBy("doc_id", "start", *(c for c in carried if c not in ("doc_id", "start")))))
    ranked = ranked.join(before, ["__c", "__s"]).withColumn("__r", (F.col("__r") - 1 + F.col("__base")).cast("long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, r = b.column("__c").to_numpy(), b.column("__r").to_numpy()
            sequence, slot = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
            for k in np.unique(c):
                at = np.nonzero(c == k)[0]
                t = table[int(k)]
                row = t[np.searchsorted(t[:, 0], r[at], side="right") - 1]
                d = r[at] - row[:, 0]
                sequence[at], slot[at] = row[:, 2] + d // row[:, 1], row[:, 3] + d % row[:, 1]
            keep = [b.column(i) for i, n in enumerate(b.schema.names) if n not in ("__c", "__r")]
            names = [n for n in b.schema.names if n not in ("__c", "__r")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(slot)], names=[*names, "sequence_id", "__slot"])

    flat = ranked.select(*carried, "__c", "__r")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = flat.mapInArrow(place, f"{kinds}, sequence_id bigint, __slot bigint")
    w = Window.partitionBy("sequence_id").orderBy("__slot")
    return placed.withColumn("offset", F.sum("length").over(w) - F.col("length")).drop("__slot")


def pack(docs: DataFrame, size: int = SIZE, grain: int = GRAIN, with_ids: bool = False, **options) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset, and ids if asked for."""
    pieces = staged(cut_pieces(docs, size, **options), "pieces")
    carry = pieces.select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"), *["ids"] * with_ids)
    return assign_sequences(carry, size, grain)
