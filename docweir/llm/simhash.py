"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into `segments` segments. If two fingerprints differ in at most `distance` bits,
some choice of `joined` segments differs in at most one bit, as long as a pigeonhole argument holds (checked by
`layout`). Each distinct fingerprint is indexed under every choice with every one of its bits masked out: rows with
equal masked bits meet by an equality join on that key, and are verified by counting differing bits.

Three single segments (64 variants, keys of about 21 bits) suit up to some 20 million distinct fingerprints; beyond,
`layout` takes wider keys and more variants, at the same, exact result: the expected number of chance meetings is what
decides. Copies never meet: fingerprints are made distinct first. A large group of near fingerprints under one key is
linked by a spanning forest, found by leaders and the triangle inequality, not by all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import _join, batch, free_names, lookup, ready, slices, staged
from docweir.llm.components import components

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: A group under one key up to this size is compared pair by pair.
SMALL = 48

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of `width` words, repeats included; of the whole sequence if that is shorter."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    f = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    if len(words) <= width:
        return np.array([f(whole, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    first, last = (end - size)[: 1 - width].tolist(), (end[width - 1 :] - 1).tolist()
    return np.array([f(whole[i:j], SEED) for i, j in zip(first, last, strict=True)], np.uint64)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """A bit is 1 if set in over half the hashes; 0 without words."""
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        count += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp, extra...) for each row; fp is the fingerprint as a signed long, extra has columns of longs to carry.

    Null text has no words: 0."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", *extra)])
        for b in slices(batches):
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield batch(schema, b.column(0), fp, *b.columns[2:])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text, *extra)
    return own.mapInArrow(run, ", ".join(f"{c} bigint" for c in ("doc_id", "fp", *extra)))


# ---------------------------------------------------------------------------------------------- the index


def segments_of(n: int) -> list[int]:
    """Masks of n segments of 64 bits, as equal as can be."""
    edge = [64 * i // n for i in range(n + 1)]
    return [((1 << (j - i)) - 1) << i for i, j in zip(edge, edge[1:], strict=False)]


def covers(n: int, joined: int, distance: int) -> bool:
    """Whether `joined` of n segments always differ in one bit together at most."""
    worst = 0

    def spread(left: int, parts: int, most: int, seen: tuple[int, ...]) -> None:
        nonlocal worst
        if not parts:
            worst = max(worst, sum(sorted(seen)[:joined])) if not left else worst
            return
        for k in range(min(left, most), -1, -1):
            spread(left - k, parts - 1, k, (*seen, k))

    spread(distance, n, distance, ())
    return worst <= 1


def layout(rows: int, distance: int = DISTANCE) -> tuple[int, int]:
    """(segments, joined) with the least work for so many distinct fingerprints: index rows plus chance meetings."""
    best = None
    for n in range(1, 13):
        for joined in range(1, n + 1):
            if not covers(n, joined, distance):
                continue
            choices = list(combinations(segments_of(n), joined))
            bits = [sum(s.bit_count() for s in c) for c in choices]
            cost = sum(b * rows * (20 + rows / 2 ** (b - 1) / 2) for b in bits)
            if best is None or cost < best[0]:
                best = (cost, n, joined)
    return best[1:]


def variants(n: int, joined: int) -> np.ndarray:
    """Masks: each choice of segments with each of its bits left out."""
    out = []
    for choice in combinations(segments_of(n), joined):
        whole = sum(choice)
        out += [whole & ~(1 << i) for i in range(64) if whole >> i & 1]
    return np.array(out, np.uint64)


def forest(fp: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that join exactly what links of at most `distance` bits among distinct fingerprints join.

    Leaders take what lies within distance; members of two leaders' groups can only link if the leaders are within
    three distances, and are compared, in blocks, only while the two groups aren't joined.
    """
    links: list[tuple[int, int]] = []
    groups: list[np.ndarray] = []
    rest = fp
    while len(rest):
        near = np.bitwise_count(rest ^ rest[0]) <= distance
        own = rest[near]
        links += [(own[0], x) for x in own[1:]]
        groups.append(own)
        rest = rest[~near]
    parent = list(range(len(groups)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lead = np.array([g[0] for g in groups], np.uint64)
    for i in range(len(groups)):
        for j in np.nonzero(np.bitwise_count(lead[i + 1 :] ^ lead[i]) <= 3 * distance)[0] + i + 1:
            a, b = find(i), find(int(j))
            if a == b:
                continue
            g, other = groups[i], groups[int(j)]
            step = max(1, (1 << 20) // len(other))
            for k in range(0, len(g), step):
                d = np.bitwise_count(g[k : k + step, None] ^ other[None, :]) <= distance
                if d.any():
                    x, y = divmod(int(np.argmax(d)), len(other))
                    links.append((g[k + x], other[y]))
                    parent[b] = a
                    break
    return links


def _pairs(v: np.ndarray, fp: np.ndarray, masks: np.ndarray, distance: int) -> np.ndarray:
    """Links found under the keys of whole, sorted groups."""
    key = fp & masks[v]
    first = np.concatenate([[0], np.nonzero((v[1:] != v[:-1]) | (key[1:] != key[:-1]))[0] + 1, [len(v)]])
    size = np.diff(first)
    out = []
    for i in np.nonzero(size > SMALL)[0].tolist():
        out += forest(fp[first[i] : first[i + 1]], distance)
    small = np.repeat((size > 1) & (size <= SMALL), size)
    group = np.repeat(np.arange(len(size)), size)
    found = [np.array(out, np.uint64).reshape(-1, 2)]
    at = np.nonzero(small)[0]
    for d in range(1, SMALL):
        at = at[at + d < len(v)]
        at = at[group[at + d] == group[at]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + d]
        ok = np.bitwise_count(x) <= distance
        k, x = at[ok], x[ok]
        # A pair is told under the first key that it shares. If that key's group is large, its forest joins the pair.
        k = k[np.argmax((x[:, None] & masks[None, :]) == 0, axis=1) == v[k]]
        found.append(np.stack([fp[k], fp[k + d]], 1))
    return np.concatenate(found)


def links(distinct: DataFrame, rows: int, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between distinct fingerprints fp that join what all links of at most `distance` bits join."""
    ready(distinct.sparkSession)
    masks = variants(*layout(max(1, rows), distance))
    signed = masks.view(np.int64).tolist()
    table = F.array(*[F.lit(m) for m in signed])
    index = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(signed) - 1))).alias("v"))
    masked = F.col("fp").bitwiseAND(F.element_at(table, F.col("v") + 1))
    index = index.select("v", "fp", masked.alias("k")).repartition("v", "k").sortWithinPartitions("v", "k").select("v", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        names = ["a", "b"]

        def told(p: np.ndarray) -> pa.RecordBatch:
            p = np.unique(np.sort(p, axis=1), axis=0).view(np.int64) if len(p) else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=names)

        for b in _larger(batches):
            v = np.concatenate([v, b[0]])
            fp = np.concatenate([fp, b[1]])
            key = fp & masks[v]
            new = np.nonzero((v[1:] != v[:-1]) | (key[1:] != key[:-1]))[0]
            cut = int(new[-1]) + 1 if len(new) else 0  # the last group may go on
            if cut:
                yield told(_pairs(v[:cut], fp[:cut], masks, distance))
                v, fp = v[cut:], fp[cut:]
        if len(v):
            yield told(_pairs(v, fp, masks, distance))

    return index.mapInArrow(run, "a bigint, b bigint")


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrow batches of a thousand rows, together."""
    own, n = [], 0
    for b in batches:
        own.append((b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy().view(np.uint64)))
        n += b.num_rows
        if n >= rows:
            yield tuple(np.concatenate(x) for x in zip(*own, strict=True))
            own, n = [], 0
    if own:
        yield tuple(np.concatenate(x) for x in zip(*own, strict=True))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE, **columns) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the smallest doc_id reachable by links, itself included.

    Null and empty texts, and texts of white space, share fingerprint 0 and are linked like any other. Null ids are
    in a component but never name it unless it has no other. Repeated ids are rows of their own; their fingerprints
    aren't linked for having one id. An empty table gives no rows.
    """
    own = staged(fingerprints(docs, width, **columns), "fingerprints")
    named = _rooted(own, distance)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return lookup(own, named, ["fp"], own.count())


def _rooted(own: DataFrame, distance: int) -> DataFrame:
    """(fp, least, root): each distinct fingerprint, its smallest doc_id and its component's smallest fingerprint."""
    distinct = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = links(distinct.select("fp"), distinct.count(), distance)
    nodes = components(found).select(F.col("node").alias("fp"), "root")
    return staged(distinct.join(nodes, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def hexed(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, null after all others.

    A row is judged by its own text: rows that share an id, or have none, stay apart by (doc_id, hash of the text).
    """
    of = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    free = free_names(docs, "id", "of", "kept")
    own = staged(fingerprints(docs.withColumn(free["of"], of), width, extra=[free["of"]]), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(free["of"]).alias("of"))
    first = own.groupBy("fp").agg(F.min(place).alias("first"))
    kept = first.join(_rooted(own, distance).select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.doc_id").alias(free["id"]), F.col("first.of").alias(free["of"]), F.lit(True).alias(free["kept"]))
    keyed = docs.withColumn(free["id"], F.col("doc_id").cast("long")).withColumn(free["of"], of)
    found = _join(keyed, kept, [free["id"], free["of"]], [free["kept"]], "inner")
    return found.dropDuplicates([free["id"], free["of"]]).select(*[F.col(f"`{c}`") for c in docs.columns])
