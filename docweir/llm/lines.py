"""Line de-duplication by a segment-partition edit join.

Lines (stripped, not blank) are linked if they are within the edits of docweir.llm.segments: a tenth of the shorter
line's words from 20 words on; below, a tenth of its characters, two at most. A class is what links join, and all but
its first line (by doc_id, then line) go. No pair within the threshold is missed, and each is counted once.

1. Each line gives keys: of its segments, under which it is indexed, and of its substrings, by which it probes.
2. Keys travel in packed blocks, dealt to buckets of bounded size; in a bucket, rows stay that share a key with
   another line, in the other role, whose length and counts of symbols allow the threshold.
3. The texts of these lines are fetched. Under keys of many lines, such as those of a passage that other lines have
   too, rows go again whose 64 counts of symbols allow no partner: of each line 64 bytes meet there, not its text.
4. A pair is verified by banded bit-parallel edit distance under the smallest key at which it meets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweir.llm.common import _join, batch, forget, free_names, id_text, lookup, ready, slices, staged, tidy, with_end
from docweir.llm.components import components
from docweir.llm.edits import within, within_pairs
from docweir.llm.hashing import dealt, mixed, unpacked
from docweir.llm.segments import EDITS, LONG, Lines, allowed, keys, threshold

#: Bits of the filter of wanted lines that scans get: 4 MB, whatever the input.
FILTER_BITS = 1 << 25
#: Bytes of text whose keys one bucket gets, about: some 700,000 keys.
BUCKET = 8 << 20
#: Characters of lines that are verified together, pairs that wait together, pairs that are looked at together.
CHUNK, PAIRS, FEW = 1 << 21, 1 << 17, 1 << 14
#: Characters of lines whose keys are computed together: what that takes stays in a core's cache.
PART = 1 << 19


# ---------------------------------------------------------------------------------------------- lines of documents


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number, stripped line) of a text's lines that aren't blank."""
    return [(i, s) for i, x in enumerate(text.split("\n")) if (s := x.strip())]


def digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode())


def short(d: bytes) -> int:
    """48 bits of a digest, by which lines meet before their texts are compared."""
    return int.from_bytes(d[:6], "little")


def shorts(digests: list[bytes]) -> np.ndarray:
    """`short` of each digest."""
    raw = np.zeros((len(digests), 8), np.uint8)
    raw[:, :6] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)[:, :6]
    return raw.view("<i8").ravel()


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, of, line, size, digest): each line, its bytes; of tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("of", pa.int64()), ("line", pa.int32()), ("size", pa.int32()), ("digest", pa.binary())])
        for b in slices(batches):
            found = [lines_of(t) for t in b.column(1).to_pylist()]
            raw = [s.encode() for own in found for _, s in own]
            at = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
            yield batch(schema, b.column(0).take(at), b.column(2).take(at), [n for own in found for n, _ in own], list(map(len, raw)), list(map(xxhash.xxh3_128_digest, raw)))

    return _keyed(docs).mapInArrow(run, "doc_id bigint, of bigint, line int, size int, digest binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("of"))


#: The bytes of a row of a block: key, id, length with kind and role, counts, place mod 256.
ROW = (6, 6, 2, 2, 1)
_MOST = (1 << 14) - 1


def _half(counts: np.ndarray) -> np.ndarray:
    """Eight counts of four bits, added up in pairs: four counts mod 16, of which an edit still moves two by one."""
    low, high = counts & np.uint32(0x0F0F0F0F), counts >> np.uint32(4) & np.uint32(0x0F0F0F0F)
    c = low + high & np.uint32(0x0F0F0F0F)
    c = c | c >> np.uint32(4)
    return (c & np.uint32(0xFF) | c >> np.uint32(8) & np.uint32(0xFF00)).astype(np.uint16)


def _blocks(lines: list[str], buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed rows) of distinct lines. A row's length is in the symbols of its key, 16,383 at most: two
    lengths are then nearer to each other than they are, never farther."""
    rows = [_rows(part) for part in _parts(lines)]
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
    if rows and len(columns[0]):
        yield from dealt(columns[0], buckets, *zip(columns, ROW, strict=True))


def _parts(lines: list[str]) -> Iterator[list[str]]:
    """The lines, some PART characters together."""
    first = size = 0
    for i, s in enumerate(lines):
        size += len(s)
        if size >= PART:
            yield lines[first : i + 1]
            first, size = i + 1, 0
    if first < len(lines):
        yield lines[first:]


def _rows(lines: list[str]) -> tuple[np.ndarray, ...]:
    own = Lines(lines)
    key, line, probe, words, place = keys(own)
    by_chars, by_words = own.counts()
    n = np.minimum(np.where(words, own.words[line], own.chars[line]), _MOST)
    meta = n << 2 | words.astype(np.int64) << 1 | probe
    counts = _half(np.where(words, by_words[line], by_chars[line]))
    return key, shorts([digest(s) for s in lines])[line], meta, counts, place


_MET = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("role", pa.int8())])
#: A role: indexed, probing, under a key of words, under a key of more than MANY lines.
INDEXED, PROBES, WORDS, COMMON = 1, 2, 4, 8
MANY = 64


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blocks of each bucket, of rows (bucket, body) sorted by bucket."""
    bucket, held = None, []
    for b in batches:
        for k, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != bucket and held:
                yield held
                held = []
            bucket = k
            held.append(body)
    if held:
        yield held


def unpacked_all(blocks: list[bytes], sizes: tuple[int, ...]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*(unpacked(b, *sizes) for b in blocks), strict=True)]


def meetings(docs: DataFrame, buckets: int) -> DataFrame:
    """(key, id, role): lines that may be within the threshold of another one under that key."""

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("body", pa.binary())])
        for b in slices(batches, most=2 << 20):
            own = list(_blocks(list({s: None for t in b.column(0).to_pylist() for _, s in lines_of(t)}), buckets))
            yield batch(schema, [k for k, _ in own], [x for _, x in own])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for body in buckets_of(batches):
            key, ident, meta, counts, place = unpacked_all(body, ROW)
            yield batch(_MET, *_met(key, ident.view(np.int64), meta.astype(np.uint16), counts.astype(np.uint16), place.astype(np.uint8)))
        tidy()

    own = docs.select("text").mapInArrow(signatures, "bucket bigint, body binary")
    return own.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "key bigint, id bigint, role tinyint")


def _fits(meta: np.ndarray, other: np.ndarray, place: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The edits that a row and another one may have by their kinds, lengths and places, the row being indexed and the
    other probing; -1 if they can't be a pair."""
    # Of 14 bits, so that their differences and thresholds fit 16.
    n, m = ((x >> 2).astype(np.int16) for x in (meta, other))
    words = meta & 2
    # Of the shorter line's words only the kind is known here; characters decide if it isn't by words.
    tau = threshold(n, np.where(words > 0, np.maximum(n, LONG), 0))
    apart = place - there
    apart = np.minimum(apart, 0 - apart)  # unsigned, of eight bits: the way round is the other way
    return np.where((words == other & 2) & (meta & 1 == 0) & (other & 1 == 1) & allowed(n, m, tau) & (apart <= tau), tau, -1)


_HALF = np.array([[min((x - y) % 16, (y - x) % 16) for y in range(16)] for x in range(16)], np.uint8)
#: How far apart two counts and two more are, mod 16, by two bytes.
_APART = (_HALF[:, None, :, None] + _HALF[None, :, None, :]).ravel()


def _alike(a: np.ndarray, b: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Whether the counts of two rows allow tau edits."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    return _APART[(a & 255) << 8 | b & 255] + _APART[a & 0xFF00 | b >> 8] <= 2 * tau


def _contested(key: np.ndarray, ident: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Rows among which are all those whose key has several lines and both roles: keys share slots, by their upper
    bits, so that a few others stay too. (Their lower ones tell the bucket.)"""
    bits = max(10, int(2 * len(key)).bit_length())
    slot = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)
    some = np.empty(1 << bits, ident.dtype)
    some[slot] = ident
    several, found = np.zeros(1 << bits, bool), np.zeros((2, 1 << bits), bool)
    # One of a slot's lines stands there; any other one differs from it.
    several[slot[some[slot] != ident]] = True
    probes = meta & 1 == 1
    found[0][slot[~probes]] = True
    found[1][slot[probes]] = True
    return (several & found[0] & found[1])[slot]


def _met(key: np.ndarray, ident: np.ndarray, meta: np.ndarray, counts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, role) of rows that have a partner under their key."""
    # Most rows go before the sort.
    order = np.nonzero(_contested(key, ident, meta))[0]
    order = order[np.argsort(key[order])]
    key, ident, meta, counts, place = (c[order] for c in (key, ident, meta, counts, place))
    if not len(key):
        return key.astype(np.int64), ident, meta.astype(np.int8)
    first = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
    size = np.diff(np.append(first, len(key)))
    # Of most keys there is one line only, in both roles.
    role = np.bitwise_or.reduceat(1 << (meta & 1), first)
    some = np.repeat((np.minimum.reduceat(ident, first) != np.maximum.reduceat(ident, first)) & (role == 3), size)
    key, ident, meta, counts, place = (c[some] for c in (key, ident, meta, counts, place))
    if not len(key):
        return key.astype(np.int64), ident, meta.astype(np.int8)
    ok = np.zeros(len(key), bool)
    first = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
    size = np.diff(np.append(first, len(key)))

    def pairs(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in ((i, j), (j, i)):
            tau = _fits(meta[a], meta[b], place[a], place[b])
            k = np.nonzero((tau >= 0) & (ident[a] != ident[b]))[0]
            k = k[_alike(counts[a[k]], counts[b[k]], tau[k])]
            ok[a[k]] = ok[b[k]] = True

    at = np.nonzero(np.repeat(size <= 64, size))[0]
    for d in range(1, 64):
        at = at[at + d < len(key)]
        at = at[key[at + d] == key[at]]
        if not len(at):
            break
        pairs(at, at + d)
    for g in np.nonzero(size > 64)[0].tolist():
        own = np.arange(first[g], first[g] + size[g])
        # Copies of a line, one from each batch of documents, count once.
        own = own[np.unique(np.stack([ident[own], meta[own], place[own]]), axis=1, return_index=True)[1]]
        for words in (0, 2):
            mine = own[meta[own] & 2 == words]
            mine = mine[np.argsort(meta[mine] >> 2, kind="stable")]
            for i, j in _length_blocks(mine[meta[mine] & 1 == 0], mine[meta[mine] & 1 == 1], meta >> 2, words > 0):
                tau = _fits(meta[i][:, None], meta[j][None], place[i][:, None], place[j][None])
                m = (tau >= 0) & (ident[i][:, None] != ident[j][None])
                m &= _alike(counts[i][:, None], counts[j][None], tau)
                ok[i[m.any(1)]] = True
                ok[j[m.any(0)]] = True
    key, ident, meta = key[ok], ident[ok], meta[ok]
    words = meta & 2
    one = np.lexsort((words, ident, key))
    key, ident, words, meta = (c[one] for c in (key, ident, words, meta))
    new = np.nonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (ident[1:] != ident[:-1]) | (words[1:] != words[:-1])])[: len(key)])[0]
    role = np.bitwise_or.reduceat(np.where(meta & 1 == 1, PROBES, INDEXED) | np.where(words > 0, WORDS, 0), new) if len(new) else meta
    key = key[new].astype(np.int64)
    _, at, size = np.unique(key, return_inverse=True, return_counts=True)
    return key, ident[new], (role | np.where(size[at] > MANY, COMMON, 0)).astype(np.int8)


def _length_blocks(own: np.ndarray, other: np.ndarray, length: np.ndarray, by_words: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of indexed and of probing rows, both sorted by length, that hold all pairs whose lengths allow one."""
    n, m = length[own].astype(np.int64), length[other].astype(np.int64)
    far = n + threshold(n, np.maximum(n, LONG) if by_words else np.zeros_like(n))
    for i in range(0, len(own), 256):
        lo, hi = np.searchsorted(m, n[i]), np.searchsorted(m, far[i : i + 256].max(), side="right")
        for j in range(int(lo), int(hi), 1024):
            yield own[i : i + 256], other[j : min(j + 1024, int(hi))]


def filter_of(ids: DataFrame) -> np.ndarray:
    """Bits of a filter of 64-bit ids, by their lowest ones: FILTER_BITS, whatever their number. It may let through
    more than them, never less."""
    low = F.col("id").bitwiseAND(FILTER_BITS - 1)
    word = F.shiftright(low, 6).cast("int")
    # At most FILTER_BITS / 64 rows.
    got = ids.select(word.alias("w"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[got["w"].to_numpy()] = got["b"].to_numpy()
    return table.view(np.uint64)


def held_in(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the filter lets through."""
    k = ids & (FILTER_BITS - 1)
    return (bits[k >> 6] >> (k & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def wanted_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line): the distinct lines whose short digest is in ids, or seems to be by a filter of fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(ids))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("line", pa.string())])
        for b in slices(batches):
            seen = list({s: None for t in b.column(0).to_pylist() for _, s in lines_of(t)})
            ident = shorts([digest(s) for s in seen])
            hit = np.nonzero(held_in(sent.value, ident))[0]
            yield batch(schema, ident[hit], [seen[i] for i in hit.tolist()])

    found = docs.select("text").mapInArrow(find, "id bigint, line string")
    # One exchange, by id, that the join after it needs as well. Two lines of one id are both kept.
    return found.groupBy("id").agg(F.collect_set("line").alias("lines")).select("id", F.explode("lines").alias("line"))


def likely(met: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, id, role) of met without rows of common keys that have no partner there by 64 counts of symbols; no pair
    within the threshold goes."""
    common = met.where(F.col("role") >= COMMON)
    bits = filter_of(common.select("id").distinct())
    if not bits.any():
        return met
    sent = met.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("words", pa.int8()), ("length", pa.int64()), ("counts", pa.binary())])
        for b in slices(batches, "line", 1 << 20):
            ident = b.column(0).to_numpy()
            hit = np.nonzero(held_in(sent.value, ident))[0]
            if not len(hit):
                continue
            own = Lines(b.column(1).take(pa.array(hit)).to_pylist())
            some = (own.words < LONG + EDITS, own.by_words)
            for kind, length, on, counts in zip((0, WORDS), (own.chars, own.words), some, own.many_counts(), strict=True):
                on = np.nonzero(on)[0]
                yield batch(schema, ident[hit[on]], np.full(len(on), kind), length[on], [c.tobytes() for c in np.minimum(counts[on], 255).astype(np.uint8)])

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_keys(batches):
            key, ident, role, length = (b.column(i).to_numpy() for i in range(4))
            ok = _partnered(key, ident, role, length, np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, 64))
            yield batch(_MET, key[ok], ident[ok], role[ok])
        tidy()

    counted = texts.mapInArrow(count, "id bigint, words tinyint, length bigint, counts binary").distinct()
    rows = common.withColumn("words", F.col("role").bitwiseAND(WORDS)).join(counted, ["id", "words"]).select("key", "id", "role", "length", "counts")
    left = rows.repartition("key").sortWithinPartitions("key").mapInArrow(partners, "key bigint, id bigint, role tinyint").distinct()
    return met.where(F.col("role") < COMMON).unionByName(left)


def whole_keys(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Rows of whole keys, some `rows` together, of batches sorted by key, their first column."""
    held, n = [], 0
    for b in with_end(batches):
        if b is not None and b.num_rows:
            held.append(b)
            n += b.num_rows
        if held and (b is None or n >= rows):
            own = pa.Table.from_batches(held)
            key = own.column(0).to_numpy()
            # The last key may go on in the next batch.
            upto = n if b is None else int(np.searchsorted(key, key[-1]))
            if upto:
                yield own.slice(0, upto)
                held, n = own.slice(upto).to_batches(), n - upto


def _partnered(key: np.ndarray, ident: np.ndarray, role: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which rows have a partner under their key, of their kind, in the other role, whose length and counts allow the
    threshold."""
    ok, kind = np.zeros(len(key), bool), role & WORDS
    order = np.lexsort((length, kind, key))
    cut = np.nonzero((key[order][1:] != key[order][:-1]) | (kind[order][1:] != kind[order][:-1]))[0] + 1
    for mine in np.split(order, cut):
        by_words = bool(kind[mine[0]])
        for i, j in _length_blocks(mine[role[mine] & INDEXED > 0], mine[role[mine] & PROBES > 0], length, by_words):
            n = length[i]
            tau = threshold(n, np.maximum(n, LONG) if by_words else np.zeros_like(n))[:, None]
            may = allowed(n[:, None], length[j][None], tau) & (ident[i][:, None] != ident[j][None])
            apart, x, y = np.zeros(may.shape, np.int16), counts[i].astype(np.int16).T, counts[j].astype(np.int16).T
            for c in range(64):
                apart += np.abs(x[c][:, None] - y[c])
                if c % 8 == 7:
                    may &= apart <= 2 * tau
                    if not may.any():
                        break
            ok[i[may.any(1)]] = True
            ok[j[may.any(0)]] = True
    return ok


def team_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows (key << 3 | role, line), sorted, of whole teams, some CHUNK characters of lines together, of batches (team,
    line, keys) sorted by team."""
    team, own, size = [], [], 0
    for b in with_end(batches):
        if b is not None:
            team += b.column(0).to_pylist()
            lines = b.column(1).to_pylist()
            size += sum(map(len, lines))
            own += zip(lines, b.column(2).to_pylist(), strict=True)
        if b is None or size >= CHUNK and team[-1] != team[0]:
            # The last team may go on in the next batch.
            n = len(team) if b is None else next(i for i in range(len(team) - 1, -1, -1) if team[i] != team[-1]) + 1
            if n:
                rows = sorted((k, s) for s, ks in own[:n] for k in ks)
                yield np.array([k for k, _ in rows], np.int64), [s for _, s in rows]
            team, own = team[n:], own[n:]
            size = sum(len(s) for s, _ in own)
    tidy()


def links(docs: DataFrame, buckets: int) -> DataFrame:
    """(a, b, n) by digests of distinct lines within their edits. Rows with b join what all links join; rows without b
    tell that a has n links that are counted under one key. Every link is counted once for each end."""
    met = staged(meetings(docs, buckets), "meetings")
    forget(docs.sparkSession)
    texts = staged(wanted_texts(docs, met.select("id").distinct()), "texts")
    met = likely(met, texts)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, line in team_chunks(batches):
            yield _links(*_verified(key, line))

    rows = _teams(met).join(texts, "id").select("team", "line", "keys")
    return rows.repartition(buckets, "team").sortWithinPartitions("team").mapInArrow(verify, "a binary, b binary, n bigint")


def _teams(met: DataFrame) -> DataFrame:
    """(team, id, keys): keys with their roles, below; each key goes to one team, keys of the same lines mostly to the same one, so that a line's text
    travels once for most of its keys. A team is named by the smallest key that a key's lines have."""
    least = Window.partitionBy("id")
    by_id = met.repartition("id").withColumn("least", F.min("key").over(least))
    by_key = by_id.repartition("key").withColumn("team", F.min("least").over(Window.partitionBy("key")))
    role = F.col("role").bitwiseAND(COMMON - 1).cast("long")
    return by_key.repartition("id").groupBy("id", "team").agg(F.collect_list(F.shiftleft("key", 3).bitwiseOR(role)).alias("keys"))


def _links(lines: list[str], a: np.ndarray, b: np.ndarray, degree: np.ndarray) -> pa.RecordBatch:
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])
    own = np.nonzero(degree)[0].tolist()
    d = {i: digest(lines[i]) for i in {*a.tolist(), *b.tolist(), *own}}
    rows = [(d[i], d[j], 0) for i, j in zip(a.tolist(), b.tolist(), strict=True)] + [(d[i], None, int(degree[i])) for i in own]
    return batch(schema, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])


def _code(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    """48 bits that stand for a key and a line, above 16 for a place."""
    return mixed(key + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(0xFFFF)


def _verified(key: np.ndarray, text: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (key << 3 | role, line), sorted: (distinct lines, stars of what links join, each line's links).

    A pair is judged under the smallest key that both have at places that its edits allow.
    """
    lines = sorted(set(text))
    place = {s: i for i, s in enumerate(lines)}
    row = np.array([place[s] for s in text], np.int64)
    role, key = key & 7, (key >> 3).astype(np.uint64)
    own = Lines(lines)
    k, who, probe, words, place_in = keys(own)
    kinds = []
    for by_words, counts in zip((False, True), own.many_counts(), strict=True):
        index, other = (np.nonzero((words == by_words) & (probe == p))[0] for p in (False, True))
        index = index[np.lexsort((k[index], who[index]))]
        known = np.sort(_code(k[other], who[other]) | place_in[other].astype(np.uint64))
        kinds.append((by_words, own.words if by_words else own.chars, counts, who[index], k[index], place_in[index], known))
    parent, degree = np.arange(len(lines)), np.zeros(len(lines), np.int64)
    pending: list[tuple[bool, np.ndarray, np.ndarray, np.ndarray]] = []

    def judge(x: np.ndarray, y: np.ndarray, at: np.ndarray, kind: tuple) -> None:
        """x is indexed and y probes under key at."""
        for i in range(0, len(x), FEW):
            judge_few(x[i : i + FEW], y[i : i + FEW], at[i : i + FEW], kind)

    def judge_few(x: np.ndarray, y: np.ndarray, at: np.ndarray, kind: tuple) -> None:
        by_words, length, many, idx_line, idx_key, idx_place, known = kind
        tau = threshold(own.chars[x], own.words[x] if by_words else np.zeros_like(x))
        ok = allowed(length[x], length[y], tau) & ((length[x] < length[y]) | (x < y)) & (x != y)
        ok &= (np.minimum(own.words[x], own.words[y]) >= LONG) == by_words
        x, y, at, tau = x[ok], y[ok], at[ok], tau[ok]
        ok = np.abs(many[x] - many[y]).sum(1) <= 2 * tau
        x, y, at, tau = x[ok], y[ok], at[ok], tau[ok]
        if not len(x):
            return
        # The indexed line's keys up to this one: the other one has this key, at a like place, and none before.
        lo, hi = np.searchsorted(idx_line, x), np.searchsorted(idx_line, x, side="right")
        pair = np.repeat(np.arange(len(x)), hi - lo)
        entry = np.arange(len(pair)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
        some = idx_key[entry] <= at[pair]
        pair, entry = pair[some], entry[some]
        near_by = _near_in(_code(idx_key[entry], y[pair]), idx_place[entry], tau[pair], known)
        pair, entry = pair[near_by], entry[near_by]
        here, before = np.zeros(len(x), bool), np.zeros(len(x), bool)
        same = idx_key[entry] == at[pair]
        here[pair[same]], before[pair[~same]] = True, True
        ok = here & ~before
        pending.append((by_words, x[ok], y[ok], tau[ok]))
        if sum(len(p[1]) for p in pending) >= PAIRS:
            settle()

    def settle() -> None:
        """Verifies the pending pairs, those of one threshold together."""
        for kind in (False, True):
            x, y, tau = (np.concatenate([np.empty(0, np.int64), *(p[i] for p in pending if p[0] == kind)]) for i in (1, 2, 3))
            good = _close(own, x, y, tau, kind)
            x, y = x[good], y[good]
            degree[:] += np.bincount(np.concatenate([x, y]), minlength=len(lines))
            _join_all(parent, x, y)
        pending.clear()

    def candidates(i: np.ndarray, j: np.ndarray) -> None:
        """Rows i and j share a key."""
        ok = (role[i] & WORDS) == (role[j] & WORDS)
        i, j = i[ok], j[ok]
        for kind in kinds:
            mine = ((role[i] & WORDS) > 0) == kind[0]
            a, b = i[mine], j[mine]
            n, m = kind[1][row[a]], kind[1][row[b]]
            swap = (m < n) | (m == n) & (row[b] < row[a])
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            on = (role[a] & INDEXED > 0) & (role[b] & PROBES > 0)
            judge(row[a[on]], row[b[on]], key[a[on]], kind)

    first = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
    size = np.diff(np.append(first, len(key)))
    at = np.nonzero(np.repeat(size <= 64, size))[0]
    for d in range(1, 64):
        at = at[at + d < len(key)]
        at = at[key[at + d] == key[at]]
        if not len(at):
            break
        candidates(at, at + d)
    for g in np.nonzero(size > 64)[0].tolist():
        mine, here = np.arange(first[g], first[g] + size[g]), key[first[g]]
        for kind in kinds:
            length = kind[1][row]
            some = mine[((role[mine] & WORDS) > 0) == kind[0]]
            some = some[np.lexsort((row[some], length[some]))]
            for p, q in _length_blocks(some[role[some] & INDEXED > 0], some[role[some] & PROBES > 0], length, kind[0]):
                judge(np.repeat(row[p], len(q)), np.tile(row[q], len(p)), np.full(len(p) * len(q), here, np.uint64), kind)
    settle()
    return lines, *stars(lines, parent), degree


def _close(own: Lines, x: np.ndarray, y: np.ndarray, tau: np.ndarray, by_words: bool) -> np.ndarray:
    """Whether lines x[k] and y[k] are within tau[k] edits of words or characters; x[k] isn't the longer one."""
    out = np.zeros(len(x), bool)
    few = tau <= 31
    for some in (np.nonzero(few)[0], np.nonzero(~few)[0]):
        if not len(some):
            continue
        used, back = np.unique(np.concatenate([x[some], y[some]]), return_inverse=True)
        sym, n = own.symbols(used, by_words)
        i, j = back[: len(some)], back[len(some) :]
        if few[some[0]]:
            out[some] = within_pairs(sym, n, i, j, tau[some])
            continue
        # A band of more than 64 bits: one by one.
        text = ["".join(map(chr, (s[:m] + (1 << 16) if by_words else s[:m]).tolist())) for s, m in zip(sym, n.tolist(), strict=True)]
        out[some] = [within(text[p], text[q], t) for p, q, t in zip(i.tolist(), j.tolist(), tau[some].tolist(), strict=True)]
    return out


def _near_in(code: np.ndarray, place: np.ndarray, reach: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are among known ones at a place not farther than reach."""
    low = code | np.maximum(place - reach, 0).astype(np.uint64)
    high = code | np.minimum(place + reach, 0xFFFF).astype(np.uint64)
    at = np.searchsorted(known, low)
    return np.append(known, ~np.uint64(0))[at] <= high


def _in(code: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are among sorted known ones."""
    if not len(known):
        return np.zeros(len(code), bool)
    return known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code


def _join_all(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins x[k] and y[k]. parent names each line's root."""
    some = parent[x] != parent[y]
    if not some.any():
        return

    def root(i: int) -> int:
        while (p := int(parent[i])) != i:
            parent[i] = i = int(parent[p])
        return i

    for i, j in zip(x[some].tolist(), y[some].tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    while not np.array_equal(up := parent[parent], parent):
        parent[:] = up


def stars(lines: list[str], parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, line) for the lines of each group of several but its centre: that of the smallest digest, which is the
    root of its component if that is the group alone."""
    size = np.bincount(parent, minlength=len(parent))
    some = np.nonzero(size[parent] > 1)[0]
    order = sorted(some.tolist(), key=lambda i: digest(lines[i]))
    centre: dict[int, int] = {}
    out = [(c, i) for i in order if (c := centre.setdefault(int(parent[i]), i)) != i]
    return np.array([c for c, _ in out], np.int64), np.array([i for _, i in out], np.int64)


def first_places(found: DataFrame, classes: DataFrame, rows: int, degree: DataFrame | None = None) -> DataFrame:
    """(doc_id, of, line, digest, keep_doc, keep_line) of the found lines whose class has more than one place: keep is
    the first one. classes has (node, root) for digests that are linked; equal digests are one class anyway. Columns
    that degree has for linked digests follow."""
    counts = staged(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    some = counts.select("digest").union(classes.select("node")).distinct().withColumn("__some", F.lit(True))
    hits = lookup(found.select("doc_id", "of", "line", "digest"), staged(some, "some"), ["digest"], rows, "inner", counts)
    hits = staged(hits.drop("__some"), "hits")
    first = hits.groupBy("digest").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    roots = first.join(classes.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    roots = staged(roots, "roots")
    keeper = roots.groupBy("root").agg(F.min("first").alias("keep"))
    named = roots.join(keeper, "root").select("digest", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line").alias("keep_line"))
    if degree is not None:
        named = named.join(degree, "digest", "left")
    return lookup(hits, staged(named, "classes"), ["digest"], rows, "inner", counts)


def near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, of, line, digest, keep_doc, keep_line, n_links): each line whose class has more than one place; the
    class's first line; the links of the line's text.

    A line is to be removed if it isn't the first of its class. Null text and blank lines give no rows; rows repeated
    under one doc_id with one text are one document.
    """
    ready(docs.sparkSession)
    own = id_text(docs, id_col, text_col)
    found = staged(occurrences(own), "occurrences")
    n, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    linked = staged(links(own, 1 + size // BUCKET), "links")
    classes = components(linked.where("b is not null").select("a", "b"))
    degree = linked.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("n_links"))
    return first_places(found, classes, n, degree)


def _per_document(found: DataFrame) -> DataFrame:
    gone = ~(F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("line") == F.col("keep_line")))
    return found.groupBy("doc_id", "of").agg(
        F.collect_set(F.when(gone, F.col("line"))).alias("drop"),
        F.sum("n_links").alias("n_links"),
        F.min("keep_doc").alias("keep_doc"),
    )


def _without(text: str, drop: list[int]) -> str:
    gone = set(drop)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id, n_lines, n_removed, n_links, kept_sha256.

    class_id is the smallest doc_id that holds the first line of a class of one of its lines, its own for a document
    without lines. n_links sums, over its lines, the different texts linked to each. kept_sha256 is that of the text
    without the removed lines. Repeated rows give a row each.
    """
    found = near_lines(docs, id_col, text_col)
    info = _per_document(found)
    own = _keyed(id_text(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("class_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_links", pa.int64()), ("kept_sha256", pa.string())])
        for b in slices(batches):
            drop, text = [d or [] for d in b.column("drop").to_pylist()], b.column("text").to_pylist()
            kept = [hashlib.sha256((_without(t, d) if d else t).encode()).hexdigest() for t, d in zip(text, drop, strict=True)]
            n = [sum(map(bool, map(str.strip, t.split("\n")))) for t in text]
            yield batch(schema, b.column("doc_id"), b.column("class_id"), n, [len(d) for d in drop], b.column("n_links"), kept)

    joined = _join(own, info, ["doc_id", "of"], ["drop", "n_links", "keep_doc"], "left")
    # No first line of a class stands behind another one of it.
    joined = joined.select("doc_id", "text", "drop", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.least("keep_doc", "doc_id").alias("class_id"))
    return joined.mapInArrow(run, "doc_id bigint, class_id bigint, n_lines bigint, n_removed bigint, n_links bigint, kept_sha256 string")


def _kept(text: pd.Series, drop: pd.Series) -> pd.Series:
    """Texts without the lines of the given numbers; null if no line, or only blank ones, are left, and for null."""
    left = [None if t is None else _without(t, d) for t, d in zip(text, drop, strict=True)]
    return pd.Series([t if t and t.strip() else None for t in left], dtype=object)


def remove_lines(docs: DataFrame) -> DataFrame:
    """docs without lines that aren't the first of their class; a document of which no line is left goes.

    Documents without any line, null ones among them, stay as they are. A column n_chars gets the new length.
    """
    info = _per_document(near_lines(docs)).where(F.size("drop") > 0)
    free = free_names(docs, "of", "drop", "new", "id")
    own = docs.withColumn(free["id"], F.col("doc_id").cast("long")).withColumn(free["of"], F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    info = info.select(F.col("doc_id").alias(free["id"]), F.col("of").alias(free["of"]), F.col("drop").alias(free["drop"]))
    joined = _join(own, info, [free["id"], free["of"]], [free["drop"]], "left")
    gone = F.col(free["drop"])
    # Not deterministic, so that the filter doesn't run it a second time. Only texts that change go to Python.
    kept = F.pandas_udf(_kept, T.StringType()).asNondeterministic()
    joined = joined.withColumn(free["new"], kept(F.when(gone.isNotNull(), F.col("text").cast("string")), gone))
    joined = joined.where(gone.isNull() | F.col(free["new"]).isNotNull()).withColumn(free["new"], F.when(gone.isNull(), F.col("text")).otherwise(F.col(free["new"])))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col(free["new"]).alias("text"))
        elif c == "n_chars":
            cols.append(F.when(gone.isNull(), F.col("n_chars")).otherwise(F.length(free["new"])).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            cols.append(F.col(f"`{c}`"))
    return joined.select(*cols)
