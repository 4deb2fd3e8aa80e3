"""Removal of repeated byte strings with suffix arrays built by induced sorting.

A byte goes if a `length`-byte string covering it also starts earlier, in any document. All-corpus suffix arrays
don't fit a task, so strings that may be equal are first brought together, exactly:

1. Anchors. In every window of `length` bytes the smallest hash of its `gram`-byte strings is an anchor: equal
   windows have the same anchor at the same place. An anchor's context is all bytes of windows that hold it.
2. Anchors meet by their hash. Where two contexts are equal, all windows of the later one are repeats. Only the first
   of each distinct context, where an anchor has several, needs a closer look: that is where texts part.
3. Shards of such contexts get a suffix array (classify suffixes, sort leftmost-smaller substrings, recurse on their
   names, induce) and permuted common prefixes; windows with a common prefix of `length` with an earlier one go.

An anchor with more than `giant` distinct contexts has its windows dealt out by their own hashes instead, so that no
task gets all of them. In a batch of documents only the first of equal contexts is sent on, whatever its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import batch, forget, gathered, id_text, ready, slices, staged, with_docs, with_end

LENGTH = 100
GRAM = 24
#: Bytes of contexts in a shard, about.
SHARD = 1 << 20
#: Contexts of one anchor beyond which its windows are dealt out: some 1.4 MB of them.
GIANT = 8_000
#: So many giant anchors are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_ANCHORS = 100_000

# ---------------------------------------------------------------------------------------------- anchors

_P = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = 24  # bits of a position in a block
_BLOCK = 1 << 22


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram-byte string."""
    powers, n = {1: _TABLE[data]}, 1
    while n * 2 <= gram:
        h = powers[n]
        powers[2 * n] = h[:-n] * _power(n) + h[n:]
        n *= 2
    out, size = powers[n], n
    while size < gram:
        n = max(k for k in powers if k <= gram - size)
        m = len(data) - size - n + 1
        out, size = out[:m] * _power(n) + powers[n][size : size + m], size + n
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of documents that stand one behind the other and end at `ends`."""
    places, hashes, width = [], [], length - gram + 1
    low = np.uint64((1 << _PLACE) - 1)
    start = np.concatenate([[0], ends[:-1]])
    for at in range(0, max(0, len(data) - length + 1), _BLOCK):
        part = data[at : at + _BLOCK + length - 1]
        h = gram_hashes(part, gram)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        n, least = 1, key
        while n * 2 <= width:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < width:
            least = np.minimum(least[: len(least) - (width - n)], least[width - n :])
        # Windows inside one document: at most length bytes before its end.
        whole = np.zeros(len(least) + 1, np.int8)
        i, j = np.clip(start - at, 0, len(least)), np.clip(ends - length + 1 - at, 0, len(least))
        ok = j > i
        np.add.at(whole, i[ok], 1)
        np.add.at(whole, j[ok], -1)
        p = (least[np.cumsum(whole[:-1]) > 0] & low).astype(np.int64)
        p = p[np.concatenate([[True], p[1:] != p[:-1]])] if len(p) else p
        places.append(p + at)
        hashes.append(h[p])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    p, h = np.concatenate(places), np.concatenate(hashes)
    p, one = np.unique(p, return_index=True)
    return p, h[one]


# ---------------------------------------------------------------------------------------------- suffix arrays


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last suffix is larger than the empty one."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    step[-1] = -1
    known = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    after = np.minimum.accumulate(known[::-1])[::-1]
    return step[after] > 0


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that the order of the leftmost-smaller suffixes (or substrings) induces."""
    n = len(text)
    edge = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
    lms = lms.astype(np.int32)
    by = np.argsort(text[lms], kind="stable")
    own = np.split(lms[by], np.searchsorted(text[lms][by], np.arange(1, symbols)))
    pending: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    pending[text[n - 1]].append(np.array([n - 1], np.int32))
    larger: list[np.ndarray] = [np.empty(0, np.int32)] * symbols

    def deal(scan: np.ndarray, wanted) -> None:
        before = scan[scan > 0] - 1
        ch = text[before]
        ok = wanted(ch)
        before, ch = before[ok], ch[ok]
        if not len(before):
            return
        o = np.argsort(ch, kind="stable")
        before, ch = before[o], ch[o]
        cut = np.concatenate([[0], np.nonzero(ch[1:] != ch[:-1])[0] + 1, [len(ch)]])
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            pending[ch[i]].append(before[i:j])

    for c in range(symbols):
        if edge[c] == edge[c + 1]:
            continue
        parts, wave = [], np.concatenate([np.empty(0, np.int32), *pending[c]])
        while len(wave):  # a run of one symbol induces inside its own bucket
            parts.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~small[before]]
        larger[c] = np.concatenate([np.empty(0, np.int32), *parts])
        deal(np.concatenate([larger[c], own[c]]), lambda ch, c=c: ch > c)
    out = np.empty(n, np.int32)
    pending = [[] for _ in range(symbols)]
    for c in range(symbols - 1, -1, -1):
        if edge[c] == edge[c + 1]:
            continue
        parts, wave = [], np.concatenate([np.empty(0, np.int32), *pending[c]])
        while len(wave):
            parts.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & small[before]]
        smaller = np.concatenate([np.empty(0, np.int32), *parts])
        k = edge[c] + len(larger[c])
        out[edge[c] : k], out[k : edge[c + 1]] = larger[c], smaller[::-1]
        deal(np.concatenate([smaller, larger[c][::-1]]), lambda ch, c=c: ch < c)
    return out


def _ranked(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, by doubling: names are too many for buckets.

    A suffix's rank is where its group of equal prefixes begins in the order; only groups of several are sorted on.
    """
    n, h = len(names), 1
    order = np.argsort(names, kind="stable")
    own = names[order].astype(np.int64)
    rank, slots = np.empty(n, np.int64), np.arange(n)
    while True:
        new = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        several = ~(new & np.append(new[1:], True))
        slots = slots[several]
        if not len(slots):
            return order
        at = order[slots]
        after = at + h
        own = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(own)
        order[slots], own = at[by], own[by]
        h *= 2


def suffix_array(text: np.ndarray, symbols: int = 257) -> np.ndarray:
    """The suffix array of a string of small integers; a suffix that is a prefix of another is the smaller one."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = _types(text)
    lms = np.nonzero(small[1:] & ~small[:-1])[0] + 1
    if not len(lms):
        return _induce(text, small, lms, symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = _induce(text, small, lms, symbols)
    rough = rough[is_lms[rough]]  # leftmost-smaller substrings, sorted
    upto = np.append(lms[1:] + 1, n)
    size = np.zeros(n, np.int32)
    size[lms] = upto - lms
    same = size[rough[1:]] == size[rough[:-1]]
    last = np.zeros(n, bool)
    last[lms[-1]] = True  # it ends with the text, as no other does
    same &= ~(last[rough[1:]] | last[rough[:-1]])
    k, at = 0, np.nonzero(same)[0]
    while len(at):
        at = at[size[rough[at]] > k]
        differ = text[rough[at] + k] != text[rough[at + 1] + k]
        same[at[differ]] = False
        at, k = at[~differ], k + 1
    name = np.zeros(n, np.int32)
    name[rough] = np.concatenate([[0], np.cumsum(~same)])
    order = _ranked(name[lms])
    return _induce(text, small, lms[order], symbols)


def common_prefixes(text: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Permuted: for each position, the common prefix with the suffix before it in the array, inside their pieces.

    ends has each position's piece's end. Only positions whose left neighbours differ are compared; any other one's
    value is one less than that of the position before.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    at = np.arange(n, dtype=np.int32)
    has = before >= 0
    prior = np.maximum(before, 0)
    inside = has & (at > 0) & (before > 0)
    plain = np.zeros(n, bool)
    i = np.nonzero(inside)[0]
    # The neighbours to the left must be each other's neighbours in the array as well, or they are compared anew.
    plain[i] = (text[i - 1] == text[before[i] - 1]) & (text[i - 1] != 0) & (before[i - 1] == before[i] - 1)
    todo = np.nonzero(has & ~plain)[0]
    room = np.minimum(ends[todo] - todo, ends[prior[todo]] - prior[todo])
    found = np.zeros(n, np.int32)
    k = 0
    while len(todo):
        ok = room > k
        todo, room = todo[ok], room[ok]
        equal = text[todo + k] == text[before[todo] + k]
        found[todo[equal]] = k + 1
        todo, room = todo[equal], room[equal]
        k += 1
    lead = np.maximum.accumulate(np.where(~plain, at, np.int32(0)))
    return np.maximum(found[lead] - (at - lead), 0)


def repeats(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows of the pieces that also start earlier in them. A piece is bytes of doc from start on."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.zeros(int(size.sum()) + len(pieces), np.int16)
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text[:] = raw.astype(np.int16) + 1
    text[first + size] = 0
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), size + 1)
    ends = (first + size).astype(np.int32)[piece]
    order = suffix_array(text)
    long = common_prefixes(text, order, ends)[order] >= length
    run = np.cumsum(~long)
    many = long | np.append(long[1:], False)
    at, run = order[many], run[many]
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    d, s = doc[piece[at]], start[piece[at]] + at - first[piece[at]]
    o = np.lexsort((s, d, run))
    d, s, run = d[o], s[o], run[o]
    head = np.concatenate([[True], run[1:] != run[:-1]])
    k = np.maximum.accumulate(np.where(head, np.arange(len(run)), 0))
    later = (d != d[k]) | (s != s[k])
    return d[later], s[later]


def joined(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, united where they overlap or touch."""
    if not len(doc):
        return doc, lo, hi
    o = np.lexsort((lo, doc))
    doc, lo, hi = doc[o], lo[o], hi[o]
    # The furthest end so far, inside a document: ends are shifted so that a later document's are larger.
    group = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    far = np.maximum.accumulate(hi + group * (1 << 40)) - group * (1 << 40)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > far[:-1])])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], far[last]


# ---------------------------------------------------------------------------------------------- the corpus

_ROW = "h bigint, ctx bigint, doc bigint, at bigint"


def _scan(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, ctx, doc, at): the first of each context of a batch, at = position, bytes to the left, to the right;
    or, with at = -1, spans of other ones: ctx = first << 32 | end."""
    names = ["h", "ctx", "doc", "at"]
    for b in slices(batches, most=8 << 20):
        pairs = sorted((d, t) for d, t in zip(b.column(0).to_pylist(), (t.encode() for t in b.column(1).to_pylist()), strict=True) if len(t) >= length)
        if not pairs:
            continue
        ids = np.array([d for d, _ in pairs], np.int64)
        size = np.array([len(t) for _, t in pairs], np.int64)
        ends = np.cumsum(size)
        raw = b"".join(t for _, t in pairs)
        p, h = anchors(np.frombuffer(raw, np.uint8), ends, length, gram)
        k = np.searchsorted(ends, p, side="right")
        begin = (ends - size)[k]
        lo, hi = np.maximum(p + gram - length, begin), np.minimum(p + length, ends[k])
        left, right = p - lo, hi - p
        f = xxhash.xxh3_64_intdigest
        ctx = np.array([f(raw[i:j], s) for i, j, s in zip(lo.tolist(), hi.tolist(), (left * 1024 + right).tolist(), strict=True)], np.uint64)
        # Documents are in order, so the first row of a context is its earliest, but for repeats of one doc_id. As
        # everywhere, contexts are equal if both their anchor's hash and their own are.
        order = np.lexsort((h, ctx))
        new = np.concatenate([[True], (ctx[order][1:] != ctx[order][:-1]) | (h[order][1:] != h[order][:-1])])[: len(p)]
        lead = np.empty(len(p), np.int64)
        lead[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
        first = lead == np.arange(len(p))
        again = ~first & ((ids[k] != ids[k[lead]]) | (p - begin != p[lead] - begin[lead]))
        at = (p - begin) << 20 | left << 10 | right
        d, i, j = joined(ids[k][again], (lo - begin)[again], (hi - begin)[again])
        mixed = d * np.int64(-7046029254386353131)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[first].view(np.int64), mixed])), pa.array(np.concatenate([ctx[first].view(np.int64), i << 32 | j])), pa.array(np.concatenate([ids[k][first], d])), pa.array(np.concatenate([at[first], np.full(len(d), -1)]))], names=names)


_FOUND = "doc bigint, lo bigint, hi bigint, h bigint, open boolean"


def _settle(batches: Iterator[pa.RecordBatch], closed: bool = False) -> Iterator[pa.RecordBatch]:
    """Sorted rows of _scan: spans of contexts seen before, and, open, the first of contexts that share an anchor."""

    names = ["doc", "lo", "hi", "h", "open"]
    held: list[np.ndarray] = [np.empty(0, np.int64)] * 4
    lead: tuple | None = None  # the last group's anchor, whether it has been told, its first row, its context's first row
    for b in with_end(gathered(batches)):
        if b is not None:
            held = [np.concatenate([x, y]) for x, y in zip(held, b, strict=True)]
        h, ctx, doc, at = held
        if not len(h):
            continue
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        # A group that may go on is held back, unless it is long: then it is cut at a context, and its lead kept.
        cut = len(h) if b is None else int(np.nonzero(new_h)[0][-1])
        if not cut and len(h) > 1_000_000:
            cut = len(h)
        if not cut:
            continue
        held = [x[cut:] for x in held]
        h, ctx, doc, at = h[:cut], ctx[:cut], doc[:cut], at[:cut]
        new_h = new_h[:cut]
        new_c = new_h | np.concatenate([[True], ctx[1:] != ctx[:-1]])
        if lead is not None and lead[0] == h[0]:
            new_h[0] = False
            new_c[0] = lead[1] != ctx[0]
        i = np.arange(cut)
        head = np.maximum.accumulate(np.where(new_c, i, -1))
        d0 = np.where(head < 0, lead[2] if lead else 0, doc[np.maximum(head, 0)])
        a0 = np.where(head < 0, lead[3] if lead else 0, at[np.maximum(head, 0)])
        span = at < 0
        pos, left, right = at >> 20, at >> 10 & 1023, at & 1023
        again = ~span & ~new_c & ((doc != d0) | (at != a0))
        group = np.cumsum(new_h)
        first = new_c & ~span
        several = np.bincount(group[first], minlength=group[-1] + 1) > 1
        carried = lead is not None and lead[0] == h[0] and not new_h[0]
        if carried:
            several[group[0]] |= lead[4] or bool(first[group == group[0]].any())
        open_ = first & several[group] if not closed else np.zeros(cut, bool)
        out = [(doc[span], ctx[span] >> 32, ctx[span] & 0xFFFFFFFF, h[span], np.zeros(int(span.sum()), bool))]
        d, lo, hi = joined(doc[again], (pos - left)[again], (pos + right)[again])
        out.append((d, lo, hi, np.zeros(len(d), np.int64), np.zeros(len(d), bool)))
        out.append((doc[open_], at[open_], at[open_], h[open_], np.ones(int(open_.sum()), bool)))
        if carried and not lead[4] and several[group[0]] and not closed:
            # The group turned out to have several contexts after its first part was let go with one.
            out.append((np.array([lead[2]]), np.array([lead[3]]), np.array([lead[3]]), h[:1], np.array([True])))
        told = bool(several[group[-1]])
        lead = (h[-1], ctx[-1], d0[-1], a0[-1], told)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("ctx", pa.binary())])
    for b in slices(batches):
        rows = []
        for d, text, which in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("open").to_pylist(), strict=True):
            raw = text.encode()
            for w in which:
                if not w["giant"]:
                    pos, at = w["at"] >> 20, w["at"]
                    lo = pos - (at >> 10 & 1023)
                    rows.append((w["h"], d, lo, raw[lo : pos + (at & 1023)]))
        yield batch(schema, *([r[i] for r in rows] for i in range(4)))


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows as of _scan, one for each window of a giant anchor's contexts, by the window's own hashes."""
    names, f = ["h", "ctx", "doc", "at"], xxhash.xxh3_128_intdigest
    for b in slices(batches):
        hashes, doc, start = [], [], []
        for d, text, which in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("open").to_pylist(), strict=True):
            raw = text.encode()
            for w in which:
                if w["giant"]:
                    pos, at = w["at"] >> 20, w["at"]
                    own = range(pos - (at >> 10 & 1023), pos + (at & 1023) - length + 1)
                    hashes += [f(raw[i : i + length]) for i in own]
                    start += own
                    doc += [d] * len(own)
        low = np.array([x & 0xFFFFFFFFFFFFFFFF for x in hashes], np.uint64).view(np.int64)
        high = np.array([x >> 64 for x in hashes], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(np.array(doc, np.int64)), pa.array(np.array(start, np.int64) << 20 | length)], names=names)


def _shards(batches: Iterator[pa.RecordBatch], length: int, shard: int) -> Iterator[pa.RecordBatch]:
    """Sorted by h: whole groups are gathered into shards, and each shard's repeats told as spans."""
    names = ["doc", "lo", "hi"]
    pieces: list[bytes] = []
    doc: list[int] = []
    start: list[int] = []
    total, last = 0, None

    def told() -> pa.RecordBatch:
        d, s = repeats(pieces, np.array(doc, np.int64), np.array(start, np.int64), length)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in joined(d, s, s + length)], names=names)

    for b in batches:
        for h, d, s, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if total > shard and h != last:
                yield told()
                pieces, doc, start, total = [], [], [], 0
            pieces.append(c)
            doc.append(d)
            start.append(s)
            total, last = total + len(c), h
    if pieces:
        yield told()


def _unique_ids(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs (doc_id, text) if ids are unique and not null, else with ids that number (doc_id, text) in order."""
    n, d = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == d:
        return docs.withColumn("own_id", F.col("doc_id")), True
    keyed = docs.withColumn("of", F.sha2(F.col("text").cast("binary"), 256))
    order = keyed.select("doc_id", "of").distinct().repartitionByRange("doc_id", "of").sortWithinPartitions("doc_id", "of")
    order = staged(order.withColumn("n", F.monotonically_increasing_id()), "order")
    k = order.select(F.col("doc_id").alias("__d"), F.col("of").alias("__o"), "n")
    out = keyed.join(k, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("of") == F.col("__o")))
    return staged(out.select(F.col("n").alias("doc_id"), "text", F.col("doc_id").alias("own_id")), "numbered"), False


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, giant: int = GIANT) -> DataFrame:
    """(doc, lo, hi): spans of bytes to remove, overlapping ones not united. docs has unique ids in doc_id."""
    spark = ready(docs.sparkSession)
    rows = docs.select("doc_id", "text").mapInArrow(lambda it: _scan(it, length, gram), _ROW)
    rows = rows.repartition("h").sortWithinPartitions("h", "ctx", "doc", "at")
    found = staged(rows.mapInArrow(_settle, _FOUND), "anchors")
    forget(spark)
    opened = found.where("open").select("doc", F.col("lo").alias("at"), "h")
    large = staged(opened.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > giant).select(F.col("h").alias("large")), "giants")
    big = large.count()
    if big:
        flag = F.broadcast(large) if big <= BROADCAST_ANCHORS else large
        opened = opened.join(flag, F.col("h") == F.col("large"), "left").select("doc", "at", "h", F.col("large").isNotNull().alias("giant"))
    else:
        opened = opened.withColumn("giant", F.lit(False))
    by = opened.groupBy("doc").agg(F.collect_list(F.struct("h", "at", "giant")).alias("open"))
    with_open = docs.select("doc_id", "text").join(by, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "open")
    contexts = with_open.mapInArrow(_contexts, "h bigint, doc bigint, start bigint, ctx binary")
    contexts = contexts.repartition("h").sortWithinPartitions("h")
    closer = contexts.mapInArrow(lambda it: _shards(it, length, shard), "doc bigint, lo bigint, hi bigint")
    if big:
        windows = with_open.mapInArrow(lambda it: _windows(it, length), _ROW).repartition("h", "ctx").sortWithinPartitions("h", "ctx", "doc", "at")
        closer = closer.unionByName(windows.mapInArrow(lambda it: _settle(it, True), _FOUND).select("doc", "lo", "hi"))
    closer = staged(closer, "repeats")
    forget(spark)
    return found.where("not open").select("doc", "lo", "hi").unionByName(closer)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, giant: int = GIANT) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): one row for each row of docs; removed are maximal spans of bytes, kept the rest.

    Null text is empty; texts of fewer than `length` bytes stay whole. Rows repeated with one id and text are one
    document; different texts under one id are taken as documents of their own, in the order of their digests; null
    ids come first. kept may cut characters in two: it is binary.
    """
    ready(docs.sparkSession)
    own, _ = _unique_ids(id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")))
    spans = repeated_spans(own, length, gram, shard, giant)
    by = spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).withColumnRenamed("doc", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", span), ("kept", pa.binary())])
        for b in slices(batches):
            sizes, removed, kept = [], [], []
            for text, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                lo, hi = np.array([x["lo"] for x in s or []], np.int64), np.array([x["hi"] for x in s or []], np.int64)
                _, lo, hi = joined(np.zeros(len(lo), np.int64), lo, hi)
                edge = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(raw)]
                sizes.append(len(raw))
                removed.append([{"lo": i, "hi": j} for i, j in zip(lo.tolist(), hi.tolist(), strict=True)])
                kept.append(b"".join(raw[i:j] for i, j in zip(edge[::2], edge[1::2], strict=True)))
            yield batch(schema, b.column("own_id"), sizes, removed, kept)

    return with_docs(own, by).select("own_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, removed array<struct<lo:bigint,hi:bigint>>, kept binary")


def repeat_digests(found: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

