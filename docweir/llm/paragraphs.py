"""Substring de-duplication by paragraph MinHash banding.

A paragraph is a line that isn't blank, stripped. Paragraphs are near-duplicates from a Jaccard similarity of
`similarity` of their sets of five-word shingles (words: runs without ASCII white space, ASCII letters lowered). Those
of fewer than five words have one shingle, the whole. `tune` picks the cheapest banding whose recall at that
similarity reaches `recall`; paragraphs that collide in a band are fetched, verified by exact Jaccard (or by edit
distance, to `tau`, if that is asked for), and joined by components. All but the first paragraph of a component, by
doc_id and line, are removed.

1. Band keys travel in packed blocks, dealt to buckets of bounded size; keys of different paragraphs stay.
2. Their texts are fetched, once for each team of keys, and compared; pairs that others have joined already are not.
   Under a key of many paragraphs, those are compared that share one of their rarest shingles, as all similar ones do.
3. Components, first places, removal.

A passage inside a longer paragraph is no paragraph of its own, and no similarity of wholes tells it. So, with
`passage`, runs of that many words or more, whatever their case, marks and lines, are then looked for in the text that
is left: every window of `passage` words that stands at an earlier place too goes, so that maximal runs go. A window
holds, as its smallest hash, a shorter one (an anchor) that each copy of it has as well. Anchors that repeat are found
first; only windows around one are compared, by 64-bit hashes, and none that repeats is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import _join, batch, forget, id_text, ready, slices, staged, tidy
from docweir.llm.components import components
from docweir.llm.edits import within
from docweir.llm.hashing import Words, dealt, mixed, smallest
from docweir.llm.lines import BUCKET, _in, _join_all, _keyed, _MET, _teams, buckets_of, digest, filter_of, first_places, held_in, lines_of, occurrences, short, stars, team_chunks, unpacked_all, wanted_texts

SIMILARITY = 0.8
WIDTH = 5
RECALL = 0.998
#: Words of a passage that the query looks for.
PASSAGE = 30
#: Under a key of more paragraphs than this, pairs are found by rare shingles. Pairs that are compared together there.
MANY, PAIRS = 64, 1 << 14
#: Words of 64 bits that tell a paragraph's shingles apart before they are looked up.
BITS = 8
#: The bytes of a row of a block: key and id; an anchor's key and whether it repeats.
ROW, ANCHOR = (6, 6), (6,)


def tune(similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows) with the fewest bands whose recall at `similarity` is high enough; three rows at least, for
    unlike paragraphs not to collide, unless that would need more than 64 bands."""
    for rows in (3, 2, 1):
        for bands in range(1, 65):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding reaches this recall")


def _band_keys(lines: list[str], width: int, bands: int, rows: int) -> np.ndarray:
    """(band, line) keys of 48 bits."""
    seeds = np.random.default_rng(4).integers(1, 2**63, (bands * rows, 2), dtype=np.uint64) | np.uint64(1)
    who, h = Words(lines, lower=True).shingles(width)
    first = np.searchsorted(who, np.arange(len(lines)))
    out = np.empty((bands, len(lines)), np.uint64)
    for band in range(bands):
        key = np.full(len(lines), band + 1, np.uint64)
        for a, c in seeds[band * rows : band * rows + rows]:
            x = h * a
            key = mixed(key ^ np.minimum.reduceat((x ^ (x >> np.uint64(31))) * c, first))
        out[band] = key >> np.uint64(16)
    return out


def collisions(docs: DataFrame, width: int, bands: int, rows: int, buckets: int) -> DataFrame:
    """(key, id, role): paragraphs that share a band with a different one; the role says nothing."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("body", pa.binary())])
        for b in slices(batches):
            own = list({s: None for t in b.column(0).to_pylist() for _, s in lines_of(t)})
            if own:
                ident = np.array([short(digest(s)) for s in own], np.int64)
                key = _band_keys(own, width, bands, rows).ravel()
                blocks = list(dealt(key, buckets, *zip((key, np.tile(ident, bands)), ROW, strict=True)))
                yield batch(schema, [k for k, _ in blocks], [x for _, x in blocks])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for body in buckets_of(batches):
            key, ident = unpacked_all(body, ROW)
            order = np.lexsort((ident, key))
            key, ident = key[order].astype(np.int64), ident[order].view(np.int64)
            # Copies of a paragraph, one from each batch of documents, stand together.
            one = np.concatenate([[True], (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])])
            key, ident = key[one], ident[one]
            same = key[1:] == key[:-1]
            ok = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            yield batch(_MET, key[ok], ident[ok], np.zeros(int(ok.sum()), np.int8))
        tidy()

    own = docs.select("text").mapInArrow(sign, "bucket bigint, body binary")
    return own.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "key bigint, id bigint, role tinyint")


def joined_texts(key: np.ndarray, text: list[str], similarity: float, width: int, tau: int | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of rows (key, paragraph), sorted by key: (distinct paragraphs, stars of what near pairs under a key join). Pairs
    that are joined already aren't compared."""
    lines = sorted(set(text))
    place = {s: i for i, s in enumerate(lines)}
    row = np.array([place[s] for s in text], np.int64)
    who, h = Words(lines, lower=True).shingles(width)
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    one = np.concatenate([[True], (who[1:] != who[:-1]) | (h[1:] != h[:-1])])[: len(who)]
    who, h = who[one], h[one]
    size = np.bincount(who, minlength=len(lines))
    first = np.cumsum(size) - size
    line_code = np.uint64(0x9E3779B97F4A7C15)
    known = np.sort(mixed(h + who.astype(np.uint64) * line_code))
    parent = np.arange(len(lines))
    flat = np.zeros(len(lines) * BITS, np.uint64)
    np.bitwise_or.at(flat, who * BITS + (h >> np.uint64(6)).astype(np.int64) % BITS, np.uint64(1) << (h & np.uint64(63)))
    flags = flat.reshape(-1, BITS)

    def may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the shingles that x has for sure and y hasn't leave enough for the similarity."""
        apart = np.zeros(len(x), np.int64)
        for i in range(BITS):
            apart += np.bitwise_count(flags[x, i] & ~flags[y, i])
        both = size[x] - apart
        return both / np.maximum(1, size[x] + size[y] - both) >= similarity

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = size[x]
        pair = np.repeat(np.arange(len(x)), n)
        at = np.repeat(first[x] - (np.cumsum(n) - n), n) + np.arange(len(pair))
        both = np.bincount(pair[_in(mixed(h[at] + y[pair].astype(np.uint64) * line_code), known)], minlength=len(x))
        good = both / np.maximum(1, n + size[y] - both) >= similarity
        if tau is not None:
            good |= [ok or within(lines[i], lines[j], tau) for ok, i, j in zip(good.tolist(), x.tolist(), y.tolist(), strict=True)]
        return good

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        some = parent[x] != parent[y]
        if tau is None:
            some &= np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])
        x, y = x[some], y[some]
        x, y = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
        step = max(1, (1 << 20) // max(1, int(size[x].max(initial=1))))
        for i in range(0, len(x), step):
            p, q = x[i : i + step], y[i : i + step]
            if tau is None:
                some = (parent[p] != parent[q]) & may(p, q)
                p, q = p[some], q[some]
            good = near(p, q)
            _join_all(parent, p[good], q[good])

    start = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
    length = np.diff(np.append(start, len(key)))
    # Rare shingles say nothing of edits.
    many = (length > MANY) & (tau is None)
    at = np.nonzero(np.repeat(~many, length))[0]
    for d in range(1, int(length[~many].max(initial=0))):
        at = at[at + d < len(key)]
        at = at[key[at + d] == key[at]]
        compare(row[at], row[at + d])
    for g in np.nonzero(many)[0].tolist():
        mine = np.unique(row[start[g] : start[g] + length[g]])
        n = size[mine]
        at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        for x, y in _sharing(np.repeat(mine, n), h[at], n, similarity):
            compare(x, y)
    return lines, *stars(lines, parent)


def _sharing(who: np.ndarray, h: np.ndarray, size: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of paragraphs, some PAIRS together, that hold all whose similarity is enough, of their sorted (paragraph,
    shingle) and the paragraphs' numbers of shingles. A paragraph's shingles that aren't its rarest ones here are too few
    for what must be common to both, so similar ones share one of the others."""
    _, token, often = np.unique(h, return_inverse=True, return_counts=True)
    order = np.lexsort((token, often[token], who))
    rank = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
    reach = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    some = order[rank < np.repeat(reach, size)]
    some = some[np.argsort(token[some], kind="stable")]
    who, token = who[some], token[some]
    held: list[np.ndarray] = []
    at, d = np.arange(len(who)), 0
    while len(at) or held:
        d += 1
        at = at[at + d < len(who)]
        at = at[token[at + d] == token[at]]
        held.append(who[at] << 32 | who[at + d])
        if not len(at) or sum(map(len, held)) >= PAIRS:
            pair = np.unique(np.concatenate(held))
            held = []
            for i in range(0, len(pair), PAIRS):
                yield pair[i : i + PAIRS] >> 32, pair[i : i + PAIRS] & 0xFFFFFFFF


def near_links(docs: DataFrame, buckets: int = 1, similarity: float = SIMILARITY, width: int = WIDTH, recall: float = RECALL, tau: int | None = None) -> DataFrame:
    """(a, b): digests of paragraphs that are near-duplicates, enough of them to join what all join."""
    met = staged(collisions(docs, width, *tune(similarity, recall), buckets), "collisions")
    forget(docs.sparkSession)
    texts = wanted_texts(docs, met.select("id").distinct())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        for key, line in team_chunks(batches):
            lines, x, y = joined_texts(key, line, similarity, width, tau)
            yield batch(schema, [digest(lines[i]) for i in x.tolist()], [digest(lines[i]) for i in y.tolist()])

    rows = _teams(met).join(texts, "id").select("team", "line", "keys")
    return rows.repartition(buckets, "team").sortWithinPartitions("team").mapInArrow(verify, "a binary, b binary")


def near_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, of, line, digest, keep_doc, keep_line): each paragraph whose class has more than one place, and the
    class's first one. Null and empty texts have none; rows repeated under one id with one text are one document."""
    ready(docs.sparkSession)
    own = id_text(docs, id_col, text_col)
    found = staged(occurrences(own), "occurrences")
    n, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    classes = components(staged(near_links(own, 1 + size // BUCKET, **options), "links"))
    return first_places(found, classes, n)


# ---------------------------------------------------------------------------------------------- passages

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _anchors(own: Words, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, keys of 47 bits): of each window of `passage` words, its shorter window of the smallest hash."""
    half = passage // 2
    reach, span = half + 1, passage - half
    h = own.runs(span)
    # Windows of `passage` words begin at these words.
    whole = own.places() <= (own.count - passage)[own.text]
    low = np.where(whole, smallest(h, reach), np.uint64(0))
    # The largest of the smallest hashes of all windows that a place is in.
    most = ~smallest(~low[::-1], reach)[::-1]
    # Windows before a text's first word are another text's: they hold a place of this one only if they are none.
    at = np.nonzero((most == h) & (own.places() <= (own.count - span)[own.text]))[0]
    return at, h[at] >> np.uint64(17)


def repeated_anchors(docs: DataFrame, passage: int, buckets: int) -> DataFrame:
    """(id): keys of anchors that stand at more than one place of docs' kept texts."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("body", pa.binary())])
        for b in slices(batches, "kept", 2 << 20):
            key, n = np.unique(_anchors(Words(b.column(0).to_pylist(), lower=True, trim=True), passage)[1], return_counts=True)
            blocks = list(dealt(key, buckets, (key << np.uint64(1) | (n > 1).astype(np.uint64), *ANCHOR)))
            yield batch(schema, [k for k, _ in blocks], [x for _, x in blocks])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for body in buckets_of(batches):
            (row,) = unpacked_all(body, ANCHOR)
            row.sort()
            key, first = np.unique(row >> np.uint64(1), return_index=True)
            n = np.diff(np.append(first, len(row)))
            again = np.bitwise_or.reduceat(row & np.uint64(1), first) > 0
            yield pa.RecordBatch.from_arrays([pa.array(key[(n > 1) | again].astype(np.int64))], names=["id"])
        tidy()

    own = docs.select("kept").mapInArrow(sign, "bucket bigint, body binary")
    return own.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "id bigint")


#: What stands for a null doc_id in blocks: as the smallest number it comes first.
_NULL = -(1 << 63)
#: The bytes of a window's row in a block: key, and its place: doc_id, of, at.
WINDOW_ROW = (8, 8, 8, 4)


def _windows_around(b: pa.RecordBatch, bits: np.ndarray, passage: int) -> list[np.ndarray]:
    """[key, doc_id, of, at] of the windows of `passage` words of a batch that hold an anchor in the filter."""
    own, half = Words(b.column(2).to_pylist(), lower=True, trim=True), passage // 2
    at, key = _anchors(own, passage)
    at = at[held_in(bits, key.astype(np.int64))]
    # From `half` words before an anchor to the anchor itself, inside its text.
    cover = np.zeros(len(own.hash) + 1, np.int64)
    np.add.at(cover, np.maximum(own.first[own.text[at]], at - half), 1)
    np.add.at(cover, at + 1, -1)
    place = own.places()
    start = np.nonzero((np.cumsum(cover)[:-1] > 0) & (place <= (own.count - passage)[own.text]))[0]
    doc, of = b.column(0).fill_null(_NULL).to_numpy(), b.column(1).to_numpy()
    return [own.runs(passage)[start], doc[own.text[start]], of[own.text[start]], place[start]]


def _earliest(rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(the earliest row of each key, whether the key has another place)."""
    key, doc, of, at = rows
    order = np.lexsort((at, of, doc, key))
    key, doc, of, at = (c[order] for c in (key, doc, of, at))
    first = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    other = ~first & ((doc != np.roll(doc, 1)) | (of != np.roll(of, 1)) | (at != np.roll(at, 1)))
    at_first = np.nonzero(first)[0]
    again = np.bitwise_or.reduceat(other, at_first) if len(key) else np.empty(0, bool)
    return [c[at_first] for c in (key, doc, of, at)], again


def _window_blocks(rows: list[np.ndarray], buckets: int, *more: tuple[np.ndarray, int]) -> list[tuple[int, bytes]]:
    return list(dealt(rows[0], buckets, *zip((rows[0], *(c.view(np.uint64) for c in rows[1:3]), rows[3]), WINDOW_ROW, strict=True), *more))


def _read_rows(body: list[bytes], *more: int) -> list[np.ndarray]:
    key, doc, of, at, *rest = unpacked_all(body, (*WINDOW_ROW, *more))
    return [key, doc.view(np.int64), of.view(np.int64), at.astype(np.int64), *rest]


def passages(docs: DataFrame, passage: int, buckets: int = 1) -> DataFrame:
    """(doc_id, of, cut, first_id): the first words of windows that repeat an earlier one, in docs (doc_id, of, kept);
    the smallest doc_id that holds the earlier place.

    A pass sends, of each batch of documents, each key's earliest place to the key's bucket, which tells the first
    place of keys that have several. A second one sends the places of such keys; a bucket knows its first places and
    takes blocks of others one by one. So a task holds keys, but never all places of one.
    """
    spark = docs.sparkSession
    anchors = staged(repeated_anchors(docs, passage, buckets), "anchors")
    sent = spark.sparkContext.broadcast(filter_of(anchors))
    block = pa.schema([("bucket", pa.int64()), ("turn", pa.int32()), ("body", pa.binary())])
    row = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("of", pa.int64()), ("at", pa.int32())])

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "kept", 2 << 20):
            rows, again = _earliest(_windows_around(b, sent.value, passage))
            out = _window_blocks(rows, buckets, (again.astype(np.uint64), 1))
            yield batch(block, [k for k, _ in out], [0] * len(out), [x for _, x in out])
        tidy()

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for body in buckets_of(b.select(["bucket", "body"]) for b in batches):
            *rows, again = _read_rows(body, 1)
            (key, doc, of, at), several = _earliest(rows)
            # A key that repeats inside one batch may have come from that batch alone.
            keep = several | _in(key, np.unique(rows[0][again > 0]))
            yield batch(row, key[keep].view(np.int64), doc[keep], of[keep], at[keep])
        tidy()

    own = docs.select("doc_id", "of", "kept")
    kind = "bucket bigint, turn int, body binary"
    found = own.mapInArrow(early, kind).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    firsts = staged(found.mapInArrow(first_of, "key bigint, doc_id bigint, of bigint, at int"), "firsts")
    forget(spark)
    known = spark.sparkContext.broadcast(filter_of(firsts.select(F.col("key").alias("id"))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, doc, of, at = (c.to_numpy() for c in b.columns)
            out = _window_blocks([key.view(np.uint64), doc, of, at.astype(np.int64)], buckets)
            yield batch(block, [k for k, _ in out], [0] * len(out), [x for _, x in out])

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "kept", 2 << 20):
            rows = _windows_around(b, sent.value, passage)
            some = held_in(known.value, rows[0].view(np.int64))
            out = _window_blocks([c[some] for c in rows], buckets)
            yield batch(block, [k for k, _ in out], [1] * len(out), [x for _, x in out])
        tidy()

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("of", pa.int64()), ("at", pa.int32()), ("first_id", pa.int64())])
        bucket, heads, first = None, [], None
        for b in batches:
            for k, turn, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != bucket:
                    bucket, heads, first = k, [], None
                if turn == 0:
                    heads.append(body)
                    continue
                if not heads:
                    continue
                if first is None:
                    first = _read_rows(heads)
                    order = np.argsort(first[0])
                    first = [c[order] for c in first]
                key, doc, of, at = _read_rows([body])
                i = np.minimum(np.searchsorted(first[0], key), len(first[0]) - 1)
                gone = (first[0][i] == key) & ((first[1][i] != doc) | (first[2][i] != of) | (first[3][i] != at))
                ids = [pa.array(x[gone], pa.int64(), mask=x[gone] == _NULL) for x in (doc, first[1][i])]
                yield batch(schema, ids[0], of[gone], at[gone].astype(np.int32), ids[1])
        tidy()

    both = firsts.mapInArrow(pack, kind).union(own.mapInArrow(all_, kind))
    gone = both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "turn").mapInArrow(later, "doc_id bigint, of bigint, at int, first_id bigint")
    return gone.groupBy("doc_id", "of").agg(F.collect_set("at").alias("cut"), F.min("first_id").alias("first_id"))


def without_words(text: str, cut: list[int], passage: int) -> tuple[str, int]:
    """(text without the words of the windows that begin at `cut`, runs gone). Lines of which nothing is left go."""
    spans, runs = [m.span() for m in _WORD.finditer(text)], []
    for at in sorted(cut):
        if runs and at <= runs[-1][1]:
            runs[-1][1] = at + passage
        else:
            runs.append([at, at + passage])
    out, at = [], 0
    for i, j in runs:
        lo, hi = spans[i][0], spans[j - 1][1]
        # Where lines are cut inside, one line end stays between what is left on both sides.
        out += [text[at:lo], "\n" if "\n" in text[lo:hi] else ""]
        at = hi
    left = "".join([*out, text[at:]])
    return "\n".join(x for x in (y.strip() for y in left.split("\n")) if x), len(runs)


# ---------------------------------------------------------------------------------------------- removal


def without(text: str, drop: list[int]) -> str:
    """The text without the lines of these numbers."""
    gone = set(drop)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text


def remove_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = 0, **options) -> DataFrame:
    """One row for each document: doc_id, class_id, n_paragraphs, n_removed, n_passages_removed, kept (the text).

    class_id is the smallest doc_id that holds the first place of a class of one of its paragraphs, or of its passages,
    its own if it has none. Documents without repeats keep their text as it is. Repeated rows give a row each.
    """
    found = near_paragraphs(docs, id_col=id_col, text_col=text_col, **options)
    gone = ~(F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("line") == F.col("keep_line")))
    info = found.where(gone).groupBy("doc_id", "of").agg(F.collect_set("line").alias("drop"), F.min("keep_doc").alias("keep_doc"))
    own = _keyed(id_text(docs, id_col, text_col))
    names = ["doc_id", "of", "class_id", "n_paragraphs", "n_removed", "n_passages_removed"]
    kind = ", ".join(f"{n} bigint" for n in names) + ", kept string"
    schema = pa.schema([*((n, pa.int64()) for n in names), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text, drop = b.column("text").to_pylist(), [d or [] for d in b.column("drop").to_pylist()]
            n = [sum(map(bool, map(str.strip, t.split("\n")))) for t in text]
            yield batch(schema, b.column("doc_id"), b.column("of"), b.column("class_id"), n, [len(d) for d in drop], [0] * len(n), [without(t, d) for t, d in zip(text, drop, strict=True)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "kept"):
            rows = [without_words(t, d, passage) if d else (t, 0) for t, d in zip(b.column("kept").to_pylist(), b.column("cut").to_pylist(), strict=True)]
            yield batch(schema, *(b.column(c) for c in names[:-1]), [n for _, n in rows], [t for t, _ in rows])

    joined = _join(own, info, ["doc_id", "of"], ["drop", "keep_doc"], "left")
    # No first place of a class stands behind another one of it.
    left = joined.select("doc_id", "of", "text", "drop", F.least("keep_doc", "doc_id").alias("class_id")).mapInArrow(run, kind)
    if passage:
        forget(docs.sparkSession)
        left = staged(left, "left")
        size = left.agg(F.coalesce(F.sum(F.octet_length("kept")), F.lit(0))).first()[0]
        left = _join(left, passages(left, passage, 1 + size // (4 * BUCKET)), ["doc_id", "of"], ["cut", "first_id"], "left")
        left = left.withColumn("class_id", F.least("class_id", "first_id")).mapInArrow(cut, kind)
    return left.drop("of")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "class_id", "n_paragraphs", "n_removed", "n_passages_removed", F.sha2("kept", 256).alias("kept_sha256"))
