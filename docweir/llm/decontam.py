"""Decontamination: a hash set of normalised benchmark n-grams is broadcast, document windows are looked up in it.

Words are [0-9a-z] and non-ASCII characters after lowering A-Z. Only words of the benchmark get a code; a window
is a candidate if its rolling hash is in the set, and a hit if its codes are equal, word by word. The set is built
from blocks of at most `block_words` benchmark words, chosen by a hash of the item id, so that what is broadcast is
bounded whatever the benchmark's size; several blocks mean several scans, whose hits are united.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import batch, free_names, id_text, ready, slices, staged

WINDOW = 10
#: Benchmark words in a block, about: some 100 MB in the driver and in a worker.
BLOCK_WORDS = 500_000

#: A-Z to a-z, other ASCII but digits and letters to space; UTF-8 bytes of other characters stay.
NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Windows:
    """The windows of some benchmark items: word codes, and by window length the hashes and what they stand for."""

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        self.codes: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            w = [self.codes.setdefault(x, len(self.codes) + 1) for x in words(text)]
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                found.setdefault(tuple(w[i : i + n]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[tuple[tuple[int, ...], set]]]] = {}
        for n in sorted({len(k) for k in found}):
            own = [(k, v) for k, v in found.items() if len(k) == n]
            h = self._hash(np.array([k for k, _ in own], np.uint64))
            order = np.argsort(h, kind="stable")
            self.by_length[n] = (h[order], [own[i] for i in order.tolist()])

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for i in range(codes.shape[1]):
            h = (h + codes[:, i]) * _P
        return h

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set]]:
        """For each text: how many words it has, which are hit, and the items that occur in it."""
        get = self.codes.get
        split = [t.translate(NORMAL).split() for t in texts]
        ends = np.cumsum([0, *map(len, split)])
        code = np.zeros(ends[-1], np.uint64)
        for s, i in zip(split, ends.tolist(), strict=False):
            code[i : i + len(s)] = [get(w, 0) for w in s]
        doc = np.repeat(np.arange(len(texts)), np.diff(ends))
        hit = np.zeros(len(code), bool)
        items: dict[int, set] = {}
        h = np.zeros(len(code), np.uint64)
        alive = code > 0
        longest = max(self.by_length, default=0)
        for n in range(1, longest + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = (h[:m] + code[n - 1 :]) * _P
            alive = alive[:m] & (code[n - 1 :] > 0)
            if n not in self.by_length:
                continue
            hashes, own = self.by_length[n]
            at = np.nonzero(alive)[0]
            at = at[doc[at] == doc[at + n - 1]]
            k = np.searchsorted(hashes, h[at])
            ok = (k < len(hashes)) & (hashes[np.minimum(k, len(hashes) - 1)] == h[at])
            for i, j in zip(at[ok].tolist(), k[ok].tolist(), strict=True):
                seen = tuple(code[i : i + n].tolist())
                while j < len(hashes) and hashes[j] == h[i]:
                    if own[j][0] == seen:
                        hit[i : i + n] = True
                        items.setdefault(int(doc[i]), set()).update(own[j][1])
                    j += 1
        for d, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            yield j - i, hit[i:j], items.get(d, set())


_built: dict[str, Windows] = {}


def _windows(name: str, items: list[tuple[object, str | None]], window: int) -> Windows:
    """The windows of a block, built once in a worker, which keeps those of the last block that it had to do with."""
    if name not in _built:
        _built.clear()
        _built[name] = Windows(items, window)
    return _built[name]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[Callable[[], list[tuple[object, str | None]]]]:
    """Functions that fetch a block each: block_words words, about, and one item's at least."""
    rows = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // (6 * block_words)
    for k in range(n):
        yield lambda k=k: [(r["item"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect()]


def _marked(docs: DataFrame, benchmark: DataFrame, text_col: str, window: int, block_words: int, item_col: str, item_text: str) -> tuple[DataFrame, str, str, str]:
    """docs with, under names that clash with none of its columns: the words' count, the hit words as packed bits, the items.

    A pass over docs for each block; between passes docs are written to the shared folder, so that one block's set is
    in memory at a time.
    """
    spark = ready(docs.sparkSession)
    count, bits, items = free_names(docs, "words", "bits", "items").values()
    out = docs.withColumn(count, F.lit(0).cast("long")).withColumn(bits, F.lit(b"")).withColumn(items, F.array().cast("array<string>"))
    schema = out.schema
    blocks = list(_blocks(benchmark, item_col, item_text, block_words))
    for nth, block in enumerate(blocks):
        sent, name = spark.sparkContext.broadcast(block()), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            found = _windows(name, sent.value, window)
            for b in slices(batches, text_col):
                at = {n: b.schema.get_field_index(n) for n in (text_col, count, bits, items)}
                n, packed, which = [], [], []
                for (k, hit, ids), old, before in zip(found.scan([(t or "").encode() for t in b.column(at[text_col]).to_pylist()]), b.column(at[bits]).to_pylist(), b.column(at[items]).to_pylist(), strict=True):
                    if old:
                        hit = hit | np.unpackbits(np.frombuffer(old, np.uint8), count=k).astype(bool)
                    n.append(k)
                    packed.append(np.packbits(hit).tobytes() if hit.any() else b"")
                    which.append(sorted({*before, *(str(i) for i in ids if i is not None)}))
                columns = list(b.columns)
                for c, v in ((count, n), (bits, packed), (items, which)):
                    columns[at[c]] = pa.array(v, b.schema.field(at[c]).type)
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

        out = out.mapInArrow(run, schema)
        if nth + 1 < len(blocks):
            out = staged(out, "scanned")
            sent.destroy()
    return out, count, bits, items


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool) if packed else np.zeros(n, bool)


def _runs(hit: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of True."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, hits, items) for each row of docs.

    hits are the hit words as runs (first, end) of word positions; items are the ids, as sorted strings, of which a
    window occurs. An item of fewer than `window` words is one window; one without words, or null, is none. An item
    without an id hits words, but can't be named. Null text has no words. Repeated rows are scanned each on its own. Empty tables give no rows (documents) or no hits
    (benchmark).
    """
    own = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    out, count, bits, items = _marked(own, benchmark, "text", window, block_words, item_col, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
        for b in batches:
            hits = [[{"first": i, "end": j} for i, j in _runs(_bits(p, n)).tolist()] for n, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield batch(schema, b.column(0), b.column(1), hits, b.column(3))

    return out.select("doc_id", count, bits, items).mapInArrow(run, "doc_id bigint, n_words bigint, hits array<struct<first:bigint,end:bigint>>, items array<string>")


def hit_digests(found: DataFrame) -> DataFrame:
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def remove_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """docs with hit words cut out of the text; documents without hits stay as they are, and so does null text.

    A run of hit words goes from its first to its last character, with what stands between them. A column n_chars, if
    there is one, gets the new length. A document of which no word is left is dropped.
    """
    out, count, bits, items = _marked(docs, benchmark, text_col, window, block_words, "item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            k = b.schema.get_field_index(text_col)
            texts, keep = b.column(k).to_pylist(), [True] * b.num_rows
            cut = [i for i, p in enumerate(b.column(b.schema.get_field_index(bits)).to_pylist()) if p]
            counts, packed = b.column(b.schema.get_field_index(count)), b.column(b.schema.get_field_index(bits))
            for i in cut:
                hit = _bits(packed[i].as_py(), counts[i].as_py())
                texts[i], keep[i] = cut_words(texts[i].encode(), hit).decode(), not hit.all()
            columns = list(b.columns)
            columns[k] = pa.array(texts, b.schema.field(k).type)
            if (j := b.schema.get_field_index("n_chars")) >= 0:
                n = b.column(j).to_pylist()
                for i in cut:
                    n[i] = len(texts[i])
                columns[j] = pa.array(n, b.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array(keep)).select(docs_names)

    docs_names = docs.columns
    return out.mapInArrow(run, docs.schema)


def cut_words(text: bytes, hit: np.ndarray) -> bytes:
    low = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge, parts, at = _runs(low), [], 0
    for i, j in _runs(hit).tolist():
        parts.append(text[at : edge[i, 0]])
        at = int(edge[j - 1, 1])
    return b"".join([*parts, text[at:]])
