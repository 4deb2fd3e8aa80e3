"""Token ids of a public tokenizer, and ORC files of them.

The tokenizers library needs some 2 microseconds a character. Its word-level vocabularies never cross white
space, so a text is cut at ASCII white space, equal chunks are encoded once, and the ids are gathered: chunks of
plain Latin characters go to the library's BPE model by pre-token, all others, and all texts with special tokens,
go through the library whole. The result is that of encode() for each text.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import batch, id_text, ready, shared_dir, slices, tidy

WORD_BPE = "word_bpe_49k.json"
END_ID = 2
#: Entries of a worker's cache; it is emptied beyond. A task that ends empties it, too.
CACHE = 400_000

PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[!-~¡-įı-ɏ]+").fullmatch
#: ASCII marks: a run of them after a word is one pre-token.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def vocabulary(name: str = WORD_BPE) -> str:
    """The path of a vocabulary file on this machine; executors call it themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _lowered() -> dict[int, str]:
    """For str.translate: a plain character, or what it becomes in lower case, lowered, as its bytes' characters."""
    table = _byte_chars()
    plain = [chr(c) for c in range(33, 0x250) if _PLAIN(chr(c))]
    return {ord(c): "".join(table[b] for b in c.lower().encode()) for c in {*plain, *(c.lower() for c in plain)}}


class Encoder:
    """ids of many texts at once. Any tokenizer file works; files of the known word-level form work fast."""

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norms = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pres = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.words = norms == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pres] == ["Split", "ByteLevel"] and pres[0]["pattern"] == {"Regex": PRETOKENS} and not spec.get("post_processor") and spec["model"]["type"] == "BPE"
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.model = self.tokenizer.model
        if self.words:
            self.model._resize_cache(0)
        self.find = regex.compile(PRETOKENS).findall
        self.table = _lowered()
        self._empty()

    def _empty(self) -> None:
        """Forgets all chunks. Chunk k's ids are flat[ends[k]:ends[k + 1]]."""
        self.chunks: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def rest(self) -> None:
        """Gives the cache's memory back when a task ends; the vocabulary stays."""
        self._empty()
        tidy()

    def _add(self, chunk: str, ids) -> int:
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        k = self.chunks[chunk] = len(self.ends) - 2
        return k

    def _ids(self, k: int) -> array:
        return self.flat[self.ends[k] : self.ends[k + 1]]

    def _piece(self, p: str) -> int:
        """The code of a pre-token of plain characters."""
        if (k := self.chunks.get(p)) is None:
            k = self._add(p, [t.id for t in self.model.tokenize(p if p.isascii() else p.translate(self.table))])
        return k

    def _chunk(self, c: str) -> int:
        """The code of a new chunk, of which ASCII letters are lowered already."""
        word = c.rstrip(_MARKS)
        if not (word.isascii() or _PLAIN(word)):
            return self._add(c, self.tokenizer.encode(c, add_special_tokens=False).ids)
        if word.isalpha():
            k = self._piece(word)
            return k if len(word) == len(c) else self._add(c, self._ids(k) + self._ids(self._piece(c[len(word) :])))
        if not _PLAIN(c):
            return self._add(c, self.tokenizer.encode(c, add_special_tokens=False).ids if c else [])
        out = array("i")
        for p in self.find(c.lower()):
            out += self._ids(self._piece(p))
        return self._add(c, out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]]. Null counts as empty."""
        # Not as large_string: Arrow's kernels misread a slice that was cast to it.
        texts = pc.fill_null(texts, "")
        special = None
        if self.words:
            for s in self.specials:
                m = pc.match_substring(texts, s)
                special = m if special is None else pc.or_(special, m)
        if not self.words or (special is not None and pc.any(special).as_py()):
            return self._slowly(texts, special)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.values.dictionary_encode()
        if len(self.chunks) > CACHE:
            self._empty()
        own, known = self._chunk, coded.dictionary.to_pylist()
        codes = [own(c) if k is None else k for c, k in zip(known, map(self.chunks.get, known), strict=True)]
        flat, ends = np.array(self.flat, np.int32), np.array(self.ends, np.int64)
        word = np.array(codes, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if codes else np.empty(0, np.int64)
        first, size = ends[:-1][word], np.diff(ends)[word]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])]
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids, upto[at]

    def _slowly(self, texts: pa.Array, special: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
        """Texts with a special token's string, or all if the file isn't of the known form, one by one."""
        parts, one = [], None if special is None else special.to_pylist()
        for i in range(len(texts)):
            if one is None or one[i]:
                parts.append(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32))
            else:
                parts.append(self.encode(texts.slice(i, 1))[0])
        return np.concatenate([np.empty(0, np.int32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """A worker keeps its encoder, with its caches, from task to task."""
    if name not in _encoders:
        _encoders[name] = Encoder(vocabulary(name) if "/" not in name else name)
    return _encoders[name]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each document's ids."""
    n = len(offsets) - 1
    out = np.insert(ids, offsets[1:], end).astype(np.int32) if n else ids
    return out, offsets + np.arange(n + 1)


# ---------------------------------------------------------------------------------------------- ORC files

ORC_SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, vocab: str = WORD_BPE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes each document's ids, an end id last, as ORC in ascending id order; one file for each range of ids.

    The files' rows are (doc_id, part, part_start, n_tokens, ids): part is the file's place in the order, part_start
    the number of ids before the document in its file. Integer run-length encoding makes both almost free. Row
    indexes and a Bloom filter on doc_id let readers skip stripes and row groups; a stripe is read on its own.
    Null text counts as empty (the end id alone); null ids come first; equal ids keep no order between them; very
    long texts stay one row. An empty table gives files without rows.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, enc = TaskContext.get().partitionId(), 0, encoder(vocab)
        schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for b in slices(batches):
            ids, off = with_end(*enc.encode(b.column(1)), end_id)
            n = len(off) - 1
            yield batch(schema, b.column(0), np.full(n, part), off[:-1] + start, np.diff(off), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())))
            start += int(off[-1])
        enc.rest()

    rows = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    # The texts, not the ids, are dealt by range: Spark samples the keys first, and that must not encode anything.
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, ORC_SCHEMA)
    rows.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", "1000").option("orc.create.index", "true").orc(path)


def read_token_orc(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files: start counts the ids of all documents before."""
    rows = spark.read.schema(ORC_SCHEMA).orc(path)
    # One row for each file: as many as the write had tasks, whatever the number of documents.
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    base, at = [], 0
    for r in sorted(totals, key=lambda r: r["part"]):
        base.append((r["part"], at))
        at += r["n"]
    starts = spark.createDataFrame(base, "part int, base bigint")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def documents_of(spark, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, part, part_start, n_tokens, ids) of the documents with these ids, a list that fits a plan.

    The ids reach the files' readers: stripes and groups of rows are passed over by their least and greatest ids, and
    those that might hold one by their Bloom filters.
    """
    return spark.read.schema(ORC_SCHEMA).orc(path).where(F.col("doc_id").isin([int(i) for i in ids]))


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for b in batches:
        lists = b.column(3)
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        off = lists.offsets.to_numpy()
        yield batch(schema, b.column(0), b.column(1), pa.array(np.diff(off), pa.int64()), [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])


def token_digests(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens (counted, not read) and the crc32 of the ids."""
    ready(spark)
    return read_token_orc(spark, path).mapInArrow(_crcs, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Writes the documents to the shared folder and reads the digests back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens.orc"
    write_token_orc(docs, path, **options)
    return token_digests(docs.sparkSession, path)
