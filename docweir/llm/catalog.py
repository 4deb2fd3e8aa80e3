"""The operators' queries, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweir.llm import decontam, lines, media, packing, paragraphs, pii, quality, simhash, suffix, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return packing.pack(_table(spark, sf_dir, "documents")).select(*cols)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_digests(suffix.remove_repeats(_table(spark, sf_dir, "documents")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.personal_data(_table(spark, sf_dir, "documents")))


def op4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.digests(paragraphs.remove_paragraphs(_table(spark, sf_dir, "documents"), passage=paragraphs.PASSAGE))


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length")
    return media.media_columns(_table(spark, sf_dir, "documents")).select(*cols)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hit_digests(decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.hexed(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_suffix_dedup, op3_pii, op4_paragraphs, op5_token_orc, op6_media, op7_line_dedup, op8_decontamination, op9_quality, op10_simhash)}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Queries that SQL can express. The others need a tokenizer, a seeded hash, a trained model, an image or a banding.
ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": """
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as hx, octet_length(encode(coalesce(text, ''))) as n from documents),
strings as (select doc_id, i, substr(hx, 2 * i + 1, 200) as s from bytes, unnest(range(0, n - 99)) as t(i)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from strings) where k > 1),
edges as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 100, true) as fresh from later),
runs as (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as run from edges),
spans as (select doc_id, min(i) as lo, max(i) + 100 as hi from runs group by doc_id, run),
gaps as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as prior from spans),
cut as (select g.doc_id, sum(hi - lo) as n_removed, count(*) as n_spans, max(hi) as upto, string_agg(substr(hx, 2 * prior + 1, 2 * (lo - prior)), '' order by lo) as head
  from gaps g join bytes b on g.doc_id = b.doc_id group by g.doc_id)
select b.doc_id, b.n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(head, '') || substr(hx, 2 * coalesce(upto, 0) + 1))) as kept_sha256
from bytes b left join cut c on b.doc_id = c.doc_id""",
    "op8_decontamination": f"""
with doc as (select doc_id, {_WORDS.format("text")} as w from documents),
item as (select item_id, {_WORDS.format("text")} as w from benchmark),
win as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') as s
  from item, unnest(range(0, len(w) - least(len(w), 10) + 1)) as t(i) where len(w) > 0),
sizes as (select distinct k from win),
here as (select doc_id, i, sizes.k as k, array_to_string(w[i + 1 : i + sizes.k], ' ') as s from doc, sizes, unnest(range(0, len(w) - sizes.k + 1)) as t(i)),
found as (select doc_id, i, here.k as k, item_id from here join win on here.k = win.k and here.s = win.s),
hits as (select doc_id, count(distinct i + j) as n from found, unnest(range(0, k)) as t(j) group by doc_id),
items as (select doc_id, list_sort(list(distinct item_id::varchar)) as ids from found group by doc_id)
select doc.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n, 0) > 0 as contaminated
from doc left join hits on doc.doc_id = hits.doc_id left join items on doc.doc_id = items.doc_id""",
}
