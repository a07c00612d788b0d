"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.chunk_fingerprints import fingerprint_report
from tidemark.llm.common import read
from tidemark.llm.decontamination import find_leaks
from tidemark.llm.html_text import extract_pages
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import score_quality
from tidemark.llm.sharding import shard_documents
from tidemark.llm.substring_dedup import dedup_report
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.toxicity import score_toxicity


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(read(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), 24)


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_html_text, op3_substring_dedup, op4_fingerprints, op5_toxicity, op6_decontamination, op7_near_dedup, op8_quality,
    op9_token_counts, op10_sharding,
)}
ORACLES: dict[str, str] = {
    "op3_substring_dedup": r"""
with docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (
  select doc_id, w, unnest(range(1, len(w) - 48)) as p from docs where len(w) >= 50),
windows as (
  select doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as h from starts),
firsts as (
  select h, min(doc_id) as d from windows group by h),
late as (
  select windows.doc_id, windows.p from windows join firsts using (h) where d < windows.doc_id),
gone as (
  select distinct doc_id, unnest(range(p, p + 50)) as i from late),
removed as (
  select doc_id, list(i) as g, count(*) as n from gone group by doc_id),
left_words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from docs join removed using (doc_id)),
kept as (
  select l.doc_id, string_agg(word, ' ' order by l.i) as k
  from left_words l left join gone on gone.doc_id = l.doc_id and gone.i = l.i where gone.i is null group by l.doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(case when n is null then array_to_string(w, ' ') else coalesce(k, '') end) as kept_sha256
from docs left join removed using (doc_id) left join kept using (doc_id)
"""
}
