"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.llm import alignment, chat, exact_dedup, fingerprints, html, near_dedup, negatives, packing, pieces, quality, substring_dedup, suffix_dedup, topk
from vecbank.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


QUERIES["op5_exact_dedup"] = op5_exact_dedup
SQL["op5_exact_dedup"] = """
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
           sha256(coalesce(text, '')) as text_sha256
    from documents window w as (partition by coalesce(text, ''))"""


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


QUERIES["op7_best_fit_packing"] = op7_best_fit_packing


def op8_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    network = quality.fit(docs, table(spark, sf, "labels"))
    return quality.score(docs, network).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


QUERIES["op8_quality_classifier"] = op8_quality_classifier


def op10_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract_pages(table(spark, sf, "pages"))


QUERIES["op10_html_extraction"] = op10_html_extraction


def op3_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return topk.search(rows.filter(F.col("vec_id") % 100 == 0), rows)


QUERIES["op3_exact_topk"] = op3_exact_topk
SQL["op3_exact_topk"] = """
    with v as (
      select vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) as vec from embeddings
      where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    hits as (
      select q.vec_id as query_id, c.vec_id, list_dot_product(q.vec, c.vec)::bigint as score
      from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
    select query_id, rank, vec_id, score
    from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from hits)
    where rank <= 10"""


def op9_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    return chat.rotate(table(spark, sf, "conversations"))


QUERIES["op9_chat_formatting"] = op9_chat_formatting
SQL["op9_chat_formatting"] = chat.ROTATE_SQL


def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.digests(table(spark, sf, "documents"))


QUERIES["op4_sentencepiece"] = op4_sentencepiece


def op1_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"))


QUERIES["op1_suffix_array_dedup"] = op1_suffix_array_dedup
SQL["op1_suffix_array_dedup"] = """
    with d as (select doc_id, hex(encode(coalesce(text, ''))) as bytes from documents),
    w as (select doc_id, bytes, unnest(range(0, greatest(len(bytes) // 2 - 199, 0))) as start from d),
    k as (select doc_id, start, md5(substr(bytes, 2 * start + 1, 400)) as content from w),
    repeated as (
      select doc_id, start from (select *, count(*) over (partition by content) as times from k) where times > 1),
    spans as (
      select doc_id, start, coalesce(start - lag(start) over (partition by doc_id order by start) > 200, true) as opens
      from repeated),
    runs as (select *, sum(opens::int) over (partition by doc_id order by start rows unbounded preceding) as run from spans),
    removed as (select doc_id, run, min(start) as first, max(start) + 200 as last from runs group by doc_id, run),
    gone as (
      select doc_id, list(first order by first) as firsts, list(last order by first) as lasts, sum(last - first)::bigint as n_removed
      from removed group by doc_id),
    kept as (
      select d.doc_id, bytes, coalesce(n_removed, 0) as n_removed, coalesce(len(firsts), 0) as n_spans,
             list_prepend(0, coalesce(lasts, [])) as begins, list_append(coalesce(firsts, []), len(bytes) // 2) as ends
      from d left join gone using (doc_id))
    select doc_id, len(bytes) // 2 as n_bytes, n_removed, n_spans,
           sha256(unhex(array_to_string(list_transform(begins, lambda b, i: substr(bytes, 2 * b + 1, 2 * (ends[i] - b))), '')))
             as kept_sha256
    from kept"""


def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf, "documents"))


QUERIES["op2_substring_dedup"] = op2_substring_dedup
SQL["op2_substring_dedup"] = r"""
    with d as (
      select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
    w as (select doc_id, unnest(range(1, greatest(len(words) - 18, 1))) as start, words from d),
    k as (select doc_id, start, md5(array_to_string(words[start:start + 19], ' ')) as content from w),
    repeated as (
      select doc_id, start from (select *, row_number() over (partition by content order by doc_id, start) as nth from k)
      where nth > 1),
    gone as (select distinct doc_id, start + i as place from repeated, range(20) t(i)),
    removed as (select doc_id, list(place) as places from gone group by doc_id),
    kept as (
      select doc_id, len(words) as n_words, coalesce(len(places), 0) as n_removed,
             case when places is null then words
                  else list_filter(words, lambda x, i: not list_contains(places, i)) end as rest
      from d left join removed using (doc_id))
    select doc_id, n_words, n_removed, sha256(array_to_string(rest, ' ')) as kept_sha256 from kept"""


def op6_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents"), size=3, similarity=85)


QUERIES["op6_minhash_near_dedup"] = op6_minhash_near_dedup


def op13_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf, "documents"))


QUERIES["op13_document_fingerprints"] = op13_document_fingerprints
SQL["op13_document_fingerprints"] = fingerprints.FINGERPRINT_SQL


def op11_cross_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align(table(spark, sf, "documents"))


QUERIES["op11_cross_tokenizer_alignment"] = op11_cross_tokenizer_alignment


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf, "embeddings").select("vec_id", shifted.alias("label"), F.col("embedding").alias("vec"))
    return negatives.mine(rows.filter(F.col("vec_id") % 100 == 0), rows)


QUERIES["op12_hard_negatives"] = op12_hard_negatives
SQL["op12_hard_negatives"] = """
    with v as (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) as vec from embeddings
      where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    s as (
      select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.vec, c.vec)::bigint as score
      from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id),
    p as (
      select anchor_id, vec_id as positive_id, score as positive_score
      from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as nth from s where same) where nth <= 5)
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    from (
      select p.*, s.vec_id as negative_id, s.score as negative_score,
             row_number() over (partition by anchor_id, positive_id order by score desc, s.vec_id)::int as rank
      from p join s using (anchor_id)
      where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
    where rank <= 5"""
