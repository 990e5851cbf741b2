"""Queries of detection, candidates, chunking and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunk, detect, index
from ..rules import DEFAULT_RULES
from . import sql
from .catalogue import query
from .tables import PHONES_AND_IPV4, doc_segments, page_segments, secret_segments, table, turn_segments

_DOCS = sql.occurrences(sql.DOC_SEGMENTS, DEFAULT_RULES)
_RAW = sql.occurrences(sql.DOC_SEGMENTS, DEFAULT_RULES, allow=False)
_KEPT = sql.first_wins(_DOCS)
_COLUMNS = ["file_rel", "seg_ord", "seg_id", "rule_ord", "rule", "category", "strategy", "value", "off"]
_SAFE = "select distinct value as term from ({occ}) where file_rel like '%0'"
_MAPPED = "select distinct value as \"from\" from ({occ}) where file_rel like '%5'"


def _count(occ: DataFrame) -> DataFrame:
    return occ.groupBy("rule", "category").agg(F.count("*").alias("n_matches"), F.countDistinct("value").alias("n_values"))


def _count_sql(occ: str) -> str:
    return f"select rule, category, count(*) as n_matches, count(distinct value) as n_values from ({occ}) group by rule, category"


@query(_count_sql(_DOCS))
def t0_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(detect.occurrences(doc_segments(spark, sf_dir)))


@query(_count_sql(sql.occurrences(sql.PAGE_SEGMENTS, DEFAULT_RULES)))
def t0_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(detect.occurrences(page_segments(spark, sf_dir)))


@query(_count_sql(sql.occurrences(sql.TURN_SEGMENTS, DEFAULT_RULES)))
def t0_scan_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(detect.occurrences(turn_segments(spark, sf_dir)))


@query(sql.first_wins(sql.occurrences(sql.SECRET_SEGMENTS, DEFAULT_RULES)))
def t0_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, ARNs, instances, UUIDs and SIDs, and values that allow lists leave alone."""
    return detect.detect(secret_segments(spark, sf_dir)).select(*_COLUMNS)


@query(_KEPT)
def t0_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(doc_segments(spark, sf_dir)).select(*_COLUMNS)


@query(f"select rule, count(*) as n_raw, sum(allowed) as n_allowed from (select r.rule, case when d.off is null then 1 else 0 end as allowed from ({_RAW}) r left join ({_DOCS}) d using (file_rel, seg_id, rule_ord, off)) group by rule")
def t0_allow_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = detect.occurrences(doc_segments(spark, sf_dir), allow=False)
    return raw.groupBy("rule").agg(F.count("*").alias("n_raw"), F.sum(F.col("allowed").cast("int")).alias("n_allowed"))


@query(f"with occ as ({_DOCS}) select {', '.join(_COLUMNS)} from occ where value not in ({_SAFE.format(occ='select * from occ')})")
def t0_safe_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = index.materialised(detect.occurrences(doc_segments(spark, sf_dir)))
    safe = occ.where(F.col("file_rel").endswith("0")).select(F.col("value").alias("term")).distinct()
    return detect.without(occ, safe, "term").select(*_COLUMNS)


@query(f"with occ as ({_DOCS}) select {', '.join(_COLUMNS)} from occ where value not in ({_MAPPED.format(occ='select * from occ')})")
def t0_map_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = index.materialised(detect.occurrences(doc_segments(spark, sf_dir)))
    mapped = occ.where(F.col("file_rel").endswith("5")).select(F.col("value").alias("from")).distinct()
    return detect.without(occ, mapped, "from").select(*_COLUMNS)


@query(f"select rule, count(*) as n_kept from ({_KEPT}) group by rule")
def t0_overlap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.first_rule_wins(detect.occurrences(doc_segments(spark, sf_dir))).groupBy("rule").agg(F.count("*").alias("n_kept"))


@query(f"select value, category, rule, count, examples from ({sql.candidates(_KEPT)})")
def t0_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = detect.candidates(detect.detect(doc_segments(spark, sf_dir)))
    return cands.select("value", "category", "rule", "count", F.array_join("examples", " ").alias("examples"))


@query(f"select category, count(*) as n_candidates, sum(count)::bigint as n_occurrences, array_to_string(list(value order by value), ' ') as values_found from ({sql.candidates(_KEPT)}) group by category")
def t0_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = detect.candidates(detect.detect(doc_segments(spark, sf_dir)))
    return cands.groupBy("category").agg(F.count("*").alias("n_candidates"), F.sum("count").alias("n_occurrences"), F.array_join(F.sort_array(F.collect_list("value")), " ").alias("values_found"))


_SOME = sql.candidates(sql.first_wins(sql.occurrences(sql.DOC_SEGMENTS, PHONES_AND_IPV4)))


@query(f"select bucket, key, value, n from ({sql.numbered(_SOME)})")
def stable_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = detect.candidates(detect.detect(doc_segments(spark, sf_dir), PHONES_AND_IPV4))
    return detect.with_placeholders(cands).select("bucket", "key", "value", "n")


@query(f"select value, category, n, placeholder from ({sql.with_placeholders(_SOME)})")
def t0_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = detect.candidates(detect.detect(doc_segments(spark, sf_dir), PHONES_AND_IPV4))
    return detect.with_placeholders(cands).select("value", "category", "n", "placeholder")


@query(
    """with k as (select c_mktsegment as bucket, c_name as key, min(c_custkey) as first from customer group by 1, 2),
       known as (select bucket, key, row_number() over (partition by bucket order by first) as n from k where first % 3 = 0),
       fresh as (select bucket, key, row_number() over (partition by bucket order by first) as n from k where first % 3 <> 0)
       select bucket, key, n from known union all
       select f.bucket, f.key, f.n + coalesce(m.last, 0) from fresh f left join (select bucket, max(n) as last from known group by bucket) m using (bucket)"""
)
def stable_index_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of an earlier run are kept; new keys go on after them."""
    keys = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("bucket"), F.col("c_name").alias("key")).agg(F.min("c_custkey").alias("first"))
    known = index.number_keys(keys.where("first % 3 = 0"))
    return index.number_keys(keys, known)


@query("select source, count(*) as n_files, sum(strlen(text))::bigint as n_bytes from documents group by source")
def scan_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"))


@query("select page_id, replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&') as normal from pages")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.normalize(F.col("html")).alias("normal"))


@query("select doc_id, length(text) as n_before, length(regexp_replace(regexp_replace(text, ' the ', ' ' || chr(8203) || 'the' || chr(65279), 'g'), '[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}\\x{FEFF}]', '', 'g')) as n_after from documents")
def zero_width_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.regexp_replace("text", " the ", " ​the﻿")
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n_before"), F.length(text.strip_zero_width(dirty)).alias("n_after"))


@query("select doc_id, (floor(length(text) / 3.5) + 3700 + 250 + 2048)::bigint as tokens, 16384 // 2 >= floor(length(text) / 3.5) + 3700 + 250 + 2048 as fits from documents")
def chunk_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = text.request_tokens(F.length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", need.alias("tokens"), (need <= 16384 // 2).alias("fits"))


@query("select event_id, json_extract_string(props, '$.k') as k, json_valid(props) as sound from (select event_id, props from events)")
def json_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects behind prose are found as well as bare ones."""
    rows = table(spark, sf_dir, "events").withColumn("said", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked"))).otherwise(F.col("props")))
    found = text.json_object(F.col("said"))
    return rows.select("event_id", F.get_json_object(found, "$.k").alias("k"), found.isNotNull().alias("sound"))


@query()
def chunk_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunks(doc_segments(spark, sf_dir), "flat", most=5000)


@query()
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunk.chunks(doc_segments(spark, sf_dir), "flat", most=5000).groupBy("file_rel").agg(F.count("*").alias("n_chunks"), F.max(F.length("text")).alias("longest"), F.max(F.col("start") + F.length("text")).alias("last_end"))
    return made


@query("select lpad(doc_id::varchar, 12, '0') as file_rel, (i)::int as chunk_id, (i * 800)::int as start, substr(text, (i * 800 + 1)::bigint, 1000) as text from (select doc_id, text, unnest(range(0, greatest(1, ((length(text) - 200 + 799) // 800)))) as i from (select doc_id, regexp_replace(text, '[\\n .;,]', '_', 'g') as text from documents where text <> ''))")
def chunk_fixed_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without separators chunks have a fixed stride, which SQL can say."""
    seg = doc_segments(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[\n .;,]", "_"))
    return chunk.chunks(seg, "flat", most=1000, overlap=200).select("file_rel", "chunk_id", "start", "text")


@query()
def chunk_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunks(doc_segments(spark, sf_dir), "structured")


@query()
def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.block_rows(doc_segments(spark, sf_dir)).groupBy("file_rel", "kind").agg(F.count("*").alias("n_blocks"), F.sum(F.length("body")).alias("n_chars"))
