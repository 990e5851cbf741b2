"""Queries of triage, the map, model answers and scores, on inputs derived from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers, rewrite, score, submap, triage
from ..rules import CATEGORIES
from . import sql
from .catalogue import query
from .tables import table

_CATS = "[" + ", ".join(map(sql.quote, CATEGORIES)) + "]"
_CANDS_SQL = f"""select doc_id, substr(text, 1, 24) as value, {_CATS}[(doc_id % 12 + 1)::int] as category,
    case when doc_id % 7 = 0 then '' when doc_id % 7 = 1 then upper(substr(text, 1, 24)) else 'Vendor' || doc_id end as suggested_placeholder,
    0.5 + (doc_id % 50) / 100 as confidence, case when doc_id % 11 = 0 then 'T0_rules' else 'T1_llm' end as tier,
    case doc_id % 3 when 0 then 'yes' when 1 then 'no' else 'uncertain' end as critic_is_real_leak,
    case when doc_id % 5 = 0 then 'no' else 'yes' end as critic_placeholder_safe, (doc_id % 20) / 20 as critic_confidence,
    case when doc_id % 2 = 0 then 1.0 else 0.5 end as self_consistency from documents"""


def _category(key):
    return F.element_at(F.array(*map(F.lit, CATEGORIES)), (key % 12 + 1).cast("int"))


def _cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("doc_id"), F.substring("text", 1, 24)
    return table(spark, sf_dir, "documents").select(
        k, v.alias("value"), _category(k).alias("category"),
        F.when(k % 7 == 0, "").when(k % 7 == 1, text.upper_by_letter(v)).otherwise(F.concat(F.lit("Vendor"), k)).alias("suggested_placeholder"),
        (F.lit(0.5) + (k % 50) / 100).alias("confidence"), F.when(k % 11 == 0, "T0_rules").otherwise("T1_llm").alias("tier"),
        F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").otherwise("uncertain").alias("critic_is_real_leak"),
        F.when(k % 5 == 0, "no").otherwise("yes").alias("critic_placeholder_safe"), ((k % 20) / 20).alias("critic_confidence"),
        F.when(k % 2 == 0, 1.0).otherwise(0.5).alias("self_consistency"),
    )


_PROMOTE = "(tier = 'T0_rules' or (confidence >= 0.75 and critic_is_real_leak = 'yes' and critic_placeholder_safe <> 'no' and trim(suggested_placeholder) <> '' and lower(trim(suggested_placeholder)) <> lower(trim(value)) and (confidence >= 0.92 or self_consistency >= 0.99)))"
_BUCKETS = f"select *, case when {_PROMOTE} then 'promote' when tier <> 'T0_rules' and critic_is_real_leak = 'no' and critic_confidence >= 0.85 then 'reject' else 'review' end as bucket from ({_CANDS_SQL})"


@query(f"select doc_id, bucket from ({_BUCKETS})")
def triage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.route(_cands(spark, sf_dir)).select("doc_id", "bucket")


@query(
    f"select c_custkey, case when c_custkey % 2 = 1 then 'given' when cat in ('brand', 'phones') and cat = 'brand' then {sql.fit('(' + sql.quote('Vendor') + ' || ' + sql.zfill('c_custkey', 'greatest(1, length(c_name) - 6)') + ')', 'length(c_name)')}"
    f" else substr(c_name, 1, 4) || {sql.last(sql.zfill('c_custkey', 'length(c_name) - 4'), 'length(c_name) - 4')} end as placeholder from (select *, case when c_custkey % 4 = 0 then 'brand' else 'other' end as cat from customer)"
)
def fill_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.col("c_name").alias("value"), F.when(k % 4 == 0, "brand").otherwise("other").alias("category"), F.when(k % 2 == 1, "given").when(k % 3 == 0, F.col("c_name")).otherwise("").alias("suggested_placeholder"), k.alias("n"))
    return triage.fill_placeholders(rows).select("c_custkey", F.col("suggested_placeholder").alias("placeholder"))


_SMAP_SQL = f"select {_CATS}[(p_partkey % 12 + 1)::int] as category, (p_partkey // 12)::int as entry_ord, p_name || ' ' || p_partkey as \"from\", 'Vendor' || p_partkey as \"to\", 'm:' || p_partkey as id, p_partkey from part"


def _smap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(_category(k).alias("category"), F.floor(k / 12).cast("int").alias("entry_ord"), F.concat_ws(" ", "p_name", k.cast("string")).alias("from"), F.concat(F.lit("Vendor"), k).alias("to"), F.concat(F.lit("m:"), k).alias("id"))


@query(f"select \"from\", id, row_number() over (order by length(\"from\") desc, list_position({_CATS}, category), entry_ord) as nth from ({_SMAP_SQL})")
def rules_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    rules = rewrite.compile_rules(_smap(spark, sf_dir))
    order = Window.partitionBy().orderBy(F.desc("n"), "cat_ord", "entry_ord")
    return rules.select("from", "id", F.row_number().over(order).cast("long").alias("nth"))


_NEW_SQL = f"select c_custkey as ord, {_CATS}[(c_custkey % 12 + 1)::int] as category, c_name as value, 'P' || c_custkey || 'z' as placeholder from customer where c_custkey % 10 <> 0"


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("ord"), _category(k).alias("category"), F.col("c_name").alias("value"), F.when(k % 10 == 0, F.col("c_name")).otherwise(F.concat(F.lit("P"), k, F.lit("z"))).alias("placeholder"))


@query(
    f"with m as ({_SMAP_SQL}), n as ({_NEW_SQL}) select category, \"from\", \"to\", id from m union all"
    " select category, value, placeholder, category || ':' || lpad(((select count(*) from m) + row_number() over (order by ord))::varchar, 4, '0') from n"
)
def map_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without a change are left out, the others numbered after the map."""
    return submap.merge(_smap(spark, sf_dir), _new(spark, sf_dir)).select("category", "from", "to", "id")


@query()
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders that clash with the map or each other are bumped."""
    new = _new(spark, sf_dir).withColumn("placeholder", F.concat(F.lit("Vendor"), F.col("ord") % 40))
    return submap.merge(_smap(spark, sf_dir), new).select("category", "from", "to", "id")


@query("select c_mktsegment as \"from\", count(distinct c_custkey % 3) as n_categories from customer group by 1 having count(distinct c_custkey % 3) > 1")
def inv_duplicate_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("from"), (F.col("c_custkey") % 3).cast("string").alias("category"))
    return submap.duplicate_from(rows).select("from", "n_categories")


@query("select 'm:' || n_nationkey as id, n_name || 'X' as pass1, n_name || 'XX' as pass2 from nation where n_nationkey % 2 = 1")
def inv_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders that hold their value grow with each pass."""
    k = F.col("n_nationkey")
    smap = table(spark, sf_dir, "nation").select(F.lit("other").alias("category"), k.alias("entry_ord"), F.col("n_name").alias("from"), F.when(k % 2 == 1, F.concat("n_name", F.lit("X"))).otherwise(F.concat(F.lit("v"), k)).alias("to"), F.concat(F.lit("m:"), k).alias("id"))
    return submap.not_idempotent(smap).select("id", "pass1", "pass2")


@query(
    "select id, category, \"from\", old_to, new_to, reason from ("
    " select 'm:' || c_custkey as id, 'keys' as category, md5(c_name) as \"from\", '00000000' || lpad(c_custkey::varchar, 24, '0') as old_to, substr(md5(c_name), 1, 8) || repeat('0', 23) || '1' as new_to, 'hex_keep_prefix' as reason from customer where c_custkey % 3 = 0"
    " union all select 'm:' || c_custkey, 'other', substr(c_name, 1, 6), 'placeholder-' || c_custkey, 'pla000', 'clamp_overlong' from customer where c_custkey % 3 = 1)"
)
def map_migrate_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("m:"), k).alias("id"), F.when(k % 3 == 0, "keys").otherwise("other").alias("category"),
        F.when(k % 3 == 0, F.md5(F.col("c_name").cast("binary"))).when(k % 3 == 1, F.substring("c_name", 1, 6)).otherwise(F.col("c_name")).alias("from"),
        F.when(k % 3 == 0, F.concat(F.lit("00000000"), F.lpad(k.cast("string"), 24, "0"))).when(k % 3 == 1, F.concat(F.lit("placeholder-"), k)).otherwise(F.col("c_name")).alias("to"),
    )
    return submap.migrate(rows)


@query("select value, decision from (select c_name as value, case when c_custkey % 4 = 0 then 'skip' else 'pending' end as decision, c_custkey from customer) where c_custkey % 3 <> 0 or decision = 'skip'")
def prune_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    cands = c.select(F.col("c_name").alias("value"), F.when(F.col("c_custkey") % 4 == 0, "skip").otherwise("pending").alias("decision"))
    return triage.prune_promoted(cands, c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("from"))).select("value", "decision")


@query("select c_name as value from customer where c_custkey % 3 <> 0 and c_custkey % 5 <> 0 and c_custkey % 4 <> 0")
def unhandled_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    pending = c.select(F.col("c_name").alias("value"), F.when(F.col("c_custkey") % 4 == 0, "approve").alias("decision"))
    return triage.unhandled(pending, c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("from")), c.where("c_custkey % 5 = 0").select(F.col("c_name").alias("value"))).select("value")


@query("select c_name as value from customer where c_custkey % 4 in (1, 2)")
def unreviewed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    return triage.unreviewed(table(spark, sf_dir, "customer").select(F.col("c_name").alias("value"), F.when(k == 0, "approve").when(k == 1, " Pending ").when(k == 3, "skip").alias("decision"))).select("value")


_EDIT_COLS = ["value", "category", "suggested_placeholder", "original_value", "confidence", "critic_confidence", "critic_is_real_leak", "critic_placeholder_safe", "rationale", "count", "decision", "user_edited"]


def _edits(spark: SparkSession, sf_dir: str, old: bool) -> DataFrame:
    k = F.col("c_custkey")
    edited = (k % 5 == 0) if old else F.lit(False)
    rows = table(spark, sf_dir, "customer").where((k % 7 != 0) if old else (k % 6 != 0))
    return rows.select(
        F.when(edited, F.upper("c_name")).otherwise(F.col("c_name")).alias("value"), F.col("c_mktsegment").alias("category"),
        F.concat(F.lit("old" if old else "new"), k).alias("suggested_placeholder"), F.when(edited, F.col("c_name")).otherwise("").alias("original_value"),
        F.lit(0.5 if old else 0.75).alias("confidence"), F.lit(0.25).alias("critic_confidence"), F.when(k % 2 == 0, "yes").otherwise("no" if old else "").alias("critic_is_real_leak"),
        F.lit("yes").alias("critic_placeholder_safe"), F.lit("r").alias("rationale"), (k % (9 if old else 4)).alias("count"),
        F.when(k % 3 == 0, "approve").otherwise("pending").alias("decision") if old else F.lit("pending").alias("decision"), edited.alias("user_edited"),
    )


@query(
    """select case when o and k % 5 = 0 then upper(c_name) else c_name end as value, c_mktsegment as category,
         case when o and (k % 5 = 0 or not n) then 'old' || k else 'new' || k end as suggested_placeholder,
         (case when n then 0.75 else 0.5 end)::double as confidence,
         case when k % 2 = 0 then 'yes' when o then 'no' else '' end as critic_is_real_leak,
         case when n and o then greatest(k % 4, k % 9) when n then k % 4 else k % 9 end as count,
         case when o and k % 3 = 0 then 'approve' else 'pending' end as decision
       from (select *, c_custkey as k, c_custkey % 6 <> 0 as n, c_custkey % 7 <> 0 as o from customer)
       where n or (o and (k % 5 = 0 or k % 3 = 0))"""
)
def merge_user_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = triage.merge_user_edits(_edits(spark, sf_dir, False), _edits(spark, sf_dir, True))
    return merged.select("value", "category", "suggested_placeholder", "confidence", "critic_is_real_leak", "count", "decision")


@query("select \"from\", \"to\", category, source from (select *, row_number() over (partition by \"from\" order by source) as rn from (select c_name as \"from\", 'm' || c_custkey as \"to\", 'brand' as category, 0 as source from customer where c_custkey % 2 = 0 union all select c_name, 'a' || c_custkey, 'ids', 1 from customer where c_custkey % 3 = 0 union all select c_name, 'p' || c_custkey, 'other', 2 from customer where c_custkey % 5 = 0)) where rn = 1")
def preview_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    smap = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("from"), F.concat(F.lit("m"), k).alias("to"), F.lit("brand").alias("category"), k.cast("int").alias("entry_ord"))
    part = lambda m, p, cat: c.where(k % m == 0).select(F.col("c_name").alias("value"), F.concat(F.lit(p), k).alias("placeholder"), F.lit(cat).alias("category"), k.alias("ord"))
    return submap.preview(smap, part(3, "a", "ids"), part(5, "p", "other"))


@query("select rule as name, case when rule like '%phone%' or rule like '%mobile%' or rule like '%e164%' then 'phones' when rule like '%hex%' then 'keys' when rule like '%ip%' then 'network' when rule like '%arn%' or rule like '%ec2%' or rule like '%uuid%' or rule like '%sid%' then 'infra_ids' else 'other' end as category, n from (select ['italian_mobile', 'e164_generic', 'real_ipv4', 'hex_credentials_32', 'aws_arn', 'cloud_uuid', 'ad_sid', 'plain'][(doc_id % 8 + 1)::int] as rule, count(*) as n from documents group by 1)")
def hits_to_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["italian_mobile", "e164_generic", "real_ipv4", "hex_credentials_32", "aws_arn", "cloud_uuid", "ad_sid", "plain"]))
    hits = table(spark, sf_dir, "documents").groupBy(F.element_at(names, (F.col("doc_id") % 8 + 1).cast("int")).alias("name")).agg(F.count("*").alias("n"))
    return hits.select("name", text.category_of_pattern(F.col("name")).alias("category"), "n")


_MENTION = "select user_id % 97 as u, event_id, event_type, value, (event_id % 3)::int as pass_idx from events"


@query(
    f"with m as ({_MENTION}), f as (select 'V' || u as value, event_type as category, event_id, least(1.0, greatest(0.0, value / 100)) as confidence, 'f' || (event_id % 7) as label from m)"
    " select value, first(category order by event_id) as category, count(*) as count, max(confidence) as confidence,"
    " (select array_to_string(list(label order by fe)[1:5], ' ') from (select label, min(event_id) as fe from f g where g.value = f.value group by label)) as examples from f group by value"
)
def t1_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model answers, one per event, parsed and grouped by value."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    one = F.struct(F.concat(F.lit(" V"), F.col("user_id") % 97).alias("value"), F.col("event_type").alias("category"), F.lit("p").alias("suggested_placeholder"), (F.col("value") / 100).alias("confidence"), F.lit("").alias("rationale"))
    raw = F.concat(F.lit("Sure: "), F.to_json(F.struct(F.array(one).alias("candidates"))))
    rows = e.select(F.lit(0).alias("pass_idx"), F.concat(F.lit("f"), k % 7).alias("file_rel"), F.lit("").alias("seg_id"), k.alias("chunk_id"), raw.alias("raw"), F.col("event_type").alias("said"))
    parsed = answers.parse_candidates(rows).drop("category").join(rows.select("chunk_id", F.col("said").alias("category")), "chunk_id")
    grouped = answers.group_mentions(parsed.withColumn("seg_id", F.lit(None).cast("string")), ["chunk_id", "pos"])
    return grouped.select("value", "category", "count", "confidence", F.array_join("examples", " ").alias("examples"))


_PASSES = "select user_id % 97 as v, (event_id % 3)::int as pass_idx, count(*) as n, max(value) as conf from events group by 1, 2"


@query(f"select 'V' || v as value, sum(n)::bigint as count, max(conf) as confidence, first('p' || pass_idx order by conf desc, pass_idx) as suggested_placeholder from ({_PASSES}) group by v")
def multipass_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 97).alias("v"), (F.col("event_id") % 3).cast("int").alias("pass_idx")).agg(F.count("*").alias("count"), F.max("value").alias("confidence"))
    rows = e.select("pass_idx", F.concat(F.lit("V"), "v").alias("value"), F.lit("ids").alias("category"), F.concat(F.lit("p"), "pass_idx").alias("suggested_placeholder"), F.lit("").alias("rationale"), "count", "confidence")
    return answers.merge_passes(rows).select("value", "count", "confidence", "suggested_placeholder")


@query("select c_name as value, case when c_custkey % 5 = 0 then 'no' when c_custkey % 2 = 0 then 'yes' else 'uncertain' end as critic_is_real_leak, case when c_custkey % 5 = 0 then 1.0 when c_custkey % 2 = 0 then least(1.0, c_custkey % 7 / 5) else 0.0 end as critic_confidence from customer")
def critic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    verdicts = c.where(k % 2 == 0).select(F.col("c_name").alias("value"), F.lit(" YES ").alias("is_real_leak"), F.lit("yes").alias("placeholder_safe"), (k % 7 / 5).alias("verdict_confidence"))
    safe = c.where(k % 5 == 0).select(F.col("c_name").alias("term"))
    return answers.criticise(c.select(F.col("c_name").alias("value")), verdicts, safe).select("value", "critic_is_real_leak", "critic_confidence")


@query("select user_id, event_type as answer, n / sum_n as agreement from (select user_id, event_type, count(*) as n, sum(count(*)) over (partition by user_id) as sum_n, row_number() over (partition by user_id order by count(*) desc, min(event_id)) as rn from events group by user_id, event_type) where rn = 1")
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.majority(table(spark, sf_dir, "events").withColumnRenamed("event_type", "answer"), "user_id", "answer", "event_id").select("user_id", "answer", "agreement")


_NATIONS = "select 'network' as category, n_nationkey as entry_ord, n_name as \"from\" from nation"


@query("select c_custkey, c_name || ' of ' || n_name as value, 'v' || c_custkey as placeholder from customer join nation on c_nationkey = n_nationkey where c_custkey % 4 <> 0 and c_custkey % 3 <> 0")
def audit_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers must stand in their chunk, name a mapped value and not repeat one in the placeholder."""
    c, n, k = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), F.col("c_custkey")
    smap = n.select(F.lit("network").alias("category"), F.col("n_nationkey").alias("entry_ord"), F.col("n_name").alias("from"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(k, F.concat_ws(" of ", "c_name", "n_name").alias("value"), F.when(k % 4 == 0, F.concat(F.lit("x"), F.lower("n_name"))).otherwise(F.concat(F.lit("v"), k)).alias("placeholder"), F.when(k % 3 == 0, "elsewhere").otherwise(F.concat_ws(" of ", "c_name", "n_name")).alias("chunk"))
    grounded = answers.ground(rows.withColumnRenamed("c_custkey", "ord"), smap)
    return grounded.select(F.regexp_extract("placeholder", r"(\d+)$", 1).cast("long").alias("c_custkey"), "value", "placeholder")


@query("select seq, value from (select event_id as seq, event_type as value, case when event_id % 3 = 0 then 'skip' else 'promote' end as action from events order by event_id desc limit 8) where action = 'promote'")
def few_shot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("value"), F.when(F.col("event_id") % 3 == 0, "skip").otherwise("promote").alias("action"))
    return answers.few_shot(rows).select("seq", "value")


_COUNTS = "select file, count(*) filter (where e and c) as tp, count(*) filter (where c and not e) as fp, count(*) filter (where e and not c) as fn from (select o_orderpriority as file, lower(o_orderstatus || o_orderkey) as value, bool_or(o_orderkey % 4 <> 0) as e, bool_or(o_orderkey % 3 <> 0) as c from orders group by 1, 2) group by file"
_RATES = "case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("file"), F.concat("o_orderstatus", "o_orderkey").alias("value"), "o_orderkey")
    return score.per_file(o.where("o_orderkey % 4 <> 0"), o.where("o_orderkey % 3 <> 0").withColumn("value", F.lower("value")))


_SETS = "select o_orderpriority as file, lower(o_orderstatus || o_orderkey) as value, o_orderkey % 4 <> 0 as e, o_orderkey % 3 <> 0 as c from orders"


@query(f"select file, case when bool_or(e) then 'missed' else 'extra' end as kind, value from ({_SETS}) group by file, value having bool_or(e) <> bool_or(c)")
def score_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values behind the counts: missed ones and extra ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("file"), F.concat("o_orderstatus", "o_orderkey").alias("value"), "o_orderkey")
    return score.differences(o.where("o_orderkey % 4 <> 0"), o.where("o_orderkey % 3 <> 0"))


@query(
    "with new as (select c_custkey, row_number() over (order by c_custkey % 2, c_custkey) + (select count(*) from customer where c_custkey % 10 = 0) as n from customer where c_custkey % 10 <> 0 and c_custkey % 3 <> 0)"
    " select c_name as \"from\", 'V' || c_custkey as \"to\", 'brand:' || c_custkey as id from customer where c_custkey % 10 = 0"
    " union all select c_name, 'Q' || c_custkey || 'z', 'brand:' || lpad(n::varchar, greatest(4, length(n::varchar))::int, '0') from new join customer using (c_custkey)"
)
def promote_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists merged in their order: skipped rows and values that the map holds stay out."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    smap = c.where(k % 10 == 0).select(F.lit("brand").alias("category"), k.cast("int").alias("entry_ord"), F.col("c_name").alias("from"), F.concat(F.lit("V"), k).alias("to"), F.concat(F.lit("brand:"), k).alias("id"))
    cands = c.select(k.alias("ord"), F.lit("brand").alias("category"), F.col("c_name").alias("value"), F.concat(F.lit("Q"), k, F.lit("z")).alias("suggested_placeholder"), F.when(k % 3 == 0, "skip").otherwise("pending").alias("decision"), F.lit("T0_rules").alias("tier"))
    grown, _, _ = triage.promote(smap, [cands.where(F.col("ord") % 2 == 0), cands.where(F.col("ord") % 2 == 1)])
    return grown.select("from", "to", "id")


@query(f"select file, tp, fp, fn, round(p, 3) as precision, round(r, 3) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 3) as f1 from (select *, {_RATES} from ({_COUNTS}))")
def score_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@query(f"select tp, fp, fn, p as precision, r as recall, round(2 * p * r / (p + r), 3) as f1 from (select tp, fp, fn, round(p, 3) as p, round(r, 3) as r from (select *, {_RATES} from (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from ({_COUNTS}))))")
def score_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.micro(_scored(spark, sf_dir))


@query(
    "select kind, category, count(*) as n from (select 'missed' as kind, c_mktsegment as category from customer where c_custkey % 3 = 0"
    " union all select 'wrong_category', c_mktsegment from customer where c_custkey % 3 = 1 and c_custkey % 5 = 0"
    " union all select 'negative', case when c_custkey % 5 = 0 then 'zzz' else c_mktsegment end from customer where c_custkey % 3 <> 0 and c_custkey % 7 = 0) group by all"
)
def grade_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    expected = c.where(k % 3 != 2).select(F.col("c_mktsegment").alias("category"), F.col("c_name").alias("value"))
    caught = c.where(k % 3 != 0).select(F.when(k % 5 == 0, "zzz").otherwise(F.col("c_mktsegment")).alias("category"), F.col("c_name").alias("value"))
    return score.grade(expected, caught, c.where(k % 7 == 0).select(F.col("c_name").alias("value")))


@query("select file, category, value, count(distinct run_id) as runs_caught, count(distinct run_id) = max(total) as always from (select role as file, role as category, (conv_id % 50)::varchar as value, turn as run_id from conversations) join (select role as file, count(distinct turn) as total from conversations group by 1) using (file) group by 1, 2, 3")
def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("file"), F.col("role").alias("category"), (F.col("conv_id") % 50).cast("string").alias("value"), F.col("turn").alias("run_id"))
    return score.stability(rows)


@query("select event_type, round(min(value), 2) as min_value, round(max(value), 2) as max_value, round(avg(value), 2) as mean_value, round(stddev_pop(value), 2) as stdev_value from events group by event_type")
def stat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.summary(table(spark, sf_dir, "events"), "event_type", "value")


@query("select 'sha256:' || sha256(p_name || p_partkey) as image_id, case when p_partkey % 4 = 0 then 'redact' else 'untouched' end as action from part where p_partkey % 4 <> 1")
def image_decisions_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import images

    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    inventory = p.select(images.image_id(F.concat("p_name", k).cast("binary")).alias("image_id"), k)
    decisions = inventory.where(k % 4 < 2).select("image_id", F.when(k % 4 == 0, "redact").otherwise("skip").alias("action"))
    return images.decided(inventory.select("image_id"), decisions).where("action <> 'skip'")
