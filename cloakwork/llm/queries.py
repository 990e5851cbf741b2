"""The ``opN_<name>`` queries over ``documents`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, ngram_join, packing, pii, quality, sharding, toxicity, wordpiece
from .common import documents


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), keep_ids=False)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir), 40)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


#: The secret of the pseudonyms; give your own to keep them private.
PII_KEY = b"cloakwork demonstration key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_language, op3_sharding, op4_exact_dedup, op5_pii, op6_toxicity, op7_packing, op8_token_counts, op9_quality, op10_ngram_join)}


_EXACT = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept,
    sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))"""

_JACCARD = """
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
  sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
      else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words),
  items as (select doc_id, len(s) as n, unnest(s) as g from sets),
  links as (select a.doc_id as x, b.doc_id as y from items a join items b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
  reach as (select doc_id, doc_id as r from documents union select reach.doc_id, links.y from reach join links on reach.r = links.x)
select sets.doc_id, len(s)::bigint as n_shingles, least_id as component_id, copies as set_copies
from sets join (select doc_id, min(r) as least_id from reach group by doc_id) using (doc_id)
  join (select doc_id, case when len(s) = 0 then 1 else count(*) over (partition by list_sort(s)) end as copies from sets) using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": _EXACT, "op10_ngram_join": _JACCARD}
