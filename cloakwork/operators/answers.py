"""Model answers as tables: detector, critic, vote, audit and few-shot examples.

Whoever asks the model writes one row per answer; everything after that is
relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import placeholders, text
from ..rules import CATEGORIES

ANSWER = "candidates array<struct<value:string,category:string,suggested_placeholder:string,confidence:double,rationale:string>>"


def parse_candidates(answers: DataFrame) -> DataFrame:
    """(pass_idx, file_rel, seg_id, chunk_id, pos, value, ...) of raw answers; loose JSON, trimmed and clipped."""
    rows = answers.withColumn("a", text.parse_json(F.col("raw"), ANSWER)).select("pass_idx", "file_rel", "seg_id", "chunk_id", F.posexplode("a.candidates").alias("pos", "c"))
    clip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c.confidence", F.lit(0.0))))
    category = F.lower(F.trim(F.coalesce("c.category", F.lit("other"))))
    return rows.select(
        "pass_idx", "file_rel", "seg_id", "chunk_id", "pos", F.trim("c.value").alias("value"),
        F.when(category.isin(*CATEGORIES), category).otherwise("other").alias("category"),
        F.trim(F.coalesce("c.suggested_placeholder", F.lit(""))).alias("suggested_placeholder"), clip.alias("confidence"),
        F.substring(F.trim(F.coalesce("c.rationale", F.lit(""))), 1, 120).alias("rationale"),
    ).where("value <> ''")


def group_mentions(rows: DataFrame, order: list[str], most_examples: int = 5) -> DataFrame:
    """Per value: count, largest confidence, the first mention's category and placeholder, up to five places."""
    first = F.struct(*order)
    base = rows.groupBy("value").agg(F.min_by(F.struct("category", "suggested_placeholder", "rationale"), first).alias("m"), F.count("*").alias("count"), F.max("confidence").alias("confidence"))
    label = F.concat_ws(":", "file_rel", "seg_id")
    places = rows.groupBy("value", label.alias("label")).agg(F.min(first).alias("first"))
    top = places.withColumn("k", F.row_number().over(Window.partitionBy("value").orderBy("first"))).where(F.col("k") <= most_examples)
    shown = top.groupBy("value").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "label"))), lambda e: e["label"]).alias("examples"))
    return base.join(shown, "value").select("value", "m.*", "count", "confidence", "examples")


def merge_passes(cands: DataFrame) -> DataFrame:
    """One candidate per value over passes (pass_idx, value, category, suggested_placeholder, rationale, count, confidence)."""
    best = F.struct("confidence", (-F.col("pass_idx")).alias("early"))
    return cands.groupBy("value").agg(F.max_by(F.struct("category", "suggested_placeholder", "rationale"), best).alias("m"), F.sum("count").alias("count"), F.max("confidence").alias("confidence")).select("value", "m.*", "count", "confidence")


def criticise(cands: DataFrame, verdicts: DataFrame, safe: DataFrame) -> DataFrame:
    """Candidates with critic columns: safe terms are a sure no, missing verdicts uncertain."""
    trusted = safe.select(F.col("term").alias("value"), F.lit(True).alias("safe")).distinct()
    one = lambda v, allowed, default: F.when(F.lower(F.trim(v)).isin(*allowed), F.lower(F.trim(v))).otherwise(default)
    joined = cands.join(trusted, "value", "left").join(verdicts, "value", "left")
    is_safe = F.coalesce("safe", F.lit(False))
    return joined.select(
        *cands.columns,
        F.when(is_safe, "no").otherwise(one(F.col("is_real_leak"), ("yes", "no", "uncertain"), "uncertain")).alias("critic_is_real_leak"),
        F.when(is_safe, "yes").otherwise(one(F.col("placeholder_safe"), ("yes", "no"), "yes")).alias("critic_placeholder_safe"),
        F.when(is_safe, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("verdict_confidence"), F.lit(0.0))))).alias("critic_confidence"),
    )


def majority(votes: DataFrame, key: str, answer: str, order: str) -> DataFrame:
    """(key, answer, agreement): the most frequent non-null answer, the earliest of equals, and its share."""
    counted = votes.where(F.col(answer).isNotNull()).groupBy(key, answer).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(key).agg(F.max_by(answer, F.struct("n", (-F.col("first")).alias("early"))).alias(answer), (F.max("n") / F.sum("n")).alias("agreement"))


def ground(proposed: DataFrame, smap: DataFrame) -> DataFrame:
    """Audit answers (ord, value, placeholder, chunk) that the map backs.

    The chunk must hold the value, the value equal or contain a map value, the
    placeholder contain none; the first map entry in order names the category.
    Values are compared lower-cased with the distinct map values, which Spark
    broadcasts for this containment join.
    """
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    known = smap.where("`from` <> ''").groupBy(F.lower("from").alias("low")).agg(F.min_by("category", F.struct(order, "entry_ord")).alias("category"), F.min(F.struct(order.alias("o"), "entry_ord")).alias("rank"))
    v, p = F.col("value"), F.col("placeholder")
    asked = proposed.where((v != "") & (p != "") & (p != v) & (F.instr("chunk", v) > 0)).withColumns({"vl": F.lower(v), "pl": F.lower(p)})
    bad = asked.join(known.select("low"), F.instr("pl", F.col("low")) > 0, "left_semi").select("ord")
    sound = asked.join(bad, "ord", "left_anti")
    backed = sound.join(known, F.instr("vl", F.col("low")) > 0).groupBy("ord", "value", "placeholder").agg(F.min_by("category", F.struct((F.col("low") != F.col("vl")).alias("inexact"), "rank")).alias("category"))
    cut = backed.withColumn("placeholder", F.when(placeholders.overlong(v, p), placeholders.clamp(v, p)).otherwise(p)).where((p != "") & (p != v))
    return cut.groupBy("value").agg(F.min_by(F.struct("category", "placeholder"), "ord").alias("m")).select("value", "m.*")


def few_shot(decisions: DataFrame, last: int = 8) -> DataFrame:
    """The promotions among the last decisions, newest first."""
    return decisions.orderBy(F.desc("seq")).limit(last).where("action = 'promote'")


def clipped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
