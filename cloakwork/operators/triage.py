"""Routing of candidates, and edits that people made to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import placeholders
from . import index, submap


def promotable(low: float = 0.75, high: float = 0.92) -> Column:
    """Rule candidates always; others on confidence, a critic's yes, and a placeholder that changes something."""
    value, proposed = F.trim("value"), F.trim("suggested_placeholder")
    sure = (F.col("confidence") >= high) | (F.col("self_consistency") >= 0.99)
    changes = (proposed != "") & (F.lower(proposed) != F.lower(value))
    sound = (F.col("confidence") >= low) & (F.col("critic_is_real_leak") == "yes") & (F.col("critic_placeholder_safe") != "no") & changes & sure
    return (F.col("tier") == "T0_rules") | sound


def rejectable(least: float = 0.85) -> Column:
    return (F.col("tier") != "T0_rules") & (F.col("critic_is_real_leak") == "no") & (F.col("critic_confidence") >= least)


def route(cands: DataFrame, low: float = 0.75, high: float = 0.92, reject: float = 0.85) -> DataFrame:
    """Candidates with ``bucket``: promote, else reject, else review."""
    return cands.withColumn("bucket", F.when(promotable(low, high), "promote").when(rejectable(reject), "reject").otherwise("review"))


def fill_placeholders(cands: DataFrame, n: str = "n") -> DataFrame:
    """Blank or unchanged placeholders get the category's strategy with index ``n``, at last a redaction token."""
    value, proposed = F.trim("value"), F.trim(F.coalesce("suggested_placeholder", F.lit("")))
    category = F.lower(F.trim(F.when(F.coalesce("category", F.lit("")) == "", "other").otherwise(F.col("category"))))
    derived = placeholders.resolve(placeholders.category_strategy(category, value), value, F.col(n))
    fresh = F.when(derived.isNull() | (derived == "") | (derived == value), placeholders.redacted(category, value)).otherwise(derived)
    return cands.withColumn("suggested_placeholder", F.when((value != "") & ((proposed == "") | (proposed == value)), fresh).otherwise(F.col("suggested_placeholder")))


def merge_user_edits(new: DataFrame, old: DataFrame) -> DataFrame:
    """A fresh run's candidates with the decisions and edits of the run before.

    Matched on (original_value or value, category).  Matched rows keep what
    people did; what the detector says is refreshed.  Old rows without a match
    stay if they were edited or decided on.
    """
    key = lambda d, p: d.select(F.coalesce(F.nullif("original_value", F.lit("")), F.col("value")).alias("k"), F.col("category").alias("c"), F.struct(*d.columns).alias(p))
    both = key(new, "new").join(key(old, "old"), ["k", "c"], "full_outer")
    said = lambda f: F.coalesce(F.nullif(F.col(f"new.{f}"), F.lit("")), F.col(f"old.{f}"))
    matched, edited = F.col("new").isNotNull() & F.col("old").isNotNull(), F.col("old.user_edited")
    pick = {
        "value": F.when(edited, F.col("old.value")).otherwise(F.col("new.value")),
        "suggested_placeholder": F.when(edited, F.col("old.suggested_placeholder")).otherwise(said("suggested_placeholder")),
        "original_value": F.when(edited, F.col("old.original_value")).otherwise(F.lit("")),
        "confidence": F.col("new.confidence"),
        "critic_confidence": F.col("new.critic_confidence"),
        "critic_is_real_leak": said("critic_is_real_leak"),
        "critic_placeholder_safe": said("critic_placeholder_safe"),
        "rationale": said("rationale"),
        "count": F.greatest("new.count", "old.count"),
    }
    out = [F.when(matched, pick.get(f, F.col(f"old.{f}"))).otherwise(F.coalesce(F.col(f"new.{f}"), F.col(f"old.{f}"))).alias(f) for f in new.columns]
    kept = F.col("new").isNotNull() | F.col("old.user_edited") | (F.col("old.decision") != "pending")
    return both.where(kept).select(*out)


def prune_promoted(cands: DataFrame, mapped: DataFrame) -> DataFrame:
    """Candidates that the map does not hold yet, and those that people skipped."""
    known = mapped.select(F.col("from").alias("value"), F.lit(True).alias("known")).distinct()
    return cands.join(known, "value", "left").where(F.col("known").isNull() | (F.col("decision") == "skip")).drop("known")


def promote(smap: DataFrame, lists: list[DataFrame]) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """One step from candidates to the map: (map, lists, log).

    ``lists`` (ord, category, value, suggested_placeholder, decision, tier) are
    merged in their order; skipped rows stay out of the map and in their list,
    and rows that the map holds now leave it.  Blank or unchanged placeholders
    are filled first.  ``log`` (action, value, placeholder, category, tier) has
    a row for each candidate that was not skipped.
    """
    some = ("ord", "category", "value", "suggested_placeholder", "decision", "tier")
    every = None
    for k, one in enumerate(lists):
        part = one.select(*some).withColumn("list", F.lit(k))
        every = part if every is None else every.unionByName(part)
    every = index.running(every.where(F.coalesce("decision", F.lit("pending")) != "skip"), ["list", "ord", "value"])
    keys = every.groupBy(F.col("category").alias("bucket"), F.col("value").alias("key")).agg(F.min("rank").alias("first"))
    numbered = every.join(index.number_keys(keys).select(F.col("bucket").alias("category"), F.col("key").alias("value"), "n"), ["category", "value"])
    filled = index.materialised(fill_placeholders(numbered).select("list", F.col("rank").alias("ord"), "category", "value", F.col("suggested_placeholder").alias("placeholder"), "tier"))
    grown = index.materialised(submap.merge(smap, filled.select("ord", "category", "value", "placeholder")))
    log = filled.select(F.lit("promote").alias("action"), "value", "placeholder", "category", "tier")
    return grown, [prune_promoted(one, grown) for one in lists], log


def unhandled(pending: DataFrame, mapped: DataFrame, auto: DataFrame) -> DataFrame:
    """Pending values that neither the map, nor promotion, nor approval takes care of."""
    covered = mapped.select(F.col("from").alias("value")).unionByName(auto.select("value"))
    return pending.where((F.col("value") != "") & (F.coalesce("decision", F.lit("pending")) != "approve")).join(covered, "value", "left_anti")


def unreviewed(pending: DataFrame) -> DataFrame:
    return pending.where((F.col("value") != "") & F.lower(F.trim(F.coalesce("decision", F.lit("")))).isin("", "pending"))
