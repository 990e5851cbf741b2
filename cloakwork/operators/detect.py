"""Rule detection: matches, filters, first-wins dedup and candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import matching, placeholders
from ..rules import DEFAULT_RULES, Rule
from . import index

ORDER = ["file_rel", "seg_ord", "rule_ord", "off"]


def occurrences(segments: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, allow: bool = True, snippets: bool = False) -> DataFrame:
    """One row per match: file_rel, seg_ord, seg_id, rule_ord, rule, category, strategy, value, off.

    All rules are evaluated in one pass over ``segments`` (file_rel, seg_ord,
    seg_id, text), each behind the letters that every match of it holds; nothing
    is shuffled.  With ``allow`` matches on a rule's allow list are left out,
    else a column ``allowed`` marks them.  ``snippets`` adds the match with its
    surroundings.
    """
    text = F.col("text")

    def hits_of(k: int, r: Rule):
        hits = matching.find_all(text, r.regex)
        if r.needs:
            hits = F.when(text.contains(r.needs), hits).otherwise(F.array().cast(matching.MATCHES))
        if allow and r.allow:
            hits = F.filter(hits, lambda m: ~matching.searched(m["value"], r.allow))
        marks = [] if allow else [lambda m: matching.searched(m["value"], r.allow).alias("allowed")]
        marks += [lambda m: matching.snippet(text, m["off"], F.length(m["value"])).alias("snippet")] if snippets else []
        return F.transform(hits, lambda m: F.struct(F.lit(k).alias("rule_ord"), m["off"].alias("off"), m["value"].alias("value"), *(mark(m) for mark in marks)))

    found = [hits_of(k, r) for k, r in enumerate(rules)]
    names, cats, ways = (F.array(*(F.lit(x) for x in xs)) for xs in ([r.name for r in rules], [r.category for r in rules], [r.strategy for r in rules]))
    hit = segments.select("file_rel", "seg_ord", "seg_id", F.explode(F.concat(*found)).alias("m"))
    return hit.select(
        "file_rel", "seg_ord", "seg_id", "m.rule_ord",
        F.element_at(names, F.col("m.rule_ord") + 1).alias("rule"),
        F.element_at(cats, F.col("m.rule_ord") + 1).alias("category"),
        F.element_at(ways, F.col("m.rule_ord") + 1).alias("strategy"),
        "m.value", "m.off", *([] if allow else ["m.allowed"]), *(["m.snippet"] if snippets else []),
    )


def without(occ: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Rows whose value is not in ``values.column`` (exact, case-sensitive); Spark broadcasts the side it finds small."""
    return occ.join(values.select(F.col(column).alias("value")), "value", "left_anti").select(*occ.columns)


def first_rule_wins(occ: DataFrame) -> DataFrame:
    """Of matches that start at one place of a segment, that of the earliest rule; ends don't matter."""
    rest = [c for c in occ.columns if c not in ("file_rel", "seg_id", "off")]
    kept = occ.groupBy("file_rel", "seg_id", "off").agg(F.min_by(F.struct(*rest), F.struct("rule_ord", F.length("value"))).alias("m"))
    return kept.select("file_rel", "seg_id", "off", "m.*").select(*occ.columns)


def candidates(occ: DataFrame, most_examples: int = 5) -> DataFrame:
    """One row per value: value, category, rule, strategy, count, examples; the first sighting decides.

    ``occ`` is far smaller than the texts; it is written once and read for counts and examples.
    """
    occ = index.materialised(occ)
    first = F.struct(*ORDER)
    counted = occ.groupBy("value").agg(F.min_by(F.struct("category", "rule", "strategy"), first).alias("m"), F.count("*").alias("count"), F.min(first).alias("first"))
    top = occ.withColumn("nth", F.row_number().over(Window.partitionBy("value").orderBy(*ORDER))).where(F.col("nth") <= most_examples)
    shown = top.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("nth", F.format_string("%s:%s@%d", "file_rel", "seg_id", "off").alias("label")))).alias("e"))
    return counted.join(shown, "value").select("value", "m.category", "m.rule", "m.strategy", "count", F.array_distinct(F.transform("e", lambda e: e["label"])).alias("examples"), "first")


def with_placeholders(cands: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Candidates with n and placeholder; values with one canonical form share an index."""
    keyed = cands.withColumns({"bucket": placeholders.bucket(F.col("strategy"), F.col("rule")), "key": placeholders.canonical(F.col("strategy"), F.col("value"))})
    numbers = index.number_keys(keyed.groupBy("bucket", "key").agg(F.min("first").alias("first")), known)
    return keyed.join(numbers, ["bucket", "key"]).withColumn("placeholder", placeholders.resolve(F.col("strategy"), F.col("value"), F.col("n")))


def with_templates(cands: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Placeholders of rules that have a template instead of a strategy: ``{n}``, ``{zeros}`` and ``{value}`` are filled in.

    A rule with neither leaves the value as it is.
    """
    filled = F.col("placeholder")
    for r in rules:
        if not r.strategy:
            made = F.replace(F.replace(F.replace(F.lit(r.template or "{value}"), F.lit("{n}"), F.col("n").cast("string")), F.lit("{zeros}"), F.repeat(F.lit("0"), F.length("value"))), F.lit("{value}"), F.col("value"))
            filled = F.when(F.col("rule") == r.name, made).otherwise(filled)
    return cands.withColumn("placeholder", filled)


def detect(segments: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, safe: DataFrame | None = None, mapped: DataFrame | None = None) -> DataFrame:
    """Occurrences after all filters, in their order: allow lists, known values, safe terms, first rule wins."""
    occ = occurrences(segments, rules)
    if mapped is not None:
        occ = without(occ, mapped, "from")
    if safe is not None:
        occ = without(occ, safe, "term")
    return first_rule_wins(occ)
