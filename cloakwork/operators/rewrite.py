"""Longest-match-first rewriting of segments with an auditable event table.

Rules go to tasks as automata that find all of them in one pass over a text,
whatever their number.  A map with more rules than a pass takes is dealt to
several passes, each of which adds its finds to the segments; the last one
chooses among all finds, so that the result does not depend on the passes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import RuleMatcher, leftmost_longest, worker_cache
from ..rules import CASE_INSENSITIVE, categories
from . import index

#: Rules of one pass, which every task gets (some 200 bytes each).
PASS_RULES = 500_000

EVENT = "orig_off int, orig_len int, anon_off int, anon_len int, from string, to string, category string, mapping_id string"
_FIND = "start int, n int, k long, to string, category string, id string"


def compile_rules(smap: DataFrame, case_insensitive: tuple[str, ...] = CASE_INSENSITIVE) -> DataFrame:
    """Map entries (category, entry_ord, from, to, id) as rules; entries of unknown categories are left out."""
    known = categories(smap.sparkSession, case_insensitive)
    entries = smap.where(F.coalesce(F.col("from"), F.lit("")) != "").join(F.broadcast(known), "category")  # twelve categories
    return entries.select("from", "to", "category", "id", "ci", "cat_ord", "entry_ord", F.length("from").alias("n"))


def longest_first(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("n"), "cat_ord", "entry_ord")


def apply_rules(segments: DataFrame, rules: DataFrame, text_col: str = "text") -> DataFrame:
    """``segments`` with ``text_col`` rewritten and ``events``, an array of replacements in order.

    At each place, from left to right, the longest rule that holds there is
    applied, of several as long the first in map order; a rule of a
    case-insensitive category holds where the text's lower case is the value's.
    Offsets count code points.  Null texts have no events.
    """
    ranked = index.running(rules.select("from", "to", "category", "id", "ci", "cat_ord", "entry_ord", "n"), [F.desc("n"), "cat_ord", "entry_ord"])
    total, segments = ranked.count(), segments.drop("events")
    passes = max(1, -(-total // PASS_RULES))
    for p in range(passes):
        part = ranked.where((F.col("rank") >= p * PASS_RULES) & (F.col("rank") < (p + 1) * PASS_RULES)) if passes > 1 else ranked
        rows = [(r["rank"], r["from"], r["to"], r["category"], r["id"], r["ci"]) for r in part.collect()]  # PASS_RULES at most
        segments = _scan(segments, rows, text_col, first=p == 0, last=p == passes - 1)
        if p < passes - 1:
            segments = index.materialised(segments)
    return segments


def rewrite_text(text: str, finds) -> tuple[str, list[tuple]]:
    """A text with its finds (start, length, rank, to, category, id) applied, and the events."""
    out, events, last, shift = [], [], 0, 0
    for start, n, _, to, category, mapping_id in leftmost_longest(finds):
        events.append((start, n, start + shift, len(to), text[start : start + n], to, category, mapping_id))
        out += [text[last:start], to]
        shift += len(to) - n
        last = start + n
    return "".join([*out, text[last:]]), events


def _scan(segments: DataFrame, rules: list[tuple], text_col: str, first: bool, last: bool) -> DataFrame:
    """One pass: adds finds to the column ``events``, or, if it is the last, rewrites."""
    shared, token = segments.sparkSession.sparkContext.broadcast(rules), uuid.uuid4().hex
    event_type, find_type = T.StructType.fromDDL(EVENT), T.StructType.fromDDL(_FIND)
    kind = event_type if last else find_type
    fields = segments.schema.fields if first else segments.schema.fields[:-1]
    schema = T.StructType([*fields, T.StructField("events", T.ArrayType(kind))])
    arrow = pa.list_(pa.struct([pa.field(f.name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.dataType.simpleString()]) for f in kind.fields]))
    names, kept = [f.name for f in kind.fields], [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = worker_cache(lambda: RuleMatcher(shared.value), token)
        for batch in batches:
            texts, events = batch.column(text_col).to_pylist(), []
            before = [[]] * len(texts) if first else batch.column("events").to_pylist()
            for i, (text, early) in enumerate(zip(texts, before, strict=True)):
                finds = [] if text is None else [tuple(e[f] for f in ("start", "n", "k", "to", "category", "id")) for e in early] + list(matcher.finds(text))
                if last and finds:
                    texts[i], finds = rewrite_text(text, finds)
                events.append([dict(zip(names, f, strict=True)) for f in finds])
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(events, arrow)], names=[*kept, "events"])

    return segments.mapInArrow(run, schema)


def event_rows(applied: DataFrame, tier: str = "T2_human") -> DataFrame:
    """One row per event of rewritten segments."""
    return applied.select("file_rel", "seg_id", F.explode("events").alias("e")).select("file_rel", "seg_id", "e.*", F.lit(tier).alias("tier"))
