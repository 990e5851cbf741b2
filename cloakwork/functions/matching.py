"""Regular-expression matches with code-point offsets, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a snippet on either side of the match.
AROUND = 40
MATCHES = "array<struct<off:int,value:string>>"


def quote(literal: str) -> str:
    """A pattern that matches ``literal`` and nothing else, in Java's dialect."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<off, value>> of all matches; ``pattern`` must not match the empty string.

    Offsets are those of Python's ``finditer``: lengths of the gaps and matches
    before, so astral characters count one.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), values.alias("value"))

    def step(state: Column, pair: Column) -> Column:
        off = state["pos"] + F.length(pair["gap"])
        found = F.array(F.struct(off.cast("int").alias("off"), pair["value"].alias("value")))
        return F.struct((off + F.length(pair["value"])).cast("int").alias("pos"), F.concat(state["out"], found).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(MATCHES).alias("out"))
    named = F.transform(pairs, lambda p: F.struct(F.coalesce(p["gap"], F.lit("")).alias("gap"), p["value"].alias("value")))
    walked = F.aggregate(F.filter(named, lambda p: p["value"].isNotNull()), start, step, lambda s: s["out"])
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(MATCHES))


def searched(value: Column, patterns: Sequence[str]) -> Column:
    """Does any pattern find something in ``value``?"""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | value.rlike(p)
    return hit


def snippet(text: Column, off: Column, length: Column, around: int = AROUND) -> Column:
    """The match with ``around`` characters on either side, on one line."""
    start = F.greatest(F.lit(0), off - around)
    return F.trim(F.translate(F.substr(text, start + 1, off + length + around - start), "\n", " "))
