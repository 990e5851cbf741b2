"""Scores of detection results against expected values and between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def per_file(expected: DataFrame, caught: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of each file over distinct lower-cased values."""
    low = lambda d, flag: d.select("file", F.lower("value").alias("value"), F.lit(1).alias(flag)).distinct()
    both = low(expected, "e").join(low(caught, "c"), ["file", "value"], "full_outer")
    n = lambda cond: F.sum(cond.cast("long"))
    e, c = F.col("e").isNotNull(), F.col("c").isNotNull()
    counts = both.groupBy("file").agg(n(e & c).alias("tp"), n(~e & c).alias("fp"), n(e & ~c).alias("fn"))
    return with_rates(counts)


def differences(expected: DataFrame, caught: DataFrame) -> DataFrame:
    """(file, kind, value): lower-cased values that were ``missed``, and ``extra`` ones."""
    low = lambda d: d.select("file", F.lower("value").alias("value")).distinct()
    kind = lambda a, b, k: low(a).join(low(b), ["file", "value"], "left_anti").select("file", F.lit(k).alias("kind"), "value")
    return kind(expected, caught, "missed").unionByName(kind(caught, expected, "extra"))


def with_rates(counts: DataFrame, rounded_f1: bool = False) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _share(tp, tp + fp), _share(tp, tp + fn)
    if rounded_f1:
        p, r = F.round(p, 3), F.round(r, 3)
    return counts.withColumns({"precision": F.round(p, 3), "recall": F.round(r, 3), "f1": F.round(_share(2 * p * r, p + r), 3)})


def micro(files: DataFrame) -> DataFrame:
    """Totals over files; f1 of the rounded rates."""
    return with_rates(files.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn"))), rounded_f1=True)


def grade(expected: DataFrame, caught: DataFrame, negatives: DataFrame) -> DataFrame:
    """(kind, category, n): missed values, values under a wrong category, negatives that were caught."""
    got = caught.select("value", F.col("category").alias("got")).distinct()
    first = got.groupBy("value").agg(F.min("got").alias("got"))
    exp = expected.select("category", "value").distinct().join(first, "value", "left")
    missed = exp.where("got is null").groupBy("category").agg(F.count("*").alias("n")).select(F.lit("missed").alias("kind"), "category", "n")
    wrong = exp.where("got <> category").groupBy("category").agg(F.count("*").alias("n")).select(F.lit("wrong_category").alias("kind"), "category", "n")
    false = got.join(negatives.select("value").distinct(), "value", "left_semi").groupBy(F.col("got").alias("category")).agg(F.count("*").alias("n")).select(F.lit("negative").alias("kind"), "category", "n")
    return missed.unionByName(wrong).unionByName(false)


def stability(runs: DataFrame) -> DataFrame:
    """(file, category, value, runs_caught, always) over the runs of each file."""
    total = runs.groupBy("file").agg(F.countDistinct("run_id").alias("runs_total"))
    seen = runs.select("file", "category", "value", "run_id").distinct().groupBy("file", "category", "value").agg(F.count("*").alias("runs_caught"))
    return seen.join(total, "file").select("file", "category", "value", "runs_caught", (F.col("runs_caught") == F.col("runs_total")).alias("always"))


def summary(rows: DataFrame, by: str, column: str) -> DataFrame:
    """min, max, mean and population deviation, rounded to two places."""
    c = F.col(column)
    return rows.groupBy(by).agg(F.round(F.min(c), 2).alias("min_value"), F.round(F.max(c), 2).alias("max_value"), F.round(F.avg(c), 2).alias("mean_value"), F.round(F.stddev_pop(c), 2).alias("stdev_value"))


def by_category(events: DataFrame) -> DataFrame:
    return events.groupBy("category").agg(F.count("*").alias("n_events"), F.countDistinct("from").alias("n_values"))
