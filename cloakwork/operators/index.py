"""Stable running numbers of distinct keys within buckets."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def materialised(df: DataFrame) -> DataFrame:
    """Checkpoint in the cluster's shared folder (``spark.checkpoint.dir``); a temporary one only where it is unset and all runs in this process."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="cloakwork-"))
    return df.checkpoint(eager=True)


def first_sightings(rows: DataFrame, bucket: str, key: str, order: list[str]) -> DataFrame:
    """(bucket, key, first) of each distinct key; ``first`` is the smallest struct of ``order``."""
    return rows.groupBy(F.col(bucket).alias("bucket"), F.col(key).alias("key")).agg(F.min(F.struct(*order)).alias("first"))


def running(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank``, from 0 in ``order``: a range sort, numbered in place; only a count for each partition is gathered."""
    at, part, before = (_fresh(rows, c) for c in ("at", "part", "before"))
    place = materialised(rows.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    sizes = place.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count("*").alias("n"))  # one row for each partition
    starts = sizes.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    numbered = place.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(starts), part)
    return numbered.select(*rows.columns, (F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("rank"))


def _fresh(rows: DataFrame, stem: str) -> str:
    """A column name that ``rows`` does not have."""
    have = {c.lower() for c in rows.columns}
    return next(name for n in range(len(have) + 1) if (name := f"{stem}_{n}") not in have)


def number_keys(keys: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(bucket, key, n): keys are numbered from 1 in the order of ``first`` within each bucket.

    ``known`` (bucket, key, n) is kept; new keys go on after the bucket's
    largest number.  Keys are numbered over all buckets, and a bucket's first
    number is taken off, so that one bucket may hold any number of keys.
    """
    new = keys
    if known is not None:
        new = keys.join(known.select("bucket", "key"), ["bucket", "key"], "left_anti")
    ranked = running(new.select("bucket", "key", "first"), ["bucket", "first"]).select("bucket", "key", "rank")
    base = ranked.groupBy("bucket").agg(F.min("rank").alias("base"))
    if known is None:
        return ranked.join(base, "bucket").select("bucket", "key", (F.col("rank") - F.col("base") + 1).alias("n"))
    last = known.groupBy("bucket").agg(F.max("n").alias("last"))
    numbered = ranked.join(base, "bucket").join(last, "bucket", "left").select("bucket", "key", (F.col("rank") - F.col("base") + 1 + F.coalesce("last", F.lit(0))).alias("n"))
    return known.select("bucket", "key", F.col("n").cast("long").alias("n")).unionByName(numbered)
