"""Helpers shared by the document operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only where it is unset and all tasks run in this process, as in local
    tests, a temporary folder is taken.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="cloakwork-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Shuffle files of plans that nothing refers to any more are given back at
    once: Spark's cleaner waits for the driver to collect its garbage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (case-insensitive)."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name = f"{stem}_{uuid.uuid4().hex[:6]}"
    return name


def text_view(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): extra columns, with whatever names, never reach the operator."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_bucket(id_col: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def crc_bucket_py(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def release() -> None:
    """Give back memory that this Python worker holds but does not use; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that releases memory when its rows are done."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return task


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; a row stays in its partition, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(lean(run), schema)


def sub_batches(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``most`` bytes of ``column`` each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def bounded_sample(df: DataFrame, key: str, most: int, group: str) -> DataFrame:
    """At most ``most`` rows of each ``group`` of ``df``, one of each ``key``: those with the smallest hashes of the key.

    Rows whose hash lies beyond the share of their group that is needed, with
    room to spare, are dropped where they are read, so tasks send some three
    times ``most`` rows of a group in all, not each so many.  How many rows a
    group has goes to the driver, so groups must be few (languages, classes).
    """
    span = 1 << 40
    rows = {r[0]: r[1] for r in df.groupBy(group).count().collect()}
    place = F.pmod(F.xxhash64(key), F.lit(span))
    limit = F.lit(span)
    for value, n in rows.items():
        if n > 3 * most:
            limit = F.when(F.col(group) == value, F.lit(int(3 * most / n * span))).otherwise(limit)
    place_col, nth = fresh(df, "place"), fresh(df, "nth")
    near = df.withColumn(place_col, place).where(F.col(place_col) < limit)
    others = [F.xxhash64(c) for c in df.columns if c != key]
    one = near.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(*others))).where(F.col(nth) == 1)
    first = one.withColumn(nth, F.row_number().over(Window.partitionBy(group).orderBy(place_col, key))).where(F.col(nth) <= most)
    return first.drop(place_col, nth)
