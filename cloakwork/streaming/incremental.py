"""Detection over a stream of new segments, with indices kept between batches.

An extension: the batch operators run in ``foreachBatch``, and the index table
grows by each batch's new keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import detect, index


def watch(segments: DataFrame, out: str, state: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each batch's candidates with placeholders below ``out``, and known indices below ``state``.

    Both paths get one folder per batch, overwritten when a batch runs again,
    so a restart after a failure gives the same numbers.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(f"{state}/v={batch_id - 1}") if batch_id else None
        cands = detect.candidates(detect.detect(batch))
        done = index.materialised(detect.with_placeholders(cands, known))
        done.drop("first").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        fresh = done.select("bucket", "key", "n").distinct()
        grown = fresh if known is None else known.unionByName(fresh.join(known, ["bucket", "key"], "left_anti"))
        grown.write.mode("overwrite").parquet(f"{state}/v={batch_id}")

    return segments.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
