"""Images of documents: identity, decisions and redaction of pixels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image_id(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def decided(inventory: DataFrame, decisions: DataFrame) -> DataFrame:
    """Distinct images with redact, skip or defer; without a decision untouched.  Decisions on unknown images drop out."""
    return inventory.dropDuplicates(["image_id"]).join(decisions.dropDuplicates(["image_id"]), "image_id", "left").withColumn("action", F.coalesce("action", F.lit("untouched")))


def counters(done: DataFrame) -> DataFrame:
    return done.groupBy("action").agg(F.count("*").alias("n_images"))


def redact(pixels: np.ndarray, rects: Sequence[tuple[int, int, int, int, str, int]]) -> np.ndarray:
    """Paint rectangles (x, y, w, h, tool, intensity) in order on a copy; tools are blackout and pixelate.

    Rectangles are clamped to the picture; none gives the very same array.
    """
    if not rects:
        return pixels
    out = pixels.copy()
    height, width = out.shape[:2]
    for x, y, w, h, tool, size in rects:
        x0, y0, x1, y1 = max(0, x), max(0, y), min(width, x + w), min(height, y + h)
        if x0 >= x1 or y0 >= y1:
            continue
        if tool == "blackout":
            out[y0:y1, x0:x1] = 0
        elif tool == "pixelate":
            step = max(1, min(128, size or 12))
            for a in range(y0, y1, step):
                for b in range(x0, x1, step):
                    block = out[a : min(a + step, y1), b : min(b + step, x1)]
                    block[...] = block.reshape(-1, *block.shape[2:]).mean(axis=0).astype(out.dtype)
        else:
            raise ValueError(f"unknown tool {tool!r}")
    return out
