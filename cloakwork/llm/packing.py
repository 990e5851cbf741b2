"""Packing of token pieces into training sequences by vector bin packing.

A sequence has three limits at once: tokens, segments (pieces) and
loss-bearing tokens.  A piece is a vector of the three; an open sequence has
the vector of what is left.  The dot-product heuristic puts into the open
sequence the piece, of those that fit, whose vector has the largest dot
product with what is left, each dimension taken as a share of its limit.
What is still open is filled with a part cut from the longest piece.  A
sequence that cannot be full, because the segments or the loss-bearing tokens
ran out or no piece is left, ends at the largest power of two below, which
needs no padding, and the rest waits for the next one.

Each task packs its own rows from a bounded pool, so nothing is shuffled and
no group is gathered; sequence ids hold the partition in their upper bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import lean, sub_batches

#: Pieces a task holds before it closes sequences; more give less padding, the memory is this times the capacity.
POOL = 1024
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long"
_FIELDS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "segment": pa.int32(), "loss_tokens": pa.int64()}


class Packer:
    """Takes documents' ids, gives pieces of closed sequences."""

    def __init__(self, first_sequence: int, tokens: int, segments: int, loss: int, pool: int = POOL, keep_ids: bool = False):
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.tokens, self.keep_ids, self.loss = tokens, keep_ids, loss
        self.most = pool
        self.next = first_sequence
        self.sizes = np.zeros((2 * pool, 3))  # of each waiting piece: tokens, segments, loss-bearing tokens; no tokens: a free place
        self.items: list[tuple | None] = [None] * (2 * pool)
        self.free = list(range(2 * pool))
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray, bearing_from: int) -> None:
        """A document; its ids from place ``bearing_from`` on bear loss."""
        n, start = len(ids), 0
        while start < n:
            room = min(self.tokens, max(bearing_from - start, 0) + self.loss)
            length = min(room, n - start)
            piece = (doc_id, ids, start, length, bearing_from)
            start += length
            if length == self.tokens:
                self._emit([piece])
            else:
                self._wait(piece)
                while len(self.free) <= self.most:  # a close may give back as many pieces as it takes, but fewer tokens
                    self._close()

    def finish(self) -> None:
        while len(self.free) < len(self.items):
            self._close()

    @staticmethod
    def _bearing(piece: tuple) -> int:
        _, _, start, length, bearing_from = piece
        return max(0, start + length - max(start, bearing_from))

    def _wait(self, piece: tuple) -> None:
        at = self.free.pop()
        self.items[at] = piece
        self.sizes[at] = piece[3], 1, self._bearing(piece)

    def _take(self, at: int) -> tuple:
        piece = self.items[at]
        self.items[at] = None
        self.sizes[at] = 0
        self.free.append(at)
        return piece

    def _close(self) -> None:
        """Fill one sequence from the waiting pieces."""
        left, chosen = self.limits.copy(), []
        while True:
            fits = (self.sizes[:, 0] > 0) & (self.sizes <= left).all(axis=1)
            score = np.where(fits, self.sizes @ (left / self.limits**2), -1.0)
            at = int(score.argmax())
            if score[at] < 0:
                break
            left -= self.sizes[at]
            chosen.append(self._take(at))
        if left[0] >= 1 and left[1] >= 1 and len(self.free) < len(self.items):
            waiting = np.flatnonzero(self.sizes[:, 0] > 0)
            at = int(waiting[self.sizes[waiting, 0].argmax()])  # the longest, so that few documents are cut
            doc_id, ids, start, length, bearing_from = self.items[at]
            part = int(min(left[0], length - 1, max(bearing_from - start, 0) + left[2]))
            if part > 0:
                self._take(at)
                chosen.append((doc_id, ids, start, part, bearing_from))
                self._wait((doc_id, ids, start + part, length - part, bearing_from))
        held = sum(p[3] for p in chosen)
        over = held - (held if held == self.tokens else 1 << held.bit_length() - 1)
        while over:
            doc_id, ids, start, length, bearing_from = chosen.pop()
            back = min(over, length)
            if back < length:
                chosen.append((doc_id, ids, start, length - back, bearing_from))
            self._wait((doc_id, ids, start + length - back, back, bearing_from))
            over -= back
        self._emit(chosen)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for k, piece in enumerate(pieces):
            doc_id, ids, start, length, _ = piece
            part = ids[start : start + length]
            row = (doc_id, start, length, zlib.crc32(part.tobytes()), len(ids), self.next, offset, k, self._bearing(piece))
            self.rows.append((*row, part.astype(np.int32)) if self.keep_ids else row)
            offset += length
        self.next += 1

    def taken(self) -> pa.RecordBatch | None:
        """The rows made since the last call."""
        if not self.rows:
            return None
        columns = list(zip(*self.rows, strict=True))
        self.rows = []
        out = {name: pa.array(c, kind) for (name, kind), c in zip(_FIELDS.items(), columns, strict=False)}
        if self.keep_ids:
            out["ids"] = pa.array(columns[-1], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(out)


def pack_documents(
    docs: DataFrame,
    vocab_path: str,
    *,
    max_tokens: int = 2048,
    max_segments: int = 512,
    max_loss_tokens: int | None = None,
    end_id: int = 1,
    prompt_chars: str | None = None,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    pool: int = POOL,
) -> DataFrame:
    """Pack whole texts, each followed by ``end_id``, into sequences of at most ``max_tokens``.

    ``prompt_chars`` names a column with the number of leading characters that
    bear no loss (instruction data); without it every token bears loss.  One
    row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, segment (its place in the sequence), loss_tokens, and ids if asked.

    A null or empty text is the end id alone.  Null ids and repeated rows are
    packed row by row; an empty table gives no rows; other columns are ignored.
    Each id lies in exactly one piece.  Every sequence holds ``max_tokens`` or
    a power of two, so that none is padded.
    """
    loss = max_tokens if max_loss_tokens is None else max_loss_tokens
    if min(max_tokens, max_segments, loss) < 1:
        raise ValueError("limits must be positive")
    prompt = F.coalesce(F.col(prompt_chars).cast("long"), F.lit(0)) if prompt_chars else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), prompt.alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.loaded(vocab_path)
        packer = Packer(TaskContext.get().partitionId() << 40, max_tokens, max_segments, loss, pool, keep_ids=keep_ids)
        for whole in batches:
            for batch in sub_batches(whole):
                for doc_id, text, chars in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "prompt")), strict=True):
                    ids = encoder.library_ids(text or "")
                    bearing = 0 if chars <= 0 or not text else int(np.searchsorted(np.cumsum(encoder.token_sizes[ids]), len(text[:chars].encode())))
                    packer.add(doc_id, np.append(ids, np.uint32(end_id)), bearing)
                if (out := packer.taken()) is not None:
                    yield out
        packer.finish()
        if (out := packer.taken()) is not None:
            yield out

    return rows.mapInArrow(lean(run), _SCHEMA + ", ids array<int>" * keep_ids)
