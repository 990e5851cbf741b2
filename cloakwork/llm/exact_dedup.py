"""Exact duplicates by an extendible-hash index on shared files.

Keys are 64-bit hashes of whole texts; a first pass writes the rows' keys into
the shared checkpoint folder, and only texts whose key stands on several rows
are looked at again.  The key space is cut into ranges, which are dealt to
owner tasks.  An owner gets the entries of a range in key order, chains those
of one key, comparing bytes, so that two texts with one hash stay apart, and
puts each text into the range's extendible-hash directory: a bucket that holds
more keys than its capacity is split, and where it has a single slot the
directory doubles first (one key alone is never split).  The buckets of all
ranges are the index; they lie in the shared checkpoint folder, and rows find
their group by joining it.  Neither keys nor directories pass the driver.

Map tasks chain their own rows first and send one entry for each different
text, so a group of copies that holds a third of all rows reaches its owner as
one entry for each window of a map task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, lean, sub_batches

#: Distinct keys a bucket may hold before it is split.
BUCKET_KEYS = 4096
#: Times a range's directory doubles at most; a bucket at that depth takes more keys than its capacity.
MOST_DOUBLINGS = 16
#: Key ranges of each owner task, more or less.
OWNER_RANGES = 4
#: Bytes of different texts that a map task chains before it sends them on.
WINDOW_BYTES = 24 << 20
#: Up to so many keys or index rows (some 40 bytes each) go to every task; beyond, all rows are shuffled by key, with the same result.
LISTED = 1 << 20

_ENTRY = "range int, key long, text binary, last_id long, rows long"
_INDEX = "depth int, prefix long, key long, sha string, keep_id long, group_size long"


class Directory:
    """Extendible hashing of one key range: slots point to buckets, which hold the entries of up to ``capacity`` keys."""

    def __init__(self, range_bits: int, capacity: int):
        self.bits, self.capacity = range_bits, capacity
        self.depth = 0  # bits below the range's own that the directory tells apart
        self.slots: list[dict] = [self._bucket(0)]

    @staticmethod
    def _bucket(depth: int) -> dict:
        return {"depth": depth, "keys": {}}

    def _slot(self, key: int) -> int:
        return (key & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits - self.depth) & ((1 << self.depth) - 1)

    def add(self, key: int, entry: tuple) -> None:
        bucket = self.slots[self._slot(key)]
        bucket["keys"].setdefault(key, []).append(entry)
        while len(bucket["keys"]) > self.capacity and bucket["depth"] < min(MOST_DOUBLINGS, 64 - self.bits):
            self._split(bucket)
            bucket = self.slots[self._slot(key)]

    def _split(self, bucket: dict) -> None:
        if bucket["depth"] == self.depth:  # a single slot: the directory doubles
            self.slots = [b for b in self.slots for _ in (0, 1)]
            self.depth += 1
        halves = [self._bucket(bucket["depth"] + 1) for _ in (0, 1)]
        shift = 64 - self.bits - bucket["depth"] - 1
        for key, entries in bucket["keys"].items():
            halves[(key & 0xFFFFFFFFFFFFFFFF) >> shift & 1]["keys"][key] = entries
        deeper = self.depth - bucket["depth"]
        first = self._slot(next(iter(bucket["keys"]))) >> deeper << deeper
        each = 1 << (deeper - 1)
        for k, half in enumerate(halves):
            self.slots[first + k * each : first + (k + 1) * each] = [half] * each

    def rows(self, range_: int) -> Iterator[tuple]:
        """(depth, prefix, key, entry) of every bucket, in key order; depth and prefix count from the top of the key."""
        at = 0
        while at < len(self.slots):
            bucket = self.slots[at]
            deeper = self.depth - bucket["depth"]
            for key, entries in bucket["keys"].items():
                for entry in entries:
                    yield self.bits + bucket["depth"], range_ << bucket["depth"] | at >> deeper, key, entry
            at += 1 << deeper


def _entries(docs: DataFrame, range_bits: int) -> DataFrame:
    """One entry for each different text of a window of a map task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains: dict[int, list[list]] = {}
        held = 0

        def send() -> pa.RecordBatch:
            rows = [(k, *e) for k, chain in chains.items() for e in chain]
            chains.clear()
            columns = [[(k & 0xFFFFFFFFFFFFFFFF) >> (64 - range_bits) for k, *_ in rows], *zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["range", "key", "text", "last_id", "rows"])

        for whole in batches:
            for batch in sub_batches(whole):
                for doc_id, text, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "key")), strict=True):
                    chain = chains.setdefault(key, [])
                    for entry in chain:
                        if entry[0] == text:
                            entry[2] += 1
                            if doc_id is not None and (entry[1] is None or doc_id > entry[1]):
                                entry[1] = doc_id
                            break
                    else:
                        chain.append([text, doc_id, 1])
                        held += len(text)
                if held >= WINDOW_BYTES:
                    yield send()
                    held = 0
        if chains:
            yield send()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), "key").mapInArrow(lean(run), _ENTRY)


def _own(range_bits: int, bucket_keys: int):
    """Entries in the order of range and key; gives the index rows of texts that more than one row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_, directory = None, Directory(range_bits, bucket_keys)
        key, chain = None, []

        def close_key() -> None:
            seen = set()
            for text, last_id, rows in chain:
                sha = hashlib.sha256(text).hexdigest()
                if sha in seen:
                    raise ValueError("two different texts with one SHA-256")
                seen.add(sha)
                if rows > 1:
                    directory.add(key, (sha, last_id, rows))

        def index() -> Iterator[pa.RecordBatch]:
            rows = [(d, p, k, *e) for d, p, k, e in directory.rows(range_ or 0)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["depth", "prefix", "key", "sha", "keep_id", "group_size"])

        for batch in batches:
            for r, k, text, last_id, rows in zip(*(batch.column(c).to_pylist() for c in ("range", "key", "text", "last_id", "rows")), strict=True):
                if k != key:
                    close_key()
                    key, chain = k, []
                if r != range_:
                    yield from index()
                    range_, directory = r, Directory(range_bits, bucket_keys)
                for entry in chain:
                    if entry[0] == text:
                        entry[2] += rows
                        if last_id is not None and (entry[1] is None or last_id > entry[1]):
                            entry[1] = last_id
                        break
                else:
                    chain.append([text, last_id, rows])
        close_key()
        yield from index()

    return run


def _text(text_col: str, normalise=None):
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return normalise(text) if normalise else text


def _listed(rows: DataFrame) -> DataFrame:
    """``rows`` with a broadcast hint if there are no more than ``LISTED``."""
    return F.broadcast(rows) if rows.limit(LISTED + 1).count() <= LISTED else rows


def build_index(docs: DataFrame, thin: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The index over texts that several rows of ``docs`` (doc_id, text, key) hold.

    ``thin`` holds the rows' keys.  One row for each such text: depth and
    prefix of its bucket, key, sha, keep_id (the largest id), group_size.
    """
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_bits = max(1, (OWNER_RANGES * owners - 1).bit_length())
    repeated = cut(thin.groupBy("key").count().where("count > 1").select("key"))
    if repeated.limit(LISTED + 1).count() <= LISTED:
        docs = docs.join(F.broadcast(repeated), "key", "left_semi")
    entries = _entries(docs, range_bits).repartition(owners, "range").sortWithinPartitions("range", "key")
    return cut(entries.mapInArrow(lean(_own(range_bits, bucket_keys)), _INDEX))


def exact_groups(docs: DataFrame, *, bucket_keys: int = BUCKET_KEYS, id_col: str = "doc_id", text_col: str = "text", normalise=None) -> DataFrame:
    """Group rows with equal whole texts; of a group the row with the largest id stays.

    ``normalise`` is a function of a string column that is applied first (none:
    texts must be identical).  Returns doc_id, keep_id, group_size, kept,
    text_sha256 for every row.  Null texts count as empty; null ids are below
    all others; where the largest id stands on several equal rows exactly one
    of them is kept; an empty table gives no rows; other columns are ignored.
    """
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _text(text_col, normalise).alias("text")).withColumn("key", F.xxhash64("text"))
    thin = cut(keyed.select("doc_id", "key", F.sha2("text", 256).alias("sha")))
    index = build_index(keyed, thin, bucket_keys)
    joined = thin.join(_listed(index.select("key", "sha", "keep_id", "group_size")), ["key", "sha"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    judged = joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("sha").alias("text_sha256"))
    first = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("keep_id")) == 1
    return judged.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, *, bucket_keys: int = BUCKET_KEYS, id_col: str = "doc_id", text_col: str = "text", normalise=None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows equal in id and text one stays.

    Rows whose text is in no group stay where they are; where the index is
    listed, only the rows with a group's largest id are shuffled.
    """
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _text(text_col, normalise).alias("text")).withColumn("key", F.xxhash64("text"))
    index = build_index(keyed, keyed.select("key"), bucket_keys)
    key, sha, keep_id, size, place = (fresh(docs, c) for c in ("key", "sha", "keep_id", "group_size", "place"))
    groups = _listed(index.select(F.col("key").alias(key), F.col("sha").alias(sha), F.col("keep_id").alias(keep_id), F.col("group_size").alias(size)))
    text = _text(text_col, normalise)
    marked = docs.withColumns({key: F.xxhash64(text), sha: F.sha2(text, 256)}).join(groups, [key, sha], "left")
    alone = marked.where(F.col(size).isNull())
    best = marked.where(F.col(size).isNotNull() & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(keep_id)))
    one = best.withColumn(place, F.row_number().over(Window.partitionBy(key, sha).orderBy(keep_id))).where(F.col(place) == 1)
    return alone.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(one.select(*(F.col(f"`{c}`") for c in docs.columns)))
