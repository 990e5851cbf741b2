"""Residual leaks in rewritten text, and the loop that resolves them."""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from os.path import commonprefix

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matching, placeholders, text
from ..functions.literals import fold, overlaps_itself, same_in_any_case, whole_word, worker_cache
from ..rules import CATEGORIES, DEFAULT_RULES, SWEPT_CATEGORIES, Rule
from . import detect, index, rewrite, submap

#: Map values of one pass over the texts.
PASS_VALUES = 500_000
#: Letters of them, without those that a value shares with the one before; an automaton takes some 50 bytes for each.
PASS_LETTERS = 1_500_000
#: Hits that a task holds before it hands them on.
BATCH_HITS = 20_000
#: Rank of the first swept value among the sources of a hit: after all rules.
FIRST_SWEPT = 1 << 32
REGRESSION = "regression:from-value"


def swept_values(smap: DataFrame, least: int = 3) -> DataFrame:
    """(rank, from, to, name) of textual map entries that are looked for in any case, the first of each spelling, in map order."""
    order = F.array_position(F.array(*map(F.lit, SWEPT_CATEGORIES)), F.col("category"))
    rows = smap.where(F.col("category").isin(*SWEPT_CATEGORIES)).select("category", "entry_ord", "id", F.trim("from").alias("f"), F.trim("to").alias("t"), order.alias("o"))
    first = rows.where(F.length("f") >= least).groupBy(F.lower("f")).agg(F.min_by(F.struct("f", "t", "id", "category", "o", "entry_ord"), F.struct("o", "entry_ord")).alias("m")).select("m.*")
    named = F.concat(F.lit("map:"), F.coalesce(F.when(F.col("id") != "", F.col("id")), F.col("category")))
    return index.running(first.select("o", "entry_ord", F.col("f").alias("from"), F.col("t").alias("to"), named.alias("name")), ["o", "entry_ord"]).select("rank", "from", "to", "name")


def guarded_values(smap: DataFrame) -> DataFrame:
    """(from) of all map values, as they are, less those that their own placeholder holds."""
    return smap.where("`from` <> ''").select("from").distinct().join(submap.supersets(smap).select("from").distinct(), "from", "left_anti")


_HIT = "file_rel string, pattern string, match string, off int, src long, snippet string"
_VALUE = "key string, from string, rank long, to string, name string"
_COUNT = "file_rel string, source string, n_hits long"


def _cleaner(normalise: bool) -> Callable[[str], str]:
    return text.normalize_text if normalise else str


def _keyed(values: DataFrame | None, swept: DataFrame | None, normalise: bool) -> DataFrame:
    """Values (rank null) and swept values in one table with ``key``, the fold of what is looked for; equal at all finds with one start and length."""
    clean = _cleaner(normalise)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [fold(clean(v) if rank is None else v) for v, rank in zip(batch.column("from").to_pylist(), batch.column("rank").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *batch.columns], names=["key", *batch.schema.names])

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    exact = None if values is None else values.select("from", none("long", "rank"), none("string", "to"), none("string", "name"))
    loose = None if swept is None else swept.select("from", "rank", "to", "name")
    rows = loose if exact is None else exact if loose is None else exact.unionByName(loose)
    return rows.mapInArrow(run, _VALUE)


def parts(keyed: DataFrame) -> Iterator[pa.Table]:
    """``keyed`` in pieces that a worker can hold, in order of the key; rows of one key stay together.

    The driver holds a partition and a piece at most.  What a value adds to its
    automaton is no more than its letters beyond what it shares with the one before.
    """
    names = ["from", "rank", "to", "name"]
    schema = pa.schema([("from", pa.string()), ("rank", pa.int64()), ("to", pa.string()), ("name", pa.string())])
    done, rows, count, nodes, last, before = [], [], 0, 0, None, {True: "", False: ""}

    def flush() -> None:
        if rows:
            done.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema))
            rows.clear()

    for r in keyed.orderBy("key", "from", "rank").toLocalIterator():
        if r["key"] != last and (count >= PASS_VALUES or nodes >= PASS_LETTERS):
            flush()
            yield pa.Table.from_batches(done, schema)
            done, count, nodes, before = [], 0, 0, {True: "", False: ""}
        kind, word = r["rank"] is None, r["from"] if r["rank"] is None else r["key"]
        count, nodes, last = count + 1, nodes + len(word) - len(commonprefix((word, before[kind]))), r["key"]
        before[kind] = word
        rows.append(tuple(r[c] for c in names))
        if len(rows) == 20_000:
            flush()
    flush()
    if done:
        yield pa.Table.from_batches(done, schema)


class Values:
    """A piece of the values as two automata of row numbers; texts, ranks and names stay in Arrow's buffers."""

    def __init__(self, piece: pa.Table, clean: Callable[[str], str]):
        self.exact, self.loose = ahocorasick.Automaton(ahocorasick.STORE_INTS), ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.size = array("I", bytes(4 * piece.num_rows))
        self.again = bytearray(piece.num_rows)  # values that may overlap themselves
        self.same: dict[int, list[int]] = {}  # swept values of one fold, by the first of them
        self.held: dict[int, tuple] = {}
        self.starts: list[int] = []  # of the batches
        at = 0
        self.batches = piece.to_batches(max_chunksize=20_000)
        for batch in self.batches:
            self.starts.append(at)
            for i, (value, rank) in enumerate(zip(batch.column("from").to_pylist(), batch.column("rank").to_pylist(), strict=True), at):
                found, word = (self.exact, clean(value)) if rank is None else (self.loose, fold(value))
                if not word:
                    continue
                self.size[i], self.again[i] = len(word), overlaps_itself(word)
                if (first := found.get(word, -1)) < 0:
                    found.add_word(word, i)
                elif rank is not None:  # of values that are the same when clean, the first stays
                    self.same.setdefault(first, [first]).append(i)
            at += batch.num_rows
        for found in (self.exact, self.loose):
            if len(found):
                found.make_automaton()

    def row(self, i: int) -> tuple:
        """(rank, from, to, name)"""
        if i not in self.held:
            if len(self.held) >= 1 << 14:
                self.held.clear()
            k = bisect_right(self.starts, i) - 1
            self.held[i] = tuple(self.batches[k].column(c)[i - self.starts[k]].as_py() for c in ("rank", "from", "to", "name"))
        return self.held[i]

    def finds(self, body: str) -> Iterator[tuple[int, int, int, bool]]:
        """(start, length, row, swept), one of each start and length: values where they stand, then swept ones; those of one value are apart from each other."""
        size, again, ends, kept = self.size, self.again, {}, set()
        if len(self.exact):
            for end, i in self.exact.iter(body):
                start = end + 1 - size[i]
                if again[i]:
                    if start < ends.get(i, 0):
                        continue
                    ends[i] = end + 1
                    kept.add((start, i))
                yield start, size[i], i, False
        if not len(self.loose):
            return
        ends.clear()
        for end, first in self.loose.iter(fold(body)):
            a, b, stop = body[end], body[end + 1 : end + 2], end + 1
            if (a.isalnum() or a == "_") == (b.isalnum() or b == "_"):
                continue  # no word border behind it
            n = size[first]
            start = stop - n
            a, b = body[start], body[start - 1 : start] if start else ""
            if (a.isalnum() or a == "_") == (b.isalnum() or b == "_"):
                continue
            found, taken = body[start:stop], None
            for i in sorted(self.same[first], key=self.row) if first in self.same else (first,):
                rank, value, to, _ = self.row(i)
                if start >= ends.get(i, 0) and (found == value or whole_word(value).match(body, start)):
                    ends[i] = stop
                    if taken is None and not (to and (len(to) == n or found[-1] == "\n") and same_in_any_case(to).search(found)):
                        taken = i
            if taken is not None:
                i = self.exact.get(found, -1) if len(self.exact) else -1
                if i < 0 or again[i] and (start, i) not in kept:
                    yield start, n, taken, True


def _values(shared, token: str, normalise: bool) -> Values:
    return worker_cache(lambda: Values(pa.ipc.open_stream(shared.value).read_all(), _cleaner(normalise)), token)


def _passes(segments: DataFrame, values: DataFrame | None, swept: DataFrame | None, normalise: bool, rows: Callable[[Iterator[tuple], Values], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``rows`` makes of (file_rel, text) and values, for each piece of the values in a pass of its own."""
    made, segments = None, segments.select("file_rel", "text")
    for piece in parts(_keyed(values, swept, normalise)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, piece.schema) as out:
            out.write_table(piece)
        shared, token = segments.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=token) -> Iterator[pa.RecordBatch]:
            texts = ((batch.column("file_rel")[i].as_py(), batch.column("text")[i].as_py()) for batch in batches for i in range(batch.num_rows))
            yield from rows(texts, _values(shared, token, normalise))

        one = segments.mapInArrow(run, schema)
        made = one if made is None else made.unionByName(one)
    return segments.sparkSession.createDataFrame([], schema) if made is None else made


def hit_batches(texts: Iterator[tuple], values: Values) -> Iterator[pa.RecordBatch]:
    """Hits of (file_rel, text) as batches of ``BATCH_HITS`` rows at most, however many hits a text has."""
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["file_rel", "pattern", "match", "off", "src", "snippet"])

    for file_rel, body in texts:
        for start, n, i, loose in values.finds(body):
            rank, value, _, name = values.row(i)
            snippet = body[max(0, start - matching.AROUND) : start + n + matching.AROUND].replace("\n", " ").strip(" ")
            out.append((file_rel, name, body[start : start + n], start, FIRST_SWEPT + rank, snippet) if loose else (file_rel, REGRESSION, value, start, 0, snippet))
            if len(out) >= BATCH_HITS:
                yield batch()
    if out:
        yield batch()


def count_batches(texts: Iterator[tuple], values: Values) -> Iterator[pa.RecordBatch]:
    """(file_rel, source, n_hits) of (file_rel, text), at most two rows a text."""
    out: list[tuple] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["file_rel", "source", "n_hits"])
    for file_rel, body in texts:
        n = [0, 0]
        for *_, loose in values.finds(body):
            n[loose] += 1
        out += [(file_rel, source, k) for source, k in ((REGRESSION, n[0]), ("map", n[1])) if k]
        if len(out) >= BATCH_HITS:
            yield batch()
            out.clear()
    if out:
        yield batch()


def literal_hits(segments: DataFrame, values: DataFrame | None = None, swept: DataFrame | None = None, normalise: bool = False) -> DataFrame:
    """Hits (file_rel, pattern, match, off, src, snippet) of ``values`` (from), case-sensitive, and of ``swept`` values.

    Map values go to tasks in pieces of ``PASS_VALUES`` or ``PASS_LETTERS``,
    each in a pass of its own.  Finds of one value are apart from each other; of
    those with one start and length the first source stays.  All values that can
    meet so are in one piece, so that passes need not know of each other.
    """
    return _passes(segments, values, swept, normalise, hit_batches, _HIT)


def literal_counts(segments: DataFrame, smap: DataFrame, normalise: bool = True) -> DataFrame:
    """(file_rel, source, n_hits) of the map's values, the source ``regression:from-value`` or ``map``: how many rows ``verify`` without rules has, counted where the texts are."""
    body = segments.select("file_rel", (text.normalize(F.col("text")) if normalise else F.col("text")).alias("text")).where(F.coalesce("text", F.lit("")) != "")
    return _passes(body, guarded_values(smap), swept_values(smap), normalise, count_batches, _COUNT).groupBy("file_rel", "source").agg(F.sum("n_hits").alias("n_hits"))


def verify(segments: DataFrame, smap: DataFrame | None = None, rules: Sequence[Rule] = DEFAULT_RULES, normalise: bool = True) -> DataFrame:
    """Hits (file_rel, pattern, match, off, snippet) in ``segments`` (file_rel, text).

    Values of the map first (less those that their own placeholder holds), then
    the rules, then the map's swept values; of hits with one start and length
    the earliest source stays.
    """
    body = segments.select("file_rel", F.col("text").alias("raw")).withColumn("text", text.normalize(F.col("raw")) if normalise else F.col("raw")).drop("raw")
    body = body.where(F.coalesce("text", F.lit("")) != "")
    found = []
    if rules:
        seg = body.select("file_rel", F.lit(0).alias("seg_ord"), F.col("file_rel").alias("seg_id"), "text")
        found.append(detect.occurrences(seg, rules, snippets=True).select("file_rel", F.col("rule").alias("pattern"), F.col("value").alias("match"), "off", (F.col("rule_ord") + 1).cast("long").alias("src"), "snippet"))
    if smap is not None:
        found.append(literal_hits(body, guarded_values(smap), swept_values(smap), normalise))
    if not found:
        return segments.sparkSession.createDataFrame([], _HIT).drop("src")
    hits = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    first = hits.groupBy("file_rel", "off", F.length("match").alias("n")).agg(F.min_by(F.struct("pattern", "match", "snippet"), F.struct("src", "match")).alias("m"))
    return first.select("file_rel", "m.pattern", "m.match", "off", "m.snippet")


def derive(hits: DataFrame, smap: DataFrame) -> DataFrame:
    """Entries (value, category, placeholder) for hit values that the map holds in another case."""
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    known = smap.where("`from` <> ''").groupBy(F.lower("from").alias("low")).agg(F.min_by(F.struct("category", "to"), F.struct(order, "entry_ord")).alias("m")).select("low", "m.*")
    values = hits.select(F.col("match").alias("value")).where("value <> ''").distinct().withColumn("low", F.lower("value"))
    v = F.col("value")
    shaped = values.join(known, "low").where("`to` <> ''").withColumn("p", text.match_case(v, F.col("to"))).where(F.col("p") != v)
    cut = shaped.withColumn("placeholder", F.when(placeholders.overlong(v, F.col("p")), placeholders.clamp(v, F.col("p"))).otherwise(F.col("p")))
    return cut.where((F.col("placeholder") != "") & (F.col("placeholder") != v)).select("value", "category", "placeholder")


def review_queue(hits: DataFrame) -> DataFrame:
    """What is left for people to decide: (value, category, pattern, count, snippet) of each value, the category guessed from its first pattern."""
    rows = hits.where("match <> ''").groupBy(F.col("match").alias("value")).agg(F.min("pattern").alias("pattern"), F.count("*").alias("count"), F.min("snippet").alias("snippet"))
    return rows.select("value", text.category_of_pattern(F.col("pattern")).alias("category"), "pattern", "count", "snippet")


def auto_resolve(
    source: DataFrame, smap: DataFrame, rounds: int = 2, rules: Sequence[Rule] = DEFAULT_RULES, audit: Callable[[DataFrame], DataFrame] | None = None, sure: float = 0.92
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verify, derive entries for what is left, rewrite from the source again; (segments, map, hits).

    ``source`` is (file_rel, seg_ord, seg_id, text).  Values that the map holds
    in another case take its placeholder; ``audit``, if given, gets the review
    queue of the others and answers (value, category, placeholder, confidence),
    of which those of at least ``sure`` are added.  Ends after ``rounds``, or
    when nothing new comes up; ``review_queue`` of the hits is left to people.
    Each round's map is a checkpoint.
    """
    done = rewrite.apply_rules(source, rewrite.compile_rules(smap))
    for _ in range(rounds):
        hits = index.materialised(verify(done, smap, rules))
        new = derive(hits, smap)
        if audit:
            left = review_queue(hits).join(new.select("value"), "value", "left_anti")
            answers = audit(left).where(F.col("confidence") >= sure).select("value", submap.known_category().alias("category"), "placeholder")
            new = new.unionByName(answers.join(left.select("value"), "value", "left_semi"))
        new = new.withColumn("ord", F.xxhash64("value")).join(smap.select("category", F.col("from").alias("value")), ["category", "value"], "left_anti")
        new = index.materialised(new)
        if not new.limit(1).count():
            break
        smap = index.materialised(submap.merge(smap, new))
        done = rewrite.apply_rules(source, rewrite.compile_rules(smap))
    return done, smap, verify(done, smap, rules)
