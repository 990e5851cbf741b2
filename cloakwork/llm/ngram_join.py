"""Self-join of documents on the Jaccard similarity of their word n-gram sets.

Candidates come from a partition of the universe.  The hash range of n-grams
is cut into segments whose number depends on a band of set sizes: two sets of
a band with the wanted similarity differ in at most H elements, so with exact
segments (weight 1) and segments with one-deletion neighbourhoods (weight 2)
whose weights sum to H + 1, they agree on an exact segment or differ by one
element at most on a neighbourhood segment.  With E more exact segments, a set
leaves out those of very few elements (weight 0), which many sets share, as
long as it has no more than E of them.  How many segments of each kind a band
gets is the cheapest choice of a cost model over signatures sent and candidates
expected.  Every candidate is verified exactly on its words.

Equal sets are one node.  A map task sends a signature that many of its sets
share once, with the first as pivot; so does an owner across tasks.  Round one
verifies pivots against their members and finds components.  Round two takes
the signatures whose members are still in several components.  Sets that share
many signatures have the same largest component beside them, so signatures
meet by that component, each set once with all its signatures there: a pair is
looked at once and not once for each signature it shares.  Large meetings are
dealt to tasks in blocks.  A parity sketch, whose bits grow with the set, rules
pairs out: its Hamming distance never exceeds the sets' difference.  After it,
any two sets that share a signature are verified, ruled out exactly, or
connected already.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, fresh, lean, sub_batches

#: Chance, in the cost model, that a set holds an n-gram of another one by accident.
SHARED = 0.05
#: A plan sends at most so many times the signatures of the plan that sends fewest.
MOST_SENT = 1.5
#: Cost of one verified candidate in signatures.
VERIFY_COST = 2.0
#: Bits of the parity sketch: at least so many for each n-gram, at least so many in all; a power of two.
SKETCH_BITS, LEAST_BITS = 2, 512
#: Bytes of signatures and sketches that one task holds of a meeting in round two, more or less.
BLOCK_BYTES = 4 << 20
#: Sets of a meeting that one task holds, and that pass by it, more or less.
BLOCK_SETS = 2048
#: Pairs' sketches that are compared at a time, in bytes.
COMPARED_BYTES = 16 << 20
#: Members that one task verifies against a pivot.
PER_SALT = 256
#: Up to so many pairs, the list of wanted texts (some 40 bytes each) goes to every task, and only those texts are shuffled; the same for meetings.
LISTED_PAIRS = 100_000
#: Rows of an Arrow batch while the join runs; texts may be long.
BATCH_ROWS = 512

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def shingle_tuples(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """The exact set: distinct n-grams, or the whole sequence where it is shorter."""
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(n)), strict=False))


#: Longer words are hashed one by one; bytes whose prefix sums are held at a time; bytes of texts that are hashed together.
LONG_WORD = 64
SUM_BLOCK = 1 << 16
TEXT_BLOCK = 1 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _K1)


def _powers(base: int) -> np.ndarray:
    out = np.full(SUM_BLOCK + LONG_WORD + 1, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(int(_K1)), _powers(pow(int(_K1), -1, 1 << 64))


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of lower-case bytes that end with a blank.

    A word's hash is a polynomial in its bytes' codes, read off prefix sums and
    mixed with its length; polynomials of up to 64 bytes don't collide by form.
    """
    codes = np.frombuffer(raw, np.uint8)
    blank = _BLANK[codes]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts = edges[~blank[edges]]
    if not blank[0]:
        starts = np.concatenate([[0], starts])
    ends = edges[blank[edges]]
    sizes = ends - starts
    out = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(raw) + SUM_BLOCK, SUM_BLOCK))
    for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if j > i:
            base = k * SUM_BLOCK
            part = _BYTE[codes[base : base + SUM_BLOCK + LONG_WORD]]
            part *= _UP[: len(part)]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
            s = starts[i:j] - base
            e = np.minimum(ends[i:j] - base, len(part))
            out[i:j] = (sums[e] - sums[s]) * _DOWN[s]
    out = _mix(out + sizes.astype(np.uint64) * _K2)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return starts, out


class Hasher:
    """64-bit hashes of words, and of n-gram sets."""

    def __init__(self, n: int):
        self.n = n

    def word_hashes(self, texts: list[str | None]) -> list[np.ndarray]:
        """Hashes of the words of each text, in order; texts are hashed some at a time."""
        out: list[np.ndarray] = []
        raws: list[bytes] = []
        held = 0

        def close() -> None:
            starts, hashes = _hash_words(b" ".join(raws) + b" ")
            ends = np.cumsum([len(r) + 1 for r in raws])
            out.extend(np.split(hashes, np.searchsorted(starts, ends[:-1])))
            raws.clear()

        for text in texts:
            raw = (text or "").encode().translate(_LOWER)
            if raws and held + len(raw) > TEXT_BLOCK:
                close()
                held = 0
            raws.append(raw)
            held += len(raw) + 1
        if raws:
            close()
        return out

    def shingles(self, hashes: np.ndarray) -> np.ndarray:
        """Sorted distinct n-gram hashes of a sequence of word hashes."""
        if not len(hashes):
            return hashes
        span = min(self.n, len(hashes))
        out = np.full(len(hashes) - span + 1, np.uint64(span))
        for k in range(span):
            out = _mix(out * _K1 + hashes[k : len(hashes) - span + 1 + k])
        return np.unique(out)


def set_names(shingles: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two signed 64-bit names of a set; the first one is its id, the second tells whether two sets share that."""
    raw = hashlib.blake2b(shingles.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def parity_sketch(shingles: np.ndarray) -> bytes:
    """Bit i tells whether the n-grams whose hash ends in i are odd in number.

    Sketches of different lengths compare: folded in two by exclusive or, the
    longer one is the shorter sketch of its set.
    """
    bits = max(LEAST_BITS, 1 << max(0, SKETCH_BITS * len(shingles) - 1).bit_length())
    odd = np.bincount((_mix(shingles ^ _K3) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart_at_least(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """For each pair of sketches, the bits that differ: a lower bound of the sets' difference."""
    out = np.zeros(len(xs), np.int64)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
        shapes.setdefault((len(x), len(y)), []).append(i)
    for (m, k), places in shapes.items():
        each = max(1, COMPARED_BYTES // max(m, k))
        for at in range(0, len(places), each):
            part = places[at : at + each]
            sides = [np.frombuffer(b"".join(s[i] for i in part), np.uint64).reshape(len(part), -1, min(m, k) // 8) for s in (xs, ys)]
            differ = np.bitwise_xor.reduce(sides[0], axis=1) ^ np.bitwise_xor.reduce(sides[1], axis=1)
            out[part] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
    return out


def may_link(xn: np.ndarray, yn: np.ndarray, xs: list[bytes], ys: list[bytes], t: Fraction) -> np.ndarray:
    """Pairs of sets (sizes and sketches) that are not ruled out."""
    sized = np.flatnonzero(t.denominator * np.minimum(xn, yn) >= t.numerator * np.maximum(xn, yn))
    out = np.zeros(len(xn), bool)
    apart = apart_at_least([xs[i] for i in sized], [ys[i] for i in sized])
    out[sized] = (t.denominator + t.numerator) * apart <= (t.denominator - t.numerator) * (xn + yn)[sized]
    return out


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    partner: int  # largest size that links with a set of the band
    exact: int  # segments that must agree
    near: int  # segments that may differ by one element
    weak: int  # exact segments of so few elements are left out ...
    spare: int  # ... by a set that has no more than this many of them


class Bands:
    """Size bands for a similarity, with the allocation of segments."""

    def __init__(self, similarity: Fraction, largest: int, rows: dict[int, int] | None = None):
        self.t = similarity
        self.bands: list[Band] = []
        low = 1
        while low <= max(1, largest):
            high = math.floor(low / similarity)
            partner = math.floor(high / similarity)
            plan = self._allocate(self.apart(high, partner), (low + high) / 2, (rows or {}).get(len(self.bands), 1))
            self.bands.append(Band(low, high, partner, *plan))
            low = high + 1
        self.lows = np.array([b.low for b in self.bands])

    def apart(self, x: int, y: int) -> int:
        """The most elements in which linked sets of these sizes differ."""
        return math.floor((1 - self.t) * (x + y) / (1 + self.t))

    @staticmethod
    def _allocate(apart: int, size: float, rows: int) -> tuple[int, int, int, int]:
        """(exact, near, weak, spare) of the cheapest plan for sets that differ in at most ``apart`` elements.

        Linked sets agree on segments of weight exact + 2 near - apart = spare + 1
        or more; if one of them has at most ``spare`` weak segments, a stronger
        one is among those.
        """
        plans = []
        for near in {0, (apart + 1) // 2} if apart else {0}:
            for weak in range(-1, 4):
                spare, exact = 0, max(0, apart + 1 - 2 * near)
                for _ in range(60):  # more segments are smaller, and more of them weak
                    each = size / (exact + near)
                    share = [math.exp(k * math.log(each) - each - math.lgamma(k + 1)) for k in range(60)]
                    lost = exact * sum(share[: weak + 1])
                    if (enough := math.ceil(lost + 3 * math.sqrt(lost)) if weak >= 0 else 0) <= spare:
                        break
                    spare, exact = enough, max(0, apart + 1 + enough - 2 * near)
                else:
                    continue
                sent = exact - lost + near * (1 + each)
                alone = math.exp(-each * (1 - SHARED))  # the other set's segment holds nothing else
                met = exact * alone * sum(s * SHARED**k for k, s in enumerate(share) if k > weak) + near * (1 + each) * alone * SHARED ** max(0.0, each - 1)
                plans.append((sent + VERIFY_COST * rows * met, sent, (exact, near, weak, spare)))
        fewest = min(sent for _, sent, _ in plans)
        return min((cost, plan) for cost, sent, plan in plans if sent <= MOST_SENT * fewest)[1]

    def of(self, size: int) -> list[int]:
        """Bands whose signatures a set of this size sends: its own, and the one below where it can be the larger partner."""
        k = int(np.searchsorted(self.lows, size, side="right")) - 1
        return [k - 1, k] if k and size <= self.bands[k - 1].partner else [k]


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of a set (sorted distinct hashes)."""
    mixed = _mix(shingles + _K1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    out = []
    for k in bands.of(len(shingles)):
        band = bands.bands[k]
        parts = band.exact + band.near
        edges = np.searchsorted(shingles, (np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // max(2, parts))))
        edges = np.concatenate([[0], edges, [len(shingles)]])
        place = (np.arange(parts, dtype=np.uint64) + np.uint64(k << 32)) * _K3
        whole = sums[edges[1:]] - sums[edges[:-1]]
        sent = _mix(whole * _K1 + place)
        weak = np.flatnonzero(np.diff(edges)[: band.exact] <= band.weak)
        out.append(np.delete(sent, weak) if len(weak) <= band.spare else sent)
        for p in range(band.exact, parts):  # neighbourhoods: the segment less any one element
            out.append(_mix((whole[p] - mixed[edges[p] : edges[p + 1]]) * _K1 + place[p]))
    return np.unique(np.concatenate(out))


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _describe(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """doc_id, set size, names of the set and parity sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(n)
        for whole in batches:
            for batch in sub_batches(whole):
                sets = [hasher.shingles(h) for h in hasher.word_hashes(batch.column("text").to_pylist())]
                names = [set_names(s, seed) for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n_shingles": pa.array(map(len, sets), pa.int64()),
                        "set_id": pa.array([x for x, _ in names], pa.int64()),
                        "check": pa.array([y for _, y in names], pa.int64()),
                        "sketch": pa.array(map(parity_sketch, sets), pa.binary()),
                    }
                )

    return rows.mapInArrow(lean(run), "doc_id long, n_shingles long, set_id long, check long, sketch binary")


_PACK = ("bucket", "kind", "sigs", "names", "pivots", "members")
_PACK_TYPES = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _shared_signatures(rows: DataFrame, n: int, bands: Bands, owners: int, seed: int) -> DataFrame:
    """(sig, pivot, member) for each set that shares a signature with an earlier one; names of sets.

    Signatures travel packed, one row for each owner bucket and batch: their
    sorted hashes, and the places of their sets in the batch's list of names.
    """
    buckets = 4 * owners
    width = (1 << 64) // buckets + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(n)
        for whole in batches:
            for batch in sub_batches(whole):
                sets = {}
                for h in hasher.word_hashes(batch.column("text").to_pylist()):
                    if len(s := hasher.shingles(h)):
                        sets[set_names(s, seed)[0]] = s
                if not sets:
                    continue
                each = [signatures(s, bands) for s in sets.values()]
                table = np.sort(np.fromiter(sets, np.int64, len(sets)))
                small = np.uint16 if len(table) <= 1 << 16 else np.uint32
                place = np.repeat(np.searchsorted(table, np.fromiter(sets, np.int64, len(sets))).astype(small), [len(x) for x in each])
                sigs = np.concatenate(each)
                order = np.lexsort((place, sigs))
                sigs, place = sigs[order], place[order]
                first = np.concatenate([[True], sigs[1:] != sigs[:-1]])
                pivots = place[first][np.cumsum(first) - 1]
                for kind, keep in ((0, first), (1, ~first)):
                    s, p, m = sigs[keep], pivots[keep], place[keep]
                    cuts = np.searchsorted(s // np.uint64(width), np.arange(buckets + 1, dtype=np.uint64)).tolist()
                    rows = []
                    for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if j > i:
                            used = np.unique(np.concatenate([p[i:j], m[i:j]]) if kind else p[i:j])
                            at = [np.searchsorted(used, x).astype(small).tobytes() for x in ((p[i:j], m[i:j]) if kind else (p[i:j],))]
                            rows.append((b, kind, s[i:j].tobytes(), table[used].tobytes(), at[0], at[1] if kind else b""))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACK_TYPES, strict=True)], names=list(_PACK))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at = None

        def rows_of(s: np.ndarray, p: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"sig": pa.array(s.view(np.int64)), "pivot": pa.array(p), "member": pa.array(m)})

        def close() -> pa.RecordBatch | None:
            if not held:
                return None
            s, p = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((p, s))
            s, p = s[order], p[order]
            if len(s) > 1:  # the same set, sent by several tasks
                new = np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] != p[:-1])])
                s, p = s[new], p[new]
            first = np.concatenate([[True], s[1:] != s[:-1]])
            if first.all():
                return None
            pivots = p[first][np.cumsum(first) - 1]
            return rows_of(s[~first], pivots[~first], p[~first])

        for batch in batches:
            for b, kind, s, table, p, m in zip(*(batch.column(c).to_pylist() for c in _PACK), strict=True):
                if b != at:
                    if (out := close()) is not None:
                        yield out
                    at = b
                s, table = np.frombuffer(s, np.uint64), np.frombuffer(table, np.int64)
                small = np.uint16 if len(p) == 2 * len(s) else np.uint32
                p = table[np.frombuffer(p, small)]
                if kind:
                    yield rows_of(s, p, table[np.frombuffer(m, small)])
                else:
                    held.append((s, p))
        if (out := close()) is not None:
            yield out

    packed = rows.select("text").mapInArrow(lean(send), "bucket int, kind int, sigs binary, names binary, pivots binary, members binary")
    return packed.repartition(owners, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(own), "sig long, pivot long, member long")


def _not_ruled_out(pairs: DataFrame, names: DataFrame, t: Fraction) -> DataFrame:
    """Of ``pairs`` (a, b: ids of sets) those that sizes and sketches leave."""
    x = names.select(F.col("set_id").alias("a"), F.col("n").alias("xn"), F.col("sketch").alias("xs"))
    y = names.select(F.col("set_id").alias("b"), F.col("n").alias("yn"), F.col("sketch").alias("ys"))
    sized = t.denominator * F.least("xn", "yn") >= t.numerator * F.greatest("xn", "yn")
    sides = pairs.join(x, "a").join(y, "b").where(sized).select("a", "b", "xn", "yn", "xs", "ys")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left = may_link(*(batch.column(c).to_numpy() for c in ("xn", "yn")), *(batch.column(c).to_pylist() for c in ("xs", "ys")), t)
        return batch.select(["a", "b"]).filter(pa.array(left))

    return arrow_map(sides, run, "a long, b long")


def _meetings(labelled: DataFrame, names: DataFrame, t: Fraction, owners: int) -> DataFrame:
    """Pairs (a, b) of different components that share a signature and that nothing rules out.

    ``labelled``: (sig, node, label).  A signature with several components goes
    to the one that has most of its sets.  There each set comes once, with all
    signatures that went there, and meets the sets of other components with
    which it shares one.  Sets outside that component are dealt to blocks of
    about ``BLOCK_BYTES`` or ``BLOCK_SETS``, and all sets of the meeting pass by
    each block, in slices of so many sets.
    """
    per_label = labelled.groupBy("sig", "label").count()
    main = per_label.groupBy("sig").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("sig", "main")
    met = labelled.join(main, "sig").groupBy("main", "node").agg(F.max("label").alias("label"), F.collect_list("sig").alias("sigs"))  # a set's own signatures
    facts = names.select(F.col("set_id").alias("node"), "n", "sketch")
    met = cut(met.join(facts, "node").select("main", "node", "label", "n", "sketch", "sigs"))
    weight, apart = F.octet_length("sketch") + 8 * F.size("sigs"), F.col("label") != F.col("main")
    sizes = met.groupBy("main").agg(F.sum(F.when(apart, weight)).alias("bytes"), F.sum(apart.cast("int")).alias("held"), F.count("*").alias("all"))
    blocks = sizes.select("main", F.ceil(F.greatest(F.col("bytes") / BLOCK_BYTES, F.col("held") / BLOCK_SETS)).cast("int").alias("blocks"), F.ceil(F.col("all") / BLOCK_SETS).cast("int").alias("slices"))
    dealt = met.join(F.broadcast(blocks) if blocks.limit(LISTED_PAIRS + 1).count() <= LISTED_PAIRS else blocks, "main")
    place = lambda among, turn: F.pmod(F.xxhash64("node", F.lit(turn)), F.col(among)).cast("int")
    each = lambda among: F.explode(F.sequence(F.lit(0), F.col(among) - 1))
    own = dealt.where(apart).withColumn("block", place("blocks", 0)).withColumn("slice", each("slices")).withColumn("role", F.lit(0))
    passing = dealt.withColumn("slice", place("slices", 1)).withColumn("block", each("blocks")).withColumn("role", F.lit(1))
    columns = ("main", "block", "slice", "role", "node", "label", "n", "sketch", "sigs")
    every = own.select(*columns).unionByName(passing.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            rows = batch.to_pydict()
            sigs = batch.column("sigs")
            ends, flat = sigs.offsets.to_numpy(), sigs.values.to_numpy()
            keys = list(zip(rows["main"], rows["block"], rows["slice"], strict=True))
            at = 0
            while at < len(keys):
                stop = at
                while stop < len(keys) and keys[stop] == keys[at] and rows["role"][stop] == rows["role"][at]:
                    stop += 1
                if keys[at] != key:
                    key, held, index = keys[at], [], None
                for i in range(at, stop) if not rows["role"][at] else ():
                    held.append((rows["node"][i], rows["label"][i], rows["n"][i], rows["sketch"][i], flat[ends[i] : ends[i + 1]]))
                if rows["role"][at] and held:
                    index = index or Block(held, key[0])
                    here = [(rows["node"][i], rows["label"][i], rows["n"][i], rows["sketch"][i], flat[ends[i] : ends[i + 1]]) for i in range(at, stop)]
                    if len(found := index.pairs(here, t)):
                        yield pa.RecordBatch.from_pydict({"a": pa.array(found.min(axis=1)), "b": pa.array(found.max(axis=1))})
                at = stop

    return every.repartition(owners, "main", "block", "slice").sortWithinPartitions("main", "block", "slice", "role").mapInArrow(lean(run), "a long, b long").distinct()


class Block:
    """Sets of a meeting (node, label, size, sketch, signatures), by signature."""

    def __init__(self, sets: list[tuple], main: int):
        self.main = main
        self.node, self.label, self.n = (np.array([s[k] for s in sets], np.int64) for k in range(3))
        self.sketch = [s[3] for s in sets]
        sigs = np.concatenate([s[4] for s in sets])
        owner = np.repeat(np.arange(len(sets)), [len(s[4]) for s in sets])
        order = np.argsort(sigs, kind="stable")
        self.sigs, self.owner = sigs[order], owner[order]

    def pairs(self, passing: list[tuple], t: Fraction) -> np.ndarray:
        """Nodes (held, passing) with a common signature, in different components, each pair in one order only, not ruled out."""
        meet = np.zeros((len(passing), len(self.node)), bool)
        for row, s in zip(meet, passing, strict=True):
            first, last = (np.searchsorted(self.sigs, s[4], side=side) for side in ("left", "right"))
            many = last - first
            if many.any():
                skip = np.repeat(first - (np.cumsum(many) - many), many)
                row[self.owner[skip + np.arange(many.sum())]] = True
        node, label, n = (np.array([s[k] for s in passing], np.int64)[:, None] for k in range(3))
        meet &= (label != self.label) & ((label == self.main) | (self.node < node))
        meet &= t.denominator * np.minimum(n, self.n) >= t.numerator * np.maximum(n, self.n)
        p, h = np.nonzero(meet)
        if not len(p):
            return np.zeros((0, 2), np.int64)
        left = may_link(n[p, 0], self.n[h], [passing[i][3] for i in p], [self.sketch[i] for i in h], t)
        return np.stack([self.node[h[left]], node[p[left], 0]], axis=1)


def _verify(pairs: DataFrame, names: DataFrame, rows: DataFrame, n: int, t: Fraction, seed: int) -> DataFrame:
    """Of ``pairs`` (a, b: names of sets) those that link, checked on the words themselves.

    ``names`` gives each set's document.  A pivot meets at most ``PER_SALT``
    members, more or less, in one task; its text is sent once for each.  Sets
    of hashes rule out what is more than two n-grams short of linking, which a
    collision of hashes cannot bring about; the rest is counted on the words.
    """
    many = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / PER_SALT).cast("int").alias("salts"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    heads = many.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = heads.select("a", "salt", "role", "node").unionByName(salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("node")))
    placed = wanted.join(names.select(F.col("set_id").alias("node"), "doc_id"), "node")
    listed = pairs.limit(LISTED_PAIRS + 1).count() <= LISTED_PAIRS
    texts = rows.join(F.broadcast(placed) if listed else placed, "doc_id").select("a", "salt", "role", "node", "text")
    owners = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    num, den = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(n)
        key, head, head_text, head_set = None, None, None, None
        links = lambda x, y, both: den * both >= num * (x + y - both)
        for whole in batches:
            for batch in sub_batches(whole, most=2 << 20):
                found: list[tuple[int, int]] = []
                texts_here = batch.column("text").to_pylist()
                hashed = [hasher.shingles(h) for h in hasher.word_hashes(texts_here)]
                for a, salt, role, node, text, s in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "role", "node")), texts_here, hashed, strict=True):
                    if node != set_names(s, seed)[0]:  # an id may stand on several texts
                        continue
                    if not role:
                        if (a, salt) != key:
                            key, head, head_text, head_set = (a, salt), s, text, None
                    elif (a, salt) == key:
                        near = len(np.intersect1d(s, head, assume_unique=True))
                        if near and links(len(s), len(head), near + 2):
                            head_set = head_set or shingle_tuples(split_words(head_text), n)
                            own = shingle_tuples(split_words(text), n)
                            both = len(own & head_set)
                            if both and links(len(own), len(head_set), both):
                                found.append((a, node))
                if found:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return texts.repartition(owners, "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(lean(run), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b); label is the component's smallest node.

    Labels take the smallest neighbour's and then their label's label, until
    nothing changes; each round is a checkpoint.
    """
    both = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("mid"))
        jumped = lower.join(labels.select(F.col("node").alias("mid"), F.col("label").alias("far")), "mid", "left")
        new = cut(jumped.select("node", "was", F.least("mid", "far").alias("label")))
        if not new.where("was <> label").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def link_documents(docs: DataFrame, *, n: int = 3, similarity: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Connected components of documents whose n-gram sets have at least ``similarity``.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable)
    and set_copies (rows with the very same set).  Null, empty and blank texts
    have no n-gram and link with nothing; texts with fewer than n words are
    one n-gram, the whole sequence.  Equal sets are linked.  A pair exactly at
    the similarity links.  Rows with a null id have no component; repeated rows
    fall into one; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        return _linked(_read(docs, id_col, text_col), n, Fraction(similarity))
    finally:
        spark.conf.set(setting, before)


def _linked(rows: DataFrame, n: int, t: Fraction, seed: int = 0) -> DataFrame:
    """All jobs with Python in them run here; what is returned reads checkpoints."""
    spark = rows.sparkSession
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    thin = cut(_describe(rows, n, seed))
    filled = thin.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    named = filled.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"), F.min("check").alias("low"), F.max("check").alias("high"))
    names = cut(named)
    if names.where("low <> high").limit(1).count():  # two sets with one id: name them anew
        return _linked(rows, n, t, seed + 1)
    largest = names.agg(F.max("n")).head()[0] or 1
    bands = Bands(t, largest)
    edges = F.lit(-1)
    for b in bands.bands:
        edges = edges + (F.col("n") >= b.low).cast("int")
    counted = {r["band"]: r["count"] for r in names.groupBy(edges.alias("band")).count().collect()}  # one row for each band
    bands = Bands(t, largest, counted)
    shared = cut(_shared_signatures(rows.where(F.col("doc_id").isNotNull()), n, bands, owners, seed))

    stars = shared.select(F.col("pivot").alias("a"), F.col("member").alias("b")).distinct()
    stars = cut(_not_ruled_out(stars, names, t))
    links = cut(_verify(stars, names, rows, n, t, seed))
    labels = components(links)

    members = shared.select("sig", F.col("member").alias("node")).unionByName(shared.select("sig", F.col("pivot").alias("node"))).distinct()
    labelled = cut(members.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label")))
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(_meetings(labelled, names, t, owners).join(known, ["a", "b"], "left_anti"))
    if pairs.limit(1).count():
        more = cut(_verify(pairs, names, rows, n, t, seed))
        labels = components(links.unionByName(more))

    named = names.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").select("set_id", "doc_id", "copies", F.coalesce("label", "set_id").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    final = named.join(least, "label").select("set_id", "copies", "component_id")
    empty = F.col("n_shingles") == 0
    out = thin.select("doc_id", "n_shingles", F.when(~empty & F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id")).join(final, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("set_copies"))


def keep_one(docs: DataFrame, *, n: int = 5, similarity: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of each component's smallest id.

    Rows without n-grams or without an id stay; rows that repeat that id stay together.
    """
    found = link_documents(docs, n=n, similarity=similarity, id_col=id_col, text_col=text_col)
    gone_id = fresh(docs, "gone_id")
    gone = found.where((F.col("n_shingles") > 0) & (F.col("component_id") != F.col("doc_id"))).select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(gone_id), "left_anti")
