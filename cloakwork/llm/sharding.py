"""Shards of nearly equal bytes by minimax contiguous partition.

Rows with equal texts are one atomic group.  Groups fall by a hash of their
text into a fixed number of cells, which are the atoms; with fewer groups than
cells most cells are one group.  Atoms are ordered in as many stripes as there
are shards: by size, round by round, the largest of a round goes to the stripe
that has least; so stripes come out nearly equal, and small atoms lie where
cuts fall.  This order is cut.  The smallest
capacity for which greedy filling needs no more than the wanted shards is
found by binary search, each guess checked greedily over the prefix sums; then
the cuts are made there, each as near to equal shares as that capacity leaves
room for (greedy filling would starve the last shard).  Only DataFrame and SQL
functions are used.

The cells are a bounded number whatever the input, so one array of prefix sums
holds them; equal texts are always in one cell.  Rows get their slots by
counting within (shard, lane) and adding the lanes before, where the lane comes
from the row's place in the checkpoint, so that neither a shard nor a group of
copies that holds a third of all rows, nor one repeated row, is numbered in one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Cells of the hash range; with 40 shards a cell is about 0.06 % of one.
CELLS = 1 << 16
#: Ways in which a shard's rows are numbered side by side.
LANES = 512
#: Bytes that each row counts besides its text.
ROW_BYTES = 16



def _search(low: str, high: str, test: str, steps: int) -> str:
    """SQL of the smallest whole number m in [low, high] for which ``test`` holds; it must hold at ``high``."""
    mid = "(s.lo + shiftright(s.hi - s.lo, 1))"
    return (
        f"aggregate(sequence(1, {steps}), named_struct('lo', {low}, 'hi', {high}), (s, i) -> "
        f"if(s.lo >= s.hi, s, if({test.format(m=mid)}, named_struct('lo', s.lo, 'hi', {mid}), named_struct('lo', {mid} + 1L, 'hi', s.hi))), s -> s.lo)"
    )


def _filled(capacity: str, steps: int) -> str:
    """SQL of how many atoms lie before the next cut, when ``p`` atoms lie before this one."""
    mid = "(b.lo + shiftright(b.hi - b.lo + 1L, 1))"
    return (
        f"aggregate(sequence(1, {steps}), named_struct('lo', p, 'hi', size(prefix) - 1L), (b, j) -> "
        f"if(b.lo >= b.hi, b, if(prefix[int{mid}] - prefix[int(p)] <= {capacity}, named_struct('lo', {mid}, 'hi', b.hi), named_struct('lo', b.lo, 'hi', {mid} - 1L))), b -> b.lo)"
    )


def in_stripes(atoms: DataFrame, stripes: int) -> DataFrame:
    """(cell, bytes, nth, stripe): atoms by falling size, dealt so that the stripes' sums come out nearly equal."""
    packed = atoms.agg(F.sort_array(F.collect_list(F.struct("bytes", "cell")), asc=False).alias("a"))
    start = f"named_struct('lanes', transform(sequence(1, {stripes}), s -> named_struct('held', 0L, 'stripe', s)), 'out', cast(array() as array<int>))"
    lanes = f"transform(array_sort(s.lanes), (x, i) -> named_struct('held', x.held + coalesce(get(a, r * {stripes} + i).bytes, 0L), 'stripe', x.stripe))"
    rounds = f"sequence(0, int((size(a) - 1) div {stripes}))"
    dealt = f"aggregate({rounds}, {start}, (s, r) -> named_struct('lanes', {lanes}, 'out', concat(s.out, transform(array_sort(s.lanes), x -> x.stripe))), s -> s.out)"
    one = packed.where("size(a) > 0").selectExpr("a", f"{dealt} as stripe")
    return one.selectExpr("stripe", "posexplode(a) as (nth, x)").selectExpr("x.cell as cell", "x.bytes as bytes", "nth", "stripe[nth] as stripe")


def minimax_cuts(atoms: DataFrame, shards: int, most_atoms: int) -> DataFrame:
    """Cut ordered atoms into at most ``shards`` runs with the smallest possible largest sum.

    ``atoms``: (cell, bytes), one row per atom, at most ``most_atoms`` of them,
    in the order of cell.  One row comes back: capacity, and cuts, the last
    cell of each run.  Without atoms capacity is 0 and cuts is empty.
    """
    steps = most_atoms.bit_length() + 1
    whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = atoms.select("cell", "bytes", F.sum("bytes").over(whole).alias("upto"))
    packed = summed.agg(F.sort_array(F.collect_list(F.struct("cell", "upto"))).alias("a"), F.coalesce(F.max("bytes"), F.lit(0)).alias("largest"), F.coalesce(F.max("upto"), F.lit(0)).alias("total"))
    arrays = packed.selectExpr("transform(a, x -> x.cell) as cells", "concat(array(0L), transform(a, x -> x.upto)) as prefix", f"greatest(largest, (total + {shards - 1}L) div {shards}L) as low", "largest")
    needs = f"aggregate(sequence(1, {shards}), 0L, (p, k) -> {_filled('{m}', steps)}) >= size(prefix) - 1"
    found = arrays.selectExpr("cells", "prefix", f"{_search('low', 'low + largest', needs, 63)} as capacity")
    firsts = found.selectExpr("*", f"{_earliest(shards, steps)} as firsts")
    ends = firsts.selectExpr("cells", "capacity", f"{_even(shards, steps)} as ends")
    return ends.selectExpr("capacity", "transform(filter(array_distinct(ends), e -> e > 0), e -> cells[int(e) - 1]) as cuts")


def _earliest(shards: int, steps: int) -> str:
    """SQL of how few atoms may lie before each cut, the last one first, so that the runs behind it stay within ``capacity``."""
    mid = "(b.lo + shiftright(b.hi - b.lo, 1))"
    back = (
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0L, 'hi', p), (b, j) -> "
        f"if(b.lo >= b.hi, b, if(prefix[int(p)] - prefix[int{mid}] <= capacity, named_struct('lo', b.lo, 'hi', {mid}), named_struct('lo', {mid} + 1L, 'hi', b.hi))), b -> b.lo)"
    )
    return f"aggregate(sequence(1, {shards}), array(size(prefix) - 1L), (c, k) -> concat(c, transform(slice(c, -1, 1), p -> {back})))"


def _even(shards: int, steps: int) -> str:
    """SQL of the atoms that lie before each cut: as near to equal shares as ``capacity`` and the cuts that follow leave room for.

    Every run has an atom where there are as many atoms as shards.
    """
    n, total = "(size(prefix) - 1L)", "prefix[size(prefix) - 1]"
    mid = "(b.lo + shiftright(b.hi - b.lo + 1L, 1))"
    share = f"({total} * k div {shards})"
    under = f"aggregate(sequence(1, {steps}), named_struct('lo', 0L, 'hi', {n}), (b, j) -> if(b.lo >= b.hi, b, if(prefix[int{mid}] <= {share}, named_struct('lo', {mid}, 'hi', b.hi), named_struct('lo', b.lo, 'hi', {mid} - 1L))), b -> b.lo)"
    low = f"greatest(firsts[{shards} - k], least({n}, p + 1L))"
    near = f"transform(array({under}), i -> if(i < {n} and prefix[int(i) + 1] - {share} < {share} - prefix[int(i)], i + 1L, i))[0]"
    cut_ = f"greatest({low}, least({near}, {_filled('capacity', steps)}, greatest({low}, {n} - ({shards} - k))))"
    return f"concat(aggregate(sequence(1, {shards}), array(0L), (c, k) -> if(k = {shards}, c, concat(c, transform(slice(c, -1, 1), p -> {cut_})))), array({n}))"


def shard_rows(docs: DataFrame, shards: int = 40, *, cells: int = CELLS, lanes: int = LANES, row_bytes: int = ROW_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Give every row a shard of nearly equal bytes and a slot in it.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard
    (null).  Null and empty texts are one group of size ``row_bytes``; equal
    texts share a shard; repeated rows get slots of their own; a null id is a
    row like others; an empty table gives no rows; other columns are ignored.

    A cell of at least the mean size of the shards that are left takes a shard
    of its own (the last ones), largest first, and the others are cut minimax
    into the rest: else one large group of copies would set the capacity, and
    most shards would stay empty.
    """
    if cells & (cells - 1):
        raise ValueError("cells must be a power of two")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + row_bytes).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 65 - cells.bit_length()).cast("int").alias("cell"),
        )
    )
    atoms = rows.groupBy("cell").agg(F.sum("size").alias("bytes"))
    top = atoms.orderBy(F.desc("bytes"), "cell").limit(shards).collect()  # at most as many rows as shards
    left = atoms.agg(F.coalesce(F.sum("bytes"), F.lit(0))).head()[0]
    alone: list[int] = []
    for cell in top:
        if len(alone) < shards - 1 and cell["bytes"] * (shards - len(alone)) > left and cell["bytes"] < left:
            alone.append(cell["cell"])
            left -= cell["bytes"]
        else:
            break
    rest = atoms.where(~F.col("cell").isin(alone)) if alone else atoms
    stripes = shards - len(alone)
    ordered = cut(in_stripes(rest, stripes).select("cell", "bytes", (F.col("stripe").cast("long") * cells + F.col("nth")).alias("at")))
    cuts = minimax_cuts(ordered.select(F.col("at").alias("cell"), "bytes"), stripes, cells).head()["cuts"]  # one row, at most as many cuts as shards
    shard = F.lit(0)
    for last in cuts[:-1]:
        shard = shard + (F.col("at") > last).cast("int")
    homes = ordered.select("cell", shard.alias("shard"))
    for k, cell in enumerate(alone):
        homes = homes.unionByName(homes.sparkSession.range(1).select(F.lit(cell).alias("cell"), F.lit(shards - 1 - k).alias("shard")))
    placed = rows.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(homes), "cell")  # ``cells`` rows at most
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("place"), F.lit(lanes)).cast("int").alias("lane"), "place")
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "lane").count().select("shard", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "place")
    return (
        placed.select("*", F.row_number().over(within).alias("n"))
        .join(F.broadcast(offsets), ["shard", "lane"])  # shards x lanes rows at most
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
