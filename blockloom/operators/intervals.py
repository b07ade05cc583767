"""Overlapping and gapped integer intervals: continuous runs, gaps and clashes.

Intervals ``[start, end)`` are cut at multiples of ``2^CELL_BITS``. Each task first works off the pieces it has, many cells of the address space at a time: pieces are decomposed into canonical dyadic blocks (level, index)
by a closed form, equal blocks collapse, blocks covered by an ancestor go, sibling pairs merge upward level by level, and adjacent blocks coalesce. What is left, at most one row per piece and at most ``2^CELL_BITS``
rows a cell and task however hot the entity, is shuffled once, by (entity, cell), and worked off in the same way; only the first and last
run of each cell is then compared across cells; an address space has a bounded number of cells (2^16 for the 2^32 logical blocks of a file).

Clashes carry the smallest and largest owner of each block; a block clashes if its own and its ancestors' owners differ. Before the shuffle equal pieces collapse, and where
a task has more than ``HOT_PIECES`` pieces of a cell it sends their distinct blocks instead.

Defined results: intervals with null or non-positive length, null start, null entity (or, for clashes, null owner) don't count.
Repeated and equal intervals count once; a start may be negative. Touching intervals are one run. Empty tables give no rows. An interval makes a row for each cell it lies in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.session import cut

CELL_BITS = 16
INIT_MAX_LEN = 32768
HOT_PIECES = 4096
_PIECES = "entity string, cell bigint, kind string, run_start bigint, run_end bigint, first boolean, last boolean"


def cell_pieces(intervals: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """``entity, s, e`` (+ other columns) to one row per cell: ``cell`` and the piece's ``s``, ``e`` inside it."""
    kept = [c for c in intervals.columns if c not in ("s", "e")]
    low, high = F.shiftright("s", bits), F.shiftright(F.col("e") - 1, bits)
    whole = intervals.where(F.col("e") > F.col("s"))
    # hardly any interval lies in more than one cell: those rows need no array
    cells = whole.select("*", F.explode(F.when(low == high, F.array(low)).otherwise(F.sequence(low, high))).alias("cell"))
    base = F.shiftleft("cell", bits)
    return cells.select(*kept, "cell", F.greatest(F.col("s") - base, F.lit(0)).cast("int").alias("s"), F.least(F.col("e") - base, F.lit(1 << bits)).cast("int").alias("e"))


def dyadic_blocks(s: np.ndarray, e: np.ndarray, bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the interval, level, start) of the canonical blocks of intervals inside a cell.

    With h the highest bit in which s and e differ and m = e cleared below h: the set bits of m - s give the blocks left of m, those of e - m the blocks right of it.
    """
    h = np.floor(np.log2(np.maximum(s ^ e, 1))).astype(np.int64)
    m = (e >> h) << h
    left, right = m - s, e - m
    which, level, start = [], [], []
    for lv in range(bits + 1):
        for has, at in (((left >> lv) & 1, m - ((left >> lv) << lv)), ((right >> lv) & 1, m + ((right >> (lv + 1)) << (lv + 1)))):
            own = np.flatnonzero(has)
            which.append(own)
            level.append(np.full(len(own), lv, np.int64))
            start.append(at[own])
    return np.concatenate(which), np.concatenate(level), np.concatenate(start)


def _collapse(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each kind in it) of rows with equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def _merge_up(group: np.ndarray, level: np.ndarray, start: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint (group, level, start) blocks with every sibling pair replaced by its parent, lowest level first."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    up_g, up_s = np.empty(0, np.int64), np.empty(0, np.int64)
    for lv in range(bits + 1):
        own = level == lv
        g, s = np.concatenate([group[own], up_g]), np.concatenate([start[own], up_s])
        order = np.lexsort((s, g))
        g, s = g[order], s[order]
        even = ((s >> lv) & 1) == 0
        pair = np.zeros(len(g), bool)
        if lv < bits and len(g) > 1:
            pair[:-1] = even[:-1] & (g[1:] == g[:-1]) & (s[1:] == s[:-1] + (1 << lv))
        second = np.zeros(len(g), bool)
        second[1:] = pair[:-1]
        stay = ~(pair | second)
        out.append((g[stay], np.full(int(stay.sum()), lv, np.int64), s[stay]))
        up_g, up_s = g[pair], s[pair]
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))  # type: ignore[return-value]


def _uncovered(group: np.ndarray, level: np.ndarray, start: np.ndarray, bits: int) -> np.ndarray:
    """Mask of the blocks without an ancestor among the blocks of their group."""
    order = np.lexsort((-level, start, group))
    g, end = group[order], start[order] + (np.int64(1) << level[order])
    lifted = end + (g << (bits + 2))
    before = np.concatenate([[-1], np.maximum.accumulate(lifted)[:-1]])
    free = np.empty(len(order), bool)
    free[order] = before < lifted
    return free


def _owners(group: np.ndarray, level: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest owner of each block and all its ancestors, from the top level down."""
    low, high = low.copy(), high.copy()
    for lv in range(bits, 0, -1):
        at = np.flatnonzero(level == lv)
        if not len(at):
            continue
        key = (group[at] << (bits + 1)) + start[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        below = np.flatnonzero(level < lv)
        want = (group[below] << (bits + 1)) + ((start[below] >> lv) << lv)
        pos = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[pos] == want
        b, a = below[hit], at[pos[hit]]
        low[b], high[b] = np.minimum(low[b], low[a]), np.maximum(high[b], high[a])
    return low, high


def _runs(group: np.ndarray, level: np.ndarray, start: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent disjoint blocks of a group as (group, start, end)."""
    free = _uncovered(group, level, start, bits)
    g, lv, s = _merge_up(group[free], level[free], start[free], bits)
    order = np.lexsort((s, g))
    g, s, e = g[order], s[order], (s + (np.int64(1) << lv))[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != e[:-1])
    at = np.flatnonzero(new)
    return g[at], s[at], np.concatenate([e[at[1:] - 1], e[-1:]])


def _groups(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(entities, a number per row's (entity, cell), one row of each number)."""
    entity, cell = table["entity"].combine_chunks(), table["cell"].to_numpy()
    ids = entity.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order, first = _collapse(ids, cell)
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return entity, group, order[first]


def _distinct_blocks(table: pa.Table, group: np.ndarray, bits: int, clash: bool) -> tuple[np.ndarray, ...]:
    """(group, level, start[, low, high]) of the different blocks of all pieces."""
    s, e = table["s"].to_numpy().astype(np.int64), table["e"].to_numpy().astype(np.int64)
    which, level, start = dyadic_blocks(s, e, bits)
    g = group[which]
    order, first = _collapse(g, level, start)
    out = [x[order][first] for x in (g, level, start)]
    if clash:
        out += [np.minimum.reduceat(table["low"].to_numpy()[which][order], first), np.maximum.reduceat(table["high"].to_numpy()[which][order], first)]
    return tuple(out)


def _combine(table: pa.Table, bits: int, clash: bool) -> pa.RecordBatch:
    """Fewer pieces that say the same: before the shuffle."""
    entity, group, row = _groups(table)
    if clash:
        s, e = table["s"].to_numpy().astype(np.int64), table["e"].to_numpy().astype(np.int64)
        order, first = _collapse(group, s, e)
        g, s, e = group[order][first], s[order][first], e[order][first]
        low, high = np.minimum.reduceat(table["low"].to_numpy()[order], first), np.maximum.reduceat(table["high"].to_numpy()[order], first)
        hot = np.bincount(g)[g] > HOT_PIECES
        if hot.any():
            part = pa.table({"s": pa.array(s[hot]), "e": pa.array(e[hot]), "low": pa.array(low[hot]), "high": pa.array(high[hot])})
            bg, level, start, bl, bh = _distinct_blocks(part, g[hot], bits, True)
            g, s, e = np.concatenate([g[~hot], bg]), np.concatenate([s[~hot], start]), np.concatenate([e[~hot], start + (np.int64(1) << level)])
            low, high = np.concatenate([low[~hot], bl]), np.concatenate([high[~hot], bh])
    else:
        g, s, e = _runs(*_distinct_blocks(table, group, bits, False), bits)
    rows = row[g]
    out = {"entity": entity.take(pa.array(rows)), "cell": pa.array(table["cell"].to_numpy()[rows]), "s": pa.array(s.astype(np.int32)), "e": pa.array(e.astype(np.int32))}
    return pa.record_batch(out | ({"low": pa.array(low), "high": pa.array(high)} if clash else {}))


def _cell_runs(table: pa.Table, bits: int, clash: bool) -> pa.RecordBatch | None:
    """Runs and inner gaps of whole cells."""
    entity, group, first_row = _groups(table)
    blocks = _distinct_blocks(table, group, bits, clash)
    group, level, start = blocks[:3]
    if clash:
        low, high = _owners(*blocks, bits)
        keep = low != high
        group, level, start = group[keep], level[keep], start[keep]
        if not len(group):
            return None
    cell = table["cell"].to_numpy()
    g, s, e = _runs(group, level, start, bits)
    same = g[1:] == g[:-1]
    first, last = np.concatenate([[True], ~same]), np.concatenate([~same, [True]])
    gap = np.flatnonzero(same)
    offset = cell[first_row][np.concatenate([g, g[gap]])] << bits
    n, k = len(g), 0 if clash else len(gap)
    rows = first_row[np.concatenate([g, g[gap]])][: n + k]
    return pa.record_batch(
        {
            "entity": entity.take(pa.array(rows)),
            "cell": pa.array(cell[rows]),
            "kind": pa.array(["run"] * n + ["gap"] * k, pa.string()),
            "run_start": pa.array((np.concatenate([s, e[:-1][same]]) + offset)[: n + k]),
            "run_end": pa.array((np.concatenate([e, s[1:][same]]) + offset)[: n + k]),
            "first": pa.array(np.concatenate([first, np.zeros(len(gap), bool)])[: n + k]),
            "last": pa.array(np.concatenate([last, np.zeros(len(gap), bool)])[: n + k]),
        }
    )


def _before(bits: int, clash: bool, rows_at_once: int = 500_000):
    """mapInArrow that combines the pieces of a task, ``rows_at_once`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= rows_at_once:
                yield _combine(pa.Table.from_batches(held), bits, clash)
                held, rows = [], 0
        if rows:
            yield _combine(pa.Table.from_batches(held), bits, clash)

    return run


def _pieces(bits: int, clash: bool, rows_at_once: int = 200_000):
    """mapInArrow over rows sorted by (entity, cell): whole cells are worked off many at a time."""

    def cut_point(t: pa.Table) -> int:
        e, c = t["entity"].combine_chunks(), t["cell"].to_numpy()
        ids = e.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        differs = np.flatnonzero((c != c[-1]) | (ids != ids[-1]))
        return int(differs[-1]) + 1 if len(differs) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= rows_at_once:
                t = pa.Table.from_batches(held)
                k = cut_point(t)
                if k:
                    if (out := _cell_runs(t.slice(0, k), bits, clash)) is not None:
                        yield out
                    t = t.slice(k)
                else:  # one cell fills it all: fewer pieces say the same
                    t = pa.Table.from_batches([_combine(t, bits, clash)])
                held = t.combine_chunks().to_batches()
                rows = 0 if not k else t.num_rows
        if held and (out := _cell_runs(pa.Table.from_batches(held), bits, clash)) is not None:
            yield out

    return run


def merge_intervals(intervals: DataFrame, owner: str | None = None, bits: int = CELL_BITS) -> DataFrame:
    """(entity, kind, run_start, run_end): runs and the gaps between them; with ``owner``: runs of two or more owners.

    ``intervals``: entity (string), s, e (bigint) and, if named, the owner column (bigint).
    """
    columns = ["entity", "s", "e"] + [owner] * bool(owner)
    pieces = cell_pieces(intervals.select(*columns).dropna(), bits)
    if owner:
        pieces = pieces.select("entity", "cell", "s", "e", F.col(owner).alias("low"), F.col(owner).alias("high"))
    fields = "entity string, cell bigint, s int, e int" + ", low bigint, high bigint" * bool(owner)
    combined = pieces.select(*[f.split(" ")[0] for f in fields.split(", ")]).mapInArrow(_before(bits, bool(owner)), fields)
    laid = combined.repartition("entity", "cell").sortWithinPartitions("entity", "cell")
    # written once: runs, gaps and edges are all read from the result
    pieces = cut(laid.mapInArrow(_pieces(bits, bool(owner)), _PIECES))
    edge = F.col("first") | F.col("last")
    inner = pieces.where(~edge).select("entity", "kind", "run_start", "run_end")
    by_start = Window.partitionBy("entity").orderBy("run_start")
    edges = pieces.where(edge).withColumn("_prev", F.lag("run_end").over(by_start)).withColumn("_new", F.coalesce(F.col("run_start") != F.col("_prev"), F.lit(True)))
    island = edges.withColumn("_island", F.sum(F.col("_new").cast("long")).over(by_start))
    joined = island.groupBy("entity", "_island").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"))
    runs = joined.select("entity", F.lit("run").alias("kind"), "run_start", "run_end")
    out = inner.unionByName(runs)
    if not owner:
        across = F.col("first") & (F.col("_prev") < F.col("run_start"))
        out = out.unionByName(edges.where(across).select("entity", F.lit("gap").alias("kind"), F.col("_prev").alias("run_start"), F.col("run_start").alias("run_end")))
    return out


def _length() -> Column:
    n = F.col("ee_len").cast("long")
    return F.when(n > INIT_MAX_LEN, n - INIT_MAX_LEN).otherwise(n)


def extent_ranges(extent: DataFrame) -> DataFrame:
    """(kind, image_id, inode_number, block_start, block_end): runs and gaps of files, clashes of images."""
    usable = extent.where((F.col("ee_len") > 0) & F.col("image_id").isNotNull() & F.col("inode_number").isNotNull())
    s = F.col("ee_block").cast("long")
    p = F.col("ee_start_hi").cast("long") * F.lit(4294967296) + F.col("ee_start_lo").cast("long")
    sep = F.lit("\u0001")
    logical = usable.select(F.concat("image_id", sep, F.col("inode_number").cast("string")).alias("entity"), s.alias("s"), (s + _length()).alias("e"))
    physical = usable.select(F.col("image_id").alias("entity"), p.alias("s"), (p + _length()).alias("e"), F.col("inode_number").cast("long").alias("inode_number"))
    files = merge_intervals(logical).select(
        "kind",
        F.expr("left(entity, length(entity) - length(substring_index(entity, '\u0001', -1)) - 1)").alias("image_id"),
        F.substring_index("entity", "\u0001", -1).cast("long").alias("inode_number"),
        F.col("run_start").alias("block_start"),
        F.col("run_end").alias("block_end"),
    )
    clash = merge_intervals(physical, "inode_number").select(
        F.lit("clash").alias("kind"), F.col("entity").alias("image_id"), F.lit(0).cast("long").alias("inode_number"), F.col("run_start").alias("block_start"), F.col("run_end").alias("block_end")
    )
    return files.unionByName(clash)
