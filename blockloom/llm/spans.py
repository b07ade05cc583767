"""Long exact spans shared between records: count-min prefilter, then exact grouping.

A window is ``length`` code points. Equal windows have equal *anchors*, an anchor being the smallest hash among the window's ``GRAM``-grams,
so windows are counted by anchor: consecutive windows with one anchor form a *segment*, and a corpus has about one segment per hundred code
points. One pass over the texts writes the segments' hashes and places, no texts. Their anchors are counted in a count-min sketch of ``DEPTH`` rows, ``CELLS`` cells a segment,
counted in parts and merged by cell. A sketch never underestimates, so all segments whose anchor is estimated repeated are kept, and those are grouped exactly:

* equal segments (128-bit hash of all their text) of two documents share all their windows;
* anchors with several different segments are compared window by window, one representative per different segment, whose text is fetched for this.

The sketch's width follows the corpus, so the share that passes by chance (about 1 in ``CELLS`` after the first row, its square after the second) is the same at any size.
Anchors with more than ``HOT_VARIANTS`` different segments are compared by a distributed grouping of their windows instead of in one task; the result is the same.

Defined results: null, empty and shorter texts have no span. A repeated id counts once. Windows repeated only inside one document are not
shared. Overlapping or touching windows make one span. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.textbatch import Flat, flats, unique_docs
from blockloom.session import cut

LENGTH = 320
GRAM = 64
#: Cells of a sketch row per segment (up to twice as many, for the width is a power of two), and rows.
CELLS, DEPTH = 16, 2
HOT_VARIANTS = 5_000


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (block prefix and suffix minima)."""
    n = len(h)
    pad = -n % w
    top = np.iinfo(np.uint64).max
    blocks = np.concatenate([h, np.full(pad, top, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def segments(flat: Flat, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, document, first window, number of windows) of all segments; positions are in the flat array."""
    n = len(flat.code)
    none = np.empty(0, np.int64)
    if n < length:
        return np.empty(0, np.uint64), none, none, none
    gram = min(GRAM, length)
    least = _window_min(flat.hashes(slice(0, n - gram + 1), gram), length - gram + 1)
    sizes = np.diff(flat.start)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    fits = np.arange(len(least)) + length <= flat.start[doc + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (fits[1:] != fits[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate([at, [len(least)]]))
    good = fits[at]
    return least[at][good], doc[at][good], at[good], count[good]


def segment_table(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, doc_id, start, n, h1, h2, fresh) of all segments, without their texts; ``fresh``: the anchor's first one in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat in flats(batches, least=length):
            anchor, doc, at, n = segments(flat, length)
            if not len(at):
                continue
            size = n + length - 1
            order = np.lexsort((anchor, doc))
            a, d = anchor[order], doc[order]
            fresh = np.empty(len(a), bool)
            fresh[order] = np.append(True, (a[1:] != a[:-1]) | (d[1:] != d[:-1]))
            yield pa.record_batch(
                {
                    "anchor": pa.array(anchor.view(np.int64)),
                    "doc_id": batch.column("doc_id").take(pa.array(doc)),
                    "start": pa.array(at - flat.start[doc]),
                    "n": pa.array(n),
                    "h1": pa.array(flat.hashes(at, size, 0).view(np.int64)),
                    "h2": pa.array(flat.hashes(at, size, 1).view(np.int64)),
                    "fresh": pa.array(fresh),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, "anchor bigint, doc_id bigint, start bigint, n bigint, h1 bigint, h2 bigint, fresh boolean")


def _cell(row: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("anchor", F.lit(row)), 64 - bits)


def estimated_repeated(seg: DataFrame, bits: int | None = None) -> DataFrame:
    """The segments whose anchor the count-min sketch estimates to stand in two documents.

    A row of the sketch is a count per cell: each task counts its own part (the map side of the aggregation), the parts are merged by cell. Cells live where their hash puts them, so
    the sketch is as wide as the corpus asks for (``CELLS`` cells a segment) and no one holds it whole; segments meet their cells by a semi join. The second row counts what the
    first one lets pass, which still never underestimates: all segments of a repeated anchor have passed.
    """
    if bits is None:
        bits = max(16, (CELLS * seg.count()).bit_length())
    for row in range(DEPTH):
        cell = _cell(row, bits).alias("_cell")
        twice = seg.where("fresh").groupBy(cell).agg(F.count("*").alias("_n")).where("_n > 1").select("_cell")
        seg = cut(seg.withColumn("_cell", cell).join(twice, "_cell", "left_semi").drop("_cell"))
    return seg


def fetch_bodies(docs: DataFrame, variants: DataFrame, length: int = LENGTH) -> DataFrame:
    """``variants`` (with the document and start of one of their places) with their texts: one text a variant, not one a place."""
    wanted = variants.groupBy("doc_id").agg(F.collect_list(F.struct("start", "anchor", "h1", "h2", "n", "lo", "hi", "_k")).alias("w"))
    fields = ("anchor", "h1", "h2", "n", "lo", "hi", "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                lists = pa.concat_arrays([b.column("w")])
                inner, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
                start, n = inner.field("start").to_numpy(), inner.field("n").to_numpy()
                texts = np.repeat(np.arange(b.num_rows), sizes).tolist()
                text = b.column("text").to_pylist()
                body = [text[k][s : s + m + length - 1] for k, s, m in zip(texts, start.tolist(), n.tolist())]
                yield pa.record_batch({f: inner.field(f) for f in fields} | {"body": pa.array(body, pa.string())})

    return docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(run, ", ".join(f"`{f}` bigint" for f in fields) + ", body string")


def _window_keys(bodies: list[str], n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, hash, hash) of every window of every segment text."""
    flat = Flat(bodies)
    row = np.repeat(np.arange(len(n)), n)
    rel = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = flat.start[row] + rel
    return row, rel, flat.hashes(at, length, 0), flat.hashes(at, length, 1)


def _rel_runs(row: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive offsets per row: (row, first, last)."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (rel[1:] != rel[:-1] + 1)
    at = np.flatnonzero(new)
    return row[at], rel[at], rel[np.concatenate([at[1:] - 1, [len(rel) - 1]])] if len(rel) else rel


_VARIANT = "anchor bigint, h1 bigint, h2 bigint, n bigint, lo bigint, hi bigint, body string"
_SHARED = "anchor bigint, h1 bigint, h2 bigint, n bigint, first bigint, last bigint"


def _compare(length: int, rows_at_once: int = 2_000):
    """mapInArrow over variants sorted by anchor: which windows of each also stand in another document."""

    def work(t: pa.Table) -> pa.RecordBatch | None:
        n = t["n"].to_numpy()
        row, rel, k1, k2 = _window_keys(t["body"].to_pylist(), n, length)
        lo, hi, anchor = t["lo"].to_numpy()[row], t["hi"].to_numpy()[row], t["anchor"].to_numpy()[row]
        order = np.lexsort((k2, k1, anchor))
        a, x, y = anchor[order], k1[order], k2[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        at = np.flatnonzero(new)
        shared = np.minimum.reduceat(lo[order], at) != np.maximum.reduceat(hi[order], at)
        mask = np.empty(len(a), bool)
        mask[order] = np.repeat(shared, np.diff(np.concatenate([at, [len(a)]])))
        r, first, last = _rel_runs(row[mask], rel[mask])
        if not len(r):
            return None
        part = t.select(["anchor", "h1", "h2", "n"]).take(pa.array(r))
        return pa.record_batch([*(c.combine_chunks() for c in part.columns), pa.array(first), pa.array(last)], names=["anchor", "h1", "h2", "n", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                piece = pa.Table.from_batches([batch.slice(at, rows_at_once)])
                held = piece if held is None else pa.concat_tables([held, piece])
                if held.num_rows < rows_at_once:
                    continue
                anchor = held["anchor"].to_numpy()
                other = np.flatnonzero(anchor != anchor[-1])
                k = int(other[-1]) + 1 if len(other) else 0
                if k and (out := work(held.slice(0, k))) is not None:
                    yield out
                held = held.slice(k)
        if held is not None and held.num_rows and (out := work(held)) is not None:
            yield out

    return run


def _compare_hot(hot: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many variants, by grouping windows over the cluster."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                row, rel, k1, k2 = _window_keys(b.column("body").to_pylist(), b.column("n").to_numpy(), length)
                take = pa.array(row)
                yield pa.record_batch(
                    {c: b.column(c).take(take) for c in ("anchor", "h1", "h2", "n", "lo", "hi")} | {"rel": pa.array(rel), "k1": pa.array(k1.view(np.int64)), "k2": pa.array(k2.view(np.int64))}
                )

    windows = hot.mapInArrow(explode, "anchor bigint, h1 bigint, h2 bigint, n bigint, lo bigint, hi bigint, rel bigint, k1 bigint, k2 bigint")
    both = windows.groupBy("anchor", "k1", "k2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("anchor", "k1", "k2")
    hit = windows.join(both, ["anchor", "k1", "k2"]).select("anchor", "h1", "h2", "n", "rel")
    by = Window.partitionBy("anchor", "h1", "h2", "n").orderBy("rel")
    return (
        hit.withColumn("_g", F.col("rel") - F.row_number().over(by))
        .groupBy("anchor", "h1", "h2", "n", "_g")
        .agg(F.min("rel").alias("first"), F.max("rel").alias("last"))
        .drop("_g")
    )


def shared_spans(docs: DataFrame, length: int = LENGTH, bits: int | None = None, hot_variants: int = HOT_VARIANTS) -> DataFrame:
    """(doc_id, span_start, span_end): the union of all windows that also stand in another document."""
    docs = unique_docs(docs.select("doc_id", "text"))
    seg = estimated_repeated(cut(segment_table(docs, length)), bits)
    variant = ["anchor", "h1", "h2", "n"]
    kinds = cut(seg.groupBy(*variant).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "start")).alias("p")))
    per_anchor = (
        kinds.groupBy("anchor")
        .agg(F.count("*").alias("_k"), F.max((F.col("lo") == F.col("hi")).cast("int")).alias("_alone"), F.min("lo").alias("_a"), F.max("hi").alias("_b"))
        .where("_a <> _b and _k > 1 and _alone = 1")
        .select("anchor", "_k")
    )
    whole = kinds.where("lo <> hi").select(*variant, F.lit(0).cast("long").alias("first"), (F.col("n") - 1).alias("last"))
    several = cut(fetch_bodies(docs, kinds.join(per_anchor, "anchor").select(*variant, "lo", "hi", "_k", "p.doc_id", "p.start"), length))
    cool = several.where(F.col("_k") <= hot_variants).drop("_k")
    compared = cool.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(length), _SHARED)
    hot = several.where(F.col("_k") > hot_variants).drop("_k")
    # windows of variants that stand in two documents are in ``whole`` already; a second listing changes no union
    shared = whole.unionByName(compared)
    if not hot.isEmpty():
        shared = shared.unionByName(_compare_hot(hot, length))
    spans = seg.select(*variant, "doc_id", "start").join(shared, variant).select(
        "doc_id", (F.col("start") + F.col("first")).alias("s"), (F.col("start") + F.col("last") + length).alias("e")
    )
    by = Window.partitionBy("doc_id").orderBy("s", "e")
    before = spans.withColumn("_far", F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    island = before.withColumn("_g", F.sum(F.when(F.col("_far") >= F.col("s"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "_g").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).select("doc_id", "span_start", "span_end")


def shared_share(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_shared, n_chars): how much of each record is shared elsewhere."""
    per = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    sizes = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))
    return sizes.join(per, "doc_id", "left").select("doc_id", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), "n_chars")
