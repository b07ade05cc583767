"""Superblocks, groups, bitmaps and inodes of images as relations; what derives from decoded fields is a Catalyst expression, runs of bits are read off the packed bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import decode as D
from blockloom.functions import layout


def superblock(raw: DataFrame) -> DataFrame:
    fields = [D.le("raw", at, w).alias(n) for n, at, w in layout.SUPERBLOCK]
    blobs = [D.raw("raw", at, w).alias(n) for n, at, w in layout.SUPERBLOCK_RAW if n not in ("s_volume_name", "s_last_mounted", "s_mount_opts")]
    texts = [D.c_string(D.raw("raw", at, w)).alias(n) for n, at, w in layout.SUPERBLOCK_RAW if n in ("s_volume_name", "s_last_mounted", "s_mount_opts")]
    arrays = [F.array(*[D.le("raw", at + k * w, w) for k in range(n)]).alias(name) for name, at, w, n in layout.SUPERBLOCK_ARRAYS]
    out = raw.select("image_id", "image_path", *fields, *blobs, *texts, *arrays)
    total = lambda low, high: F.col(low) + F.when(D.has("s_feature_incompat", 0x80), F.col(high)).otherwise(0) * F.lit(1 << 32)
    return out.select(
        "*",
        F.call_function("shiftleft", F.lit(1024), F.col("s_log_block_size").cast("int")).alias("block_size"),
        F.expr("s_inodes_count div s_inodes_per_group").cast("int").alias("block_group_count"),
        total("s_blocks_count_lo", "s_blocks_count_hi").alias("blocks_count"),
        total("s_free_blocks_count_lo", "s_free_blocks_count_hi").alias("free_blocks_count"),
        D.uuid_text(F.col("s_uuid")).alias("uuid_str"),
        D.uuid_text(F.col("s_journal_uuid")).alias("journal_uuid_str"),
        (F.col("s_state") == 1).alias("state_cleanly_unmounted"),
        D.hex_text("s_magic").alias("magic_hex"),
        D.flags("s_feature_compat", layout.COMPAT).alias("compat"),
        D.flags("s_feature_incompat", layout.INCOMPAT).alias("incompat"),
        D.flags("s_feature_ro_compat", layout.RO_COMPAT).alias("ro_compat"),
    )


def group_desc(raw: DataFrame) -> DataFrame:
    out = raw.withColumn("bits", F.col("desc_size") * 8).drop("desc_size")
    start = F.col("first_data_block") + F.col("group_number") * F.col("blocks_per_group")
    return out.select(
        "*",
        *[D.has("flags", m).alias(n) for m, n in layout.GROUP_FLAGS.items()],
        start.alias("starting_block"),
        (F.col("group_number") * F.col("inodes_per_group") + 1).alias("starting_inode"),
        F.least("blocks_per_group", F.col("blocks_count") - start).alias("number_of_blocks"),
        F.col("inodes_per_group").alias("number_of_inodes"),
        D.ceil_div(F.col("inodes_per_group"), 8).alias("inode_bitmap_bytes"),
        (F.col("bitmap_inode") * F.col("block_size")).alias("bitmap_inode_bytes"),
        (F.col("table_inode") * F.col("block_size")).alias("table_inode_bytes"),
    )


def _bits(raw: bytes, n: int) -> np.ndarray:
    """The first ``n`` bits, least significant first; missing bytes are zero."""
    return np.unpackbits(np.frombuffer(raw.ljust(-(-n // 8), b"\0"), np.uint8), bitorder="little")[:n]


def explode_bits(bitmaps: DataFrame, number: str) -> DataFrame:
    """(image_id, group_number, number, allocated): a row per bit of ``bits``, least significant first, up to ``n_bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, group, first, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if n > 0:
                    used = _bits(raw, n).astype(bool)
                    same = [pa.repeat(pa.scalar(v, t), n) for v, t in ((image, pa.string()), (group, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(first + np.arange(n, dtype=np.int64)), pa.array(used)], names=["image_id", "group_number", number, "allocated"])

    own = bitmaps.select("image_id", F.col("group_number").cast("int"), F.col("first_number").cast("bigint"), "n_bits", "bits")
    return own.mapInArrow(run, f"image_id string, group_number int, {number} bigint, allocated boolean")


def bit_runs(bitmaps: DataFrame) -> DataFrame:
    """(image_id, group_number, range_start, range_end, allocated, first, last): runs of equal bits of each bitmap, read off the packed bits; ``first`` and ``last`` tell the runs at its ends."""
    names = ["image_id", "group_number", "range_start", "range_end", "allocated", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, group, start, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if n > 0:
                    used = _bits(raw, n)
                    at = np.concatenate([[0], np.flatnonzero(np.diff(used)) + 1]).astype(np.int64)
                    end = np.append(at[1:], n) - 1
                    k = len(at)
                    same = [pa.repeat(pa.scalar(v, t), k) for v, t in ((image, pa.string()), (group, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(start + at), pa.array(start + end), pa.array(used[at].astype(bool)), pa.array(at == 0), pa.array(end == n - 1)], names=names)

    own = bitmaps.select("image_id", F.col("group_number").cast("int"), F.col("first_number").cast("bigint"), "n_bits", "bits")
    return own.mapInArrow(run, "image_id string, group_number int, range_start bigint, range_end bigint, allocated boolean, first boolean, last boolean")


def run_usage(runs: DataFrame) -> DataFrame:
    """(image_id, group_number, allocated, unallocated) from runs of bits."""
    n = F.col("range_end") - F.col("range_start") + 1
    total = lambda c: F.sum(F.when(c, n).otherwise(0)).alias
    return runs.groupBy("image_id", "group_number").agg(total(F.col("allocated"))("allocated"), total(~F.col("allocated"))("unallocated"))


def free_runs(runs: DataFrame) -> DataFrame:
    """(image_id, range_start, range_end, n) of free numbers: only the runs at the ends of a bitmap can go on in another one, so at most two rows a group meet in a window."""
    free = runs.where(~F.col("allocated"))
    edge = F.col("first") | F.col("last")
    by = Window.partitionBy("image_id").orderBy("range_start")
    edges = free.where(edge).withColumn("_new", F.coalesce(F.col("range_start") - F.lag("range_end").over(by) > 1, F.lit(True)).cast("int")).withColumn("_i", F.sum("_new").over(by))
    joined = edges.groupBy("image_id", "_i").agg(F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end")).drop("_i")
    out = joined.unionByName(free.where(~edge).select("image_id", "range_start", "range_end"))
    return out.withColumn("n", F.col("range_end") - F.col("range_start") + 1)


def block(bitmaps: DataFrame) -> DataFrame:
    return explode_bits(bitmaps.where("kind = 'block'"), "block_number")


def inode_bitmap(bitmaps: DataFrame) -> DataFrame:
    return explode_bits(bitmaps.where("kind = 'inode'"), "inode_number")


def inode(raw: DataFrame) -> DataFrame:
    out = raw
    kind = D.mode_type("i_mode")
    nothing = ~F.col("allocated") & D.has("i_flags", 0x81000).__invert__()
    for n, _, _ in layout.INODE[:11]:
        nothing = nothing & (F.col(n) == 0)
    return out.select(
        "*",
        kind.alias("file_type"),
        D.permissions("i_mode").alias("perm"),
        (F.col("i_size_lo") + F.when(kind == "file", F.col("i_size_high")).otherwise(0) * F.lit(1 << 32)).alias("size"),
        D.has("i_flags", 0x80000).alias("uses_extents"),
        D.has("i_flags", 0x1000).alias("index_fl"),
        D.flags("i_flags", layout.INODE_FLAGS).alias("inode_flags"),
        nothing.alias("zeroed"),
        # a short target is kept in the block map itself
        F.when((kind == "symlink") & (F.col("i_blocks_lo") == 0), D.c_string(F.col("i_block"))).alias("symlink_target"),
        # contents that this engine does not interpret are told, not misread
        (D.has("i_flags", 0x4) | D.has("i_flags", 0x800) | D.has("i_flags", 0x10000000)).alias("unsupported"),
    )


def inode_group(number: Column, per_group: Column) -> Column:
    return F.floor((number - 1) / per_group).cast("int")


def block_group(number: Column, first: Column, per_group: Column) -> Column:
    return F.floor((number - first) / per_group).cast("int")


def group_usage(units: DataFrame) -> DataFrame:
    """(image_id, group_number, allocated, unallocated) of a block or inode relation."""
    return units.groupBy("image_id", "group_number").agg(F.count_if("allocated").alias("allocated"), F.count_if(~F.col("allocated")).alias("unallocated"))


def islands(units: DataFrame, number: str, entity: str = "image_id", group: str = "group_number") -> DataFrame:
    """(entity, range_start, range_end, n): maximal runs of consecutive numbers.

    Groups hold ascending ranges of numbers of bounded size. Runs form inside groups; only the first and last run of each group can go on in another
    group, so at most two rows a group meet in the window of an entity, however many runs it has.
    """
    inner = Window.partitionBy(entity, group).orderBy(number)
    runs = (
        units.select(entity, group, number, (F.col(number) - F.row_number().over(inner)).alias("_g"))
        .groupBy(entity, group, "_g")
        .agg(F.min(number).alias("a"), F.max(number).alias("b"))
    )
    whole = Window.partitionBy(entity, group)
    marked = runs.withColumn("_edge", (F.col("a") == F.min("a").over(whole)) | (F.col("b") == F.max("b").over(whole)))
    across = Window.partitionBy(entity).orderBy("a")
    edges = marked.where("_edge").withColumn("_new", F.coalesce(F.col("a") - F.lag("b").over(across) > 1, F.lit(True)).cast("int")).withColumn("_i", F.sum("_new").over(across))
    joined = edges.groupBy(entity, "_i").agg(F.min("a").alias("range_start"), F.max("b").alias("range_end")).drop("_i")
    out = joined.unionByName(marked.where(~F.col("_edge")).select(entity, F.col("a").alias("range_start"), F.col("b").alias("range_end")))
    return out.withColumn("n", F.col("range_end") - F.col("range_start") + 1)


