"""Block mapping, directories, the path catalog and file contents of images as relations."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import decode as D
from blockloom.functions import layout
from blockloom.functions.crc import crc32c
from blockloom.operators import hierarchy
from blockloom.session import cut
from blockloom.sources.extimage import read_ranges

KEY = ("image_id", "inode_number")
MAX_DEPTH = 5
#: Bytes of one read; longer runs of blocks are read in pieces.
READ_BYTES = 4 << 20


_NODE = "image_id string, inode_number bigint, image_path string, block_size int, node_block bigint, magic int, depth int, a bigint, b bigint, start bigint, child bigint"
_NODE_TYPE = np.dtype([("logical", "<u4"), ("length", "<u2"), ("start_hi", "<u2"), ("start_lo", "<u4")])


def _parse_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of extent nodes: of a leaf its length (b) and start, of an index node its child; a node without the magic number gives one row with that number and no depth."""
    names = [f.split(" ")[0] for f in _NODE.split(", ")]
    types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        own, found, lengths, heads = [], [], [], []
        for i, data in enumerate(batch.column("content").to_pylist()):
            data = data or b""
            magic, entries, _, depth = struct.unpack_from("<HHHH", data) if len(data) >= 12 else (0, 0, 0, 0)
            if magic != layout.EXTENT_MAGIC:
                own.append(i)
                found.append(np.zeros(1, _NODE_TYPE))
                lengths.append(1)
                heads.append((magic, -1))
                continue
            n = min(entries, len(data) // 12 - 1)
            if n > 0:
                own.append(i)
                found.append(np.frombuffer(data, _NODE_TYPE, n, 12))
                lengths.append(n)
                heads.append((magic, depth))
        if not own:
            continue
        rec = np.concatenate(found)
        take = pa.array(np.repeat(own, lengths))
        magic, depth = (np.repeat(np.array(x, np.int32), lengths) for x in zip(*heads))
        hi, lo = rec["start_hi"].astype(np.int64), rec["start_lo"].astype(np.int64)
        # an index record has the low word of its child where a leaf has length and high word, and the high word after it
        child = rec["length"].astype(np.int64) | hi << 16 | (lo & 0xFFFF) << 32
        same = [batch.column(c).take(take) for c in ("image_id", "inode_number", "image_path", "block_size", "node_block")]
        values = (magic, depth, rec["logical"].astype(np.int64), rec["length"].astype(np.int64), hi << 32 | lo, child)
        yield pa.RecordBatch.from_arrays([*same, pa.array(magic), pa.array(depth, mask=depth < 0), *[pa.array(v) for v in values[2:]]], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names=names)


def _nodes(level: DataFrame) -> DataFrame:
    return level.select(*KEY, "image_path", "block_size", "node_block", "content").mapInArrow(_parse_nodes, _NODE)


def _extent_levels(inodes: DataFrame, master_offset: int) -> list[DataFrame]:
    """Records of the nodes of each level, from the root nodes in the inodes downwards."""
    level = inodes.where("uses_extents and not unsupported").select(
        *KEY, "image_path", "block_size", F.lit(0).cast("bigint").alias("node_block"), F.col("i_block").alias("content")
    )
    out = []
    for _ in range(MAX_DEPTH + 1):
        rows = cut(_nodes(level))
        out.append(rows)
        down = rows.where("depth > 0").select(*KEY, "image_path", "block_size", F.col("child").alias("node_block"))
        if down.isEmpty():
            break
        wanted = down.select("*", (F.col("node_block") * F.col("block_size")).alias("byte_at"), F.col("block_size").cast("bigint").alias("byte_len"))
        level = read_ranges(wanted.repartition("image_path", "node_block"), master_offset)
    return out


def extents(inodes: DataFrame, master_offset: int = 0) -> DataFrame:
    """(image_id, inode_number, node_block, depth, ee_block, ee_len, ee_start, initialized) of all leaves; trees are descended level by level."""
    rows = reduce(DataFrame.unionByName, _extent_levels(inodes, master_offset)).where("depth = 0")
    long = F.col("b") > 32768
    return rows.select(*KEY, "node_block", "depth", F.col("a").alias("ee_block"), F.when(long, F.col("b") - 32768).otherwise(F.col("b")).cast("int").alias("ee_len"), F.col("start").alias("ee_start"), (~long).alias("initialized"))


def extent_errors(inodes: DataFrame, master_offset: int = 0) -> DataFrame:
    """(image_id, inode_number, node_block, magic) of extent nodes without the magic number; what hangs on them is missing from ``extents``."""
    return reduce(DataFrame.unionByName, _extent_levels(inodes, master_offset)).where("depth is null").select(*KEY, "node_block", "magic")


def extent_checksums(inodes: DataFrame, superblocks: DataFrame, master_offset: int = 0) -> DataFrame:
    """(image_id, inode_number, node_block, stored, computed, valid) of the extent nodes outside inodes, in images with metadata checksums.

    The checksum covers the seed of the file system, inode number, generation and the node up to its tail, which stands behind the records the node has room for.
    """
    seed = superblocks.where(F.col("ro_compat.METADATA_CSUM")).select("image_id", F.when(F.col("incompat.CSUM_SEED"), F.col("s_checksum_seed")).alias("_seed"), "s_uuid")
    tree = inodes.join(seed, "image_id")
    nodes = [rows.where("depth > 0").select(*KEY, "image_path", "block_size", F.col("child").alias("node_block")) for rows in _extent_levels(tree, master_offset)]
    wanted = reduce(DataFrame.unionByName, nodes).join(tree.select(*KEY, "i_generation", "_seed", "s_uuid"), list(KEY))
    read = read_ranges(wanted.select("*", (F.col("node_block") * F.col("block_size")).alias("byte_at"), F.col("block_size").cast("bigint").alias("byte_len")), master_offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("inode_number", "i_generation", "_seed", "s_uuid", "content")
        for batch in batches:
            stored, computed = [], []
            for number, generation, start, identifier, data in zip(*(batch.column(n).to_pylist() for n in names)):
                room = struct.unpack_from("<H", data, 4)[0]
                end = min(12 + 12 * room, len(data) - 4)
                base = crc32c(identifier) if start is None else start
                stored.append(struct.unpack_from("<I", data, end)[0])
                computed.append(crc32c(data[:end], crc32c(struct.pack("<II", number, generation), base)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("image_id"), batch.column("inode_number"), batch.column("node_block"), pa.array(stored, pa.int64()), pa.array(computed, pa.int64())], names=["image_id", "inode_number", "node_block", "stored", "computed"]
            )

    sums = read.mapInArrow(run, "image_id string, inode_number bigint, node_block bigint, stored bigint, computed bigint")
    return sums.withColumn("valid", F.col("stored") == F.col("computed"))


def _pointers(frame: DataFrame, kept: str, column: str) -> DataFrame:
    """``kept`` columns and (k, p) of the pointers other than zero in the bytes of ``column``."""
    names = kept.split(" ")
    fields = ", ".join(f"`{n}` {frame.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                row, k, p = [], [], []
                for i, data in enumerate(b.column(column).to_pylist()):
                    v = np.frombuffer(data, "<u4", len(data) // 4)
                    own = np.flatnonzero(v)
                    row.append(np.full(len(own), i))
                    k.append(own)
                    p.append(v[own].astype(np.int64))
                take = pa.array(np.concatenate(row).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*[b.column(n).take(take) for n in names], pa.array(np.concatenate(k).astype(np.int64)), pa.array(np.concatenate(p))], names=[*names, "k", "p"])

    return frame.select(*names, column).mapInArrow(run, f"{fields}, k bigint, p bigint")


def mapped_blocks(inodes: DataFrame, master_offset: int = 0) -> DataFrame:
    """(image_id, inode_number, logical_block, physical_block) of block-mapped inodes; zero pointers are holes and give no row."""
    base = inodes.where("not uses_extents and not unsupported and i_mode <> 0 and (i_blocks_lo > 0) and not (file_type in ('character_device', 'block_device', 'fifo', 'socket'))")
    base = base.where("not (file_type = 'symlink' and i_size_lo < 60)")
    slots = cut(_pointers(base, "image_id inode_number image_path block_size", "i_block"))
    per = F.expr("block_size div 4").cast("bigint")
    out = slots.where("k < 12").select(*KEY, F.col("k").cast("bigint").alias("logical_block"), F.col("p").alias("physical_block"))
    first = F.when(F.col("k") == 12, F.lit(12)).when(F.col("k") == 13, 12 + per).otherwise(12 + per + per * per)
    level = slots.where("k >= 12").select(*KEY, "image_path", "block_size", (F.col("k") - 11).alias("height"), first.cast("bigint").alias("first"), "p")
    for _ in range(3):
        level = cut(level)
        if level.isEmpty():
            break
        wanted = level.select("*", (F.col("p") * F.col("block_size")).alias("byte_at"), F.col("block_size").cast("bigint").alias("byte_len"))
        read = read_ranges(wanted.repartition("image_path", "p"), master_offset)
        below = _pointers(read, "image_id inode_number image_path block_size height first", "content")
        span = F.when(F.col("height") == 1, F.lit(1)).when(F.col("height") == 2, per).otherwise(per * per)
        below = cut(below.select(*KEY, "image_path", "block_size", (F.col("height") - 1).alias("height"), (F.col("first") + F.col("k") * span).alias("first"), "p"))
        out = out.unionByName(below.where("height = 0").select(*KEY, F.col("first").alias("logical_block"), F.col("p").alias("physical_block")))
        level = below.where("height > 0")
    return out


def block_runs(inodes: DataFrame, master_offset: int = 0) -> DataFrame:
    """(image_id, inode_number, logical, n, physical, initialized): runs consecutive in logical and physical order, without holes."""
    single = mapped_blocks(inodes, master_offset)
    by = Window.partitionBy(*KEY).orderBy("logical_block")
    breaks = (F.col("logical_block") - F.lag("logical_block").over(by) != 1) | (F.col("physical_block") - F.lag("physical_block").over(by) != 1)
    mapped = (
        single.withColumn("_new", F.coalesce(breaks, F.lit(True)).cast("int"))
        .withColumn("_r", F.sum("_new").over(by))
        .groupBy(*KEY, "_r")
        .agg(F.min("logical_block").alias("logical"), F.count("*").alias("n"), F.min("physical_block").alias("physical"))
        .select(*KEY, "logical", "n", "physical", F.lit(True).alias("initialized"))
    )
    tree = extents(inodes, master_offset).select(*KEY, F.col("ee_block").alias("logical"), F.col("ee_len").cast("bigint").alias("n"), F.col("ee_start").alias("physical"), "initialized")
    return mapped.unionByName(tree)


def contiguous(runs: DataFrame, *order: str) -> DataFrame:
    """(image_id, inode_number, seq, block_start, block_end, running_start, running_end): runs in logical order (then by ``order``), joined where the next begins where the last ends on disk.

    ``runs``: image_id, inode_number, logical, n, physical. Offsets are in blocks and run on without holes, as the parts of a reader that ignores them.
    """
    first = ("logical", *order)
    by = Window.partitionBy(*KEY).orderBy(*first)
    rows = runs.withColumn("_end", F.lag(F.col("physical") + F.col("n")).over(by))
    parts = (
        rows.withColumn("_r", F.sum(F.when(F.col("physical") == F.col("_end"), 0).otherwise(1)).over(by))
        .groupBy(*KEY, "_r")
        .agg(F.min_by("physical", F.struct(*first)).alias("block_start"), F.sum("n").alias("n_blocks"))
    )
    along = Window.partitionBy(*KEY).orderBy("_r")
    running = F.sum("n_blocks").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return parts.select(
        *KEY, F.row_number().over(along).alias("seq"), "block_start", (F.col("block_start") + F.col("n_blocks")).alias("block_end"), (running - F.col("n_blocks")).alias("running_start"), running.alias("running_end")
    )


def part_at(parts: DataFrame, at: Column) -> DataFrame:
    """The parts whose running range holds ``at``."""
    return parts.where((at >= F.col("running_start")) & (at < F.col("running_end")))


def holes(runs: DataFrame, *order: str) -> DataFrame:
    """``runs`` that begin behind the furthest end before them, with the blocks between as ``hole``."""
    by = Window.partitionBy(*KEY).orderBy("logical", *order)
    far = F.max(F.col("logical") + F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("hole", F.col("logical") - F.coalesce(far, F.lit(0))).where("hole > 0")


def inode_block(inodes: DataFrame, master_offset: int = 0) -> DataFrame:
    """(image_id, inode_number, logical_block, physical_block, initialized): a row per mapped block; a hole has none."""
    return block_runs(inodes, master_offset).where("n > 0").select(*KEY, F.posexplode(F.sequence(F.col("physical"), F.col("physical") + F.col("n") - 1)).alias("_k", "physical_block"), "logical", "initialized").select(
        *KEY, (F.col("logical") + F.col("_k")).alias("logical_block"), "physical_block", "initialized"
    )


_DIRENT = "image_id string, dir_inode bigint, ordinal bigint, inode bigint, rec_len int, name_len int, file_type int, name_raw binary, byte_start bigint, byte_end bigint"


def _parse_dirents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of directory blocks; each block is parsed on its own, by record length, up to its end. In blocks of 64 KiB and more a length's low bits are its high ones, and 0 or 65535 means the whole block."""
    names = [f.split(" ")[0] for f in _DIRENT.split(", ")]
    head = struct.Struct("<IHBB").unpack_from
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            b = batch.slice(lo, 4096)
            block, ordinal, inode, rec, lengths, kinds, raw, begin = ([] for _ in range(8))
            for i, (logical, start, typed, data) in enumerate(zip(*(b.column(c).to_pylist() for c in ("logical_block", "byte_at", "filetype", "content")))):
                at, slot, end = 0, 0, len(data)
                while at + 8 <= end:
                    number, size, length, kind = head(data, at)
                    if end >= 65536:
                        size = end if size in (0, 65535) else (size & 65532) | (size & 3) << 16
                    if not typed:
                        length, kind = length | kind << 8, None
                    if size < 8 or size % 4 or at + size > end:
                        break
                    if 0 < length <= size - 8:
                        block.append(i)
                        ordinal.append(logical << 16 | slot)
                        inode.append(number)
                        rec.append(size)
                        lengths.append(length)
                        kinds.append(kind)
                        raw.append(data[at + 8 : at + 8 + length])
                        begin.append(start + at)
                        slot += 1
                    at += size
            take = pa.array(block, pa.int64())
            first, size = pa.array(begin, pa.int64()), pa.array(rec, pa.int32())
            columns = [
                b.column("image_id").take(take), b.column("inode_number").take(take), pa.array(ordinal, pa.int64()), pa.array(inode, pa.int64()), size, pa.array(lengths, pa.int32()), pa.array(kinds, pa.int32()),
                pa.array(raw, pa.binary()), first, pc.add(first, size.cast(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def dirent(inodes: DataFrame, runs: DataFrame, master_offset: int = 0) -> DataFrame:
    """Entries of all allocated directories, ``.`` and ``..`` and deleted ones included; ``name`` is null where the bytes aren't UTF-8."""
    dirs = inodes.where("allocated and file_type = 'directory' and not unsupported").select(*KEY, "image_path", "block_size", "filetype", "size")
    blocks = (
        runs.join(dirs, list(KEY))
        .select(*KEY, "image_path", "block_size", "filetype", "size", "logical", "physical", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("_k"))
        .select(*KEY, "image_path", "filetype", (F.col("logical") + F.col("_k")).alias("logical_block"), ((F.col("physical") + F.col("_k")) * F.col("block_size")).alias("byte_at"), F.col("block_size").cast("bigint").alias("byte_len"), "size")
        .where("logical_block * byte_len < size")
    )
    parsed = read_ranges(blocks.drop("size").repartition("image_path", "inode_number"), master_offset).mapInArrow(_parse_dirents, _DIRENT)
    return parsed.select("*", D.dirent_type("file_type").alias("file_type_str"), F.try_validate_utf8(F.col("name_raw").cast("string")).alias("name"))


def dx_entry(inodes: DataFrame, runs: DataFrame, master_offset: int = 0) -> DataFrame:
    """Root blocks of hashed directories: their scalars and, exploded, (hash, block) of each index entry."""
    dirs = inodes.where("allocated and file_type = 'directory' and index_fl and not unsupported").select(*KEY, "image_path", "block_size")
    roots = runs.where("logical = 0").join(dirs, list(KEY)).select(*KEY, "image_path", (F.col("physical") * F.col("block_size")).alias("byte_at"), F.col("block_size").cast("bigint").alias("byte_len"))
    raw = read_ranges(roots, master_offset)
    out = raw.select(
        "image_id", F.col("inode_number").alias("dir_inode"), D.le("content", 0, 4).alias("dot_inode"), D.le("content", 12, 4).alias("dotdot_inode"), D.le("content", 0x1C, 1).alias("hash_version"),
        D.le("content", 0x1D, 1).alias("info_length"), D.le("content", 0x1E, 1).alias("indirect_levels"), D.le("content", 0x20, 2).alias("dx_limit"), D.le("content", 0x22, 2).alias("dx_count"),
        D.le("content", 0x24, 4).alias("dx_block"), "content",
    ).where("info_length = 8 and dx_count > 0 and dx_count <= dx_limit")
    entries = F.transform(
        F.sequence(F.lit(0), F.col("dx_count").cast("int") - 1),
        lambda k: F.struct(k.alias("ordinal"), F.when(k == 0, F.lit(0).cast("bigint")).otherwise(D.le("content", k * 8 + 0x20, 4)).alias("hash"), D.le("content", k * 8 + 0x24, 4).alias("block")),
    )
    return out.select(*[c for c in out.columns if c != "content"], F.explode(entries).alias("e")).select("*", "e.*").drop("e")


def _numbered(rows: DataFrame) -> DataFrame:
    """``obj_id``: 1, 2, .. per image in the order of ``_dir`` and ``ordinal``; ranges are sorted apart and offset by the few range sizes."""
    laid = rows.repartitionByRange("image_id", "_dir", "ordinal").sortWithinPartitions("image_id", "_dir", "ordinal")
    marked = cut(laid.select("*", F.monotonically_increasing_id().alias("_m"))).withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = marked.groupBy("_p").agg(F.count("*").alias("_n")).orderBy("_p").collect()  # a row per range
    total, steps = 0, []
    for r in sizes:
        steps.append((r["_p"], total))
        total += r["_n"]
    offsets = rows.sparkSession.createDataFrame(steps, "_p bigint, _before bigint")
    placed = marked.join(F.broadcast(offsets), "_p").withColumn("_at", F.col("_before") + F.col("_i"))
    first = placed.groupBy("image_id").agg(F.min("_at").alias("_first"))
    return placed.join(first, "image_id").withColumn("obj_id", F.col("_at") - F.col("_first") + 1).drop("_m", "_p", "_i", "_before", "_at", "_first")


def entry(inodes: DataFrame, dirents: DataFrame) -> DataFrame:
    """The path catalog: every live entry reachable from the root directory, in the order a depth-first walk by directory lists it."""
    live = cut(dirents.where("inode <> 0 and coalesce(name, '') not in ('.', '..') and coalesce(file_type_str, '') <> 'unknown'").select("image_id", "dir_inode", "ordinal", "inode", "name", "name_raw", "file_type", "file_type_str"))
    label = F.coalesce(F.col("name"), F.concat(F.lit("0x"), F.lower(F.hex("name_raw"))))
    props = inodes.select(
        "image_id", F.col("inode_number").alias("inode"), "size", "i_mode", F.col("i_uid"), "i_gid", "i_size_lo", "i_size_high", "i_atime", "i_ctime", "i_mtime", "i_dtime", "i_links_count", "i_blocks_lo",
        "i_flags", "i_generation", "i_file_acl_lo", "i_obso_faddr", "union_osd1", "uses_extents", "index_fl", "perm", F.col("file_type").alias("mode_type"), "image_path", "block_size",
    )
    full = live.join(props, ["image_id", "inode"]).withColumn("label", label).withColumn("file_type_str", F.coalesce("file_type_str", "mode_type"))

    up = full.where("file_type_str = 'directory'").groupBy("image_id", F.col("inode").alias("node")).agg(F.min_by(F.struct("dir_inode", "label", "ordinal"), F.struct("dir_inode", "ordinal")).alias("u"))
    links = up.select(
        F.lit("dir").alias("tree"), "image_id", "node", F.col("u.dir_inode").alias("parent"), F.col("u.label").alias("label"), F.lpad(F.col("u.ordinal").cast("string"), 16, "0").alias("order"),
        F.when(F.col("u.dir_inode") == layout.ROOT_INODE, F.lit("")).alias("base"),
    )
    where = hierarchy.resolve(links, order=True).where("path is not null and root = ''")
    known = full.join(where.select("image_id", F.col("node").alias("dir_inode"), F.col("path").alias("parent_path"), F.col("order_path").alias("_dir")), ["image_id", "dir_inode"], "left")
    top = F.col("dir_inode") == layout.ROOT_INODE
    placed = known.withColumn("parent_path", F.when(top, "").otherwise(F.col("parent_path"))).withColumn("_dir", F.when(top, "").otherwise(F.col("_dir"))).where("parent_path is not null")
    done = _numbered(placed.withColumn("full_path", F.concat("parent_path", F.lit("/"), "label")))
    return done.drop("_dir", "label", "mode_type", "name_raw")


def file_part(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Parts of regular files in reading order: runs of blocks, and holes and preallocated blocks as ``sparse`` parts."""
    files = entries.where("file_type_str = 'file' and size > 0").select("image_id", "full_path", "inode", "size", "image_path", "block_size")
    owned = files.join(runs.withColumnRenamed("inode_number", "inode"), ["image_id", "inode"], "left")
    by = Window.partitionBy("image_id", "full_path").orderBy("logical")
    end = F.col("logical") + F.col("n")
    laid = owned.withColumn("_before", F.coalesce(F.lag(end).over(by), F.lit(0))).withColumn("_last", F.lead("logical").over(by).isNull())
    blocks = F.floor((F.col("size") + F.col("block_size") - 1) / F.col("block_size")).cast("bigint")
    none = F.lit(None).cast("bigint")
    part = lambda sparse, l0, l1, physical: F.struct(sparse.alias("sparse"), l0.cast("bigint").alias("l0"), l1.cast("bigint").alias("l1"), physical.alias("physical"))
    head = part(F.lit(True), F.col("_before"), F.col("logical"), none)
    body = part(~F.col("initialized"), F.col("logical"), end, F.when(F.col("initialized"), F.col("physical")))
    tail = part(F.lit(True), F.coalesce(end, F.lit(0)), F.when(F.col("_last"), blocks).otherwise(F.lit(0)), none)
    parts = laid.select("image_id", "full_path", "inode", "size", "image_path", "block_size", F.explode(F.array(head, body, tail)).alias("p")).where("p.l1 > p.l0")
    bs = F.col("block_size")
    sized = parts.select(
        "image_id", "full_path", "size", "image_path", "block_size", F.col("p.sparse").alias("sparse"), F.col("p.physical").alias("block_start"),
        (F.col("p.physical") + F.col("p.l1") - F.col("p.l0")).alias("block_end"), (F.col("p.physical") * bs).alias("byte_start"), ((F.col("p.l1") - F.col("p.l0")) * bs).alias("byte_len"),
        (F.col("p.l0") * bs).alias("running_start"), F.col("p.l0").alias("_l0"),
    )
    used = F.greatest(F.lit(0).cast("bigint"), F.least("byte_len", F.col("size") - F.col("running_start")))
    order = Window.partitionBy("image_id", "full_path").orderBy("_l0")
    return sized.select("*", used.alias("data_len"), (F.col("running_start") + used).alias("running_end"), (F.col("byte_start") + used).alias("byte_end"), F.row_number().over(order).alias("seq")).drop("_l0")


def _read_parts(parts: DataFrame, start: Column, end: Column, master_offset: int) -> DataFrame:
    """Bytes [start, end) of each file: parts are trimmed, read in pieces of at most READ_BYTES and put together in order."""
    a, b = F.greatest(start, F.col("running_start")), F.least(end, F.col("running_start") + F.col("byte_len"))
    trimmed = parts.select("image_id", "full_path", "image_path", "byte_start", "running_start", a.alias("_a"), b.alias("_b")).where("_b > _a")
    step = F.lit(READ_BYTES)
    pieces = trimmed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_b") - F.col("_a") - 1) / step).cast("bigint"))).alias("_k"))
    at = F.col("_a") + F.col("_k") * step
    wanted = pieces.select("image_id", "full_path", "image_path", at.alias("_at"), (F.col("byte_start") + at - F.col("running_start")).alias("byte_at"), F.least(step, F.col("_b") - at).alias("byte_len"))
    read = read_ranges(wanted.repartition("image_path", "full_path"), master_offset)
    return read.groupBy("image_id", "full_path").agg(F.expr("listagg(content) within group (order by _at)").alias("content"))


def file_pieces(entries: DataFrame, parts: DataFrame, master_offset: int = 0, piece_bytes: int = READ_BYTES) -> DataFrame:
    """(image_id, full_path, piece, piece_start, n_bytes, content) of regular files of any size: ``content`` holds bytes ``[piece_start, piece_start + n_bytes)``, null where all of them lie in holes.

    No row holds more than ``piece_bytes`` bytes, so a file larger than a binary value can be is read like any other. An empty file has no piece.
    """
    step = F.lit(piece_bytes).cast("bigint")
    data = parts.where("not sparse").select("image_id", "full_path", "image_path", "byte_start", "running_start", (F.col("running_start") + F.least("byte_len", F.col("data_len"))).alias("_end")).where("_end > running_start")
    cutup = data.select("*", F.explode(F.sequence(F.expr(f"running_start div {piece_bytes}"), F.expr(f"(_end - 1) div {piece_bytes}"))).alias("piece"))
    a, b = F.greatest("running_start", F.col("piece") * step), F.least("_end", (F.col("piece") + 1) * step)
    wanted = cutup.select("image_id", "full_path", "piece", "image_path", a.alias("_at"), (F.col("byte_start") + a - F.col("running_start")).alias("byte_at"), (b - a).alias("byte_len"))
    read = read_ranges(wanted.repartition("image_path", "full_path", "piece"), master_offset)
    files = entries.where("file_type_str = 'file' and size > 0").select("image_id", "full_path", "size")
    every = files.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size - 1) div {piece_bytes}"))).alias("piece"))
    sized = every.select("image_id", "full_path", "piece", (F.col("piece") * step).alias("piece_start"), F.least(step, F.col("size") - F.col("piece") * step).alias("n_bytes"))
    laid = read.groupBy("image_id", "full_path", "piece").agg(F.collect_list(F.struct("_at", "content")).alias("_parts"))
    joined = sized.join(laid, ["image_id", "full_path", "piece"], "left")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 8):
                b = batch.slice(k, 8)
                out = []
                for start, n, own in zip(b.column("piece_start").to_pylist(), b.column("n_bytes").to_pylist(), b.column("_parts").to_pylist()):
                    if own is None:
                        out.append(None)
                        continue
                    buffer = bytearray(n)
                    for part in own:
                        at = part["_at"] - start
                        buffer[at : at + len(part["content"])] = part["content"]
                    out.append(bytes(buffer))
                yield pa.record_batch({**{c: b.column(c) for c in ("image_id", "full_path", "piece", "piece_start", "n_bytes")}, "content": pa.array(out, pa.binary())})

    return joined.mapInArrow(fill, "image_id string, full_path string, piece bigint, piece_start bigint, n_bytes bigint, content binary")


def file_content(entries: DataFrame, parts: DataFrame, master_offset: int = 0, limit: int | None = None) -> DataFrame:
    """(image_id, full_path, content) of regular files; ``limit`` takes the first bytes only."""
    end = F.col("size") if limit is None else F.least(F.col("size"), F.lit(limit))
    read = _read_parts(parts, F.lit(0).cast("bigint"), end, master_offset)
    files = entries.where("file_type_str = 'file'").select("image_id", "full_path")
    return files.join(read, ["image_id", "full_path"], "left").select("image_id", "full_path", F.coalesce("content", F.unhex(F.lit(""))).alias("content"))


def range_read(entries: DataFrame, parts: DataFrame, offset: int, count: int | None, master_offset: int = 0) -> DataFrame:
    """``count`` bytes (null: all) from ``offset`` of each file, clamped to its size."""
    if offset < 0 or count is not None and count < -1:
        raise ValueError("offset and count must not be negative")
    whole = count is None or count == -1
    end = F.col("size") if whole else F.least(F.col("size"), F.lit(offset + count).cast("bigint"))
    read = _read_parts(parts, F.lit(offset).cast("bigint"), end, master_offset)
    files = entries.where("file_type_str = 'file'").select("image_id", "full_path")
    return files.join(read, ["image_id", "full_path"], "left").select("image_id", "full_path", F.coalesce("content", F.unhex(F.lit(""))).alias("content"))


def slack(parts: DataFrame, master_offset: int = 0, content: bool = True) -> DataFrame:
    """(image_id, full_path, slack_size[, content]): the bytes between a file's end and the end of its last block."""
    total = parts.groupBy("image_id", "full_path").agg(F.max(F.col("running_start") + F.col("byte_len")).alias("_all"), F.max("size").alias("size"))
    sizes = total.select("image_id", "full_path", F.greatest(F.lit(0).cast("bigint"), F.col("_all") - F.col("size")).alias("slack_size"))
    if not content:
        return sizes
    read = _read_parts(parts, F.col("size"), F.col("running_start") + F.col("byte_len"), master_offset)
    return sizes.join(read, ["image_id", "full_path"], "left").select("image_id", "full_path", "slack_size", F.coalesce("content", F.unhex(F.lit(""))).alias("content"))
