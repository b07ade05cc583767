"""The reader's operators applied to the metadata tables, each with its SQL."""

from __future__ import annotations

import datetime
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import decode as D
from blockloom.functions import layout
from blockloom.operators import files as FL
from blockloom.operators import metadata as M
from blockloom.session import read_table
from blockloom.sources.extimage import inode_columns


def _live(spark: SparkSession, d: str, *more: str) -> DataFrame:
    rows = read_table(spark, d, "dirent", "entry_id", "image_id", "dir_inode", "inode", "name", "file_type_str", *more)
    return rows.where("inode <> 0 and coalesce(name, '') not in ('.', '..') and coalesce(file_type_str, '') <> 'unknown'").dropDuplicates(["entry_id"])


_INODE_STATE = ("image_id", "inode_number", "scan_ts")


def _inodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per inode: its newest state (largest scan_ts)."""
    rows = read_table(spark, d, "inode", *dict.fromkeys((*_INODE_STATE, *columns)))
    newest = rows.groupBy("image_id", "inode_number").agg(F.max_by(F.struct(*columns), F.struct("scan_ts", *columns)).alias("s"))
    return newest.select("image_id", "inode_number", *[F.col(f"s.{c}").alias(c) for c in columns if c not in ("image_id", "inode_number")])


def mode_decode(spark: SparkSession, d: str) -> DataFrame:
    return _inodes(spark, d, "i_mode").select("image_id", "inode_number", D.mode_type("i_mode").alias("kind"), D.hex_text("i_mode").alias("mode_hex"))


def permissions(spark: SparkSession, d: str) -> DataFrame:
    perm = _inodes(spark, d, "i_mode").select("image_id", "inode_number", D.permissions("i_mode").alias("p"))
    flat = [F.col(f"p.{w}.{a}").alias(f"{w}_{a}") for w, rights in layout.PERMISSIONS.items() for a in rights] + [F.col(f"p.{n}").alias(n) for n in layout.SPECIAL_BITS]
    return perm.select("image_id", "inode_number", *flat)


def inode_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = _inodes(spark, d, "i_flags")
    return rows.select("image_id", "inode_number", D.flag_names("i_flags", {0x1000: "INDEX", 0x80000: "EXTENTS"}).alias("names"), D.masked("i_flags", [0x1000, 0x80000]).getItem(1).alias("extent_mask"))


def feature_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "superblock", "image_id", "s_feature_incompat").dropDuplicates(["image_id"])
    f = rows.select("image_id", D.flags("s_feature_incompat", layout.INCOMPAT).alias("f"), D.flag_names("s_feature_incompat", layout.INCOMPAT).alias("names"))
    return f.select("image_id", "names", *[F.col(f"f.`{n}`").alias(n.lower() if n[0].isalpha() else "bits64") for n in layout.INCOMPAT.values()])


def superblock_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "superblock", "image_id", "s_log_block_size", "s_inodes_count", "s_inodes_per_group", "s_uuid").dropDuplicates(["image_id"])
    return rows.select(
        "image_id",
        F.call_function("shiftleft", F.lit(1024), F.col("s_log_block_size").cast("int")).alias("block_size"),
        F.expr("s_inodes_count div s_inodes_per_group").alias("block_group_count"),
        D.dashed(F.regexp_replace("s_uuid", "-", "")).alias("uuid_str"),
        D.ceil_div(F.col("s_inodes_per_group").cast("bigint"), 8).alias("bitmap_bytes"),
    )


def _le_bytes(value: Column, width: int) -> Column:
    digits = F.lpad(F.hex(value), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(width - 1, -1, -1)]))


def le_decode(spark: SparkSession, d: str) -> DataFrame:
    """Little-endian bytes of a number decode to the number, as 2, 4 and 8 bytes and signed."""
    rows = read_table(spark, d, "dirent", "entry_id", "byte_start").dropDuplicates(["entry_id"])
    raw = rows.select("entry_id", _le_bytes(F.col("byte_start"), 8).alias("b"))
    return raw.select(
        "entry_id", D.le("b", 0, 8).cast("bigint").alias("u64"), D.le("b", 0, 4).alias("u32"), D.le("b", 0, 2).alias("u16"), D.le("b", 1, 1).alias("u8"),
        D.signed(D.le("b", 0, 2), 2).alias("s16"), D.be("b", 0, 4).alias("be32"),
    )


def uuid_format(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", D.dashed(F.md5("text")).alias("uuid_str")).distinct()


def human_duration(spark: SparkSession, d: str) -> DataFrame:
    rows = _inodes(spark, d, "i_atime", "i_mtime")
    return rows.select("image_id", "inode_number", D.human_duration(F.col("i_atime") - F.col("i_mtime") + 90_000).alias("since"), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("i_mtime") / 86400).cast("int")).alias("m_day"))


def live_entries(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).select("entry_id", "image_id", "inode", "name")


def deleted_entries(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "dirent", "entry_id", "image_id", "dir_inode", "inode", "name").where("inode = 0").dropDuplicates(["entry_id"])


def children_of_root(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).where("dir_inode = 2").select("entry_id", "image_id", F.concat(F.lit("/"), "name").alias("full_path"), "file_type_str")


def dirent_inode_join(spark: SparkSession, d: str) -> DataFrame:
    props = _inodes(spark, d, "size", "i_mode", "i_uid", "i_links_count").withColumnRenamed("inode_number", "inode")
    return _live(spark, d).join(props, ["image_id", "inode"]).select("entry_id", "image_id", "inode", "name", "size", "i_mode", "i_uid", "i_links_count")


def dirent_types(spark: SparkSession, d: str) -> DataFrame:
    """Type by the entry's code, else by the inode's mode."""
    rows = read_table(spark, d, "dirent", "entry_id", "image_id", "inode", "file_type").where("inode <> 0").dropDuplicates(["entry_id"])
    modes = _inodes(spark, d, "i_mode").withColumnRenamed("inode_number", "inode")
    kind = F.coalesce(F.when(F.col("file_type") > 0, D.dirent_type("file_type")), D.mode_type("i_mode"))
    return rows.join(modes, ["image_id", "inode"], "left").select("entry_id", F.when(F.col("file_type").isNull() & F.col("i_mode").isNull(), None).otherwise(kind).alias("kind"))


def link_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entries per file inode against its link count."""
    found = _live(spark, d).where("file_type_str = 'file'").groupBy("image_id", "inode").agg(F.count("*").alias("n_entries"))
    links = _inodes(spark, d, "i_links_count").withColumnRenamed("inode_number", "inode")
    return found.join(links, ["image_id", "inode"]).where("n_entries <> i_links_count").select("image_id", "inode", "n_entries", "i_links_count")


def name_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose stored length is not that of the UTF-8 name, and their bytes."""
    rows = read_table(spark, d, "dirent", "entry_id", "name", "name_len", "rec_len", "byte_start", "byte_end").where("name is not null").dropDuplicates(["entry_id"])
    return rows.select(
        "entry_id", F.octet_length("name").cast("bigint").alias("n_bytes"), (F.octet_length("name") == F.col("name_len")).alias("same"), F.lower(F.hex(F.col("name").cast("binary"))).alias("name_hex"),
        (F.col("byte_end") - F.col("byte_start") == F.col("rec_len")).alias("spans_record"), D.hex_text("byte_start").alias("byte_start_hex"),
    )


def inode_to_group(spark: SparkSession, d: str) -> DataFrame:
    per = read_table(spark, d, "superblock", "image_id", "s_inodes_per_group").dropDuplicates(["image_id"])
    rows = read_table(spark, d, "inode", "image_id", "inode_number", "group_number").distinct()
    return rows.join(per, "image_id").select("image_id", "inode_number", "group_number", M.inode_group(F.col("inode_number"), F.col("s_inodes_per_group")).alias("computed_group"))


def block_to_group(spark: SparkSession, d: str) -> DataFrame:
    """Group of each extent's first block; a group has as many blocks as a bitmap block has bits, the first data block is 1 where blocks have 1 KiB."""
    bs = read_table(spark, d, "superblock", "image_id", "block_size").dropDuplicates(["image_id"])
    rows = read_table(spark, d, "extent", "extent_id", "image_id", "ee_start_hi", "ee_start_lo").where("ee_start_lo is not null").dropDuplicates(["extent_id"])
    block = F.col("ee_start_hi").cast("bigint") * F.lit(1 << 32) + F.col("ee_start_lo")
    first = F.when(F.col("block_size") == 1024, 1).otherwise(0)
    return rows.join(bs, "image_id").select("extent_id", block.alias("physical"), M.block_group(block, first, 8 * F.col("block_size")).alias("group_number"), D.hex_text(block).alias("physical_hex"))


def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.group_usage(_inodes(spark, d, "group_number", "allocated"))


def image_totals(spark: SparkSession, d: str) -> DataFrame:
    seen = _inodes(spark, d, "allocated", "size", "file_type").groupBy("image_id").agg(
        F.count_if("allocated").alias("n_allocated"), F.sum(F.when(F.col("allocated"), F.col("size"))).alias("n_bytes"), F.countDistinct("file_type").alias("n_types")
    )
    own = read_table(spark, d, "superblock", "image_id", "s_inodes_count", "s_blocks_count").dropDuplicates(["image_id"])
    return own.join(seen, "image_id", "left").select("image_id", "s_inodes_count", "s_blocks_count", F.coalesce("n_allocated", F.lit(0)).alias("n_allocated"), "n_bytes", "n_types")


def usage_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _inodes(spark, d, "file_type", "size").groupBy("image_id", "file_type").agg(F.count("*").alias("n_inodes"), F.sum("size").alias("n_bytes"), F.max("size").alias("largest"))


def bitmap_explode(spark: SparkSession, d: str) -> DataFrame:
    """``p_size`` as a bitmap of eight parts."""
    rows = read_table(spark, d, "part", "p_partkey", "p_size")
    maps = rows.select(F.lit("parts").alias("image_id"), F.col("p_partkey").alias("group_number"), (F.col("p_partkey") * 8).alias("first_number"), F.lit(8).alias("n_bits"), _le_bytes(F.col("p_size"), 1).alias("bits"))
    return M.explode_bits(maps, "number").select(F.col("group_number").alias("p_partkey"), "number", "allocated")


def free_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Runs of inode numbers without an allocated inode between the known ones."""
    rows = _inodes(spark, d, "group_number", "allocated").where("not allocated")
    return M.islands(rows, "inode_number")


def _part_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "extent", "extent_id", "image_id", "inode_number", "ee_block", "ee_len", "ee_start_hi", "ee_start_lo")
    rows = rows.where("ee_len > 0 and ee_block is not null and ee_start_lo is not null").dropDuplicates(["extent_id"])
    n = F.when(F.col("ee_len") > 32768, F.col("ee_len") - 32768).otherwise(F.col("ee_len")).cast("bigint")
    start = F.col("ee_start_hi").cast("bigint") * F.lit(1 << 32) + F.col("ee_start_lo")
    return rows.select("image_id", "inode_number", "extent_id", F.col("ee_block").alias("logical"), n.alias("n"), start.alias("physical"), (F.col("ee_len") <= 32768).alias("initialized"))


def file_parts(spark: SparkSession, d: str) -> DataFrame:
    """Extents in logical order, joined where the next begins where the last ends on disk, with running offsets."""
    return FL.contiguous(_part_rows(spark, d), "extent_id")


def range_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The part that holds the middle block of each inode's parts."""
    parts = file_parts(spark, d)
    middle = parts.groupBy("image_id", "inode_number").agg(F.expr("max(running_end) div 2").alias("at"))
    found = FL.part_at(parts.join(middle, ["image_id", "inode_number"]), F.col("at"))
    return found.select("image_id", "inode_number", "at", "seq", (F.col("block_start") + F.col("at") - F.col("running_start")).alias("block"))


def extent_holes(spark: SparkSession, d: str) -> DataFrame:
    """Blocks between an extent's start and the furthest end before it."""
    return FL.holes(_part_rows(spark, d), "extent_id").select("extent_id", "image_id", "inode_number", "logical", "hole")


def uninitialized_extents(spark: SparkSession, d: str) -> DataFrame:
    return _part_rows(spark, d).groupBy("image_id").agg(F.count_if(~F.col("initialized")).alias("n_uninitialized"), F.sum(F.when(F.col("initialized"), F.col("n")).otherwise(0)).alias("n_readable"))


def slack(spark: SparkSession, d: str) -> DataFrame:
    bs = read_table(spark, d, "superblock", "image_id", "block_size").dropDuplicates(["image_id"])
    rows = _inodes(spark, d, "size", "file_type").where("file_type = 'file' and size > 0").join(bs, "image_id")
    whole = F.expr("(size + block_size - 1) div block_size * block_size")
    parts = rows.select("image_id", F.col("inode_number").cast("string").alias("full_path"), "size", F.lit(0).cast("bigint").alias("running_start"), whole.alias("byte_len"))
    return FL.slack(parts, content=False).select("image_id", F.col("full_path").cast("bigint").alias("inode_number"), "slack_size")


_RAW_INODE = ("i_mode", "i_uid", "size", "i_atime", "i_ctime", "i_mtime", "i_dtime", "i_gid", "i_links_count", "i_blocks_lo", "i_flags", "i_generation")


def _decoded_inodes(spark: SparkSession, d: str) -> DataFrame:
    """The table's inodes written as raw records of the disk and decoded again."""
    where = {n: (o, w) for n, o, w in layout.INODE}
    columns = ("image_id", "inode_number", "allocated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.zeros((batch.num_rows, 128), np.uint8)
            for name in _RAW_INODE:
                v = batch.column(name).cast(pa.int64()).fill_null(0).to_numpy()
                for field, part in (("i_size_lo", v & 0xFFFFFFFF), ("i_size_high", v >> 32)) if name == "size" else ((name, v),):
                    at, width = where[field]
                    raw[:, at : at + width] = part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
            fields = inode_columns(raw.tobytes(), 128)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *fields.values()], names=[*columns, *fields])

    rows = _inodes(spark, d, "allocated", *_RAW_INODE)
    schema = "image_id string, inode_number bigint, allocated boolean, " + ", ".join(f"{n} bigint" for n, _, _ in layout.INODE) + ", i_block binary, union_osd2 binary"
    return M.inode(rows.mapInArrow(run, schema))


def inode_decode(spark: SparkSession, d: str) -> DataFrame:
    names = [n for n in _RAW_INODE if n != "size"]
    return _decoded_inodes(spark, d).select("image_id", "inode_number", *names, "size", F.col("file_type").alias("kind"), "uses_extents", "index_fl", "perm.setuid", "perm.user.write")


def zeroed_filter(spark: SparkSession, d: str) -> DataFrame:
    """Inodes that were never used, by allocation."""
    return _decoded_inodes(spark, d).groupBy("image_id", "allocated").agg(F.count_if("zeroed").alias("n_zeroed"), F.count("*").alias("n_all"))


def superblock_decode(spark: SparkSession, d: str) -> DataFrame:
    """The table's superblocks written as raw blocks and decoded again."""
    names = ("image_id", "s_volume_name", "s_uuid", "s_log_block_size", "s_inodes_count", "s_first_ino", "s_inodes_per_group", "s_blocks_count", "s_feature_incompat", "s_mkfs_time")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                sb = bytearray(1024)
                put = lambda form, at, v, sb=sb: struct.pack_into(form, sb, at, v)
                put("<I", 0x00, r["s_inodes_count"])
                put("<I", 0x04, r["s_blocks_count"] & 0xFFFFFFFF)
                put("<I", 0x150, r["s_blocks_count"] >> 32)
                put("<I", 0x18, r["s_log_block_size"])
                put("<I", 0x28, r["s_inodes_per_group"])
                put("<H", 0x38, layout.MAGIC)
                put("<I", 0x54, r["s_first_ino"])
                put("<I", 0x60, r["s_feature_incompat"])
                put("<I", 0x108, int(r["s_mkfs_time"].replace(tzinfo=datetime.UTC).timestamp()))
                sb[0x68:0x78] = uuid.UUID(r["s_uuid"]).bytes
                sb[0x78:0x88] = (r["s_volume_name"] or "").encode()[:16].ljust(16, b"\0")
                out.append(bytes(sb))
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("image_id"), pa.array(out, pa.binary())], names=["image_id", "image_path", "raw"])

    rows = read_table(spark, d, "superblock", *names).distinct()
    sb = M.superblock(rows.mapInArrow(run, "image_id string, image_path string, raw binary"))
    total = F.col("s_blocks_count_lo") + F.when(F.col("incompat.`64BITS`"), F.col("s_blocks_count_hi")).otherwise(0) * F.lit(1 << 32)
    return sb.select(
        "image_id", "s_inodes_count", "s_inodes_per_group", "s_first_ino", "block_size", "block_group_count", "uuid_str", "s_volume_name", "s_mkfs_time", "magic_hex", F.col("incompat.EXTENTS").alias("extents"),
        (total == F.col("blocks_count")).alias("same_total"), "s_blocks_count_lo",
    )


def inode_ages(spark: SparkSession, d: str) -> DataFrame:
    """Inodes last changed in the past, and whether the age agrees with the clock to a minute."""
    age = D.seconds_since("i_mtime")
    return _inodes(spark, d, "i_mtime").select("image_id", "inode_number", (age > 0).alias("past"), (F.abs(age + F.col("i_mtime") - F.unix_timestamp()) < 60).alias("by_the_clock"))


def obj_ids(spark: SparkSession, d: str) -> DataFrame:
    """Entries of an image numbered by directory and place, by sorted ranges and offsets instead of one sorting task."""
    rows = _live(spark, d, "ordinal").select("entry_id", "image_id", F.concat_ws("/", F.lpad(F.col("dir_inode").cast("string"), 20, "0"), F.lpad("entry_id", 20, "0")).alias("_dir"), "ordinal")
    return FL._numbered(rows).select("entry_id", "image_id", "obj_id")


def largest_files(spark: SparkSession, d: str) -> DataFrame:
    """The 20 largest files: a report of that length."""
    return _inodes(spark, d, "size", "file_type").where("file_type = 'file'").orderBy(F.desc("size"), "image_id", "inode_number").limit(20).select("image_id", "inode_number", "size")


def dx_roots(spark: SparkSession, d: str) -> DataFrame:
    """Hash-tree roots that pass the format's checks."""
    rows = read_table(spark, d, "dx_root", "dx_id", "image_id", "dir_inode", "dot_inode", "dx_limit", "dx_count", "indirect_levels").dropDuplicates(["dx_id"])
    return rows.select("dx_id", "image_id", "dir_inode", ((F.col("dx_count") <= F.col("dx_limit")) & (F.col("indirect_levels") <= 1)).alias("plausible"), F.coalesce(F.col("dot_inode") == F.col("dir_inode"), F.lit(False)).alias("own_dot"))


QUERIES = {
    f.__name__: f
    for f in (
        mode_decode, permissions, inode_flags, feature_flags, superblock_sizes, le_decode, uuid_format, human_duration, live_entries, deleted_entries, children_of_root, dirent_inode_join,
        dirent_types, link_counts, name_lengths, inode_to_group, block_to_group, group_counts, image_totals, usage_by_type, bitmap_explode, free_ranges, file_parts, range_lookup,
        extent_holes, uninitialized_extents, slack, inode_decode, zeroed_filter, superblock_decode, inode_ages, obj_ids, largest_files, dx_roots,
    )
}


def _state(*columns: str) -> str:
    packed = ", ".join(f"{c} := {c}" for c in columns)
    out = ", ".join(f"s.{c} AS {c}" for c in columns)
    return f"(SELECT image_id, inode_number, {out} FROM (SELECT image_id, inode_number, max_by(struct_pack({packed}), struct_pack(scan_ts := scan_ts, {packed})) AS s FROM inode GROUP BY ALL))"


_LIVE = "(SELECT DISTINCT entry_id, image_id, dir_inode, ordinal, inode, name, file_type_str FROM dirent WHERE inode <> 0 AND coalesce(name, '') NOT IN ('.', '..') AND coalesce(file_type_str, '') <> 'unknown')"


def _kind(column: str) -> str:
    return f"CASE ({column} & 61440) " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in layout.MODE_TYPES.items()) + " ELSE 'unknown' END"


_PARTS = """(SELECT DISTINCT image_id, inode_number, extent_id, ee_block AS logical, CAST(CASE WHEN ee_len > 32768 THEN ee_len - 32768 ELSE ee_len END AS BIGINT) AS n,
  ee_start_hi * 4294967296 + ee_start_lo AS physical, ee_len <= 32768 AS initialized FROM extent WHERE ee_len > 0 AND ee_block IS NOT NULL AND ee_start_lo IS NOT NULL)"""
_FILE_PARTS = f"""
a AS (SELECT *, CASE WHEN physical = lag(physical + n) OVER w THEN 0 ELSE 1 END AS fresh FROM {_PARTS} WINDOW w AS (PARTITION BY image_id, inode_number ORDER BY logical, extent_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id, inode_number ORDER BY logical, extent_id ROWS UNBOUNDED PRECEDING) AS r FROM a),
c AS (SELECT image_id, inode_number, r, arg_min(physical, (logical, extent_id)) AS block_start, CAST(sum(n) AS BIGINT) AS nb FROM b GROUP BY ALL),
parts AS (SELECT image_id, inode_number, CAST(row_number() OVER w AS INTEGER) AS seq, block_start, block_start + nb AS block_end,
  CAST(sum(nb) OVER w - nb AS BIGINT) AS running_start, CAST(sum(nb) OVER w AS BIGINT) AS running_end FROM c WINDOW w AS (PARTITION BY image_id, inode_number ORDER BY r ROWS UNBOUNDED PRECEDING))
"""
_FLAGS = ", ".join(f"(s_feature_incompat & {m}) <> 0 AS {n.lower() if n[0].isalpha() else 'bits64'}" for m, n in layout.INCOMPAT.items())
_NAMES = "concat_ws(' ', " + ", ".join(f"CASE WHEN (s_feature_incompat & {m}) <> 0 THEN '{n}' END" for m, n in layout.INCOMPAT.items()) + ")"
_PERMS = ", ".join(f"(i_mode & {m}) <> 0 AS {w}_{a}" for w, rights in layout.PERMISSIONS.items() for a, m in rights.items()) + ", " + ", ".join(f"(i_mode & {m}) <> 0 AS {n}" for n, m in layout.SPECIAL_BITS.items())
_TYPES = "CASE t.file_type " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in layout.DIRENT_TYPES.items() if k) + " END"

SQL = {
    "mode_decode": f"SELECT image_id, inode_number, {_kind('i_mode')} AS kind, '0x' || lower(to_hex(i_mode)) AS mode_hex FROM {_state('i_mode')}",
    "permissions": f"SELECT image_id, inode_number, {_PERMS} FROM {_state('i_mode')}",
    "inode_flags": f"SELECT image_id, inode_number, CASE WHEN i_flags & 528384 = 0 THEN 'none' ELSE concat_ws(' ', CASE WHEN i_flags & 4096 <> 0 THEN 'INDEX' END, CASE WHEN i_flags & 524288 <> 0 THEN 'EXTENTS' END) END AS names, i_flags & 524288 AS extent_mask FROM {_state('i_flags')}",
    "feature_flags": f"SELECT DISTINCT image_id, CASE WHEN {_NAMES} = '' THEN 'none' ELSE {_NAMES} END AS names, {_FLAGS} FROM superblock",
    "superblock_sizes": "SELECT DISTINCT image_id, CAST(1024 << s_log_block_size AS INTEGER) AS block_size, s_inodes_count // s_inodes_per_group AS block_group_count, s_uuid AS uuid_str, CAST((s_inodes_per_group + 7) // 8 AS BIGINT) AS bitmap_bytes FROM superblock",
    "le_decode": """SELECT DISTINCT entry_id, byte_start AS u64, byte_start & 4294967295 AS u32, byte_start & 65535 AS u16, (byte_start >> 8) & 255 AS u8,
  CASE WHEN (byte_start & 65535) >= 32768 THEN (byte_start & 65535) - 65536 ELSE byte_start & 65535 END AS s16,
  ((byte_start & 255) << 24) + (((byte_start >> 8) & 255) << 16) + (((byte_start >> 16) & 255) << 8) + ((byte_start >> 24) & 255) AS be32 FROM dirent""",
    "uuid_format": r"SELECT DISTINCT doc_id, regexp_replace(md5(text), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS uuid_str FROM documents WHERE text IS NOT NULL",
    "human_duration": f"""SELECT image_id, inode_number, printf('%dh%02dm%02ds', s // 3600, s % 3600 // 60, s % 60) AS since, CAST(make_timestamp(i_mtime * 1000000) AS DATE) AS m_day
  FROM (SELECT *, i_atime - i_mtime + 90000 AS s FROM {_state('i_atime', 'i_mtime')})""",
    "live_entries": f"SELECT entry_id, image_id, inode, name FROM {_LIVE}",
    "deleted_entries": "SELECT DISTINCT entry_id, image_id, dir_inode, inode, name FROM dirent WHERE inode = 0",
    "children_of_root": f"SELECT entry_id, image_id, '/' || name AS full_path, file_type_str FROM {_LIVE} WHERE dir_inode = 2",
    "dirent_inode_join": f"SELECT entry_id, l.image_id, inode, name, size, i_mode, i_uid, i_links_count FROM {_LIVE} l JOIN {_state('size', 'i_mode', 'i_uid', 'i_links_count')} s ON l.image_id = s.image_id AND l.inode = s.inode_number",
    "dirent_types": f"SELECT t.entry_id, CASE WHEN t.file_type IS NULL AND s.i_mode IS NULL THEN NULL ELSE coalesce({_TYPES}, {_kind('s.i_mode')}) END AS kind FROM (SELECT DISTINCT entry_id, image_id, inode, file_type FROM dirent WHERE inode <> 0) t LEFT JOIN {_state('i_mode')} s ON t.image_id = s.image_id AND t.inode = s.inode_number",
    "link_counts": f"SELECT f.image_id, f.inode, n_entries, i_links_count FROM (SELECT image_id, inode, count(*) AS n_entries FROM {_LIVE} WHERE file_type_str = 'file' GROUP BY ALL) f JOIN {_state('i_links_count')} s ON f.image_id = s.image_id AND f.inode = s.inode_number WHERE n_entries <> i_links_count",
    "name_lengths": "SELECT DISTINCT entry_id, CAST(octet_length(encode(name)) AS BIGINT) AS n_bytes, octet_length(encode(name)) = name_len AS same, lower(hex(encode(name))) AS name_hex, byte_end - byte_start = rec_len AS spans_record, '0x' || lower(to_hex(byte_start)) AS byte_start_hex FROM dirent WHERE name IS NOT NULL",
    "inode_to_group": "SELECT DISTINCT i.image_id, inode_number, group_number, CAST((inode_number - 1) // s_inodes_per_group AS INTEGER) AS computed_group FROM inode i JOIN superblock s ON i.image_id = s.image_id",
    "block_to_group": "SELECT DISTINCT extent_id, ee_start_hi * 4294967296 + ee_start_lo AS physical, CAST((ee_start_hi * 4294967296 + ee_start_lo - CASE WHEN block_size = 1024 THEN 1 ELSE 0 END) // (8 * block_size) AS INTEGER) AS group_number, '0x' || lower(to_hex(ee_start_hi * 4294967296 + ee_start_lo)) AS physical_hex FROM extent e JOIN superblock b ON e.image_id = b.image_id WHERE ee_start_lo IS NOT NULL",
    "group_counts": f"SELECT image_id, group_number, count(*) FILTER (allocated) AS allocated, count(*) FILTER (NOT allocated) AS unallocated FROM {_state('group_number', 'allocated')} GROUP BY ALL",
    "image_totals": f"SELECT b.image_id, s_inodes_count, s_blocks_count, count(*) FILTER (allocated) AS n_allocated, CAST(sum(size) FILTER (allocated) AS BIGINT) AS n_bytes, count(DISTINCT file_type) AS n_types FROM (SELECT DISTINCT image_id, s_inodes_count, s_blocks_count FROM superblock) b LEFT JOIN {_state('allocated', 'size', 'file_type')} s ON b.image_id = s.image_id GROUP BY ALL",
    "usage_by_type": f"SELECT image_id, file_type, count(*) AS n_inodes, CAST(sum(size) AS BIGINT) AS n_bytes, max(size) AS largest FROM {_state('file_type', 'size')} GROUP BY ALL",
    "bitmap_explode": "SELECT p_partkey, p_partkey * 8 + b AS number, (p_size >> CAST(b AS INTEGER)) & 1 = 1 AS allocated FROM part, range(8) r(b)",
    "free_ranges": f"""SELECT image_id, min(n) AS range_start, max(n) AS range_end, count(*) AS n FROM (
  SELECT image_id, inode_number AS n, inode_number - row_number() OVER (PARTITION BY image_id ORDER BY inode_number) AS g FROM {_state('allocated')} WHERE NOT allocated) GROUP BY image_id, g""",
    "file_parts": f"WITH {_FILE_PARTS} SELECT * FROM parts",
    "range_lookup": f"WITH {_FILE_PARTS}, mid AS (SELECT image_id, inode_number, max(running_end) // 2 AS pos FROM parts GROUP BY ALL) SELECT p.image_id, p.inode_number, pos AS at, seq, block_start + pos - running_start AS block FROM parts p JOIN mid m ON p.image_id = m.image_id AND p.inode_number = m.inode_number AND pos >= running_start AND pos < running_end",
    "extent_holes": f"SELECT extent_id, image_id, inode_number, logical, hole FROM (SELECT *, logical - coalesce(max(logical + n) OVER (PARTITION BY image_id, inode_number ORDER BY logical, extent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hole FROM {_PARTS}) WHERE hole > 0",
    "uninitialized_extents": f"SELECT image_id, count(*) FILTER (NOT initialized) AS n_uninitialized, CAST(sum(CASE WHEN initialized THEN n ELSE 0 END) AS BIGINT) AS n_readable FROM {_PARTS} GROUP BY ALL",
    "slack": f"SELECT s.image_id, inode_number, (block_size - size % block_size) % block_size AS slack_size FROM {_state('size', 'file_type')} s JOIN (SELECT DISTINCT image_id, block_size FROM superblock) b ON s.image_id = b.image_id WHERE file_type = 'file' AND size > 0",
    "inode_decode": f"SELECT image_id, inode_number, i_mode, coalesce(i_uid, 0) AS i_uid, i_atime, i_ctime, i_mtime, i_dtime, i_gid, i_links_count, i_blocks_lo, i_flags, i_generation, CASE WHEN i_mode & 61440 = 32768 THEN size ELSE size & 4294967295 END AS size, {_kind('i_mode')} AS kind, i_flags & 524288 <> 0 AS uses_extents, i_flags & 4096 <> 0 AS index_fl, i_mode & 2048 <> 0 AS setuid, i_mode & 128 <> 0 AS write FROM {_state('allocated', 'i_mode', 'i_uid', 'size', 'i_atime', 'i_ctime', 'i_mtime', 'i_dtime', 'i_gid', 'i_links_count', 'i_blocks_lo', 'i_flags', 'i_generation')}",
    "zeroed_filter": f"SELECT image_id, allocated, count(*) FILTER (NOT allocated AND i_flags & 528384 = 0 AND i_mode = 0 AND coalesce(i_uid, 0) = 0 AND size & 4294967295 = 0 AND i_atime = 0 AND i_ctime = 0 AND i_mtime = 0 AND i_dtime = 0 AND i_gid = 0 AND i_links_count = 0 AND i_blocks_lo = 0 AND i_flags = 0) AS n_zeroed, count(*) AS n_all FROM {_state('allocated', 'i_mode', 'i_uid', 'size', 'i_atime', 'i_ctime', 'i_mtime', 'i_dtime', 'i_gid', 'i_links_count', 'i_blocks_lo', 'i_flags', 'i_generation')} GROUP BY ALL",
    "superblock_decode": "SELECT DISTINCT image_id, s_inodes_count, CAST(s_inodes_per_group AS BIGINT) AS s_inodes_per_group, CAST(s_first_ino AS BIGINT) AS s_first_ino, block_size, CAST(s_inodes_count // s_inodes_per_group AS INTEGER) AS block_group_count, s_uuid AS uuid_str, coalesce(s_volume_name, '') AS s_volume_name, CAST(epoch(s_mkfs_time) AS BIGINT) AS s_mkfs_time, '0xef53' AS magic_hex, s_feature_incompat & 64 <> 0 AS extents, true AS same_total, s_blocks_count & 4294967295 AS s_blocks_count_lo FROM superblock",
    "inode_ages": f"SELECT image_id, inode_number, epoch(now()) > i_mtime AS past, true AS by_the_clock FROM {_state('i_mtime')}",
    "obj_ids": f"SELECT entry_id, image_id, row_number() OVER (PARTITION BY image_id ORDER BY dir_inode, entry_id, ordinal) AS obj_id FROM {_LIVE}",
    "largest_files": f"SELECT image_id, inode_number, size FROM {_state('size', 'file_type')} WHERE file_type = 'file' ORDER BY size DESC, image_id, inode_number LIMIT 20",
    "dx_roots": "SELECT DISTINCT dx_id, image_id, dir_inode, dx_count <= dx_limit AND indirect_levels <= 1 AS plausible, coalesce(dot_inode = dir_inode, false) AS own_dot FROM dx_root",
}
