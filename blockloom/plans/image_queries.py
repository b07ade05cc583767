"""Queries over images that are written from the tables, checked against SQL over the tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.api import ImageSet
from blockloom.operators import files as FL
from blockloom.operators import metadata as M
from blockloom.session import read_table, shared_dir
from blockloom.sources.imagewriter import Shape, write_images

_made: dict[tuple[str, str], ImageSet] = {}


def image_set(spark: SparkSession, d: str) -> ImageSet:
    """Images of the page texts of a data folder, written once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _made:
        folder = f"{shared_dir(spark).rstrip('/')}/blockloom-images/{hashlib.md5('|'.join(key).encode()).hexdigest()}"
        docs = read_table(spark, d, "documents", "doc_id", "lang", "text").where("text is not null").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.*")
        rows = docs.select(
            F.col("doc_id").alias("key"), F.coalesce("lang", F.lit("none")).alias("dir"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content")
        )
        write_images(rows, folder).collect()  # a row an image
        _made[key] = ImageSet(spark, folder)
    return _made[key]


def files_listing(spark: SparkSession, d: str) -> DataFrame:
    return image_set(spark, d).files.select("full_path", "size", "i_mode", "file_type_str")


def file_contents(spark: SparkSession, d: str) -> DataFrame:
    return image_set(spark, d).file_content.select("full_path", F.sha2("content", 256).alias("digest"))


def directory_children(spark: SparkSession, d: str) -> DataFrame:
    return image_set(spark, d).get_directory_contents("/").select("full_path", "file_type_str").distinct()


def dir_usage(spark: SparkSession, d: str) -> DataFrame:
    return image_set(spark, d).files.groupBy("parent_path").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def slack_by_file(spark: SparkSession, d: str) -> DataFrame:
    s = image_set(spark, d)
    return FL.slack(s.file_part, s.offset, content=False).select("full_path", "slack_size")


def range_reads(spark: SparkSession, d: str) -> DataFrame:
    s = image_set(spark, d)
    return FL.range_read(s.files, s.file_part, 100, 100, s.offset).select("full_path", F.hex("content").alias("bytes_hex"))


def file_parts_total(spark: SparkSession, d: str) -> DataFrame:
    parts = image_set(spark, d).file_part
    return parts.groupBy("full_path").agg(F.sum("data_len").alias("n_bytes"), F.max("running_end").alias("last_end"))


def inodes_by_type(spark: SparkSession, d: str) -> DataFrame:
    s = image_set(spark, d)
    return s.allocated_inodes.where("file_type = 'file'").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def free_block_ranges(spark: SparkSession, d: str) -> DataFrame:
    return image_set(spark, d).unallocated_block_ranges


def block_groups(spark: SparkSession, d: str) -> DataFrame:
    """Per image: whether runs of bits, rows of bits and descriptors agree about every group, free ranges and totals about the image, and groups about its blocks."""
    s = kit(spark, d)
    key = ["image_id", "group_number"]
    rows = M.group_usage(s.block).withColumnsRenamed({"allocated": "_a", "unallocated": "_u"})
    both = s.group_usage.join(rows, key).join(s.group_desc.select(*key, "free_blocks", "number_of_blocks", "block_uninit"), key)
    per = both.groupBy("image_id").agg(
        F.bool_and((F.col("allocated") == F.col("_a")) & (F.col("unallocated") == F.col("_u"))).alias("runs_agree"), F.bool_and(F.col("unallocated") == F.col("free_blocks")).alias("descriptors_agree"),
        F.bool_and(F.col("allocated") + F.col("unallocated") == F.col("number_of_blocks")).alias("covered"), F.sum("unallocated").alias("_free"), F.sum("number_of_blocks").alias("_all"),
    )
    ranges = s.unallocated_block_ranges.groupBy("image_id").agg(F.sum("n").alias("_n"))
    single = s.unallocated_blocks.groupBy("image_id").agg(F.count("*").alias("_k"))
    c = s.counts.select("image_id", "number_of_blocks", "number_of_unallocated_blocks", "number_of_allocated_blocks")
    own = s.superblock.select("image_id", "s_first_data_block")
    joined = per.join(ranges, "image_id").join(single, "image_id").join(c, "image_id").join(own, "image_id")
    return joined.select(
        "image_id", "runs_agree", "descriptors_agree", "covered", ((F.col("_n") == F.col("_free")) & (F.col("_k") == F.col("_free"))).alias("ranges_agree"),
        ((F.col("number_of_unallocated_blocks") == F.col("_free")) & (F.col("number_of_blocks") - F.col("s_first_data_block") == F.col("_all")) & (F.col("number_of_allocated_blocks") == F.col("_all") - F.col("_free"))).alias("totals_agree"),
    )


def one_group(spark: SparkSession, d: str) -> DataFrame:
    """Blocks and inodes of group 0 alone, by a filter that reaches the source."""
    s = kit(spark, d)
    blocks = s.block.where("group_number = 0").groupBy("image_id").agg(F.count("*").alias("_b"), F.min("block_number").alias("first_block"))
    free = s.unallocated_inodes.where("group_number = 0").groupBy("image_id").agg(F.bool_and("zeroed").alias("free_are_zeroed"))
    desc = s.group_desc.where("group_number = 0").select("image_id", "number_of_blocks", "starting_block")
    return blocks.join(free, "image_id", "left").join(desc, "image_id").select("image_id", "first_block", (F.col("_b") == F.col("number_of_blocks")).alias("whole"), (F.col("first_block") == F.col("starting_block")).alias("starts_there"), F.coalesce("free_are_zeroed", F.lit(True)).alias("free_are_zeroed"))


def kit_journal(spark: SparkSession, d: str) -> DataFrame:
    return kit(spark, d).journal.select("image_id", "version", "block_size", "length", "sequence", "start", "uuid_str")


def kit_journal_records(spark: SparkSession, d: str) -> DataFrame:
    return kit(spark, d).journal_record


def kit_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Extent nodes outside inodes and how many of them have the right checksum."""
    return kit(spark, d).extent_checksum.groupBy("image_id").agg(F.count("*").alias("n_nodes"), F.count_if("valid").alias("n_valid"))


def kit_hexdump(spark: SparkSession, d: str) -> DataFrame:
    """The magic number in a dump of block 1, which is the superblock where blocks have 1 KiB."""
    s = kit(spark, d)
    small = s.superblock.where("block_size = 1024").select("image_id")
    return s.hexdump_block(1).join(small, "image_id").select("image_id", F.substring("hex", 0x38 * 2 + 1, 4).alias("magic"), F.length("hex").alias("n"))


def image_status(spark: SparkSession, d: str) -> DataFrame:
    return kit(spark, d).status.select("image_id", F.col("error").isNull().alias("readable"))


def image_counts(spark: SparkSession, d: str) -> DataFrame:
    """Totals per image; free inodes are zeroed ones in images of the writer."""
    c = kit(spark, d).counts
    return c.select(
        "image_id", "number_of_allocated_inodes", (F.col("number_of_inodes") == F.col("number_of_allocated_inodes") + F.col("number_of_unallocated_inodes")).alias("inodes_add_up"),
        (F.col("number_of_zeroed_inodes") == F.col("number_of_unallocated_inodes")).alias("free_are_zeroed"),
    )


def entry_order(spark: SparkSession, d: str) -> DataFrame:
    """Entries per image, and their walk numbers: from 1 without a gap."""
    return kit(spark, d).entry.groupBy("image_id").agg(F.count("*").alias("n"), F.min("obj_id").alias("first"), F.max("obj_id").alias("last"), F.countDistinct("obj_id").alias("different"))


def extent_leaves(spark: SparkSession, d: str) -> DataFrame:
    return image_set(spark, d).extent.groupBy("depth").agg(F.count("*").alias("n_extents"), F.sum("ee_len").alias("n_blocks"))


# -- images with everything in them: nested and hashed directories, links, holes, deep trees, deleted and unreadable names --------------

SHAPES = (Shape(1024, 2048, fanout=2, fragment=1, hashed=True, journal=True), Shape(4096, 4096, fanout=2, inode_size=256, wide=True, hashed=True))
#: Bytes of the holes of French pages and, beyond the reach of two levels of pointers, of undetermined ones.
HOLE, FAR_HOLE = 12_288, 73_400_320


def _kit_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", "doc_id", "text", "lang", "source", "n_chars", "page_no", "n_columns").distinct()
    lang, page, n = F.coalesce("lang", F.lit("none")), F.coalesce("page_no", F.lit(0)), F.coalesce("n_chars", F.lit(0))
    kind = F.when(F.col("text").isNull(), "deleted").when(F.col("n_columns").isNull() & (F.col("text") != ""), "symlink").otherwise("file")
    hole = F.when(lang == "fr", HOLE).when(lang == "und", FAR_HOLE).otherwise(0)
    text = F.when(F.col("kind") == "symlink", F.concat(F.lit("to-"), F.left("text", F.lit(20) + 10 * page))).otherwise(F.coalesce("text", F.lit("")))
    label = F.lpad(F.col("doc_id").cast("string"), 10, "0")
    rows = docs.withColumn("kind", kind).select(
        F.col("doc_id").alias("key"),
        F.concat_ws("/", lang, F.concat(F.lit("p"), page.cast("string")), F.regexp_replace(F.coalesce("source", F.lit("none")), "/", "_")).alias("dir"),
        F.when(F.col("text") == "", F.concat(F.unhex(F.lit("FF")), F.concat(label, F.lit(".bin")).cast("binary"))).otherwise(F.concat(label, F.lit(".txt")).cast("binary")).alias("name"),
        text.cast("binary").alias("content"), "kind", (F.lit(0o100000) + n % 512 + 512 * (page % 8)).cast("int").alias("mode"), page.alias("uid"), (n % 60_000).cast("int").alias("gid"),
        (F.lit(1_500_000_000) + n).alias("mtime"), F.when(F.col("kind") == "file", hole).otherwise(0).cast("bigint").alias("hole"), (n % 2 == 0).alias("extents"),
        F.when((F.col("kind") == "file") & (page <= 3), F.concat(F.lit("links/"), lang)).alias("link_dir"),
    )
    return rows


def kit(spark: SparkSession, d: str) -> ImageSet:
    """Images of all pages in two shapes, written once a session."""
    key = (spark.sparkContext.applicationId, d, "kit")
    if key not in _made:
        folder = f"{shared_dir(spark).rstrip('/')}/blockloom-images/{hashlib.md5('|'.join(key).encode()).hexdigest()}"
        write_images(_kit_rows(spark, d), folder, shapes=SHAPES).collect()  # a row an image
        _made[key] = ImageSet(spark, folder)
    return _made[key]


def _kit_files(spark: SparkSession, d: str) -> tuple[ImageSet, DataFrame]:
    s = kit(spark, d)
    return s, s.files


def kit_entries(spark: SparkSession, d: str) -> DataFrame:
    """The whole walk: every entry of every directory at any depth."""
    e = kit(spark, d).entry
    own = lambda c: F.when(F.col("file_type_str") != "directory", F.col(c)).alias(c)
    return e.select("image_id", "full_path", "parent_path", "file_type_str", *[own(c) for c in ("size", "i_mode", "i_uid", "i_gid", "i_links_count", "i_mtime")], "block_size")


def kit_permissions(spark: SparkSession, d: str) -> DataFrame:
    p = lambda *path: F.col(".".join(("perm", *path))).alias("_".join(path))
    flat = [p(w, a) for w in ("user", "group", "other") for a in ("read", "write", "execute")] + [p(n) for n in ("setuid", "setgid", "sticky")]
    return kit(spark, d).files.select("image_id", "full_path", *flat)


def kit_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents by pieces of 4 MiB, holes included."""
    s = kit(spark, d)
    return FL.file_pieces(s.files, s.file_part, s.offset).select("image_id", "full_path", "piece", "piece_start", "n_bytes", F.sha2("content", 256).alias("digest"))


def kit_first_bytes(spark: SparkSession, d: str) -> DataFrame:
    s = kit(spark, d)
    return FL.file_content(s.files, s.file_part, s.offset, limit=64).select("image_id", "full_path", F.hex("content").alias("bytes_hex"))


def kit_far_reads(spark: SparkSession, d: str) -> DataFrame:
    """Bytes around the end of the far holes, behind three levels of pointers."""
    s = kit(spark, d)
    return FL.range_read(s.files, s.file_part, FAR_HOLE - 8, 40, s.offset).select("image_id", "full_path", F.hex("content").alias("bytes_hex"))


def kit_parts(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of data and of holes of each file."""
    part = kit(spark, d).file_part.groupBy("image_id", "full_path")
    return part.agg(F.sum(F.when(~F.col("sparse"), F.col("data_len")).otherwise(0)).alias("n_data"), F.sum(F.when(F.col("sparse"), F.col("data_len")).otherwise(0)).alias("n_hole"), F.max("running_end").alias("last_end"))


def kit_slack(spark: SparkSession, d: str) -> DataFrame:
    s = kit(spark, d)
    return FL.slack(s.file_part, s.offset).select("image_id", "full_path", "slack_size", F.hex("content").alias("bytes_hex"))


def kit_links(spark: SparkSession, d: str) -> DataFrame:
    """Inodes with several names."""
    named = kit(spark, d).files.groupBy("image_id", "inode").agg(F.array_join(F.sort_array(F.collect_list("full_path")), " | ").alias("paths"), F.count("*").alias("n"), F.max("i_links_count").alias("links"))
    return named.where("n > 1").select("image_id", "paths", "n", "links")


def kit_symlinks(spark: SparkSession, d: str) -> DataFrame:
    """Targets kept in the inode."""
    return kit(spark, d).allocated_inodes.where("file_type = 'symlink'").select("image_id", "size", "symlink_target")


def kit_deleted(spark: SparkSession, d: str) -> DataFrame:
    return kit(spark, d).dirent.where("inode = 0").select("image_id", "name", "name_len", "file_type_str")


def kit_unreadable_names(spark: SparkSession, d: str) -> DataFrame:
    return kit(spark, d).dirent.where("name is null").select("image_id", F.lower(F.hex("name_raw")).alias("name_hex"), "name_len")


def kit_hashed(spark: SparkSession, d: str) -> DataFrame:
    """Index entries of the hashed directories of links."""
    s = kit(spark, d)
    dirs = s.directories.where("parent_path = '/links'").select("image_id", F.col("inode").alias("dir_inode"), "full_path")
    dx = s.dx_entry.join(dirs, ["image_id", "dir_inode"])
    return dx.groupBy("image_id", "full_path").agg(F.count("*").alias("n_leaves"), F.max("dx_count").cast("bigint").alias("dx_count"), F.count_if(F.col("dot_inode") == F.col("dir_inode")).alias("n_own"), F.max("block").alias("last_block"))


def kit_extents(spark: SparkSession, d: str) -> DataFrame:
    """Extents, blocks and leaf nodes of the extent trees."""
    e = kit(spark, d).extent
    return e.groupBy("image_id").agg(F.count("*").alias("n_extents"), F.sum("ee_len").cast("bigint").alias("n_blocks"), F.countDistinct("inode_number", "node_block").alias("n_leaf_nodes"), F.max("ee_block").alias("last_logical"))


def kit_mapped_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of files and long symbolic links, by either way of mapping."""
    s = kit(spark, d)
    own = s.entry.where("file_type_str <> 'directory'").select("image_id", F.col("inode").alias("inode_number"), "uses_extents").distinct()
    return s.inode_block.join(own, ["image_id", "inode_number"]).groupBy("image_id", "uses_extents").agg(F.count("*").alias("n_blocks"), F.countDistinct("physical_block").alias("n_physical"), F.max("logical_block").alias("last_logical"))


def kit_superblocks(spark: SparkSession, d: str) -> DataFrame:
    sb = kit(spark, d).superblock
    return sb.select(
        "image_id", "block_size", "s_volume_name", F.col("s_first_ino").cast("int").alias("first_ino"), F.col("s_inode_size").cast("int").alias("inode_size"), "magic_hex", "state_cleanly_unmounted",
        F.col("incompat.FILETYPE").alias("filetype"), F.col("incompat.`64BITS`").alias("bits64"), F.col("compat.DIR_INDEX").alias("dir_index"), F.col("ro_compat.BIGALLOC").alias("bigalloc"),
        F.col("s_blocks_per_group").cast("int").alias("per_group"), F.col("s_first_data_block").cast("int").alias("first_block"), F.size("s_jnl_blocks").alias("n_journal_words"),
        F.array_join(F.col("s_hash_seed").cast("array<string>"), "").alias("hash_seed"), F.col("compat.HAS_JOURNAL").alias("has_journal"),
    )


def kit_allocated_inodes(spark: SparkSession, d: str) -> DataFrame:
    """Inodes in use as bitmaps, inodes, descriptors and totals have them, and directories."""
    s = kit(spark, d)
    bits = s.inode_bitmap.where("allocated").groupBy("image_id").agg(F.count("*").alias("n_bits"))
    seen = s.allocated_inodes.groupBy("image_id").agg(F.count("*").alias("n_inodes"), F.count_if(F.col("file_type") == "directory").alias("n_dirs"), F.count_if("zeroed").alias("n_zeroed"))
    desc = s.group_desc.groupBy("image_id").agg(F.sum(F.col("inodes_per_group") - F.col("free_inodes")).alias("n_desc"), F.sum("used_dirs").alias("n_used_dirs"))
    own = s.counts.select("image_id", F.col("number_of_allocated_inodes").alias("n_counts"), (F.col("number_of_inodes") - F.col("number_of_unallocated_inodes")).alias("n_super"))
    return bits.join(seen, "image_id").join(desc, "image_id").join(own, "image_id")


def kit_inode_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The root directory and the first file by number; where each lies in its group."""
    s = kit(spark, d)
    group = M.inode_group(F.col("inode_number"), F.col("inodes_per_group"))
    desc = s.group_desc.select("image_id", "group_number", "inodes_per_group", "starting_inode", "table_inode_bytes")
    rows = s.get_inode(2).join(desc, ["image_id", "group_number"]).join(s.superblock.select("image_id", "s_inode_size"), "image_id")
    at = F.col("table_inode_bytes") + (F.col("inode_number") - F.col("starting_inode")) * F.col("s_inode_size")
    return rows.select("image_id", "inode_number", "file_type", "allocated", (group == F.col("group_number")).alias("in_group"), (at == F.col("byte_start")).alias("in_place"), "i_links_count")


def kit_block_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The last block of group 1 by number and by group; every group's bitmap covers its blocks."""
    s = kit(spark, d)
    per = s.superblock.select("image_id", "s_first_data_block", "s_blocks_per_group")
    group = M.block_group(F.col("block_number"), F.col("s_first_data_block"), F.col("s_blocks_per_group"))
    return s.block.join(per, "image_id").groupBy("image_id").agg(F.count_if(group == F.col("group_number")).alias("n_right"), F.count("*").alias("n_all")).join(
        s.superblock.select("image_id", F.col("blocks_count") - F.col("s_first_data_block")), "image_id"
    ).select("image_id", (F.col("n_right") == F.col("n_all")).alias("all_right"), (F.col("n_all") == F.col("(blocks_count - s_first_data_block)")).alias("all_there"))


def kit_children(spark: SparkSession, d: str) -> DataFrame:
    """One directory's children, and what the lookups by path say about them."""
    s = kit(spark, d)
    return s.get_directory_contents("/links").select("image_id", "full_path", "file_type_str", F.col("name").alias("name"))


def kit_handle(spark: SparkSession, d: str) -> DataFrame:
    """Seeks and reads of a handle, and lookups by path, on the first regular file with a readable name."""
    s = kit(spark, d)
    first = s.files.where("name is not null and size >= 40 and i_uid > 3").orderBy("full_path", "image_id").select("image_id", "full_path").first()
    rows = []
    if first is not None:
        image, path = first
        with s.handle(path, image) as h:
            end = h.seek(-10, 2)
            last = h.read()
            h.seek(5)
            part = h.read(7)
            h.seek(-2, 1)
            rows.append((image, path, len(h), end, last.hex(), part.hex(), h.read(4).hex(), h.tell(), s.is_file(path, image), s.is_directory("/links", image), s.get_file_size(path, image), s.open(path[1:], image, 8).hex(), s.get_file_permissions(path, image)["user"]["read"]))
    return spark.createDataFrame(rows, "image_id string, full_path string, n bigint, at bigint, last string, part string, again string, tell bigint, is_file boolean, is_dir boolean, size bigint, head string, user_read boolean")


QUERIES = {
    f.__name__: f
    for f in (
        files_listing, file_contents, directory_children, dir_usage, slack_by_file, range_reads, file_parts_total, inodes_by_type, free_block_ranges, block_groups, one_group,
        image_counts, entry_order, extent_leaves, kit_entries, kit_permissions, kit_contents, kit_first_bytes, kit_far_reads, kit_parts, kit_slack, kit_links, kit_symlinks, kit_deleted,
        kit_unreadable_names, kit_hashed, kit_extents, kit_mapped_blocks, kit_superblocks, kit_allocated_inodes, kit_inode_lookup, kit_block_lookup, kit_children, kit_handle, kit_journal, kit_journal_records, kit_checksums,
        kit_hexdump, image_status,
    )
}

_KIT = f"""
WITH k0 AS (SELECT DISTINCT doc_id, text, coalesce(lang, 'none') AS lang, replace(coalesce(source, 'none'), '/', '_') AS src, coalesce(n_chars, 0) AS n, coalesce(page_no, 0) AS page, n_columns FROM documents),
k1 AS (SELECT *, CASE WHEN text IS NULL THEN 'deleted' WHEN n_columns IS NULL AND text <> '' THEN 'symlink' ELSE 'file' END AS kind FROM k0),
k2 AS (SELECT *, CASE WHEN kind = 'symlink' THEN 'to-' || left(text, 20 + 10 * page) ELSE coalesce(text, '') END AS body,
  CAST(CASE WHEN kind <> 'file' THEN 0 WHEN lang = 'fr' THEN {HOLE} WHEN lang = 'und' THEN {FAR_HOLE} ELSE 0 END AS BIGINT) AS hole,
  lang || '/p' || page || '/' || src AS dir, CASE WHEN text = '' THEN '0xff' || lower(hex(encode(lpad(doc_id || '', 10, '0') || '.bin'))) ELSE lpad(doc_id || '', 10, '0') || '.txt' END AS label,
  CASE WHEN kind = 'file' AND page <= 3 THEN 'links/' || lang END AS link_dir FROM k1),
k3 AS (SELECT *, CAST(octet_length(encode(body)) AS BIGINT) AS len FROM k2),
k4 AS (SELECT *, doc_id % greatest(2, CAST(ceil((SELECT sum(len) FROM k3) / 4e6) AS BIGINT)) AS v FROM k3),
kit AS (SELECT *, CASE WHEN bs = 1024 THEN nb ELSE (nb + 2) // 3 END AS ne FROM (SELECT *, printf('vol-%06d.img', v) AS image_id, CASE WHEN v % 2 = 0 THEN 1024 ELSE 4096 END AS bs, hole + len AS size, (len + CASE WHEN v % 2 = 0 THEN 1023 ELSE 4095 END) // CASE WHEN v % 2 = 0 THEN 1024 ELSE 4096 END AS nb,
  len > 0 AND n % 2 = 0 AND NOT (kind = 'symlink' AND len < 60) AS tree, kind = 'symlink' AND len < 60 AS short FROM k4)),
named AS (SELECT *, '/' || dir AS parent_path, '/' || dir || '/' || label AS full_path FROM kit WHERE kind <> 'deleted' UNION ALL SELECT *, '/' || link_dir, '/' || link_dir || '/' || label FROM kit WHERE link_dir IS NOT NULL),
used AS (SELECT image_id, bs, dir FROM kit UNION SELECT image_id, bs, link_dir FROM kit WHERE link_dir IS NOT NULL),
folders AS (SELECT DISTINCT image_id, bs, array_to_string(list_slice(string_split(dir, '/'), 1, d), '/') AS dir FROM used, range(1, 4) r(d) WHERE d <= len(string_split(dir, '/'))),
files AS (SELECT * FROM named WHERE kind = 'file'),
images AS (SELECT DISTINCT image_id, v, bs FROM kit)
"""
_PERM = ", ".join(f"((32768 + n % 512 + 512 * (page % 8)) & {m}) <> 0 AS {w}_{a}" for w, rights in (("user", (256, 128, 64)), ("group", (32, 16, 8)), ("other", (4, 2, 1))) for a, m in zip(("read", "write", "execute"), rights))
_SPECIAL = ", ".join(f"((32768 + n % 512 + 512 * (page % 8)) & {m}) <> 0 AS {n}" for n, m in (("setuid", 2048), ("setgid", 1024), ("sticky", 512)))
_HEX = "hex(encode(body))"

_F = "(SELECT DISTINCT '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' AS full_path, '/' || coalesce(lang, 'none') AS dir, CAST(octet_length(encode(text)) AS BIGINT) AS size, text FROM documents WHERE text IS NOT NULL)"
SQL = {
    "files_listing": f"SELECT full_path, size, CAST(33188 AS BIGINT) AS i_mode, 'file' AS file_type_str FROM {_F}",
    "file_contents": f"SELECT full_path, sha256(text) AS digest FROM {_F}",
    "directory_children": f"SELECT DISTINCT dir AS full_path, 'directory' AS file_type_str FROM {_F}",
    "dir_usage": f"SELECT dir AS parent_path, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM {_F} GROUP BY dir",
    "slack_by_file": f"SELECT full_path, (1024 - size % 1024) % 1024 AS slack_size FROM {_F} WHERE size > 0",
    "range_reads": f"SELECT full_path, substr(hex(encode(text)), 201, 200) AS bytes_hex FROM {_F}",
    "file_parts_total": f"SELECT full_path, size AS n_bytes, size AS last_end FROM {_F} WHERE size > 0",
    "inodes_by_type": f"SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM {_F}",
    "kit_entries": _KIT
    + """SELECT image_id, full_path, parent_path, kind AS file_type_str, size, CAST(CASE kind WHEN 'symlink' THEN 41471 ELSE 32768 + n % 512 + 512 * (page % 8) END AS BIGINT) AS i_mode, CAST(page AS BIGINT) AS i_uid,
  CAST(n % 60000 AS BIGINT) AS i_gid, CAST(CASE WHEN link_dir IS NULL THEN 1 ELSE 2 END AS BIGINT) AS i_links_count, 1500000000 + n AS i_mtime, bs AS block_size FROM named
UNION ALL SELECT image_id, '/' || dir, CASE WHEN contains(dir, '/') THEN '/' || regexp_replace(dir, '/[^/]*$', '') ELSE '' END, 'directory', NULL, NULL, NULL, NULL, NULL, NULL, bs FROM folders""",
    "kit_permissions": _KIT + f"SELECT image_id, full_path, {_PERM}, {_SPECIAL} FROM files",
    "kit_contents": _KIT
    + """SELECT image_id, full_path, p AS piece, p * 4194304 AS piece_start, least(4194304, size - p * 4194304) AS n_bytes,
  CASE WHEN len > 0 AND p = hole // 4194304 THEN sha256(repeat(chr(0), hole % 4194304) || body) END AS digest FROM files, range(0, 40) r(p) WHERE p * 4194304 < size""",
    "kit_first_bytes": _KIT + f"SELECT image_id, full_path, CASE WHEN hole > 0 THEN repeat('00', 64) ELSE left({_HEX}, 128) END AS bytes_hex FROM files",
    "kit_far_reads": _KIT + f"SELECT image_id, full_path, CASE WHEN hole = {FAR_HOLE} THEN repeat('00', 8) || left({_HEX}, 64) ELSE '' END AS bytes_hex FROM files",
    "kit_parts": _KIT + "SELECT image_id, full_path, len AS n_data, hole AS n_hole, size AS last_end FROM files WHERE size > 0",
    "kit_slack": _KIT + "SELECT image_id, full_path, (bs - size % bs) % bs AS slack_size, repeat('00', CAST((bs - size % bs) % bs AS INTEGER)) AS bytes_hex FROM files WHERE size > 0",
    "kit_links": _KIT + "SELECT image_id, least('/' || dir || '/' || label, '/' || link_dir || '/' || label) || ' | ' || greatest('/' || dir || '/' || label, '/' || link_dir || '/' || label) AS paths, CAST(2 AS BIGINT) AS n, CAST(2 AS BIGINT) AS links FROM kit WHERE link_dir IS NOT NULL",
    "kit_symlinks": _KIT + "SELECT image_id, size, CASE WHEN short THEN body END AS symlink_target FROM kit WHERE kind = 'symlink'",
    "kit_deleted": _KIT + "SELECT image_id, label AS name, CAST(octet_length(encode(label)) AS INTEGER) AS name_len, 'file' AS file_type_str FROM kit WHERE kind = 'deleted'",
    "kit_unreadable_names": _KIT + "SELECT image_id, substr(label, 3) AS name_hex, CAST((length(label) - 2) // 2 AS INTEGER) AS name_len FROM named WHERE text = ''",
    "kit_hashed": _KIT
    + """SELECT image_id, '/' || link_dir AS full_path, leaves AS n_leaves, leaves AS dx_count, leaves AS n_own, leaves AS last_block FROM (
  SELECT image_id, link_dir, bs, CAST((count(*) + bs // 24 - 1) // (bs // 24) AS BIGINT) AS leaves FROM kit WHERE link_dir IS NOT NULL GROUP BY image_id, link_dir, bs) WHERE leaves BETWEEN 2 AND (bs - 32) // 8""",
    "kit_extents": _KIT
    + """SELECT image_id, CAST(sum(ne) AS BIGINT) AS n_extents, CAST(sum(nb) AS BIGINT) AS n_blocks, CAST(sum(CASE WHEN ne <= 4 THEN 1 ELSE (ne + 1) // 2 END) AS BIGINT) AS n_leaf_nodes,
  max(hole // bs + CASE WHEN bs = 1024 THEN nb - 1 ELSE (nb - 1) // 3 * 3 END) AS last_logical FROM kit WHERE tree GROUP BY image_id""",
    "kit_mapped_blocks": _KIT
    + """SELECT image_id, n % 2 = 0 AS uses_extents, CAST(sum(nb) AS BIGINT) AS n_blocks, CAST(sum(nb) AS BIGINT) AS n_physical, max(hole // bs + nb - 1) AS last_logical
  FROM kit WHERE kind <> 'deleted' AND len > 0 AND NOT short GROUP BY ALL""",
    "kit_superblocks": _KIT
    + """SELECT image_id, bs AS block_size, printf('volume-%06d', v) AS s_volume_name, 11 AS first_ino, CASE WHEN bs = 1024 THEN 128 ELSE 256 END AS inode_size, '0xef53' AS magic_hex, true AS state_cleanly_unmounted, true AS filetype,
  bs = 4096 AS bits64, true AS dir_index, false AS bigalloc, CASE WHEN bs = 1024 THEN 2048 ELSE 4096 END AS per_group, CASE WHEN bs = 1024 THEN 1 ELSE 0 END AS first_block, 17 AS n_journal_words,
  (v + 1) || '' || (v + 2) || (v + 3) || (v + 4) AS hash_seed, bs = 1024 AS has_journal FROM images""",
    "kit_allocated_inodes": _KIT
    + """SELECT i.image_id, 10 + f + d AS n_bits, 10 + f + d AS n_inodes, 1 + d AS n_dirs, CAST(0 AS BIGINT) AS n_zeroed, 10 + f + d AS n_desc, 1 + d AS n_used_dirs, 10 + f + d AS n_counts, 10 + f + d AS n_super
  FROM images i JOIN (SELECT image_id, count(*) FILTER (kind <> 'deleted') AS f FROM kit GROUP BY 1) a ON a.image_id = i.image_id JOIN (SELECT image_id, count(*) AS d FROM folders GROUP BY 1) b ON b.image_id = i.image_id""",
    "kit_inode_lookup": _KIT
    + """SELECT image_id, CAST(2 AS BIGINT) AS inode_number, 'directory' AS file_type, true AS allocated, true AS in_group, true AS in_place, 2 + count(*) AS i_links_count FROM folders WHERE NOT contains(dir, '/') GROUP BY image_id""",
    "kit_block_lookup": _KIT + "SELECT image_id, true AS all_right, true AS all_there FROM images",
    "kit_children": _KIT + "SELECT DISTINCT image_id, '/' || link_dir AS full_path, 'directory' AS file_type_str, lang AS name FROM kit WHERE link_dir IS NOT NULL",
    "kit_handle": _KIT
    + f"""SELECT image_id, full_path, size AS n, size - 10 AS at, lower(right({_HEX}, 20)) AS last, lower(substr(h, 11, 14)) AS part, lower(substr(h, 21, 8)) AS again, CAST(14 AS BIGINT) AS tell, true AS is_file, true AS is_dir, size,
  lower(left(h, 16)) AS head, (n % 512) & 256 <> 0 AS user_read
FROM (SELECT *, CASE WHEN hole > 0 THEN repeat('00', 64) ELSE {_HEX} END AS h FROM files WHERE text <> '' AND size >= 40 AND page > 3 ORDER BY full_path, image_id LIMIT 1)""",
    "block_groups": _KIT + "SELECT image_id, true AS runs_agree, true AS descriptors_agree, true AS covered, true AS ranges_agree, true AS totals_agree FROM images",
    "one_group": _KIT + "SELECT image_id, CAST(CASE WHEN bs = 1024 THEN 1 ELSE 0 END AS BIGINT) AS first_block, true AS whole, true AS starts_there, true AS free_are_zeroed FROM images",
    "kit_journal": _KIT
    + "SELECT image_id, CAST(4 AS BIGINT) AS version, CAST(1024 AS BIGINT) AS block_size, CAST(6 AS BIGINT) AS length, v + 1 AS sequence, CAST(1 AS BIGINT) AS start, printf('00000000-0000-0000-0000-%012x', v) AS uuid_str FROM images WHERE bs = 1024",
    "kit_journal_records": _KIT
    + """SELECT image_id, CAST(b AS BIGINT) AS journal_block, kind, v + 1 AS sequence, CASE kind WHEN 'commit' THEN 1600000000 + v END AS seconds, k AS ordinal, f + v AS fs_block
  FROM images, (VALUES (0, 'superblock', 0, NULL), (1, 'descriptor', 0, 100), (1, 'descriptor', 1, 200), (4, 'revoke', 0, 300), (4, 'revoke', 1, 301), (5, 'commit', 0, NULL)) r(b, kind, k, f) WHERE bs = 1024""",
    "kit_checksums": _KIT
    + """, levels AS (SELECT image_id, ne AS r FROM kit WHERE tree AND bs = 1024 AND ne > 4),
deep AS (SELECT image_id, (r + 1) // 2 AS r1, ((r + 1) // 2 + 1) // 2 AS r2, (((r + 1) // 2 + 1) // 2 + 1) // 2 AS r3 FROM levels)
SELECT image_id, CAST(sum(r1 + CASE WHEN r1 > 4 THEN r2 ELSE 0 END + CASE WHEN r1 > 4 AND r2 > 4 THEN r3 ELSE 0 END) AS BIGINT) AS n_nodes,
  CAST(sum(r1 + CASE WHEN r1 > 4 THEN r2 ELSE 0 END + CASE WHEN r1 > 4 AND r2 > 4 THEN r3 ELSE 0 END) AS BIGINT) AS n_valid FROM deep GROUP BY image_id""",
    "kit_hexdump": _KIT + "SELECT image_id, '53ef' AS magic, 2048 AS n FROM images WHERE bs = 1024",
    "image_status": _KIT + "SELECT image_id, true AS readable FROM images",
    "image_counts": _KIT
    + """SELECT i.image_id, 10 + f + d AS number_of_allocated_inodes, true AS inodes_add_up, true AS free_are_zeroed
  FROM images i JOIN (SELECT image_id, count(*) FILTER (kind <> 'deleted') AS f FROM kit GROUP BY 1) a ON a.image_id = i.image_id JOIN (SELECT image_id, count(*) AS d FROM folders GROUP BY 1) b ON b.image_id = i.image_id""",
    "entry_order": _KIT
    + """SELECT image_id, n, CAST(1 AS BIGINT) AS first, n AS last, n AS different FROM (SELECT image_id, count(*) AS n FROM (SELECT image_id FROM named UNION ALL SELECT image_id FROM folders) GROUP BY image_id)""",
    "extent_leaves": """
WITH f AS (SELECT DISTINCT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, doc_id % greatest(2, CAST(ceil((SELECT sum(size) FROM f) / 4e6) AS BIGINT)) AS v FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY doc_id) AS k, (size + 1023) // 1024 AS nb FROM g)
SELECT CAST(0 AS INTEGER) AS depth, CAST(sum((nb + 2) // 3) AS BIGINT) AS n_extents, CAST(sum(nb) AS BIGINT) AS n_blocks FROM h WHERE k % 2 = 1 AND nb > 0""",
}
