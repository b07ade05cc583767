"""The journal of an image as relations: its superblock, its blocks by kind, and the blocks that descriptors and revocations name.

Journal blocks are big-endian and lie in the journal inode's own blocks (hidden inode 8 unless the superblock names another). A block without the journal's magic number is data.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions import decode as D
from blockloom.functions import layout
from blockloom.sources.extimage import read_ranges

KEY = ("image_id", "inode_number")


def _blocks(superblocks: DataFrame, inodes: DataFrame, runs: DataFrame, master_offset: int, first_only: bool) -> DataFrame:
    """(image_id, logical_block, content) of the journal inodes."""
    own = superblocks.where("s_journal_inum > 0").select("image_id", F.col("s_journal_inum").alias("inode_number"))
    journals = inodes.join(own, list(KEY)).select(*KEY, "image_path", "block_size")
    kept = runs.where("logical = 0") if first_only else runs
    n = F.lit(1).cast("bigint") if first_only else F.col("n")
    placed = kept.join(journals, list(KEY)).select(*KEY, "image_path", "block_size", "logical", "physical", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("k"))
    wanted = placed.select("image_id", "image_path", (F.col("logical") + F.col("k")).alias("logical_block"), ((F.col("physical") + F.col("k")) * F.col("block_size")).alias("byte_at"), F.col("block_size").cast("bigint").alias("byte_len"))
    return read_ranges(wanted, master_offset).select("image_id", "logical_block", "content")


def journal_superblock(superblocks: DataFrame, inodes: DataFrame, runs: DataFrame, master_offset: int = 0) -> DataFrame:
    """One row per image with a journal; ``start`` 0 means that it is clean."""
    first = _blocks(superblocks, inodes, runs, master_offset, True).where(D.be("content", 0, 4) == layout.JOURNAL_MAGIC)
    fields = [D.be("content", at, w).alias(n) for n, at, w in layout.JOURNAL_SUPERBLOCK]
    return first.select("image_id", *fields, D.uuid_text(D.raw("content", 0x30, 16)).alias("uuid_str"))


_RECORDS = "image_id string, journal_block bigint, kind string, sequence bigint, seconds bigint, ordinal int, fs_block bigint"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in _RECORDS.split(", ")]
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    for batch in batches:
        rows: list[tuple] = []
        for image, at, data in zip(*(batch.column(c).to_pylist() for c in ("image_id", "logical_block", "content"))):
            magic, kind, sequence = struct.unpack_from(">III", data)
            if magic != layout.JOURNAL_MAGIC or kind not in layout.JOURNAL_KINDS:
                continue
            name = layout.JOURNAL_KINDS[kind]
            if name == "commit":
                rows.append((image, at, name, sequence, struct.unpack_from(">Q", data, 0x30)[0], 0, None))
            elif name == "descriptor":
                place, k = 12, 0
                while place + 8 <= len(data):
                    block, _, flags = struct.unpack_from(">IHH", data, place)
                    rows.append((image, at, name, sequence, None, k, block))
                    k += 1
                    place += 8 + (0 if flags & 2 else 16)
                    if flags & 8:
                        break
            elif name == "revoke":
                end = min(len(data), struct.unpack_from(">I", data, 12)[0])
                rows += [(image, at, name, sequence, None, k, struct.unpack_from(">I", data, p)[0]) for k, p in enumerate(range(16, end - 3, 4))]
            else:
                rows.append((image, at, name, sequence, None, 0, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)


def journal_record(superblocks: DataFrame, inodes: DataFrame, runs: DataFrame, master_offset: int = 0) -> DataFrame:
    """(image_id, journal_block, kind, sequence, seconds, ordinal, fs_block): a row per superblock and commit, and per block that a descriptor or revocation names (32-bit tags, as without checksums)."""
    return _blocks(superblocks, inodes, runs, master_offset, False).mapInArrow(_parse, _RECORDS)
