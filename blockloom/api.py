"""``ImageSet``: the images under a path as relations, with the lookups a file system reader offers."""

from __future__ import annotations

import bisect
import io
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import decode as D
from blockloom.operators import files as FL
from blockloom.operators import journal as J
from blockloom.operators import metadata as M
from blockloom.session import cut
from blockloom.sources.extimage import Image, read_image


class FileHandle(io.RawIOBase):
    """A seekable, read-only file. The places of its parts are fetched once, one row per run of blocks; reads then go straight to the image, a window of ``window`` bytes at a time."""

    def __init__(self, images: ImageSet, path: str, image_id: str | None = None, window: int = 1 << 20):
        super().__init__()
        row = images._one(path, image_id, RuntimeError)
        if row["file_type_str"] != "file":
            raise RuntimeError(f"{path} is no regular file")
        self.name, self.length, self._at, self._window = path, row["size"], 0, window
        one = images.get(path, row["image_id"]).limit(1)
        parts = FL.file_part(one, images.runs).where("not sparse").select("running_start", "byte_len", "byte_start").orderBy("running_start").collect()  # a row per run of blocks of one file
        self._starts = [p["running_start"] for p in parts]
        self._parts = [tuple(p) for p in parts]
        self._image = Image(row["image_path"], images.offset)
        self._held: tuple[int, bytes] = (0, b"")

    def __len__(self) -> int:
        return self.length

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self._at, self.length)[whence]
        if at < 0:
            raise ValueError("negative position")
        self._at = at
        return at

    def _fetch(self, start: int, n: int) -> bytes:
        out = bytearray(n)
        k = max(0, bisect.bisect_right(self._starts, start) - 1)
        while k < len(self._parts) and self._parts[k][0] < start + n:
            first, size, place = self._parts[k]
            a, b = max(first, start), min(first + size, start + n)
            if a < b:
                data = self._image.read(place + a - first, b - a)
                out[a - start : a - start + len(data)] = data
            k += 1
        return bytes(out)

    def read(self, count: int | None = -1) -> bytes:
        if count is not None and count < -1:
            raise ValueError("count must not be below -1")
        left = max(0, self.length - self._at)
        n = left if count is None or count == -1 else min(count, left)
        if not n:
            return b""
        start, held = self._held
        if not (start <= self._at and self._at + n <= start + len(held)):
            if n >= self._window:
                data = self._fetch(self._at, n)
                self._at += n
                return data
            start = self._at // self._window * self._window
            size = self._at + n - start if self._at + n > start + self._window else self._window
            self._held = start, held = start, self._fetch(start, min(size, self.length - start))
        data = held[self._at - start : self._at - start + n]
        self._at += n
        return data

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class ImageSet:
    """Every attribute is a DataFrame over all images; lookups by path take ``image_id`` if there are several images.

    Paths are absolute (``/dir/file``; a missing leading slash is accepted). The root directory has no row. With ``permissive`` unreadable images
    give no rows, and ``status`` says why; else they are an error.
    """

    def __init__(self, spark: SparkSession, path: str, master_offset: int = 0, magic_ignore: bool = False, permissive: bool = False):
        self.spark, self.path, self.offset, self._ignore, self._permissive = spark, path, master_offset, magic_ignore, permissive

    def _raw(self, table: str) -> DataFrame:
        return read_image(self.spark, self.path, table, self.offset, self._ignore, self._permissive)

    @cached_property
    def superblock(self) -> DataFrame:
        return M.superblock(self._raw("superblock"))

    @cached_property
    def group_desc(self) -> DataFrame:
        return M.group_desc(self._raw("group"))

    @cached_property
    def block(self) -> DataFrame:
        return M.block(self._raw("bitmap"))

    @cached_property
    def _block_runs(self) -> DataFrame:
        return M.bit_runs(self._raw("bitmap").where("kind = 'block'"))

    @cached_property
    def status(self) -> DataFrame:
        """(image_id, image_path, n_bytes, error): every file under the path, and why it can't be read if it can't."""
        return self._raw("status")

    @cached_property
    def inode_bitmap(self) -> DataFrame:
        return M.inode_bitmap(self._raw("bitmap"))

    @cached_property
    def raw_block(self) -> DataFrame:
        return self._raw("block")

    @cached_property
    def inode(self) -> DataFrame:
        return M.inode(self._raw("inode"))

    @cached_property
    def _used(self) -> DataFrame:
        """Allocated inodes, written once: mapping, directories and files all start from them."""
        return cut(self.inode.where("allocated"))

    @cached_property
    def runs(self) -> DataFrame:
        return cut(FL.block_runs(self._used, self.offset))

    @cached_property
    def extent(self) -> DataFrame:
        return FL.extents(self._used, self.offset)

    @cached_property
    def extent_errors(self) -> DataFrame:
        return FL.extent_errors(self._used, self.offset)

    @cached_property
    def inode_block(self) -> DataFrame:
        return FL.inode_block(self._used, self.offset)

    @cached_property
    def contiguous(self) -> DataFrame:
        """Runs of blocks joined where they go on on disk."""
        return FL.contiguous(self.runs)

    @cached_property
    def hole(self) -> DataFrame:
        return FL.holes(self.runs)

    @cached_property
    def dirent(self) -> DataFrame:
        return FL.dirent(self._used, self.runs, self.offset)

    @cached_property
    def dx_entry(self) -> DataFrame:
        return FL.dx_entry(self._used, self.runs, self.offset)

    @cached_property
    def entry(self) -> DataFrame:
        return cut(FL.entry(self._used, self.dirent))

    @cached_property
    def file_part(self) -> DataFrame:
        return FL.file_part(self.entry, self.runs)

    @cached_property
    def file_content(self) -> DataFrame:
        return FL.file_content(self.entry, self.file_part, self.offset)

    @cached_property
    def file_piece(self) -> DataFrame:
        """Contents by pieces of a few MiB; for files of any size."""
        return FL.file_pieces(self.entry, self.file_part, self.offset)

    @cached_property
    def slack(self) -> DataFrame:
        return FL.slack(self.file_part, self.offset)

    @cached_property
    def journal(self) -> DataFrame:
        """Journal superblocks."""
        return J.journal_superblock(self.superblock, self._used, self.runs, self.offset)

    @cached_property
    def journal_record(self) -> DataFrame:
        return J.journal_record(self.superblock, self._used, self.runs, self.offset)

    @cached_property
    def extent_checksum(self) -> DataFrame:
        """Stored and computed checksums of extent nodes outside inodes, of images with metadata checksums."""
        return FL.extent_checksums(self._used, self.superblock, self.offset)

    # -- filters -------------------------------------------------------------------------------------

    @property
    def files(self) -> DataFrame:
        return self.entry.where("file_type_str = 'file'")

    @property
    def directories(self) -> DataFrame:
        return self.entry.where("file_type_str = 'directory'")

    @property
    def filenames(self) -> DataFrame:
        return self.files.select("image_id", "full_path")

    @property
    def allocated_inodes(self) -> DataFrame:
        return self.inode.where("allocated")

    @property
    def unallocated_inodes(self) -> DataFrame:
        return self.inode.where("not allocated")

    @property
    def zeroed_inodes(self) -> DataFrame:
        return self.inode.where("zeroed")

    @property
    def allocated_blocks(self) -> DataFrame:
        return self.block.where("allocated")

    @property
    def unallocated_blocks(self) -> DataFrame:
        return self.block.where("not allocated")

    @property
    def unallocated_block_ranges(self) -> DataFrame:
        return M.free_runs(self._block_runs)

    @property
    def group_usage(self) -> DataFrame:
        return M.run_usage(self._block_runs)

    @property
    def counts(self) -> DataFrame:
        """Totals per image; allocated ones from the group descriptors."""
        per = self.group_desc.groupBy("image_id").agg(
            F.count("*").alias("number_of_block_groups"),
            F.sum(F.col("inodes_per_group") - F.col("free_inodes")).alias("number_of_allocated_inodes"),
            F.sum(F.col("number_of_blocks") - F.col("free_blocks")).alias("number_of_allocated_blocks"),
        )
        zero = self.inode.groupBy("image_id").agg(F.count_if("zeroed").alias("number_of_zeroed_inodes"))
        own = self.superblock.select(
            "image_id", F.col("s_inodes_count").alias("number_of_inodes"), F.col("blocks_count").alias("number_of_blocks"),
            F.col("s_free_inodes_count").alias("number_of_unallocated_inodes"), F.col("free_blocks_count").alias("number_of_unallocated_blocks"),
        )
        return own.join(per, "image_id").join(zero, "image_id")

    # -- lookups by path -----------------------------------------------------------------------------

    @staticmethod
    def _key(path: str) -> str:
        return path if path.startswith("/") else "/" + path

    def get(self, path: str, image_id: str | None = None) -> DataFrame:
        found = self.entry.where(F.col("full_path") == self._key(path))
        return found if image_id is None else found.where(F.col("image_id") == image_id)

    def _one(self, path: str, image_id: str | None, error=KeyError):
        row = self.get(path, image_id).first()
        if row is None:
            raise error(path)
        return row

    def get_directory_contents(self, path: str, image_id: str | None = None) -> DataFrame:
        parent = "" if path in ("", "/") else self._key(path).rstrip("/")
        if parent and self._one(parent, image_id)["file_type_str"] != "directory":
            raise KeyError(path)
        found = self.entry.where(F.col("parent_path") == parent)
        return found if image_id is None else found.where(F.col("image_id") == image_id)

    def is_file(self, path: str, image_id: str | None = None) -> bool:
        return self._one(path, image_id, RuntimeError)["file_type_str"] == "file"

    def is_directory(self, path: str, image_id: str | None = None) -> bool:
        return self._one(path, image_id, RuntimeError)["file_type_str"] == "directory"

    def get_inode(self, number: int) -> DataFrame:
        return self.inode.where(F.col("inode_number") == number)

    def get_block(self, number: int) -> DataFrame:
        return self.block.where(F.col("block_number") == number)

    def get_file_size(self, path: str, image_id: str | None = None) -> int:
        return self._one(path, image_id)["size"]

    def get_file_inode(self, path: str, image_id: str | None = None) -> int:
        return self._one(path, image_id)["inode"]

    def get_file_parts(self, path: str, image_id: str | None = None) -> DataFrame:
        self._one(path, image_id)
        return FL.file_part(self.get(path, image_id), self.runs).orderBy("seq")

    def get_file_permissions(self, path: str, image_id: str | None = None) -> dict:
        return self._one(path, image_id)["perm"].asDict(recursive=True)

    def slack_space_size(self, path: str, image_id: str | None = None) -> int:
        self._one(path, image_id)
        row = FL.slack(FL.file_part(self.get(path, image_id), self.runs), self.offset, content=False).first()
        return row["slack_size"] if row else 0

    def slack_open(self, path: str, image_id: str | None = None) -> bytes:
        self._one(path, image_id)
        row = FL.slack(FL.file_part(self.get(path, image_id), self.runs), self.offset).first()
        return bytes(row["content"]) if row else b""

    def open(self, path: str, image_id: str | None = None, number_of_bytes: int | None = None) -> bytes:
        """The bytes of one file."""
        return self.read_range(path, 0, number_of_bytes, image_id)

    def read_range(self, path: str, offset: int = 0, count: int | None = None, image_id: str | None = None) -> bytes:
        if self._one(path, image_id)["file_type_str"] != "file":
            raise RuntimeError(f"{path} is no regular file")
        one = self.get(path, image_id).limit(1)
        row = FL.range_read(one, FL.file_part(one, self.runs), offset, count, self.offset).first()
        return bytes(row["content"])

    def handle(self, path: str, image_id: str | None = None) -> FileHandle:
        return FileHandle(self, path, image_id)

    def hexdump_block(self, number: int) -> DataFrame:
        return self.raw_block.where(F.col("block_number") == number).select("image_id", F.lower(F.hex("content")).alias("hex"))

    def feature_names(self) -> DataFrame:
        from blockloom.functions import layout

        return self.superblock.select(
            "image_id", D.flag_names("s_feature_compat", layout.COMPAT).alias("compat"), D.flag_names("s_feature_incompat", layout.INCOMPAT).alias("incompat"), D.flag_names("s_feature_ro_compat", layout.RO_COMPAT).alias("ro_compat")
        )
