"""Spark data source over raw ext2/3/4 images.

``spark.read.format("extimage").option("path", ...).option("table", ...)``. Tables: ``superblock`` (raw), ``group``, ``bitmap``, ``inode``, ``block`` and ``status``. Records of fixed size are decoded by one numpy view over
all records of a read; what derives from the fields is left to Catalyst. ``read_ranges`` fetches byte ranges named by a frame. Nothing writes to an image.

Work is planned from file sizes alone, without opening an image: small images share a task, a large one is split into runs of block groups. Each task reads the geometry of its images itself.

Options: ``path`` (a file, or a folder whose files are images), ``pushdown``, ``masterOffset`` (byte offset of the file system), ``magicIgnore``, ``mode`` (``failfast``: an unreadable image is an error, the default;
``permissive``: it gives no rows, and ``status`` says why), ``bytesPerTask``.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from blockloom.functions import layout
from blockloom.session import ship

SCHEMAS = {
    "superblock": "image_id string, image_path string, raw binary",
    "group": "image_id string, image_path string, group_number int, block_size int, first_data_block bigint, blocks_count bigint, blocks_per_group bigint, inodes_per_group bigint, desc_size int, "
    + ", ".join(f"{n} bigint" for n, _, _, _ in layout.GROUP),
    "bitmap": "image_id string, group_number int, kind string, first_number bigint, n_bits int, uninit boolean, bits binary",
    "inode": "image_id string, image_path string, inode_number bigint, group_number int, allocated boolean, byte_start bigint, block_size int, filetype boolean, "
    + ", ".join(f"{n} bigint" for n, _, _ in layout.INODE) + ", i_block binary, union_osd2 binary",
    "block": "image_id string, block_number bigint, group_number int, content binary",
    "status": "image_id string, image_path string, n_bytes bigint, error string",
}
#: Neighbouring ranges are read together up to this size.
COALESCED_BYTES = 4 << 20
#: One view over records of fixed size: field, offset and width of each, or bytes.
_KINDS = {1: "u1", 2: "<u2", 4: "<u4", 8: "<u8"}


def record_type(fields, size: int, blobs=()) -> np.dtype:
    """The structured type of a record of ``size`` bytes; fields beyond it are left out."""
    own = [(n, o, _KINDS[w]) for n, o, w in fields if o + w <= size] + [(n, o, f"V{w}") for n, o, w in blobs if o + w <= size]
    return np.dtype({"names": [n for n, _, _ in own], "offsets": [o for _, o, _ in own], "formats": [f for _, _, f in own], "itemsize": size})


def inode_columns(data: bytes, size: int) -> dict[str, pa.Array]:
    """The fields of consecutive inodes of ``size`` bytes."""
    blobs = (("i_block", *layout.I_BLOCK), ("union_osd2", 0x74, 12))
    view = np.frombuffer(data, record_type(layout.INODE, size, blobs))
    out = {n: pa.array(view[n].astype(np.int64)) for n, _, _ in layout.INODE}
    for n, _, w in blobs:
        raw = np.ascontiguousarray(view[n]).tobytes()
        out[n] = pa.FixedSizeBinaryArray.from_buffers(pa.binary(w), len(view), [None, pa.py_buffer(raw)]).cast(pa.binary())
    return out


def descriptor_columns(data: bytes, size: int) -> dict[str, pa.Array]:
    """The fields of consecutive group descriptors, low and high halves put together."""
    low = record_type([(n, o, w) for n, o, w, _ in layout.GROUP], size)
    view = np.frombuffer(data, low)
    out = {n: view[n].astype(np.int64) for n, _, _, _ in layout.GROUP}
    if size >= 64:
        high = np.frombuffer(data, record_type([(n, h, w) for n, _, w, h in layout.GROUP if h is not None], size))
        for n, _, w, h in layout.GROUP:
            if h is not None:
                out[n] = out[n] | high[n].astype(np.int64) << (8 * w)
    return {n: pa.array(v) for n, v in out.items()}


def split_uri(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Geometry:
    """What a reader must know of a superblock to find the other records."""

    path: str
    image_id: str
    offset: int
    block_size: int
    blocks_count: int
    blocks_per_group: int
    inodes_count: int
    inodes_per_group: int
    inode_size: int
    first_data_block: int
    desc_size: int
    incompat: int

    @property
    def groups(self) -> int:
        return -(-(self.blocks_count - self.first_data_block) // self.blocks_per_group)

    def group_blocks(self, g: int) -> int:
        return min(self.blocks_per_group, self.blocks_count - self.first_data_block - g * self.blocks_per_group)


class Image:
    """Positioned reads on one image."""

    def __init__(self, path: str, offset: int = 0):
        fs, inner = split_uri(path)
        self._file, self._offset, self.path = fs.open_input_file(inner), offset, path

    def read(self, at: int, size: int) -> bytes:
        end = self._file.size()
        at += self._offset
        if at >= end or size <= 0:
            return b""
        return self._file.read_at(min(size, end - at), at)

    def geometry(self, magic_ignore: bool = False) -> Geometry:
        raw = self.read(1024, 1024)
        if len(raw) < 1024:
            raise ValueError(f"{self.path}: too short for a superblock")
        u16, u32 = (lambda o: struct.unpack_from("<H", raw, o)[0]), (lambda o: struct.unpack_from("<I", raw, o)[0])
        if u16(0x38) != layout.MAGIC and not magic_ignore:
            raise ValueError(f"{self.path}: magic {u16(0x38):#06x}, expected {layout.MAGIC:#06x}")
        incompat = u32(0x60)
        for value, names, mask in ((incompat, layout.INCOMPAT, 0x10), (incompat, layout.INCOMPAT, 0x8), (u32(0x64), layout.RO_COMPAT, 0x200)):
            # other places of descriptors, no file system at all, bitmaps of clusters instead of blocks
            if value & mask:
                raise ValueError(f"{self.path}: {names[mask]} is not supported")
        wide = bool(incompat & 0x80)
        log = u32(0x18)
        if log > 6 or not u32(0x20) or not u32(0x28):
            raise ValueError(f"{self.path}: implausible geometry")
        return Geometry(
            self.path, os.path.basename(self.path), self._offset, 1024 << log, u32(0x04) | (u32(0x150) << 32 if wide else 0), u32(0x20), u32(0x00), u32(0x28),
            (u16(0x58) or 128) if u32(0x4C) else 128, u32(0x14), max(u16(0xFE), 32) if wide else 32, incompat,
        )

    def descriptors(self, g: Geometry, first: int, last: int) -> bytes:
        return self.read((g.first_data_block + 1) * g.block_size + first * g.desc_size, (last - first) * g.desc_size).ljust((last - first) * g.desc_size, b"\0")


def _word(raw: bytes, low: int, width: int, high: int | None) -> int:
    value = int.from_bytes(raw[low : low + width], "little")
    if high is not None and len(raw) >= 64:
        value |= int.from_bytes(raw[high : high + width], "little") << (8 * width)
    return value


_AT = {name: (low, width, high) for name, low, width, high in layout.GROUP}


def group_field(raw: bytes, name: str) -> int:
    return _word(raw, *_AT[name])


def list_images(path: str) -> list[tuple[str, int]]:
    """(path, size) of the image files, from one listing."""
    fs, inner = split_uri(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.Directory:
        found = [(i.path, i.size) for i in fs.get_file_info(pafs.FileSelector(inner)) if i.type == pafs.FileType.File and not os.path.basename(i.path).startswith((".", "_"))]
        return [(prefix + p, n) for p, n in sorted(found)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [(path, info.size)]


class _Part(InputPartition):
    """Pieces of images: (path, file size, number of the share, number of shares of that image)."""

    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces


class _Reader(DataSourceReader):
    def __init__(self, options: dict, table: str):
        self.table = table
        self.path = options["path"]
        low = {k.lower(): v for k, v in options.items()}
        self.offset = int(low.get("masteroffset", 0))
        self.ignore = str(low.get("magicignore", "false")).lower() == "true"
        self.permissive = str(low.get("mode", "failfast")).lower() == "permissive" or table == "status"
        self.task_bytes = int(low.get("bytespertask", 64 << 20))
        #: Ranges of group numbers and image names that filters leave.
        self.groups: list = [0, 1 << 60, None]
        self.images: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        held, size = [], 0
        for path, n in list_images(self.path):
            if self.images is not None and os.path.basename(path) not in self.images:
                continue
            # records of an image are a small share of it, its blocks are all of it
            work = n if self.table == "block" else n // 16
            shares = 1 if self.table in ("superblock", "status") else max(1, -(-work // self.task_bytes))
            for k in range(shares):
                if held and size + work // shares > self.task_bytes:
                    parts.append(_Part(held))
                    held, size = [], 0
                held.append((path, n, k, shares))
                size += max(work // shares, 1 << 20)
        if held:
            parts.append(_Part(held))
        return parts or [_Part([])]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        for path, size, share, shares in part.pieces:
            try:
                image = Image(path, self.offset)
                g = image.geometry(self.ignore)
            except (ValueError, OSError) as e:
                if self.table == "status":
                    yield self._status_row(path, size, str(e))
                elif not self.permissive:
                    raise
                continue
            if self.table == "status":
                yield self._status_row(path, size, None)
            elif self.table == "superblock":
                yield pa.RecordBatch.from_pydict({"image_id": [g.image_id], "image_path": [g.path], "raw": [image.read(1024, 1024)]})
            else:
                first, last = max(g.groups * share // shares, self.groups[0]), min(g.groups * (share + 1) // shares, self.groups[1] + 1)
                if first < last:
                    yield from self._groups(image, g, first, last)

    @staticmethod
    def _status_row(path: str, size: int, error: str | None) -> pa.RecordBatch:
        columns = ([os.path.basename(path)], pa.string()), ([path], pa.string()), ([size], pa.int64()), ([error], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], names=["image_id", "image_path", "n_bytes", "error"])

    def _groups(self, image: Image, g: Geometry, first: int, last: int) -> Iterator[pa.RecordBatch]:
        raw = image.descriptors(g, first, last)
        if self.table == "group":
            n = last - first
            same = ((g.image_id, pa.string()), (g.path, pa.string())), ((g.block_size, pa.int32()), (g.first_data_block, pa.int64()), (g.blocks_count, pa.int64()), (g.blocks_per_group, pa.int64()), (g.inodes_per_group, pa.int64()), (g.desc_size, pa.int32()))
            columns = [pa.repeat(pa.scalar(*v), n) for v in same[0]] + [pa.array(range(first, last), pa.int32())] + [pa.repeat(pa.scalar(*v), n) for v in same[1]]
            names = ["image_id", "image_path", "group_number", "block_size", "first_data_block", "blocks_count", "blocks_per_group", "inodes_per_group", "desc_size"]
            fields = descriptor_columns(raw, g.desc_size)
            yield pa.RecordBatch.from_arrays([*columns, *fields.values()], names=[*names, *fields])
            return
        for number in range(first, last):
            if self.groups[2] is None or number in self.groups[2]:
                at = (number - first) * g.desc_size
                yield from getattr(self, "_" + self.table)(image, g, number, raw[at : at + g.desc_size])

    @staticmethod
    def _inode_bits(image, g, desc) -> tuple[bytes, bool]:
        size = -(-g.inodes_per_group // 8)
        uninit = bool(group_field(desc, "flags") & 0x1)
        return (bytes(size) if uninit else image.read(group_field(desc, "bitmap_inode") * g.block_size, size)), uninit

    def _bitmap(self, image, g, number, desc):
        n = g.group_blocks(number)
        no_blocks = bool(group_field(desc, "flags") & 0x2)
        blocks = bytes(-(-n // 8)) if no_blocks else image.read(group_field(desc, "bitmap_block") * g.block_size, -(-n // 8))
        bits, no_inodes = self._inode_bits(image, g, desc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in (
                ([g.image_id] * 2, pa.string()), ([number] * 2, pa.int32()), (["block", "inode"], pa.string()),
                ([g.first_data_block + number * g.blocks_per_group, number * g.inodes_per_group + 1], pa.int64()), ([n, g.inodes_per_group], pa.int32()),
                ([no_blocks, no_inodes], pa.bool_()), ([blocks, bits], pa.binary()))],
            names=["image_id", "group_number", "kind", "first_number", "n_bits", "uninit", "bits"],
        )

    def _inode(self, image, g, number, desc):
        bits, _ = self._inode_bits(image, g, desc)
        start = group_field(desc, "table_inode") * g.block_size
        n, size = g.inodes_per_group, g.inode_size
        used = np.unpackbits(np.frombuffer(bits.ljust(-(-n // 8), b"\0"), np.uint8), bitorder="little")[:n].astype(bool)
        for at in range(0, n, 16384):
            k = min(16384, n - at)
            data = image.read(start + at * size, k * size).ljust(k * size, b"\0")
            same = [pa.repeat(pa.scalar(v, t), k) for v, t in ((g.image_id, pa.string()), (g.path, pa.string()))]
            row = np.arange(at, at + k, dtype=np.int64)
            own = [
                pa.array(number * n + row + 1), pa.repeat(pa.scalar(number, pa.int32()), k), pa.array(used[at : at + k]), pa.array(g.offset + start + row * size),
                pa.repeat(pa.scalar(g.block_size, pa.int32()), k), pa.repeat(pa.scalar(bool(g.incompat & 0x2)), k),
            ]
            fields = inode_columns(data, size)
            names = ["image_id", "image_path", "inode_number", "group_number", "allocated", "byte_start", "block_size", "filetype", *fields]
            yield pa.RecordBatch.from_arrays([*same, *own, *fields.values()], names=names)

    def _block(self, image, g, number, desc):
        first, n = g.first_data_block + number * g.blocks_per_group, g.group_blocks(number)
        per = max(1, (1 << 22) // g.block_size)
        for at in range(first, first + n, per):
            k = min(per, first + n - at)
            data = image.read(at * g.block_size, k * g.block_size).ljust(k * g.block_size, b"\0")
            content = pa.FixedSizeBinaryArray.from_buffers(pa.binary(g.block_size), k, [None, pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(g.image_id, pa.string()), k), pa.array(range(at, at + k), pa.int64()), pa.repeat(pa.scalar(number, pa.int32()), k), content],
                names=["image_id", "block_number", "group_number", "content"],
            )


class _PruningReader(_Reader):
    """Used where the session allows Python sources to see filters (``spark.sql.python.filterPushdown.enabled``)."""

    def pushFilters(self, filters: list[Filter]):
        """Equality, IN and ranges on group_number and equality and IN on image_id prune what is read; the filters are also left to Spark."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("group_number",):
                low, high, only = self.groups
                if isinstance(f, EqualTo):
                    only = {f.value} if only is None else only & {f.value}
                elif isinstance(f, In):
                    only = set(f.value) if only is None else only & set(f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    high = min(high, f.value - isinstance(f, LessThan))
                if only is not None:
                    only = {v for v in only if v is not None}
                    low, high = max([low, *([min(only)] if only else [1 << 60])]), min([high, *([max(only)] if only else [-1])])
                self.groups = [low, high, only]
            elif name == ("image_id",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.images = own if self.images is None else self.images & own
            yield f


class ExtImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "extimage"

    def _table(self) -> str:
        table = self.options.get("table", "superblock")
        if table not in SCHEMAS:
            raise ValueError(f"unknown table {table}; there are {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> DataSourceReader:
        kind = _PruningReader if str(self.options.get("pushdown", "false")).lower() == "true" else _Reader
        return kind(dict(self.options), self._table())


def read_image(spark: SparkSession, path: str, table: str, master_offset: int = 0, magic_ignore: bool = False, permissive: bool = False) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ExtImageSource)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("extimage").option("path", path).option("table", table).option("pushdown", prune)
    reader = reader.option("mode", "permissive" if permissive else "failfast")
    return reader.option("masterOffset", master_offset).option("magicIgnore", str(magic_ignore)).load()


def read_ranges(ranges: DataFrame, master_offset: int = 0, out: str = "content") -> DataFrame:
    """``ranges`` (image_path, byte_at, byte_len and any more) with the bytes there; sorted within partitions, so that reads run forward and neighbouring ranges are read at once.

    A null ``byte_at`` gives zeros, as do bytes behind the end of an image.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        images: dict[str, Image] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                data: list[bytes] = []
                run_path, run_at, run_len, sizes = None, 0, 0, []

                def flush() -> None:
                    if not sizes:
                        return
                    if run_path not in images:
                        images[run_path] = Image(run_path, master_offset)
                    raw = images[run_path].read(run_at, run_len).ljust(run_len, b"\0")
                    place = 0
                    for n in sizes:
                        data.append(raw[place : place + n])
                        place += n

                for p, at, n in zip(b.column("image_path").to_pylist(), b.column("byte_at").to_pylist(), b.column("byte_len").to_pylist()):
                    if sizes and p == run_path and at == run_at + run_len and run_len + n <= COALESCED_BYTES:
                        sizes.append(n)
                        run_len += n
                        continue
                    flush()
                    run_path, run_at, run_len, sizes = p, at, n, [n]
                    if at is None:
                        data.append(bytes(n))
                        sizes = []
                flush()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=[*b.schema.names, out])

    return ranges.sortWithinPartitions("image_path", "byte_at").mapInArrow(run, f"{fields}, `{out}` binary")
