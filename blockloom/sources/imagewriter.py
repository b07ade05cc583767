"""Deterministic ext images from rows of files: fixtures and the bridge from tables to the image reader.

A row names a file: its directory (any depth), name, content and, where the frame has such columns, kind, mode, owner, time, a hole before the content, a second directory that links to it, and whether it is mapped by
extents or by block pointers. Missing columns have the defaults of ``COLUMNS``. A ``Shape`` says how an image is laid out: block size, blocks a group, records per extent node (few make deep trees), inode size,
64-byte group descriptors, hashed directories. Files are fragmented on purpose. Tasks write whole images of bounded size, under a temporary name first, so that a repeated task does no harm.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions import layout
from blockloom.functions.crc import crc32c
from blockloom.sources.extimage import split_uri

FIRST_INODE, JOURNAL_INODE, GENERATION = 11, 8, 7
CHARS_PER_IMAGE = 4_000_000
EPOCH = 1_600_000_000
DIR_MODE, FILE_MODE, LINK_MODE = 0o40755, 0o100644, 0o120777
#: Optional columns of a row: (name, type, default). ``kind`` is file, symlink (the content is its target) or deleted (an entry without an inode).
COLUMNS = (
    ("kind", "string", "file"), ("mode", "int", FILE_MODE), ("uid", "int", 1000), ("gid", "int", 1000), ("mtime", "bigint", EPOCH), ("hole", "bigint", 0), ("extents", "boolean", None), ("link_dir", "string", None),
)


@dataclass(frozen=True)
class Shape:
    block: int = 1024
    per_group: int = 8192
    fanout: int | None = None
    fragment: int = 3
    inode_size: int = 128
    wide: bool = False
    hashed: bool = False
    #: A journal, and checksums of extent nodes.
    journal: bool = False

    @property
    def first(self) -> int:
        return 1 if self.block == 1024 else 0


@dataclass
class _File:
    key: int
    dir: str
    name: bytes
    content: bytes
    kind: str
    mode: int
    uid: int
    gid: int
    mtime: int
    hole: int
    extents: bool
    link_dir: str | None


class _Disk:
    """Blocks in order of use, and what is in them."""

    def __init__(self, first: int, shape: Shape):
        self.next, self.data, self.shape = first, {}, shape

    def take(self, content: bytes) -> int:
        n, self.next = self.next, self.next + 1
        self.data[n] = content
        return n

    def chunks(self, data: bytes, hole: int = 0) -> list[tuple[int, bytes]]:
        """(logical block, bytes)."""
        size = self.shape.block
        return [(hole // size + k, data[i : i + size]) for k, i in enumerate(range(0, len(data), size))]

    def extent_map(self, pieces: list[tuple[int, bytes]], seed: int = 0) -> bytes:
        """The root node of a tree over the pieces: runs of a few blocks, a block left free after each (long files have long runs). Nodes in blocks end with their checksum, from ``seed``."""
        step = self.shape.fragment if len(pieces) < 900 else 32000
        records = []
        for at in range(0, len(pieces), step):
            part = pieces[at : at + step]
            start = [self.take(p) for _, p in part][0]
            records.append((part[0][0], struct.pack("<IHHI", part[0][0], len(part), start >> 32, start & 0xFFFFFFFF)))
            self.next += 1
        node = lambda rows, most, depth: struct.pack("<HHHHI", layout.EXTENT_MAGIC, len(rows), most, depth, 0) + b"".join(r for _, r in rows)
        most, depth = self.shape.fanout or (self.shape.block - 16) // 12, 0
        while len(records) > 4:
            parts = [records[i : i + most] for i in range(0, len(records), most)]
            filled = [node(p, most, depth).ljust(12 + 12 * most, b"\0") for p in parts]
            blocks = [self.take(n + (struct.pack("<I", crc32c(n, seed)) if self.shape.journal else b"")) for n in filled]
            records = [(p[0][0], struct.pack("<IIHH", p[0][0], b & 0xFFFFFFFF, b >> 32, 0)) for p, b in zip(parts, blocks)]
            depth += 1
        return node(records, 4, depth).ljust(60, b"\0")

    def pointer_map(self, pieces: list[tuple[int, bytes]]) -> bytes:
        """The fifteen pointers over the pieces: direct ones, then one, two and three levels of pointer blocks."""
        per = self.shape.block // 4
        where = [(logical, self.take(p)) for logical, p in pieces]

        def level(height: int, first: int, own: list[tuple[int, int]]) -> int:
            if not own:
                return 0
            if not height:
                return own[0][1]
            span = per ** (height - 1)
            slots = [0] * per
            for k, part in groupby(own, lambda x: (x[0] - first) // span):
                slots[k] = level(height - 1, first + k * span, list(part))
            return self.take(struct.pack(f"<{per}I", *slots))

        slots, first = [0] * 15, 12
        for logical, block in where:
            if logical < 12:
                slots[logical] = block
        for height in (1, 2, 3):
            slots[11 + height] = level(height, first, [x for x in where if first <= x[0] < first + per**height])
            first += per**height
        return struct.pack("<15I", *slots)


def _linear(entries: list[tuple[int, int, bytes]], block: int) -> list[bytes]:
    """Directory blocks; the last record of each reaches its end."""
    blocks: list[bytes] = []
    current, last = b"", 0
    for number, kind, name in entries:
        size = (8 + len(name) + 3) // 4 * 4
        if len(current) + size > block:
            blocks.append(current[: last + 4] + struct.pack("<H", (block - last) & 0xFFFF) + current[last + 6 :])
            current = b""
        last = len(current)
        current += (struct.pack("<IHBB", number, size, len(name), kind) + name).ljust(size, b"\0")
    blocks.append(current[: last + 4] + struct.pack("<H", (block - last) & 0xFFFF) + current[last + 6 :])
    return [b.ljust(block, b"\0") for b in blocks]


def _directory(own: int, parent: int, entries: list[tuple[int, int, bytes]], shape: Shape) -> tuple[list[bytes], bool]:
    """(blocks, hashed): a hashed directory has a root of index entries before its leaf blocks."""
    dots = [(own, 2, b"."), (parent, 2, b"..")]
    leaves = _linear(entries, shape.block) if entries else []
    room = (shape.block - 0x20) // 8
    if not shape.hashed or not 2 <= len(leaves) <= room:
        return _linear([*dots, *entries], shape.block), False
    root = struct.pack("<IHBB4s", own, 12, 1, 2, b".") + struct.pack("<IHBB4s", parent, shape.block - 12, 2, 2, b"..") + struct.pack("<IBBBB", 0, 1, 8, 0, 0)
    root += struct.pack("<HHI", room, len(leaves), 1) + b"".join(struct.pack("<II", k << 20, k + 1) for k in range(1, len(leaves)))
    return [root.ljust(shape.block, b"\0"), *leaves], True


def number_of(label: str) -> int:
    """The digits at a label's end."""
    return int(label.rpartition("-")[2]) if label.rpartition("-")[2].isdigit() else 0


def _journal(block: int, number: int) -> list[bytes]:
    """A journal of one transaction: superblock, a descriptor of two blocks, those, a revocation and the commit."""
    head = lambda kind: struct.pack(">III", layout.JOURNAL_MAGIC, kind, number + 1)
    sb = head(4) + struct.pack(">8I", block, 6, 1, number + 1, 1, 0, 0, 1) + struct.pack(">I", 0) + number.to_bytes(16, "big")
    descriptor = head(1) + struct.pack(">IHH16s", number + 100, 0, 0, bytes(16)) + struct.pack(">IHH", number + 200, 0, 2 | 8)
    revoke = head(5) + struct.pack(">III", 24, number + 300, number + 301)
    commit = (head(2) + bytes(0x30 - 12)) + struct.pack(">Q", EPOCH + number)
    return [sb, descriptor, b"one", b"two", revoke, commit]


def build_image(files: list[_File], shape: Shape = Shape(), label: str = "") -> bytes:
    """The image of some files and of all directories they name."""
    block = shape.block
    paths = {""}
    for f in files:
        for d in (f.dir, f.link_dir):
            parts = d.split("/") if d else []
            paths.update("/".join(parts[:k]) for k in range(1, len(parts) + 1))
    folders = sorted(paths - {""})
    number = {"": layout.ROOT_INODE} | {d: FIRST_INODE + i for i, d in enumerate(folders)}
    living = [f for f in files if f.kind != "deleted"]
    first_file = FIRST_INODE + len(folders)
    n_inodes = first_file + len(living)
    guess = sum(2 * len(f.content) // block + 6 + 3 * (f.hole > 0) for f in living) * 2 + len(files) // 4 + len(folders) * 4 + 64
    groups = 1
    while True:
        per = (-(-n_inodes // groups) + 7) // 8 * 8
        table = -(-per * shape.inode_size // block)
        desc_size = 64 if shape.wide else 32
        gdt = -(-groups * desc_size // block)
        need = -(-(2 + gdt + groups * (2 + table) + guess) // shape.per_group)
        if need <= groups:
            break
        groups = need
    base = shape.first + 1 + gdt
    disk = _Disk(base + groups * (2 + table), shape)
    inodes: dict[int, bytes] = {}

    def inode(n: int, mode: int, size: int, links: int, flags: int, blocks: bytes, before: int, uid: int = 1000, gid: int = 1000, mtime: int = EPOCH) -> None:
        used = sum(1 for b in range(before, disk.next) if b in disk.data) * (block // 512)
        head = struct.pack("<HHIIIIIHHII", mode, uid & 0xFFFF, size & 0xFFFFFFFF, EPOCH, EPOCH + 1, mtime, 0, gid & 0xFFFF, links, used, flags)
        inodes[n] = (head + b"\0" * 4 + blocks.ljust(60, b"\0") + struct.pack("<III", GENERATION, 0, size >> 32)).ljust(0x78, b"\0") + struct.pack("<HH", uid >> 16, gid >> 16)

    identifier = uuid.uuid5(uuid.NAMESPACE_OID, label or f"{len(files)}").bytes
    if shape.journal:
        before, blocks = disk.next, _journal(block, number_of(label))
        inode(JOURNAL_INODE, 0o100600, len(blocks) * block, 1, 0, disk.pointer_map(list(enumerate(blocks))), before, 0, 0)
    members: dict[str, list[tuple[int, int, bytes]]] = {d: [] for d in paths}
    for d in folders:
        members[d.rpartition("/")[0]].append((number[d], 2, d.rpartition("/")[2].encode()))
    at = {id(f): first_file + k for k, f in enumerate(living)}
    for f in files:
        kind = 7 if f.kind == "symlink" else 1
        members[f.dir].append((at.get(id(f), 0), kind, f.name))
        if f.link_dir is not None and f.kind != "deleted":
            members[f.link_dir].append((at[id(f)], kind, f.name))
    for f in living:
        before, size = disk.next, f.hole + len(f.content)
        short = f.kind == "symlink" and len(f.content) < 60
        tree = f.extents and not short
        pieces = [] if short else disk.chunks(f.content, f.hole)
        blocks = f.content if short else disk.extent_map(pieces, crc32c(struct.pack("<II", at[id(f)], GENERATION), crc32c(identifier))) if tree else disk.pointer_map(pieces)
        links = 1 + (f.link_dir is not None)
        inode(at[id(f)], LINK_MODE if f.kind == "symlink" else f.mode, size, links, 0x80000 if tree else 0, blocks, before, f.uid, f.gid, f.mtime)
    for d in ("", *folders):
        before = disk.next
        listing, hashed = _directory(number[d], number[d.rpartition("/")[0]] if d else layout.ROOT_INODE, members[d], shape)
        blocks = disk.pointer_map(list(enumerate(listing)))
        below = sum(1 for c in folders if c.rpartition("/")[0] == d)
        inode(number[d], DIR_MODE, len(listing) * block, 2 + below, 0x1000 if hashed else 0, blocks, before)

    total = shape.first + groups * shape.per_group
    total = min(total, max(disk.next + 1, shape.first + (groups - 1) * shape.per_group + 64))
    used = np.zeros(shape.first + groups * shape.per_group, bool)
    used[shape.first : base + groups * (2 + table)] = True
    used[list(disk.data)] = True
    used[total:] = True
    out = bytearray(total * block)
    free_blocks_total = 0
    for g in range(groups):
        first = shape.first + g * shape.per_group
        part = used[first : first + shape.per_group]
        free = int((~part).sum())
        free_blocks_total += free
        numbers = range(g * per + 1, (g + 1) * per + 1)
        marks = np.array([k < FIRST_INODE or k in inodes for k in numbers])
        where = base + 2 * groups + g * table
        for k in numbers:
            if k in inodes:
                spot = where * block + (k - g * per - 1) * shape.inode_size
                out[spot : spot + len(inodes[k])] = inodes[k]
        for spot, bits in ((base + g, part), (base + groups + g, marks)):
            packed = np.packbits(bits, bitorder="little").tobytes().ljust(block, b"\xff")
            out[spot * block : (spot + 1) * block] = packed
        dirs = sum(1 for k in numbers if k in inodes and inodes[k][1] >> 4 == 4)
        desc = struct.pack("<IIIHHHH", base + g, base + groups + g, where, free, int((~marks).sum()), dirs, 4)
        spot = (shape.first + 1) * block + g * desc_size
        out[spot : spot + len(desc)] = desc
    for n, content in disk.data.items():
        out[n * block : n * block + len(content)] = content
    sb = bytearray(1024)
    log = (block // 1024).bit_length() - 1
    used_inodes = FIRST_INODE - 1 + sum(1 for k in inodes if k >= FIRST_INODE)
    struct.pack_into("<13I", sb, 0, per * groups, total, 0, free_blocks_total, per * groups - used_inodes, shape.first, log, log, shape.per_group, shape.per_group, per, 0, EPOCH)
    struct.pack_into("<6H", sb, 0x34, 0, 65535, layout.MAGIC, 1, 1, 0)
    struct.pack_into("<II", sb, 0x4C, 1, 0)
    struct.pack_into("<IHHIII", sb, 0x54, FIRST_INODE, shape.inode_size, 0, (0x20 if shape.hashed else 0) | (0x4 if shape.journal else 0), 0x2 | 0x40 | 0x200 | (0x80 if shape.wide else 0), 0x1 | (0x400 if shape.journal else 0))
    sb[0x68:0x78] = identifier
    struct.pack_into("<4I", sb, 0xEC, *(number_of(label) + k for k in range(1, 5)))
    if shape.journal:
        struct.pack_into("<I", sb, 0xE0, JOURNAL_INODE)
    sb[0x78:0x88] = label.encode()[:16].ljust(16, b"\0")
    struct.pack_into("<H", sb, 0xFE, desc_size if shape.wide else 0)
    struct.pack_into("<I", sb, 0x108, EPOCH)
    out[1024:2048] = sb
    return bytes(out)


def volumes(size: int, chars_per_image: int = CHARS_PER_IMAGE) -> int:
    """Number of images for so many bytes of content."""
    return max(2, -(-size // chars_per_image))


def write_images(rows: DataFrame, folder: str, chars_per_image: int = CHARS_PER_IMAGE, shapes: tuple[Shape, ...] = (Shape(),)) -> DataFrame:
    """Write ``rows`` (key bigint, dir string, name string or binary, content binary and any of ``COLUMNS``) as images ``vol-<n>.img``; (image_id, n_files, n_bytes).

    A row goes to image key mod the number of images, an image has the shape of its number. Without a column ``extents`` every second file has extents.
    """
    k = volumes(rows.agg(F.sum(F.length("content"))).first()[0] or 0, chars_per_image)
    full = rows
    for name, kind, default in COLUMNS:
        if name not in rows.columns:
            full = full.withColumn(name, F.lit(default).cast(kind))
    fields = ["key", "dir", "name", "content", *[c for c, _, _ in COLUMNS]]
    spread = full.select(F.pmod("key", F.lit(k)).cast("bigint").alias("volume"), *[F.col(c).cast("binary").alias(c) if c in ("name", "content") else F.col(c) for c in fields])

    def flush(volume: int, held: list[tuple]) -> pa.RecordBatch:
        files = [_File(*r) for r in sorted(held, key=lambda r: (r[0], r[1], r[2]))]
        for i, f in enumerate(files):
            if f.extents is None:
                f.extents = i % 2 == 0
        fs, inner = split_uri(folder)
        fs.create_dir(inner, recursive=True)
        image = build_image(files, shapes[volume % len(shapes)], f"volume-{volume:06d}")
        final = f"{inner}/vol-{volume:06d}.img"
        part = f"{inner}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(image)
        fs.move(part, final)
        return pa.record_batch({"image_id": [f"vol-{volume:06d}.img"], "n_files": [len(files)], "n_bytes": [len(image)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume, held = None, []
        for batch in batches:
            for v, *r in zip(*(batch.column(x).to_pylist() for x in ("volume", *fields))):
                if volume is not None and v != volume:
                    yield flush(volume, held)
                    held = []
                volume = v
                held.append(tuple(r))
        if held:
            yield flush(volume, held)

    laid = spread.repartition(k, "volume").sortWithinPartitions("volume")
    return laid.mapInArrow(run, "image_id string, n_files bigint, n_bytes bigint")
