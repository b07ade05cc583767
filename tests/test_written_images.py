"""Images of the writer, unreadable files among them, and the parts of the reader that need no image."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.api import ImageSet
from blockloom.functions import layout
from blockloom.functions.crc import crc32c
from blockloom.operators import files as FL
from blockloom.operators import metadata as M
from blockloom.sources import extimage
from blockloom.sources.imagewriter import Shape, write_images

ROWS = "key bigint, dir string, name string, content binary"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two images: with a deep tree of extents and a file beyond 3 GiB, most of it a hole."""
    out = tmp_path_factory.mktemp("written") / "images"
    rng = random.Random(3)
    rows = [(k, ("a/b/c", "a/b", "")[k % 3], f"{k}.bin", bytearray(rng.randbytes(n)), 0, True) for k, n in enumerate((0, 10, 40_000, 70_000, 1024, 90_000))]
    rows += [(6, "big", "far.bin", bytearray(b"x" * 5000 + b"end"), 3 * 1024**3, False), (7, "big", "wide.bin", bytearray(b"y" * 5000 + b"end"), 3 * 1024**3, True)]
    df = spark.createDataFrame(rows, ROWS + ", hole bigint, extents boolean")
    write_images(df, str(out), shapes=(Shape(1024, 2048, fanout=2, fragment=1, hashed=True, journal=True),)).collect()
    return out, {f"/{d}/{n}".replace("//", "/"): bytes(c) for _, d, n, c, hole, _ in rows if not hole}


def test_files_beyond_two_gib(spark, folder):
    s = ImageSet(spark, str(folder[0]))
    big = s.files.where("parent_path = '/big'")
    assert {r["size"] for r in big.collect()} == {3 * 1024**3 + 5003}
    pieces = FL.file_pieces(big, s.file_part.where("full_path like '/big/%'"), s.offset)
    rows = pieces.groupBy("full_path").agg(F.count("*").alias("n"), F.count("content").alias("held"), F.sum("n_bytes").alias("bytes")).collect()
    assert [(r["n"], r["held"], r["bytes"]) for r in rows] == [(769, 1, 3 * 1024**3 + 5003)] * 2
    for name, letter in (("far", b"x"), ("wide", b"y")):
        image = big.where(f"name = '{name}.bin'").first()["image_id"]
        with s.handle(f"/big/{name}.bin", image) as h:
            assert h.seek(3 * 1024**3 - 3) and h.read(6) == b"\0\0\0" + letter * 3
            assert h.seek(-4, 2) == len(h) - 4 and h.read() == letter + b"end" and h.read(1) == b""
            assert h.seek(2**31) and h.read(3) == b"\0\0\0"


def test_contents_and_handles(spark, folder):
    s = ImageSet(spark, str(folder[0]))
    small = s.files.where("parent_path <> '/big'")
    parts = s.file_part.where("full_path not like '/big/%'")
    assert {r["full_path"]: bytes(r["content"]) for r in FL.file_content(small, parts).collect()} == folder[1]
    rebuilt: dict = {}
    for r in FL.file_pieces(small, parts, piece_bytes=1000).orderBy("full_path", "piece").collect():
        assert r["piece_start"] == 1000 * r["piece"] and r["n_bytes"] == len(r["content"])
        rebuilt[r["full_path"]] = rebuilt.get(r["full_path"], b"") + bytes(r["content"])
    assert rebuilt == {p: c for p, c in folder[1].items() if c}
    path = max(folder[1], key=lambda p: len(folder[1][p]))
    rng = random.Random(1)
    h = s.handle(path)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    for _ in range(200):
        at, n = rng.randint(0, len(h)), rng.choice([0, 1, 7, 5000, 80_000])
        h.seek(at)
        assert h.read(n) == folder[1][path][at : at + n]
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before  # no job for a read
    errors = s.extent_errors.count()
    assert errors == 0 and s.extent_checksum.where("not valid").count() == 0 and s.extent_checksum.count() > 20
    assert s.journal_record.where("kind = 'descriptor'").count() == 2 * s.superblock.count()


def test_bad_images_among_good_ones(spark, folder, tmp_path):
    good = sorted(folder[0].glob("*.img"))[0]
    raw = good.read_bytes()
    (tmp_path / "good.img").write_bytes(raw)
    (tmp_path / "short.img").write_bytes(b"x" * 100)
    (tmp_path / "zeros.img").write_bytes(bytes(4096))
    clusters = bytearray(raw)
    struct.pack_into("<I", clusters, 1024 + 0x64, 0x200)
    (tmp_path / "clusters.img").write_bytes(clusters)
    broken = bytearray(raw)
    nodes = [at for at in range(0, len(broken), 1024) if broken[at : at + 2] == b"\x0a\xf3" and struct.unpack_from("<H", broken, at + 6)[0] == 0]
    broken[nodes[0]] = 0
    (tmp_path / "broken.img").write_bytes(broken)
    status = {r["image_id"]: r["error"] for r in ImageSet(spark, str(tmp_path)).status.collect()}
    assert status["good.img"] is None and status["broken.img"] is None
    assert "too short" in status["short.img"] and "magic" in status["zeros.img"] and "BIGALLOC" in status["clusters.img"]
    with pytest.raises(Exception, match="magic|short|BIGALLOC"):
        ImageSet(spark, str(tmp_path)).group_desc.collect()
    s = ImageSet(spark, str(tmp_path), permissive=True)
    assert {r["image_id"] for r in s.superblock.collect()} == {"good.img", "broken.img"}
    assert s.files.where("image_id = 'good.img'").count() == ImageSet(spark, str(good)).files.count() > 0
    errors = s.extent_errors.collect()
    assert [(r["image_id"], r["node_block"]) for r in errors] == [("broken.img", nodes[0] // 1024)]
    none = ImageSet(spark, str(tmp_path / "none"))
    with pytest.raises(Exception, match="none"):
        none.superblock.collect()


def test_planning(tmp_path):
    """Small images share a task, a large one is split, and filters leave what they need."""
    for k in range(30):
        (tmp_path / f"{k:02d}.img").write_bytes(bytes(10))
    with open(tmp_path / "large.img", "wb") as f:
        f.truncate(8 << 30)
    make = lambda table, kind=extimage._PruningReader, **o: kind({"path": str(tmp_path), **o}, table)
    parts = make("inode").partitions()
    shares = [p for part in parts for p in part.pieces]
    assert len(parts) < 15 and sum(p[0].endswith("large.img") for p in shares) == 8 and len({p[0] for p in shares}) == 31
    r = make("inode")
    left = list(r.pushFilters([extimage.In(("group_number",), (3, 9, 40)), extimage.LessThan(("group_number",), 20), extimage.GreaterThanOrEqual(("group_number",), 5), extimage.EqualTo(("image_id",), "03.img")]))
    assert len(left) == 4 and r.groups[:2] == [9, 9] or r.groups[0] >= 5 and r.groups[1] <= 19
    assert [p[0][-6:] for part in r.partitions() for p in part.pieces] == ["03.img"]


def test_filters_reach_the_source(spark, folder):
    s = ImageSet(spark, str(folder[0]))
    every = s.inode.select("image_id", "group_number", "inode_number").collect()
    for where, keep in (
        ("group_number in (0, 2)", lambda g: g in (0, 2)), ("group_number > 0", lambda g: g > 0), ("group_number <= 1", lambda g: g <= 1), ("group_number = 1 and group_number in (1, 2)", lambda g: g == 1), ("group_number > 999", lambda g: False),
    ):
        got = s.inode.where(where).select("image_id", "group_number", "inode_number").collect()
        assert sorted(got) == sorted(r for r in every if keep(r["group_number"])), where


def test_records_by_one_view():
    rng = random.Random(5)
    for size in (128, 256):
        raw = rng.randbytes(size * 50)
        got = extimage.inode_columns(raw, size)
        for name, at, width in layout.INODE:
            assert got[name].to_pylist() == [int.from_bytes(raw[k * size + at : k * size + at + width], "little") for k in range(50)]
        at, width = layout.I_BLOCK
        assert got["i_block"].to_pylist() == [raw[k * size + at : k * size + at + width] for k in range(50)]
    for size in (32, 64):
        raw = rng.randbytes(size * 20)
        got = extimage.descriptor_columns(raw, size)
        for name, *_ in layout.GROUP:
            assert [v % 2**64 for v in got[name].to_pylist()] == [extimage.group_field(raw[k * size : (k + 1) * size], name) for k in range(20)]


def test_runs_of_bits(spark):
    rng = random.Random(6)
    maps, want = [], {}
    for image in ("a", "b"):
        bits = []
        for g in range(6):
            n = 64 if g < 5 else 37
            own = rng.choice([[0] * n, [1] * n, [rng.randint(0, 1) for _ in range(n)], [rng.random() < 0.1 for _ in range(n)]])
            raw = np.packbits(np.array(own, bool), bitorder="little").tobytes()
            maps.append((image, g, 100 + 64 * g, n, bytearray(raw[: len(raw) - (g == 2)])))
            bits += [int(b) for b in own[: 8 * (len(raw) - (g == 2))]] + [0] * max(0, n - 8 * (len(raw) - (g == 2)))
        free = [100 + k for k, b in enumerate(bits) if not b]
        want[image] = [(free[i], free[j]) for i, j in _islands(free)]
    df = spark.createDataFrame(maps, "image_id string, group_number int, first_number bigint, n_bits int, bits binary")
    runs = M.bit_runs(df)
    for image, ranges in want.items():
        got = sorted((r["range_start"], r["range_end"]) for r in M.free_runs(runs).where(F.col("image_id") == image).collect())
        assert got == ranges
    single = M.group_usage(M.explode_bits(df, "number"))
    assert sorted(map(tuple, single.collect())) == sorted(map(tuple, M.run_usage(runs).collect()))
    assert M.free_runs(M.bit_runs(df.limit(0))).count() == 0


def _islands(numbers):
    out, begin = [], 0
    for k in range(1, len(numbers) + 1):
        if k == len(numbers) or numbers[k] != numbers[k - 1] + 1:
            if numbers:
                out.append((begin, k - 1))
            begin = k
    return out


def test_directory_records_of_large_blocks():
    """In 64 KiB blocks a record may be as long as the block."""
    entry = lambda n, size, name: struct.pack("<IHBB", n, size, len(name), 1) + name
    blocks = [entry(5, 65535, b"whole").ljust(65536, b"\0"), entry(6, 0, b"zero").ljust(65536, b"\0"), (entry(7, 16, b"one").ljust(16, b"\0") + entry(8, 65520, b"two")).ljust(65536, b"\0"), b"", b"\0" * 8]
    n = len(blocks)
    batch = pa.record_batch(
        {"image_id": ["a"] * n, "inode_number": pa.array([2] * n, pa.int64()), "logical_block": pa.array(range(n), pa.int64()), "byte_at": pa.array([65536 * k for k in range(n)], pa.int64()), "filetype": [True] * n, "content": pa.array(blocks, pa.binary())}
    )
    rows = [r for b in FL._parse_dirents(iter([batch])) for r in b.to_pylist()]
    assert [(r["inode"], r["name_raw"], r["rec_len"], r["ordinal"]) for r in rows] == [(5, b"whole", 65536, 0), (6, b"zero", 65536, 1 << 16), (7, b"one", 16, 2 << 16), (8, b"two", 65520, (2 << 16) + 1)]


def test_checksum():
    assert crc32c(b"123456789") ^ 0xFFFFFFFF == 0xE3069283
    assert crc32c(b"6789", crc32c(b"12345")) == crc32c(b"123456789")
