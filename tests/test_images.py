"""The reader against images made by mkfs: relations, paths, contents, allocation."""

import os
import re
import stat
import subprocess

import pytest
from pyspark.sql import functions as F

from blockloom.api import ImageSet


@pytest.fixture(scope="module")
def image_set(spark, images):
    return ImageSet(spark, str(images[0]))


def _walk(src):
    out = {}
    for folder, dirs, names in os.walk(src):
        for n in dirs + names:
            p = os.path.join(folder, n)
            out["/" + os.path.relpath(p, src)] = os.lstat(p)
    return out


def test_superblock(image_set, images):
    rows = {r["image_id"]: r for r in image_set.superblock.collect()}
    assert len(rows) == 8
    for name, r in rows.items():
        said = subprocess.run(["dumpe2fs", "-h", str(images[0] / name)], capture_output=True, text=True).stdout
        field = lambda k, said=said: re.search(rf"^{k}:\s+(.*)$", said, re.M)[1]
        assert r["s_inodes_count"] == int(field("Inode count"))
        assert r["blocks_count"] == int(field("Block count"))
        assert r["block_size"] == int(field("Block size"))
        assert r["uuid_str"] == field("Filesystem UUID")
        assert r["s_free_inodes_count"] == int(field("Free inodes"))
        assert r["free_blocks_count"] == int(field("Free blocks"))
        assert r["magic_hex"] == "0xef53" and r["s_want_extra_isize"] == 32 and r["state_cleanly_unmounted"]
        assert r["incompat"]["FILETYPE"] == (name != "nofiletype.fs")
        assert r["incompat"]["EXTENTS"] == (name.startswith("ext4") or name == "indexed.fs")


def test_allocation(image_set):
    free = {(r["image_id"], r["group_number"]): r["unallocated"] for r in image_set.group_usage.collect()}
    for g in image_set.group_desc.collect():
        if not g["block_uninit"]:
            assert free[g["image_id"], g["group_number"]] == g["free_blocks"]
    ranges = image_set.unallocated_block_ranges.groupBy("image_id").agg(F.sum("n").alias("n"))
    total = {r["image_id"]: r["n"] for r in ranges.collect()}
    single = {r["image_id"]: r["n"] for r in image_set.unallocated_blocks.groupBy("image_id").agg(F.count("*").alias("n")).collect()}
    assert total == single
    for c in image_set.counts.collect():
        assert c["number_of_allocated_inodes"] + c["number_of_unallocated_inodes"] == c["number_of_inodes"]
        assert c["number_of_zeroed_inodes"] > 0


def test_catalog(image_set, images):
    want = _walk(images[1])
    for image in [r["image_id"] for r in image_set.superblock.collect()]:
        rows = {r["full_path"]: r for r in image_set.entry.where(F.col("image_id") == image).collect()}
        rows.pop("/lost+found")
        assert set(rows) == set(want), image
        kinds = {stat.S_IFREG: "file", stat.S_IFDIR: "directory", stat.S_IFLNK: "symlink", stat.S_IFIFO: "fifo"}
        for p, st in want.items():
            r = rows[p]
            assert r["file_type_str"] == kinds[stat.S_IFMT(st.st_mode)], (image, p)
            assert r["i_mode"] == st.st_mode
            if r["file_type_str"] == "file":
                assert r["size"] == st.st_size
        assert rows["/hard.txt"]["inode"] == rows["/512byte.txt"]["inode"]
        perm = rows["/sub/deep/x.txt"]["perm"]
        assert perm["setuid"] and perm["user"]["execute"] and not perm["group"]["write"] and perm["other"]["execute"]


def test_symlinks(image_set):
    links = image_set.inode.where("allocated and file_type = 'symlink'").collect()
    assert len(links) == 8 and {r["symlink_target"] for r in links} == {"512byte.txt"}


def test_order(image_set):
    """All entries of a directory before those of its subdirectories, depth first."""
    rows = image_set.entry.where("image_id = 'ext4_1024.fs'").orderBy("obj_id").collect()
    assert [r["obj_id"] for r in rows] == list(range(1, len(rows) + 1))
    by_dir = {}
    for r in rows:
        by_dir.setdefault(r["parent_path"], []).append(r)
    want = []

    def walk(p):
        kids = sorted(by_dir.get(p, []), key=lambda r: r["ordinal"])
        want.extend(k["full_path"] for k in kids)
        for k in kids:
            if k["file_type_str"] == "directory":
                walk(k["full_path"])

    walk("")
    assert want == [r["full_path"] for r in rows]


def test_contents(image_set, images):
    want = {p: open(images[1] / p[1:], "rb").read() for p, st in _walk(images[1]).items() if stat.S_ISREG(st.st_mode) and "/big/" not in p}
    small = image_set.entry.where("parent_path <> '/big'")
    from blockloom.operators import files as FL

    parts = FL.file_part(small, image_set.runs)
    for r in FL.file_content(small.where("full_path <> '/far.bin'"), parts.where("full_path <> '/far.bin'")).collect():
        assert bytes(r["content"]) == want[r["full_path"]], (r["image_id"], r["full_path"])
    far = want["/far.bin"]
    for at in (0, 300 * 1024 - 100, 66000 * 1024 - 50, len(far) - 10):
        for r in FL.range_read(small.where("full_path = '/far.bin'"), parts.where("full_path = '/far.bin'"), at, 2000).collect():
            assert bytes(r["content"]) == far[at : at + 2000], (r["image_id"], at)
    total = parts.groupBy("image_id", "full_path").agg(F.sum("data_len").alias("n"), F.max("size").alias("size"))
    assert total.where("n <> size").count() == 0
    assert parts.where("full_path = '/sparse.bin' and sparse and seq = 1").count() == 8
    assert {r["slack_size"] for r in image_set.slack.where("image_id = 'ext4_1024.fs' and full_path = '/sub/deep/x.txt'").collect()} == {1021}


def test_hash_directories(image_set, images):
    dx = image_set.dx_entry.where("image_id = 'indexed.fs'").collect()
    assert dx and {r["dot_inode"] for r in dx} == {r["dir_inode"] for r in dx}
    n = image_set.entry.where("parent_path = '/big'").groupBy("image_id").count().collect()
    assert {r["count"] for r in n} == {400}


def test_lookups(image_set, spark, images):
    one = ImageSet(spark, str(images[0] / "ext3_4096.fs"))
    assert one.open("1024byte.txt") == b"C" * 1024
    assert one.open("/8192byte.txt", number_of_bytes=10) == b"C" * 10
    assert one.open("/empty.txt") == b""
    assert one.read_range("/sparse.bin", 5 * 4096 - 2, 4) == b"\0\0SS"
    assert one.is_file("/link") is False and one.is_directory("/sub")
    assert one.get_file_permissions("/sub/deep/x.txt")["setuid"]
    assert one.get_file_size("/4096byte.txt") == 4096
    assert one.slack_space_size("/512byte.txt") == 3584 and len(one.slack_open("/512byte.txt")) == 3584
    assert {r["name"] for r in one.get_directory_contents("/sub").collect()} == {"deep", "käse.txt"}
    assert one.get_directory_contents("/").count() == 15
    with pytest.raises(KeyError):
        one.get_directory_contents("/nowhere")
    with pytest.raises(RuntimeError):
        one.is_file("/nowhere")
    with pytest.raises(RuntimeError):
        one.open("/sub")


def test_handle(spark, images):
    one = ImageSet(spark, str(images[0] / "ext4_4096.fs"))
    want = (images[1] / "long.bin").read_bytes()
    with one.handle("/long.bin") as h:
        assert len(h) == 700_000 and h.seek(-10, 2) == 699_990 and h.read() == want[-10:] and h.read(5) == b""
        assert h.seek(4090) == 4090 and h.read(20) == want[4090:4110] and h.tell() == 4110
        assert h.seek(10, 1) == 4120 and h.read(3) == want[4120:4123]
        with pytest.raises(ValueError):
            h.seek(-1)
        with pytest.raises(ValueError):
            h.read(-2)


def test_written_images(spark, tmp_path):
    """Images of the writer: fragmented extent trees of depth 1, indirect and double indirect maps, several groups, empty files."""
    import random

    from blockloom.sources.imagewriter import write_images

    rng = random.Random(1)
    sizes = [0, 1, 1023, 1024, 1025, 12 * 1024, 13 * 1024, 300_000, 300_001, 700_000, 900_000, 0, 2_000_000, 2_000_000, 5000, 6_000_000, 6_000_000]
    rows = [(k, ("a", "b", "c")[k % 3], f"{k}.bin", bytearray(rng.randbytes(n))) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "key bigint, dir string, name string, content binary")
    made = write_images(df, str(tmp_path / "out"), 30_000_000).collect()
    assert sum(r["n_files"] for r in made) == len(rows)
    s = ImageSet(spark, str(tmp_path / "out"))
    got = {r["full_path"]: bytes(r["content"]) for r in s.file_content.collect()}
    assert got == {f"/{d}/{n}": bytes(c) for _, d, n, c in rows}
    leaves = {r["depth"]: r["count"] for r in s.extent.groupBy("node_block").count().selectExpr("node_block > 0 as depth", "count").groupBy("depth").count().collect()}
    assert leaves.get(True, 0) > 1
    free = s.group_usage.join(s.group_desc.select("image_id", "group_number", "free_blocks"), ["image_id", "group_number"])
    assert free.count() > 2 and free.where("unallocated <> free_blocks").count() == 0


def test_offset_and_magic(spark, images, tmp_path):
    raw = (images[0] / "ext2_1024.fs").read_bytes()
    (tmp_path / "shifted.fs").write_bytes(b"\xff" * 1048576 + raw)
    moved = ImageSet(spark, str(tmp_path / "shifted.fs"), master_offset=1048576)
    assert moved.open("/2048byte.txt") == b"C" * 2048
    with pytest.raises(Exception, match="magic"):
        ImageSet(spark, str(tmp_path / "shifted.fs")).group_desc.collect()
