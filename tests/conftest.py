import os
import shutil
import subprocess

import pytest

from blockloom.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", cpus=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def images(tmp_path_factory):
    """Folder of ext2/3/4 images made by mkfs from one source folder, and that folder."""
    if not shutil.which("mkfs.ext4"):
        pytest.skip("e2fsprogs is absent")
    root = tmp_path_factory.mktemp("ext")
    src = root / "src"
    (src / "sub" / "deep").mkdir(parents=True)
    (src / "big").mkdir()
    for n in (512, 1024, 2048, 4096, 8192):
        (src / f"{n}byte.txt").write_bytes(b"C" * n)
    os.symlink("512byte.txt", src / "link")
    os.link(src / "512byte.txt", src / "hard.txt")
    os.mkfifo(src / "pipe")
    (src / "empty.txt").write_bytes(b"")
    (src / "sub" / "deep" / "x.txt").write_bytes(b"hi\n")
    (src / "sub" / "käse.txt").write_bytes(b"cheese")
    os.chmod(src / "sub" / "deep" / "x.txt", 0o4751)
    with open(src / "sparse.bin", "wb") as f:
        f.seek(5 * 4096)
        f.write(b"S" * 4096)
        f.seek(40 * 4096)
        f.write(b"T" * 100)
    with open(src / "far.bin", "wb") as f:  # reaches the double and triple indirect blocks of 1 KiB block maps
        for at in (0, 300 * 1024, 66000 * 1024):
            f.seek(at)
            f.write(bytes([65 + at % 7]) * 1500)
    (src / "long.bin").write_bytes(os.urandom(700_000))
    for i in range(400):
        (src / "big" / f"an_entry_with_a_rather_long_name_{i:04d}").write_bytes(b"")
    out = root / "images"
    out.mkdir()
    for kind in ("ext2", "ext3", "ext4"):
        for bs in (1024, 4096):
            subprocess.run([f"mkfs.{kind}", "-q", "-F", "-b", str(bs), "-d", str(src), str(out / f"{kind}_{bs}.fs"), "24M"], check=True, capture_output=True)
    subprocess.run(["mkfs.ext2", "-q", "-F", "-O", "^filetype", "-b", "2048", "-d", str(src), str(out / "nofiletype.fs"), "24M"], check=True, capture_output=True)
    shutil.copy(out / "ext4_1024.fs", out / "indexed.fs")
    subprocess.run(["e2fsck", "-fyD", str(out / "indexed.fs")], capture_output=True)
    return out, src
