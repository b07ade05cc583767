"""The entry without the text subpackage, and the folder for written tables."""

import os
import subprocess
import sys

import pytest

from blockloom import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_goes_on_without_text_operators():
    """Whatever the text operators lack, the other queries are there."""
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("blockloom.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
names = set(e.queries())
assert {"p1_found", "p2_found", "p5_found", "files_listing"} <= names and not names & {"p3_found", "p8_found"}, names
assert set(e.oracle_sql()) <= names
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


class _Session:
    """As much of a session as ``shared_dir`` asks of one."""

    def __init__(self, master, folder=None):
        self._folder = folder
        self.conf = self
        self.sparkContext = self
        self.master = master

    def get(self, key, default=None):
        return self._folder or default

    def getConf(self):
        return self


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session(master))
    assert session.shared_dir(_Session(master, "hdfs://x/shared")) == "hdfs://x/shared"


def test_local_masters():
    assert all(map(session.is_local, ("local", "local[8]", "local[*]", "local[4, 2]")))
    assert not any(map(session.is_local, ("local-cluster[3,2,1024]", "yarn", "")))
