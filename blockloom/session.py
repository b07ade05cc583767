"""Session helpers: one place that knows how lineage is cut and where files go."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def get_spark(app: str = "blockloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you have."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once a session; they need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_blockloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="blockloom-code-")) / "blockloom_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._blockloom_shipped = True


def is_local(master: str) -> bool:
    """Whether executors run inside this process (``local``, ``local[8]``, ``local[*, 3]``), not merely on this machine."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one where none is set and all executors are threads of this process."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to
    if not is_local(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_blockloom_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="blockloom-")
        spark.sparkContext._blockloom_dir = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: no lineage, true sizes, survives lost executors.

    A written table rather than ``checkpoint()``: the latter keeps the plan's constraints, whose number doubles with every self join of a
    loop. ``release`` removes the tables; at the end of the process that happens by itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/blockloom/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release, spark)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove all tables that ``cut`` wrote; frames made from them can't be read any more."""
    try:
        jvm = spark.sparkContext._jvm
        while _written:
            at = jvm.org.apache.hadoop.fs.Path(_written.pop())
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone already
        _written.clear()


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder, only ``columns`` if any are given."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
