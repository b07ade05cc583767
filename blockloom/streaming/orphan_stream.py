"""Orphan state and report maintained from a stream of changes.

A change row is a reference or an observation, or the withdrawal of one (``change_rows``). ``fold_batch`` is the body of a ``foreachBatch`` sink: it drops references known already, turns the rest into
signed deltas and merges them with the state. References and key states lie in ``BUCKETS`` buckets by key hash; a batch reads and writes only the buckets it touches, under its own number. A manifest
names the batch that last wrote each bucket; writing it commits the batch, so a repeated batch starts from the same manifest and replaces nothing but its own output. Folders that
neither of the last two manifests names are removed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators import orphans

BUCKETS = 256


def change_rows(refs: DataFrame | None = None, inode: DataFrame | None = None, sign: int = 1) -> DataFrame:
    """References (``orphans.references``) and records as change rows; ``sign`` -1 withdraws them."""
    out = None
    columns = ("ref_table", "ref_id", "image_id", "inode_number", "scan_ts", "loaded_at", "i_dtime")
    for df in (refs, inode):
        if df is None:
            continue
        for c, kind in (("ref_table", "string"), ("ref_id", "bigint"), ("i_dtime", "bigint")):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast(kind))
        one = df.select(*columns).withColumn("sign", F.lit(sign))
        out = one if out is None else out.unionByName(one)
    return out


def _bucket() -> Column:
    return F.pmod(F.xxhash64("image_id", "inode_number"), F.lit(BUCKETS)).cast("int")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    fs, at = _fs(spark, f"{folder}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, folder: str, batch: int) -> dict[str, int]:
    return json.loads(spark.read.text(f"{folder}/manifest/{batch:012d}", wholetext=True).first()[0]) if batch >= 0 else {}


def latest_batch(spark: SparkSession, folder: str) -> int:
    """Number of the newest committed batch, -1 if there is none."""
    return max(_manifests(spark, folder), default=-1)


def _read(spark: SparkSession, folder: str, kind: str, manifest: dict[str, int], schema, buckets: list[int] | None = None) -> DataFrame:
    chosen = {b: n for b, n in manifest.items() if buckets is None or int(b) in set(buckets)}
    paths = [f"{folder}/{kind}/batch={n:012d}/bucket={b}" for b, n in chosen.items()]
    fs_paths = [p for p in paths if _fs(spark, p)[0].exists(_fs(spark, p)[1])]
    return spark.read.schema(schema).parquet(*fs_paths) if fs_paths else spark.createDataFrame([], schema)


def _schemas(changes: DataFrame) -> tuple:
    refs = changes.limit(0).select(*orphans.REFERENCE, *orphans.KEY, "scan_ts", "loaded_at")
    return refs.schema, orphans.fold_deltas(orphans.reference_deltas(refs)).schema


def read_references(spark: SparkSession, folder: str, changes: DataFrame) -> DataFrame:
    return _read(spark, folder, "refs", _manifest(spark, folder, latest_batch(spark, folder)), _schemas(changes)[0])


def read_state(spark: SparkSession, folder: str, changes: DataFrame) -> DataFrame:
    return _read(spark, folder, "keys", _manifest(spark, folder, latest_batch(spark, folder)), _schemas(changes)[1])


def current_report(spark: SparkSession, folder: str, changes: DataFrame) -> DataFrame:
    """The orphan report as of the newest committed batch; ``changes`` gives the column types only."""
    return orphans.orphan_report(read_references(spark, folder, changes), read_state(spark, folder, changes))


def fold_batch(changes: DataFrame, batch: int, folder: str) -> None:
    spark = changes.sparkSession
    before = [n for n in _manifests(spark, folder) if n < batch]
    manifest = _manifest(spark, folder, before[-1] if before else -1)
    changes = changes.persist()
    touched = [r[0] for r in changes.select(_bucket().alias("b")).distinct().collect()]  # at most BUCKETS rows
    ref_schema, key_schema = _schemas(changes)
    known, state = (_read(spark, folder, kind, manifest, schema, touched) for kind, schema in (("refs", ref_schema), ("keys", key_schema)))
    is_ref = F.col("ref_table").isNotNull()
    of = lambda sign, ref: changes.where((F.col("sign") == sign) & (is_ref if ref else ~is_ref))
    one = lambda df: df.groupBy(*orphans.REFERENCE).agg(F.min(F.struct(*orphans.KEY, "scan_ts")).alias("r"), F.min("loaded_at").alias("loaded_at")).select(*orphans.REFERENCE, "r.*", "loaded_at")
    back = of(-1, True).select(*orphans.REFERENCE).distinct()
    # what comes and goes within one batch never was
    new = orphans.new_references(one(of(1, True)), known).join(back, list(orphans.REFERENCE), "left_anti")
    gone = known.join(back, list(orphans.REFERENCE), "left_semi")
    deltas = [
        orphans.reference_deltas(new),
        orphans.reference_deltas(gone, -1),
        orphans.existence_deltas(orphans.observe(of(1, False).join(of(-1, False).select(*orphans.KEY).distinct(), list(orphans.KEY), "left_anti")), state),
        orphans.existence_deltas(orphans.observe(of(-1, False)), state, withdrawn=True),
    ]
    merged = orphans.merge_states(state, orphans.fold_deltas(*deltas))
    kept = known.join(back, list(orphans.REFERENCE), "left_anti").unionByName(new)
    for kind, df in (("refs", kept), ("keys", merged)):
        df.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{kind}/batch={batch:012d}")
    manifest = {**manifest, **{str(b): batch for b in touched}}
    fs, at = _fs(spark, f"{folder}/manifest/{batch:012d}")
    part = at.suffix(".part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(part, at)
    changes.unpersist()
    _clean(spark, folder, batch)


def _clean(spark: SparkSession, folder: str, batch: int) -> None:
    numbers = [n for n in _manifests(spark, folder) if n <= batch]
    alive = {(b, n) for k in numbers[-2:] for b, n in _manifest(spark, folder, k).items()}
    for k in numbers[:-2]:
        fs, at = _fs(spark, f"{folder}/manifest/{k:012d}")
        fs.delete(at, False)
    for kind in ("refs", "keys"):
        fs, at = _fs(spark, f"{folder}/{kind}")
        for of in fs.listStatus(at):
            name = of.getPath().getName()
            if not name.startswith("batch=") or int(name[6:]) > batch:
                continue
            buckets = [s.getPath() for s in fs.listStatus(of.getPath()) if s.getPath().getName().startswith("bucket=")]
            dead = [p for p in buckets if (p.getName()[7:], int(name[6:])) not in alive]
            for p in dead:
                fs.delete(p, True)
            if len(dead) == len(buckets):
                fs.delete(of.getPath(), True)


def maintain(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start keeping the state of a stream of change rows (``change_rows``)."""
    return changes.writeStream.foreachBatch(lambda df, n: fold_batch(df, n, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_per_window(records: DataFrame, duration: str = "1 day", late: str = "10 days") -> DataFrame:
    """Records per event-time window of ``scan_ts``; rows later than ``late`` behind the newest are left out of their window."""
    timed = records.withColumn("event_ts", F.col("scan_ts").cast("timestamp")).withWatermark("event_ts", late)
    return timed.groupBy(F.window("event_ts", duration).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")
