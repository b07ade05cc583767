"""References to records that do not exist.

Everything that happens to a reference or a record is a *change delta* on the key it concerns: a reference adds +1 to the key's reference count, a
withdrawn one -1; a record's first observation adds +1 to the key's existence count, its deletion -1, its return +1, its withdrawal takes back what the
state holds. Deltas are summed to one state row per key, and states of two loads are summed likewise (``merge_states``), so a later load never reads old
data again. A key with a positive reference count and an existence count of zero is an orphan; ``orphan_report`` joins the few such keys back to
the references that name them.

A record is told from its observations: ``observe`` keeps the newest one of a load per key, ``existence_deltas`` compares it with what the state knows and turns the difference into signed
deltas. An observation older than the one known changes nothing.

State columns, one row per key: ``ref_count``, ``exist_count``, ``seen_count`` (signed sums; the last one counts that the record was ever there), ``first_loaded`` (earliest arrival of the record),
``last_seen`` (newest observation), ``first_ref`` (earliest arrival of a reference).

Defined results: references that are null or below ``least`` are none. Repeated records (same id) count once, with their earliest arrival, also across loads (``new_references``); a withdrawal of
an unknown reference or record counts nothing. Of several observations with the same newest ``scan_ts`` the one with the largest deletion time counts; a null deletion time is 0, a null
``scan_ts`` older than any other. A null arrival is never late, and a record whose arrivals are all null is never the cause of "late". A reference
whose image is null is ``missing``. Empty tables give an empty report; columns other than those named are ignored.
Hot keys: all counts combine on the map side, and the join back has one row per key on its right side, so
that adaptive execution may split the partitions of a hot key on the left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("image_id", "inode_number")
REFERENCE = ("ref_table", "ref_id")
LEAST_INODE = 11


def references(table: DataFrame, ref_table: str, id_column: str, key_column: str, least: int = LEAST_INODE) -> DataFrame:
    """(ref_table, ref_id, image_id, inode_number, scan_ts, loaded_at), one row per referring record."""
    return (
        table.where(F.col(key_column) >= least)
        .groupBy(F.col(id_column).cast("long").alias("ref_id"))
        .agg(
            F.min(F.struct(F.col("image_id"), F.col(key_column).cast("long").alias("inode_number"), F.col("scan_ts"))).alias("r"),
            F.min("loaded_at").alias("loaded_at"),
        )
        .select(F.lit(ref_table).alias("ref_table"), "ref_id", "r.image_id", "r.inode_number", "r.scan_ts", "loaded_at")
    )


def new_references(refs: DataFrame, known: DataFrame) -> DataFrame:
    """The references of a load that no earlier load had."""
    return refs.join(known.select(*REFERENCE), list(REFERENCE), "left_anti")


def _no(kind: str, name: str) -> Column:
    return F.lit(None).cast(kind).alias(name)


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """+1 (or -1 for withdrawn references) on the key of each reference."""
    zero = F.lit(0).cast("long")
    return refs.select(
        *KEY,
        F.lit(sign).cast("long").alias("ref_delta"),
        zero.alias("exist_delta"),
        zero.alias("seen_delta"),
        _no(refs.schema["loaded_at"].dataType.simpleString(), "first_loaded"),
        _no(f"struct<scan_ts:{refs.schema['scan_ts'].dataType.simpleString()},gone:bigint>", "last_seen"),
        F.col("loaded_at").alias("first_ref"),
    )


def observe(inode: DataFrame) -> DataFrame:
    """One row per key of a load: its newest observation and its earliest arrival."""
    last = F.struct(F.col("scan_ts").alias("scan_ts"), F.coalesce(F.col("i_dtime").cast("long"), F.lit(0)).alias("gone"))
    return inode.groupBy(F.col("image_id"), F.col("inode_number").cast("long").alias("inode_number")).agg(F.max(last).alias("last_seen"), F.min("loaded_at").alias("first_loaded"))


def existence_deltas(observed: DataFrame, state: DataFrame | None = None, withdrawn: bool = False) -> DataFrame:
    """Signed changes of existence that a load's observations (of ``observe``) mean, given the state before it.

    A new record gives +1, a deletion -1, a return +1, each a row of its own; ``withdrawn``: the records named are taken back with all that was known of them.
    """
    known, was = F.lit(0).cast("long"), F.lit(None).cast(observed.schema["last_seen"].dataType)
    if state is not None:
        before = state.select(F.col("image_id").alias("_i"), F.col("inode_number").alias("_n"), F.col("seen_count").alias("_seen"), F.col("exist_count").alias("_exist"), F.col("last_seen").alias("_was"))
        observed = observed.join(before, F.col("image_id").eqNullSafe(F.col("_i")) & (F.col("inode_number") == F.col("_n")), "left")
        known, was = F.coalesce("_seen", F.lit(0)), F.col("_was")
    if withdrawn:
        rows = observed.where(known > 0) if state is not None else observed.limit(0).withColumns({"_exist": known})
        one = F.array(F.struct(-F.col("_exist").cast("long"), F.lit(-1).cast("long")))
    else:
        alive_before = (known > 0) & ~_dead(was)
        newest = F.greatest("last_seen", was)
        rows = observed
        step = lambda when, exist, seen: F.when(when, F.struct(F.lit(exist).cast("long"), F.lit(seen).cast("long")))
        changes = F.array(
            step(known == 0, 1, 1),
            step(((known == 0) | alive_before) & _dead(newest), -1, 0),
            step((known > 0) & ~alive_before & ~_dead(newest), 1, 0),
            # an observation without news still brings its times
            F.struct(F.lit(0).cast("long"), F.lit(0).cast("long")),
        )
        one = F.filter(changes, lambda c: c.isNotNull())
    return rows.select(*KEY, "last_seen", "first_loaded", F.explode(one).alias("c")).select(
        *KEY, F.lit(0).cast("long").alias("ref_delta"), F.col("c.col1").alias("exist_delta"), F.col("c.col2").alias("seen_delta"), "first_loaded", "last_seen",
        _no(observed.schema["first_loaded"].dataType.simpleString(), "first_ref"),
    )


def _dead(seen: Column) -> Column:
    return F.coalesce(seen.getField("gone") > 0, F.lit(False))


def fold_deltas(*deltas: DataFrame) -> DataFrame:
    """One state row per key from any number of delta frames."""
    return _sum(reduce(DataFrame.unionByName, deltas))


def merge_states(state: DataFrame, later: DataFrame) -> DataFrame:
    """The state after a later load: counts add up, the newest observation and earliest arrivals win. What a withdrawal took back is forgotten."""
    both = state.unionByName(later)
    merged = _sum(both.withColumnsRenamed({"ref_count": "ref_delta", "exist_count": "exist_delta", "seen_count": "seen_delta"}))
    return merged.withColumns({c: F.when(F.col("seen_count") != 0, F.col(c)) for c in ("last_seen", "first_loaded")})


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(
        F.sum("ref_delta").alias("ref_count"),
        F.sum("exist_delta").alias("exist_count"),
        F.sum("seen_delta").alias("seen_count"),
        F.max("last_seen").alias("last_seen"),
        F.min("first_loaded").alias("first_loaded"),
        F.min("first_ref").alias("first_ref"),
    )


def orphan_report(refs: DataFrame, state: DataFrame) -> DataFrame:
    """(ref_table, ref_id, reason, period_ym) of every reference to a missing, deleted or late record."""
    late_key = F.coalesce(F.col("first_loaded") > F.col("first_ref"), F.lit(False))
    flagged = state.where((F.col("ref_count") > 0) & ((F.col("exist_count") == 0) | late_key)).select(
        *KEY, F.col("seen_count").alias("_seen"), (F.col("exist_count") == 0).alias("_gone"), F.col("first_loaded").alias("_first")
    )
    on = F.col("r.image_id").eqNullSafe(F.col("k.image_id")) & (F.col("r.inode_number") == F.col("k.inode_number"))
    reason = (
        F.when((F.col("_seen") == 0) | F.col("r.image_id").isNull(), "missing")
        .when(F.col("_gone"), "deleted")
        .when(F.col("_first") > F.col("loaded_at"), "late")
    )
    return (
        refs.alias("r").join(flagged.alias("k"), on)
        .select("ref_table", "ref_id", reason.alias("reason"), F.date_format("scan_ts", "yyyy-MM").alias("period_ym"))
        .where(F.col("reason").isNotNull())
    )


def all_references(dirent: DataFrame, dx_root: DataFrame) -> DataFrame:
    """The references of directory entries and hash-tree roots to inodes."""
    return references(dirent, "dirent", "entry_id", "inode").unionByName(references(dx_root, "dx_root", "dx_id", "dot_inode"))


def find_orphans(dirent: DataFrame, dx_root: DataFrame, inode: DataFrame) -> DataFrame:
    """The orphan report of directory entries and hash-tree roots against the inode table."""
    refs = all_references(dirent, dx_root)
    return orphan_report(refs, fold_deltas(reference_deltas(refs), existence_deltas(observe(inode))))


def orphans_of_two_loads(first: tuple[DataFrame, DataFrame, DataFrame], second: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """The same report from two loads of (dirent, dx_root, inode): the second one's deltas are merged into the state of the first."""
    known = all_references(*first[:2])
    state = fold_deltas(reference_deltas(known), existence_deltas(observe(first[2])))
    more = new_references(all_references(*second[:2]), known)
    later = fold_deltas(reference_deltas(more), existence_deltas(observe(second[2]), state))
    return orphan_report(known.unionByName(more), merge_states(state, later))


def orphans_by_period(report: DataFrame) -> DataFrame:
    """Orphan references per table, month and reason."""
    return report.groupBy("ref_table", "period_ym", "reason").agg(F.count("*").alias("n_refs"))
