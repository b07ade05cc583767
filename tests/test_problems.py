"""The general problems against brute force on small tables, with nulls, repeats, ties, empty tables and extra columns."""

import datetime as dt
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.operators import hierarchy, intervals, orphans
from blockloom.streaming import orphan_stream

T = lambda d: dt.datetime(2023, 1, 1) + dt.timedelta(days=d)
NTZ = "timestamp_ntz"
DIRENT = f"entry_id bigint, image_id string, dir_inode bigint, inode bigint, file_type_str string, name string, scan_ts {NTZ}, loaded_at {NTZ}, reason string"
DX = f"dx_id bigint, image_id string, dir_inode bigint, dot_inode bigint, dotdot_inode bigint, scan_ts {NTZ}, loaded_at {NTZ}"
INODE = f"image_id string, inode_number bigint, i_dtime bigint, scan_ts {NTZ}, loaded_at {NTZ}, ref_count int"
IDX = "idx_id bigint, image_id string, inode_number bigint, node_block bigint, ei_leaf_lo bigint, ei_leaf_hi int"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_orphans(spark):
    e = lambda i, inode, loaded=5, img="a", scan=0: (i, img, 2, inode, "file", "n", T(scan), None if loaded is None else T(loaded), "x")
    entries = [e(1, 20), e(1, 20, 9), e(2, 21), e(3, 22), e(4, 23), e(5, 10), e(6, None), e(7, 20, img=None), e(8, 24, None), e(9, 22, 1, scan=40), e(10, 30)]
    roots = [(1, "a", 5, 99, 2, T(0), T(5)), (2, "a", 5, None, 2, T(0), T(5))]
    inodes = [("a", 20, 0, T(0), T(1), 0), ("a", 21, 0, T(0), T(1), 0), ("a", 21, 77, T(3), T(4), 0), ("a", 22, None, T(0), T(3), 0), ("a", 22, 0, T(0), T(3), 0), ("a", 24, 0, T(0), T(50), 0),
              ("a", 30, 5, T(1), T(1), 0), ("a", 30, 0, T(1), T(1), 0)]
    d, x, n = spark.createDataFrame(entries, DIRENT), spark.createDataFrame(roots, DX), spark.createDataFrame(inodes, INODE)
    got = _rows(orphans.find_orphans(d, x, n))
    assert got == sorted(
        [("dirent", 2, "deleted", "2023-01"), ("dirent", 4, "missing", "2023-01"), ("dirent", 7, "missing", "2023-01"), ("dirent", 9, "late", "2023-02"), ("dirent", 10, "deleted", "2023-01"),
         ("dx_root", 1, "missing", "2023-01")], key=str)
    none = orphans.find_orphans(d.limit(0), x.limit(0), n.limit(0))
    assert none.count() == 0
    assert orphans.find_orphans(d, x, n.limit(0)).where("reason <> 'missing'").count() == 0


def _state(df):
    return _rows(df.select(*orphans.KEY, "ref_count", "exist_count", "seen_count", "last_seen", "first_loaded"))


def _load(spark, entries, inodes):
    d, x, n = spark.createDataFrame(entries, DIRENT), spark.createDataFrame([], DX), spark.createDataFrame(inodes, INODE)
    return d, x, n


def test_orphan_counts_are_signed_sums(spark):
    """Creation, deletion, return and withdrawal add up over loads; an old observation that comes late changes nothing."""
    obs = lambda *rows: orphans.observe(spark.createDataFrame([("a", n, g, T(t), T(t), 0) for n, g, t in rows], INODE))
    state = orphans.fold_deltas(orphans.existence_deltas(obs((20, 0, 1), (21, 0, 1), (21, 7, 2), (22, 0, 5), (23, 0, 1), (24, 9, 1))))
    counts = lambda s: {r["inode_number"]: (r["exist_count"], r["seen_count"]) for r in s.collect()}
    assert counts(state) == {20: (1, 1), 21: (0, 1), 22: (1, 1), 23: (1, 1), 24: (0, 1)}
    second = orphans.existence_deltas(obs((20, 4, 3), (21, 0, 3), (22, 9, 2), (25, 0, 1), (24, 9, 2)), state)
    assert sorted((r["inode_number"], r["exist_delta"]) for r in second.where("exist_delta <> 0").collect()) == [(20, -1), (21, 1), (25, 1)]
    state = orphans.merge_states(state, orphans.fold_deltas(second))
    assert counts(state) == {20: (0, 1), 21: (1, 1), 22: (1, 1), 23: (1, 1), 24: (0, 1), 25: (1, 1)}
    back = orphans.existence_deltas(obs((23, 0, 1), (24, 9, 1), (99, 0, 1)), state, withdrawn=True)
    state = orphans.merge_states(state, orphans.fold_deltas(back))
    left = counts(state)
    assert left[23] == (0, 0) and left[24] == (0, 0) and 99 not in left
    assert state.where("inode_number in (23, 24) and (last_seen is not null or first_loaded is not null)").count() == 0


def test_orphans_of_two_loads(spark):
    """Two loads merged, records repeated across them, give the report of all rows at once."""
    rng = random.Random(3)
    entries = [(i, "a", 2, rng.randint(11, 40), "file", "n", T(0), T(rng.randint(0, 9)), "") for i in range(200)]
    inodes = [("a", rng.randint(11, 40), rng.choice([0, 0, 9]), T(rng.randint(0, 5)), T(rng.randint(0, 9)), 0) for _ in range(60)]
    # "late" goes by the earliest arrival, so a repeat in the second load arrives later than in the first
    again = [(*e[:7], T(20), "") for e in entries[:50:5]] + [entries[60]]
    want = _rows(orphans.find_orphans(*_load(spark, entries, inodes)))
    got = orphans.orphans_of_two_loads(_load(spark, entries[:120], inodes[:25]), _load(spark, entries[120:] + again, inodes[25:] + inodes[:9]))
    assert len(want) > 20 and _rows(got) == want
    empty = _load(spark, [], [])
    assert _rows(orphans.orphans_of_two_loads(empty, _load(spark, entries, inodes))) == want
    assert _rows(orphans.orphans_of_two_loads(_load(spark, entries, inodes), empty)) == want


def test_orphan_stream(spark, tmp_path):
    """A stream with repeats and withdrawals keeps the state of what is left; old folders go."""
    rng = random.Random(4)
    entry = lambda i, n: (i, "a", 2, n, "file", "n", T(0), T(5), "")
    inode = lambda n, gone, t: ("a", n, gone, T(t), T(1), 0)
    batches = [
        ([entry(i, rng.randint(11, 30)) for i in range(60)], [inode(n, 0, 1) for n in range(11, 26)], 1),
        ([entry(1000, 11), entry(1001, 31)], [inode(12, 8, 2), inode(13, 0, 2), inode(31, 0, 2)], 1),
        ([], [inode(14, 0, 1)], -1),
        ([entry(1001, 31), entry(4242, 12)], [], -1),
    ]
    batches[1][0].extend(batches[0][0][:20])
    (tmp_path / "in").mkdir()
    schema = None
    for k, (e, n, sign) in enumerate(batches):
        refs = orphans.references(spark.createDataFrame(e, DIRENT), "dirent", "entry_id", "inode")
        rows = orphan_stream.change_rows(refs, spark.createDataFrame(n, INODE), sign)
        schema = schema or rows.schema
        rows.coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        next((tmp_path / f"b{k}").glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
    out = str(tmp_path / "out")
    for k in range(4):  # mtime orders the files
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    orphan_stream.maintain(stream, out, str(tmp_path / "chk")).awaitTermination(300)
    assert orphan_stream.latest_batch(spark, out) == 3
    entries = batches[0][0] + [entry(1000, 11)]
    inodes = [n for n in batches[0][1] if n[1] != 14] + batches[1][1]
    want = _rows(orphans.find_orphans(*_load(spark, entries, inodes)))
    sample = spark.createDataFrame([], schema)
    assert _rows(orphan_stream.current_report(spark, out, sample)) == want
    assert {r[2] for r in want} == {"missing", "deleted"}
    state = orphan_stream.read_state(spark, out, sample)
    assert state.where("ref_count < 0 or exist_count not in (0, 1)").count() == 0
    # the batch done once more changes nothing, and at most two manifests are left
    orphan_stream.fold_batch(spark.read.schema(schema).parquet(str(tmp_path / "in" / "3.parquet")), 3, out)
    assert _rows(orphan_stream.current_report(spark, out, sample)) == want
    assert len(list((tmp_path / "out" / "manifest").glob("[0-9]*"))) == 2
    assert len(list((tmp_path / "out" / "keys").glob("batch=*/bucket=*"))) <= 2 * 20


def _brute_paths(entries, roots, idx):
    """Paths by climbing from every row."""
    live = {(i, n, p, name) for _, i, p, n, t, name, *_ in entries if n and name not in (".", "..") and t != "unknown"}
    rows = {("dir", i, n, p, name if name is not None else f"#{n}") for i, n, p, name in live}
    up = {}
    for _, i, p, n, t, name, *_ in entries:
        if n and name not in (".", "..") and t == "directory":
            key, val = ("dir", i, n), (p, name if name is not None else f"#{n}")
            up[key] = min(up.get(key, val), val)
    for _, i, d, _, dd, *_ in sorted(roots):
        if d not in (None, 2) and ("dir", i, d) not in up:
            up[("dir", i, d)] = (dd, f"#{d}")
            rows.add(("dir", i, d, dd, f"#{d}"))
    base = {}
    for _, i, n, p, lo, hi in idx:
        b = lo + hi * 4294967296
        rows.add(("ext", i, b, p, str(b)))
        up[("ext", i, b)] = (p, str(b))
        base[("ext", i, b)] = f"/{n}"
    out = set()
    for tree, i, n, p, label in rows:
        names, at, seen, owner = [label], p, [], ("ext", i, n)
        while True:
            if at == (2 if tree == "dir" else 0):
                out.add((tree, i, n, ("" if tree == "dir" else base[owner]) + "/" + "/".join(reversed(names))))
                break
            key = (tree, i, at)
            if key not in up:
                out.add((tree, i, n, "#" + ("null" if at is None else str(at)) + "/" + "/".join(reversed(names))))
                break
            if at in seen:
                out.add((tree, i, n, f"cycle:{min(seen[seen.index(at):])}"))
                break
            seen.append(at)
            owner = key
            names.append(up[key][1])
            at = up[key][0]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_paths(spark, seed):
    rng = random.Random(seed)
    entries, k = [], 0
    for img in ("a", "b"):
        nodes = list(range(11, 111))
        for n in nodes:
            k += 1
            parent = rng.choice([2, 2, n + 1, n - 1, rng.choice(nodes), 600 + rng.randint(0, 3)])
            kind = rng.choice(["directory"] * 5 + ["file", "unknown", None])
            entries.append((k, img, parent, n, kind, rng.choice([None, f"d{n}", f"d{n}", "é x"]), T(0), T(0), ""))
        for n in range(200, 320):  # a chain longer than several strides
            k += 1
            entries.append((k, img, n - 1 if n > 200 else 2, n, "directory", f"c{n}", T(0), T(0), ""))
        for n in range(400, 450):  # the same under a directory without a known parent, and below a loop
            k += 1
            entries.append((k, img, n - 1 if n > 400 else 900, n, "directory", f"u{n}", T(0), T(0), ""))
        for n in range(2000, 2050):
            k += 1
            entries.append((k, img, n - 1 if n > 2000 else 2003, n, "directory", None, T(0), T(0), ""))
        entries.append(entries[-1])
        entries += [(k + 1, img, 2, 0, "file", "gone", T(0), T(0), ""), (k + 2, img, 2, 2, "directory", ".", T(0), T(0), ""), (k + 3, img, None, 777, "file", "lost", T(0), T(0), "")]
        k += 3
    roots = [(1, "a", 600, 600, 2, T(0), T(0)), (2, "a", 601, 601, 602, T(0), T(0)), (3, "a", 602, None, 601, T(0), T(0)), (4, "b", 603, 9, None, T(0), T(0))]
    idx = [(1, "a", 40, 0, 100, 0), (2, "a", 40, 100, 101, 0), (3, "a", 40, 101, 102, 1), (4, "b", 41, 900, 901, 0), (5, "b", 41, 903, 902, 0), (6, "b", 41, 902, 903, 0), (7, "b", 41, 903, 904, 0), (7, "b", 41, 903, 904, 0)]
    d, x, i = spark.createDataFrame(entries, DIRENT), spark.createDataFrame(roots, DX), spark.createDataFrame(idx, IDX)
    want = _brute_paths(entries, roots, idx)
    got = set(map(tuple, hierarchy.paths(d, x, i).collect()))
    assert got == want
    if seed > 1:
        return
    # as many ancestors as steps on the way, the root of an extent tree and doubly listed nodes apart
    once = {(t, g, n) for t, g, n, _ in want} - {k for k in {(t, g, n) for t, g, n, _ in want} if sum(w[:3] == k for w in want) > 1}
    below = hierarchy.descendants(d, x, i).groupBy("tree", "image_id", "node").agg(F.count("*").alias("k")).collect()
    k = {(r["tree"], r["image_id"], r["node"]): r["k"] for r in below}
    for tree, img, node, path in want:
        if (tree, img, node) in once and "#null" not in path:
            steps = 0 if path.startswith("cycle") else path.count("/") - 2 * (tree == "ext" and not path.startswith("#"))
            assert k.get((tree, img, node), 0) == steps, path


def test_trees_edges(spark):
    d, x, i = spark.createDataFrame([], DIRENT), spark.createDataFrame([], DX), spark.createDataFrame([], IDX)
    assert hierarchy.paths(d, x, i).count() == 0
    assert hierarchy.descendant_counts(d, x, i).count() == 0
    assert hierarchy.descendants(d, x, i).count() == 0
    chain = spark.createDataFrame([(n, "a", n - 1 if n > 11 else 2, n, "directory", f"d{n}", T(0), T(0), "") for n in range(11, 61)], DIRENT)
    counts = {r["node"]: r["n_descendants"] for r in hierarchy.descendant_counts(chain, x, i).collect()}
    assert counts == {n: 60 - n for n in range(11, 60)}
    rows = hierarchy.tree_rows(chain, x, i)
    links = hierarchy._links(rows)
    pairs = hierarchy.ancestor_pairs(links, hierarchy.resolve(links)).where("ancestor > 2")
    assert pairs.count() == 49 * 48 // 2
    assert pairs.where("node - ancestor <> distance").count() == 0
    below = hierarchy.descendants(chain, x, i)
    assert below.count() == 50 * 51 // 2  # the root directory is an ancestor too
    assert below.where("ancestor > 2 and node - ancestor <> distance or ancestor = 2 and node - 10 <> distance").count() == 0


def _brute_ranges(rows):
    """Runs, gaps and clashes block by block."""
    logical, physical = {}, {}
    for _, img, ino, b, n, hi, lo in rows:
        if img is None or ino is None or n is None or n <= 0:
            continue
        n = n - 32768 if n > 32768 else n
        if b is not None:
            logical.setdefault((img, ino), set()).update(range(b, b + n))
        if hi is not None and lo is not None:
            for p in range(hi * 4294967296 + lo, hi * 4294967296 + lo + n):
                physical.setdefault(img, {}).setdefault(p, set()).add(ino)

    def runs(s):
        out = []
        for v in sorted(s):
            if out and out[-1][1] == v:
                out[-1][1] = v + 1
            else:
                out.append([v, v + 1])
        return out

    got = set()
    for (img, ino), s in logical.items():
        r = runs(s)
        got |= {("run", img, ino, a, b) for a, b in r} | {("gap", img, ino, p[1], q[0]) for p, q in zip(r, r[1:])}
    for img, ps in physical.items():
        got |= {("clash", img, 0, a, b) for a, b in runs({p for p, o in ps.items() if len(o) > 1})}
    return got


EXT = "extent_id bigint, image_id string, inode_number bigint, ee_block bigint, ee_len int, ee_start_hi int, ee_start_lo bigint, kind string"


@pytest.mark.parametrize("seed,scale", [(1, 40), (2, 300), (3, 70000)])
def test_ranges(spark, seed, scale):
    rng = random.Random(seed)
    rows = []
    for k in range(250):
        ino = rng.choice([11, 11, 11, 12, 13, None])
        lo = rng.choice([rng.randint(0, scale), rng.randint(65500, 65600)])
        rows.append((k, rng.choice(["a", "a", "b", None]), ino, rng.choice([None, rng.randint(0, scale), rng.randint(65500, 65570)]), rng.choice([None, 0, 1, 2, 5, 17, 64, 32768 + 9]), rng.choice([0, 1]), rng.choice([None, lo])))
    rows += rows[:20] + [(900, "c", 5, 0, 32768, 0, 0), (901, "c", 6, 32768, 32768, 0, 32000), (902, "c", 6, 65536, 32768, 1, 7)]
    df = spark.createDataFrame([(*r, "own") for r in rows], EXT)
    assert set(map(tuple, intervals.extent_ranges(df).collect())) == _brute_ranges(rows)
    assert intervals.extent_ranges(df).count() == len(_brute_ranges(rows))


def test_dyadic_blocks():
    """Canonical blocks: aligned, disjoint, no two siblings, and together the interval."""
    rng = random.Random(1)
    pairs = [(0, 1), (0, 64), (1, 64), (0, 63), (31, 33), (5, 6)] + [tuple(sorted(rng.sample(range(65), 2))) for _ in range(300)]
    s, e = (np.array(x, np.int64) for x in zip(*pairs))
    which, level, start = intervals.dyadic_blocks(s, e, 6)
    for k, (a, b) in enumerate(pairs):
        own = sorted((int(x), int(lv)) for w, lv, x in zip(which, level, start) if w == k)
        assert all(x % (1 << lv) == 0 for x, lv in own)
        assert [p for x, lv in own for p in range(x, x + (1 << lv))] == list(range(a, b))
        assert not any(l1 == l2 and x2 == x1 + (1 << l1) and (x1 >> l1) % 2 == 0 for (x1, l1), (x2, l2) in zip(own, own[1:]))


def test_hot_cells_and_small_batches(spark, monkeypatch):
    """One cell with most pieces, worked off a few rows at a time, gives the same runs and clashes; starts may be negative."""
    rng = random.Random(7)
    rows = [("h", a := rng.randint(-70_000, 3000), a + rng.choice([0, 1, 3, 40, 900]), rng.randint(1, 3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "entity string, s bigint, e bigint, owner bigint")
    covered, owners = set(), {}
    for _, a, b, o in rows:
        covered.update(range(a, b))
        for p in range(a, b):
            owners.setdefault(p, set()).add(o)

    def runs(points):
        out = []
        for v in sorted(points):
            if out and out[-1][1] == v:
                out[-1][1] = v + 1
            else:
                out.append([v, v + 1])
        return [tuple(r) for r in out]

    want, clash = runs(covered), runs({p for p, o in owners.items() if len(o) > 1})
    monkeypatch.setattr(intervals, "HOT_PIECES", 50)
    got = intervals.merge_intervals(df.select("entity", "s", "e")).collect()
    assert sorted((r["run_start"], r["run_end"]) for r in got if r["kind"] == "run") == want
    assert sorted((r["run_start"], r["run_end"]) for r in got if r["kind"] == "gap") == [(p[1], q[0]) for p, q in zip(want, want[1:])]
    assert sorted((r["run_start"], r["run_end"]) for r in intervals.merge_intervals(df, "owner").collect()) == clash
    # the same functions, ten rows at a time
    table = pa.table({"entity": ["h"] * 500, "cell": [0] * 500, "s": pa.array([i % 97 * 3 for i in range(500)], pa.int32()), "e": pa.array([i % 97 * 3 + 2 for i in range(500)], pa.int32())})
    whole = intervals._cell_runs(table, 16, False).to_pydict()
    pieces = list(intervals._pieces(16, False, 10)(iter(table.to_batches(max_chunksize=7))))
    assert len(pieces) == 1 and pieces[0].to_pydict() == whole
    before = pa.Table.from_batches(intervals._before(16, False, 100)(iter(table.to_batches(max_chunksize=7))))
    assert before.num_rows < 500 and intervals._cell_runs(before, 16, False).to_pydict()["run_start"] == whole["run_start"]


def test_intervals_long_and_hot(spark):
    """Intervals over many cells, and one entity with most rows."""
    df = spark.createDataFrame([("e", 0, 1 << 20), ("e", (1 << 20) + 5, (1 << 20) + 6), ("f", 3, 3), ("f", 9, 4)], "entity string, s bigint, e bigint")
    assert _rows(intervals.merge_intervals(df)) == [("e", "gap", 1 << 20, (1 << 20) + 5), ("e", "run", 0, 1 << 20), ("e", "run", (1 << 20) + 5, (1 << 20) + 6)]
    hot = spark.range(60_000).select(F.lit("h").alias("entity"), (F.col("id") * 3).alias("s"), (F.col("id") * 3 + 2).alias("e"))
    got = intervals.merge_intervals(hot)
    assert got.groupBy("kind").count().orderBy("kind").collect() == [("gap", 59_999), ("run", 60_000)]
    assert intervals.merge_intervals(hot.limit(0)).count() == 0
