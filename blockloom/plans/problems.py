"""The pN_ queries of the general problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import hierarchy, intervals, orphans
from blockloom.session import read_table

#: The instant that parts the loads of ``p1_two_loads``.
SECOND_LOAD = "2024-03-01 00:00:00"
_DIRENT = ("entry_id", "image_id", "dir_inode", "inode", "file_type_str", "name")
_DX = ("dx_id", "image_id", "dir_inode", "dotdot_inode")
_IDX = ("idx_id", "image_id", "inode_number", "node_block", "ei_leaf_lo", "ei_leaf_hi")
_EXTENT = ("extent_id", "image_id", "inode_number", "ee_block", "ee_len", "ee_start_hi", "ee_start_lo")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(
        read_table(spark, d, "dirent", "entry_id", "image_id", "inode", "scan_ts", "loaded_at"),
        read_table(spark, d, "dx_root", "dx_id", "image_id", "dot_inode", "scan_ts", "loaded_at"),
        read_table(spark, d, "inode", "image_id", "inode_number", "i_dtime", "scan_ts", "loaded_at"),
    )


def p1_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_period(p1_found(spark, d))


def p1_two_loads(spark: SparkSession, d: str) -> DataFrame:
    """The report of ``p1_found``, from the state after the rows that arrived before ``SECOND_LOAD``, merged with the deltas of the later ones."""
    tables = (
        read_table(spark, d, "dirent", "entry_id", "image_id", "inode", "scan_ts", "loaded_at"),
        read_table(spark, d, "dx_root", "dx_id", "image_id", "dot_inode", "scan_ts", "loaded_at"),
        read_table(spark, d, "inode", "image_id", "inode_number", "i_dtime", "scan_ts", "loaded_at"),
    )
    early = F.coalesce(F.col("loaded_at") < F.lit(SECOND_LOAD).cast("timestamp_ntz"), F.lit(False))
    return orphans.orphans_of_two_loads(tuple(t.where(early) for t in tables), tuple(t.where(~early) for t in tables))


def _trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return read_table(spark, d, "dirent", *_DIRENT), read_table(spark, d, "dx_root", *_DX), read_table(spark, d, "extent_idx", *_IDX)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(*_trees(spark, d))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(*_trees(spark, d))


def p2_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendant_counts(*_trees(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.extent_ranges(read_table(spark, d, "extent", *_EXTENT))


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """Blocks covered, missing and claimed twice, per image."""
    found = p5_found(spark, d)
    return found.groupBy("image_id", "kind").agg(F.count("*").alias("n_ranges"), F.sum(F.col("block_end") - F.col("block_start")).alias("n_blocks"))


QUERIES = {f.__name__: f for f in (p1_found, p1_by_period, p1_two_loads, p2_found, p2_descendants, p2_descendant_counts, p5_found, p5_totals)}

_P1 = """
WITH refs AS (
  SELECT 'dirent' AS ref_table, entry_id AS ref_id, image_id, inode AS n, min(scan_ts) AS scan_ts, min(loaded_at) AS loaded_at
  FROM dirent WHERE inode >= 11 GROUP BY ALL
  UNION ALL
  SELECT 'dx_root', dx_id, image_id, dot_inode, min(scan_ts), min(loaded_at) FROM dx_root WHERE dot_inode >= 11 GROUP BY ALL),
have AS (
  SELECT image_id, inode_number AS n, min(loaded_at) AS first_loaded, max(struct_pack(t := scan_ts, gone := coalesce(i_dtime, 0))).gone AS gone
  FROM inode GROUP BY 1, 2),
found AS (
  SELECT ref_table, ref_id,
    CASE WHEN h.n IS NULL THEN 'missing' WHEN h.gone > 0 THEN 'deleted' WHEN h.first_loaded > r.loaded_at THEN 'late' END AS reason,
    strftime(r.scan_ts, '%Y-%m') AS period_ym
  FROM refs r LEFT JOIN have h ON r.image_id = h.image_id AND r.n = h.n)
"""

_P2 = """
WITH RECURSIVE live AS (
  SELECT DISTINCT image_id, inode AS node, dir_inode AS parent, coalesce(name, '#' || inode) AS label, file_type_str = 'directory' AS inner_node
  FROM dirent WHERE inode <> 0 AND coalesce(name, '') NOT IN ('.', '..') AND coalesce(file_type_str, '') <> 'unknown'),
bare AS (
  SELECT image_id, dir_inode AS node, min_by(dotdot_inode, dx_id) AS parent, '#' || dir_inode AS label, true AS inner_node FROM dx_root x
  WHERE dir_inode <> 2 AND NOT EXISTS (SELECT 1 FROM live l WHERE l.inner_node AND l.image_id = x.image_id AND l.node = x.dir_inode)
  GROUP BY image_id, dir_inode),
trees AS (
  SELECT 'dir' AS tree, image_id, node, parent, label, inner_node, CASE WHEN parent = 2 THEN '' END AS base FROM live
  UNION ALL SELECT 'dir', image_id, node, parent, label, inner_node, CASE WHEN parent = 2 THEN '' END FROM bare
  UNION ALL SELECT DISTINCT 'ext', image_id, ei_leaf_hi * 4294967296 + ei_leaf_lo, node_block, (ei_leaf_hi * 4294967296 + ei_leaf_lo) || '', true,
    CASE WHEN node_block = 0 THEN '/' || inode_number END FROM extent_idx),
up AS (SELECT tree, image_id, node, min(parent) AS parent, min_by(label, parent) AS label, min_by(coalesce(base, 'x'), parent) AS base0 FROM trees WHERE inner_node GROUP BY ALL),
based AS (
  SELECT t.*, CASE WHEN t.base IS NOT NULL THEN t.base WHEN u.node IS NULL THEN '#' || t.parent END AS root
  FROM trees t LEFT JOIN up u ON t.tree = u.tree AND t.image_id = u.image_id AND t.parent = u.node),
walk AS (
  SELECT tree, image_id, node, label, inner_node, root || '/' || label AS full_path, 1 AS depth FROM based WHERE root IS NOT NULL
  UNION ALL
  SELECT b.tree, b.image_id, b.node, b.label, b.inner_node, w.full_path || '/' || b.label, w.depth + 1
  FROM based b JOIN walk w ON b.root IS NULL AND b.tree = w.tree AND b.image_id = w.image_id AND b.parent = w.node AND w.inner_node),
lost AS (
  SELECT b.* FROM based b WHERE b.root IS NULL AND NOT EXISTS (
    SELECT 1 FROM walk w WHERE w.tree = b.tree AND w.image_id = b.image_id AND w.inner_node AND w.node = b.parent)),
climb AS (
  SELECT DISTINCT tree, image_id, node AS origin, parent AS here, [node] AS seen FROM lost WHERE inner_node
  UNION ALL
  SELECT c.tree, c.image_id, c.origin, u.parent, list_append(c.seen, c.here)
  FROM climb c JOIN up u ON c.tree = u.tree AND c.image_id = u.image_id AND c.here = u.node WHERE NOT list_contains(c.seen, c.here)),
loops AS (
  SELECT tree, image_id, origin, list_min(list_slice(seen, list_position(seen, here), len(seen))) AS least FROM climb WHERE list_contains(seen, here))
"""

_RUNS = """
WITH ext AS (
  SELECT DISTINCT image_id, inode_number, ee_block AS s, ee_start_hi * 4294967296 + ee_start_lo AS p, CASE WHEN ee_len > 32768 THEN ee_len - 32768 ELSE ee_len END AS n
  FROM extent WHERE ee_len > 0),
log0 AS (SELECT *, max(s + n) OVER w AS before FROM (SELECT DISTINCT image_id, inode_number, s, n FROM ext WHERE s IS NOT NULL)
  WINDOW w AS (PARTITION BY image_id, inode_number ORDER BY s, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
log1 AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, inode_number ORDER BY s, n ROWS UNBOUNDED PRECEDING) AS g FROM log0),
runs AS (SELECT image_id, inode_number, min(s) AS a, max(s + n) AS b FROM log1 GROUP BY image_id, inode_number, g),
gaps AS (SELECT image_id, inode_number, lag(b) OVER (PARTITION BY image_id, inode_number ORDER BY a) AS a, a AS b FROM runs),
phy0 AS (SELECT *, max(p + n) OVER w AS before FROM (SELECT DISTINCT image_id, inode_number, p, n FROM ext WHERE p IS NOT NULL)
  WINDOW w AS (PARTITION BY image_id, inode_number ORDER BY p, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
phy1 AS (SELECT *, sum(CASE WHEN before IS NULL OR p > before THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, inode_number ORDER BY p, n ROWS UNBOUNDED PRECEDING) AS g FROM phy0),
own AS (SELECT image_id, inode_number, min(p) AS a, max(p + n) AS b FROM phy1 GROUP BY image_id, inode_number, g),
ends AS (SELECT image_id, a AS x, 1 AS d FROM own UNION ALL SELECT image_id, b, -1 FROM own),
steps AS (SELECT image_id, x, sum(sum(d)) OVER (PARTITION BY image_id ORDER BY x) AS depth, lead(x) OVER (PARTITION BY image_id ORDER BY x) AS nx FROM ends GROUP BY image_id, x),
dup AS (SELECT *, sum(CASE WHEN prev = x THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY x) AS g
  FROM (SELECT *, lag(nx) OVER (PARTITION BY image_id ORDER BY x) AS prev FROM steps WHERE depth > 1)),
found AS (
  SELECT 'run' AS kind, image_id, inode_number, a AS block_start, b AS block_end FROM runs
  UNION ALL SELECT 'gap', image_id, inode_number, a, b FROM gaps WHERE a IS NOT NULL
  UNION ALL SELECT 'clash', image_id, 0, min(x), max(nx) FROM dup GROUP BY image_id, g)
"""

SQL = {
    "p1_found": _P1 + "SELECT * FROM found WHERE reason IS NOT NULL",
    "p1_two_loads": _P1 + "SELECT * FROM found WHERE reason IS NOT NULL",
    "p1_by_period": _P1 + "SELECT ref_table, period_ym, reason, count(*) AS n_refs FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p2_found": _P2
    + """SELECT DISTINCT tree, image_id, node, full_path FROM (
  SELECT tree, image_id, node, full_path FROM walk
  UNION ALL SELECT l.tree, l.image_id, l.node, 'cycle:' || o.least FROM lost l JOIN loops o ON l.tree = o.tree AND l.image_id = o.image_id AND l.parent = o.origin)""",
    "p2_descendants": _P2
    + """, chain AS (
  SELECT tree, image_id, node, parent AS ancestor, 1 AS distance FROM based b
  WHERE b.root IS NOT NULL OR EXISTS (SELECT 1 FROM walk w WHERE w.tree = b.tree AND w.image_id = b.image_id AND w.inner_node AND w.node = b.parent)
  UNION ALL
  SELECT c.tree, c.image_id, c.node, u.parent, c.distance + 1 FROM chain c JOIN up u ON u.tree = c.tree AND u.image_id = c.image_id AND u.node = c.ancestor
  WHERE c.ancestor <> CASE c.tree WHEN 'dir' THEN 2 ELSE 0 END)
SELECT tree, image_id, ancestor, node, min(distance) AS distance FROM chain WHERE NOT (tree = 'ext' AND ancestor = 0) GROUP BY ALL""",
    "p2_descendant_counts": _P2
    + """, chain AS (
  SELECT t.tree, t.image_id, u.node AS anc, u.parent AS nx FROM (SELECT DISTINCT * FROM trees) t
  JOIN up u ON u.tree = t.tree AND u.image_id = t.image_id AND u.node = t.parent
  JOIN (SELECT DISTINCT tree, image_id, node FROM walk WHERE inner_node) k ON k.tree = u.tree AND k.image_id = u.image_id AND k.node = u.node
  WHERE t.base IS NULL
  UNION ALL
  SELECT c.tree, c.image_id, u.node, u.parent FROM chain c JOIN up u ON u.tree = c.tree AND u.image_id = c.image_id AND u.node = c.nx)
SELECT tree, image_id, anc AS node, count(*) AS n_descendants FROM chain GROUP BY ALL""",
    "p5_found": _RUNS + "SELECT kind, image_id, inode_number, block_start, block_end FROM found",
    "p5_totals": _RUNS + "SELECT image_id, kind, count(*) AS n_ranges, CAST(sum(block_end - block_start) AS BIGINT) AS n_blocks FROM found GROUP BY ALL",
}
