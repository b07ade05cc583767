"""Parent-child rows to full hierarchies: path, depth, root, descendants and cycles.

A *link* frame has one row per node that may be a parent: ``tree, image_id, node, parent, label, base``.
``base`` is the path of the root when the parent is a root (its node is not part of the tree), else null.

Paths grow from the roots in frontier joins: what hangs on the frontier of the round before gets its path, and so does what hangs on that. Only the nodes still without one then learn
the labels of twice as many levels above them (a join with themselves), so that the next frontier join reaches twice as far: a tree of depth d takes about log2(d) rounds, and each round
is one written table. Every node below a root is reached by a frontier; those that no frontier reaches lie on a cycle or below one, and for these alone the cycle
and its smallest node come from pointer doubling. Every step is a key join whose lineage is cut
in the shared folder; no step gathers rows of a tree, an image or a directory.

Defined results: a node claimed by several parents keeps the smallest (parent, label) for the way up of what lies below it, while every
claiming row is listed itself. A null parent is a root of its own with the path ``#null``. A null image is an image of
its own. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from blockloom.session import cut

KEY = ("tree", "image_id", "node")
ROOT_INODE = 2


def _live(dirent: DataFrame) -> DataFrame:
    return dirent.where(
        (F.col("inode") != 0)
        & ~F.coalesce(F.col("name").isin(".", ".."), F.lit(False))
        & ~F.coalesce(F.col("file_type_str") == "unknown", F.lit(False))
    )


def _base(tree: str, parent: Column, inode: Column | None = None) -> Column:
    """The root's path if ``parent`` is a root by its number, else null."""
    if tree == "dir":
        return F.when(parent == ROOT_INODE, F.lit(""))
    return F.when(parent == 0, F.concat(F.lit("/"), inode.cast("string")))


def directory_rows(dirent: DataFrame, dx_root: DataFrame) -> DataFrame:
    """Every (node, parent, label) of the directory tree; ``inner``: the row makes its node a directory."""
    entries = _live(dirent).select(
        F.lit("dir").alias("tree"),
        F.coalesce("image_id", F.lit("")).alias("image_id"),
        F.col("inode").cast("long").alias("node"),
        F.col("dir_inode").cast("long").alias("parent"),
        F.coalesce(F.col("name"), F.concat(F.lit("#"), F.col("inode").cast("string"))).alias("label"),
        F.coalesce(F.col("file_type_str") == "directory", F.lit(False)).alias("inner"),
    )
    hashed = (
        dx_root.where(F.col("dir_inode").isNotNull() & (F.col("dir_inode") != ROOT_INODE))
        .groupBy(F.coalesce("image_id", F.lit("")).alias("image_id"), F.col("dir_inode").cast("long").alias("node"))
        .agg(F.min_by(F.col("dotdot_inode").cast("long"), "dx_id").alias("parent"))
    )
    known = entries.where("inner").select("image_id", "node").distinct()
    bare = hashed.join(known, ["image_id", "node"], "left_anti").select(
        F.lit("dir").alias("tree"), "image_id", "node", "parent", F.concat(F.lit("#"), F.col("node").cast("string")).alias("label"), F.lit(True).alias("inner")
    )
    return entries.unionByName(bare).withColumn("base", _base("dir", F.col("parent")))


def extent_rows(extent_idx: DataFrame) -> DataFrame:
    """Every (node, parent, label) of the extent trees; nodes are the blocks that index entries point to."""
    block = (F.coalesce(F.col("ei_leaf_hi"), F.lit(0)).cast("long") * F.lit(4294967296) + F.col("ei_leaf_lo").cast("long")).alias("node")
    return (
        extent_idx.where(F.col("ei_leaf_lo").isNotNull())
        .select(
            F.lit("ext").alias("tree"),
            F.coalesce("image_id", F.lit("")).alias("image_id"),
            block,
            F.col("node_block").cast("long").alias("parent"),
            F.col("inode_number").cast("long").alias("_inode"),
        )
        .select(
            "tree", "image_id", "node", "parent", F.col("node").cast("string").alias("label"), F.lit(True).alias("inner"), _base("ext", F.col("parent"), F.col("_inode")).alias("base")
        )
    )


def tree_rows(dirent: DataFrame, dx_root: DataFrame, extent_idx: DataFrame) -> DataFrame:
    """The distinct rows of both trees, written once: every later step starts from them."""
    return cut(directory_rows(dirent, dx_root).unionByName(extent_rows(extent_idx)).distinct())


def _links(rows: DataFrame) -> DataFrame:
    """One way up per node that some row names as its parent."""
    parents = rows.where("base is null").select("tree", "image_id", F.col("parent").alias("node")).distinct()
    up = rows.where("inner").join(parents, list(KEY), "left_semi")
    one = up.groupBy(*KEY).agg(F.min(F.struct("parent", "label", "base")).alias("u"))
    return one.select(*KEY, "u.parent", "u.label", "u.base")


def _hash_root(parent: Column) -> Column:
    return F.concat(F.lit("#"), F.coalesce(parent.cast("string"), F.lit("null")))


def resolve(links: DataFrame, order: bool = False) -> DataFrame:
    """(tree, image_id, node, path, depth, root, cycle): ``cycle`` is the smallest node of the loop met, else null.

    ``path`` of an unreached node is null. ``root`` is the path of the root (empty for the root directory). With ``order`` the links' column of that name is joined up like the labels,
    as ``order_path``.
    """
    at = ["tree", "image_id", "top"]
    extra = ["order_path"] * order
    named = links.select("tree", "image_id", F.col("node").alias("parent"), F.lit(True).alias("_named"))
    base = F.coalesce("base", F.when(F.col("_named").isNull(), _hash_root(F.col("parent"))))
    up = lambda c: F.concat(F.lit("/"), c)
    own = [up("label").alias("seg")] + [up("order").alias("order_path")] * order
    rooted = links.join(named, ["tree", "image_id", "parent"], "left").select(*KEY, "parent", F.col("parent").alias("top"), *own, base.alias("base"), F.lit(1).alias("depth"))
    # a row is done when its base is known; then seg is the whole way down from it
    frontier, left = _written(rooted)
    done = [frontier.where("base is not null")]
    rest = frontier.where("base is null")
    while left:
        above = done[-1].select("tree", "image_id", F.col("node").alias("top"), *[F.col(c).alias(f"_{c}") for c in ("seg", "base", "depth", *extra)])
        joined = rest.join(above, at, "left")
        longer = lambda t="_": [F.concat(f"{t}{c}", c).alias(c) for c in ("seg", *extra)]
        further = (F.col("depth") + F.col("_depth")).alias("depth")
        reached = joined.where("_base is not null").select(*KEY, "parent", "top", *longer(), F.col("_base").alias("base"), further)
        waiting = joined.where("_base is null").select(*KEY, "parent", "top", "seg", *extra, "base", "depth")
        # the top of a waiting row was waiting itself at the round's start: either the frontier has just reached it, or it lends its own labels
        every = reached.unionByName(waiting)
        upper = every.select("tree", "image_id", F.col("node").alias("top"), F.col("top").alias("_top"), *[F.col(c).alias(f"_{c}") for c in ("seg", "base", "depth", *extra)])
        doubled = waiting.drop("base").join(upper, at).select(*KEY, "parent", F.col("_top").alias("top"), *longer(), F.col("_base").alias("base"), further)
        step, now = _written(reached.unionByName(doubled))
        if now == left:
            break
        done.append(step.where("base is not null"))
        rest, left = step.where("base is null"), now
    out = None
    for part in done:
        one = part.select(*KEY, F.concat("base", "seg").alias("path"), "depth", F.col("base").alias("root"), *extra)
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("cycle", F.lit(None).cast("long"))
    if left:
        none = F.lit(None)
        loops = cycle_of(rest.select(*KEY, "parent"))
        unreached = loops.select(*KEY, none.cast("string").alias("path"), none.cast("int").alias("depth"), none.cast("string").alias("root"), *[none.cast("string").alias(c) for c in extra], "cycle")
        out = out.unionByName(unreached)
    return out


def _written(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` written, and how many of them have no base yet, counted while writing."""
    seen = Observation()
    table = cut(rows.observe(seen, F.count_if(F.col("base").isNull()).alias("open")))
    return table, seen.get["open"]


def cycle_of(links: DataFrame) -> DataFrame:
    """(tree, image_id, node, cycle) for links whose way up never ends: the smallest node on the loop it meets.

    Doubling: after round k ``jump`` is 2^k levels up and ``least`` the smallest of the 2^k nodes passed. The set of jump targets
    shrinks to the nodes on loops; once it no longer shrinks and 2^k covers it, ``least`` at a target is the loop's smallest.
    """
    state = cut(links.select(*KEY, F.col("parent").alias("jump"), F.col("node").alias("least")))
    reach, before, span = _targets(state), -1, 1
    while reach != before or span < reach:
        at = state.select("tree", "image_id", F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("least").alias("_least"))
        state = cut(state.join(at, ["tree", "image_id", "jump"]).select(*KEY, F.col("_jump").alias("jump"), F.least("least", "_least").alias("least")))
        before, reach, span = reach, _targets(state), span * 2
    at = state.select("tree", "image_id", F.col("node").alias("jump"), F.col("least").alias("cycle"))
    return state.join(at, ["tree", "image_id", "jump"]).select(*KEY, "cycle")


def _targets(state: DataFrame) -> int:
    return state.select("tree", "image_id", "jump").distinct().count()


def _full(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    up = resolved.select("tree", "image_id", F.col("node").alias("parent"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("root").alias("_root"), "cycle", F.lit(True).alias("_known"))
    known = F.coalesce(F.col("_known"), F.lit(False))
    root = F.coalesce(F.col("base"), F.when(known, F.col("_root")).otherwise(_hash_root(F.col("parent"))))
    above = F.coalesce(F.col("base"), F.when(known, F.col("_path")).otherwise(_hash_root(F.col("parent"))))
    looped = known & F.col("cycle").isNotNull() & F.col("base").isNull()
    return rows.join(up, ["tree", "image_id", "parent"], "left").select(
        *KEY,
        F.when(looped, F.concat(F.lit("cycle:"), F.col("cycle").cast("string"))).otherwise(F.concat(above, F.lit("/"), F.col("label"))).alias("full_path"),
        F.when(~looped, F.when(F.col("base").isNull() & known, F.col("_depth") + 1).otherwise(1)).alias("depth"),
        F.when(~looped, root).alias("root"),
        "parent",
    )


def hierarchy(dirent: DataFrame, dx_root: DataFrame, extent_idx: DataFrame) -> DataFrame:
    """(tree, image_id, node, full_path, depth, root, parent) of every row of both trees."""
    rows = tree_rows(dirent, dx_root, extent_idx)
    return _full(rows, resolve(_links(rows)))


def paths(dirent: DataFrame, dx_root: DataFrame, extent_idx: DataFrame) -> DataFrame:
    """(tree, image_id, node, full_path), distinct."""
    return hierarchy(dirent, dx_root, extent_idx).select(*KEY, "full_path").distinct()


def ancestor_pairs(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """(tree, image_id, node, ancestor, distance) of every reached inner node, its root included.

    Pairs up to distance 2^k and the node 2^k levels up give the pairs up to 2^(k+1): a join a doubling of depth, and only new pairs are written.
    """
    reached = resolved.where("cycle is null").select(*KEY, "depth")
    jump = cut(links.join(reached, list(KEY)).select(*KEY, F.col("parent").alias("jump"), "depth"))
    deepest = jump.agg(F.max("depth")).first()[0] or 0
    jump = jump.drop("depth")
    pairs, span = jump.select(*KEY, F.col("jump").alias("ancestor"), F.lit(1).alias("distance")), 1
    while span < deepest:
        at = jump.select("tree", "image_id", F.col("node").alias("jump"), F.col("jump").alias("_jump"))
        upper = pairs.select("tree", "image_id", F.col("node").alias("jump"), "ancestor", (F.col("distance") + span).alias("distance"))
        pairs = pairs.unionByName(cut(jump.join(upper, ["tree", "image_id", "jump"]).select(*KEY, "ancestor", "distance")))
        jump = cut(jump.join(at, ["tree", "image_id", "jump"]).select(*KEY, F.col("_jump").alias("jump")))
        span *= 2
    return pairs


def _pairs(dirent: DataFrame, dx_root: DataFrame, extent_idx: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, ancestor pairs of the reached inner nodes)."""
    rows = tree_rows(dirent, dx_root, extent_idx)
    links = cut(_links(rows))
    return rows, links, ancestor_pairs(links, resolve(links))


def descendants(dirent: DataFrame, dx_root: DataFrame, extent_idx: DataFrame) -> DataFrame:
    """(tree, image_id, ancestor, node, distance): every node at any depth below each reached inner node, the root directory and directories without a known parent.

    A listed row is below its parent, and below all that its parent is below. A node listed twice below one keeps its shortest distance. Nodes on or below a loop have no ancestor.
    """
    rows, links, pairs = _pairs(dirent, dx_root, extent_idx)
    own = rows.select(*KEY, "parent", "base")
    above = ["tree", "image_id", "parent"]
    parent_of = pairs.withColumnRenamed("node", "parent")
    free = own.where("base is null").join(links.select("tree", "image_id", F.col("node").alias("parent")), above, "left_anti")
    inner = own.where("base is null").join(parent_of.select(*above).distinct(), above, "left_semi")
    near = own.where("base is not null").unionByName(free).unionByName(inner).select(*KEY, F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    far = inner.join(parent_of, above).select(*KEY, "ancestor", (F.col("distance") + 1).alias("distance"))
    # the top of an extent tree is the inode, no block
    every = near.unionByName(far).where("ancestor is not null and not (tree = 'ext' and ancestor = 0)")
    return every.groupBy("tree", "image_id", "ancestor", "node").agg(F.min("distance").alias("distance"))


def descendant_counts(dirent: DataFrame, dx_root: DataFrame, extent_idx: DataFrame) -> DataFrame:
    """(tree, image_id, node, n_descendants): rows anywhere below each reached inner node that has any.

    Rows are first counted per parent; the counts of all inner nodes below a node, told by the ancestor pairs, and its own add up.
    """
    rows, _, pairs = _pairs(dirent, dx_root, extent_idx)
    own = cut(rows.groupBy("tree", "image_id", F.col("parent").alias("node")).agg(F.count("*").alias("n")))
    below = pairs.join(own, list(KEY)).select("tree", "image_id", F.col("ancestor").alias("node"), "n")
    total = own.unionByName(below).groupBy(*KEY).agg(F.sum("n").alias("n_descendants"))
    return total.join(pairs.select(*KEY).distinct(), list(KEY), "left_semi")
