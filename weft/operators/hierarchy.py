"""Parent-child links to full hierarchies by pointer doubling (problem 6).

Each node starts with a pointer to its parent.  A round replaces the pointer by
the pointer of the node it points to, so jumps double and a tree of depth d is
resolved after log2(d) rounds.  A round in which nothing new is resolved proves
that what is left runs on or into a loop: were there an open node outside loops,
the node half way up its chain would have been resolved in that round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.names import filled, join_on, strip
from weft.session import cut

TREE = ["paper_name", "catalyst_id"]
LINKS = ("synthesis_input", "synthesis_output")
KINDS = ("chemical", "synthesis")
#: Rows of whole trees that one task takes at a time, and from where a bucket is too large for that.
BUCKET_ROWS, HOT_ROWS = 50_000, 400_000
NOTHING, SEP = "\x02", "\x01"
#: Mark before each id of a path.
PATH = "\x03"


def live_nodes(nodes: DataFrame) -> DataFrame:
    """Last row (by loaded_at, row_id) of each node; deleted ones and other types left out."""
    last = nodes.select(*TREE, strip("id").alias("id"), "loaded_at", "row_id", F.struct("op", "type", "synthesis_level").alias("rec")).where(filled(F.col("id")))
    last = last.groupBy(*TREE, "id").agg(F.max_by("rec", F.struct("loaded_at", "row_id")).alias("rec"))
    return last.where(F.coalesce(F.lower("rec.op"), F.lit("add")) != "delete").select(*TREE, "id", "rec.type", "rec.synthesis_level").where(F.col("type").isin(*KINDS))


def parent_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (tree, id, parent) whose ends are both live nodes.

    Should a node have several parents against the contract, the smallest id is
    taken, so that the result stays one row per node.
    """
    links = edges.where(F.lower(strip("type")).isin(*LINKS)).select(*TREE, strip("source_id").alias("id"), strip("target_id").alias("parent")).where(filled(F.col("id")) & filled(F.col("parent")))
    links = links.groupBy(*TREE, "id").agg(F.collect_set("parent").alias("parents")).select(*TREE, "id", F.explode("parents").alias("parent"))
    keys = nodes.select(*TREE, F.col("id").alias("parent"))
    links = join_on(links, keys, [*TREE, "parent"], "left_semi")
    return links.groupBy(*TREE, "id").agg(F.min("parent").alias("parent"))


def resolve(nodes: DataFrame, links: DataFrame, with_paths: bool = False) -> DataFrame:
    """Root and depth (and path from the root) of every node.

    ``nodes``: tree columns and id, unique; ``links``: tree columns, id, parent,
    at most one row per id.  A node on a loop, or below one, has root ``''``,
    depth -1 and, with paths, an empty path.  Rounds are logarithmic in depth.
    """
    seg = [F.array("id").alias("path")] if with_paths else []
    state = join_on(nodes.select(*TREE, "id"), links, [*TREE, "id"], "left")
    state = cut(state.select(
        *TREE, "id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.col("id")).alias("root_id"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), *seg,
    ))
    done, going, left = state.where("up is null"), state.where("up is not null"), None
    while (now := going.count()) and now != left:
        left = now
        ahead = done.unionByName(going).select(*TREE, F.col("id").alias("up"), F.col("up").alias("next_up"), F.col("root_id").alias("next_root"), F.col("depth").alias("more"), *([F.col("path").alias("front")] if with_paths else []))
        moved = cut(join_on(going.drop("root_id"), ahead, [*TREE, "up"], "inner").select(
            *TREE, "id", F.col("next_up").alias("up"), F.col("next_root").alias("root_id"), (F.col("depth") + F.col("more")).alias("depth"),
            *([F.concat("front", "path").alias("path")] if with_paths else []),
        ))
        done, going = done.unionByName(moved.where("up is null")), moved.where("up is not null")
    names = [*TREE, "id", "root_id", "depth", *(["path"] if with_paths else [])]
    loop = going.withColumns({"root_id": F.lit(""), "depth": F.lit(-1).cast("long"), **({"path": F.array().cast("array<string>")} if with_paths else {})})
    return done.select(*names).unionByName(loop.select(*names))


def _double(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Root, depth, path and descendants for a few whole trees at once; pointers are positions in an array.

    A round joins each open node with the node its pointer stands on: the pointer
    jumps twice as far, and that node's path segment goes before its own.
    """
    if not len(nodes):
        return pd.DataFrame()
    tree = lambda t: t["paper_name"].fillna(NOTHING) + SEP + t["catalyst_id"].fillna(NOTHING) + SEP
    index = pd.Index(tree(nodes) + nodes["id"])
    child, parent = index.get_indexer(tree(links) + links["id"]), index.get_indexer(tree(links) + links["parent"])
    real = (child >= 0) & (parent >= 0)
    kept = pd.DataFrame({"child": child[real], "parent": parent[real], "name": links["parent"].to_numpy()[real]})
    kept = kept.sort_values("name", kind="stable").drop_duplicates("child")
    up, depth = np.arange(len(nodes)), np.zeros(len(nodes), dtype="int64")
    up[kept["child"]], depth[kept["child"]] = kept["parent"], 1
    is_root = np.ones(len(nodes), dtype=bool)
    is_root[kept["child"]] = False
    ids, parent_of = nodes["id"].to_numpy(dtype=object), up.copy()
    left, open_ = -1, np.flatnonzero(~is_root[up])
    while len(open_) and len(open_) != left:
        left, ahead = len(open_), up[open_]
        depth[open_], up[open_] = depth[open_] + depth[ahead], up[ahead]
        open_ = np.flatnonzero(~is_root[up])
    loop = ~is_root[up]
    # The same once more with path segments, without the loops, on which they would grow for ever.  A segment
    # begins behind the node that its pointer stands on and ends at the node itself; the root's own comes last.
    path, jump = PATH + ids, parent_of.copy()
    open_ = np.flatnonzero(~is_root[jump] & ~loop)
    while len(open_):
        ahead = jump[open_]
        path[open_], jump[open_] = path[ahead] + path[open_], jump[ahead]
        open_ = open_[~is_root[jump[open_]]]
    below = ~is_root & ~loop
    path[below] = path[up[below]] + path[below]
    # Subtrees are added up from the deepest nodes on.
    size = np.ones(len(nodes), dtype="int64")
    for d in range(int(depth[~loop].max(initial=0)), 0, -1):
        at = np.flatnonzero((depth == d) & ~loop)
        np.add.at(size, parent_of[at], size[at])
    out = nodes[["paper_name", "catalyst_id", "id"]].copy()
    out["root_id"] = np.where(loop, "", ids[up])
    out["depth"] = np.where(loop, -1, depth)
    out["path"] = np.where(loop, "", path)
    out["n_descendants"] = np.where(loop, 0, size - 1)
    step = parent_of[parent_of]
    has = ~loop & (depth > 1)
    out["step_above"] = np.where(has, ids[step], None)
    return out


def hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Root, depth, path, descendants and next step above of every live node of ``tree_nodes`` under ``tree_edges``.

    Returns tree columns, id, root_id, depth, path (ids from the root, each after
    a ``PATH`` mark), n_descendants, step_above.  Trees come together in buckets
    of about ``BUCKET_ROWS`` rows, whose pointers are doubled in one task.  Trees
    in a bucket of more than ``HOT_ROWS`` rows (one that holds a large tree) are
    doubled by joins of tables instead; results are the same.

    Ids are compared without blanks around them; null tree columns compare equal;
    null or empty ids are no node; repeated edges count once; empty tables give
    no rows; other columns are ignored.
    """
    wanted = edges.where(F.lower(strip("type")).isin(*LINKS))
    n = max(1, -(-(nodes.count() + edges.count()) // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(*TREE), F.lit(n)).alias("b")
    ours = nodes.select(bucket, *TREE, strip("id").alias("id"), "loaded_at", "row_id", F.struct("op", "type", "synthesis_level").alias("rec"))
    links = wanted.select(bucket, *TREE, strip("source_id").alias("id"), strip("target_id").alias("parent")).where(filled(F.col("id")) & filled(F.col("parent")))
    sizes = nodes.select(bucket).unionByName(wanted.select(bucket)).groupBy("b").count()
    # Which buckets are large stays a table; it is joined only if there is one.
    hot = cut(sizes.where(F.col("count") > HOT_ROWS).select("b"))
    any_hot = not hot.isEmpty()
    cold = ours.join(hot, "b", "left_anti") if any_hot else ours
    cold_links = links.join(hot, "b", "left_anti") if any_hot else links
    # The shuffle's own number of partitions; a task takes its buckets one after another.
    cold = cold.where(filled(F.col("id"))).repartition("b").groupBy("b", *TREE, "id").agg(F.max_by("rec", F.struct("loaded_at", "row_id")).alias("rec"))
    cold = cold.where(F.coalesce(F.lower("rec.op"), F.lit("add")) != "delete").where(F.col("rec.type").isin(*KINDS)).select("b", *TREE, "id")
    schema = "paper_name string, catalyst_id string, id string, root_id string, depth bigint, path string, n_descendants bigint, step_above string"
    out = cold.groupBy("b").cogroup(cold_links.groupBy("b")).applyInPandas(_double, schema)
    return out.unionByName(_by_joins(nodes, edges, bucket, hot)) if any_hot else out


def _by_joins(nodes: DataFrame, edges: DataFrame, bucket, hot: DataFrame) -> DataFrame:
    """``hierarchy`` of the trees in hot buckets: pointers and paths are tables, doubled by joins."""
    mine = lambda df: df.withColumn("b", bucket).join(hot, "b", "left_semi").drop("b")
    live = cut(live_nodes(mine(nodes)))
    links = cut(parent_links(live, mine(edges)))
    # Loops are found first, as paths on them would grow for ever.
    plain = cut(resolve(live, links))
    whole = plain.where("depth >= 0").select(*TREE, "id")
    tree = resolve(whole, join_on(links, whole, [*TREE, "id"], "left_semi"), with_paths=True)
    tree = cut(tree.unionByName(plain.where("depth < 0").withColumn("path", F.array().cast("array<string>"))))
    counts = descendants(tree).groupBy(*TREE, "id").agg(F.count("*").alias("n_descendants"))
    out = join_on(tree, counts, [*TREE, "id"], "left")
    path = F.array_join(F.transform("path", lambda x: F.concat(F.lit(PATH), x)), "")
    return out.select(*TREE, "id", "root_id", "depth", path.alias("path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), F.get(F.reverse("path"), F.lit(2)).alias("step_above"))


def descendants(paths: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs: the closure, one row per link of a path."""
    return paths.where("size(path) > 1").select(
        *TREE, F.col("id").alias("descendant_id"), F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("pos", "id"), "depth",
    ).select(*TREE, "id", "descendant_id", (F.col("depth") - F.col("pos")).alias("distance"))


def with_path_ids(tree: DataFrame) -> DataFrame:
    """``hierarchy`` with its path as an array of ids."""
    return tree.withColumn("path", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(path, 2)"), PATH)))


def full_hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Path text, depth, root, number of descendants, and whether ``synthesis_level`` contradicts the tree.

    Towards the root the level of synthesis steps must rise; a step is flagged if its
    recorded level is not below that of the next step towards the root.  Nodes on loops are never flagged.
    """
    tree = cut(hierarchy(nodes, edges))
    levels = live_nodes(nodes).where("type = 'synthesis' and synthesis_level is not null").select(*TREE, "id", F.col("synthesis_level").alias("level"))
    levels = cut(levels)
    above = levels.select(*TREE, F.col("id").alias("step_above"), F.col("level").alias("level_above"))
    steps = join_on(tree.where("step_above is not null").select(*TREE, "id", "step_above"), levels, [*TREE, "id"], "inner")
    clash = join_on(steps, above, [*TREE, "step_above"], "inner").where("level >= level_above").select(*TREE, "id", F.lit(True).alias("level_contradicts"))
    return join_on(tree, clash, [*TREE, "id"], "left").select(
        *TREE, "id", F.replace(F.expr("substring(path, 2)"), F.lit(PATH), F.lit("/")).alias("path"), "depth", "root_id", (F.col("depth") == -1).alias("in_loop"),
        "n_descendants", F.coalesce("level_contradicts", F.lit(False)).alias("level_contradicts"),
    )
