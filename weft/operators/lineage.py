"""Backward lineage from tested targets: reach, least distance and step levels.

Whole trees come together in a task, where all their targets are walked back at
once; large trees go by joins, a hop at a time.  Nodes reached before are dropped,
so every node is visited once and loops end by themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions.names import join_on
from weft.operators.hierarchy import BUCKET_ROWS, HOT_ROWS, NOTHING, SEP
from weft.session import cut, forget

TREE = ["paper_name", "catalyst_id"]


def reach_by_joins(targets: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """``reach`` for trees of any size: the frontier of all targets advances together, one join a hop."""
    key = [*TREE, "target_id"]
    back = cut(edges.select(*TREE, F.col("target_id").alias("id"), F.col("source_id").alias("prev")).distinct())
    front = cut(targets.select(*key).distinct().withColumn("id", F.col("target_id")).withColumn("dist", F.lit(0)))
    seen, parts, hop = front, [front], 0
    while most is None or hop < most:
        hop += 1
        step = join_on(front.drop("dist"), back, [*TREE, "id"], "inner").select(*key, F.col("prev").alias("id")).distinct()
        front = cut(join_on(step, seen.select(*key, "id"), [*key, "id"], "left_anti").withColumn("dist", F.lit(hop)))
        if front.isEmpty():
            forget(front)
            break
        parts.append(front)
        seen = seen.unionByName(front)
    return seen


def _walk(most: int | None):
    def walk(targets: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        """Breadth-first from all targets of a few whole trees at once, over positions in arrays."""
        if not len(targets):
            return pd.DataFrame()
        tree = lambda t: t["paper_name"].fillna(NOTHING) + SEP + t["catalyst_id"].fillna(NOTHING) + SEP
        start = tree(targets) + targets["target_id"]
        to, frm = tree(edges) + edges["target_id"], tree(edges) + edges["source_id"]
        codes, keys = pd.factorize(pd.concat([start, to, frm], ignore_index=True))
        n, a, b = len(keys), len(targets), len(targets) + len(edges)
        order = np.argsort(codes[a:b], kind="stable")
        ends, prev = codes[a:b][order], codes[b:][order]
        first = np.searchsorted(ends, np.arange(n), "left")
        count = np.searchsorted(ends, np.arange(n), "right") - first
        who, at = np.arange(a), codes[:a]
        seen, parts, hop = np.sort(who * n + at), [(who, at, np.zeros(a, dtype="int32"))], 0
        while len(who) and (most is None or hop < most):
            hop += 1
            many = count[at]
            spot = np.repeat(first[at] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            pairs = np.unique(np.repeat(who, many) * n + prev[spot])
            pairs = np.setdiff1d(pairs, seen, assume_unique=True)
            seen = np.union1d(seen, pairs)
            who, at = pairs // n, pairs % n
            parts.append((who, at, np.full(len(who), hop, dtype="int32")))
        who, at, dist = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids = np.array([k.rsplit(SEP, 1)[1] for k in keys], dtype=object)
        out = targets.iloc[who][["paper_name", "catalyst_id", "target_id"]].reset_index(drop=True)
        return out.assign(id=ids[at], dist=dist)

    return walk


def reach(targets: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes from which a target can be reached: tree columns, target_id, id, dist (least number of links).

    ``targets``: tree columns and target_id; ``edges``: tree columns, source_id,
    target_id.  ``most`` bounds the distance.  A target reaches itself at 0.
    Whole trees are walked in buckets of about ``BUCKET_ROWS`` edges; trees in a
    bucket of more than ``HOT_ROWS`` go by joins.  Null tree columns compare
    equal; repeated rows count once; empty tables give no rows.
    """
    n = max(1, -(-edges.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(*TREE), F.lit(n))
    # Which buckets are large stays a table; it is joined only if there is one.
    hot = cut(edges.groupBy(bucket.alias("b")).count().where(F.col("count") > HOT_ROWS).select("b"))
    any_hot = not hot.isEmpty()
    cold = lambda df: df.withColumn("b", bucket).join(hot, "b", "left_anti") if any_hot else df.withColumn("b", bucket)
    large = lambda df: df.withColumn("b", bucket).join(hot, "b", "left_semi").drop("b")
    t = cold(targets.where("target_id is not null").select(*TREE, "target_id")).distinct().repartition("b")
    e = cold(edges.where("source_id is not null and target_id is not null").select(*TREE, "source_id", "target_id")).repartition("b").dropDuplicates()
    schema = "paper_name string, catalyst_id string, target_id string, id string, dist int"
    out = t.groupBy("b").cogroup(e.groupBy("b")).applyInPandas(_walk(most), schema)
    return out.unionByName(reach_by_joins(large(targets), large(edges), most)) if any_hot else out


def levels(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Level of each step of a lineage: 1 for the step farthest from the target, then on towards it; ties by id.

    Ranks run within a target's lineage, which is a tree of steps of one paper.
    """
    steps = join_on(reached, nodes.where("type = 'synthesis'").select(*TREE, "id").distinct(), [*TREE, "id"], "left_semi")
    rank = F.row_number().over(W.partitionBy(*TREE, "target_id").orderBy(F.desc("dist"), "id"))
    return steps.select(*TREE, "target_id", "id", "dist", rank.alias("level"))


def rendered(reached_levels: DataFrame, nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """A text per target: its steps in order, each with name and inputs."""
    names = nodes.select(*TREE, "id", "name").groupBy(*TREE, "id").agg(F.max("name").alias("name"))
    s = join_on(reached_levels, names, [*TREE, "id"], "left")
    s = join_on(s, inputs.select(*TREE, F.col("step_id").alias("id"), "names"), [*TREE, "id"], "left")
    line = F.concat(F.lit("Step "), F.col("level"), F.lit(": "), F.coalesce("name", F.lit("N/A")), F.lit("\n  Inputs: "), F.coalesce(F.nullif(F.array_join("names", ", "), F.lit("")), F.lit("N/A")))
    return s.groupBy(*TREE, "target_id").agg(F.sort_array(F.collect_list(F.struct("level", line.alias("line")))).alias("l")).select(
        *TREE, "target_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("scenario"))
