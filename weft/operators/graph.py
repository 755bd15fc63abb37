"""Building and patching section graphs: upserts, patches, set logic and joins on nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.names import filled, join_on, strip

TREE = ["paper_name", "catalyst_id"]
#: Labels of node types and of edge types in the property graph.
NODE_LABELS = {"chemical": "Chemical", "synthesis": "Synthesis", "testing": "Testing", "characterization": "Characterization", "catalyst": "Catalyst"}
EDGE_LABELS = {"synthesis_input": "SYNTHESIS_INPUT", "synthesis_output": "SYNTHESIS_OUTPUT", "tested_in": "TESTED_IN", "characterized_in": "CHARACTERIZED_IN", "appear_in": "APPEAR_IN", "with_basicmaterial": "WITH_BASICMATERIAL"}
UNKNOWN_NODE, UNKNOWN_EDGE = "UnknownNode", "RELATED_TO"


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns: an upsert. Partial maxima are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return out.select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest])


def merge_maps(df: DataFrame, keys: list[str], maps: str, order: list[str]) -> DataFrame:
    """Properties added up per key; for a property set twice the last value stays."""
    each = df.select(*keys, *order, F.explode(maps).alias("_k", "_v"))
    last = each.groupBy(*keys, "_k").agg(F.max_by("_v", F.struct(*order)).alias("_v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(maps))


def apply_patch(base: DataFrame, patch: DataFrame, keys: list[str], order: list[str], op: str = "op") -> DataFrame:
    """``base`` after a patch: deletes, then updates (the last of each key replaces every record of it), then adds as they are.

    Updates without a record are ignored, adds are not made unique, and deletes
    touch nothing else.  Both frames have the same columns; ``op`` tells
    ``delete``, ``update`` or ``add``.
    """
    cols = [c for c in base.columns if c != op]
    kept = join_on(base.select(*cols), patch.where(F.col(op) == "delete").select(*keys).distinct(), keys, "left_anti")
    updates = last_by(patch.where(F.col(op) == "update").select(*cols), keys, order)
    rest = [c for c in cols if c not in keys]
    fresh = updates.select(*keys, F.struct(*rest).alias("_u"))
    changed = join_on(kept, fresh, keys, "left").select(*keys, *[F.when(F.col("_u").isNotNull(), F.col("_u").getField(c)).otherwise(F.col(c)).alias(c) for c in rest])
    return changed.select(*cols).unionByName(patch.where(F.col(op) == "add").select(*cols))


def label(kind: Column, is_tested: Column) -> Column:
    """Node label; a tested chemical is a Catalyst, an unknown type UnknownNode."""
    out = F.lit(UNKNOWN_NODE)
    for k, v in NODE_LABELS.items():
        out = F.when(F.lower(kind) == k, v).otherwise(out)
    return F.when((F.lower(kind) == "chemical") & F.coalesce(is_tested, F.lit(False)), "Catalyst").otherwise(out)


def relation(kind: Column) -> Column:
    out = F.lit(UNKNOWN_EDGE)
    for k, v in EDGE_LABELS.items():
        out = F.when(F.lower(F.trim(kind)) == k, v).otherwise(out)
    return out


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes of the same tree."""
    ids = nodes.select(*TREE, strip("id").alias("id")).distinct()
    e = edges.withColumns({"source_id": strip("source_id"), "target_id": strip("target_id")})
    e = join_on(e, ids.withColumnRenamed("id", "source_id"), [*TREE, "source_id"], "left_semi")
    return join_on(e, ids.withColumnRenamed("id", "target_id"), [*TREE, "target_id"], "left_semi")


def simple_edges(edges: DataFrame) -> DataFrame:
    """One edge per pair of ends, the last one."""
    e = edges.withColumns({"source_id": strip("source_id"), "target_id": strip("target_id")}).where(filled(F.col("source_id")) & filled(F.col("target_id")))
    return last_by(e, [*TREE, "source_id", "target_id"], ["loaded_at", "row_id"])


def starting_materials(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no step puts out."""
    ids = nodes.select(*TREE, strip("id").alias("id")).distinct()
    made = edges.where(F.lower(strip("type")) == "synthesis_output").select(*TREE, strip("target_id").alias("id")).distinct()
    return join_on(ids, made, [*TREE, "id"], "left_anti")


def materials_of_interest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Starting materials and tested catalysts."""
    tested = nodes.where("is_tested_catalyst").select(*TREE, strip("id").alias("id"))
    return starting_materials(nodes, edges).unionByName(tested).distinct()


def step_ends(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Names of the chemicals that enter (``synthesis_input``) or leave (``synthesis_output``) each step, sorted."""
    near, far = ("target_id", "source_id") if kind == "synthesis_input" else ("source_id", "target_id")
    chem = nodes.where("type = 'chemical' and op <> 'delete'").select(*TREE, strip("id").alias("far"), "name").where("name is not null").distinct()
    links = edges.where(F.lower(strip("type")) == kind).select(*TREE, strip(near).alias("step_id"), strip(far).alias("far")).distinct()
    return join_on(links, chem, [*TREE, "far"], "inner").groupBy(*TREE, "step_id").agg(F.sort_array(F.collect_set("name")).alias("names"))


def with_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Test edges of each tree with their testing node, also where that node is missing."""
    e = edges.where(F.lower(strip("type")) == "tested_in").select(*TREE, strip("source_id").alias("chemical_id"), strip("target_id").alias("test_id")).distinct()
    t = nodes.where("type = 'testing'").select(*TREE, strip("id").alias("test_id"), F.lit(True).alias("has_node")).distinct()
    return join_on(e, t, [*TREE, "test_id"], "left").withColumn("has_node", F.coalesce("has_node", F.lit(False)))
