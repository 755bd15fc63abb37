"""Queries of the general problems: 1, 5, 6 and 7."""

from __future__ import annotations

from weft.operators import hierarchy, nested, orphans, quantities
from weft.session import table


def _tree(spark, d):
    return table(spark, d, "tree_nodes"), table(spark, d, "tree_edges")


def p1_found(spark, d):
    return nested.quantities(table(spark, d, "tree_raw")).select("record_id", "owner", "owner_id", "path").distinct()


def p1_nodes(spark, d):
    return nested.nodes(table(spark, d, "tree_raw"))


def p1_edges(spark, d):
    return nested.edges(table(spark, d, "tree_raw"))


def p1_quantities(spark, d):
    return nested.quantities(table(spark, d, "tree_raw"))


def p5_found(spark, d):
    return orphans.orphan_ends(*_tree(spark, d)).select("row_id", "side", "reason").distinct()


def p5_by_month(spark, d):
    return orphans.orphans_by_period(orphans.orphan_ends(*_tree(spark, d)), "tree_nodes", "tree_edges")


def p6_found(spark, d):
    return hierarchy.hierarchy(*_tree(spark, d)).select(*hierarchy.TREE, "id", "root_id", "depth")


def p6_hierarchy(spark, d):
    return hierarchy.full_hierarchy(*_tree(spark, d))


def p6_descendants(spark, d):
    return hierarchy.descendants(hierarchy.with_path_ids(hierarchy.hierarchy(*_tree(spark, d))))


def p7_found(spark, d):
    return quantities.converted(table(spark, d, "node_quantities"), table(spark, d, "quantity_ref")).distinct()


def p7_converted(spark, d):
    done = quantities.normalise(table(spark, d, "node_quantities"), table(spark, d, "quantity_ref"))
    return done.select("quantity_id", "quantity", "low", "high", "common_unit", "stated_in", "unique", "as_is")


def p7_inferred(spark, d):
    return quantities.infer_units(quantities.normalise(table(spark, d, "node_quantities"), table(spark, d, "quantity_ref")))


QUERIES = {f.__name__: f for f in (p1_found, p1_nodes, p1_edges, p1_quantities, p5_found, p5_by_month, p6_found, p6_hierarchy, p6_descendants, p7_found, p7_converted, p7_inferred)}

_P5 = """
WITH n AS (SELECT paper_name, catalyst_id, trim(id) AS k, loaded_at AS ts, row_id AS rid, coalesce(lower(trim(op)), 'add') AS op FROM tree_nodes WHERE trim(id) <> ''),
e AS (SELECT row_id, 'source' AS side, paper_name, catalyst_id, trim(source_id) AS k, loaded_at AS ts FROM tree_edges WHERE trim(source_id) <> ''
      UNION ALL SELECT row_id, 'target', paper_name, catalyst_id, trim(target_id), loaded_at FROM tree_edges WHERE trim(target_id) <> ''),
j AS (SELECT e.row_id, e.side, e.ts, max_by(n.op, (n.ts, n.rid)) FILTER (WHERE n.ts <= e.ts) AS op_then, count(n.k) AS n_all
      FROM e LEFT JOIN n ON n.paper_name IS NOT DISTINCT FROM e.paper_name AND n.catalyst_id IS NOT DISTINCT FROM e.catalyst_id AND n.k = e.k GROUP BY ALL),
r AS (SELECT row_id, side, ts, CASE WHEN op_then = 'delete' THEN 'deleted' WHEN op_then IS NULL AND n_all > 0 THEN 'late' WHEN op_then IS NULL THEN 'missing' END AS reason FROM j)
"""
_P6 = """
WITH RECURSIVE n AS (SELECT paper_name AS p, catalyst_id AS c, trim(id) AS id, type, synthesis_level AS lv FROM tree_nodes WHERE trim(id) <> ''
      QUALIFY row_number() OVER (PARTITION BY paper_name, catalyst_id, trim(id) ORDER BY loaded_at DESC, row_id DESC) = 1 AND op <> 'delete' AND type IN ('chemical', 'synthesis')),
l AS (SELECT e.paper_name AS p, e.catalyst_id AS c, trim(e.source_id) AS id, min(trim(e.target_id)) AS up FROM tree_edges e
      JOIN n a ON a.p = e.paper_name AND a.c = e.catalyst_id AND a.id = trim(e.source_id)
      JOIN n b ON b.p = e.paper_name AND b.c = e.catalyst_id AND b.id = trim(e.target_id)
      WHERE lower(trim(e.type)) IN ('synthesis_input', 'synthesis_output') GROUP BY ALL),
t AS (SELECT n.p, n.c, n.id, n.id AS root_id, 0 AS depth, [n.id] AS path FROM n ANTI JOIN l USING (p, c, id)
      UNION ALL SELECT l.p, l.c, l.id, t.root_id, t.depth + 1, list_append(t.path, l.id) FROM l JOIN t ON t.p = l.p AND t.c = l.c AND t.id = l.up),
d AS (SELECT n.p, n.c, n.id, coalesce(t.root_id, '') AS root_id, CAST(coalesce(t.depth, -1) AS BIGINT) AS depth, coalesce(t.path, []) AS path FROM n LEFT JOIN t USING (p, c, id)),
x AS (SELECT p, c, id AS descendant_id, unnest(path[:-2]) AS id, unnest(range(len(path) - 1)) AS pos, depth FROM d WHERE len(path) > 1)
"""
ORACLE = {
    "p5_found": _P5 + "SELECT DISTINCT row_id, side, reason FROM r WHERE reason IS NOT NULL",
    "p5_by_month": _P5 + "SELECT 'tree_edges' AS child_table, 'tree_nodes' AS parent_table, strftime(ts, '%Y-%m') AS month, side, reason, count(*) AS n_orphans FROM r WHERE reason IS NOT NULL GROUP BY ALL",
    "p6_found": _P6 + "SELECT p AS paper_name, c AS catalyst_id, id, root_id, depth FROM d",
    "p6_hierarchy": _P6 + """, k AS (SELECT p, c, id, count(*) AS m FROM x GROUP BY ALL),
v AS (SELECT d.p, d.c, d.id, true AS bad FROM d JOIN n a ON a.p = d.p AND a.c = d.c AND a.id = d.id JOIN n b ON b.p = d.p AND b.c = d.c AND b.id = d.path[-3]
      WHERE len(d.path) > 2 AND a.type = 'synthesis' AND b.type = 'synthesis' AND a.lv >= b.lv)
SELECT d.p AS paper_name, d.c AS catalyst_id, d.id, array_to_string(d.path, '/') AS path, d.depth, d.root_id, d.depth = -1 AS in_loop,
       coalesce(k.m, 0) AS n_descendants, coalesce(v.bad, false) AS level_contradicts
FROM d LEFT JOIN k USING (p, c, id) LEFT JOIN v USING (p, c, id)""",
    "p6_descendants": _P6 + "SELECT p AS paper_name, c AS catalyst_id, id, descendant_id, CAST(depth - pos AS BIGINT) AS distance FROM x",
}
