"""Queries of the engine's own operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions import text as X
from weft.functions import units as U
from weft.functions.names import join_on, strip
from weft.operators import graph as G
from weft.operators import lineage as L
from weft.operators import vectors as V
from weft.session import cut, table

TREE = ["paper_name", "catalyst_id"]
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def nodes(s, d):
    return table(s, d, "tree_nodes")


def edges(s, d):
    return table(s, d, "tree_edges")


# --- building and patching graphs -----------------------------------------------------------------


@query("""SELECT e.row_id FROM tree_edges e WHERE EXISTS (SELECT 1 FROM tree_nodes n WHERE n.paper_name = e.paper_name AND n.catalyst_id = e.catalyst_id AND trim(n.id) = trim(e.source_id))
AND EXISTS (SELECT 1 FROM tree_nodes n WHERE n.paper_name = e.paper_name AND n.catalyst_id = e.catalyst_id AND trim(n.id) = trim(e.target_id))""")
def edges_valid_endpoints(s, d):
    return G.valid_edges(edges(s, d), nodes(s, d)).select("row_id")


@query("""SELECT row_id, paper_name, catalyst_id, source_id, target_id, type FROM (SELECT row_id, paper_name, catalyst_id, trim(source_id) AS source_id, trim(target_id) AS target_id, type,
row_number() OVER (PARTITION BY paper_name, catalyst_id, trim(source_id), trim(target_id) ORDER BY loaded_at DESC, row_id DESC) AS k FROM tree_edges WHERE trim(source_id) <> '' AND trim(target_id) <> '') WHERE k = 1""")
def edge_dedupe_last(s, d):
    return G.simple_edges(edges(s, d)).select("row_id", *TREE, "source_id", "target_id", "type")


@query("""SELECT paper_name, id, row_id, name, op FROM (SELECT paper_name, trim(id) AS id, row_id, name, op, row_number() OVER (PARTITION BY paper_name, trim(id) ORDER BY loaded_at DESC, row_id DESC) AS k FROM tree_nodes) WHERE k = 1""")
def node_upsert_last(s, d):
    n = nodes(s, d).select("paper_name", strip("id").alias("id"), "row_id", "name", "op", "loaded_at")
    return G.last_by(n, ["paper_name", "id"], ["loaded_at", "row_id"]).select("paper_name", "id", "row_id", "name", "op")


@query("""WITH n AS (SELECT row_id, paper_name, catalyst_id, trim(id) AS id, name, op, loaded_at FROM tree_nodes),
u AS (SELECT * FROM n WHERE op = 'update' QUALIFY row_number() OVER (PARTITION BY paper_name, catalyst_id, id ORDER BY loaded_at DESC, row_id DESC) = 1)
SELECT b.paper_name, b.catalyst_id, b.id, CASE WHEN u.id IS NOT NULL THEN u.row_id ELSE b.row_id END AS row_id, CASE WHEN u.id IS NOT NULL THEN u.name ELSE b.name END AS name
FROM n b LEFT JOIN u USING (paper_name, catalyst_id, id)
WHERE b.op = 'add' AND NOT EXISTS (SELECT 1 FROM n x WHERE x.op = 'delete' AND x.paper_name = b.paper_name AND x.catalyst_id = b.catalyst_id AND x.id = b.id)""")
def patch_apply(s, d):
    n = nodes(s, d).select("row_id", *TREE, strip("id").alias("id"), "name", "op", "loaded_at")
    return G.apply_patch(n.where("op = 'add'"), n.where("op <> 'add'"), [*TREE, "id"], ["loaded_at", "row_id"]).select(*TREE, "id", "row_id", "name")


@query("""SELECT DISTINCT paper_name, catalyst_id, trim(id) AS id FROM tree_nodes EXCEPT SELECT paper_name, catalyst_id, trim(target_id) FROM tree_edges WHERE lower(trim(type)) = 'synthesis_output'""")
def starting_materials(s, d):
    return G.starting_materials(nodes(s, d), edges(s, d))


@query("""(SELECT DISTINCT paper_name, catalyst_id, trim(id) AS id FROM tree_nodes EXCEPT SELECT paper_name, catalyst_id, trim(target_id) FROM tree_edges WHERE lower(trim(type)) = 'synthesis_output')
UNION SELECT paper_name, catalyst_id, trim(id) FROM tree_nodes WHERE is_tested_catalyst""")
def starting_or_tested(s, d):
    return G.materials_of_interest(nodes(s, d), edges(s, d))


@query("""SELECT 'node' AS part, type AS kind, count(*) AS n FROM tree_nodes GROUP BY ALL UNION ALL SELECT 'edge', lower(trim(type)), count(*) FROM tree_edges GROUP BY ALL
UNION ALL SELECT 'quantity', holder, count(*) FROM node_quantities GROUP BY ALL""")
def sections_union_all(s, d):
    parts = [nodes(s, d).select(F.lit("node").alias("part"), F.col("type").alias("kind")), edges(s, d).select(F.lit("edge").alias("part"), F.lower(strip("type")).alias("kind")),
             table(s, d, "node_quantities").select(F.lit("quantity").alias("part"), F.col("holder").alias("kind"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part", "kind").agg(F.count("*").alias("n"))


_ENDS = """WITH c AS (SELECT DISTINCT paper_name, catalyst_id, trim(id) AS far, name FROM tree_nodes WHERE type = 'chemical' AND op <> 'delete' AND name IS NOT NULL),
l AS (SELECT DISTINCT paper_name, catalyst_id, trim({near}) AS step_id, trim({far}) AS far FROM tree_edges WHERE lower(trim(type)) = '{kind}')
SELECT paper_name, catalyst_id, step_id, array_to_string(list_sort(list(DISTINCT name)), '|') AS names FROM l JOIN c USING (paper_name, catalyst_id, far) GROUP BY ALL"""


@query(_ENDS.format(near="target_id", far="source_id", kind="synthesis_input"))
def step_inputs(s, d):
    return G.step_ends(nodes(s, d), edges(s, d), "synthesis_input").withColumn("names", F.array_join("names", "|"))


@query(_ENDS.format(near="source_id", far="target_id", kind="synthesis_output"))
def step_outputs(s, d):
    return G.step_ends(nodes(s, d), edges(s, d), "synthesis_output").withColumn("names", F.array_join("names", "|"))


@query("""WITH e AS (SELECT DISTINCT paper_name, catalyst_id, trim(source_id) AS chemical_id, trim(target_id) AS test_id FROM tree_edges WHERE lower(trim(type)) = 'tested_in'),
t AS (SELECT DISTINCT paper_name, catalyst_id, trim(id) AS test_id, true AS has_node FROM tree_nodes WHERE type = 'testing')
SELECT e.*, coalesce(has_node, false) AS has_node FROM e LEFT JOIN t USING (paper_name, catalyst_id, test_id)""")
def tested_left(s, d):
    return G.with_tests(nodes(s, d), edges(s, d))


@query("""SELECT DISTINCT paper_name, catalyst_id, trim(id) AS id FROM tree_nodes n WHERE type = 'chemical' AND trim(id) <> '' AND NOT EXISTS (SELECT 1 FROM tree_edges e WHERE starts_with(lower(trim(e.type)), 'synthesis_')
AND e.paper_name IS NOT DISTINCT FROM n.paper_name AND e.catalyst_id IS NOT DISTINCT FROM n.catalyst_id AND (trim(e.source_id) = trim(n.id) OR trim(e.target_id) = trim(n.id)))""")
def chemicals_outside_steps(s, d):
    """Chemicals that no step takes in or puts out: what merging of sections would add."""
    made = edges(s, d).where(F.lower(strip("type")).startswith("synthesis_")).select(*TREE, F.explode(F.array(strip("source_id"), strip("target_id"))).alias("id")).distinct()
    own = nodes(s, d).where("type = 'chemical'").select(*TREE, strip("id").alias("id")).where("id <> ''").distinct()
    return join_on(own, made, [*TREE, "id"], "left_anti")


@query("""SELECT n.row_id, CASE WHEN EXISTS (SELECT 1 FROM tree_edges e WHERE lower(trim(e.type)) = 'tested_in' AND e.paper_name = n.paper_name AND e.catalyst_id = n.catalyst_id AND trim(e.source_id) = trim(n.id))
THEN true ELSE coalesce(n.is_tested_catalyst, false) END AS is_catalyst FROM tree_nodes n WHERE n.type = 'chemical'""")
def flag_tested(s, d):
    tested = edges(s, d).where(F.lower(strip("type")) == "tested_in").select(*TREE, strip("source_id").alias("k"), F.lit(True).alias("hit")).distinct()
    n = nodes(s, d).where("type = 'chemical'").select("row_id", *TREE, strip("id").alias("k"), "is_tested_catalyst")
    return join_on(n, tested, [*TREE, "k"], "left").select("row_id", F.when(F.col("hit"), True).otherwise(F.coalesce("is_tested_catalyst", F.lit(False))).alias("is_catalyst"))


@query("""WITH f AS (SELECT paper_name, catalyst_id, trim(id) AS id FROM tree_nodes WHERE type = 'chemical' AND is_tested_catalyst),
l AS (SELECT paper_name, catalyst_id, trim(source_id) AS id FROM tree_edges WHERE lower(trim(type)) = 'tested_in' AND trim(source_id) <> '')
SELECT paper_name, catalyst_id, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM (SELECT * FROM l UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.paper_name = f.paper_name AND l.catalyst_id = f.catalyst_id)) GROUP BY ALL""")
def tested_targets(s, d):
    """Targets named by test edges; where a tree has none, those flagged on chemicals."""
    listed = edges(s, d).where(F.lower(strip("type")) == "tested_in").select(*TREE, strip("source_id").alias("id")).where("id <> ''")
    flagged = nodes(s, d).where("type = 'chemical' and is_tested_catalyst").select(*TREE, strip("id").alias("id"))
    both = listed.withColumn("own", F.lit(True)).unionByName(flagged.withColumn("own", F.lit(False)))
    out = both.groupBy(*TREE).agg(F.collect_set(F.when(F.col("own"), F.col("id"))).alias("a"), F.collect_set(F.when(~F.col("own"), F.col("id"))).alias("b"))
    return out.select(*TREE, F.array_join(F.sort_array(F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b"))), ",").alias("ids"))


@query("""SELECT row_id, CASE WHEN type = 'chemical' AND is_tested_catalyst THEN 'Catalyst' WHEN type = 'chemical' THEN 'Chemical' WHEN type = 'synthesis' THEN 'Synthesis' WHEN type = 'testing' THEN 'Testing'
WHEN type = 'characterization' THEN 'Characterization' ELSE 'UnknownNode' END AS label FROM tree_nodes""")
def label_assign(s, d):
    return nodes(s, d).select("row_id", G.label(F.col("type"), F.col("is_tested_catalyst")).alias("label"))


@query("""SELECT CASE lower(trim(type)) WHEN 'synthesis_input' THEN 'SYNTHESIS_INPUT' WHEN 'synthesis_output' THEN 'SYNTHESIS_OUTPUT' WHEN 'tested_in' THEN 'TESTED_IN' WHEN 'characterized_in' THEN 'CHARACTERIZED_IN' WHEN 'appear_in' THEN 'APPEAR_IN' WHEN 'with_basicmaterial' THEN 'WITH_BASICMATERIAL' ELSE 'RELATED_TO' END AS rel_type, count(*) AS n FROM tree_edges GROUP BY ALL""")
def rel_type_map(s, d):
    return edges(s, d).groupBy(G.relation(F.col("type")).alias("rel_type")).agg(F.count("*").alias("n"))


# --- properties -----------------------------------------------------------------------------------

_KEY = """regexp_replace(trim(replace({p}, '_json', '') || '_' || quantity || '_' || coalesce(nullif(replace(replace(replace(trim(unit), ' ', '_'), '/', '-per-'), '%', 'pct'), ''), 'NoUnit')), '[ .\\-]', '_', 'g')"""
_PREFIX = "CASE holder WHEN 'properties' THEN 'property' WHEN 'conditions' THEN 'condition' WHEN 'conditions_json' THEN 'condition' ELSE holder END"


def _flat(s, d):
    q = table(s, d, "node_quantities")
    prefix = F.when(F.col("holder") == "properties", "property").when(F.col("holder").isin("conditions", "conditions_json"), "condition").otherwise(F.col("holder"))
    return q.select("quantity_id", "paper_name", "catalyst_id", "node_id", "holder", X.safe_key(F.concat_ws("_", prefix, F.col("quantity"), X.unit_suffix(F.col("unit")))).alias("prop_key"), "value", "loaded_at")


@query(f"SELECT quantity_id, {_KEY.format(p=_PREFIX)} AS prop_key, value AS prop_value FROM node_quantities")
def flatten_props(s, d):
    return _flat(s, d).select("quantity_id", "prop_key", F.col("value").alias("prop_value"))


@query(f"""SELECT paper_name, catalyst_id, trim(node_id) AS node_id, prop_key, value AS prop_value FROM (SELECT *, {_KEY.format(p=_PREFIX)} AS prop_key FROM node_quantities)
QUALIFY row_number() OVER (PARTITION BY paper_name, catalyst_id, trim(node_id), prop_key ORDER BY loaded_at DESC, quantity_id DESC) = 1""")
def props_upsert(s, d):
    p = _flat(s, d).select(*TREE, strip("node_id").alias("node_id"), "prop_key", F.col("value").alias("prop_value"), "loaded_at", "quantity_id")
    return G.last_by(p, [*TREE, "node_id", "prop_key"], ["loaded_at", "quantity_id"]).select(*TREE, "node_id", "prop_key", "prop_value")


@query(f"SELECT holder AS label, array_to_string(list_sort(list(DISTINCT {_KEY.format(p=_PREFIX)})), '|') AS keys FROM node_quantities GROUP BY ALL")
def schema_introspect(s, d):
    return _flat(s, d).groupBy(F.col("holder").alias("label")).agg(F.array_join(F.sort_array(F.collect_set("prop_key")), "|").alias("keys"))


@query(f"SELECT holder AS label, array_to_string(list_sort(list(DISTINCT prop_key)), '|') AS keys FROM (SELECT holder, {_KEY.format(p=_PREFIX)} AS prop_key FROM node_quantities) WHERE starts_with(prop_key, 'condition_t') GROUP BY ALL")
def schema_prefix(s, d):
    return _flat(s, d).where(F.col("prop_key").startswith("condition_t")).groupBy(F.col("holder").alias("label")).agg(F.array_join(F.sort_array(F.collect_set("prop_key")), "|").alias("keys"))


@query("SELECT row_id, regexp_replace(trim(k), '[ .\\-]', '_', 'g') AS key, v AS value FROM (SELECT row_id, unnest(map_keys(attrs)) AS k, unnest(map_values(attrs)) AS v FROM tree_nodes)")
def attrs_safe(s, d):
    return nodes(s, d).select("row_id", F.explode("attrs").alias("k", "value")).select("row_id", X.safe_key(F.col("k")).alias("key"), "value")


@query("SELECT material_id, CASE WHEN instr(formula, '(') > 1 THEN trim(split_part(formula, '(', 1)) ELSE regexp_replace(trim(formula), '^\\((.*)\\)$', '\\1') END AS base FROM material_ref")
def formula_base(s, d):
    return table(s, d, "material_ref").select("material_id", X.formula_base(F.col("formula")).alias("base"))


@query("SELECT row_id, nullif(trim(split_part(name, '(', 1)), '') AS base FROM tree_nodes WHERE type = 'chemical'")
def name_base(s, d):
    return nodes(s, d).where("type = 'chemical'").select("row_id", X.name_base(F.col("name")).alias("base"))


# --- lineage --------------------------------------------------------------------------------------

_REACH = """WITH RECURSIVE e AS (SELECT DISTINCT paper_name AS p, catalyst_id AS c, trim(source_id) AS s, trim(target_id) AS t FROM tree_edges WHERE trim(source_id) <> '' AND trim(target_id) <> ''),
r AS (SELECT DISTINCT paper_name AS p, catalyst_id AS c, trim(id) AS target_id, trim(id) AS id, 0 AS dist FROM tree_nodes WHERE is_tested_catalyst
UNION SELECT r.p, r.c, r.target_id, e.s, r.dist + 1 FROM r JOIN e ON e.p = r.p AND e.c = r.c AND e.t = r.id WHERE r.dist < {most}),
m AS (SELECT p AS paper_name, c AS catalyst_id, target_id, id, min(dist) AS dist FROM r GROUP BY ALL)
"""


def _lineage(s, d, most=None):
    e = edges(s, d).select(*TREE, strip("source_id").alias("source_id"), strip("target_id").alias("target_id")).where("source_id <> '' and target_id <> ''")
    return L.reach(nodes(s, d).where("is_tested_catalyst").select(*TREE, strip("id").alias("target_id")), e, most)


@query(_REACH.format(most=120) + "SELECT * FROM m")
def lineage_reach(s, d):
    return _lineage(s, d)


@query(_REACH.format(most=6) + "SELECT * FROM m")
def lineage_bounded(s, d):
    return _lineage(s, d, 6)


_STEPS = "n AS (SELECT DISTINCT paper_name, catalyst_id, trim(id) AS id FROM tree_nodes WHERE type = 'synthesis')"


@query(_REACH.format(most=120) + f", {_STEPS} SELECT paper_name, catalyst_id, target_id, id, dist, row_number() OVER (PARTITION BY paper_name, catalyst_id, target_id ORDER BY dist DESC, id) AS level FROM m JOIN n USING (paper_name, catalyst_id, id)")
def lineage_levels(s, d):
    return L.levels(_lineage(s, d), nodes(s, d).select(*TREE, strip("id").alias("id"), "type"))


@query(_REACH.format(most=120) + f""", {_STEPS}, lv AS (SELECT paper_name, catalyst_id, target_id, id, row_number() OVER (PARTITION BY paper_name, catalyst_id, target_id ORDER BY dist DESC, id) AS level FROM m JOIN n USING (paper_name, catalyst_id, id)),
nm AS (SELECT paper_name, catalyst_id, trim(id) AS id, max(name) AS name FROM tree_nodes GROUP BY ALL), inp AS ({_ENDS.format(near="target_id", far="source_id", kind="synthesis_input").replace("'|'", "', '")})
SELECT lv.paper_name, lv.catalyst_id, target_id, string_agg('Step ' || level || ': ' || coalesce(nm.name, 'N/A') || chr(10) || '  Inputs: ' || coalesce(nullif(inp.names, ''), 'N/A'), chr(10) ORDER BY level) AS scenario
FROM lv LEFT JOIN nm USING (paper_name, catalyst_id, id) LEFT JOIN inp ON inp.paper_name = lv.paper_name AND inp.catalyst_id = lv.catalyst_id AND inp.step_id = lv.id GROUP BY ALL""")
def scenario_text(s, d):
    n = nodes(s, d).select(*TREE, strip("id").alias("id"), "type", "name")
    return L.rendered(L.levels(_lineage(s, d), n), n, G.step_ends(nodes(s, d), edges(s, d), "synthesis_input"))


# --- vectors --------------------------------------------------------------------------------------

_KNN = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 4) AS sim FROM v a, v b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM p QUALIFY rank <= 10)
"""


def _vectors(s, d):
    v = table(s, d, "embeddings")
    return v.where("vec_id % 50 = 0"), v


@query(_KNN + "SELECT * FROM r")
def vector_topk(s, d):
    return V.nearest(*_vectors(s, d), 10)


@query(_KNN + "SELECT least(query_id, vec_id) AS i, greatest(query_id, vec_id) AS j, max(sim) AS sim FROM r WHERE query_id <> vec_id AND sim >= 0.3 GROUP BY 1, 2")
def knn_pairs(s, d):
    return V.similar_pairs(*_vectors(s, d), 10, 0.3)


_COMP = "WITH RECURSIVE" + _KNN[4:] + """, q AS (SELECT DISTINCT least(query_id, vec_id) AS i, greatest(query_id, vec_id) AS j FROM r WHERE query_id <> vec_id AND sim >= 0.3),
l AS (SELECT i AS x, j AS y FROM q UNION SELECT j, i FROM q), w AS (SELECT x AS id, x AS root FROM l UNION SELECT l.y, w.root FROM w JOIN l ON l.x = w.id), k AS (SELECT id, min(root) AS root FROM w GROUP BY id)
"""


@query(_COMP + "SELECT * FROM k")
def components(s, d):
    return V.components(V.similar_pairs(*_vectors(s, d), 10, 0.3))


@query(_COMP + "SELECT DISTINCT coalesce(a.root, q.query_id) AS query_id, coalesce(b.root, q.vec_id) AS vec_id FROM r q LEFT JOIN k a ON a.id = q.query_id LEFT JOIN k b ON b.id = q.vec_id WHERE coalesce(a.root, q.query_id) <> coalesce(b.root, q.vec_id)")
def contract_nodes(s, d):
    q, v = _vectors(s, d)
    near = cut(V.nearest(q, v, 10))
    pairs = near.where("query_id <> vec_id and sim >= 0.3").select(F.least("query_id", "vec_id").alias("i"), F.greatest("query_id", "vec_id").alias("j")).distinct()
    return V.contract(near.select("query_id", "vec_id"), V.components(pairs), "query_id", "vec_id")


#: The same over all vectors as queries: the similarity self-join, its components and the contracted links.
_KNN_ALL, _COMP_ALL = (x.replace(" WHERE a.vec_id % 50 = 0", "") for x in (_KNN, _COMP))


@query(_KNN_ALL + "SELECT least(query_id, vec_id) AS i, greatest(query_id, vec_id) AS j, max(sim) AS sim FROM r WHERE query_id <> vec_id AND sim >= 0.3 GROUP BY 1, 2")
def knn_pairs_all(s, d):
    v = table(s, d, "embeddings")
    return V.similar_pairs(v, v, 10, 0.3)


@query(_COMP_ALL + "SELECT v.vec_id AS id, coalesce(k.root, v.vec_id) AS root FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL) v LEFT JOIN k ON k.id = v.vec_id")
def components_all(s, d):
    v = table(s, d, "embeddings")
    return V.with_singletons(V.components(V.similar_pairs(v, v, 10, 0.3)), v.select("vec_id"))


@query(_COMP_ALL + "SELECT DISTINCT coalesce(a.root, q.query_id) AS query_id, coalesce(b.root, q.vec_id) AS vec_id FROM r q LEFT JOIN k a ON a.id = q.query_id LEFT JOIN k b ON b.id = q.vec_id WHERE coalesce(a.root, q.query_id) <> coalesce(b.root, q.vec_id)")
def contract_nodes_all(s, d):
    v = table(s, d, "embeddings")
    near = cut(V.nearest(v, v, 10))
    pairs = near.where("query_id <> vec_id and sim >= 0.3").select(F.least("query_id", "vec_id").alias("i"), F.greatest("query_id", "vec_id").alias("j")).distinct()
    return V.contract(near.select("query_id", "vec_id"), V.components(pairs), "query_id", "vec_id")


# --- names, evidence, resolution ------------------------------------------------------------------

#: Patterns of a resolver and the names they stand for (parameters of the queries below).
PATTERNS = {"alumina|al2o3": "alumina", "zirconi": "zirconia", "silica|sio2": "silica", "^catalyst k": "catalyst", "oxide": "an oxide"}
_VALUES = ", ".join(f"('{p}', '{n}', {i})" for i, (p, n) in enumerate(PATTERNS.items()))


@query(f"SELECT n.name, v.canonical FROM (SELECT DISTINCT name FROM tree_nodes WHERE name IS NOT NULL) n JOIN (VALUES {_VALUES}) v(pattern, canonical, pos) ON regexp_matches(lower(n.name), v.pattern)")
def regex_resolve(s, d):
    names = nodes(s, d).where("name is not null").select("name").distinct()
    hits = F.filter(F.array(*[F.when(F.lower("name").rlike(p), F.lit(n)) for p, n in PATTERNS.items()]), lambda x: x.isNotNull())
    return names.select("name", F.explode(hits).alias("canonical"))


@query("SELECT name, min(row_id) AS row_id, count(*) AS n FROM tree_nodes n WHERE regexp_matches(lower(name), 'alumina|al2o3') AND type = 'chemical' GROUP BY name")
def name_detail(s, d):
    return nodes(s, d).where("type = 'chemical'").where(F.lower("name").rlike("alumina|al2o3")).groupBy("name").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))


@query("SELECT name, min_by(row_id, (CASE WHEN is_tested_catalyst THEN 0 ELSE 1 END, row_id)) AS row_id FROM tree_nodes WHERE type = 'chemical' AND name IS NOT NULL GROUP BY name")
def label_priority(s, d):
    """One node per name: a tested catalyst before other chemicals."""
    first = F.struct(F.when(F.col("is_tested_catalyst"), 0).otherwise(1).alias("a"), F.col("row_id").alias("b"))
    return nodes(s, d).where("type = 'chemical' and name is not null").groupBy("name").agg(F.min_by("row_id", first).alias("row_id"))


@query("SELECT quantity_id, paper_name, nullif(CASE WHEN length(source_text) > 40 THEN left(source_text, 40) || '...' ELSE source_text END, '') AS evidence FROM node_quantities WHERE source_text IS NOT NULL")
def evidence(s, d):
    return table(s, d, "node_quantities").where("source_text is not null").select("quantity_id", "paper_name", X.snippet(F.col("source_text"), 40).alias("evidence"))


@query("SELECT lower(trim(name)) AS alias_key, min(name) AS canonical, count(DISTINCT name) AS n_aliases FROM tree_nodes WHERE trim(name) <> '' GROUP BY 1")
def canonical_alias(s, d):
    return nodes(s, d).where(F.trim("name") != "").groupBy(F.lower(F.trim("name")).alias("alias_key")).agg(F.min("name").alias("canonical"), F.countDistinct("name").alias("n_aliases"))


@query("SELECT paper_name, max_by(lang, (n, lang)) AS lang FROM (SELECT paper_name, lower(lang) AS lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND paper_name IS NOT NULL GROUP BY ALL) GROUP BY paper_name")
def majority_vote(s, d):
    n = table(s, d, "documents").where("lang is not null and paper_name is not null").groupBy("paper_name", F.lower("lang").alias("lang")).agg(F.count("*").alias("n"))
    return n.groupBy("paper_name").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"))


@query("SELECT lower(trim(source)) AS k, md5(trim(source)) AS cache_key, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL")
def md5_key(s, d):
    return table(s, d, "documents").where("source is not null").groupBy(F.lower(F.trim("source")).alias("k"), F.md5(F.trim("source")).alias("cache_key")).agg(F.count("*").alias("n"))


# --- runs, usage, aggregates ----------------------------------------------------------------------

#: Statuses of runs.
STATUSES = ("success", "warning_no_synthesis_data", "warning_no_testing_data", "warning_no_testing_data_expected", "error_no_data_extracted", "worker_error", "other")
_IN = ", ".join(f"('{x}')" for x in STATUSES)


@query(f"""WITH b AS (SELECT * FROM (VALUES {_IN}) v(status)), r AS (SELECT CASE WHEN status IN (SELECT status FROM b) THEN status ELSE 'other' END AS status, ml_generation_status AS ml FROM run_meta)
SELECT b.status, count(r.status) AS n, count(*) FILTER (WHERE r.ml = 'done' AND b.status = 'success') AS n_ml_done, count(*) FILTER (WHERE starts_with(r.ml, 'skipped') AND b.status = 'success') AS n_ml_skipped,
count(*) FILTER (WHERE r.status IS NOT NULL AND b.status = 'success' AND coalesce(r.ml, 'unknown') <> 'done' AND NOT starts_with(coalesce(r.ml, 'unknown'), 'skipped')) AS n_ml_errors FROM b LEFT JOIN r USING (status) GROUP BY 1
UNION ALL SELECT 'total', count(*), count(*) FILTER (WHERE ml = 'done' AND status = 'success'), count(*) FILTER (WHERE starts_with(ml, 'skipped') AND status = 'success'), count(*) FILTER (WHERE status = 'success' AND coalesce(ml, 'unknown') <> 'done' AND NOT starts_with(coalesce(ml, 'unknown'), 'skipped')) FROM r""")
def run_status_summary(s, d):
    """Runs by status, each bucket with its row even if it is empty, and in total; model generation counts within successful runs."""
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("other")
    ml, good = F.coalesce("ml_generation_status", F.lit("unknown")), F.col("status") == "success"
    done, skipped = ml == "done", ml.startswith("skipped")
    r = table(s, d, "run_meta").withColumn("status", status)
    counts = [F.count("*").alias("n"), F.count_if(done & good).alias("n_ml_done"), F.count_if(skipped & good).alias("n_ml_skipped"), F.count_if(good & ~done & ~skipped).alias("n_ml_errors")]
    buckets = s.createDataFrame([(x,) for x in STATUSES], "status string")
    per = buckets.join(r.groupBy("status").agg(*counts), "status", "left").fillna(0)
    return per.unionByName(r.agg(*counts).select(F.lit("total").alias("status"), "n", "n_ml_done", "n_ml_skipped", "n_ml_errors"))


_J = "try_cast(replace(usage_metadata, '''', chr(34)) AS JSON)"
_FIRST = "list_filter(json_keys(j), lambda k: regexp_matches(coalesce(j ->> k ->> 'input_tokens', ''), '^-?[0-9]+$') AND regexp_matches(coalesce(j ->> k ->> 'output_tokens', ''), '^-?[0-9]+$'))[1]"
_USE = f"(SELECT *, CAST(j ->> m ->> 'input_tokens' AS BIGINT) AS i, CAST(j ->> m ->> 'output_tokens' AS BIGINT) AS o FROM (SELECT *, {_FIRST} AS m FROM (SELECT *, {_J} AS j FROM run_meta)))"


def _usage(s, d):
    """Token counts of each run: those of its first entry that has both as whole numbers."""
    r = table(s, d, "run_meta")
    return r.withColumn("_u", first_usage(r.columns)).withColumns({"i": F.col("_u.i"), "o": F.col("_u.o")}).drop("_u")


def first_usage(columns):
    """The first counted entry of usage_metadata, or else of usage_metadata_stage1 where there is such a column; a dict as text reads as JSON with single quotes."""
    read = lambda c: F.map_entries(F.from_json(c, "map<string,struct<input_tokens:string,output_tokens:string>>", {"allowSingleQuotes": "true"}))
    whole = lambda e: e["value"]["input_tokens"].rlike(r"^-?\d+$") & e["value"]["output_tokens"].rlike(r"^-?\d+$")
    first = lambda c: F.get(F.transform(F.filter(read(c), whole), lambda e: F.struct(e["value"]["input_tokens"].cast("long").alias("i"), e["value"]["output_tokens"].cast("long").alias("o"))), F.lit(0))
    main = F.nullif(F.col("usage_metadata"), F.lit(""))
    return first(F.coalesce(main, F.col("usage_metadata_stage1")) if "usage_metadata_stage1" in columns else main)


@query(f"""SELECT model_name, sum(i) AS input_tokens, sum(o) AS output_tokens, count(i) AS n_counted, count(*) - count(i) AS n_skipped, round(sum(i) / 1e6 * 2.5 + sum(o) / 1e6 * 10, 6) AS cost,
round((sum(i) / 1e6 * 2.5 + sum(o) / 1e6 * 10) / nullif(count(i), 0), 6) AS cost_per_run FROM {_USE} GROUP BY 1""")
def token_cost(s, d):
    """Tokens and cost by model, and the cost of an average counted run."""
    cost = F.sum("i") / 1e6 * 2.5 + F.sum("o") / 1e6 * 10
    return _usage(s, d).groupBy("model_name").agg(
        F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.count("i").alias("n_counted"), (F.count("*") - F.count("i")).alias("n_skipped"),
        F.round(cost, 6).alias("cost"), F.round(F.try_divide(cost, F.count("i")), 6).alias("cost_per_run"))


@query(f"SELECT paper_name, run_id, started_at, CAST(sum(coalesce(i, 0)) OVER (PARTITION BY paper_name ORDER BY started_at, run_id, file RANGE UNBOUNDED PRECEDING) AS BIGINT) AS running_input FROM (SELECT DISTINCT paper_name, run_id, started_at, file, i FROM {_USE} WHERE paper_name IS NOT NULL)")
def running_tokens(s, d):
    u = _usage(s, d).where("paper_name is not null").select("paper_name", "run_id", "started_at", "file", "i").distinct()
    w = W.partitionBy("paper_name").orderBy("started_at", "run_id", "file").rangeBetween(W.unboundedPreceding, 0)
    return u.select("paper_name", "run_id", "started_at", F.sum(F.coalesce("i", F.lit(0))).over(w).alias("running_input"))


@query("SELECT DISTINCT file, split_part(regexp_replace(file, '\\.[^.]*$', ''), '_', 1) AS paper FROM run_meta WHERE file IS NOT NULL")
def paper_names(s, d):
    return table(s, d, "run_meta").where("file is not null").select("file", F.split(X.stem(F.col("file")), "_")[0].alias("paper")).distinct()


@query("SELECT r.file, r.error_message, count(*) AS n FROM run_meta r WHERE r.status = 'worker_error' AND EXISTS (SELECT 1 FROM tree_raw t WHERE t.paper_name = r.paper_name) GROUP BY ALL")
def failed_with_graph(s, d):
    bad = table(s, d, "run_meta").where("status = 'worker_error'")
    return bad.join(table(s, d, "tree_raw").select("paper_name"), "paper_name", "left_semi").groupBy("file", "error_message").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, round(stddev_samp(l_quantity), 4) AS sd,
round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity), 4) AS median, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 FROM lineitem GROUP BY ALL""")
def agg_delegated(s, d):
    table(s, d, "lineitem").createOrReplaceTempView("weft_lineitem")
    return s.sql("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, round(stddev_samp(l_quantity), 4) AS sd,
    round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity), 4) AS median, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 FROM weft_lineitem GROUP BY ALL""")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def auto_limit(s, d):
    from weft.tools import Graph

    return Graph({"orders": table(s, d, "orders")}).query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")


# --- text -----------------------------------------------------------------------------------------


@query("SELECT text_id, md5(trim(replace(replace(replace(replace(replace('​ ' || full_text || ' ☐', '<!-- PageBreak -->', ''), '☐', ''), '☒', ''), '​', ''), '﻿', ''), ' \n\t    ')) AS m FROM paper_text WHERE length(full_text) > 0")
def clean_control(s, d):
    marked = F.concat(F.lit("​ "), "full_text", F.lit(" ☐"))
    return table(s, d, "paper_text").where(F.length("full_text") > 0).select("text_id", F.md5(X.clean_control(marked)).alias("m"))


@query("SELECT text_id, md5(regexp_replace(regexp_replace(regexp_replace(full_text, '<!--\\s*PageFooter=.*?-->', '', 'g'), '<!--\\s*PageHeader=.*?-->', '', 'g'), '<!--\\s*PageNumber=.*?-->', '', 'g')) AS m FROM paper_text")
def strip_comments(s, d):
    return table(s, d, "paper_text").select("text_id", F.md5(X.strip_page_comments(F.col("full_text"))).alias("m"))


@query("SELECT text_id, md5(regexp_replace('<figure>' || full_text || '</figure>' || full_text, '(<figure>)(?s:.*?)(</figure>)', '\\1\\2', 'g')) AS m FROM paper_text")
def empty_figures(s, d):
    return table(s, d, "paper_text").select("text_id", F.md5(X.empty_figures(F.concat(F.lit("<figure>"), "full_text", F.lit("</figure>"), "full_text"))).alias("m"))


@query("SELECT text_id, md5(regexp_replace(replace(full_text, chr(13), ''), '\n+', chr(10), 'g')) AS m FROM paper_text")
def single_newlines(s, d):
    return table(s, d, "paper_text").select("text_id", F.md5(X.single_newlines(F.col("full_text"))).alias("m"))


@query("SELECT text_id, md5(replace(replace(full_text, 'ﬂ', 'fl'), 'ﬁ', 'fi')) AS m FROM paper_text")
def ligatures(s, d):
    return table(s, d, "paper_text").select("text_id", F.md5(X.plain_ligatures(F.col("full_text"))).alias("m"))


@query("SELECT record_id, md5(nullif(trim(regexp_extract(payload, '```json\\s*\n((?s:.*?))\n```', 1), ' \n'), '')) AS block FROM tree_raw WHERE payload IS NOT NULL")
def fenced_json(s, d):
    return table(s, d, "tree_raw").where("payload is not null").select("record_id", F.md5(X.fenced(F.col("payload"), "json")).alias("block"))


@query("SELECT quantity_id, try_cast(trim(value) AS DOUBLE) AS number FROM node_quantities")
def try_number(s, d):
    v = F.trim("value")
    # Java also reads a letter after a number as its type.
    return table(s, d, "node_quantities").select("quantity_id", F.when(~v.rlike("[dDfF]$"), v.try_cast("double")).alias("number"))


@query("SELECT event_id, value + 273.15 AS kelvin, value / 1000 AS kg, value * 60 AS ml_min FROM events")
def unit_convert(s, d):
    q = lambda v, kind, a, b: U.convert(F.col("value"), F.lit(kind), F.lit(a), F.lit(b)).alias(v)
    return table(s, d, "events").select("event_id", q("kelvin", "temperature", "degC", "K"), q("kg", "mass", "g", "kg"), q("ml_min", "flow_rate", "mL/s", "mL/min"))
