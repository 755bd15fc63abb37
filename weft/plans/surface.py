"""Queries of the property graph, single papers' trees, layout and resolution, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import layout as Y
from weft.functions.names import strip
from weft.operators import graph as G
from weft.operators import kg as K
from weft.operators import nested
from weft.operators import trees as T
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


def _nodes(s, d):
    return table(s, d, "tree_nodes")


def _edges(s, d):
    return table(s, d, "tree_edges")


# --- the property graph ---------------------------------------------------------------------------

_LABEL = """CASE WHEN lower(trim(type)) = 'chemical' AND is_tested_catalyst THEN 'Catalyst' WHEN lower(trim(type)) = 'chemical' THEN 'Chemical' WHEN lower(trim(type)) = 'synthesis' THEN 'Synthesis'
WHEN lower(trim(type)) = 'testing' THEN 'Testing' WHEN lower(trim(type)) = 'characterization' THEN 'Characterization' WHEN lower(trim(type)) = 'catalyst' THEN 'Catalyst' ELSE 'UnknownNode' END"""
_REL = """CASE lower(trim(type)) WHEN 'synthesis_input' THEN 'SYNTHESIS_INPUT' WHEN 'synthesis_output' THEN 'SYNTHESIS_OUTPUT' WHEN 'tested_in' THEN 'TESTED_IN' WHEN 'characterized_in' THEN 'CHARACTERIZED_IN'
WHEN 'appear_in' THEN 'APPEAR_IN' WHEN 'with_basicmaterial' THEN 'WITH_BASICMATERIAL' ELSE 'RELATED_TO' END"""
_KG = f"""n AS (SELECT paper_name, catalyst_id, trim(id) AS id, {_LABEL} AS label, name, synthesis_level AS level, attrs FROM tree_nodes WHERE trim(id) <> '' AND trim(type) <> '' AND lower(trim(type)) <> 'paper'
QUALIFY row_number() OVER (PARTITION BY paper_name, catalyst_id, trim(id), {_LABEL} ORDER BY loaded_at DESC, row_id DESC) = 1)"""
_RELS = f"""e AS (SELECT x.paper_name, x.catalyst_id, trim(x.source_id) AS source_id, trim(x.target_id) AS target_id, {_REL} AS rel_type, coalesce(nullif(trim(x.id), ''), concat_ws('_', trim(x.source_id), trim(x.target_id), lower(trim(type)))) AS edge_id FROM tree_edges x
WHERE trim(type) <> '' AND lower(trim(type)) NOT IN ('with_basicmaterial', 'has_component') AND EXISTS (SELECT 1 FROM n WHERE n.paper_name IS NOT DISTINCT FROM x.paper_name AND n.catalyst_id IS NOT DISTINCT FROM x.catalyst_id AND n.id = trim(x.source_id))
AND EXISTS (SELECT 1 FROM n WHERE n.paper_name IS NOT DISTINCT FROM x.paper_name AND n.catalyst_id IS NOT DISTINCT FROM x.catalyst_id AND n.id = trim(x.target_id)) AND trim(x.source_id) <> '' AND trim(x.target_id) <> ''
QUALIFY row_number() OVER (PARTITION BY x.paper_name, x.catalyst_id, trim(x.source_id), trim(x.target_id), {_REL} ORDER BY x.loaded_at DESC, x.row_id DESC) = 1)"""


@query(f"WITH {_KG} SELECT paper_name, catalyst_id, id, label, name, coalesce(level, -1) AS level FROM n")
def kg_nodes(s, d):
    return K.kg_nodes(_nodes(s, d)).drop("attrs").fillna(-1, ["level"])


@query(f"WITH {_KG}, {_RELS} SELECT * FROM e")
def kg_edges(s, d):
    return K.kg_edges(_edges(s, d), K.kg_nodes(_nodes(s, d)))


@query("""SELECT 'node' AS kind, count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce(trim(id) <> '' AND trim(type) <> '', false)) AS n_rejected FROM tree_nodes
UNION ALL SELECT 'edge', count(*), count(*) FILTER (WHERE NOT coalesce(trim(type) <> '' AND trim(source_id) <> '' AND trim(target_id) <> '', false)) FROM tree_edges""")
def kg_rejected(s, d):
    return K.rejected(_nodes(s, d), _edges(s, d))


@query("SELECT DISTINCT paper_name FROM tree_nodes WHERE paper_name IS NOT NULL AND trim(id) <> '' AND trim(type) <> ''")
def kg_papers(s, d):
    return K.papers(K.kg_nodes(_nodes(s, d)))


@query(f"WITH {_KG} SELECT paper_name, catalyst_id, id FROM n WHERE label = 'Catalyst' AND paper_name IS NOT NULL AND EXISTS (SELECT 1 FROM tree_nodes t WHERE t.is_tested_catalyst AND lower(trim(t.type)) = 'chemical' AND t.paper_name = n.paper_name AND t.catalyst_id IS NOT DISTINCT FROM n.catalyst_id AND trim(t.id) = n.id)")
def kg_appear_in(s, d):
    return K.appear_in(K.kg_nodes(_nodes(s, d)), _nodes(s, d))


@query("SELECT trim(id) AS id, count(DISTINCT coalesce(paper_name, '∅') || chr(1) || coalesce(catalyst_id, '∅')) AS n FROM tree_nodes WHERE trim(id) <> '' AND trim(type) <> '' AND lower(trim(type)) <> 'paper' GROUP BY 1 HAVING count(DISTINCT coalesce(paper_name, '∅') || chr(1) || coalesce(catalyst_id, '∅')) > 1")
def ids_in_several_trees(s, d):
    """Ids that would break uniqueness were they not kept apart by tree."""
    one = K.kg_nodes(_nodes(s, d)).select(*TREE, "id").distinct()
    return K.violations(one, ["id"])


@query(f"""WITH {_KG}, made AS (SELECT DISTINCT paper_name, catalyst_id, trim(target_id) AS id FROM tree_edges WHERE lower(trim(type)) = 'synthesis_output'),
c AS (SELECT * FROM n WHERE label IN ('Chemical', 'Catalyst') AND (EXISTS (SELECT 1 FROM tree_nodes t WHERE t.is_tested_catalyst AND t.paper_name IS NOT DISTINCT FROM n.paper_name AND t.catalyst_id IS NOT DISTINCT FROM n.catalyst_id AND trim(t.id) = n.id)
OR NOT EXISTS (SELECT 1 FROM made m WHERE m.paper_name IS NOT DISTINCT FROM n.paper_name AND m.catalyst_id IS NOT DISTINCT FROM n.catalyst_id AND m.id = n.id))),
f AS (SELECT *, trim(coalesce(CASE WHEN map_contains(attrs, 'chemical formula') THEN json_extract_string(attrs['chemical formula'], '$') ELSE json_extract_string(attrs['formula'], '$') END, '')) AS g FROM c),
k AS (SELECT paper_name, catalyst_id, trim(node_id) AS id, trim(split_part(quantity, '(', 1)) AS material, value, unit FROM node_quantities WHERE holder = 'composition' AND trim(split_part(quantity, '(', 1)) <> ''
QUALIFY row_number() OVER (PARTITION BY paper_name, catalyst_id, trim(node_id), trim(split_part(quantity, '(', 1)) ORDER BY loaded_at DESC, quantity_id DESC) = 1)
SELECT paper_name, catalyst_id, id, CASE WHEN instr(g, '(') > 1 THEN trim(split_part(g, '(', 1)) ELSE g END AS material, 'formula' AS source_property, NULL::VARCHAR AS value, NULL::VARCHAR AS unit FROM f WHERE g <> ''
UNION ALL SELECT k.paper_name, k.catalyst_id, k.id, material, 'composition', value, unit FROM k WHERE EXISTS (SELECT 1 FROM f WHERE g = '' AND f.paper_name IS NOT DISTINCT FROM k.paper_name AND f.catalyst_id IS NOT DISTINCT FROM k.catalyst_id AND f.id = k.id)
UNION ALL SELECT f.paper_name, f.catalyst_id, f.id, trim(split_part(name, '(', 1)), 'name', NULL, NULL FROM f WHERE g = '' AND label <> 'Catalyst' AND trim(split_part(name, '(', 1)) <> '' AND NOT EXISTS (SELECT 1 FROM k WHERE f.paper_name IS NOT DISTINCT FROM k.paper_name AND f.catalyst_id IS NOT DISTINCT FROM k.catalyst_id AND f.id = k.id)""")
def basic_materials(s, d):
    """Materials by formula, else composition with value and unit, else name; only of starting materials and catalysts."""
    q = table(s, d, "node_quantities").where("holder = 'composition'")
    return K.basic_materials(_nodes(s, d), _edges(s, d), q)


@query("""SELECT row_id, CASE WHEN k = 'procedure' OR k = 'method' OR k NOT IN ('id', 'type', 'original_id', 'is_catalyst', 'is_tested_catalyst') THEN regexp_replace(trim(k), '[ .\\-]', '_', 'g') END AS prop, CASE WHEN v = 'null' THEN NULL WHEN starts_with(v, '"') THEN json_extract_string(v, '$') ELSE v END AS value
FROM (SELECT row_id, unnest(map_keys(attrs)) AS k, trim(unnest(map_values(attrs))) AS v FROM tree_nodes) WHERE NOT starts_with(coalesce(v, ''), '{')""")
def flat_attributes(s, d):
    return K.flat_attributes(_nodes(s, d), ["row_id"])


@query("SELECT DISTINCT unnest(map_keys(attrs)) AS key FROM (SELECT attrs FROM tree_nodes UNION ALL SELECT attrs FROM tree_edges)")
def field_keys(s, d):
    return K.field_names(_nodes(s, d), _edges(s, d))


@query(f"WITH {_KG} SELECT label, array_to_string(list_sort(list(DISTINCT k)), '|') AS keys FROM (SELECT label, unnest(map_keys(attrs)) AS k FROM n) GROUP BY 1")
def schema_labels(s, d):
    """Property names of each label."""
    return K.kg_nodes(_nodes(s, d)).select("label", F.explode(F.map_keys("attrs")).alias("k")).groupBy("label").agg(F.array_join(F.sort_array(F.collect_set("k")), "|").alias("keys"))


@query(f"WITH {_KG}, {_RELS} SELECT DISTINCT rel_type FROM e")
def schema_relationships(s, d):
    return kg_edges(s, d).select("rel_type").distinct()


# --- paths ----------------------------------------------------------------------------------------

_PATH = f"""WITH RECURSIVE {_KG}, {_RELS}, a AS (SELECT DISTINCT e.paper_name AS p, e.catalyst_id AS c, source_id AS f, target_id AS t FROM e JOIN n ON n.paper_name = e.paper_name AND n.catalyst_id = e.catalyst_id AND n.id = e.source_id AND n.label = 'Synthesis' WHERE rel_type = 'SYNTHESIS_OUTPUT'
UNION SELECT DISTINCT e.paper_name, e.catalyst_id, source_id, target_id FROM e JOIN n ON n.paper_name = e.paper_name AND n.catalyst_id = e.catalyst_id AND n.id = e.source_id AND n.label = 'Chemical' JOIN n m ON m.paper_name = e.paper_name AND m.catalyst_id = e.catalyst_id AND m.id = e.target_id AND m.label = 'Synthesis' WHERE rel_type = 'SYNTHESIS_INPUT'),
r AS (SELECT DISTINCT paper_name AS p, catalyst_id AS c, id AS target_id, id, 0 AS dist FROM n WHERE label = 'Catalyst' UNION SELECT r.p, r.c, r.target_id, a.f, r.dist + 1 FROM r JOIN a ON a.p = r.p AND a.c = r.c AND a.t = r.id WHERE r.dist < 20),
m AS (SELECT p AS paper_name, c AS catalyst_id, target_id, id, min(dist) AS dist FROM r GROUP BY ALL)
SELECT paper_name, catalyst_id, target_id, row_number() OVER (PARTITION BY paper_name, catalyst_id, target_id ORDER BY dist DESC, id) AS pos, id, name, json_extract_string(attrs['method'], '$') AS method, json_extract_string(attrs['procedure'], '$') AS procedure, dist
FROM m JOIN n USING (paper_name, catalyst_id, id) WHERE label = 'Synthesis' AND dist > 0"""


@query(_PATH)
def synthesis_path(s, d):
    """The steps behind every catalyst, from the earliest to the latest."""
    kg = cut(K.kg_nodes(_nodes(s, d)))
    targets = kg.where("label = 'Catalyst'").select(*TREE, F.col("id").alias("target_id"))
    return K.synthesis_path(targets, kg, K.kg_edges(_edges(s, d), kg))


#: Identifiers that are asked for (parameters of the queries below).
ASKED = ("chem_K1", "iron oxide", "Final catalyst K2", "no such node")
_ASKED = ", ".join(f"('{x}')" for x in ASKED)


@query(f"""WITH {_KG}, a AS (SELECT * FROM (VALUES {_ASKED}) v(identifier)), h AS (SELECT a.identifier, n.* FROM a JOIN n ON (n.id = a.identifier OR n.name = a.identifier) AND label IN ('Catalyst', 'Chemical'))
SELECT a.identifier, NULL::VARCHAR AS paper, paper_name, catalyst_id, id AS target_id FROM a LEFT JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY label <> 'Catalyst', id, coalesce(paper_name, ''), coalesce(catalyst_id, '')) = 1) USING (identifier)""")
def find_target(s, d):
    asked = s.createDataFrame([(x, None) for x in ASKED], "identifier string, paper string")
    return K.find_targets(asked, K.kg_nodes(_nodes(s, d)))


# --- resolution -----------------------------------------------------------------------------------

#: Patterns of names and fields, and what they stand for (parameters).
NAME_PATTERNS = {"alumina|al2o3|氧化铝": "alumina", "iron.?oxide|fe2o3": "iron oxide", "calcium": "calcium oxide", "oxide$": "copper oxide"}
FIELD_PATTERNS = {"how|recipe|procedure": "procedure", "method|technique": "method", "other name|alias": "aliases"}
PHRASES = ("How was it made", "the technique used", "Other names", "what method and procedure", "   ")
_P = lambda ps: ", ".join(f"({i}, '{p}', '{n}')" for i, (p, n) in enumerate(ps.items()))
_PH = ", ".join(f"('{p}')" for p in PHRASES)


@query(f"""WITH {_KG}, w AS (SELECT * FROM (VALUES {_P(NAME_PATTERNS)}) v(pos, pattern, canonical)), q AS (SELECT DISTINCT name AS phrase FROM tree_nodes WHERE name <> ''),
h AS (SELECT phrase, canonical, min(pos) AS pos FROM q JOIN w ON regexp_matches(phrase, pattern, 'i') GROUP BY ALL), o AS (SELECT name, max_by(label, (id, label)) AS label, max(id) AS id FROM n WHERE name IS NOT NULL AND label IN ('Chemical', 'Catalyst') GROUP BY name)
SELECT phrase, row_number() OVER (PARTITION BY phrase ORDER BY pos) AS rank, name, id, label, 1.0::DOUBLE AS score, 'regex' AS source FROM h JOIN o ON o.name = h.canonical QUALIFY rank <= 5""")
def resolve_names(s, d):
    """Every stored name as a free name, by patterns."""
    names = _nodes(s, d).select(F.col("name").alias("phrase"))
    out = K.resolve_names(names, K.kg_nodes(_nodes(s, d)), NAME_PATTERNS, labels=["Chemical", "Catalyst"])
    return out.select("phrase", F.col("rank").cast("long").alias("rank"), "name", "id", "label", "score", "source")


@query()
def resolve_names_vector(s, d):
    """Canonical names of the list and what stored names come nearest, by vectors of a stub embedder."""
    from weft.plugins import hashed_embedder

    names = table(s, d, "material_ref").select(F.col("canonical_name").alias("phrase"))
    return K.resolve_names(names, K.kg_nodes(_nodes(s, d)), {}, hashed_embedder, threshold=0.5)


@query(f"""WITH w AS (SELECT * FROM (VALUES {_P(FIELD_PATTERNS)}) v(pos, pattern, canonical)), q AS (SELECT * FROM (VALUES {_PH}) v(phrase))
SELECT phrase, row_number() OVER (PARTITION BY phrase ORDER BY min(pos)) AS rank, canonical AS key, 1.0::DOUBLE AS score, 'regex' AS source FROM q JOIN w ON regexp_matches(phrase, pattern, 'i') GROUP BY phrase, canonical""")
def resolve_fields(s, d):
    phrases = s.createDataFrame([(p,) for p in PHRASES], "phrase string")
    out = K.resolve_fields(phrases, field_keys(s, d), FIELD_PATTERNS)
    return out.select("phrase", F.col("rank").cast("long").alias("rank"), "key", "score", "source")


@query("SELECT count(DISTINCT name) AS n FROM tree_nodes WHERE name IS NOT NULL")
def index_names(s, d):
    """Names in an index; the fingerprint beside the count tells whether it must be built again."""
    return K.fingerprint(_nodes(s, d)).select("n")


# --- merging materials ----------------------------------------------------------------------------


def _named(s, d):
    """Distinct material names with the smallest row that has them, and their English names by the list."""
    names = _nodes(s, d).where("type = 'chemical' and name is not null").groupBy("name").agg(F.min("row_id").alias("id"))
    return K.translated(names.select("id", "name"), table(s, d, "material_ref").select(F.col("name_zh").alias("term"), F.col("canonical_name").alias("name_en")))


_NAMED = """n AS (SELECT name, min(row_id) AS id FROM tree_nodes WHERE type = 'chemical' AND name IS NOT NULL GROUP BY name), t AS (SELECT name_zh, min(canonical_name) AS name_en FROM material_ref WHERE name_zh IS NOT NULL AND canonical_name IS NOT NULL GROUP BY 1),
z AS (SELECT id, name, coalesce(name_en, name) AS name_en FROM n LEFT JOIN t ON t.name_zh = n.name)"""
_PLAN = f"""{_NAMED}, p AS (SELECT z.id, z.name, z.name_en AS new_name, CASE WHEN z.name_en <> z.name AND h.id IS NOT NULL AND h.id <> z.id THEN h.id ELSE z.id END AS keep_id FROM z LEFT JOIN z h ON h.name = z.name_en),
q AS (SELECT *, CASE WHEN keep_id <> id THEN 'merge' WHEN new_name <> name THEN 'rename' ELSE 'keep' END AS action FROM p)"""


@query(f"WITH {_PLAN} SELECT id, name, new_name, keep_id, action FROM q")
def merge_plan(s, d):
    """Renames and merges of materials after translation."""
    return K.merge_plan(_named(s, d))


@query(f"WITH {_PLAN} SELECT count(*) AS n_before, count(*) FILTER (WHERE action = 'merge') AS n_merged, count(*) FILTER (WHERE action = 'rename') AS n_renamed, count(*) FILTER (WHERE action <> 'merge') AS n_after FROM q")
def merge_reduction(s, d):
    return K.merge_reduction(K.merge_plan(_named(s, d)))


@query()
def merge_workflow(s, d):
    """The whole job: translate, embed, pair by vectors, check pairs, cluster, choose a name, merge or rename."""
    from weft.plugins import hashed_embedder

    named = cut(_named(s, d))
    return K.merge_plan(named, K.similar_names(named, hashed_embedder, 10, 0.75))


# --- single papers --------------------------------------------------------------------------------


@query("""WITH t AS (SELECT paper_name, catalyst_id, count(*) FILTER (WHERE type = 'synthesis') AS n_synthesis, count(*) FILTER (WHERE type = 'testing') AS n_testing, count(*) FILTER (WHERE type = 'characterization') AS n_characterization, count(*) FILTER (WHERE is_tested_catalyst) AS n_tested FROM tree_nodes GROUP BY ALL)
SELECT *, CASE WHEN n_synthesis + n_testing + n_characterization = 0 THEN 'error_no_data_extracted' WHEN n_synthesis = 0 THEN 'warning_no_synthesis_data' WHEN n_testing = 0 AND n_tested > 0 THEN 'warning_no_testing_data_expected' WHEN n_testing = 0 THEN 'warning_no_testing_data' ELSE 'success' END AS status FROM t""")
def tree_status(s, d):
    n = _nodes(s, d).groupBy(*TREE).agg(*[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in T.SECTIONS], F.count_if(F.coalesce("is_tested_catalyst", F.lit(False))).alias("n_tested"))
    return T.extraction_status(n)


@query()
def section_merge(s, d):
    """Chemicals and steps of each written graph after its sections are merged."""
    n = nested.nodes(table(s, d, "tree_raw")).select("record_id", "section", "pos", "id", "type", "name")
    none = n.where("false").select("record_id", "id")
    return T.merge_sections(n, none, ["record_id"]).select("record_id", "section", "pos", "id", "type", "is_tested")


_T_N = "n AS (SELECT paper_name, catalyst_id, trim(id) AS id, max_by(type, (loaded_at, row_id)) AS type FROM tree_nodes WHERE trim(id) <> '' GROUP BY ALL)"
_T_E = "e AS (SELECT row_id, paper_name, catalyst_id, trim(source_id) AS source_id, trim(target_id) AS target_id, lower(trim(type)) AS type FROM tree_edges WHERE trim(source_id) <> '' AND trim(target_id) <> '')"
_TREES = f"""WITH RECURSIVE {_T_N}, {_T_E}, s AS (SELECT DISTINCT paper_name AS p, catalyst_id AS c, trim(id) AS target_id FROM tree_nodes WHERE is_tested_catalyst),
l AS (SELECT DISTINCT paper_name AS p, catalyst_id AS c, source_id AS f, target_id AS t FROM e WHERE type NOT IN ('tested_in', 'characterized_in')),
r AS (SELECT p, c, target_id, target_id AS id, 0 AS dist FROM s UNION SELECT r.p, r.c, r.target_id, l.f, r.dist + 1 FROM r JOIN l ON l.p = r.p AND l.c = r.c AND l.t = r.id WHERE r.dist < 120),
m AS (SELECT p AS paper_name, c AS catalyst_id, target_id, id, min(dist) AS dist FROM r GROUP BY ALL),
k AS (SELECT m.*, n.type FROM m JOIN n USING (paper_name, catalyst_id, id)),
g AS (SELECT paper_name, catalyst_id, target_id, id, type, 'synthesis' AS part, CASE WHEN type = 'synthesis' THEN row_number() OVER (PARTITION BY paper_name, catalyst_id, target_id, type ORDER BY dist DESC, id) END AS level FROM k),
o AS (SELECT e.row_id, e.paper_name, e.catalyst_id, e.source_id AS target_id, e.target_id AS id, CASE e.type WHEN 'tested_in' THEN 'testing' ELSE 'characterization' END AS part FROM e JOIN s ON s.p = e.paper_name AND s.c = e.catalyst_id AND s.target_id = e.source_id WHERE e.type IN ('tested_in', 'characterized_in'))
"""


def _target_tree(s, d):
    n = G.last_by(_nodes(s, d).select(*TREE, strip("id").alias("id"), "type", "loaded_at", "row_id").where("id <> ''"), [*TREE, "id"], ["loaded_at", "row_id"])
    e = _edges(s, d).select("row_id", *TREE, strip("source_id").alias("source_id"), strip("target_id").alias("target_id"), "type").where("source_id <> '' and target_id <> ''")
    targets = _nodes(s, d).where("is_tested_catalyst").select(*TREE, strip("id").alias("target_id"))
    return T.target_tree(n.select(*TREE, "id", "type"), e, targets)


@query(_TREES + "SELECT * REPLACE (coalesce(level, 0) AS level) FROM g UNION SELECT o.paper_name, o.catalyst_id, o.target_id, o.id, n.type, part, 0 FROM o JOIN n ON n.paper_name = o.paper_name AND n.catalyst_id = o.catalyst_id AND n.id = o.id AND n.type = o.part")
def target_trees(s, d):
    """Nodes of each tested target's tree, with levels of steps, tests and characterizations."""
    return _target_tree(s, d)[0].fillna(0, ["level"])


@query(_TREES + "SELECT m.paper_name, m.catalyst_id, m.target_id, e.row_id, 'synthesis' AS part FROM m JOIN e ON e.paper_name = m.paper_name AND e.catalyst_id = m.catalyst_id AND e.target_id = m.id WHERE e.type NOT IN ('tested_in', 'characterized_in') UNION ALL SELECT paper_name, catalyst_id, target_id, row_id, part FROM o")
def target_tree_edges(s, d):
    """Edges of each tested target's tree."""
    return _target_tree(s, d)[1]


@query(_TREES + "SELECT DISTINCT paper_name, catalyst_id, id FROM n WHERE type = 'synthesis' AND NOT EXISTS (SELECT 1 FROM m WHERE m.paper_name IS NOT DISTINCT FROM n.paper_name AND m.catalyst_id IS NOT DISTINCT FROM n.catalyst_id AND m.id = n.id)")
def unreached_steps(s, d):
    n = G.last_by(_nodes(s, d).select(*TREE, strip("id").alias("id"), "type", "loaded_at", "row_id").where("id <> ''"), [*TREE, "id"], ["loaded_at", "row_id"])
    return T.unreached_steps(_target_tree(s, d)[0], n)


@query()
def scenario_texts(s, d):
    """The readable text of every written tree that can be read."""
    return T.tree_texts(table(s, d, "tree_raw"))


@query()
def step_loops(s, d):
    return T.step_loops(_nodes(s, d), _edges(s, d))


@query("""SELECT paper_name, catalyst_id, trim(source_id) AS catalyst, trim(target_id) AS char_id, count(*) AS n_edges, max(CASE WHEN EXISTS (SELECT 1 FROM tree_nodes n WHERE n.type = 'characterization' AND n.paper_name IS NOT DISTINCT FROM e.paper_name AND n.catalyst_id IS NOT DISTINCT FROM e.catalyst_id AND trim(n.id) = trim(e.target_id)) THEN 1 ELSE 0 END) AS has_node
FROM tree_edges e WHERE lower(trim(type)) = 'characterized_in' AND trim(target_id) <> '' GROUP BY ALL""")
def characterized_left(s, d):
    """Characterization edges with and without their node."""
    from weft.functions.names import join_on

    e = _edges(s, d).where(F.lower(strip("type")) == "characterized_in").select(*TREE, strip("source_id").alias("catalyst"), strip("target_id").alias("char_id")).where("char_id <> ''")
    t = _nodes(s, d).where("type = 'characterization'").select(*TREE, strip("id").alias("char_id"), F.lit(1).alias("hit")).distinct()
    return join_on(e, t, [*TREE, "char_id"], "left").groupBy(*TREE, "catalyst", "char_id").agg(F.count("*").alias("n_edges"), F.max(F.coalesce("hit", F.lit(0))).alias("has_node"))


# --- layout ---------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT text_id, unnest(string_split(coalesce(full_text, ''), '<!-- PageBreak -->')) AS t, generate_subscripts(string_split(coalesce(full_text, ''), '<!-- PageBreak -->'), 1) AS page FROM paper_text),
c AS (SELECT *, length(t) - length(replace(t, '�', '')) AS bad FROM p), w AS (SELECT *, length(t) - sum(bad) OVER (PARTITION BY text_id ORDER BY page) AS rest FROM c)
SELECT text_id, CAST(sum(rest) AS BIGINT) AS text_length, CAST(sum(bad) AS BIGINT) AS bad_characters, sum(rest) < 100 OR sum(bad) > sum(rest) AS is_image FROM w GROUP BY 1""")
def image_pages(s, d):
    """Texts that come from pictures of pages, by their length and bad characters page by page."""
    pages = table(s, d, "paper_text").select("text_id", F.posexplode(F.split(F.coalesce("full_text", F.lit("")), "<!-- PageBreak -->", -1)).alias("page", "text"))
    return Y.image_pages(pages, "text_id")


@query("""WITH c AS (SELECT text_id, k.line_no - 1 AS r, unnest(string_split(line, ' | ')) AS cell, generate_subscripts(string_split(line, ' | '), 1) - 1 AS c FROM (SELECT text_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM (SELECT text_id, list_filter(string_split(full_text, chr(10)), lambda x: contains(x, ' | ') AND NOT contains(x, '"')) AS lines FROM paper_text)) k),
m AS (SELECT text_id, max(r) AS rs, max(c) AS cs FROM c GROUP BY 1), g AS (SELECT text_id, unnest(generate_series(0, rs)) AS r, cs FROM m), h AS (SELECT text_id, r, unnest(generate_series(0, cs)) AS c FROM g),
l AS (SELECT h.text_id, h.r, string_agg(CASE WHEN contains(cell, '|') THEN '"' || cell || '"' ELSE coalesce(cell, '') END, '|' ORDER BY h.c) AS line FROM h LEFT JOIN c ON c.text_id = h.text_id AND c.r = h.r AND c.c = h.c GROUP BY ALL)
SELECT text_id, string_agg(line, chr(10) ORDER BY r) || chr(10) AS text FROM l GROUP BY 1""")
def table_grid(s, d):
    """The table lines of each text as a grid of cells."""
    lines = F.filter(F.split("full_text", "\n"), lambda x: x.contains(" | ") & ~x.contains('"'))
    cells = table(s, d, "paper_text").select("text_id", F.posexplode(lines).alias("row_index", "line")).select("text_id", "row_index", F.posexplode(F.split("line", r" \| ")).alias("column_index", "content"))
    return Y.table_text(cells, "text_id")


#: Section names that texts are searched for (a parameter).
KNOWN_SECTIONS = ("Results", "Results and Discussion", "Methods", "Experimental", "Discussion", "方法")


@query("""SELECT text_id, md5(CASE WHEN contains(full_text, 'Results and Discussion') THEN replace(t0, 'Results and Discussion', 'Section:Results and Discussion' || chr(10)) ELSE CASE WHEN contains(t1, 'Results') THEN replace(t1, 'Results', 'Section:Results' || chr(10)) ELSE t1 END END) AS m FROM (SELECT text_id, full_text, full_text AS t0, full_text AS t1 FROM paper_text WHERE full_text IS NOT NULL)""")
def section_marks(s, d):
    """Two titles, one inside the other, marked in every text."""
    known = F.array(F.lit("Results"), F.lit("Results and Discussion"))
    return table(s, d, "paper_text").where("full_text is not null").select("text_id", F.md5(Y.marked_sections(F.col("full_text"), known)).alias("m"))


@query("""WITH l AS (SELECT text_id, unnest(string_split(full_text, chr(10))) AS line, generate_subscripts(string_split(full_text, chr(10)), 1) AS k FROM paper_text WHERE full_text <> ''),
b AS (SELECT *, CASE WHEN contains(line, ' | ') THEN 'table' WHEN starts_with(line, 'Section:') THEN 'title' ELSE 'text' END AS kind FROM l), a AS (SELECT *, lead(kind) OVER (PARTITION BY text_id ORDER BY k) AS nxt FROM b)
SELECT text_id, md5(string_agg(line || CASE WHEN kind = 'table' THEN '' WHEN kind = 'title' OR nxt = 'table' THEN chr(10) ELSE chr(10) || chr(10) END || CASE WHEN nxt IS NULL THEN chr(10) ELSE '' END, '' ORDER BY k)) AS m FROM a GROUP BY 1""")
def joined_blocks(s, d):
    """Lines as blocks of one page, joined by the rules of blocks."""
    kind = F.when(F.col("text").contains(" | "), "table").when(F.col("text").startswith("Section:"), "title").otherwise("text")
    b = table(s, d, "paper_text").where("full_text <> ''").select("text_id", F.posexplode(F.split("full_text", "\n")).alias("block_no", "text")).select("text_id", F.lit(1).alias("page"), "block_no", kind.alias("kind"), "text")
    return Y.joined_blocks(b, "text_id").select("text_id", F.md5("text").alias("m"))


@query("SELECT text_id, array_to_string(list_filter(string_split(full_text, chr(10)), lambda x: length(x) > 1 AND regexp_matches(x, '^\\p{Lu}')), '|') AS titles FROM paper_text WHERE full_text IS NOT NULL")
def title_lines(s, d):
    return table(s, d, "paper_text").where("full_text is not null").select("text_id", F.array_join(Y.titles(F.split("full_text", "\n")), "|").alias("titles"))


@query("SELECT subject, title || '|' || upper(left(title, 1)) || lower(substring(title, 2)) || '|' || upper(title) AS forms FROM subject_ref")
def title_casings(s, d):
    return table(s, d, "subject_ref").select("subject", F.array_join(Y.casings(F.array("title")), "|").alias("forms"))
