"""The property graph of all papers: labelled nodes and relationships, materials, papers, key constraints, and paths through it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions import jsontext as J
from weft.functions import text as X
from weft.functions.names import filled, join_on, strip
from weft.operators import graph as G
from weft.operators import lineage as L
from weft.session import cut

TREE = G.TREE
#: Members that are not stored as properties, prefixes of flattened members, and edges that import makes itself.
SKIPPED = ("id", "type", "original_id", "is_catalyst", "is_tested_catalyst")
PREFIXES = {"properties": "property", "conditions": "condition", "conditions_json": "condition", "results": "result", "results_json": "result", "composition": "composition"}
OWN_EDGES = ("with_basicmaterial", "has_component")


def rejected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many rows lack what a node (id, type) or an edge (type, both ends) must have: kind, n_rows, n_rejected; a count of zero is a row, too."""

    def part(df: DataFrame, kind: str, *must: str) -> DataFrame:
        whole = F.forall(F.array(*[strip(c) for c in must]), lambda x: F.coalesce(filled(x), F.lit(False)))
        return df.agg(F.count("*").alias("n_rows"), F.count_if(~whole).alias("n_rejected")).select(F.lit(kind).alias("kind"), "n_rows", "n_rejected")

    return part(nodes, "node", "id", "type").unionByName(part(edges, "edge", "type", "source_id", "target_id"))


def kg_nodes(nodes: DataFrame) -> DataFrame:
    """One row per label and id, the last by (loaded_at, row_id): tree columns, id, label, name, level, attrs.

    Rows without id or type, and papers, are no nodes here; a node given with two types is two nodes.
    """
    n = nodes.where(filled(strip("id")) & filled(strip("type")) & (F.lower(strip("type")) != "paper"))
    n = n.select(*TREE, strip("id").alias("id"), G.label(strip("type"), F.col("is_tested_catalyst")).alias("label"), "name", F.col("synthesis_level").alias("level"), "attrs", "loaded_at", "row_id")
    return G.last_by(n, [*TREE, "id", "label"], ["loaded_at", "row_id"]).drop("loaded_at", "row_id")


def kg_edges(edges: DataFrame, kg: DataFrame) -> DataFrame:
    """One row per pair of ends and relationship type, the last by (loaded_at, row_id): tree columns, source_id, target_id, rel_type, edge_id.

    Edges whose ends are no nodes make nothing; edges to materials are left to ``basic_materials``.
    An edge without an id gets one of its ends and type.
    """
    kind = F.lower(strip("type"))
    e = edges.where(filled(kind) & ~kind.isin(*OWN_EDGES)).select(*TREE, strip("source_id").alias("source_id"), strip("target_id").alias("target_id"), G.relation(F.col("type")).alias("rel_type"), F.nullif(strip("id"), F.lit("")).alias("edge_id"), kind.alias("_k"), "loaded_at", "row_id")
    e = e.where(filled(F.col("source_id")) & filled(F.col("target_id")))
    ids = kg.select(*TREE, "id").distinct()
    for end in ("source_id", "target_id"):
        e = join_on(e, ids.withColumnRenamed("id", end), [*TREE, end], "left_semi")
    e = e.withColumn("edge_id", F.coalesce("edge_id", F.concat_ws("_", "source_id", "target_id", "_k"))).drop("_k")
    return G.last_by(e, [*TREE, "source_id", "target_id", "rel_type"], ["loaded_at", "row_id"]).drop("loaded_at", "row_id")


def papers(kg: DataFrame) -> DataFrame:
    """One node per paper: paper_name."""
    return kg.where("paper_name is not null").select("paper_name").distinct()


def appear_in(kg: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tested catalysts and the paper they appear in; nodes that are only typed as catalysts have no such link."""
    tested = nodes.where("is_tested_catalyst").where(F.lower(strip("type")) == "chemical").select(*TREE, strip("id").alias("id")).distinct()
    return join_on(kg.where("label = 'Catalyst' and paper_name is not null").select(*TREE, "id"), tested, [*TREE, "id"], "left_semi")


def basic_materials(nodes: DataFrame, edges: DataFrame, compositions: DataFrame) -> DataFrame:
    """Materials of starting chemicals and catalysts, one row per node and material: tree columns, id, material, source_property, value, unit.

    The formula (member ``chemical formula`` or else ``formula``) comes first, then the
    members of the composition with value and unit, then the name, but never a
    catalyst's.  ``compositions``: tree columns, node_id, quantity, value, unit,
    loaded_at, quantity_id; of members that clean to one name the last one counts.
    """
    kg = kg_nodes(nodes).where("label in ('Chemical', 'Catalyst')")
    chem = join_on(kg, G.materials_of_interest(nodes, edges), [*TREE, "id"], "left_semi")
    text = lambda k: J.plain_text(F.element_at("attrs", F.lit(k)))
    given = F.when(F.map_contains_key("attrs", "chemical formula"), text("chemical formula")).otherwise(text("formula"))
    chem = chem.withColumn("formula", F.nullif(X.formula_base(F.trim(given)), F.lit("")))
    by_formula = chem.where("formula is not null").select(*TREE, "id", F.col("formula").alias("material"), F.lit("formula").alias("source_property"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("unit"))
    open_ = chem.where("formula is null")
    c = compositions.select(*TREE, strip("node_id").alias("id"), X.name_base(F.col("quantity")).alias("material"), "value", "unit", "loaded_at", "quantity_id").where("material is not null")
    c = G.last_by(c, [*TREE, "id", "material"], ["loaded_at", "quantity_id"]).drop("loaded_at", "quantity_id")
    by_parts = join_on(c, open_.select(*TREE, "id"), [*TREE, "id"], "left_semi").select(*TREE, "id", "material", F.lit("composition").alias("source_property"), "value", "unit")
    rest = join_on(open_.where("label <> 'Catalyst'"), c.select(*TREE, "id").distinct(), [*TREE, "id"], "left_anti")
    by_name = rest.select(*TREE, "id", X.name_base(F.col("name")).alias("material"), F.lit("name").alias("source_property"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("unit")).where("material is not null")
    return by_formula.unionByName(by_parts).unionByName(by_name)


def violations(kg: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on more than one row, a check of uniqueness: the keys, n."""
    return kg.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def flat_attributes(df: DataFrame, keys: list[str], attrs: str = "attrs") -> DataFrame:
    """Members as flat properties: the keys, prop, value.

    ``attrs`` maps names to JSON text.  A member of an object becomes
    ``prefix_member_unit``: objects with a value give it and their unit, other
    objects and lists stay text, anything else is text as well.  Lists stay JSON
    text, scalars stay as they are.  Of two members with one name the later one
    in the order of names stays.
    """
    prefix = F.lit(None).cast("string")
    for k, v in PREFIXES.items():
        prefix = F.when(F.col("_k") == k, v).otherwise(prefix)
    prefix = F.coalesce(prefix, F.regexp_replace("_k", "(?i)_json$", ""))
    top = df.select(*keys, F.explode(attrs).alias("_k", "_v")).where(~F.col("_k").isin(*SKIPPED))
    top = top.withColumn("_v", J.strip_json(F.col("_v")))
    inner = top.where(F.col("_v").startswith("{")).select(*keys, prefix.alias("_p"), F.explode(J.members(F.col("_v"))).alias("_k", "_v"))
    obj = F.when(F.col("_v").startswith("{"), J.members(F.col("_v")))
    has = F.coalesce(F.map_contains_key(obj, "value"), F.lit(False))
    unit = F.when(has, X.unit_suffix(F.element_at(obj, "unit"))).otherwise("NoUnit")
    inner = inner.select(*keys, F.concat_ws("_", "_p", X.safe_key(F.col("_k")), unit).alias("prop"), F.when(has, F.element_at(obj, "value")).otherwise(F.coalesce("_v", F.lit("None"))).alias("value"))
    plain = top.where(~F.col("_v").startswith("{") | F.col("_v").isNull()).select(*keys, F.col("_k").alias("prop"), J.plain_text(F.col("_v")).alias("value"))
    out = inner.unionByName(plain).withColumn("_raw", F.col("prop")).withColumn("prop", X.safe_key(F.col("prop")))
    return out.groupBy(*keys, "prop").agg(F.max_by("value", "_raw").alias("value"))


def merge_relationships(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Relationships after an upsert: a new row takes the place of an old one with the same keys."""
    return join_on(old, new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


# --- paths ----------------------------------------------------------------------------------------


def find_targets(asked: DataFrame, kg: DataFrame) -> DataFrame:
    """The node that a name or id means: identifier, paper (asked for, may be null), tree columns and target_id (null if there is none).

    ``asked``: identifier, paper.  Catalysts come before other chemicals, then the smaller id.
    """
    c = kg.where("label in ('Catalyst', 'Chemical')").select(*TREE, "id", "name", (F.col("label") != "Catalyst").alias("late"))
    by = c.select("*", F.explode(F.array_distinct(F.array("id", "name"))).alias("identifier")).where("identifier is not null")
    a = asked.select("identifier", "paper").distinct()
    hit = a.join(by, "identifier").where("paper is null or paper = paper_name")
    best = hit.groupBy("identifier", "paper").agg(F.min_by(F.struct(*TREE, F.col("id").alias("target_id")), F.struct("late", "id", *[F.coalesce(x, F.lit("")) for x in TREE])).alias("t"))
    return join_on(a, best, ["identifier", "paper"], "left").select("identifier", "paper", *[F.col("t").getField(x).alias(x) for x in (*TREE, "target_id")])


def alternating_links(kg: DataFrame, rels: DataFrame) -> DataFrame:
    """Links that a path may go back by: from a chemical to the steps that put it out, and from a step to the plain chemicals it takes in (inputs that are tested catalysts end a path)."""
    steps = kg.where("label = 'Synthesis'").select(*TREE, F.col("id").alias("step"))
    plain = kg.where("label = 'Chemical'").select(*TREE, F.col("id").alias("chem")).distinct()
    steps = steps.distinct()
    outs = join_on(rels.where("rel_type = 'SYNTHESIS_OUTPUT'").select(*TREE, F.col("source_id").alias("step"), "target_id"), steps, [*TREE, "step"], "left_semi").select(*TREE, F.col("step").alias("source_id"), "target_id")
    ins = rels.where("rel_type = 'SYNTHESIS_INPUT'").select(*TREE, F.col("source_id").alias("chem"), F.col("target_id").alias("step"))
    ins = join_on(join_on(ins, steps, [*TREE, "step"], "left_semi"), plain, [*TREE, "chem"], "left_semi").select(*TREE, F.col("chem").alias("source_id"), F.col("step").alias("target_id"))
    return outs.unionByName(ins).distinct()


def synthesis_path(targets: DataFrame, kg: DataFrame, rels: DataFrame, max_depth: int | None = 20) -> DataFrame:
    """Steps behind each target from the earliest to the latest: tree columns, target_id, pos (from 1), id, name, method, procedure, dist.

    ``targets``: tree columns, target_id.  Hops to steps and to chemicals both
    count; a depth that is no positive number becomes 20.  Steps of one distance
    go by id.  Targets without a step give no rows.
    """
    depth = max_depth if isinstance(max_depth, int) and not isinstance(max_depth, bool) and max_depth > 0 else 20
    reached = L.reach(targets, alternating_links(kg, rels), depth)
    steps = kg.where("label = 'Synthesis'").select(*TREE, "id", "name", *[J.plain_text(F.element_at("attrs", F.lit(k))).alias(k) for k in ("method", "procedure")])
    found = join_on(reached.where("dist > 0"), steps, [*TREE, "id"], "inner")
    pos = F.row_number().over(W.partitionBy(*TREE, "target_id").orderBy(F.desc("dist"), "id"))
    return found.select(*TREE, "target_id", pos.alias("pos"), "id", "name", "method", "procedure", "dist")


# --- names and fields -----------------------------------------------------------------------------


def regex_hits(phrases: DataFrame, patterns: dict[str, str], phrase: str = "phrase") -> DataFrame:
    """Names that patterns stand for, in the patterns' order and once each: phrase, canonical, pos. Patterns are a small given list; case doesn't count."""
    if not patterns:
        return phrases.select(phrase).withColumns({"canonical": F.lit(None).cast("string"), "pos": F.lit(None).cast("int")}).where("false")
    p = phrases.where(filled(F.col(phrase))).select(phrase).distinct()
    hits = F.array(*[F.when(F.col(phrase).rlike("(?i)" + k), F.lit(v)) for k, v in patterns.items()])
    return p.select(phrase, F.posexplode(F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))).alias("pos", "canonical"))


def _by_vectors(phrases: DataFrame, names: DataFrame, embed, k: int, threshold: float) -> DataFrame:
    """Names nearest to phrases: phrase, name, score. Keys of the search are hashes, so that names need no numbers."""
    from weft.operators.vectors import nearest
    from weft.plugins import embed as embed_

    q = embed_(phrases.select(F.lower("phrase").alias("t"), "phrase").withColumn("key", F.xxhash64("phrase")), embed, "key", "t")
    v = embed_(names.withColumn("key", F.xxhash64("name")), embed, "key", "name")
    found = nearest(q, v, k, "key").where(F.col("sim") >= threshold)
    found = found.join(phrases.select("phrase", F.xxhash64("phrase").alias("query_id")), "query_id").join(names.select("name", F.xxhash64("name").alias("key")), "key")
    return found.select("phrase", "name", F.col("sim").alias("score"))


def resolve_names(phrases: DataFrame, kg: DataFrame, patterns: dict[str, str], embed=None, labels: list[str] | None = None, top_k: int = 5, threshold: float = 0.5) -> DataFrame:
    """Nodes that free names mean: phrase, rank, name, id, label, score, source.

    ``phrases``: phrase; blank ones have no answer.  Where any pattern hits, the
    pattern's names alone count (score 1, source ``regex``), even if no node has
    them.  Else the names nearest by vector (three times ``top_k`` are looked at)
    of at least the threshold.  Nodes without one of the labels don't count; of
    nodes with one name the one of the largest id answers.
    """
    p = phrases.where(filled(F.col("phrase"))).select("phrase").distinct()
    n = kg.where("name is not null").where(F.col("label").isin(*labels) if labels else F.lit(True))
    one = n.groupBy("name").agg(F.max(F.struct("id", "label")).alias("n")).select("name", "n.id", "n.label")
    hits = regex_hits(p, patterns)
    sure = hits.join(one, hits["canonical"] == one["name"]).select("phrase", "name", "id", "label", F.lit(1.0).alias("score"), F.lit("regex").alias("source"), F.col("pos").cast("double").alias("_o"))
    out = sure
    if embed is not None:
        rest = p.join(hits.select("phrase").distinct(), "phrase", "left_anti")
        near = _by_vectors(rest, one.select("name"), embed, 3 * top_k, threshold).join(one, "name")
        out = sure.unionByName(near.select("phrase", "name", "id", "label", "score", F.lit("vector").alias("source"), (-F.col("score")).alias("_o")))
    rank = F.row_number().over(W.partitionBy("phrase").orderBy("_o", "name"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top_k).drop("_o")


def field_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All property names of nodes and relationships: key."""
    keys = lambda df: df.select(F.explode(F.map_keys("attrs")).alias("key"))
    return keys(nodes).unionByName(keys(edges)).distinct()


def resolve_fields(phrases: DataFrame, keys: DataFrame, patterns: dict[str, str], embed=None, top_k: int = 10, threshold: float = 0.4) -> DataFrame:
    """Property names that phrases mean: phrase, rank, key, score, source; rank 1 is the canonical one.

    Patterns come before vectors; of these twice ``top_k`` are looked at.
    """
    p = phrases.where(filled(F.col("phrase"))).select("phrase").distinct()
    hits = regex_hits(p, patterns)
    out = hits.select("phrase", F.col("canonical").alias("key"), F.lit(1.0).alias("score"), F.lit("regex").alias("source"), F.col("pos").cast("double").alias("_o"))
    if embed is not None:
        rest = p.join(hits.select("phrase").distinct(), "phrase", "left_anti")
        near = _by_vectors(rest, keys.select(F.col("key").alias("name")).distinct(), embed, 2 * top_k, threshold)
        out = out.unionByName(near.select("phrase", F.col("name").alias("key"), "score", F.lit("vector").alias("source"), (-F.col("score")).alias("_o")))
    rank = F.row_number().over(W.partitionBy("phrase").orderBy("_o", "key"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top_k).drop("_o")


def fingerprint(names: DataFrame, name: str = "name") -> DataFrame:
    """One value for a set of names, whatever their order: n, fingerprint. An index is built again if and only if it differs."""
    h = names.where(F.col(name).isNotNull()).select(name).distinct().select(F.xxhash64(name).cast("decimal(38,0)").alias("h"), F.xxhash64(F.reverse(F.col(name))).cast("decimal(38,0)").alias("g"))
    return h.agg(F.count("*").alias("n"), F.md5(F.concat_ws("/", F.coalesce(F.sum("h"), F.lit(0)).cast("string"), F.coalesce(F.sum("g"), F.lit(0)).cast("string"))).alias("fingerprint"))


# --- merging materials ----------------------------------------------------------------------------


def translated(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``names`` (id, name) with name_en, by a dictionary (term, name_en); a name without an entry stays."""
    d = dictionary.where("term is not null and name_en is not null").groupBy("term").agg(F.min("name_en").alias("name_en"))
    return names.join(d.withColumnRenamed("term", "name"), "name", "left").select("id", "name", F.coalesce("name_en", "name").alias("name_en"))


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s,\-]+", "")


def same_substance(a: Column, b: Column) -> Column:
    """A rule in place of a model: equal but for case, blanks, hyphens and commas. Blank names are the same as nothing."""
    return F.coalesce((_plain(a) == _plain(b)) & (_plain(a) != ""), F.lit(False))


def similar_names(named: DataFrame, embed, k: int = 10, threshold: float = 0.75) -> DataFrame:
    """Pairs for ``merge_plan`` among each name's k nearest by vector (itself counts): i, j, sim.

    ``named``: id, name_en.  Nearest ones are looked for among all names, but only
    for names that ``same_substance`` holds for with some other: no pair of the
    rest can pass it.
    """
    from weft.operators.vectors import similar_pairs
    from weft.plugins import embed as embed_

    n = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = lambda names: cut(embed_(names.select("id", "name_en").repartition(n, "id"), embed, "id", "name_en"))
    plain = named.select("id", "name_en", _plain(F.col("name_en")).alias("plain"))
    shared = plain.where("plain <> ''").groupBy("plain").agg(F.count("*").alias("n")).where("n > 1")
    asked, rest = (vectors(plain.join(shared, "plain", how)) for how in ("left_semi", "left_anti"))
    return similar_pairs(asked, asked.unionByName(rest), k, threshold, "id")


def majority(votes: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """The most frequent vote of each key; of equals the larger one."""
    n = votes.where(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max_by(vote, F.struct("_n", vote)).alias(vote))


def merge_plan(named: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """What becomes of each material: id, name, new_name, keep_id, action (``merge``, ``rename``, ``keep``).

    ``named``: id, name, name_en; ``pairs``: i, j, both ids, taken to be the same
    substance after ``same_substance``.  Clusters of such pairs take the first
    of their sorted names and the smallest id.  Any other node whose name_en
    differs from its name is renamed, or merged into the node that already has
    that name, the smallest id of such.  Nothing is written: this is the dry run as well.
    """
    n = named.select("id", "name", "name_en")
    if pairs is not None:
        from weft.operators.vectors import components

        a = n.select(F.col("id").alias("i"), F.col("name_en").alias("a"))
        b = n.select(F.col("id").alias("j"), F.col("name_en").alias("b"))
        same = pairs.select("i", "j").join(a, "i").join(b, "j").where(same_substance(F.col("a"), F.col("b"))).select("i", "j")
        n = n.join(components(same), "id", "left")
    else:
        n = n.withColumn("root", F.lit(None).cast(dict(n.dtypes)["id"]))
    canon = n.where("root is not null").groupBy("root").agg(F.min(F.when(filled(F.col("name_en")), F.col("name_en"))).alias("canon"))
    n = n.join(canon, "root", "left")
    single = F.col("root").isNull()
    at_home = n.where(single).groupBy(F.col("name").alias("new_name")).agg(F.min("id").alias("holder"))
    n = n.withColumn("new_name", F.when(single, F.col("name_en")).otherwise(F.coalesce("canon", "name"))).join(at_home, "new_name", "left")
    differs = single & (F.col("name_en") != F.col("name"))
    keep = F.when(~single, F.col("root")).when(differs & F.col("holder").isNotNull() & (F.col("holder") != F.col("id")), F.col("holder")).otherwise(F.col("id"))
    action = F.when(keep != F.col("id"), "merge").when(F.col("new_name") != F.col("name"), "rename").otherwise("keep")
    return n.select("id", "name", "new_name", keep.alias("keep_id"), action.alias("action"))


def merge_reduction(plan: DataFrame) -> DataFrame:
    """Materials before and after, and how many fewer: n_before, n_merged, n_renamed, n_after."""
    return plan.agg(F.count("*").alias("n_before"), F.count_if(F.col("action") == "merge").alias("n_merged"), F.count_if(F.col("action") == "rename").alias("n_renamed"), F.count_if(F.col("action") != "merge").alias("n_after"))


def contract_materials(links: DataFrame, plan: DataFrame, target: str = "material_id") -> DataFrame:
    """Links to materials after the plan, each once: relationships of a merged node move to the one that is kept."""
    rest = [c for c in links.columns if c != target]
    return links.join(plan.select(F.col("id").alias(target), "keep_id"), target, "left").select(*rest, F.coalesce("keep_id", target).alias(target)).distinct()
