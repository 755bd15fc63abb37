"""Operators on the property graph, single papers' trees and layout: cases worked out by hand, corner cases, brute force."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import layout as Y
from weft.operators import kg as K
from weft.operators import trees as T
from weft.plugins import hashed_embedder

NODES = "row_id long, paper_name string, catalyst_id string, id string, type string, name string, synthesis_level int, is_tested_catalyst boolean, attrs map<string,string>, op string, loaded_at int, extra string"
EDGES = "row_id long, paper_name string, catalyst_id string, id string, type string, source_id string, target_id string, attrs map<string,string>, loaded_at int, label string"


@pytest.fixture(scope="module")
def graph(spark):
    n = [
        (1, "P", "c", "a", "chemical", "nickel nitrate (pure)", None, None, {"formula": '"Ni(NO3)2"'}, "add", 1, "x"), (2, "P", "c", " b ", "chemical", "support (Al2O3)", None, False, None, "add", 1, "x"),
        (3, "P", "c", "s", "synthesis", "Mix", 1, None, {"method": '"impregnation"', "procedure": '"stir"'}, "add", 1, "x"), (4, "P", "c", "k", "chemical", "Final", None, True, {}, "add", 1, "x"),
        (5, "P", "c", "k", "chemical", "Final 2", None, True, {}, "update", 2, "x"), (6, "P", "c", "t", "testing", None, None, None, None, "add", 1, "x"), (7, "P", "c", "z", "weird", None, None, None, None, "add", 1, "x"),
        (8, "P", "c", "pp", "paper", None, None, None, None, "add", 1, "x"), (9, "P", "c", None, "chemical", "lost", None, None, None, "add", 1, "x"), (10, "P", "c", "k2", "catalyst", "typed only", None, None, None, "add", 1, "x"),
    ]
    e = [
        (1, "P", "c", "e1", "synthesis_input", "a", "s", None, 1, "l"), (2, "P", "c", None, "Synthesis_Input", "b", "s ", None, 1, "l"), (3, "P", "c", "e3", "synthesis_output", "s", "k", None, 1, "l"), (4, "P", "c", "e4", "synthesis_output", "s", "k", None, 2, "l"),
        (5, "P", "c", "e5", "tested_in", "k", "t", None, 1, "l"), (6, "P", "c", "e6", "has_component", "k", "a", None, 1, "l"), (7, "P", "c", "e7", "odd", "k", "z", None, 1, "l"), (8, "P", "c", "e8", "tested_in", "k", "gone", None, 1, "l"), (9, "P", "c", "e9", "synthesis_input", None, "s", None, 1, "l"),
    ]
    return spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES)


def test_nodes_and_edges(graph):
    nodes, edges = graph
    kg = K.kg_nodes(nodes)
    assert {(r.id, r.label, r.name) for r in kg.collect()} == {("a", "Chemical", "nickel nitrate (pure)"), ("b", "Chemical", "support (Al2O3)"), ("s", "Synthesis", "Mix"), ("k", "Catalyst", "Final 2"), ("t", "Testing", None), ("z", "UnknownNode", None), ("k2", "Catalyst", "typed only")}
    assert {(r.source_id, r.target_id, r.rel_type, r.edge_id) for r in K.kg_edges(edges, kg).collect()} == {("a", "s", "SYNTHESIS_INPUT", "e1"), ("b", "s", "SYNTHESIS_INPUT", "b_s_synthesis_input"), ("s", "k", "SYNTHESIS_OUTPUT", "e4"), ("k", "t", "TESTED_IN", "e5"), ("k", "z", "RELATED_TO", "e7")}
    assert [r.id for r in K.appear_in(kg, nodes).collect()] == ["k"]
    assert {r.kind: (r.n_rows, r.n_rejected) for r in K.rejected(nodes, edges).collect()} == {"node": (10, 1), "edge": (9, 1)}
    assert K.kg_nodes(nodes.limit(0)).count() == 0 and {r.n_rows for r in K.rejected(nodes.limit(0), edges.limit(0)).collect()} == {0}


def test_materials_by_formula_parts_and_name(spark, graph):
    nodes, edges = graph
    parts = spark.createDataFrame([("P", "c", "k", "Ni (metal)", "5", "wt%", 1, 1), ("P", "c", "k", "Ni", "6", "wt%", 2, 2), ("P", "c", "k", "(none)", "6", "wt%", 2, 3)], "paper_name string, catalyst_id string, node_id string, quantity string, value string, unit string, loaded_at int, quantity_id long")
    got = {(r.id, r.material, r.source_property, r.value) for r in K.basic_materials(nodes, edges, parts).collect()}
    assert got == {("a", "Ni", "formula", None), ("b", "support", "name", None), ("k", "Ni", "composition", "6")}


def test_flat_attributes(spark):
    """The cases that the properties of the graph are defined by."""
    attrs = {
        "properties": {"surface_area": {"value": 50, "unit": "m2/g"}, "role": "Support", "n": 5, "x": {"value": None, "unit": "g"}}, "composition": {"Pt": {"value": 0.4, "unit": "wt%"}},
        "conditions_json": {"weight hourly.SV": {"value": 20, "unit": "h-1"}}, "results_json": {"yield": {"value": "2:1"}}, "extra_json": {"k": {"a": 1}}, "aliases": ["a", "b"], "is_tested_catalyst": True, "id": "q", "method": "dry",
    }
    df = spark.createDataFrame([(1, {k: json.dumps(v) for k, v in attrs.items()}), (2, {}), (3, None)], "row_id long, attrs map<string,string>")
    got = {r.prop: r.value for r in K.flat_attributes(df, ["row_id"]).collect()}
    assert got == {
        "property_surface_area_m2_per_g": "50", "property_role_NoUnit": "Support", "property_n_NoUnit": "5", "property_x_g": None, "composition_Pt_wtpct": "0.4", "condition_weight_hourly_SV_h_1": "20",
        "result_yield_NoUnit": "2:1", "extra_k_NoUnit": '{"a":1}', "aliases": '["a", "b"]', "method": "dry",
    }


def test_paths_alternate(spark, graph):
    nodes, edges = graph
    kg = K.kg_nodes(nodes)
    rels = K.kg_edges(edges, kg)
    asked = spark.createDataFrame([("Final 2", None), ("k", "P"), ("k", "Q"), ("nothing", None)], "identifier string, paper string")
    found = K.find_targets(asked, kg)
    assert {(r.identifier, r.paper, r.target_id) for r in found.collect()} == {("Final 2", None, "k"), ("k", "P", "k"), ("k", "Q", None), ("nothing", None, None)}
    targets = found.where("target_id is not null")
    assert [(r.pos, r.id, r.method, r.dist) for r in K.synthesis_path(targets, kg, rels).collect()] == [(1, "s", "impregnation", 1)]
    assert K.synthesis_path(targets, kg, rels, max_depth=-3).count() == 1 and K.synthesis_path(targets.limit(0), kg, rels).count() == 0


def test_names_by_patterns_then_vectors(spark, graph):
    kg = K.kg_nodes(graph[0])
    phrases = spark.createDataFrame([("the FINAL one",), ("support (Al203)",), (" ",), (None,), ("zzzz",), ("nickel, any",)], "phrase string")
    got = K.resolve_names(phrases, kg, {"final": "Final 2", "nickel": "no node has this"}, hashed_embedder, threshold=0.3).collect()
    assert {(r.phrase, r.rank, r.name, r.source) for r in got if r.rank == 1} == {("the FINAL one", 1, "Final 2", "regex"), ("support (Al203)", 1, "support (Al2O3)", "vector")}
    assert K.resolve_names(phrases, kg, {"final": "Final 2"}, labels=["Synthesis"]).count() == 0
    fields = K.resolve_fields(phrases, K.field_names(*graph), {"final": "procedure", "one": "method"}, hashed_embedder, threshold=0.99)
    assert [(r.phrase, r.rank, r.key) for r in fields.orderBy("rank").collect()] == [("the FINAL one", 1, "procedure"), ("the FINAL one", 2, "method")]


def test_vector_names_against_brute_force(spark):
    rng = random.Random(2)
    names = sorted({"".join(rng.choice("abcd ") for _ in range(9)).strip() for _ in range(60)})
    kg = spark.createDataFrame([("P", "c", f"n{k}", "Chemical", n, None, {}) for k, n in enumerate(names)], "paper_name string, catalyst_id string, id string, label string, name string, level int, attrs map<string,string>")
    asked = names[:7]
    embed = hashed_embedder()
    vec = {n: np.array(embed(n)) for n in names}
    want = {(a, n) for a in asked for n in sorted(names, key=lambda n: (-round(float(vec[a] @ vec[n]), 4), n))[:1] if vec[a] @ vec[n] >= 0.5}
    got = {(r.phrase, r.name) for r in K.resolve_names(spark.createDataFrame([(a,) for a in asked], "phrase string"), kg, {}, hashed_embedder).where("rank = 1").collect()}
    assert got == want


def test_index_is_built_again_only_for_other_names(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "name string")
    one = K.fingerprint(df).first()
    assert K.fingerprint(df.orderBy(F.desc("name")).distinct()).first() == one and K.fingerprint(df.where("name = 'a'")).first() != one
    assert K.fingerprint(df.limit(0)).first()["n"] == 0


def test_merge_plan(spark):
    named = spark.createDataFrame([(1, "nickel", "nickel"), (2, "Nickel ", "Nickel "), (3, "氧化铜", "copper oxide"), (4, "copper oxide", "copper oxide"), (5, "银", "silver"), (6, "water", "water"), (7, None, None)], "id long, name string, name_en string")
    pairs = spark.createDataFrame([(1, 2), (1, 6)], "i long, j long")
    plan = K.merge_plan(named, pairs)
    assert {(r.id, r.new_name, r.keep_id, r.action) for r in plan.collect()} == {(1, "Nickel ", 1, "rename"), (2, "Nickel ", 1, "merge"), (3, "copper oxide", 4, "merge"), (4, "copper oxide", 4, "keep"), (5, "silver", 5, "rename"), (6, "water", 6, "keep"), (7, None, 7, "keep")}
    assert K.merge_reduction(plan).first().asDict() == {"n_before": 7, "n_merged": 2, "n_renamed": 2, "n_after": 5}
    links = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("y", 4), ("z", 99)], "chem string, material_id long")
    assert {tuple(r) for r in K.contract_materials(links, plan).collect()} == {("x", 1), ("y", 4), ("z", 99)}


def _sims(a, b):
    unit = lambda m: np.array(m) / np.linalg.norm(np.array(m), axis=1, keepdims=True)
    return np.round(unit(a) @ unit(b).T, 4)


def test_merging_searches_only_for_names_that_can_match(spark, small, monkeypatch):
    """A search for every name did not end in time at 1 GB; all names are still searched through."""
    from weft.operators import vectors
    from weft.plans import surface

    sizes, nearest = [], vectors.nearest
    monkeypatch.setattr(vectors, "nearest", lambda q, v, *a, **kw: (sizes.append((q.count(), v.count())), nearest(q, v, *a, **kw))[1])
    plan = {r.id: (r.name, r.new_name, r.keep_id) for r in surface.merge_workflow(spark, small).collect()}
    named = [(r.id, r.name_en) for r in surface._named(spark, small).collect()]
    plain = [re.sub(r"[\s,\-]+", "", n.lower(), flags=re.ASCII) for _, n in named]
    assert sizes == [(sum(plain.count(x) > 1 for x in plain), len(named))] and 0 < sizes[0][0] < len(named) / 5
    embed = hashed_embedder()
    vec = np.array([np.float32(embed(n)) for _, n in named], dtype="float64")
    ids = np.array([i for i, _ in named])
    root = {i: i for i, _ in named}
    for a, row in enumerate(_sims(vec, vec)):
        for b in np.lexsort((ids, -row))[:10]:
            if row[b] >= 0.75 and plain[a] == plain[b] and root[ids[a]] != root[ids[b]]:
                least = sorted((root[ids[a]], root[ids[b]]))
                root = {i: least[0] if r == least[1] else r for i, r in root.items()}
    together = [i for i in root if list(root.values()).count(root[i]) > 1]
    assert together and all(plan[i][2] == root[i] for i in together)


def test_similar_names_count_nearer_ones_that_are_no_match(spark):
    """A name of the same substance beyond the k nearest is no pair, although the nearer ones are never searched for."""
    rows = [(1, "zinc-oxide"), (2, "zinc oxide"), (3, "zinc-oxide1"), (4, "zinc-oxide2"), (5, None), (6, " "), (7, "Zinc-Oxide"), (8, "zinc - oxide")]
    named = spark.createDataFrame(rows, "id long, name_en string")
    embed = hashed_embedder()
    given = [(i, n) for i, n in rows if n and n.strip()]
    vec = [np.float32(embed(n)) for _, n in given]
    for k in (1, 2, 3, 4, 5):
        near = {(i, given[b][0]) for (i, n), row in zip(given, _sims(vec, vec), strict=True) if i not in (3, 4) for b in sorted(range(len(given)), key=lambda b: (-row[b], given[b][0]))[:k] if row[b] >= 0.4}
        assert {(r.i, r.j) for r in K.similar_names(named, hashed_embedder, k, 0.4).collect()} == {(min(p), max(p)) for p in near if p[0] != p[1]}
    assert K.similar_names(named.where("id = 1"), hashed_embedder).count() == 0 and K.similar_names(named.limit(0), hashed_embedder).count() == 0


@pytest.mark.parametrize("floor", [-np.inf, 0.3])
def test_search_in_small_parts(monkeypatch, floor):
    """Many vectors, many equal ones and many queries a task: the k best with ties by key, and no more rows than these."""
    from weft.operators import vectors

    monkeypatch.setattr(vectors, "QUERIES", 7)
    monkeypatch.setattr(vectors, "VECTORS", 50)
    monkeypatch.setattr(vectors, "STRIP", 16)
    rng = np.random.default_rng(3)
    x, good = vectors._units([*rng.integers(-2, 3, (900, 6)).astype(float), np.zeros(6), np.full(6, np.nan)])
    keys = rng.permutation(len(x))
    q, k = x[:20], 4
    search = vectors._Search(q, k, floor)
    for at in range(0, len(x), 130):
        search.add(keys[at : at + 130], x[at : at + 130])
    got = sorted((int(r), -s, int(o)) for part in search.found() for r, s, o in zip(*part, strict=True))
    want = [(r, -sims[b], int(keys[b])) for r, sims in enumerate(np.round(np.einsum("ij,kj->ik", q, x), 4)) for b in np.lexsort((keys, -sims))[:k] if sims[b] >= floor]
    assert got == sorted(want) and not good[-2:].any()


def test_sections_are_merged(spark):
    rows = [(1, "synthesis", 0, "a", "chemical", "A"), (1, "synthesis", 1, "a", "chemical", "A again"), (1, "testing", 0, "k", "chemical", "first"), (1, "testing", 1, "k", "chemical", "second"), (1, "testing", 2, "t", "testing", None), (1, "characterization", 0, "k", "chemical", "late"), (1, "characterization", 1, "c", "chemical", "C"), (1, "testing", 3, "a", "chemical", "known"), (1, "testing", 4, None, "chemical", "no id")]
    n = spark.createDataFrame(rows, "record_id long, section string, pos int, id string, type string, name string")
    got = sorted((r.id, r.name, r.is_tested) for r in T.merge_sections(n, spark.createDataFrame([(1, " a ")], "record_id long, id string"), ["record_id"]).collect())
    assert got == [("a", "A", True), ("a", "A again", True), ("c", "C", False), ("k", "first", True)]


def test_status(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (None, None, None, None), (0, 2, 0, 0), (3, 0, 0, 1), (3, 0, 1, 0), (3, 2, 0, 1)], "n_synthesis int, n_testing int, n_characterization int, n_tested int")
    assert [r.status for r in T.extraction_status(df).collect()] == ["error_no_data_extracted"] * 2 + ["warning_no_synthesis_data", "warning_no_testing_data_expected", "warning_no_testing_data", "success"]


def test_tree_of_a_target(graph):
    nodes, edges = graph
    n = nodes.select("paper_name", "catalyst_id", F.trim("id").alias("id"), "type").where("id is not null").distinct()
    e = edges.select("row_id", "paper_name", "catalyst_id", F.trim("source_id").alias("source_id"), F.trim("target_id").alias("target_id"), "type").where("source_id is not null")
    tree, links = T.target_tree(n, e, n.where("id = 'k'").select("paper_name", "catalyst_id", F.col("id").alias("target_id")))
    assert {(r.id, r.part, r.level) for r in tree.collect()} == {("k", "synthesis", None), ("s", "synthesis", 1), ("a", "synthesis", None), ("b", "synthesis", None), ("t", "testing", None)}
    assert {(r.row_id, r.part) for r in links.collect()} == {(1, "synthesis"), (2, "synthesis"), (3, "synthesis"), (4, "synthesis"), (6, "synthesis"), (5, "testing"), (8, "testing")}


TREE = {"catalyst_id": "k", "nodes": [
    {"id": "k", "type": "chemical", "name": "Final", "aliases": ["F"], "composition": {"Pt": {"value": 1, "unit": "wt%"}, "X": {"a": {"value": 2}}}, "properties": {"list": [1, 2], "deep": [{"q": 1}]}},
    {"id": "a", "type": "chemical", "name": "Salt"}, {"id": "s", "type": "synthesis", "name": "Mix", "synthesis_level": 1, "procedure": "stir", "conditions": {"time": {"value": 3, "unit": "h"}}},
    {"id": "t", "type": "testing", "description": "run", "results": {"yield": {"value": 5}}}, {"id": "c", "type": "characterization", "method": "XRD", "is_reported": False},
], "edges": [{"type": "synthesis_input", "source_id": "a", "target_id": "s", "properties": {"role": "Precursor"}}, {"type": "synthesis_output", "source_id": "s", "target_id": "k"}]}
TEXT = """Catalyst Node Name: k
Catalyst Name: Final
  Aliases: F
  Composition:
    Pt: 1 wt%
    X:
      a: 2
  Properties:
    deep:
      -
        q: 1
    list:
      - 1, 2

Synthesis Pathway:

  Step 1: Mix (ID: s)
    Procedure: stir
    Inputs:
      - Salt (Precursor)
    Outputs:
      - Final
        Composition:
          Pt: 1 wt%
          X:
            a: 2
        Properties:
          deep:
            -
              q: 1
          list:
            - 1, 2
    Conditions:
      time: 3 h

Testing Scenarios:

  Scenario 1: run (ID: t)
    Results (Legacy):
      yield: 5

Characterization:

  Characterization 1: XRD (ID: c)
    Data reported: False"""


def test_tree_text(spark):
    assert T.tree_text(TREE) == TEXT
    assert T.tree_text({"catalyst_id": "q", "nodes": TREE["nodes"]}) is None and T.tree_text({}) is None
    df = spark.createDataFrame([(1, json.dumps({"catgraph_tree": TREE})), (2, None), (3, "{"), (4, "[]"), (5, "")], "record_id long, payload string")
    assert [tuple(r) for r in T.tree_texts(df).collect()] == [(1, TEXT)]


def test_loops_of_steps(spark):
    def frames(links, steps):
        n = spark.createDataFrame([("P", None, s, "synthesis") for s in steps] + [("P", None, "chem", "chemical")], "paper_name string, catalyst_id string, id string, type string")
        return n, spark.createDataFrame([("P", None, a, b) for a, b in links], "paper_name string, catalyst_id string, source_id string, target_id string")

    assert [r.loop for r in T.step_loops(*frames([("a", "b"), ("b", "c"), ("c", "b"), ("z", "a"), ("c", "chem")], "abcz")).collect()] == ["b -> c -> b"]
    assert [r.loop for r in T.step_loops(*frames([("a", "a")], "a")).collect()] == ["a -> a"]
    assert T.step_loops(*frames([("a", "b"), ("b", "chem"), ("chem", "a"), ("a", "c"), ("b", "c")], "abc")).count() == 0


def test_blocks_and_paragraphs(spark):
    b = spark.createDataFrame([(1, 1, 1, "title", "T"), (1, 1, 2, "text", "a"), (1, 1, 3, "table", "x|y\n"), (1, 1, 4, "text", "b"), (1, 2, 1, "text", None)], "doc int, page int, block_no int, kind string, text string")
    assert Y.joined_blocks(b).first()["text"] == "T\na\nx|y\nb\n\n\n\n\n\n"
    long = " ".join(["w"] * 15)
    rows = [(1, 0, 1, "title", "Name", None), (1, 1, 1, None, "short", None), (1, 2, 1, "sectionHeading", "Intro", None), (1, 3, 1, None, long, None), (1, 4, 1, "footnote", "note", None), (1, 5, 1, "pageNumber", "7", None), (1, 6, 1, None, "cell", "Table_0"), (1, 7, 1, None, "cell", "Table_0"), (1, 8, 2, "other", "end", None)]
    p = spark.createDataFrame(rows, "doc int, pos int, page int, role string, text string, place string")
    text = Y.joined_paragraphs(p)
    assert text.first()["text"] == f"Title:Name\nshort\n\nSection:Intro\n{long}\nnote\n\n<Table_0>\n\n\nend\n\n".replace("<Table_0>\n\n\nend", "<Table_0>\n\n\nend")
    assert text.select(Y.filled_places(F.col("text"), F.create_map(F.lit("Table_0"), F.lit(" 1|2 \n")))).first()[0].count("<Table_0>\n1|2\n") == 1


def test_tables_as_grids(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a", "Cap", None), (1, 1, 2, "x|y", "Cap", None), (1, 1, 0, None, "Cap", None), (2, 0, 0, 'q"', None, "foot")], "table_id int, row_index int, column_index int, content string, caption string, footnotes string")
    assert {r.table_id: r.text for r in Y.table_text(cells).collect()} == {1: 'Cap\na||\n||"x|y"\n', 2: '"q"""\nfoot\n'}


def test_titles_and_sections(spark):
    df = spark.createDataFrame([("Results and Discussion here. Results.",), ("",), (None,)], "t string")
    known = F.array(F.lit("Results"), F.lit("Results and Discussion"), F.lit("discussion"))
    assert [r[0] for r in df.select(Y.marked_sections(F.col("t"), known)).collect()] == ["Section:Results and Discussion\n here. Results.", "", None]
    assert df.limit(1).select(Y.titles(F.array(F.lit("A"), F.lit("Über"), F.lit("low"), F.lit("1 x")))).first()[0] == ["Über"]
    assert df.limit(1).select(Y.casings(F.array(F.lit("aBc dE")))).first()[0] == ["aBc dE", "Abc de", "ABC DE"]
    assert df.limit(1).select(Y.is_title(F.lit("Results"), known)).first()[0] is True


def test_pages_of_pictures(spark):
    pages = spark.createDataFrame([(1, 1, "x" * 200), (2, 1, "�" * 90 + "x" * 60), (2, 2, "y" * 150), (3, 1, None), (4, 1, "z" * 99)], "doc int, page int, text string")
    assert {r.doc: (r.text_length, r.is_image) for r in Y.image_pages(pages).collect()} == {1: (200, False), 2: (120, False), 3: (0, True), 4: (99, True)}
