"""General problems against brute force, and their corner cases."""

import datetime as dt
import random

import pytest
import tolerant
from pyspark.sql import functions as F

from weft.operators import hierarchy as H
from weft.operators import lineage as L
from weft.operators import nested as N
from weft.operators import orphans as O
from weft.operators import quantities as Q
from weft.session import table

NODES = "row_id long, paper_name string, catalyst_id string, id string, type string, synthesis_level int, op string, loaded_at timestamp, extra string"
EDGES = "row_id long, paper_name string, catalyst_id string, id string, type string, source_id string, target_id string, loaded_at timestamp, ts string, key string"
T = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)


def found(raw):
    return {tuple(r) for r in N.quantities(raw).select("record_id", "owner", "owner_id", "path").collect()}


def test_nested_against_plain_reader(spark, small):
    raw = table(spark, small, "tree_raw")
    assert found(raw) == {(r.record_id, *x) for r in raw.collect() for x in tolerant.found(r.payload)}


@pytest.mark.parametrize("payload", [None, "", "no graph", '{"synthesis": {"nodes": [{"id": "a", "p": {"value": 1}', '{"synthesis": null}', '{"synthesis": {"nodes": null, "edges": [3, null, "x"]}}'])
def test_nested_without_cases(spark, payload):
    assert found(spark.createDataFrame([(1, None, None, payload)], "record_id long, paper_name string, catalyst_id string, payload string")) == set()


def test_nested_depth_and_text(spark):
    deep = '{"value": null}'
    for k in range(40):
        deep = f'{{"k{k}": [{deep}]}}'
    import json

    body = {"catgraph_tree": {"nodes": [{"id": None, "p": json.loads(deep), "t": json.dumps([{"value": 2}]), "value": 1}], "edges": [{"id": "e", "q": {"value": {"value": 3}}}]}}
    raw = spark.createDataFrame([(7, "p", "c", json.dumps(json.dumps(body)), "clash")], "record_id long, paper_name string, catalyst_id string, payload string, path string")
    assert found(raw) == {(7, *x) for x in tolerant.found(json.dumps(body))}
    assert len(found(raw)) == 4


def orphans_plain(nodes, edges):
    out = set()
    for e in edges:
        for side in ("source", "target"):
            k = (e[f"{side}_id"] or "").strip()
            if not k:
                continue
            own = sorted((n["loaded_at"] or T(-9999), n["row_id"], n["op"]) for n in nodes if (n["paper_name"], n["catalyst_id"], (n["id"] or "").strip()) == (e["paper_name"], e["catalyst_id"], k))
            before = [n for n in own if e["loaded_at"] is None or n[0] <= e["loaded_at"]]
            if before and before[-1][2] == "delete":
                out.add((e["row_id"], side, "deleted"))
            elif not before:
                out.add((e["row_id"], side, "late" if own else "missing"))
    return out


def random_tree(seed, n=60):
    r = random.Random(seed)
    names = [None, "", " ", *[f"n{k}" for k in range(12)], " n3 ", "n4 "]
    nodes = [dict(row_id=k, paper_name=r.choice(["P", None]), catalyst_id=r.choice(["c", "d"]), id=r.choice(names), type=r.choice(["chemical", "synthesis", "testing"]), synthesis_level=r.choice([None, 1, 2]), op=r.choice(["add", "add", "update", "delete"]), loaded_at=r.choice([None, T(r.randrange(5)), T(r.randrange(5))]), extra="x") for k in range(n)]
    edges = [dict(row_id=k, paper_name=r.choice(["P", None]), catalyst_id=r.choice(["c", "d"]), id="e", type=r.choice(["synthesis_input", "SYNTHESIS_OUTPUT", "tested_in"]), source_id=r.choice(names), target_id=r.choice(names), loaded_at=r.choice([None, T(r.randrange(5)), T(r.randrange(5))]), ts="x", key="y") for k in range(n)]
    return nodes, edges


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", [20_000, -10**9, 4])
def test_orphans(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(O, "HOT_ROWS", hot)
    nodes, edges = random_tree(seed)
    got = O.orphan_ends(spark.createDataFrame([tuple(x.values()) for x in nodes], NODES), spark.createDataFrame([tuple(x.values()) for x in edges], EDGES))
    assert {(r.row_id, r.side, r.reason) for r in got.collect()} == orphans_plain(nodes, edges)


def test_orphans_empty(spark):
    assert O.orphan_ends(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)).count() == 0
    nodes, edges = random_tree(1)
    assert O.orphan_ends(spark.createDataFrame([], NODES), spark.createDataFrame([tuple(x.values()) for x in edges], EDGES)).where("reason <> 'missing'").count() == 0


def tree_frames(spark, links, ids):
    nodes = [(k, "P", "c", i, "chemical", None, "add", T(0), "x") for k, i in enumerate(ids)]
    edges = [(k, "P", "c", "e", "synthesis_input", a, b, T(0), "x", "y") for k, (a, b) in enumerate(links)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


@pytest.mark.parametrize("hot", [400_000, 0])
def test_hierarchy(spark, monkeypatch, hot):
    monkeypatch.setattr(H, "HOT_ROWS", hot)
    chain = [f"a{k}" for k in range(37)]
    links = list(zip(chain, chain[1:], strict=False)) + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s"), ("gone", "a0"), ("a3", "missing")] + [("a0", "a1")]
    got = {r.id: (r.root_id, r.depth) for r in H.hierarchy(*tree_frames(spark, links, [*chain, "x", "y", "z", "w", "s", "alone"])).collect()}
    want = {c: ("a36", 36 - k) for k, c in enumerate(chain)} | {c: ("", -1) for c in "xyzws"} | {"alone": ("alone", 0)}
    assert got == want


def test_both_ways_over_a_forest_are_the_same(spark, monkeypatch):
    r = random.Random(9)
    ids = [f"v{k}" for k in range(400)]
    links = [(ids[k], ids[r.randrange(max(0, k - 30), k)]) for k in range(1, 400) if r.random() < 0.95]
    links += [("v0", "v7"), ("v399", "v398")] if r.random() < 2 else []
    n, e = tree_frames(spark, links, ids)
    small = {tuple(x) for x in H.full_hierarchy(n, e).collect()}
    monkeypatch.setattr(H, "HOT_ROWS", 0)
    assert {tuple(x) for x in H.full_hierarchy(n, e).collect()} == small
    assert max(x[4] for x in small) > 3 and any(x[6] for x in small)


def test_hierarchy_paths_and_empty(spark):
    n, e = tree_frames(spark, [("a", "b"), ("b", "c"), ("d", "b")], "abcd")
    got = {(r.id, r.path, r.n_descendants) for r in H.full_hierarchy(n, e).collect()}
    assert got == {("a", "c/b/a", 0), ("b", "c/b", 2), ("c", "c", 3), ("d", "c/b/d", 0)}
    assert H.hierarchy(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)).count() == 0


@pytest.mark.parametrize("hot", [400_000, 0])
def test_lineage_diamond_and_loop(spark, monkeypatch, hot):
    monkeypatch.setattr(L, "HOT_ROWS", hot)
    e = spark.createDataFrame([("P", None, a, b) for a, b in [("s1", "x"), ("s2", "x"), ("x", "s3"), ("s3", "t"), ("t", "s1"), ("s1", "x")]], "paper_name string, catalyst_id string, source_id string, target_id string")
    t = spark.createDataFrame([("P", None, "t")], "paper_name string, catalyst_id string, target_id string")
    assert {(r.id, r.dist) for r in L.reach(t, e).collect()} == {("t", 0), ("s3", 1), ("x", 2), ("s1", 3), ("s2", 3)}
    assert L.reach(t, e, 1).count() == 2
    assert L.reach(t, e.limit(0)).count() == 1


CASES = [
    ("temperature", "25", "degC", None, 298.15, 298.15), ("temperature", "-40 °F", None, None, 233.15, 233.15), ("time", "8 hr 50 min", None, None, 31800, 31800), ("time", "2–3", "h", None, 7200, 10800),
    ("mass", "0,4 gram", None, None, 0.4, 0.4), ("mass", "10 500", "mg", None, 10.5, 10.5), ("mass", "1.379 x 10^6", "milligrams", None, 1379, 1379), ("pressure", "2E+03", "kPa", None, 2000, 2000),
    ("surface_area", "5.6 m² g⁻¹", "-", None, 5.6, 5.6), ("flow_rate", "78 mL min-1", None, None, 78, 78), ("loading", "ten", "wt. %", None, 10, 10), ("loading", "0.5", "mg/g", None, 0.05, 0.05),
    ("space_velocity", "31", None, "(Blank: 19 h.) [0242] Sample 242 showed 31 min-1 in the second series.", 1860, 1860), ("pore_diameter", "between 2 and 3 nm", "°C", None, 2, 3), ("heating_rate", "18", "°F/min", None, 10, 10),
    ("temperature", "751", "mol", None, None, None), ("mass", "11", None, "[8699] 按前述方法处理。", None, None), ("time", "overnight", None, None, None, None), ("mass", None, None, None, None, None), ("unknown", "3", "g", None, None, None), (None, "", "", "", None, None),
]


def test_quantities(spark, small):
    df = spark.createDataFrame([(k, *c[:4], 9.0) for k, c in enumerate(CASES)], "quantity_id long, quantity string, value string, unit string, source_text string, low double")
    got = {r.quantity_id: (r.low, r.high) for r in Q.normalise(df, table(spark, small, "quantity_ref")).collect()}
    for k, c in enumerate(CASES):
        assert got[k] == (pytest.approx(c[4]), pytest.approx(c[5])) if c[4] is not None else got[k] == (None, None), c
    assert Q.converted(df.limit(0), table(spark, small, "quantity_ref")).count() == 0


def test_units_from_identities(spark, small):
    rows = [(1, "P", "c", "n", "pore_volume", "0.5", "cm3/g", None), (2, "P", "c", "n", "surface_area", "200", "m2/g", None), (3, "P", "c", "n", "pore_diameter", "100", None, None), (4, "P", "c", "m", "pore_diameter", "10", None, None)]
    df = spark.createDataFrame(rows, "quantity_id long, paper_name string, catalyst_id string, node_id string, quantity string, value string, unit string, source_text string")
    got = Q.infer_units(Q.normalise(df, table(spark, small, "quantity_ref"))).collect()
    assert [(r.quantity_id, r.unit, r.unique) for r in got] == [(3, "Å", True)]
    assert got[0].residual < 0.01


def test_units_of_further_rows_of_a_node(spark, small):
    rows = [(1, "n", "pore_volume", "0.5", "cm3/g"), (2, "n", "surface_area", "200", "m2/g"), (3, "n", "pore_diameter", "100", None), (5, "n", "pore_diameter", "100", None), (6, "n", "pore_diameter", "11", None), (7, "n", "pore_volume", "510", None)]
    rows += [(11, "m", "pore_volume", "0.5", "cm3/g"), (12, "m", "surface_area", "200", "m2/g"), (13, "m", "pore_diameter", "10", "nm"), (14, "m", "pore_diameter", "99", None), (15, "m", "pore_volume", "0.52", None), (21, None, "pore_volume", "0.5", "cm3/g"), (22, None, "surface_area", "200", "m2/g"), (23, None, "pore_diameter", "10", None), (24, None, "pore_diameter", "100", None)]
    df = spark.createDataFrame([(k, "P", "c", n, q, v, u, None) for k, n, q, v, u in rows], "quantity_id long, paper_name string, catalyst_id string, node_id string, quantity string, value string, unit string, source_text string")
    got = Q.infer_units(Q.normalise(df, table(spark, small, "quantity_ref"))).collect()
    assert sorted((r.quantity_id, r.unit, r.unique) for r in got) == [(3, "Å", True), (5, "Å", True), (6, "nm", True), (7, "mm3/g", True), (14, "Å", True), (15, "cm3/g", True), (23, "nm", True), (24, "Å", True)]
    assert max(r.residual for r in got) < 0.1


def test_hidden_units_are_found_again(spark, small):
    """Nodes whose values obey the identity within a fifth; one of the three units is hidden."""
    r, rows, hidden = random.Random(6), [], {}
    factor = {"pore_diameter": {"nm": 1, "Å": 10, "µm": 1e-3}, "pore_volume": {"cm3/g": 1, "mm3/g": 1e3}, "surface_area": {"m2/g": 1, "cm2/g": 1e4}}
    for k in range(300):
        v, a = r.uniform(0.1, 1.5), r.uniform(20, 900)
        true = {"pore_volume": v, "surface_area": a, "pore_diameter": 4000 * v / a * r.uniform(0.85, 1.2)}
        blind = r.choice(sorted(true))
        for j, (q, x) in enumerate(sorted(true.items())):
            unit = r.choice(sorted(factor[q]))
            rows.append((10 * k + j, "P", "c", f"n{k}", q, f"{x * factor[q][unit]:.6f}", None if q == blind else unit, None))
            if q == blind:
                hidden[10 * k + j] = unit
    df = spark.createDataFrame(rows, "quantity_id long, paper_name string, catalyst_id string, node_id string, quantity string, value string, unit string, source_text string")
    got = {x.quantity_id: x.unit for x in Q.infer_units(Q.normalise(df, table(spark, small, "quantity_ref"))).where("unique").collect()}
    assert sum(got.get(k) == u for k, u in hidden.items()) >= 0.9 * len(hidden)


def test_no_unit_where_the_identity_fails(spark, small):
    rows = [(1, "pore_volume", "0.5", "cm3/g"), (2, "surface_area", "200", "m2/g"), (3, "pore_diameter", "32", None)]
    df = spark.createDataFrame([(k, "P", "c", "n", q, v, u, None) for k, q, v, u in rows], "quantity_id long, paper_name string, catalyst_id string, node_id string, quantity string, value string, unit string, source_text string")
    assert [(r.quantity_id, r.unit, r.unique) for r in Q.infer_units(Q.normalise(df, table(spark, small, "quantity_ref"))).collect()] == [(3, None, False)]


def test_upsert_maps(spark):
    from weft.operators.graph import merge_maps

    df = spark.createDataFrame([("a", 1, {"x": "1", "y": "1"}), ("a", 2, {"y": "2"}), ("b", 1, None)], "id string, t int, props map<string,string>")
    assert {r.id: r.props for r in merge_maps(df, ["id"], "props", ["t"]).collect()} == {"a": {"x": "1", "y": "2"}}


def test_components(spark):
    from weft.operators.vectors import components

    n = 50
    pairs = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 102), (102, 101)], "i long, j long")
    assert {(r.id, r.root) for r in components(pairs).collect()} == {(k, 0) for k in range(n + 1)} | {(k, 100) for k in (100, 101, 102)}
    assert components(pairs.limit(0)).count() == 0
    assert pairs.where(F.col("i") < 0).count() == 0


def test_similarity_self_join_over_all_vectors(spark, tmp_path):
    from weft.plans.reference import QUERIES

    # Vector 50 alone is in the bounded query set; 1 and 2 are alike, 3 is like none.
    rows = [(50, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.1, 0.0]), (3, [0.0, 0.0, 0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: {tuple(r[:2]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("knn_pairs") == set() and run("knn_pairs_all") == {(1, 2)}
    assert run("components_all") == {(50, 50), (1, 1), (2, 1), (3, 3)}
    assert run("contract_nodes_all") == {(a, b) for a in (1, 3, 50) for b in (1, 3, 50) if a != b}


def test_trees_without_nodes_or_targets(spark):
    n, e = tree_frames(spark, [("a", "b")], "ab")
    other = e.withColumn("paper_name", F.lit("Q"))
    assert H.hierarchy(n.limit(0), other).count() == 0 and H.hierarchy(n, other).count() == 2
    t = spark.createDataFrame([], "paper_name string, catalyst_id string, target_id string")
    assert L.reach(t, e.select("paper_name", "catalyst_id", "source_id", "target_id")).count() == 0
