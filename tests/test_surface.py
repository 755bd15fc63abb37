"""Scalars, tools, plug-ins, files and the stream."""

import pytest
from pyspark.sql import functions as F

from weft import plugins, tools
from weft.functions import text as X
from weft.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("f", "x", "y"), [
    (X.formula_base, "Pd(NH3)4(NO3)2", "Pd"), (X.formula_base, "(NH4)", "NH4"), (X.formula_base, None, None), (X.name_base, "(x)", None), (X.name_base, "silica (fumed)", "silica"),
    (X.unit_suffix, "m2/g", "m2-per-g"), (X.unit_suffix, " ", "NoUnit"), (X.unit_suffix, None, "NoUnit"), (X.unit_suffix, "wt%", "wtpct"), (X.safe_key, " weight hourly.SV-h ", "weight_hourly_SV_h"),
    (X.stem, "/a/b.c/d_e.tar.gz", "d_e.tar"), (X.answer, " '**YES**' ", "YES"), (X.clean_control, " ☐a​<!-- PageBreak -->b ", "ab"), (X.empty_figures, "<figure>a\nb</figure>c", "<figure></figure>c"),
    (lambda c: X.fenced(c, "csv"), "x\n```csv\na|b\n1|2\n```", "a|b\n1|2"), (lambda c: X.fenced(c, "csv"), "none", None), (X.tables_to_rows, "x<table><tr><th>a</th><td>b</td></tr><tr><td>1</td></tr></table>y<table><tr><td>2</td></tr></table>", "x<table>\na|b\n1\n</table>y<table>\n2\n</table>"), (lambda c: X.snippet(c, 3), "abcd", "abc..."),
])
def test_scalars(spark, f, x, y):
    assert one(spark, x, f) == y


def test_graph_queries(spark):
    g = tools.Graph({"kg": spark.range(300).withColumn("offset_x", F.col("id"))})
    assert g.query("SELECT id FROM kg").count() == 100
    assert g.query("SELECT id FROM kg LIMIT 150").count() == 150
    assert g.query("SELECT 'delete' AS word, offset_x FROM kg LIMIT 1").count() == 1
    assert g.aggregate("SELECT count(*) AS n FROM kg")["n"] == 300
    assert g.schema(prefix="off") == {"kg": ["offset_x"]}
    for bad in ("DROP TABLE kg", "INSERT INTO kg VALUES (1, 2)", "SHOW TABLES", "SELECT 1; DELETE FROM kg"):
        with pytest.raises(ValueError):
            g.query(bad)


def test_units_tool(spark):
    assert tools.convert_units(spark, 25, "temperature", "degC", "K")["result_string"] == "298.1500 K"
    assert tools.convert_units(spark, 1.5, "pressure", "bar", "psi")["result_string"] == "21.7557 psi"
    assert "error" in tools.convert_units(spark, 1, "mass", "g", "K")


def test_evidence(spark):
    r = spark.createDataFrame([("a", "P", "long text"), ("b", "P", "")], "id string, paper_name string, source_text string")
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "id string")
    assert sorted((x.id, x.source_text) for x in tools.evidence(r, ids, 4).collect() if x.source_text) == [("a", "long..."), ("a", "long...")]


def test_plugins(spark):
    def make():
        def client(p):
            if p == "bad":
                raise RuntimeError("no")
            return p.upper()
        return client

    got = {r.run_id: (r.answer, r.error) for r in plugins.ask(spark.createDataFrame([("1", "a"), ("2", "bad")], "run_id string, text string"), make).collect()}
    assert got == {"1": ("A", None), "2": (None, "RuntimeError: no")}
    e = plugins.embed(spark.createDataFrame([(1, "TiO2"), (2, " "), (3, None)], "id long, name string"), plugins.hashed_embedder, "id", "name")
    assert [r.id for r in e.collect()] == [1]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "P1_x.json").write_text("{synthesis: {nodes: [{id: 'a', p: {value: 1,}},], edges: []}} // end")
    (tmp_path / "in" / "note.md").write_text("text")
    from weft.operators import nested

    assert [(r.owner_id, r.path) for r in nested.quantities(files.graphs(spark, str(tmp_path / "in"))).collect()] == [("a", "p")]
    assert [r.run_id for r in files.documents(spark, str(tmp_path / "in")).collect()] == ["note"]
    files.write_tsv(spark.createDataFrame([("1", "x")], "a string, b string"), str(tmp_path / "t"))
    assert [tuple(r) for r in files.tsv(spark, str(tmp_path / "t")).collect()] == [("1", "x")]
    assert files.patterns([{"pattern": "a+", "name": "A"}, {"regex": "(", "name": "B"}]) == {"a+": "A"}


def test_stream(spark, tmp_path):
    from weft.streaming.upserts import current, follow

    for k, rows in enumerate([[("a", 1, "old"), ("b", 1, "b")], [("a", 2, "new"), ("a", 0, "late")]]):
        df = spark.createDataFrame(rows, "id string, t int, v string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        follow(spark, str(tmp_path / "src"), df.schema, str(tmp_path / "out"), str(tmp_path / "ck"), ["id"], ["t"]).awaitTermination()
        got = {r.id: r.v for r in current(spark, str(tmp_path / "out"), df.schema, k).collect()}
    assert got == {"a": "new", "b": "b"}
    # The part of the untouched key is still the first version.
    assert {r.name for r in (tmp_path / "out").iterdir()} >= {"v=0", "v=1", "m=0", "m=1"}


@pytest.mark.parametrize(("sql", "reads", "limited"), [
    ("SELECT load, add FROM t", True, False), ("select 'drop table x' -- delete", True, False), ("WITH a AS (SELECT 1 LIMIT 3) SELECT * FROM a", True, False), ("SELECT * FROM t WHERE x IN (SELECT y FROM u LIMIT 2) LIMIT 5", True, True),
    ("CREATE TABLE x AS SELECT 1", False, False), ("SELECT 1; DROP TABLE t", False, False), ("FROM t INSERT INTO u SELECT *", False, False), ("cache table t", False, False), ("", False, False), ("SELECT 1 AS `insert into x`", True, False),
])
def test_guards(sql, reads, limited):
    assert tools.is_read(sql) == reads and tools.has_limit(sql) == limited
    assert not tools.is_read("SELECT offset FROM dataset", strict=True)


def test_aggregate_guard():
    assert tools.check_aggregate("SELECT count (*) FROM t") is None and tools.check_aggregate("SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY x) FROM t") is None and tools.check_aggregate("SELECT 1 AS x")
    for bad in ("DELETE FROM t", "SELECT count(*) FROM t WHERE set = 1"):
        with pytest.raises(ValueError):
            tools.check_aggregate(bad)


def test_tools_on_the_graph(spark, small):
    from weft.operators import kg
    from weft.session import table

    nodes = kg.kg_nodes(table(spark, small, "tree_nodes"))
    g = tools.Graph({"kg_nodes": nodes, "kg_edges": kg.kg_edges(table(spark, small, "tree_edges"), nodes)})
    steps = g.synthesis_path("Final catalyst K1")
    assert steps and {"name", "method", "procedure", "original_id", "paper_name"} <= set(steps[0]) and "error" in g.synthesis_path("nothing like it")[0]
    assert g.resolve_name("the FINAL one", patterns={"final": "Final catalyst K1"})["best_match"]["source"] == "regex" and "error" in g.resolve_name(" ")
    assert g.resolve_field("how it was made", patterns={"made": "procedure"})["canonical"] == "procedure"
    assert "Synthesis" in g.graph_schema()["labels"] and g.graph_schema(prefix="proc") == {"labels": {"Synthesis": ["procedure"]}}
    assert tools.json.loads(g.rows("SELECT label, count(*) AS n FROM kg_nodes GROUP BY label")) and "error" in g.rows("DROP TABLE kg_nodes")


def test_search_recorder_and_chat(spark):
    def engine(q, o):
        return {"results": [{"title": "t", "other": 1}], "answer": str(o["max_results"]) + o["depth"]}

    assert tools.web_search(engine, "q", 99, "odd", answer=True) == {"query": "q", "results": [{"title": "t", "url": None, "content": None, "score": None, "published_date": None}], "answer": "10basic"}
    assert "error" in tools.web_search(lambda q, o: 1 / 0, "q")
    rec = tools.Recorder()
    assert rec.wrap("double", lambda x: 2 * x)(x=4) == 8
    with pytest.raises(ZeroDivisionError):
        rec.wrap("bad", lambda: 1 / 0)()
    assert [(r.tool, r.output, r.error) for r in rec.table(spark).collect()] == [("double", "8", None), ("bad", None, "division by zero")]
    turns = spark.createDataFrame([("user", "<hr> mine"), ("assistant", "<hr>x"), ("assistant", "see 🛠️ Tool: x"), ("assistant", "plain"), ("assistant", None)], "role string, content string")
    assert [r.content for r in tools.spoken(turns).collect()] == ["<hr> mine", "plain", None]


def test_models_and_prompts(spark):
    assert plugins.model_parts("OpenAI_gpt_x") == ("openai", "gpt_x") and plugins.key_setting("google_a") == "GOOGLE_API_KEY" and plugins.key_setting("stub_a") is None
    assert plugins.get_model("stub_echo")("x").startswith("```json")
    for bad in ("nounderscore", "nobody_x"):
        with pytest.raises(ValueError):
            plugins.get_model(bad)
    assert plugins.list_models(lambda: ["b", "a"]) == ["a", "b"] and plugins.list_models(lambda: 1 / 0) == []
    df = spark.createDataFrame([("1", "a {b}", ["x", "y"]), ("2", None, None)], "run_id string, t string, ids array<string>")
    got = {r.run_id: r.text for r in plugins.prompts(df, "{{keep}} {T} {IDS}", T="t", IDS="ids").collect()}
    assert got == {"1": '{{keep}} a {b} ["x","y"]', "2": "{{keep}}  "}
    cache = spark.createDataFrame([("0cc175b9c0f1b6a831c399e269772661", [1.0])], "md5 string, embedding array<float>")
    vectors, fresh = plugins.embed_cached(spark.createDataFrame([(" a ",), ("a",), ("bcd",), (" ",), (None,)], "t string"), cache, plugins.hashed_embedder, "t")
    assert vectors.count() == 2 and fresh.count() == 1


def test_papers_by_engine(spark, tmp_path):
    from weft.sources import pdf

    (tmp_path / "a.pdf").write_bytes("First ﬁne\nblock\n\nsecond\fpage two".encode())
    (tmp_path / "b.pdf").write_bytes(b"\xff\xfe\xff")
    found = pdf.files(spark, str(tmp_path))
    blocks = pdf.parse(found, "plain")
    assert {(r.page, r.block_no, r.text) for r in blocks.where("error is null").collect()} == {(1, 0, "First ﬁne\nblock"), (1, 1, "second"), (2, 0, "page two")} and blocks.where("error is not null").count() == 1
    assert pdf.parse(found, "plain", done=blocks).count() == 0 and pdf.parse(found, "plain", done=blocks, force=True).count() == 4
    assert [(r.run_id, r.text, r.is_image) for r in pdf.texts(blocks).collect()] == [("a", "First fine block\n\nsecond\n\n\npage two\n\n\n", True)]
    assert pdf.page_count(b"%PDF-1.4 /Type /Page /Type /Pages /Type/Page ") == 2
    with pytest.raises(ValueError):
        pdf.page_count(b"no")


def test_sinks(spark, tmp_path):
    from weft.sources import sinks

    sinks.write_graphs(spark.createDataFrame([("1", '{"a": 1}'), ("2", "{}"), ("3", None)], "run_id string, payload string"), str(tmp_path / "g"))
    assert [p.name for p in (tmp_path / "g").iterdir() if p.is_dir()] == ["run_id=1"]
    for k in ("x", "y"):
        sinks.write_trees(spark.createDataFrame([(k, 1), ("z", ord(k))], "catalyst_id string, v int"), str(tmp_path / "t"))
    assert {(r.catalyst_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("x", 1), ("y", 1), ("z", ord("y"))}
    names = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "name string, embedding array<double>")
    assert [sinks.write_index(df, str(tmp_path / "i")) for df in (names, names.orderBy(F.desc("name")), names.limit(1))] == [True, False, True]
    sinks.append_runs(spark.createDataFrame([("f", "success")], "file string, status string"), str(tmp_path / "r"))
    assert sinks.as_json_rows(spark.range(1)).first()[0] == '{"id":0}'


def test_checked_graphs_and_spec(spark, tmp_path):
    df = spark.createDataFrame([(1, "P", "{synthesis: {}}"), (2, "P", '{"characterization": {}}'), (3, "P", "{"), (4, "P", None)], "record_id long, paper_name string, payload string")
    good, bad = files.checked_graphs(df)
    assert [r.record_id for r in good.collect()] == [1] and {(r.record_id, r.reason) for r in bad.collect()} == {(2, "has no section"), (3, "can't be read"), (4, "can't be read")}
    (tmp_path / "s.txt").write_text("Catalyst:\nBET | float | area, m2/g\n\nTest:\nT | float | temperature | in K\n")
    assert [(r.section, r["name"], r.description) for r in files.feature_spec(spark, str(tmp_path / "s.txt")).orderBy("pos").collect()] == [("Catalyst", "BET", "area, m2/g"), ("Test", "T", "temperature | in K")]


@pytest.mark.parametrize("most", [200_000, 0])
def test_components_both_ways(spark, monkeypatch, most):
    from weft.operators import vectors

    monkeypatch.setattr(vectors, "IN_A_TASK", most)
    pairs = [(5, 6), (6, 7), (1, 2), (9, 7), (2, 1), (3, 3), (None, 4)]
    got = {(r.id, r.root) for r in vectors.components(spark.createDataFrame(pairs, "i long, j long")).collect()}
    assert got == {(5, 5), (6, 5), (7, 5), (9, 5), (1, 1), (2, 1), (3, 3)}
    assert vectors.components(spark.createDataFrame([], "i long, j long")).count() == 0


def test_features(spark):
    from weft.operators.features import feature_cells, feature_table

    a = spark.createDataFrame([("1", "```csv\n a |b\n1|2\n3\n```"), ("2", "none"), ("3", None), ("4", "```csv\na\n```")], "run_id string, answer string")
    got = {(r.run_id, r.row, r.a, r.b, r.c) for r in feature_table(feature_cells(a), ["a", "b", "c"]).collect()}
    assert got == {("1", 0, "1", "2", None), ("1", 1, "3", None, None)}


@pytest.mark.parametrize(("cell", "y"), [("12.5 %", 12.5), ("10-20", 15.0), ("10 to 20 nm", 15.0), ("2:4", 0.5), ("none", None), ("", None), (None, None), ("-3", -3.0), ("1e-3", 0.001), ("5:0", None)])
def test_numbers_of_cells(spark, cell, y):
    from weft.operators.features import plain_number

    assert one(spark, cell, plain_number) == (pytest.approx(y) if y is not None else None)


def test_times(spark):
    ts = lambda x: F.lit(x).cast("timestamp")
    row = spark.range(1).select(X.took(ts("2024-01-01 00:00:00"), ts("2024-01-01 00:01:00.5")), X.is_fresh(ts("2024-01-01 00:00:00"), ts("2024-01-01 01:00:00"), 3600), X.is_fresh(ts(None), ts("2024-01-01 00:00:00"), 9)).first()
    assert tuple(row) == (60.5, True, False)


def test_jobs(spark, tmp_path, small):
    from weft import jobs

    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "P_a.json").write_text('{"catgraph_tree": {"nodes": [{"id": "a"}], "edges": []}}')
    jobs.main(["import", str(tmp_path / "g"), str(tmp_path / "kg"), "--first-part"])
    assert [(r.paper_name, r.id) for r in spark.read.parquet(str(tmp_path / "kg/nodes.parquet")).collect()] == [("P", "a")]
    jobs.main(["import", str(tmp_path / "g"), str(tmp_path / "kg"), "--first-part"])
    assert spark.read.parquet(str(tmp_path / "kg/nodes.parquet")).count() == 1
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "r1.md").write_text("A catalyst was made.")
    jobs.main(["both", str(tmp_path / "txt"), str(tmp_path / "run")])
    assert spark.read.json(str(tmp_path / "run/metadata")).first()["status"] == "success"
    spark.createDataFrame([(1, "nickel"), (2, "Nickel")], "id long, name string").write.parquet(str(tmp_path / "m/materials.parquet"))
    spark.createDataFrame([("x", 1), ("x", 2)], "chem string, material_id long").write.parquet(str(tmp_path / "m/links.parquet"))
    jobs.main(["merge", str(tmp_path / "m"), str(tmp_path / "merged")])
    assert spark.read.parquet(str(tmp_path / "merged/links")).count() == 1
    jobs.main(["trees", small, str(tmp_path / "trees")])
    jobs.main(["loops", small, str(tmp_path / "loops")])
    jobs.main(["lineage", small, str(tmp_path / "lin")])
    assert spark.read.parquet(str(tmp_path / "lin")).count() > 0
