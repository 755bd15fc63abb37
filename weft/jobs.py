"""python -m weft.jobs extract|ml|both|import|merge|trees|text|loops|lineage|xlsx ...: the batch jobs, for spark-submit as well."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import plugins as P
from weft.functions import text as X
from weft.functions.names import strip
from weft.operators import features, hierarchy, kg, lineage, nested, trees
from weft.session import ship
from weft.sources import files, sinks

#: Templates of the stages and their critiques; a job's own go in by ``--prompts``, a module with the same name.
STAGES = {k: (f"Give the {k} graph of this text as JSON. {{CATALYST_IDS}}\n{{ARTICLE_TEXT}}", "Give what is missing or wrong as a patch, fenced as JSON.\n{ANSWER}\n{ARTICLE_TEXT}") for k in trees.SECTIONS}
FEATURES = "Give one row of features per experiment, fenced as csv, with pipes between.\n{FEATURES}\n{SCENARIO}"


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/tree_nodes.parquet"), spark.read.parquet(f"{folder}/tree_edges.parquet")


def extract(spark: SparkSession, o: argparse.Namespace) -> None:
    """Texts to graphs: answers of each stage with their patches, and a record of each run."""
    docs = files.documents(spark, o.input_path, o.file_ext)
    said = P.extract(docs, lambda name=o.model: P.get_model(name), STAGES)
    said.write.mode("overwrite").parquet(f"{o.output_dir}/answers")
    said = spark.read.parquet(f"{o.output_dir}/answers")
    body = F.coalesce(X.fenced(F.col("answer"), "json"), F.regexp_extract("answer", r"(?s)\{.*\}", 0))
    per = said.where(F.col("answer").isNotNull()).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", body.alias("b")))).alias("m"))
    # Sections are JSON already; they are put together as text.
    parts = F.transform(F.map_entries(F.map_filter("m", lambda k, v: F.coalesce(v != "", F.lit(False)))), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"]))
    graphs = per.select("run_id", F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")).alias("payload"))
    sinks.write_graphs(graphs, f"{o.output_dir}/graph")
    n = lambda k: F.count_if((F.col("stage") == k) & F.col("answer").isNotNull()).alias(f"n_{k}")
    runs = trees.extraction_status(said.groupBy("run_id").agg(*[n(k) for k in trees.SECTIONS], F.first("error", ignorenulls=True).alias("error_message")).withColumn("n_tested", F.lit(0)))
    sinks.append_runs(runs.withColumn("model_name", F.lit(o.model)), f"{o.output_dir}/metadata")


def generate(spark: SparkSession, o: argparse.Namespace) -> None:
    """Graphs to a table of features, with an audit of scenarios and answers."""
    raw = spark.read.text(f"{o.output_dir}/graph", recursiveFileLookup=True, wholetext=True).select(X.stem(F.col("_metadata.file_path")).alias("run_id"), F.col("value").alias("payload"))
    scenarios = trees.tree_texts(raw, "run_id")
    spec = files.feature_spec(spark, o.feature_file) if o.feature_file else None
    names = "\n".join(f"{r['name']} ({r['type']}): {r['description']}" for r in spec.orderBy("pos").collect()) if spec is not None else ""
    asked = P.prompts(scenarios.withColumn("f", F.lit(names)), FEATURES, SCENARIO="scenario", FEATURES="f")
    said = P.ask(asked, lambda name=o.model: P.get_model(name)).join(scenarios, "run_id")
    sinks.write_audit(said, f"{o.output_dir}/pairs")
    said = spark.read.parquet(f"{o.output_dir}/pairs")
    cells = features.feature_cells(said)
    columns = sorted(r[0] for r in cells.select("column").distinct().collect())
    if columns:
        files.write_tsv(features.feature_table(cells, columns), f"{o.output_dir}/dataset")


def both(spark: SparkSession, o: argparse.Namespace) -> None:
    extract(spark, o)
    generate(spark, o)


def import_graphs(spark: SparkSession, o: argparse.Namespace) -> None:
    """Graph files to tables of nodes, edges and quantities, merged with what is there; rejected files are listed."""
    good, bad = files.checked_graphs(files.graphs(spark, o.input_path, not o.first_part))
    if o.paper_name:
        good = good.withColumn("paper_name", F.lit(o.paper_name))
    for name, f in (("nodes", nested.nodes), ("edges", nested.edges), ("quantities", nested.quantities)):
        new, path = f(good), f"{o.output_dir}/{name}.parquet"
        if not o.clear:
            # An upsert by file: a file imported again takes the place of its rows.
            try:
                old = spark.read.parquet(path)
            except Exception:  # nothing there yet
                old = None
            if old is not None:
                new = old.join(good.select("record_id"), "record_id", "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{path}.new")
        spark.read.parquet(f"{path}.new").write.mode("overwrite").parquet(path)
    bad.write.mode("overwrite").parquet(f"{o.output_dir}/rejected.parquet")


def merge(spark: SparkSession, o: argparse.Namespace) -> None:
    """What becomes of the materials of a table (id, name), and the links after it; a dry run writes the plan alone."""
    from weft.session import cut

    found = spark.read.parquet(f"{o.tables}/materials.parquet").select("id", "name")
    terms = spark.read.parquet(f"{o.tables}/dictionary.parquet") if o.dictionary else spark.createDataFrame([], "term string, name_en string")
    named = cut(kg.translated(found, terms))
    plan = cut(kg.merge_plan(named, kg.similar_names(named, P.hashed_embedder, o.k, o.similarity_threshold)))
    plan.write.mode("overwrite").parquet(f"{o.output_dir}/plan")
    kg.merge_reduction(plan).write.mode("overwrite").json(f"{o.output_dir}/summary")
    if not o.dry_run:
        links = spark.read.parquet(f"{o.tables}/links.parquet")
        kg.contract_materials(links, plan).write.mode("overwrite").parquet(f"{o.output_dir}/links")
        plan.where("action <> 'merge'").select("id", F.col("new_name").alias("name")).write.mode("overwrite").parquet(f"{o.output_dir}/materials")


def target_trees(spark: SparkSession, o: argparse.Namespace) -> None:
    nodes, edges = _tables(spark, o.tables)
    n = nodes.select(*kg.TREE, strip("id").alias("id"), "type").distinct().dropDuplicates([*kg.TREE, "id"])
    e = edges.select("row_id", *kg.TREE, strip("source_id").alias("source_id"), strip("target_id").alias("target_id"), "type").where("source_id <> '' and target_id <> ''")
    tree, links = trees.target_tree(n, e, nodes.where("is_tested_catalyst").select(*kg.TREE, strip("id").alias("target_id")))
    tree.write.mode("overwrite").parquet(f"{o.output_dir}/nodes")
    links.write.mode("overwrite").parquet(f"{o.output_dir}/edges")


def tree_texts(spark: SparkSession, o: argparse.Namespace) -> None:
    trees.tree_texts(files.graphs(spark, o.tables)).write.mode("overwrite").parquet(o.output_dir)


def loops(spark: SparkSession, o: argparse.Namespace) -> None:
    """Nodes on loops, and one closed path among the steps of each tree that has one."""
    nodes, edges = _tables(spark, o.tables)
    hierarchy.hierarchy(nodes, edges).where("depth = -1").write.mode("overwrite").parquet(o.output_dir)
    trees.step_loops(nodes, edges).write.mode("overwrite").parquet(f"{o.output_dir.rstrip('/')}_paths")


def steps(spark: SparkSession, o: argparse.Namespace) -> None:
    nodes, edges = _tables(spark, o.tables)
    targets = nodes.where("is_tested_catalyst").selectExpr("paper_name", "catalyst_id", "trim(id) AS target_id")
    links = edges.selectExpr("paper_name", "catalyst_id", "trim(source_id) AS source_id", "trim(target_id) AS target_id").where("source_id <> '' and target_id <> ''")
    out = lineage.levels(lineage.reach(targets, links), nodes.selectExpr("paper_name", "catalyst_id", "trim(id) AS id", "type"))
    out.write.mode("overwrite").parquet(o.output_dir)


def xlsx(spark: SparkSession, o: argparse.Namespace) -> None:
    sinks.write_xlsx(files.tsv(spark, o.tables), o.output_dir)


JOBS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], None], str]] = {
    "extract": (extract, "texts to graphs"), "ml": (generate, "graphs to a table of features"), "both": (both, "extract, then ml"), "import": (import_graphs, "graph files to tables of nodes, edges and quantities"),
    "merge": (merge, "materials of the same substance into one"), "trees": (target_trees, "one tree per tested target"), "text": (tree_texts, "trees as readable text"),
    "loops": (loops, "nodes on loops"), "lineage": (steps, "steps behind each tested catalyst, with levels"), "xlsx": (xlsx, "a table as a spreadsheet"),
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="weft")
    sub = p.add_subparsers(dest="job", required=True)
    for name, (_, about) in JOBS.items():
        a = sub.add_parser(name, help=about)
        a.add_argument("input_path" if name in ("extract", "ml", "both", "import") else "tables", help="file or folder to read")
        a.add_argument("output_dir")
        if name in ("extract", "ml", "both"):
            a.add_argument("--model", default="stub_echo", help="provider_model")
            a.add_argument("--file-ext", default=".md")
            a.add_argument("--feature-file")
        if name == "import":
            a.add_argument("--clear", action="store_true", help="replace what is there instead of merging with it")
            a.add_argument("--first-part", action="store_true", help="paper name up to the first underscore")
            a.add_argument("--paper-name")
        if name == "merge":
            a.add_argument("--similarity-threshold", type=float, default=0.75)
            a.add_argument("--k", type=int, default=10)
            a.add_argument("--dictionary", action="store_true")
            a.add_argument("--dry-run", action="store_true")
    o = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"weft-{o.job}").getOrCreate()
    ship(spark)
    JOBS[o.job][0](spark, o)


if __name__ == "__main__":
    main()
