"""Scans and sinks on files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import jsontext as J
from weft.functions import text as X


def documents(spark: SparkSession, path: str, ext: str = ".md") -> DataFrame:
    """Whole text files below a folder: path, run_id (the file's stem), text."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ext}").text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), X.stem(F.col("_metadata.file_path")).alias("run_id"), F.col("value").alias("text"))


def graphs(spark: SparkSession, path: str, whole_stem: bool = True) -> DataFrame:
    """Graph files (JSON or JSON5): record_id, paper_name, catalyst_id, payload, for the operators on nested records.

    The paper is the file's stem, or with ``whole_stem`` false its part up to the
    first underscore.  Files that hold no graph give no nodes later on.
    """
    df = spark.read.option("pathGlobFilter", "*.{json,json5}").text(path, wholetext=True)
    stem = X.stem(F.col("_metadata.file_path"))
    return df.select(F.xxhash64(F.col("_metadata.file_path")).alias("record_id"), (stem if whole_stem else F.split(stem, "_")[0]).alias("paper_name"), F.lit(None).cast("string").alias("catalyst_id"), F.col("value").alias("payload"))


def run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Run records, one JSON object a file; usage as it was written."""
    fields = ("file", "status", "run_id", "output_graph_file", "model_name", "error_message", "ml_generation_status", "usage_metadata")
    df = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    df = J.with_plain_json(df.select(F.col("value").alias("payload")), "payload").select(J.members(F.col("payload")).alias("m"))
    return df.select(*[F.element_at("m", F.lit(k)).alias(k) for k in fields])


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header line, all columns as text; blanks around column names go, those in cells stay."""
    df = spark.read.option("sep", "\t").option("header", "true").csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def feature_spec(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``name | type | description`` under section lines that end in a colon: section, pos, name, type, description.

    A first line with a bar is a head and drops out.  The file, a short list, is
    read by Spark, wherever it lies.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    rows, section = [], ""
    for k, line in enumerate(lines):
        if line.endswith(":") and "|" not in line:
            section = line[:-1]
        elif "|" in line and k:
            parts = [p.strip() for p in line.split("|", 2)] + ["", ""]
            rows.append((section, len(rows), *parts[:3]))
    return spark.createDataFrame(rows, "section string, pos int, name string, type string, description string")


#: Sections of which a graph file must have at least one.
GRAPH_SECTIONS = ("synthesis", "testing", "catgraph_tree")


def checked_graphs(graphs_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs that can be read and have a section of ``GRAPH_SECTIONS``, and the others: record_id, paper_name, reason."""
    m = J.with_plain_json(graphs_.withColumn("_raw", F.col("payload")), "payload").withColumn("_m", J.members(F.col("payload")))
    has = F.exists(F.map_keys("_m"), lambda k: k.isin(*GRAPH_SECTIONS))
    reason = F.when(F.col("_m").isNull(), "can't be read").when(~has, "has no section")
    m = m.withColumn("reason", reason).withColumn("payload", F.col("_raw"))
    return m.where("reason is null").select(*graphs_.columns), m.where("reason is not null").select("record_id", "paper_name", "reason")


def patterns(entries: dict | list) -> dict[str, str]:
    """Patterns and the names they stand for, from a mapping or a list of records; invalid patterns are left out."""
    if isinstance(entries, dict):
        pairs = list(entries.items())
    else:
        pairs = [(e.get("pattern") or e.get("regex"), e.get("name") or e.get("canonical") or e.get("key")) for e in entries]
    out = {}
    for p, n in pairs:
        try:
            re.compile(p or "(")
        except re.error:
            continue
        if n:
            out[p] = n
    return out
