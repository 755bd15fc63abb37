"""What jobs leave behind: graphs, run records, trees, audits, indexes, spreadsheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_graphs(graphs: DataFrame, path: str, key: str = "run_id", payload: str = "payload") -> None:
    """One JSON file's worth of text per graph, in a folder per run; empty graphs are not written."""
    some = graphs.where(F.col(payload).isNotNull() & ~F.trim(payload).isin("", "{}", "null"))
    some.select(key, F.col(payload).alias("value")).write.mode("overwrite").partitionBy(key).option("partitionOverwriteMode", "dynamic").text(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Run records added to what is there, also those of failed runs."""
    runs.write.mode("append").json(path)


def write_trees(trees: DataFrame, path: str, key: str = "catalyst_id") -> None:
    """A folder per target; a target written again takes the place of its old one, others stay."""
    trees.write.mode("overwrite").partitionBy(key).option("partitionOverwriteMode", "dynamic").parquet(path)


def write_audit(pairs: DataFrame, path: str) -> None:
    """Scenario and raw answer of each call, and its error if it had one: run_id, scenario, answer, error."""
    pairs.select("run_id", "scenario", "answer", "error").write.mode("append").parquet(path)


def write_index(names: DataFrame, path: str, key: str = "name", vector: str = "embedding") -> bool:
    """Names with their vectors, written again only if the set of names differs from the one that is there; tells whether it was written."""
    from weft.operators.kg import fingerprint

    spark, now = names.sparkSession, fingerprint(names, key).first()
    try:
        old = spark.read.parquet(f"{path}/mark").first()
    except Exception:  # no index yet
        old = None
    if old is not None and (old["n"], old["fingerprint"]) == (now["n"], now["fingerprint"]):
        return False
    names.select(key, vector).write.mode("overwrite").parquet(f"{path}/names")
    spark.createDataFrame([now]).write.mode("overwrite").parquet(f"{path}/mark")
    return True


def as_json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON text: json; times and decimals as text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_xlsx(df: DataFrame, path: str, most: int = 1_048_575) -> bool:
    """A small table as a spreadsheet, unless the file is there; more rows than a sheet has are an error. Needs a library for spreadsheets."""
    import os

    if os.path.exists(path):
        return False
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError("too many rows for a sheet")
    rows.to_excel(path, index=False)
    return True
