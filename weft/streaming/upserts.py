"""Tables that follow arriving files: each micro-batch is merged by key, the last row by order wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.operators.graph import last_by

#: Parts that a table is kept in; a batch rewrites only those that it has keys of.
PARTS = 256


def _manifest(spark: SparkSession, target: str, number: int) -> dict[int, int]:
    """Version of each part after a batch; none before the first."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/m={number}")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return {}
    return {r["part"]: r["version"] for r in spark.read.schema("part int, version int").json(f"{target}/m={number}").collect()}


def current(spark: SparkSession, target: str, schema: StructType, number: int) -> DataFrame:
    """The table as it was after batch ``number``."""
    paths = [f"{target}/v={v}/part={p}" for p, v in sorted(_manifest(spark, target, number).items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def follow(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: list[str], order: list[str]):
    """A query that keeps ``target`` at the last row of each key of the Parquet files arriving in ``source``.

    Batch N merges its rows with the parts that hold their keys and writes these
    as ``target/v=N``; a list ``target/m=N`` names the version of each part.  A
    batch that is run again reads the list of the one before and writes the same
    again, so a restart changes nothing; versions that no such list names are deleted.
    """
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        old = _manifest(session, target, number - 1)
        rows = batch.select(*schema.fieldNames()).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))
        touched = [r["part"] for r in rows.select("part").distinct().collect()]
        held = [f"{target}/v={old[p]}/part={p}" for p in touched if p in old]
        if held:
            kept = session.read.schema(schema).parquet(*held)
            rows = rows.unionByName(kept.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")))
        last_by(rows, [*keys, "part"], order).select(*schema.fieldNames(), "part").repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{target}/v={number}")
        new = old | dict.fromkeys(touched, number)
        session.createDataFrame(sorted(new.items()), "part int, version int").coalesce(1).write.mode("overwrite").json(f"{target}/m={number}")
        for p, v in set(_manifest(session, target, number - 2).items()) - set(old.items()):
            stale = fs.Path(f"{target}/v={v}/part={p}")
            stale.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(stale, True)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
