"""Session factory, table access and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weft")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own; a cluster
    without one is an error, as executors would not share the files.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "weft-shared")
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage and survives the loss of executors; unlike checkpoint files
    the table is compressed and columns that nobody reads cost nothing.
    """
    folder = f"{shared_folder(df.sparkSession)}/weft-{df.sparkSession.sparkContext.applicationId}"
    _swept_at_the_end(df.sparkSession, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def _swept_at_the_end(spark: SparkSession, folder: str) -> None:
    """Have the application's tables deleted when it ends; results are lazy, so none can go before."""
    sc = spark.sparkContext
    if getattr(sc, "_weft_swept", None) != folder:
        p = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        sc._weft_swept = folder


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_weft_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_weft_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "weft.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "weft")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._weft_shipped = True
