"""Papers as files of pages, read by engines that are plugged in.

An engine turns the bytes of a file into blocks; what becomes of the blocks is
plain column work in ``weft.functions.layout``.  Engines run in the tasks that
read the files, a failing file gets its error, and files done before are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import layout as Y
from weft.functions import text as X

BLOCKS = "path string, md5 string, page int, block_no int, kind string, text string, error string"
#: An engine gets a file's bytes and gives (page, block number, kind, text) of each block.
Engine = Callable[[bytes], list[tuple[int, int, str, str]]]
ENGINES: dict[str, Callable[[], Engine]] = {}


def engine(name: str) -> Callable:
    """Registers a maker of engines by name; each call may choose another engine."""

    def add(make: Callable[[], Engine]) -> Callable[[], Engine]:
        ENGINES[name] = make
        return make

    return add


@engine("plain")
def plain_engine() -> Engine:
    """A stub that works offline: UTF-8 text, pages parted by form feeds, blocks by empty lines."""

    def read(data: bytes) -> list[tuple[int, int, str, str]]:
        pages = data.decode("utf-8").split("\f")
        return [(p, k, "text", b) for p, page in enumerate(pages, 1) for k, b in enumerate(x for x in page.split("\n\n") if x.strip())]

    return read


@engine("fitz")
def fitz_engine() -> Engine:
    """Text blocks of the pages, in order of their number; needs that library."""
    import fitz

    def read(data: bytes) -> list[tuple[int, int, str, str]]:
        with fitz.open(stream=data, filetype="pdf") as doc:
            return [(p, b[5], "text" if b[6] == 0 else "figure", b[4]) for p, page in enumerate(doc, 1) for b in page.get_text("blocks")]

    return read


def page_count(data: bytes) -> int:
    """Pages of a PDF by its page objects; an error if the bytes are none."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("Invalid PDF file")
    import re

    return len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data))


def files(spark: SparkSession, folder: str, ext: str = ".pdf") -> DataFrame:
    """The files of a folder: path, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}").load(folder).select("path", "content")


def parse(found: DataFrame, name: str, done: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Blocks of each file by an engine: path, md5, page, block_no, kind, text, error (one row without blocks if the engine failed).

    ``done`` has the md5 of files that were parsed before; they are left out
    unless ``force`` is set.
    """
    make = ENGINES[name]
    todo = found.withColumn("md5", F.md5("content"))
    if done is not None and not force:
        todo = todo.join(done.select("md5").distinct(), "md5", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: Any = None
        for b in batches:
            rows = []
            for path, md5, content in zip(b["path"], b["md5"], b["content"], strict=True):
                try:
                    read = read or make()
                    rows += [(path, md5, p, k, kind, text, None) for p, k, kind, text in read(bytes(content))]
                except Exception as e:  # a broken file belongs to its row
                    rows.append((path, md5, None, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "md5", "page", "block_no", "kind", "text", "error"]).astype({"page": "Int32", "block_no": "Int32"})

    return todo.select("path", "md5", "content").mapInPandas(run, BLOCKS)


def texts(blocks: DataFrame) -> DataFrame:
    """Running text of each file: run_id (the file's stem), text, is_image; ligatures and line breaks inside blocks go."""
    good = blocks.where("error is null")
    clean = good.withColumn("text", X.plain_ligatures(F.when(F.col("kind") == "text", F.replace(F.col("text"), F.lit("\n"), F.lit(" "))).otherwise(F.col("text"))))
    pages = good.groupBy("path", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    pictures = Y.image_pages(pages, "path").select("path", "is_image")
    return Y.joined_blocks(clean, "path").join(pictures, "path").select(X.stem(F.col("path")).alias("run_id"), "text", "is_image")
