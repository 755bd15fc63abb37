"""Feature rows from model answers: a fenced block of pipe-separated text with a header line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text as X


def feature_cells(answers: DataFrame, key: str = "run_id", answer: str = "answer") -> DataFrame:
    """Long form: key, row (from 0), column, value. Column names are stripped, cells are not; short rows lack their last cells.

    Answers without a block, or with a header only, give no rows.
    """
    lines = F.split(X.fenced(F.col(answer), "csv"), "\n")
    heads = F.transform(F.split(lines[0], r"\|"), lambda x: F.trim(x))
    rows = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, i: F.struct(i.alias("row"), F.split(x, r"\|").alias("cells")))
    each = answers.withColumn("_l", lines).where("_l is not null").select(key, heads.alias("heads"), F.inline(rows)).where("array_join(cells, '') <> ''")
    return each.select(key, "row", F.posexplode("cells").alias("_p", "value"), "heads").where("_p < size(heads)").select(key, "row", F.get("heads", F.col("_p")).alias("column"), "value")


def feature_table(cells: DataFrame, columns: list[str], key: str = "run_id") -> DataFrame:
    """Wide form with the asked columns; a column that an answer lacks is null."""
    return cells.groupBy(key, "row").pivot("column", columns).agg(F.first("value"))


def plain_number(c: Column) -> Column:
    """A feature's cell as a number: the first number in it, or the middle of a range; a ratio ``a:b`` is a over b, a text without a number is null."""
    num = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
    t = F.translate(c, "−–—", "---")
    part = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit("")).try_cast("double")
    ratio, span = rf"^\s*({num})\s*:\s*({num})\s*$", rf"({num})\s*(?:-|to|~)\s*({num})"
    return F.when(t.rlike(ratio), F.try_divide(part(ratio, 1), part(ratio, 2))).when(t.rlike(span), (part(span, 1) + part(span, 2)) / 2).otherwise(part(rf"({num})", 1))
