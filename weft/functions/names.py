"""Small column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks in the sense of Unicode; Java's plain \s knows only the ASCII ones.
EDGE_BLANKS = r"(?U)^\s+|\s+$"


def strip(c: Column | str) -> Column:
    """The text without blanks (of any kind) around it; null stays null."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, EDGE_BLANKS, "")


def filled(c: Column) -> Column:
    """True if the text is neither null nor empty."""
    return c.isNotNull() & (c != "")


def join_on(a: DataFrame, b: DataFrame, cols: list[str], how: str) -> DataFrame:
    """Null-safe equi-join that keeps the left copy of the key columns."""
    r = b.select([F.col(c).alias(f"_{c}") if c in cols else F.col(c) for c in b.columns])
    on = F.lit(True)
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(r, on, how).drop(*[f"_{c}" for c in cols])
