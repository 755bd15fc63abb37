"""Reading JSON that a language model wrote, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the parser of from_json may accept beyond strict JSON.
LENIENT = {
    "allowComments": "true", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowNumericLeadingZeros": "true",
    "allowNonNumericNumbers": "true", "allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true",
}
# Possessive groups: Java matches them in a loop, not by recursion, so long texts can't overflow its stack.
_STRINGS = r"""("(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+')"""
_COMMENTS = rf"(?s){_STRINGS}|//[^\n]*+|/\*.*?\*/"
_TRAILING = rf"(?s){_STRINGS}|,(?=\s*+[}}\]])"


def _unquote(c: Column) -> Column:
    """The text inside, if the text is one JSON string, else the text."""
    return F.when(c.startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x"), c)).otherwise(c)


def strip_json(c: Column) -> Column:
    """The text without byte-order marks and blanks around it."""
    return F.btrim(c, F.lit(" \t\r\n\u00a0\ufeff"))


def with_plain_json(df: DataFrame, name: str) -> DataFrame:
    """Column ``name`` reduced to the object in its text, without prose, fences, comments and trailing commas around or in it.

    A string that holds JSON is opened (twice at most).  Null stays null; a text
    without braces gives the empty text; a text that breaks off stays broken, so
    that parsing it gives null.  One step a column: an expression that is used
    twice is then computed once.
    """
    c = F.col(name)
    for _ in range(2):
        df = df.withColumn(name, strip_json(c)).withColumn(name, _unquote(c))
    df = df.withColumn("_fenced", F.when(c.contains("```"), F.regexp_extract(c, r"(?s)```\w*+\s*+([{\[].*)", 1)))
    df = df.withColumn(name, F.when(F.col("_fenced") != "", F.col("_fenced")).otherwise(c)).drop("_fenced")
    df = df.withColumn(name, F.regexp_extract(c, r"(?s)\{.*\}", 0))
    df = df.withColumn(name, F.when(c.contains("//") | c.contains("/*"), F.regexp_replace(c, _COMMENTS, "$1")).otherwise(c))
    return df.withColumn(name, F.when(c.rlike(r",\s*+[}\]]"), F.regexp_replace(c, _TRAILING, "$1")).otherwise(c))


def members(c: Column) -> Column:
    """Members of an object as name to JSON text (text values unquoted); null if it can't be parsed whole."""
    return F.from_json(c, "map<string,string>", LENIENT)


def elements(c: Column) -> Column:
    """Elements of an array as JSON text; null if it can't be parsed whole."""
    return F.from_json(c, "array<string>", LENIENT)


def nested_text(c: Column) -> Column:
    """The text of an object or array, also where it is itself stored as text; null for anything else."""
    return F.get(F.transform(nested_only(F.array(F.struct(F.lit("").alias("path"), c.alias("t")))), lambda x: x["t"]), F.lit(0))


def nested_only(rows: Column) -> Column:
    """Of an array of (path, t), those whose text is an object or array, also where it is itself stored as text."""
    rows = F.transform(rows, lambda x: F.struct(x["path"].alias("path"), strip_json(x["t"]).alias("t")))
    rows = F.filter(rows, lambda x: F.substring(x["t"], 1, 1).isin("{", "[", '"'))
    rows = F.transform(rows, lambda x: F.struct(x["path"].alias("path"), _unquote(x["t"]).alias("t")))
    return F.filter(rows, lambda x: (x["t"].startswith("{") & x["t"].endswith("}")) | (x["t"].startswith("[") & x["t"].endswith("]")))


def plain_text(c: Column) -> Column:
    """The text of a JSON text member without its quotes; any other JSON stays as it is, null stays null."""
    t = strip_json(c)
    return F.when(t == "null", None).otherwise(_unquote(t))
