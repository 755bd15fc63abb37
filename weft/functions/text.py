"""Scalar text rules as column expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.names import strip

#: Marks that extraction leaves in texts.
CONTROL_MARKS = ("<!-- PageBreak -->", "☐", "☒", "​", "﻿")
PAGE_COMMENTS = ("PageFooter", "PageHeader", "PageNumber")
LIGATURES = {"ﬂ": "fl", "ﬁ": "fi"}


def clean_control(c: Column) -> Column:
    """Without control marks and without blanks around."""
    for mark in CONTROL_MARKS:
        c = F.replace(c, F.lit(mark), F.lit(""))
    return strip(c)


def strip_page_comments(c: Column) -> Column:
    for name in PAGE_COMMENTS:
        c = F.regexp_replace(c, rf"<!--\s*{name}=.*?-->", "")
    return c


def empty_figures(c: Column) -> Column:
    """Figure bodies emptied, tags kept."""
    return F.regexp_replace(c, r"(?s)(<figure>).*?(</figure>)", "$1$2")


def single_newlines(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("")), "\n+", "\n")


def plain_ligatures(c: Column) -> Column:
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def fenced(c: Column, kind: str) -> Column:
    """The body of the first fenced block of a kind, stripped; null if there is none."""
    return F.nullif(strip(F.regexp_extract(c, rf"(?si)```{kind}\s*\n(.*?)\n```", 1)), F.lit(""))


def tables_to_rows(c: Column) -> Column:
    """The text with every plain HTML table (``<table>`` without attributes) as lines of cells with pipes between; other text stays."""
    parts = F.split(c, "(?s)(?=<table>)|(?<=</table>)")
    cells = lambda r: F.array_join(F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", ""))), "|")
    rows = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1), cells), "\n")
    return F.array_join(F.transform(parts, lambda t: F.when(t.startswith("<table>") & t.endswith("</table>"), F.concat(F.lit("<table>\n"), rows(t), F.lit("\n</table>"))).otherwise(t)), "")


def formula_base(c: Column) -> Column:
    """A formula cut at its first bracket, unless that opens it; then without brackets around the whole."""
    cut_ = F.when(F.locate("(", c) > 1, F.substring_index(c, "(", 1)).otherwise(c)
    cut_ = F.trim(cut_)
    return F.when(cut_.startswith("(") & cut_.endswith(")"), F.regexp_replace(cut_, r"^\((.*)\)$", "$1")).otherwise(cut_)


def name_base(c: Column) -> Column:
    """A name up to its first bracket; empty ones become null."""
    return F.nullif(F.trim(F.substring_index(c, "(", 1)), F.lit(""))


def snippet(c: Column, most: int) -> Column:
    """At most so many characters, with dots where something is cut; empty text becomes null."""
    return F.nullif(F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c), F.lit(""))


def safe_key(c: Column) -> Column:
    """A property name with blanks, dots and hyphens as underscores."""
    return F.regexp_replace(F.trim(c), r"[ .\-]", "_")


def unit_suffix(unit: Column) -> Column:
    """A unit as the end of a property name; ``NoUnit`` if it is missing or blank."""
    u = F.replace(F.replace(F.replace(F.trim(unit), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("-per-")), F.lit("%"), F.lit("pct"))
    return F.coalesce(F.nullif(u, F.lit("")), F.lit("NoUnit"))


def stem(c: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.[^.]*$", "")


def answer(c: Column) -> Column:
    """A model's short answer without quotes, stars and dashes around it."""
    return F.regexp_replace(c, "^['\"*\\- ]+|['\"*\\- ]+$", "")


def took(start: Column, end: Column) -> Column:
    """Seconds from start to end, with fractions; null if either is missing."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def is_fresh(made: Column, now: Column, seconds: int) -> Column:
    """Whether what was made at a time is at most so many seconds old."""
    return F.coalesce(took(made, now) <= seconds, F.lit(False))
