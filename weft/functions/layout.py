"""Text of laid-out documents: how blocks, paragraphs, headings and tables of a page become running text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Kinds of blocks that stand apart, roles that are left out, and words below which a paragraph is no whole one.
SPECIAL = ("table", "figure", "equation", "title")
LEFT_OUT = ("pageHeader", "pageFooter", "pageNumber")
WHOLE_WORDS = 15
#: Fixed value: a text shorter than this comes from pictures of pages.
IMAGE_CHARACTERS = 100


def casings(names: Column) -> Column:
    """Names as they are, then with only the first letter capital, then all capital."""
    first = F.transform(names, lambda n: F.concat(F.upper(F.left(n, F.lit(1))), F.lower(F.substring(n, F.lit(2), F.length(n)))))
    return F.concat(names, first, F.transform(names, F.upper))


def titles(found: Column) -> Column:
    """Of the titles found on a page, those of more than one letter that begin with a capital one."""
    return F.filter(found, lambda t: (F.length(t) > 1) & t.rlike(r"^\p{Lu}"))


def is_title(text: Column, known: Column) -> Column:
    """Whether a text is exactly one of the known titles."""
    return F.coalesce(F.exists(known, lambda t: t == text), F.lit(False))


def marked_sections(text: Column, known: Column) -> Column:
    """The text with each known title marked as a section; longer titles go first, and one inside a title marked before doesn't count."""
    longest = F.array_sort(F.array_distinct(F.filter(known, lambda t: t.isNotNull() & (t != ""))), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("done"))

    def mark(acc: Column, t: Column) -> Column:
        skip = F.exists(acc["done"], lambda d: F.contains(d, F.lower(t))) | ~F.contains(acc["text"], t)
        marked = F.struct(F.replace(acc["text"], t, F.concat(F.lit("Section:"), t, F.lit("\n"))).alias("text"), F.concat(acc["done"], F.array(F.lower(t))).alias("done"))
        return F.when(skip, acc).otherwise(marked)

    return F.aggregate(longest, start, mark, lambda acc: acc["text"])


def joined_blocks(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """Text of each document from the blocks of its pages: doc, text.

    ``blocks``: doc, page, block_no, kind, text.  Tables run on, other special
    blocks end in a line break, text in an empty line unless a table, figure or
    equation follows on its page; a page ends in one more line break.
    """
    on_page = W.partitionBy(doc, "page").orderBy("block_no")
    after = F.lead("kind").over(on_page)
    end = F.when(F.col("kind") == "table", "").when(F.col("kind").isin(*SPECIAL) | F.coalesce(after.isin("table", "figure", "equation"), F.lit(False)), "\n").otherwise("\n\n")
    close = F.when(after.isNull(), "\n").otherwise("")
    rows = blocks.withColumn("_t", F.concat(F.coalesce("text", F.lit("")), end, close))
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "block_no", "_t"))), lambda x: x["_t"]), "").alias("text"))


def joined_paragraphs(paragraphs: DataFrame, doc: str = "doc") -> DataFrame:
    """Text of each document from its paragraphs with roles: doc, text.

    ``paragraphs``: doc, pos, page, role (may be null), text, place (a table or
    figure that the paragraph belongs to, as ``Table_0``, else null).  Headings
    stand after an empty line as sections, footnotes close up to the text before,
    page furniture goes, short paragraphs end in one line break and whole ones in
    two.  A table or figure leaves a mark at its first paragraph; a new page
    starts three lines down.
    """
    part = F.struct("pos", "page", "role", "text", "place")
    each = paragraphs.groupBy(doc).agg(F.sort_array(F.collect_list(part)).alias("ps"))
    start = F.struct(F.lit("").alias("t"), F.lit(1).cast("long").alias("page"), F.array().cast("array<string>").alias("seen"))
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")

    def add(acc: Column, p: Column) -> Column:
        text = F.coalesce(p["text"], F.lit(""))
        turned = p["page"].isNotNull() & (p["page"] != acc["page"])
        t = F.when(turned, F.concat(trim(acc["t"]), F.lit("\n\n\n"))).otherwise(acc["t"])
        heading = F.concat(F.when(t.endswith("\n\n"), t).otherwise(F.concat(trim(t), F.lit("\n\n"))), F.lit("Section:"), text, F.lit("\n"))
        whole = F.size(F.split(text, " ")) >= WHOLE_WORDS
        body = (
            F.when(p["role"] == "sectionHeading", heading)
            .when(p["role"] == "footnote", F.concat(F.substring(t, F.lit(1), F.length(t) - 1), text, F.lit("\n\n")))
            .when(p["role"] == "title", F.concat(t, F.lit("Title:"), text, F.lit("\n")))
            .when(p["role"].isin(*LEFT_OUT), t)
            .when(p["role"].isNotNull() & (p["role"] != "") | whole, F.concat(t, text, F.lit("\n\n")))
            .otherwise(F.concat(t, text, F.lit("\n")))
        )
        known = F.coalesce(F.array_contains(acc["seen"], p["place"]), F.lit(False))
        mark = F.when(known, acc["t"]).otherwise(F.concat(acc["t"], F.lit("<"), p["place"], F.lit(">\n")))
        placed = p["place"].isNotNull()
        return F.struct(
            F.when(placed, mark).otherwise(body).alias("t"),
            F.when(~placed & turned, p["page"].cast("long")).otherwise(acc["page"]).alias("page"),
            F.when(placed & ~known, F.concat(acc["seen"], F.array(p["place"]))).otherwise(acc["seen"]).alias("seen"),
        )

    return each.select(doc, F.aggregate("ps", start, add, lambda acc: acc["t"]).alias("text"))


def filled_places(text: Column, contents: Column) -> Column:
    """The text with what tables and figures hold put behind their marks; ``contents`` maps a place to its text."""
    entries = F.map_entries(contents)
    return F.aggregate(entries, text, lambda t, e: F.replace(t, F.concat(F.lit("<"), e["key"], F.lit(">\n")), F.concat(F.lit("<"), e["key"], F.lit(">\n"), F.regexp_replace(e["value"], r"^\s+|\s+$", ""), F.lit("\n"))))


def _cell(c: Column) -> Column:
    """A cell as text with pipes between: quoted if it holds a pipe, a quote or a line break."""
    return F.when(c.rlike("[|\"\n\r]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))


def table_text(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """Tables as lines of cells with pipes between: key, text.

    ``cells``: key, row_index, column_index (from 0), content, and caption and
    footnotes (text, the same on all rows of a table; may be null).  The grid is
    filled up to its largest row and column; of two cells at one place the last
    by content stays.
    """
    own = [c for c in ("caption", "footnotes") if c in cells.columns]
    one = cells.groupBy(key, "row_index", "column_index").agg(F.max(F.coalesce("content", F.lit(""))).alias("content"), *[F.max(c).alias(c) for c in own])
    size = one.groupBy(key).agg(F.max("row_index").alias("rows"), F.max("column_index").alias("cols"), F.collect_list(F.struct(F.struct("row_index", "column_index").alias("at"), _cell(F.col("content")).alias("c"))).alias("cs"), *[F.max(c).alias(c) for c in own])
    at = F.map_from_entries("cs")
    row = lambda r: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("cols").cast("long")), lambda c: F.coalesce(F.element_at(at, F.struct(r.cast("int").alias("row_index"), c.cast("int").alias("column_index"))), F.lit(""))), "|")
    body = F.concat(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows").cast("long")), row), "\n"), F.lit("\n"))
    around = lambda c: F.when(F.length(c) > 0, F.concat(F.col(c), F.lit("\n"))).otherwise("") if c in own else F.lit("")
    return size.select(key, F.concat(around("caption"), body, around("footnotes")).alias("text"))


def image_pages(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """Whether a document's text comes from pictures: doc, text_length, bad_characters, is_image.

    ``pages``: doc, page, text.  Each page's length goes down by all bad
    characters so far, not only its own; a document is one of pictures if less
    than ``IMAGE_CHARACTERS`` are left, or fewer than the bad ones.
    """
    bad = F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))
    so_far = F.sum(bad).over(W.partitionBy(doc).orderBy("page").rowsBetween(W.unboundedPreceding, 0))
    rows = pages.withColumn("text", F.coalesce("text", F.lit(""))).select(doc, (F.length("text") - so_far).alias("left"), bad.alias("bad"))
    out = rows.groupBy(doc).agg(F.sum("left").alias("text_length"), F.sum("bad").alias("bad_characters"))
    return out.withColumn("is_image", (F.col("text_length") < IMAGE_CHARACTERS) | (F.col("bad_characters") > F.col("text_length")))
