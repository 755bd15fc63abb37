"""Deeply nested records to related flat tables (problem 1).

Nodes and edges leave the payload by one ``inline`` each, with the keys of their
ancestors attached.  Below them, one fold over the levels of a record carries two
arrays: the open members of the current level, each with its path, and the
objects found so far.  A level is a nested ``transform`` over members and
elements, joined by ``flatten``; a last ``inline`` emits rows.  A record with k
brackets has at most k levels, so the fold reaches any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import jsontext as J

SECTIONS = ("catgraph_tree", "synthesis", "testing", "characterization")
_FOUND = "array<struct<path:string,name:string,value:string,unit:string>>"
_OPEN = "array<struct<path:string,m:map<string,string>,a:array<string>>>"
_NEXT = "array<struct<path:string,t:string>>"


def graphs(raw: DataFrame) -> DataFrame:
    """One row per record and section: record_id, paper_name, catalyst_id, section, nodes, edges (arrays of JSON text).

    Payloads that break off, or hold no object, give no row.
    """
    # No filters here: one over a computed column would compute it once more; inline drops nulls and empty arrays.
    root = J.with_plain_json(raw.select("record_id", "paper_name", "catalyst_id", "payload"), "payload")
    root = root.select("record_id", "paper_name", "catalyst_id", J.members(F.col("payload")).alias("root"))
    secs = F.array(*[F.struct(F.lit(s).alias("path"), F.element_at("root", F.lit(s)).alias("t")) for s in SECTIONS])
    secs = F.when(F.map_contains_key("root", "nodes") | F.map_contains_key("root", "edges"), F.array(F.struct(F.lit("").alias("path"), F.to_json("root").alias("t")))).otherwise(secs)
    secs = F.transform(J.nested_only(secs), lambda x: F.struct(x["path"].alias("section"), J.members(x["t"]).alias("m")))
    flat = root.select("record_id", "paper_name", "catalyst_id", F.inline(F.when(F.col("root").isNotNull(), secs)))
    return flat.select("record_id", "paper_name", "catalyst_id", "section", *[J.elements(J.nested_text(F.element_at("m", F.lit(k)))).alias(k) for k in ("nodes", "edges")])


def owners(raw: DataFrame) -> DataFrame:
    """Nodes and edges: record_id, paper_name, catalyst_id, section, owner, pos, body, m (members), owner_id."""

    def tagged(k: str, owner: str) -> Column:
        rows = J.nested_only(F.transform(k, lambda t, i: F.struct(i.cast("string").alias("path"), t.alias("t"))))
        rows = F.transform(rows, lambda x: F.struct(F.lit(owner).alias("owner"), x["path"].cast("long").alias("pos"), x["t"].alias("body"), J.members(x["t"]).alias("m")))
        return F.coalesce(F.filter(rows, lambda x: x["m"].isNotNull()), F.array().cast("array<struct<owner:string,pos:bigint,body:string,m:map<string,string>>>"))

    rows = graphs(raw).select("record_id", "paper_name", "catalyst_id", "section", F.inline(F.concat(tagged("nodes", "node"), tagged("edges", "edge"))))
    return rows.select("*", F.element_at("m", F.lit("id")).alias("owner_id"))


def _opened(level: Column) -> Column:
    return F.transform(level, lambda x: F.struct(
        x["path"].alias("path"), F.when(x["t"].startswith("{"), J.members(x["t"])).alias("m"), F.when(x["t"].startswith("["), J.elements(x["t"])).alias("a"),
    ))


def _below(opened: Column) -> Column:
    """Path and text of the nested members and elements one level down."""
    inside = F.flatten(F.transform(opened, lambda x: F.concat(
        F.coalesce(F.transform(F.map_entries(x["m"]), lambda e: F.struct(F.concat(x["path"], F.lit("/"), e["key"]).alias("path"), e["value"].alias("t"))), F.array().cast(_NEXT)),
        F.coalesce(F.transform(x["a"], lambda t, i: F.struct(F.concat(x["path"], F.lit("/"), i.cast("string")).alias("path"), t.alias("t"))), F.array().cast(_NEXT)),
    )))
    return J.nested_only(inside)


def _valued(opened: Column) -> Column:
    get = lambda x, k: F.element_at(x["m"], F.lit(k))
    hits = F.filter(opened, lambda x: F.coalesce(F.map_contains_key(x["m"], "value"), F.lit(False)) & (x["path"] != ""))
    return F.transform(hits, lambda x: F.struct(F.substring(x["path"], F.lit(2), F.length(x["path"])).alias("path"), get(x, "name").alias("name"), get(x, "value").alias("value"), get(x, "unit").alias("unit")))


def valued_objects(body: Column, m: Column) -> Column:
    """Objects with a member ``value`` below the object in ``body``, whose members ``m`` are: array of (path, name, value, unit)."""
    first = F.array(F.struct(F.lit("").alias("path"), m.alias("m"), F.lit(None).cast("array<string>").alias("a")))
    start = F.struct(first.cast(_OPEN).alias("level"), F.array().cast(_FOUND).alias("found"))
    levels = F.sequence(F.lit(0), F.length(body) - F.length(F.translate(body, "{[", "")))
    step = lambda acc, _: F.when(F.size(acc["level"]) == 0, acc).otherwise(F.struct(
        _opened(_below(acc["level"])).cast(_OPEN).alias("level"), F.concat(acc["found"], _valued(acc["level"])).cast(_FOUND).alias("found"),
    ))
    return F.aggregate(levels, start, step, lambda acc: acc["found"])


def quantities(raw: DataFrame) -> DataFrame:
    """Flat quantities, linked to their node or edge: record_id, section, owner, owner_id, pos, path, holder, name, value, unit.

    A quantity is an object with a member ``value`` of any kind, null included.
    ``path`` runs from the owner; ``holder`` is its first part.  ``name`` is the
    object's own name or else the last part of the path that is no position.
    Null or broken payloads, empty sections and members that are no objects give
    no rows; repeated records come out once each; a null id stays null; further
    columns of ``raw`` are ignored.
    """
    found = owners(raw).select("record_id", "section", "owner", "owner_id", "pos", F.inline(valued_objects(F.col("body"), F.col("m"))))
    return found.withColumn("holder", F.substring_index("path", "/", 1)).withColumn(
        "name", F.coalesce("name", F.element_at(F.filter(F.split("path", "/"), lambda p: ~p.rlike(r"^\d+$")), -1))
    ).select("record_id", "section", "owner", "owner_id", "pos", "path", "holder", "name", "value", "unit")


def nodes(raw: DataFrame) -> DataFrame:
    """Flat nodes, linked to their record and section; nested members stay as JSON text in ``rest``."""
    m = lambda k: F.element_at("m", F.lit(k)).alias(k)
    keep = ("id", "type", "name", "synthesis_level")
    return owners(raw).where("owner = 'node'").select(
        "record_id", "paper_name", "catalyst_id", "section", "pos", *[m(k) for k in keep],
        F.map_filter("m", lambda k, v: ~k.isin(*keep)).alias("rest"),
    )


def edges(raw: DataFrame) -> DataFrame:
    """Flat edges, linked to their record and section."""
    m = lambda k: F.element_at("m", F.lit(k)).alias(k)
    keep = ("id", "type", "source_id", "target_id")
    return owners(raw).where("owner = 'edge'").select(
        "record_id", "paper_name", "catalyst_id", "section", "pos", *[m(k) for k in keep],
        F.map_filter("m", lambda k, v: ~k.isin(*keep)).alias("rest"),
    )
