"""The tool surface: guarded read-only queries over named tables, schema, names, fields, paths, evidence and unit conversion."""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from weft.functions import text as X
from weft.functions import units as U
from weft.operators import kg as K

TOP_K = 100
#: What an aggregate query must not contain, and what one is told by.
WRITES = ("create", "merge", "set", "delete", "remove")
AGGREGATES = ("avg(", "min(", "max(", "stdev(", "stddev(", "count(", "sum(", "percentile_cont(", "percentile_disc(", "collect(")
#: Statements begin with these; with a query after them they would change something.
_COMMANDS = re.compile(r"^\s*(?:create|merge|set|reset|delete|remove|insert|update|drop|alter|truncate|load|refresh|cache|uncache|clear|add|call|analyze|msck|repair|use|replace|copy|execute|declare)\b", re.I)
_READS = re.compile(r"^\s*(?:select|with|values|from|table|\()", re.I)
_LITERALS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def bare(sql: str) -> str:
    """A query without its literals, quoted names and comments."""
    return _LITERALS.sub(" ", sql)


def is_read(sql: str, strict: bool = False) -> bool:
    """True if a query only reads: one statement, which begins like a query, and whose parts in brackets insert nothing.

    With ``strict``, any text that contains one of ``create``, ``merge``, ``set``
    or ``delete`` is refused as well, even inside other words.
    """
    if strict and any(w in sql.lower() for w in WRITES[:4]):
        return False
    text = bare(sql).strip().rstrip(";")
    if ";" in text or not _READS.match(text) or _COMMANDS.match(text):
        return False
    return not re.search(r"\b(?:insert\s+(?:into|overwrite)|delete\s+from|update\s+\w+\s+set|merge\s+into|drop\s+(?:table|view|database|schema))\b", text, re.I)


def has_limit(sql: str) -> bool:
    """Whether the query itself has a limit, not only a query inside it."""
    text, before = bare(sql), None
    while before != text:
        before, text = text, re.sub(r"\([^()]*\)", " ", text)
    return bool(re.search(r"\blimit\b", text, re.I))


def check_aggregate(sql: str) -> str | None:
    """A warning where a query has no aggregate; an error if it doesn't read or names a write."""
    text = bare(sql)
    if not is_read(sql) or re.search(rf"\b(?:{'|'.join(WRITES)})\b(?!\s*\()", text, re.I):
        raise ValueError("an aggregate query must only read")
    squeezed = re.sub(r"\s+\(", "(", text.lower())
    return None if any(a in squeezed for a in AGGREGATES) else "the query has no aggregate"


class Graph:
    """Named tables that can be asked, not changed."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    def _views(self):
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return next(iter(self.tables.values())).sparkSession

    def query(self, sql: str, limit: int = TOP_K, strict: bool = False) -> DataFrame:
        """A read-only query; a limit is added if the query itself has none. Anything that could write is refused."""
        if not is_read(sql, strict):
            raise ValueError("only read queries are allowed")
        out = self._views().sql(sql)
        return out if has_limit(sql) else out.limit(limit)

    def rows(self, sql: str, limit: int = TOP_K) -> str:
        """The rows of ``query`` as one JSON text; an error as an object with its message."""
        try:
            return "[" + ",".join(r[0] for r in self.query(sql, limit).select(F.to_json(F.struct("*"))).collect()) + "]"
        except Exception as e:  # a caller's text may fail in any way; it gets the reason
            return json.dumps({"error": str(e).split("\n")[0]})

    def aggregate(self, sql: str) -> dict:
        """First row of an aggregate query as a dict, empty if there is none."""
        check_aggregate(sql)
        row = self.query(sql, 1).first()
        return row.asDict() if row else {}

    def schema(self, label: str | None = None, prefix: str = "") -> dict[str, list[str]]:
        """Columns of each table, sorted, filtered by table name and by the start of the column name."""
        return {n: keys for n, df in sorted(self.tables.items()) if label in (None, n) and (keys := sorted(c for c in df.columns if c.startswith(prefix)))}

    def graph_schema(self, label: str | None = None, prefix: str = "") -> dict:
        """Property names by label; without filters also relationship types and all property names. Tables ``kg_nodes``, ``kg_edges``."""
        keys = self.tables["kg_nodes"].select("label", F.explode(F.map_keys("attrs")).alias("k")).where(F.col("k").startswith(prefix))
        found = {r["label"]: r["ks"] for r in keys.groupBy("label").agg(F.sort_array(F.collect_set("k")).alias("ks")).collect() if label in (None, r["label"])}
        if label or prefix:
            return {"labels": found}
        types = sorted(r[0] for r in self.tables["kg_edges"].select("rel_type").distinct().collect())
        return {"labels": found, "relationships": types, "properties": sorted({k for ks in found.values() for k in ks})}

    def _one(self, text: str, name: str) -> DataFrame:
        return next(iter(self.tables.values())).sparkSession.createDataFrame([(text,)], f"{name} string")

    def resolve_name(self, free_name: str, labels: list[str] | None = None, top_k: int = 5, patterns: dict[str, str] | None = None, embed=None) -> dict:
        """The node that a free name means and the candidates; an empty name is an error."""
        if not (free_name or "").strip():
            return {"error": "the name is empty"}
        found = K.resolve_names(self._one(free_name.strip(), "phrase"), self.tables["kg_nodes"], patterns or {}, embed, sorted(labels or []), top_k)
        rows = [{"name": r["name"], "original_id": r["id"], "labels": [r["label"]], "score": r["score"], "source": r["source"]} for r in found.orderBy("rank").collect()]
        return {"best_match": rows[0] if rows else None, "candidates": rows}

    def resolve_field(self, phrase: str, top_k: int = 10, patterns: dict[str, str] | None = None, embed=None) -> dict:
        """The property name that a phrase means and the candidates."""
        if not (phrase or "").strip():
            return {"error": "the phrase is empty"}
        keys = K.field_names(self.tables["kg_nodes"], self.tables["kg_edges"].where("false").select(F.create_map().cast("map<string,string>").alias("attrs")) if "attrs" not in self.tables["kg_edges"].columns else self.tables["kg_edges"])
        rows = [{"key": r["key"], "score": r["score"], "source": r["source"]} for r in K.resolve_fields(self._one(phrase.strip().lower(), "phrase"), keys, patterns or {}, embed, top_k).orderBy("rank").collect()]
        return {"canonical": rows[0]["key"] if rows else None, "candidates": rows}

    def synthesis_path(self, target: str, paper: str | None = None, max_depth: int = 20) -> list[dict]:
        """The steps behind a catalyst or chemical given by name or id, the earliest first; an error row if there is no such node."""
        kg = self.tables["kg_nodes"]
        asked = kg.sparkSession.createDataFrame([(target, paper)], "identifier string, paper string")
        found = K.find_targets(asked, kg).where("target_id is not null").select(*K.TREE, "target_id")
        if found.isEmpty():
            return [{"error": f"no node {target!r}" + (f" in paper {paper!r}" if paper else "")}]
        steps = K.synthesis_path(found, kg, self.tables["kg_edges"], max_depth).orderBy("pos")
        return [{"original_id": r["id"], "name": r["name"], "method": r["method"], "procedure": r["procedure"], "paper_name": r["paper_name"]} for r in steps.collect()]


def evidence(records: DataFrame, ids: DataFrame, most: int = 300) -> DataFrame:
    """id, paper_name and a snippet of source_text for each asked id; an id asked twice comes twice, unknown ones not at all."""
    return ids.join(records, "id").select("id", "paper_name", X.snippet(F.col("source_text"), most).alias("source_text"))


def convert_units(spark, value: float, quantity: str, source: str, target: str) -> dict:
    """A single conversion, with the result or an error."""
    row: Row = spark.range(1).select(U.convert(F.lit(float(value)), F.lit(quantity), F.lit(source), F.lit(target)).alias("v")).first()
    if row["v"] is None:
        return {"error": f"cannot convert {quantity} from {source} to {target}"}
    return {"converted_value": row["v"], "result_string": f"{row['v']:.4f} {target}"}


def web_search(search, query: str, max_results: int = 5, depth: str = "basic", days: int | None = None, domains: list[str] | None = None, answer: bool = False) -> dict:
    """What a search engine given as ``search(query, options)`` finds: query, results of five fields each, and its answer if asked for.

    The number of results is kept within 1 and 10, and an unknown depth is the basic one.
    """
    options = {"max_results": min(10, max(1, int(max_results))), "depth": depth if depth in ("basic", "advanced") else "basic", "days": days, "domains": list(domains or []), "answer": answer}
    try:
        found = search(query, options)
    except Exception as e:  # the engine is outside; its failure is an answer, too
        return {"query": query, "results": [], "error": str(e)}
    fields = ("title", "url", "content", "score", "published_date")
    out = {"query": query, "results": [{f: r.get(f) for f in fields} for r in found.get("results", [])]}
    return out | ({"answer": found["answer"]} if answer and found.get("answer") else {})


class Recorder:
    """Calls of tools as rows: name, input (JSON), output, error."""

    def __init__(self):
        self.calls: list[tuple[str, str, str | None, str | None]] = []

    def wrap(self, name: str, tool):
        @functools.wraps(tool)
        def call(*args, **kwargs):
            given = json.dumps({"args": args, **kwargs} if args else kwargs, default=str, indent=2, ensure_ascii=False)
            try:
                out = tool(*args, **kwargs)
            except Exception as e:
                self.calls.append((name, given, None, str(e)))
                raise
            self.calls.append((name, given, json.dumps(out, default=str, ensure_ascii=False), None))
            return out

        return call

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.calls, "tool string, input string, output string, error string")


def spoken(turns: DataFrame, text: str = "content", role: str = "role") -> DataFrame:
    """Turns of a chat without those that only show a tool's output: rendered assistant turns that begin with a rule or a coloured span, or name a tool."""
    t = F.ltrim(F.coalesce(F.col(text), F.lit("")))
    shown = t.startswith("<hr>") | t.contains("🛠️ Tool:") | t.startswith("<span style='color") | t.startswith('<span style="color')
    return turns.where(~((F.col(role) == "assistant") & shown))
