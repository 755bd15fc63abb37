"""Graphs of single papers: merging their sections, what an extraction came to, one tree per tested target, and its text."""

from __future__ import annotations

from collections.abc import Iterator

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.names import filled, join_on, strip
from weft.operators import graph as G
from weft.operators import lineage as L

TREE = G.TREE
SECTIONS = ("synthesis", "testing", "characterization")


def merge_sections(nodes: DataFrame, tested: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of the synthesis section after the other sections are merged into it, with is_tested.

    ``nodes``: the keys, section, pos, id, type and any further columns; ``tested``:
    the keys and id of targets named as tested.  Chemicals of the testing section
    that synthesis lacks are added (of several with one id the first) and count as
    tested; chemicals of characterization that both lack are added, too, but don't.
    Nodes of synthesis are never dropped, and repeated ids among them stay.
    """
    n = nodes.withColumn("id", strip("id"))
    base = n.where("section = 'synthesis'")
    have = base.where(filled(F.col("id"))).select(*keys, "id").distinct()
    extra = n.where("section in ('testing', 'characterization') and type = 'chemical'").where(filled(F.col("id")))
    extra = join_on(extra, have, [*keys, "id"], "left_anti")
    rest = [c for c in n.columns if c not in (*keys, "id")]
    order = F.struct((F.col("section") != "testing").alias("a"), F.col("pos").alias("b"))
    first = extra.groupBy(*keys, "id").agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "id", *[F.col("r").getField(c).alias(c) for c in rest])
    marks = tested.select(*keys, strip("id").alias("id")).unionByName(first.where("section = 'testing'").select(*keys, "id")).distinct().withColumn("_t", F.lit(True))
    out = base.select(*n.columns).unionByName(first.select(*n.columns))
    return join_on(out, marks, [*keys, "id"], "left").withColumn("is_tested", F.coalesce("_t", F.lit(False))).drop("_t")


def extraction_status(counts: DataFrame) -> DataFrame:
    """What an extraction came to, from its sections: adds status.

    ``counts``: n_synthesis, n_testing, n_characterization, n_tested; a null count is none.
    """
    n = {c: F.coalesce(f"n_{c}", F.lit(0)) for c in (*SECTIONS, "tested")}
    status = (
        F.when((n["synthesis"] == 0) & (n["testing"] == 0) & (n["characterization"] == 0), "error_no_data_extracted")
        .when(n["synthesis"] == 0, "warning_no_synthesis_data")
        .when((n["testing"] == 0) & (n["tested"] > 0), "warning_no_testing_data_expected")
        .when(n["testing"] == 0, "warning_no_testing_data").otherwise("success")
    )
    return counts.withColumn("status", status)


def target_tree(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree of each target: its nodes (tree columns, target_id, id, type, part, level) and its edges (tree columns, target_id, row_id, part).

    All nodes from which the target is reached over ``edges``, and the edges into
    them; then the target's own tests and characterizations: every such edge,
    and its node once where it exists.  ``level`` counts steps from the farthest
    (1) to the target; other nodes have none.  ``nodes``: tree columns, id, type
    (unique ids); ``edges``: row_id, tree columns, source_id, target_id, type;
    ``targets``: tree columns, target_id.
    """
    kind = F.lower(strip("type"))
    made = edges.where(~kind.isin("tested_in", "characterized_in"))
    reached = L.reach(targets, made, None)
    level = L.levels(reached, nodes).select(*TREE, "target_id", "id", "level")
    one = nodes.select(*TREE, "id", "type")
    mine = join_on(join_on(reached, one, [*TREE, "id"], "inner"), level, [*TREE, "target_id", "id"], "left")
    mine = mine.select(*TREE, "target_id", "id", "type", F.lit("synthesis").alias("part"), "level")
    inner = made.select("row_id", *TREE, F.col("target_id").alias("id"))
    links = join_on(inner, reached.select(*TREE, "target_id", "id"), [*TREE, "id"], "inner").select(*TREE, "target_id", "row_id", F.lit("synthesis").alias("part"))
    for k, part, of in (("tested_in", "testing", "testing"), ("characterized_in", "characterization", "characterization")):
        own = edges.where((kind == k) & filled(F.col("target_id"))).select("row_id", *TREE, F.col("source_id").alias("target_id"), F.col("target_id").alias("id"))
        own = join_on(own, targets.select(*TREE, "target_id").distinct(), [*TREE, "target_id"], "left_semi")
        links = links.unionByName(own.select(*TREE, "target_id", "row_id", F.lit(part).alias("part")))
        there = join_on(own.select(*TREE, "target_id", "id").distinct(), one.where(F.col("type") == of), [*TREE, "id"], "inner")
        there = join_on(there, mine.select(*TREE, "target_id", "id"), [*TREE, "target_id", "id"], "left_anti")
        mine = mine.unionByName(there.select(*TREE, "target_id", "id", "type", F.lit(part).alias("part"), F.lit(None).cast("int").alias("level")))
    return mine, links


def unreached_steps(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """Steps of a paper's graph that belong to no target's tree: tree columns, id."""
    return join_on(nodes.where("type = 'synthesis'").select(*TREE, "id").distinct(), tree.select(*TREE, "id").distinct(), [*TREE, "id"], "left_anti")


# --- text -----------------------------------------------------------------------------------------


def indented(value, depth: int = 0) -> list[str]:
    """An object or list as indented lines: names in order, a value with its unit in one line, lists by dashes."""
    pad = " " * depth
    pairs = [(f"{k}:", value[k]) for k in sorted(value)] if isinstance(value, dict) else [("-", v) for v in value]
    out = []
    for head, v in pairs:
        if isinstance(v, dict) and "value" in v and len(v) <= 2:
            unit = v.get("unit")
            out.append(f"{pad}{head} {v['value']}{f' {unit}' if unit else ''}")
        elif isinstance(v, (dict, list)):
            out.append(f"{pad}{head}")
            flat = isinstance(v, list) and not any(isinstance(x, (dict, list)) for x in v)
            out += [f"{pad}  - {', '.join(map(str, v))}"] if flat else indented(v, depth + 2)
        else:
            out.append(f"{pad}{head} {v}")
    return out


def _block(out: list[str], title: str, data, depth: int) -> None:
    if isinstance(data, (dict, list)) and data:
        out.append(" " * depth + title)
        out += indented(data, depth + 2)


def tree_text(tree: dict) -> str | None:
    """A target's tree as readable text of four parts; null without a target among its chemicals.

    ``tree``: catalyst_id, nodes, edges, as a graph file holds them.
    """
    target, nodes, edges = tree.get("catalyst_id"), tree.get("nodes") or [], tree.get("edges") or []
    of = lambda kind: [n for n in nodes if n.get("type") == kind]
    chemicals = {n["id"]: n for n in of("chemical") if "id" in n}
    if not target or target not in chemicals:
        return None
    me = chemicals[target]
    out = [f"Catalyst Node Name: {target}", f"Catalyst Name: {me.get('name', 'N/A')}"]
    if me.get("aliases"):
        out.append(f"  Aliases: {', '.join(map(str, me['aliases']))}")
    if me.get("chemical formula"):
        out.append(f"  Formula: {me['chemical formula']}")
    _block(out, "Composition:", me.get("composition"), 2)
    _block(out, "Properties:", me.get("properties"), 2)

    out.append("\nSynthesis Pathway:")
    steps = sorted([n for n in of("synthesis") if n.get("synthesis_level") is not None], key=lambda n: n["synthesis_level"])
    if not steps:
        out.append("  No synthesis steps found.")
    whole = [e for e in edges if e.get("source_id") and e.get("target_id")]
    for step in steps:
        out.append(f"\n  Step {step['synthesis_level']}: {step.get('name', 'N/A')} (ID: {step['id']})")
        if step.get("procedure"):
            out.append(f"    Procedure: {step['procedure']}")
        for title, near, far in (("Inputs", "target_id", "source_id"), ("Outputs", "source_id", "target_id")):
            lines = []
            for e in whole:
                chem = chemicals.get(e[far]) if e[near] == step["id"] else None
                if chem is not None:
                    role = (e.get("properties") or {}).get("role") if title == "Inputs" else None
                    lines.append((f"{chem.get('name', e[far])}{f' ({role})' if role else ''}", chem))
            if lines:
                out.append(f"    {title}:")
            for text, chem in sorted(lines, key=lambda x: x[0]):
                out.append(f"      - {text}")
                _block(out, "Composition:", chem.get("composition"), 8)
                _block(out, "Properties:", chem.get("properties"), 8)
        _block(out, "Conditions:", step.get("conditions"), 4)

    out.append("\nTesting Scenarios:")
    tests = of("testing")
    if not tests:
        out.append("  No testing scenarios found for this catalyst in the tree.")
    for k, t in enumerate(tests, 1):
        out.append(f"\n  Scenario {k}: {t.get('description', 'N/A')} (ID: {t.get('id', f'Test_{k}')})")
        for title, name in (("Conditions", "conditions"), ("Results", "results")):
            now, old = t.get(f"{name}_json"), t.get(name)
            _block(out, f"{title}:" if now else f"{title} (Legacy):", now or old, 4)

    out.append("\nCharacterization:")
    found = of("characterization")
    if not found:
        out.append("  No characterization nodes found for this catalyst in the tree.")
    for k, c in enumerate(found, 1):
        first = lambda *names, c=c: next((c[n] for n in names if c.get(n)), None)
        out.append(f"\n  Characterization {k}: {first('method_name', 'method') or 'N/A'} (ID: {c.get('id', f'Char_{k}')})")
        said = c.get("data_reported") if c.get("data_reported") is not None else c.get("is_reported")
        for title, v in (("Data reported", said), ("Summary", first("characterization_summary", "summary")), ("Evidence", first("evidence_snippet"))):
            if v is not None:
                out.append(f"    {title}: {v}")
    return "\n".join(out)


def tree_texts(trees: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """The text of each tree given as JSON: key, scenario. Trees that can't be read, or lack their target, have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p in zip(b[key], b[payload], strict=True):
                try:
                    d = json.loads(p)
                    text = tree_text(d.get("catgraph_tree", d)) if isinstance(d, dict) else None
                except (ValueError, TypeError, AttributeError, KeyError):
                    text = None
                if text is not None:
                    rows.append((k, text))
            if rows:
                yield pd.DataFrame(rows, columns=[key, "scenario"])

    kind = dict(trees.dtypes)[key]
    return trees.select(key, payload).where(F.col(payload).isNotNull()).mapInPandas(run, f"{key} {kind}, scenario string")


# --- loops among steps ----------------------------------------------------------------------------


def _first_loop(links: pd.DataFrame) -> pd.DataFrame:
    """One closed path of a graph, by a depth-first walk in the order of names."""
    ahead: dict[str, list[str]] = {}
    for a, b in sorted(set(zip(links["source_id"], links["target_id"], strict=True))):
        ahead.setdefault(a, []).append(b)
    done: set[str] = set()
    for start in sorted(ahead):
        path, on, todo = [], set(), [(start, None)]
        while todo:
            x, left = todo.pop()
            if left is None:
                if x in on:
                    cycle = path[path.index(x) :] + [x]
                    return pd.DataFrame({"paper_name": links["paper_name"].iloc[:1], "catalyst_id": links["catalyst_id"].iloc[:1], "loop": [" -> ".join(cycle)]})
                if x in done:
                    continue
                path.append(x)
                on.add(x)
                todo.append((x, True))
                todo += [(y, None) for y in reversed(ahead.get(x, []))]
            else:
                path.pop()
                on.discard(x)
                done.add(x)
    return pd.DataFrame({"paper_name": [], "catalyst_id": [], "loop": []})


def step_loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One closed path among the steps of each tree that has one: tree columns, loop (ids joined by arrows).

    Only edges from step to step count.  Steps that nothing leads into or out of
    are peeled off by joins first, so a task gets what hangs between loops, not a
    whole tree.
    """
    steps = nodes.where("type = 'synthesis'").select(*TREE, strip("id").alias("id")).distinct()
    e = edges.select(*TREE, strip("source_id").alias("source_id"), strip("target_id").alias("target_id")).where(filled(F.col("source_id")) & filled(F.col("target_id"))).distinct()
    for end in ("source_id", "target_id"):
        e = join_on(e, steps.withColumnRenamed("id", end), [*TREE, end], "left_semi")
    e = peeled(e)
    return e.groupBy(*TREE).applyInPandas(_first_loop, "paper_name string, catalyst_id string, loop string")


def peeled(links: DataFrame, rounds: int = 3) -> DataFrame:
    """Links whose source something leads into and whose target leads on, after so many rounds of peeling."""
    for _ in range(rounds):
        links = join_on(links, links.select(*TREE, F.col("target_id").alias("source_id")).distinct(), [*TREE, "source_id"], "left_semi")
        links = join_on(links, links.select(*TREE, F.col("source_id").alias("target_id")).distinct(), [*TREE, "target_id"], "left_semi")
    return links


def first_given(*names: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
