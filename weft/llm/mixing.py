"""Mixing sources to target weights (problem 9), by hierarchical budgeting.

Weights run down a tree of domains, sources and languages: domains and sources
with their target shares, languages with what they hold.  A child that can't take
its part, even with all its repeats, hands the rest to its siblings; only what no
sibling can take goes up to the ancestors.  Each leaf is then drawn in seeded
epochs: whole ones, and a prefix by tokens of the last.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from weft.session import cut

#: Where the public tokenizer's ranks are; the file is on every machine.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how that tokenizer splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 20_240_601
#: Slices of a leaf's shuffled order; only the slice with the cut is put in order row by row.
SLICES = 4096
#: Languages of a source that are leaves of their own.
MOST_LANGS = 200


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``texts`` with n_tokens in place of text; null and empty texts have none."""

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    return texts.withColumn("n_tokens", tokens(F.col("text"))).drop("text")


def share_out(budget: float, children: dict, weights: dict, capacity: dict) -> tuple[dict, float]:
    """Split a budget by weights under capacities; a shortage goes to the siblings by their weights. Returns parts and what none could take."""
    parts, open_, left = dict.fromkeys(children, 0.0), {c for c in children if weights[c] > 0 and capacity[c] > 0}, budget
    while open_ and left > 1e-9 * max(budget, 1.0):
        total = sum(weights[c] for c in open_)
        give = {c: min(left * weights[c] / total, capacity[c] - parts[c]) for c in open_}
        for c, x in give.items():
            parts[c] += x
        left -= sum(give.values())
        full = {c for c in open_ if capacity[c] - parts[c] <= 1e-9 * max(capacity[c], 1.0)}
        if not full:
            break
        open_ -= full
    return parts, max(left, 0.0)


class Node:
    """A place in the tree: its weight among its siblings and, at a leaf, the tokens that it can give."""

    def __init__(self, weight: float, children: dict | None = None, room: float = 0.0):
        self.weight, self.children = weight, children or {}
        self.room = sum(c.room for c in self.children.values()) if self.children else room


def spread(node: Node, budget: float, path: tuple = ()) -> tuple[dict[tuple, float], float]:
    """What each leaf gives of a budget, and what the whole tree can't give.

    A shortage is shared among the siblings by their weights, at each level on
    the way down, so an ancestor sees only what none of its descendants could take.
    """
    if not node.children:
        take = min(budget, node.room)
        return {path: take}, budget - take
    kids = node.children
    parts, left = share_out(budget, kids, {k: c.weight for k, c in kids.items()}, {k: c.room for k, c in kids.items()})
    out: dict[tuple, float] = {}
    for k, part in parts.items():
        given, rest = spread(kids[k], part, (*path, k))
        out |= given
        left += rest
    return out, left


def budgets(leaves: list[dict], targets: dict[str, tuple], total: float | None = None) -> tuple[dict[tuple[str, str], float], float]:
    """Tokens to draw from each leaf (source, lang), and those that no source can give.

    ``leaves``: source, lang, tokens; ``targets``: source to (share, repeats[,
    domain]); a source without a domain stands alone.  A domain weighs what its
    sources do.  ``total`` defaults to the tokens of one pass over all listed sources.
    """
    held: dict[str, dict[str, float]] = {}
    for x in leaves:
        held.setdefault(x["source"], {})[x["lang"]] = float(x["tokens"])
    total = sum(v for langs in held.values() for v in langs.values()) if total is None else total
    domains: dict[str, dict[str, Node]] = {}
    for s, t in targets.items():
        langs = {k: Node(v, room=v * max(0, t[1] or 0)) for k, v in held.get(s, {}).items()}
        name = t[2] if len(t) > 2 and t[2] is not None else f"\x01{s}"
        domains.setdefault(name, {})[s] = Node(max(0.0, t[0] or 0.0), langs)
    root = Node(1.0, {d: Node(sum(n.weight for n in sources.values()), sources) for d, sources in domains.items()})
    given, left = spread(root, total)
    return {(p[1], p[2]): v for p, v in given.items() if len(p) == 3}, left


def draw(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The drawn mixture and its report.

    ``documents``: doc_id, text, lang, source; ``targets``: source, target_share,
    max_repeats (a row per source), and domain where sources have one.  The mixture
    has a row per drawn document: doc_id, source, lang, n_tokens, n_times.  The
    report has a row per target: source, target_share, max_repeats, tokens_held,
    tokens_drawn, tokens_wanted (its share of the budget, so that what is missing
    shows), actual_share, repeats (drawn by held).

    Sources and languages are compared in lower case without blanks.  Documents
    of unlisted or null sources, without text, or repeating a doc_id are not
    drawn; a null language is a language of its own.  A leaf misses its budget
    by less than one document.
    """
    domain = F.col("domain") if "domain" in targets.columns else F.lit(None).cast("string")
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats", domain.alias("domain")).where("source is not null")
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("domain").alias("domain"))
    wanted = {r["source"]: (r["target_share"], r["max_repeats"], r["domain"]) for r in t.collect()}  # one row per target
    t = t.drop("domain")
    docs = documents.select("doc_id", "text", F.lower(F.trim("source")).alias("source"), F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"))
    docs = docs.where(F.col("source").isin(*wanted) & (F.length("text") > 0))
    # Tokens are counted where the texts are; only numbers are moved to make documents unique.
    rest = F.struct("source", "lang", "n_tokens")
    sized = count_tokens(docs, tokenizer).groupBy("doc_id").agg(F.min(rest).alias("r")).select("doc_id", "r.*")
    sized = cut(sized.where("n_tokens > 0"))
    # Languages are free text: what goes beyond MOST_LANGS of a source, the smallest, is one leaf.
    per_lang = sized.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens"))
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("tokens"), "lang"))
    per_lang = cut(per_lang.withColumn("leaf", F.when(place <= MOST_LANGS, F.col("lang")).otherwise(F.lit("\x01"))))
    sized = sized.join(per_lang.select("source", "lang", "leaf"), ["source", "lang"]).withColumnRenamed("lang", "said").withColumnRenamed("leaf", "lang")
    leaves = [r.asDict() for r in per_lang.groupBy("source", F.col("leaf").alias("lang")).agg(F.sum("tokens").alias("tokens")).collect()]
    plan, _ = budgets(leaves, wanted, total)
    rows = [(x["source"], x["lang"], int(plan[x["source"], x["lang"]] // x["tokens"]), plan[x["source"], x["lang"]] % x["tokens"]) for x in leaves]
    plans = documents.sparkSession.createDataFrame(rows, "source string, lang string, epochs int, rest double")
    # The order of the last, unfinished epoch: a hash of seed, epoch and document.
    full = sized.join(plans, ["source", "lang"]).withColumn("h", F.xxhash64(F.lit(seed), "epochs", "doc_id"))
    full = full.withColumn("slice", F.pmod(F.shiftright("h", 40), F.lit(SLICES)))
    per = full.groupBy("source", "lang", "slice").agg(F.sum("n_tokens").alias("here"))
    per = per.withColumn("before", F.sum("here").over(W.partitionBy("source", "lang").orderBy("slice")) - F.col("here"))
    placed = full.join(per, ["source", "lang", "slice"])  # leaves by SLICES rows: bounded, but whether to send them is left to Spark
    inside = placed.where("before + here <= rest").withColumn("last", F.lit(1)).drop("h")
    at_cut = placed.where("before < rest and before + here > rest")
    upto = F.sum("n_tokens").over(W.partitionBy("source", "lang", "slice").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    at_cut = at_cut.withColumn("last", F.when(F.col("before") + upto <= F.col("rest"), 1).otherwise(0)).drop("h")
    beyond = placed.where("before >= rest").withColumn("last", F.lit(0)).drop("h")
    drawn = inside.unionByName(at_cut).unionByName(beyond).withColumn("n_times", F.col("epochs") + F.col("last")).where("n_times > 0")
    drawn = drawn.select("doc_id", "source", F.col("said").alias("lang"), "n_tokens", "n_times")
    held = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens_held"))
    took = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_times")).alias("tokens_drawn"))
    report = t.join(held, "source", "left").join(took, "source", "left").fillna(0, ["tokens_held", "tokens_drawn"])
    report = report.withColumn("tokens_wanted", F.round(F.col("target_share") * (sum(x["tokens"] for x in leaves) if total is None else total)).cast("long"))
    every = F.sum("tokens_drawn").over(W.partitionBy(F.lit(0)))
    report = report.withColumn("actual_share", F.round(F.try_divide("tokens_drawn", every), 6)).withColumn("repeats", F.round(F.try_divide("tokens_drawn", F.col("tokens_held")), 4))
    return drawn, report
