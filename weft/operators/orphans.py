"""References to records that do not exist (problem 5).

Parents and children come together in one tagged long form, which is grouped by
parent table and key.  The groups are small summaries, combined before the
shuffle, so a key that holds a third of all rows costs no more than any other.
Keys of ordinary size are grouped with their rows, in one shuffle, and groups with
a parent that was there all along are dropped as they are.  Of larger keys only
the groups that can hold an orphan at all are joined back to their references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions.names import filled, join_on, strip
from weft.session import cut

KEY = ["paper_name", "catalyst_id", "key"]
#: Stand-ins for absent times: a parent without a time was there from the start,
#: a child without a time sees everything.
FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 00:00:00"
#: Hash buckets of keys; rows of one key that a task takes; parts that the rows of larger keys are split into when they are joined.
BUCKETS, HOT_ROWS, PARTS = 65_536, 20_000, 64


def _ts(c: str, otherwise: str):
    return F.coalesce(F.col(c), F.lit(otherwise).cast("timestamp"))


def parent_keys(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "paper_name", "catalyst_id", strip("id").alias("key"), _ts("loaded_at", FIRST).alias("ts"),
        F.col("row_id").alias("rid"), F.coalesce(F.lower(strip("op")), F.lit("add")).alias("op"),
    ).where(filled(F.col("key")))


def child_keys(edges: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.lit("source").alias("side"), strip("source_id").alias("key")),
        F.struct(F.lit("target").alias("side"), strip("target_id").alias("key")),
    )
    return (
        edges.select("paper_name", "catalyst_id", "row_id", "loaded_at", _ts("loaded_at", LAST).alias("ts"), F.inline(ends))
        .where(filled(F.col("key")))
    )


def status_as_of(parents: DataFrame, moments: DataFrame) -> DataFrame:
    """Last ``op`` of each key at each of its distinct ``moments`` (key columns, ts).

    Two windows keep hot keys apart: one over the days of a key, of which there
    are few thousand at most, and one inside a single day of a key.
    """
    points = parents.groupBy(*KEY, "ts").agg(F.max_by("op", "rid").alias("op"))
    events = points.unionByName(moments.select(*KEY, "ts").distinct().withColumn("op", F.lit(None).cast("string")).withColumn("asked", F.lit(True)), allowMissingColumns=True)
    events = events.groupBy(*KEY, "ts").agg(F.max("op").alias("op"), F.max("asked").alias("asked")).withColumn("day", F.to_date("ts"))
    days = events.groupBy(*KEY, "day").agg(F.max_by("op", F.when(F.col("op").isNotNull(), F.col("ts"))).alias("day_op"))
    before = W.partitionBy(*KEY).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select(*KEY, "day", F.last("day_op", ignorenulls=True).over(before).alias("carried"))
    within = W.partitionBy(*KEY, "day").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    out = events.select(*KEY, "day", "ts", "asked", F.last("op", ignorenulls=True).over(within).alias("today")).where("asked")
    return join_on(out, days, [*KEY, "day"], "left").select(*KEY, "ts", F.coalesce("today", "carried").alias("op_then"))


def _by_groups(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Orphans among keys of any size: groups shrink to summaries before the shuffle, suspects are joined back."""
    tagged = parents.select(*KEY, F.lit(True).alias("is_parent"), "ts", (F.col("op") == "delete").alias("gone")).unionByName(
        children.select(*KEY, F.lit(False).alias("is_parent"), "ts", F.lit(False).alias("gone"))
    )
    groups = tagged.groupBy(*KEY).agg(
        F.max("is_parent").alias("has_parent"), F.max(~F.col("is_parent")).alias("has_child"), F.max("gone").alias("any_delete"),
        F.min(F.when(F.col("is_parent"), F.col("ts"))).alias("first_parent"), F.min(F.when(~F.col("is_parent"), F.col("ts"))).alias("first_child"),
    )
    suspect = groups.where("has_child and (not has_parent or any_delete or first_parent > first_child)").select(*KEY, "has_parent", "any_delete", "first_parent")
    # A key may hold a third of all rows: its children are spread over parts, each with a copy of the key's summary.
    part = F.pmod(F.xxhash64("row_id", "side"), F.lit(PARTS)).cast("int").alias("part")
    copies = suspect.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    judged = join_on(children.select("*", part), copies, [*KEY, "part"], "inner").drop("part")
    plain = judged.where("not has_parent or ts < first_parent").select(
        "row_id", "side", F.when(F.col("has_parent"), "late").otherwise("missing").alias("reason"), "loaded_at"
    )
    asked = judged.where("any_delete and ts >= first_parent")
    deleting = suspect.where("any_delete").select(*KEY)
    then = status_as_of(join_on(parents, deleting, KEY, "left_semi"), asked)
    then = then.where("op_then = 'delete'").select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    gone = join_on(asked.select("*", part), then, [*KEY, "ts", "part"], "left_semi").select("row_id", "side", F.lit("deleted").alias("reason"), "loaded_at")
    return plain.unionByName(gone)


def _in_groups(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Orphans among keys that fit a task: the tagged long form grouped by key; groups that can hold an orphan are opened again."""
    parent, child = F.struct("ts", "rid", "op"), F.struct("ts", "row_id", "side", "loaded_at")
    tagged = parents.select(*KEY, parent.alias("p")).unionByName(children.select(*KEY, child.alias("c")), allowMissingColumns=True)
    groups = tagged.groupBy(*KEY).agg(F.collect_list("p").alias("ps"), F.collect_list("c").alias("cs"))
    lacking = (F.size("ps") == 0) | F.exists("ps", lambda p: p["op"] == "delete") | (F.array_min("ps")["ts"] > F.array_min("cs")["ts"])

    def judged(c):
        seen = F.filter("ps", lambda p: p["ts"] <= c["ts"])
        reason = F.when(F.size("ps") == 0, "missing").when(F.size(seen) == 0, "late").when(F.array_max(seen)["op"] == "delete", "deleted")
        return F.struct(c["row_id"].alias("row_id"), c["side"].alias("side"), reason.alias("reason"), c["loaded_at"].alias("loaded_at"))

    ends = F.when((F.size("cs") > 0) & lacking, F.filter(F.transform("cs", judged), lambda x: x["reason"].isNotNull()))
    return groups.select(F.inline(ends))


def _bucket():
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS))


def orphan_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per edge row and end whose node does not exist at the edge's time.

    ``nodes``: row_id, paper_name, catalyst_id, id, op, loaded_at;
    ``edges``: row_id, paper_name, catalyst_id, source_id, target_id, loaded_at.
    Returns row_id, side, reason (``missing``, ``late``, ``deleted``), loaded_at.

    Null or blank ends are no reference; null tree columns compare equal to each
    other; a null node time means "always there", a null edge time "after all".
    Repeated rows count each; empty tables give no rows; other columns are ignored.
    Keys of about ``HOT_ROWS`` rows or more stand out from their hash bucket's
    share of all rows; their buckets take a way without whole groups in a task.
    The list of such buckets is bounded by ``BUCKETS``; results are the same.
    """
    parents, children = parent_keys(nodes), child_keys(edges)
    sizes = cut(parents.select(_bucket().alias("b")).unionByName(children.select(_bucket().alias("b"))).groupBy("b").count())
    limit = (sizes.agg(F.sum("count")).first()[0] or 0) / BUCKETS + HOT_ROWS / 2
    hot = [r["b"] for r in sizes.where(F.col("count") > limit).select("b").collect()]
    if not hot:
        return _in_groups(parents, children)
    is_hot = _bucket().isin(hot)
    return _in_groups(parents.where(~is_hot), children.where(~is_hot)).unionByName(_by_groups(parents.where(is_hot), children.where(is_hot)))


def orphans_by_period(orphans: DataFrame, parent_table: str, child_table: str) -> DataFrame:
    """Orphans per table, month of the child's load, side and reason."""
    return orphans.groupBy(
        F.lit(child_table).alias("child_table"), F.lit(parent_table).alias("parent_table"),
        F.date_format("loaded_at", "yyyy-MM").alias("month"), "side", "reason",
    ).agg(F.count("*").alias("n_orphans"))
