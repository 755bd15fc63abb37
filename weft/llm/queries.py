"""Queries of the text problems: 2, 3, 4, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.llm import confusables, leakage, materials, mixing, scans, subjects
from weft.session import table


def p2_found(spark, d):
    found = materials.map_names(table(spark, d, "tree_nodes"), table(spark, d, "material_ref"))
    return found.where("material_id is not null and not exact").select("row_id", "material_id")


def p2_unmatched(spark, d):
    """Names without an entry and how many rows carry them."""
    found = materials.map_names(table(spark, d, "tree_nodes"), table(spark, d, "material_ref"))
    return found.where("material_id is null").groupBy("name").agg(F.count("*").alias("n_rows"))


def p3_found(spark, d):
    names = confusables.touched(table(spark, d, "tree_nodes"), "name", "row_id")
    texts = confusables.touched(table(spark, d, "paper_text"), "full_text", "text_id")
    return names.select(F.lit("tree_nodes").alias("table_name"), F.col("row_id").alias("row_key")).unionByName(
        texts.select(F.lit("paper_text").alias("table_name"), F.col("text_id").alias("row_key")))


def p3_names(spark, d):
    """Every name in its consistent form."""
    return confusables.unify(table(spark, d, "tree_nodes").select("row_id", "name"), "name").select("row_id", "clean", "touched")


def p3_groups(spark, d):
    """Names that look the same but are stored with different characters."""
    return confusables.look_alikes(table(spark, d, "tree_nodes"), "name")


def p4_found(spark, d):
    return scans.noisy_lines(table(spark, d, "paper_text"))


def p4_repaired(spark, d):
    """Texts as continuous paragraphs."""
    return scans.repaired(table(spark, d, "paper_text"))


def _leaks(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark, d):
    return _leaks(spark, d).where("passage > 0").select("doc_id", "item_id").distinct()


def p8_items(spark, d):
    """How far each item leaked."""
    return leakage.leaked_items(_leaks(spark, d), table(spark, d, "eval_items"))


def _subjects(spark, d):
    return subjects.assign(table(spark, d, "documents"), table(spark, d, "subject_labels"))


def p10_found(spark, d):
    return _subjects(spark, d).where("not labelled").select("doc_id", "subject")


def p10_composition(spark, d):
    """Documents and mean probability of each subject over the whole corpus."""
    per = _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("n_documents"), F.round(F.avg("probability"), 4).alias("mean_probability"))
    return table(spark, d, "subject_ref").select("subject", "title").join(per, "subject", "left").fillna(0, ["n_documents"])


def p9_mix(spark, d):
    """The mixture: drawn documents and how often."""
    return mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark, d):
    """Shares reached, by source."""
    return mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


QUERIES = {f.__name__: f for f in (p2_found, p2_unmatched, p3_found, p3_names, p3_groups, p4_found, p4_repaired, p8_found, p8_items, p9_mix, p9_report, p10_found, p10_composition)}
ORACLE = {}
