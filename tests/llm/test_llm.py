"""Text problems against brute force, round trips and held-out accuracy; corner cases."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import confusables as C
from weft.llm import leakage as K
from weft.llm import materials as M
from weft.llm import mixing as X
from weft.llm import scans as S
from weft.llm import subjects as J
from weft.session import table

# --- look-alikes -----------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "clean"), [
    ("СuО", "CuO"), ("Аѕ to", "As to"), ("промежуточный порошок 27", None), ("NiCΟ3", "NiCO3"), ("γ-phase α-Al2O3", None), ("ﬁlter", "filter"), ("Rückstand", "Rückstand"),
    ("Rückstand", None), ("Pd(OH)₂ 5–6 m²", None), ("a​b c", "ab c"), ("half‑cell", "half-cell"), ("Ｋ２", "K2"), ("粉末，干燥。", None), ("", None), ("μm", None), ("сор порошок", None),
    ("type Ⅳ", "type IV"), ("ⅰ", "i"), ("fսel", "fuel"), ("ᎪᏚᎢ", "AST"), ("ɑlumina", "alumina"), ("ᴄobalt", "cobalt"), ("nıckel", "nickel"), ("a\ufe0fb", "ab"), ("a\u3164b", "ab"), ("a\u2028b", "a b"), ("a\u3000b", "a b"), ("粉末\u3000干燥", None),
    ("ꓮꓐ", "AB"), ("𝐂𝐮", "Cu"), ("x²₃①", None), ("−40 °C … ½", None), ("Ԛuartz", "Quartz"), ("հայերեն սա", None),
])
def test_consistent(text, clean):
    assert C.consistent(text) == (text if clean is None else clean)


def test_round_trip():
    rng = random.Random(3)
    back = {v: k for k, v in (C.CYRILLIC | C.GREEK).items() if v.isalpha() and k not in 'ӏѵүϳϲ'}
    for word in ("phosphate", "Catalyst", "zeolite", "copper oxide", "Sample"):
        noisy = "".join(back.get(c, c) if rng.random() < 0.4 else c for c in word)
        assert C.skeleton(noisy) == C.skeleton(word)
        assert C.consistent(noisy[:-1] + word[-1]) == word


def test_touched(spark):
    df = spark.createDataFrame([(1, "plain"), (2, None), (3, ""), (4, "oхide"), (5, "Größe"), (6, "x" * 100_000 + " y"), (4, "oхide")], "row_id long, name string")
    assert sorted(r.row_id for r in C.touched(df, "name", "row_id").collect()) == [4, 4, 6]
    both = {r.row_id: (r.clean, r.touched) for r in C.unify(df.withColumn("clean", F.lit("clash")), "name").collect()}
    assert both[4] == ("oxide", True) and both[5] == ("Größe", False) and both[2] == (None, False)
    g = C.look_alikes(df.unionByName(df.limit(0)).unionByName(spark.createDataFrame([(9, "oxide")], "row_id long, name string")), "name").collect()
    assert [(r.n_rows, r.n_forms, r.form) for r in g] == [(3, 2, "oxide")]
    assert C.touched(df.limit(0), "name", "row_id").count() == 0


# --- names -----------------------------------------------------------------------------------------

NAMES = {
    "copper oxide": 1, "Coppper Oxide": 1, "oxide, copper": 1, "Cu-oxide": 1, "CuO*3H2O": 1, "Kupferoxid": 1, "copper(II) oxide": 1, "copper(I) oxide": None, "氧化铜粉末": 1, "aqueous copper oxide": 1,
    "copper oxid.": 1, "oxide of copper": 1, "coppеr oxide (99 %)": 1, "copper oxide, lot 12": 1, "cpoper oixde": 1, "copper citrate": None, "indium fluoride": None, "sodium fluoride": 218,
    "ZrO2": 2, "zirconia": 2, "zirconium(IV) oxide": 2, "Paste K28-11": None, "BaSO4": None, "zeolite β": 109, "urea prills": 52, "": None, "  ": None, "x" * 5000: None, "manganese sulphate": 4, "nitric acid solution": 184,
}


def test_names(spark, small):
    rows = [(k, n, "chemical", "clash") for k, n in enumerate(NAMES)] + [(1000, None, "chemical", ""), (1001, "copper oxide", "synthesis", "")]
    nodes = spark.createDataFrame(rows, "row_id long, name string, type string, alias string")
    got = {r.name: r.material_id for r in M.map_names(nodes, table(spark, small, "material_ref")).collect()}
    assert got == NAMES
    assert M.map_names(nodes.limit(0), table(spark, small, "material_ref")).count() == 0


def test_pigeonhole_misses_nothing(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(5)
    aliases = ["copper oxide", "urea", "kaolin", "lanthanum phosphate", "teos", "zinc"]
    words = list(aliases)
    for _ in range(300):
        w = list(rng.choice(aliases))
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "a", "xy", "o"])
        words.append("".join(w))
    words = sorted(set(words) - {""})
    allowed = lambda n: 0 if n < 4 else 1 if n < 6 else min(M.MAX_EDITS, n // 3)
    want = {(w, a, edits(w, a)) for w in words for a in aliases if edits(w, a) <= allowed(len(a)) and allowed(len(a))}
    got = M.near(spark.createDataFrame([(w,) for w in words], "variant string"), spark.createDataFrame([(a, "name") for a in aliases], "alias string, kind string"))
    assert {tuple(r) for r in got.select("variant", "alias", "edits").collect()} == want


# --- scans -----------------------------------------------------------------------------------------


def test_scan_held_out(spark, small):
    """Clean lines of the data, broken on purpose in known ways, are found again."""
    texts = table(spark, "/root/testdata/sf0.01", "paper_text").select("text_id", "full_text")
    rng, planted, rows = random.Random(1), set(), []
    for r in texts.where("full_text is not null").limit(360).collect():
        lines = r.full_text.split("\n")
        for k, x in enumerate(lines):
            words = [w for w in ("temperature", "reference", "together", "measured", "evaporation") if f" {w} " in x]
            if words and rng.random() < 0.03:
                lines[k] = x.replace(words[0], words[0].replace("e", "c", 1), 1)
                planted.add((r.text_id, k + 1))
        rows.append((r.text_id, "\n".join(lines)))
    got = S.noisy_lines(spark.createDataFrame(rows, "text_id long, full_text string")).where("kind = 'misread'").collect()
    hit = {(r.text_id, r.line_no) for r in got} & planted
    assert len(planted) > 20 and len(hit) >= 0.9 * len(planted)


def test_scan_corners(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (4, "- 12 -"), (5, "word " * 50_000)], "text_id long, full_text string")
    assert {tuple(r) for r in S.noisy_lines(df).collect()} == {(4, 1, "page")}
    assert S.noisy_lines(df.limit(0)).count() == 0


def _told(spark, words):
    """Decisions over a corpus of given words: text_id is the word's number, a word a line."""
    texts = spark.createDataFrame([(i, "\n".join([w] * n)) for i, (w, n) in enumerate(words)], "text_id long, full_text string")
    survey = S._surveyed(texts)
    return {r["item"]: r["meant"] for r in S.decisions(survey).collect()}


STEMS = ("reference", "temperature", "precipitate", "concentrate", "regenerate", "treatment", "selective", "determine", "sediment", "element")


def test_editor_is_no_count_rule(spark):
    """Rare words that look like frequent ones stay if no confusion of the corpus explains them, and frequent ones stay whatever stands near."""
    words = [(w, 200) for w in STEMS] + [(w.replace("e", "c", 1), 1) for w in STEMS] + [("calcined", 400), ("calcines", 60), ("xylene", 300), ("xylenc", 80)]
    told = _told(spark, words)
    assert {w.replace("e", "c", 1): w for w in STEMS}.items() <= told.items()
    assert "calcines" not in told and "xylenc" not in told


def test_joins_are_decided(spark):
    text = "\n".join(["the impregnation of a steady-state support was measured"] * 60 + ["so the impreg-", "nation went on", "in a steady-", "state support"] * 20)
    told = {r["item"] for r in S.decisions(S._surveyed(spark.createDataFrame([(1, text)], "text_id long, full_text string"))).collect()}
    assert S.pair_item("impreg-", "nation") in told and S.pair_item("steady-", "state") not in told


def test_scan_decisions_by_join_are_the_same(spark, monkeypatch):
    texts = table(spark, "/root/testdata/sf0.001", "paper_text").select("text_id", "full_text")
    sent = {tuple(r) for r in S.noisy_lines(texts).collect()}
    clean = {tuple(r) for r in S.repaired(texts.where("text_id % 3 = 0")).collect()}
    monkeypatch.setattr(S, "DECISIONS", 0)
    assert {tuple(r) for r in S.noisy_lines(texts).collect()} == sent
    assert {tuple(r) for r in S.repaired(texts.where("text_id % 3 = 0")).collect()} == clean


CONFUSED = {"e": "c", "l": "1", "o": "0", "i": "l", "n": "u"}


def test_scan_held_out_by_kind(spark):
    """Random words of clean texts, misread in several ways, are found again, in each way."""
    import re

    texts = table(spark, "/root/testdata/sf0.01", "paper_text").select("text_id", "full_text").where("full_text is not null and lang = 'en'").orderBy("text_id").collect()
    rng, planted, rows, often = random.Random(2), {k: set() for k in CONFUSED}, [], {}
    for r in texts:
        for w in re.findall(r"\b[a-z]{6,}\b", r.full_text):
            often[w] = often.get(w, 0) + 1
    for r in texts:
        lines = r.full_text.split("\n")
        for k, x in enumerate(lines):
            kind = rng.choice(sorted(CONFUSED))
            inner = [m.group() for m in re.finditer(r"(?<= )[a-z]{6,}(?= )", x) if kind in m.group()[1:-1] and often.get(m.group(), 0) >= 40]
            if inner and not S._TABLE.search(x) and rng.random() < 0.1:
                w = rng.choice(inner)
                lines[k] = x.replace(f" {w} ", f" {w[0] + w[1:].replace(kind, CONFUSED[kind], 1)} ", 1)
                planted[kind].add((r.text_id, k + 1))
        rows.append((r.text_id, "\n".join(lines)))
    got = {(r.text_id, r.line_no) for r in S.noisy_lines(spark.createDataFrame(rows, "text_id long, full_text string")).where("kind = 'misread'").collect()}
    for cases in planted.values():
        assert len(cases) > 10 and len(got & cases) >= 0.9 * len(cases)


# --- leakage ---------------------------------------------------------------------------------------

ITEM = "Explain why the damp droplet softens an amber ferrule whenever the isotherm beside the layered furnace mirrors its hopper. Which column seeds the viscous pump?"


@pytest.mark.parametrize(("text", "leaks"), [
    (ITEM, True), (ITEM.upper().replace(" ", "\n"), True), (ITEM.replace("amber", "[12] green").replace("mirrors", "mirrors<sup>4</sup>"), True), ("before " + " ".join(ITEM.split()[3:15]) + " after", True),
    (" ".join(ITEM.split()[3:13]), False), (" ".join(reversed(ITEM.split())), False), (" ".join(w if k % 3 else "other" for k, w in enumerate(ITEM.split())), False), ("", False), ("x " * 20_000, False),
])
def test_leak(text, leaks):
    assert any(span for _, span, _ in K.Items([(1, ITEM)]).passages(text)) == leaks


HAN = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄宇宙洪荒"


@pytest.mark.parametrize(("length", "changed", "leaks"), [(20, (6, 13), True), (21, (5, 12), True), (23, (8, 15), True), (27, (6, 13, 20), True), (20, (5, 10, 15), False), (19, (9,), False)])
def test_leak_of_changed_characters(length, changed, leaks):
    text = "".join("某" if k in changed else c for k, c in enumerate(HAN[:length]))
    assert bool(K.Items([(1, HAN)]).passages(text)) == leaks


def test_skip_loses_no_passage(monkeypatch):
    rng, items = random.Random(5), K.Items([(1, HAN), (2, ITEM)])
    texts = []
    for _ in range(2000):
        whole, join = rng.choice([(list(HAN), ""), (ITEM.split(), " ")])
        part = whole[(a := rng.randrange(len(whole) - 11)) : a + rng.randint(12, 30)]
        for k in rng.sample(range(len(part)), rng.randint(0, min(3, len(part)))):
            part[k] = "某" if join == "" else "other"
        texts.append(join.join(part))
    got = [items.passages(t) for t in texts]
    monkeypatch.setattr(K, "least_hits", lambda least: 0)
    assert got == [items.passages(t) for t in texts] and 0 < sum(map(bool, got)) < len(got)


def test_leak_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a " + ITEM), (2, None), (3, ""), (1, "a " + ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "")] + [(k, f"word{k}") for k in range(20, 30)], "item_id long, text string")
    for sent in (K.SENT_TOKENS, 0):
        monkeypatch.setattr(K, "SENT_TOKENS", sent)
        assert {(r.doc_id, r.item_id) for r in K.leaks(docs, items).collect()} == {(1, 7)}
        assert K.leaks(docs, items.limit(0)).count() == 0 and K.leaks(docs.limit(0), items).count() == 0


def test_leaks_by_join_are_the_same(spark, small, monkeypatch):
    docs, items = table(spark, small, "documents"), table(spark, small, "eval_items")
    sent = {tuple(r) for r in K.leaks(docs, items).collect()}
    monkeypatch.setattr(K, "SENT_TOKENS", 0)
    monkeypatch.setattr(K, "FILTER_BITS", 1 << 14)
    assert {tuple(r) for r in K.leaks(docs, items).collect()} == sent and sent


WORDS48 = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(48)]


@pytest.mark.parametrize("size", [6, 8, 10])
def test_tiles_in_other_order_are_covered(size):
    parts = [WORDS48[k : k + size] for k in range(0, 48, size)]
    (_, span, covered), = K.Items([(1, " ".join(WORDS48))]).passages(" ".join(w for p in reversed(parts) for w in p))
    assert span == 0 and covered >= 45
    assert not K.Items([(1, " ".join(WORDS48))]).passages(" ".join(w for p in reversed(parts[:2]) for w in p))


def test_what_a_mark_leaves_free_is_a_tile():
    item = WORDS48[:30]
    (_, _, covered), = K.Items([(1, " ".join(item))]).passages(" ".join(item[:20] + ["between"] * 5 + item[14:]))
    assert covered == 30


def test_reordered_sentences_are_covered():
    a, b = ITEM.split(". ")
    (_, span, covered), = K.Items([(1, ITEM)]).passages(b + " " + a)
    assert span == 18 or covered >= 22


# --- mixing ----------------------------------------------------------------------------------------


def test_share_out():
    parts, left = X.share_out(100, {"a": 0, "b": 0, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000})
    assert parts == {"a": 10, "b": pytest.approx(54), "c": pytest.approx(36)} and left == 0
    assert X.share_out(100, {"a": 0}, {"a": 1}, {"a": 30}) == ({"a": 30}, 70)


def test_domains_share_before_ancestors():
    targets = {"a": (0.3, 1, "D"), "b": (0.3, 9, "D"), "c": (0.4, 9, "E"), "d": (0.0, 1, None)}
    leaves = [{"source": "a", "lang": "x", "tokens": 10}, {"source": "b", "lang": "x", "tokens": 100}, {"source": "b", "lang": "y", "tokens": 100}, {"source": "c", "lang": "x", "tokens": 100}]
    # a lacks 20 of its 30, which b, its sibling, gives; c keeps its share.
    got, left = X.budgets(leaves, targets, 100)
    assert got == {("a", "x"): pytest.approx(10), ("b", "x"): pytest.approx(25), ("b", "y"): pytest.approx(25), ("c", "x"): pytest.approx(40)} and left == 0
    # The whole domain D can't give its part: the rest goes to E, and what nobody has is reported.
    got, left = X.budgets(leaves[:1] + leaves[3:], {"a": (0.6, 1, "D"), "c": (0.4, 2, "E")}, 300)
    assert got == {("a", "x"): pytest.approx(10), ("c", "x"): pytest.approx(200)} and left == pytest.approx(90)


def test_mixture(spark, small):
    docs, targets = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, small, "mix_targets")
    drawn, report = X.draw(docs, targets)
    most = {r.source: r for r in targets.collect()}
    rows = drawn.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(1 <= r.n_times <= most[r.source].max_repeats for r in rows)
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == set(most) and rep["standard"].tokens_drawn == 0
    longest = max(r.n_tokens for r in rows)
    total = sum(r.tokens_drawn for r in rep.values())
    for s, r in rep.items():
        if r.tokens_held:
            want = r.target_share / 0.99
            assert abs(r.actual_share - want) * total <= 12 * longest
            assert r.tokens_drawn <= r.tokens_held * r.max_repeats
    again = {(r.doc_id, r.n_times) for r in X.draw(docs, targets)[0].collect()}
    assert again == {(r.doc_id, r.n_times) for r in rows}
    assert X.draw(docs.limit(0), targets)[0].count() == 0


# --- subjects --------------------------------------------------------------------------------------


def test_subjects_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "subject_labels")
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = {(r.doc_id, r.subject) for r in J.assign(docs, labels.where(~hidden)).join(labels.where(hidden).select("doc_id").distinct(), "doc_id", "left_semi").collect()}
    want = {(r.doc_id, r.subject) for r in labels.where(hidden).collect()}
    # Some hand labels are wrong, so neither can reach 1.
    assert len(got & want) >= 0.85 * len(got) and len(got & want) >= 0.8 * len(want)


def test_passing_frames_are_learned(spark):
    """Statements that only mention a subject are told by wording that the labels give away, whatever the language."""
    rng, rows, marks = random.Random(4), [], []
    own = {"cells": "ribosome", "machines": "turbine", "law": "statute", "sport": "goalkeeper", "music": "cello", "food": "noodle"}
    for k in range(480):
        s, other = rng.sample(sorted(own), 2)
        rows.append((k, f"The {own[s]} number {k} was seen. A {own[s]} again, of sort {k % 7}." + (f" Vom {own[other]} ist hier nur am Rande zu lesen." if k % 5 < 2 else "")))
        marks.append((k, s))
    lexicon, frames = J.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, subject string"))
    assert all(lexicon.get(t) == s for s, t in own.items())
    assert any("am rande" in f for f in frames) and not any("again" in f for f in frames)
    held = J.count_statements("Der turbine nur am Rande zu lesen. Ribosome here.", J.Reader(lexicon, frames))
    assert held["cells"][:2] == (1, 0) and held["machines"][:2] == (0, 1)


def test_the_sample_of_labels_is_bounded(spark, monkeypatch):
    rows = [(k, f"A {'turbine' if k % 2 else 'ribosome'} number {k}.") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, "machines" if k % 2 else "cells") for k in range(60)], "doc_id long, subject string")
    full = J.learn(docs, labels)
    monkeypatch.setattr(J, "HELD", 5)
    assert J.learn(docs, labels) == full
    monkeypatch.setattr(J, "MAX_LABELLED", 2)
    assert J.learn(docs, labels) == ({}, set())


def test_subject_corners(spark):
    docs = spark.createDataFrame([(1, None, "journal"), (2, "", None), (3, "Text.", "x")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(3, "a"), (3, None), (9, "b")], "doc_id long, subject string")
    assert J.assign(docs, labels).count() == 0 and J.assign(docs.limit(0), labels.limit(0)).count() == 0


def test_accuracies_follow_the_labels():
    import pandas as pd

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    lex = np.where(truth, rng.integers(4, 11, 4000), rng.integers(0, 5, 4000))
    rows = pd.DataFrame({"lex": lex, "sec": np.where(truth, 2, 1), "adr": 0, "src": 0, "hand": np.where(rng.random(4000) < 0.1, np.where(truth, 2, 1), 0)})
    p = J.learn_accuracies(rows.groupby(list(rows.columns)).size().reset_index(name="n"))
    assert p[(p.lex >= 6) & (p.hand == 0)].probability.min() > 0.9 and p[(p.lex <= 1) & (p.hand == 0)].probability.max() < 0.1


def test_normal_forms_are_stable():
    for w in ("pâte mère", "Größe", "промежуточный"):
        assert C.consistent(unicodedata.normalize("NFD", w)) == w
