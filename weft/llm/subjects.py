"""Subject areas of documents (problem 10), by labelling functions and a latent accuracy model.

Labelling functions vote on each (document, subject) with a level: the lexicon
(share of statements with a term of the subject) together with the section
(paragraphs that treat it, or only passing mentions), which see the same terms;
the address (hosts of the web addresses in the text); and the source.  Hand labels
are one more, noisy function.  The model has one unknown truth per pair and, for
each function, the probabilities of its levels given that truth; expectation
maximisation learns them from the counts of vote patterns of all documents,
starting from the labelled ones.  Documents get the subjects of posterior
probability above one half.

Lexicon and passing frames - wording that stands where a subject is only mentioned
- are learned from documents with hand labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import cut

#: Documents with hand labels that lexicon and frames are learned from, at most.
MAX_LABELLED = 20_000
#: A term is kept if its log-likelihood score and the share of its documents in the subject reach these; the first time, when mentions in passing still count, a lower share does.
LEAST_SCORE, LEAST_SHARE, FIRST_SHARE, LEAST_DOCS, LONGEST = 8.0, 0.75, 0.5, 3, 4
#: Wording is a passing frame if it stands in so many statements and this share of them mentions subjects that the document isn't labelled with.
FRAME_TIMES, FRAME_SHARE, FRAME_SCORE = 4, 0.8, 6.0
SHARE_STEP, SHARE_LEVELS = 0.05, 11
MOST_SUBJECTS = 3
ROUNDS = 30
#: Entries of the tables that a task counts terms in.
HELD = 500_000
_TOKEN = re.compile(r"[぀-ヿ一-鿿]|[^\W\d_぀-ヿ一-鿿]+(?:-[^\W\d_぀-ヿ一-鿿]+)*")
_STATEMENT = re.compile(r"(?<=[.?!])\s+|(?<=[。！？])")
_HOST = re.compile(r"(?:https?://|www\.|doi\.org/|@)([\w.-]+\.[a-z]{2,})", re.I)


def hosts(statement: str) -> list[str]:
    """Hosts of the addresses in a statement, lower case; most statements have no mark of one and are not searched."""
    low = statement.lower()
    return _HOST.findall(low) if "@" in low or "http" in low or "www." in low or "doi.org/" in low else []


def paragraphs(text: str) -> list[list[str]]:
    """Statements of each paragraph."""
    return [s for p in re.split(r"\n\s*\n", text) if (s := [x for x in _STATEMENT.split(p.replace("\n", " ")) if x.strip()])]


def terms(statement: str) -> set[str]:
    """Runs of one to ``LONGEST`` words (or Chinese characters), lower case; hosts of addresses as ``@host``."""
    w = _TOKEN.findall(statement.casefold())
    out = {" ".join(w[j : j + n]) for n in range(1, LONGEST + 1) for j in range(len(w) - n + 1)}
    return out | {"@" + h for h in hosts(statement)}


def level(treat: int, n: int) -> int:
    """Level of the lexicon's share of statements: ``treat`` of ``n``."""
    return min(SHARE_LEVELS - 1, math.ceil(treat / n / SHARE_STEP - 0.5)) if treat else 0


class Reader:
    """Finds the terms of a lexicon and passing frames in statements, all at once."""

    def __init__(self, lexicon: dict[str, str], frames: set[str]):
        import ahocorasick

        self.hosts = {t[1:]: s for t, s in lexicon.items() if t[0] == "@"}
        self.finder = ahocorasick.Automaton()
        for t, s in lexicon.items():
            if t[0] != "@":
                self.finder.add_word(f" {t} ", s)
        for t in frames:
            self.finder.add_word(f" {t} ", None)
        self.any = len(self.finder) > 0
        if self.any:
            self.finder.make_automaton()

    def read(self, statement: str) -> tuple[set[str], bool, list[str]]:
        """Subjects with a term in the statement, whether it only mentions them, and the subjects of addresses in it."""
        found, passing = set(), False
        if self.any:
            for _, s in self.finder.iter(f" {' '.join(_TOKEN.findall(statement.casefold()))} "):
                if s is None:
                    passing = True
                else:
                    found.add(s)
        addr = [self.hosts[h] for h in set(hosts(statement)) if h in self.hosts] if self.hosts else []
        return found.union(addr), passing, addr


def _totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term", "subject").agg(F.sum("n").alias("n"))


def _frames(held: dict[str, Counter]) -> Iterator[pd.DataFrame]:
    for subject, counts in held.items():
        yield pd.DataFrame({"subject": subject, "term": list(counts), "n": list(counts.values())})


def _count(docs: DataFrame, each) -> DataFrame:
    """Counts by term and subject: term, subject, n. ``each`` gives (subject, terms) of a text and its subjects; tasks count in tables of about ``HELD`` entries."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for b in batches:
            for text, subjects in zip(b["text"], b["subjects"], strict=True):
                for s, found in each(text, list(subjects)):
                    held.setdefault(s, Counter()).update(found)
                if sum(map(len, held.values())) > HELD:
                    yield from _frames(held)
                    held = {}
        yield from _frames(held)

    return _totals(docs.mapInPandas(count, "subject string, term string, n bigint"))


def _lexicon(docs: DataFrame, shared, share: float) -> dict[str, str]:
    """Terms that stand for one subject among labelled documents. ``shared`` holds the passing frames so far; their statements don't count."""

    def each(text: str, subjects: list[str]):
        own, reader = {""}, shared.value
        for p in paragraphs(text):
            for s in p:
                if not reader.read(s)[1]:
                    own |= terms(s)
        return [(s, own) for s in ("", *subjects)]

    of = F.collect_list(F.when(F.col("subject") != "", F.struct("subject", F.col("n").alias("k"))))
    per = _count(docs, each).groupBy("term").agg(F.sum(F.when(F.col("subject") == "", F.col("n"))).alias("df"), of.alias("each"))
    size = F.col("term") == ""
    kept = cut(per.where(size | (F.col("df") >= LEAST_DOCS)).select("term", "df", F.inline(F.filter("each", lambda x: size | ((x["k"] >= LEAST_DOCS) & (x["k"] >= share * F.col("df")))))))
    sizes = kept.where(size).collect()
    if not sizes:
        return {}
    weight = F.create_map(*[F.lit(x) for r in sizes for x in (r["subject"], math.log(r["df"] / r["k"]))])
    scored = kept.where(~size).withColumn("score", F.col("k") * (F.ln(F.col("k") / F.col("df")) + F.element_at(weight, F.col("subject")))).where(F.col("score") >= LEAST_SCORE)
    # Bounded by the sample: a term stands in LEAST_DOCS of at most MAX_LABELLED documents.
    return {r["term"]: r["subject"] for r in scored.groupBy("term").agg(F.max_by("subject", F.struct("score", "subject")).alias("subject")).collect()}


def _passing(docs: DataFrame, lexicon: dict[str, str]) -> set[str]:
    """Wording of statements whose terms stand for subjects that the document isn't labelled with."""
    shared = docs.sparkSession.sparkContext.broadcast(Lazy(lexicon, set()))

    def each(text: str, subjects: list[str]):
        out = []
        for p in paragraphs(text):
            for s in p:
                found, _, _ = shared.value.read(s)
                if found:
                    own = {t for t in terms(s) if t not in lexicon and t[0] != "@"} | {""}
                    out.append(("treats" if found & set(subjects) else "mentions", own))
        return out

    per = _count(docs, each).groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("subject") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("treats", "mentions")])
    per = cut(per)
    size = per.where("term = ''").first()
    if size is None or not size["mentions"]:
        return set()
    n, p = F.col("treats") + F.col("mentions"), size["mentions"] / (size["treats"] + size["mentions"])
    share = F.col("mentions") / n
    score = F.col("mentions") * (F.ln(share) - math.log(p)) + F.when(F.col("treats") > 0, F.col("treats") * (F.ln(1 - share) - math.log(max(1 - p, 1e-9)))).otherwise(0.0)
    return {r["term"] for r in per.where((F.col("term") != "") & (n >= FRAME_TIMES) & (share >= FRAME_SHARE)).where(score >= FRAME_SCORE).select("term").collect()}


class Lazy:
    """A reader that each task builds for itself when it first reads."""

    def __init__(self, lexicon: dict[str, str], frames: set[str]):
        self.args, self.reader = (lexicon, frames), None

    def __getstate__(self):
        return self.args

    def __setstate__(self, args):
        self.args, self.reader = args, None

    def read(self, statement: str) -> tuple[set[str], bool, list[str]]:
        if self.reader is None:
            self.reader = Reader(*self.args)
        return self.reader.read(statement)


def learn(documents: DataFrame, labels: DataFrame) -> tuple[dict[str, str], set[str]]:
    """Terms that stand for one subject, and passing frames, from at most ``MAX_LABELLED`` documents with hand labels (those of smallest hash).

    First the terms, with mentions in passing among them; then the frames of
    those mentions; then the terms without them; then both once more.
    """
    marks = labels.where("subject is not null and doc_id is not null").select("doc_id", "subject").distinct()
    chosen = marks.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("doc_id"), F.col("doc_id")).limit(MAX_LABELLED)
    # Only the sample's texts are moved.
    docs = documents.where(F.length("text") > 0).select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    docs = cut(docs.select("text", "subjects").repartition(docs.sparkSession.sparkContext.defaultParallelism))
    send = docs.sparkSession.sparkContext.broadcast
    lexicon = _lexicon(docs, send(Lazy({}, set())), FIRST_SHARE)
    frames: set[str] = set()
    for _ in range(2):
        frames = _passing(docs, lexicon)
        lexicon = _lexicon(docs, send(Lazy({}, frames)), LEAST_SHARE)
    return lexicon, frames


def count_statements(text: str, reader) -> dict[str, tuple[int, int, int, int, int]]:
    """Per subject: statements that treat it, passing mentions, paragraphs that treat it, addresses; and all statements."""
    treat, passing, paras, addr, n = Counter(), Counter(), Counter(), Counter(), 0
    for p in paragraphs(text):
        here = set()
        for s in p:
            n += 1
            found, mentions, hosts = reader.read(s)
            if found:
                addr.update(hosts)
                if mentions:
                    passing.update(found)
                else:
                    treat.update(found)
                    here |= found
        paras.update(here)
    return {s: (treat[s], passing[s], paras[s], addr[s], n) for s in treat.keys() | passing.keys()}


def votes(documents: DataFrame, lexicon: dict[str, str], frames: set[str]) -> DataFrame:
    """Levels of the functions on the text, for pairs with any mention: doc_id, source, subject, lex, sec, adr."""
    shared = documents.sparkSession.sparkContext.broadcast(Lazy(lexicon, frames))
    schema = "doc_id bigint, source string, subject string, lex int, sec int, adr int"

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t, src in zip(b["doc_id"], b["text"], b["source"], strict=True):
                for s, (treat, _, paras, addr, n) in count_statements(t, shared.value).items():
                    rows.append((d, src, s, level(treat, n), min(paras, 3) if treat else 4, min(addr, 2)))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "source", "subject", "lex", "sec", "adr"])

    base = documents.where(F.length("text") > 0).select("doc_id", "text", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"))
    return base.mapInPandas(vote, schema)


LEVELS = {"lex": SHARE_LEVELS, "sec": 5, "adr": 3, "src": 4, "hand": 3}


def learn_accuracies(patterns: pd.DataFrame) -> pd.DataFrame:
    """Posterior probability of each vote pattern, by expectation maximisation.

    ``patterns``: a column per function and n.  Level 0 of ``hand`` is no label,
    1 labelled otherwise, 2 labelled so.  The start takes hand labels as truth;
    where there are none, shares of a quarter or more.
    """
    w = patterns["n"].to_numpy("float64")
    hand, lex = patterns["hand"].to_numpy(), patterns["lex"].to_numpy()
    start = 1 / (1 + np.exp(-(lex * SHARE_STEP - 0.2) * 40))
    post = np.where(hand == 2, 0.95, np.where(hand == 1, 0.05, start))
    # Lexicon and section see the same terms, so they are one function of joint levels.
    patterns = patterns.assign(text=patterns["lex"] * LEVELS["sec"] + patterns["sec"])
    levels = {"text": LEVELS["lex"] * LEVELS["sec"], **{f: k for f, k in LEVELS.items() if f not in ("lex", "sec")}}
    # Labelled and unlabelled documents weigh the same in all, so that the many can't carry the truth away from the few.
    marked = hand > 0
    if marked.any() and not marked.all():
        w = w * np.where(marked, w[~marked].sum() / w[marked].sum(), 1.0)
    for step in range(ROUNDS):
        # Labelled patterns alone set the levels first, if there are enough of them.
        use = w * (hand > 0) if step == 0 and (w * (hand > 0)).sum() > 200 else w
        prior = (use * post).sum() / max(use.sum(), 1e-9)
        log = np.log(prior / (1 - prior)) * np.ones(len(w))
        for f in levels:
            v = patterns[f].to_numpy()
            yes = np.bincount(v, use * post, levels[f]) + 0.5
            no = np.bincount(v, use * (1 - post), levels[f]) + 0.5
            if f == "hand":
                # No label says nothing: labelled documents are a sample.
                yes[0], no[0] = yes.sum(), no.sum()
                gain = np.log(yes / yes[1:].sum()) - np.log(no / no[1:].sum())
                gain[0] = 0.0
            else:
                gain = np.log(yes / yes.sum()) - np.log(no / no.sum())
            log = log + gain[v]
        post = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
    return patterns[list(LEVELS)].assign(probability=post)


def assign(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Subjects of documents with their posterior probability: doc_id, subject, probability, labelled.

    ``documents``: doc_id, text, source; ``labels``: doc_id, subject.  At most
    ``MOST_SUBJECTS`` per document, the most probable first.  Null or empty texts
    and documents without a term get none; repeated rows of a doc_id are one
    document; without any labels the lexicon is empty and nothing is assigned.
    """
    found = cut(votes(documents, *learn(documents, labels))).dropDuplicates(["doc_id", "subject"])
    marks = labels.where("subject is not null").select("doc_id", "subject").distinct()
    any_mark = marks.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    found = found.join(any_mark, "doc_id", "left")
    # How a source leans: its share of a subject's labelled documents against its share of all, in three levels.
    # Sources are few; the table has a row per source and subject.
    lean = found.where("subjects is not null").groupBy("source", "subject").agg(F.count("*").alias("all"), F.sum(F.array_contains("subjects", F.col("subject")).cast("int")).alias("so"))
    rate = lean.groupBy("subject").agg((F.sum("so") / F.sum("all")).alias("rate"))
    lean = lean.join(rate, "subject").select("source", "subject", F.when(F.col("all") < 20, 0).when(F.col("so") / F.col("all") < 0.7 * F.col("rate"), 1).when(F.col("so") / F.col("all") > 1.3 * F.col("rate"), 3).otherwise(2).alias("src"))
    found = found.join(lean, ["source", "subject"], "left").withColumn("src", F.coalesce("src", F.lit(0)))
    hand = F.when(F.col("subjects").isNull(), 0).when(F.array_contains("subjects", F.col("subject")), 2).otherwise(1)
    found = found.withColumn("hand", hand)
    # Patterns are bounded by the product of the levels.
    patterns = found.groupBy(*LEVELS).agg(F.count("*").alias("n")).toPandas()
    if not len(patterns):
        return found.select("doc_id", "subject", F.lit(0.0).alias("probability"), F.lit(False).alias("labelled"))
    learned = documents.sparkSession.createDataFrame(learn_accuracies(patterns))
    rated = found.join(F.broadcast(learned), list(LEVELS)).where("probability > 0.5")
    top = rated.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("probability", "subject")), asc=False), 1, MOST_SUBJECTS).alias("top"), F.max(F.col("subjects").isNotNull()).alias("labelled"))
    return top.select("doc_id", F.inline("top"), "labelled").select("doc_id", "subject", "probability", "labelled")
