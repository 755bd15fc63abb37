"""Noise of page scans (problem 4): furniture, broken words and misread characters.

An averaged perceptron decides everything that is a choice.  As a character editor
it gives each place of a word one of the operations keep, replace, delete, insert
and, at a line end, join; a second set of weights tells running headers from body
lines by their positions on the pages.  Both are trained on the corpus itself.

Texts are read twice.  The first pass counts words, Chinese contexts, broken words
and lines by page position.  All that is mined from these counts - confusions,
candidates, decisions - is a table over distinct words, made by joins; nothing
of it is cut off.  The second pass reads the texts with the decisions at hand.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.confusables import consistent, suspicious
from weft.session import cut

#: A word is known from so many occurrences on; noise makes frequent words at least so many times rarer.
KNOWN, RARER = 5, 12
#: A confusion counts if it makes this many different frequent words into rare ones.
LEAST_WORDS = 4
#: Examples that each set of weights is fitted on, at most; passes over them; seed.
EXAMPLES, EPOCHS, SEED = 20_000, 6, 7
#: Lines from a page's edge that a position is counted for; a running line stands there so often.
EDGE_LINES, HEADER_TIMES = 2, 5
#: Log-likelihood of standing at edges that makes a line an example of a header.
SURE_HEADER = 25.0
#: Letters that a word has at most; a longer run without blanks is no word.
LONGEST_WORD = 64
#: Entries that a task counts before it hands them on; decisions that are sent to all tasks.
HELD, DECISIONS = 500_000, 2_000_000

#: Marks that end a sentence or part of it.
STOPS = ".。,;，；"

_N = r"(?=[^\s]*\d)[0-9lIOoSsBbZzgq|!]{1,6}"
_PAGE = re.compile(rf"(?:<!--\s*Page ?Number.*-->|[-–—]\s*{_N}\s*[-–—]|\[\s*{_N}\s*\]|{_N}\s*/\s*{_N}|(?:P[a-z0-9!]{{2,3}}|S[a-z0-9!]{{4}}|[pS]\.)\s*{_N}(?:\s*(?:o[ft]|von|/)\s*{_N})?|第\s*{_N}\s*页(?:\s*[/共]\s*{_N}\s*页?)?)", re.I)
_BARE = re.compile(rf"{_N}|(?=[ivxl])x{{0,3}}(?:ix|iv|v?i{{0,3}})|(?=[IVXL])X{{0,3}}(?:IX|IV|V?I{{0,3}})")
_MARK = re.compile(r"<!--\s*Page(?:Header|Footer)\b.*-->", re.I)
_BREAK = re.compile(r"<!--\s*PageBreak\s*-->", re.I)
_TABLE = re.compile(r"\s\|\s|^\s*(?:Tab(?:le|elle|\.)?|Fig(?:ure|\.)?|Abb\.|表|图)\s*\d+\s*$|^\s*\d+[.,]\d+\s*$")
_HEADING = re.compile(r"^\s*(?:\d+\.(?:\d+\.?)*\s+[A-ZÄÖÜ一-鿿][\w ]{0,30}|Section:.*|[A-ZÄÖÜ][A-ZÄÖÜ &]{5,60})$")
_WORD = re.compile(r"[^\s,;:()\[\]<>=\"。，；：（）、]+")
_HAN = re.compile(r"[一-鿿]")
_HYPHEN = re.compile(r"([^\W\d_][-¬])\s*$")
_MARKUP, _VOLUME, _NO_LETTERS = re.compile(r"<!--\s*Page\w+=|-->"), re.compile(r"\bvol\b\.?"), re.compile(r"[\W\d_]+")
_BLANKS = re.compile(r"\s+")
_NUMBER = re.compile(r"[\d.–%]+")
_DIGIT = re.compile(r"\d")
_RIGHT = re.compile(r"[^\W\d_]|[0-9!|]")
#: Kinds of counted items: words are plain, the others start with one of these.
FIVE, THREE, PAIR = "\t", "\v", "\n"


# --- reading a text --------------------------------------------------------------------------------


@functools.lru_cache(maxsize=200_000)
def shape(word: str) -> str:
    return _DIGIT.sub("9", word.strip(".?!'`*"))


def header_key(line: str) -> str:
    """Letters of a line, without its number, its mark-up and the word for volume."""
    if "<" in line:
        line = _MARKUP.sub("", line)
    key = line.casefold()
    if "vol" in key:
        key = _VOLUME.sub("", key)
    key = _NO_LETTERS.sub("", key)
    return key[:-3] if key.endswith("vol") else key


def page_lines(lines: list[str]) -> set[int]:
    """Lines that are only a page number: by form, or a bare number (arabic or roman) that no table stands beside."""
    out = set()
    for i, x in enumerate(lines):
        t = x.strip()
        if t and (_PAGE.fullmatch(t) or (_BARE.fullmatch(t) and not any(_TABLE.search(y) for y in lines[max(0, i - 1) : i + 2] if y.strip()))):
            out.add(i)
    return out


def edges(lines: list[str], pages: set[int]) -> dict[int, int]:
    """Distance from the page's edge (0 is the first or last line) of lines near one; pages end at break marks, page numbers, double blank lines and the text's ends."""
    ends = [-1, len(lines), *pages] + [i for i, x in enumerate(lines) if ("<" in x and _BREAK.search(x)) or (not x.strip() and i and not lines[i - 1].strip())]
    out: dict[int, int] = {}
    for e in ends:
        for step in (1, -1):
            i, far = e + step, 0
            while 0 <= i < len(lines) and far < EDGE_LINES:
                if "<" in lines[i] and _BREAK.search(lines[i]):
                    break
                if lines[i].strip():
                    out[i] = min(far, out.get(i, far))
                    far += 1
                i += step
    return out


def folded_lines(text: str) -> list[str]:
    """Lines without look-alikes; a soft hyphen at a line end stays as a hyphen."""
    if not suspicious(text):
        return text.split("\n")
    if "­" in text:
        text = re.sub("­[^\\S\n]*(?=\n|$)", "-", text)
    return [consistent(x) for x in text.split("\n")]


def furniture(lines: list[str], head: set[int]) -> tuple[list[int], set[int], set[int]]:
    """Positions of body lines, page numbers and headers; ``head`` are header lines as found over all texts.

    A line written like one of the text's own headers is a header wherever it stands.
    """
    pages = page_lines(lines)
    found = {i for i in head if i not in pages} | {i for i, x in enumerate(lines) if "<" in x and _MARK.search(x)}
    keys = {k for i in found if len(k := header_key(lines[i])) >= 4}
    if keys:
        most = 3 * max(map(len, keys)) + 40
        found |= {i for i, x in enumerate(lines) if i not in found and i not in pages and x.strip() and len(x) <= most and header_key(x) in keys and not _TABLE.search(x)}
    skip = pages | found
    return [i for i, x in enumerate(lines) if i not in skip and not ("<" in x and _BREAK.search(x))], pages, found


def _evened(line: str) -> str:
    return _NUMBER.sub("9", _BLANKS.sub("", line))


def contexts(lines: list[str], body: list[int]) -> Iterator[tuple[int, str]]:
    """(line, five characters around it) of each Chinese character, with numbers and blanks evened out, across lines."""
    parts = [(i, _evened(lines[i])) for i in body if not lines[i].isascii()]
    text = "".join(p for _, p in parts)
    at, k = 0, 0
    for i, p in parts:
        for k in range(max(at, 2), min(at + len(p), len(text) - 2)):
            if "一" <= text[k] <= "鿿":
                yield i, text[k - 2 : k + 3]
        at += len(p)


def line_words(lines: list[str], body: list[int]) -> Iterator[tuple[int, list[str]]]:
    """Whole words of each line; words broken at line ends are left to the joiner."""
    broken = False
    for i in body:
        if not lines[i].strip():
            continue
        found = _WORD.findall(lines[i])
        ends = lines[i].rstrip()[-1:] in "-¬" and bool(_HYPHEN.search(lines[i]))
        yield i, found[1 if broken else 0 : len(found) - 1 if ends else len(found)]
        broken = ends


def broken_words(lines: list[str], body: list[int], near: dict[int, int] | None = None) -> Iterator[tuple[int, int, str, str]]:
    """(line, next line, word's part, its other part) at each line end with a hyphen.

    Given lines near page edges, which may yet turn out to be headers, a word may go on behind these as well.
    """
    filled = [i for i in body if lines[i].strip()]
    for k, i in enumerate(filled[:-1]):
        if lines[i].rstrip()[-1:] in "-¬" and _HYPHEN.search(lines[i]):
            left = _WORD.findall(lines[i].rstrip())
            for nxt in filled[k + 1 :]:
                right = _WORD.findall(lines[nxt])
                if left and right and _RIGHT.match(right[0]):
                    yield i, nxt, left[-1], right[0]
                if near is None or nxt not in near:
                    break


def pair_item(left: str, right: str) -> str:
    """A broken word as an item: its two parts, and the mark at the line end."""
    return PAIR + shape(left.rstrip("-¬")) + PAIR + shape(right) + PAIR + left[-1]


# --- first pass: counts ----------------------------------------------------------------------------


def _surveyed(texts: DataFrame) -> DataFrame:
    """What the corpus holds, in one pass: lines near page edges (text_id, line, key, far, stop, lower), lines that may be headers elsewhere (text_id, line, kh), counts of keys off the edges (kh, n) and of items (item, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        off: Counter = Counter()
        for b in batches:
            rows, loose = [], []
            for text_id, text in zip(b["text_id"], b["full_text"], strict=True):
                lines = folded_lines(text)
                body, pages, found = furniture(lines, set())
                near = edges(lines, pages)
                for i, x in enumerate(lines):
                    if i not in pages and x.strip() and not _TABLE.search(x) and not ("<" in x and _BREAK.search(x)):
                        key = header_key(x)
                        if len(key) >= 4:
                            if i in near:
                                rows.append((text_id, i, key, near[i], x.rstrip()[-1] in STOPS, x.lstrip()[0].islower()))
                            else:
                                kh = xxhash.xxh64_intdigest(key) - (1 << 63)
                                off[kh] += 1
                                if not x.lstrip()[0].islower() and x.rstrip()[-1] not in STOPS:
                                    loose.append((text_id, i, kh))
                for _, words in line_words(lines, body):
                    n.update(words)
                n.update(pair_item(a, c) for _, _, a, c in broken_words(lines, body, near))
                if not text.isascii():
                    five = [c for _, c in contexts(lines, [i for i in body if i not in near or _HAN.search(lines[i])])]
                    n.update(FIVE + c for c in five)
                    n.update(THREE + c[1:4] for c in five)
            if rows:
                yield _frame(pd.DataFrame(rows, columns=["text_id", "line", "key", "far", "stop", "lower"]))
            if loose:
                yield _frame(pd.DataFrame(loose, columns=["text_id", "line", "kh"]))
            if len(n) > HELD:
                yield from _counted(n, off)
                n, off = Counter(), Counter()
        yield from _counted(n, off)

    return texts.select("text_id", "full_text").mapInPandas(run, "text_id bigint, line int, key string, far int, stop boolean, lower boolean, kh bigint, item string, n bigint")


def _frame(part: pd.DataFrame) -> pd.DataFrame:
    return part.reindex(columns=["text_id", "line", "key", "far", "stop", "lower", "kh", "item", "n"]).astype({"text_id": "Int64", "stop": "boolean", "lower": "boolean", "line": "Int32", "far": "Int32", "kh": "Int64", "n": "Int64", "key": "string", "item": "string"})


def _counted(n: Counter, off: Counter) -> Iterator[pd.DataFrame]:
    shapes: Counter = Counter()
    for w, k in n.items():
        if w[0] in "\t\v\n":
            shapes[w] += k
        elif not _HAN.search(w) and 0 < len(s := shape(w)) <= LONGEST_WORD:
            shapes[s] += k
    if shapes:
        yield _frame(pd.DataFrame({"item": list(shapes), "n": list(shapes.values())}))
    if off:
        yield _frame(pd.DataFrame({"kh": list(off), "n": list(off.values())}))


# --- the averaged perceptron -----------------------------------------------------------------------


class Perceptron:
    """Weights of features; a choice is the option of the highest sum."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features])

    def train(self, examples: list[tuple[list[list[str]], int]]) -> Perceptron:
        """Examples are options (each a list of features) and the right one's position."""
        rng, total, now = random.Random(SEED), defaultdict(float), 1
        for _ in range(EPOCHS):
            rng.shuffle(examples)
            for options, gold in examples:
                guess = max(range(len(options)), key=lambda k, options=options: self.score(options[k]))
                if guess != gold:
                    for side, d in ((gold, 1.0), (guess, -1.0)):
                        for f in options[side]:
                            self.weights[f] = self.weights.get(f, 0.0) + d
                            total[f] += d * now
                now += 1
        self.weights = {f: w - total[f] / now for f, w in self.weights.items() if w - total[f] / now}
        return self


def _step(n: float) -> int:
    return min(14, int(math.log2(n + 1)))


def _ratio(more: float, less: float) -> int:
    return max(-8, min(10, int(math.floor(math.log2((more + 0.5) / (less + 0.5))))))


# --- running headers -------------------------------------------------------------------------------


def _header_features(first: int, second: int, off: int, stop: int, lower: int, size: int) -> list[list[str]]:
    """Options body and header of a line's key, from how often it stands where on the pages and how the line ends and begins."""
    n = first + second + off
    share, top = int(10 * (first + second) / n), int(4 * first / max(1, first + second))
    return [["body"], [f"share{share}", f"times{min(8, _step(first + second))}", f"share{share} times{min(8, _step(n))}", f"first{top}", f"long{min(6, size // 12)}", f"stop{int(4 * stop / max(1, first + second))}", f"lower{int(4 * lower / max(1, first + second))}"]]


def headers(survey: DataFrame) -> DataFrame:
    """Running headers of each text: text_id, header_lines (0-based).

    Keys far more often at edges than lines are in general, and keys mostly off
    them, are the examples that the weights are fitted on; the weights decide
    every key seen ``HEADER_TIMES`` times at edges.  A key within two edits of a
    header (one below eight letters) that isn't frequent itself is one misread.
    """
    at_edge = survey.where("key is not null").select("text_id", "line", "key", "far", "stop", "lower")
    keys = at_edge.groupBy("key").agg(F.sum((F.col("far") == 0).cast("long")).alias("first"), F.sum((F.col("far") > 0).cast("long")).alias("second"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("stop", "lower")])
    own = F.udf(lambda k: xxhash.xxh64_intdigest(k) - (1 << 63), "bigint")
    often = cut(keys.where(F.col("first") + F.col("second") >= HEADER_TIMES).withColumn("kh", own("key")))
    off = survey.where("n is not null and kh is not null").groupBy("kh").agg(F.sum("n").alias("off"))
    often = cut(often.join(off, "kh", "left").fillna(0, ["off"]))
    totals = survey.agg(F.count("key").alias("edge"), F.coalesce(F.sum(F.when(F.col("kh").isNotNull(), F.col("n"))), F.lit(0)).alias("off")).first()
    p = min(max(totals["edge"] / max(1, totals["edge"] + totals["off"]), 0.01), 0.45)
    n = F.col("first") + F.col("second")
    share = n / (n + F.col("off"))
    sure = n * F.ln(share / p) + F.when(F.col("off") > 0, F.col("off") * F.ln((1 - share) / (1 - p))).otherwise(0.0)
    evidence = ("first", "second", "off", "stop", "lower")
    rated = often.withColumn("sure", F.when(share < p, -sure).otherwise(sure))
    sample = lambda c: rated.where(c).orderBy(F.xxhash64("key")).limit(EXAMPLES // 2).collect()
    yes, no = sample((F.col("sure") >= SURE_HEADER) & (share > 0.8)), sample((F.col("sure") < SURE_HEADER / 10) & (share < 0.5))
    model = Perceptron().train([(_header_features(*[r[c] for c in evidence], len(r["key"])), k) for rows, k in ((yes, 1), (no, 0)) for r in rows])

    @F.udf("boolean")
    def is_header(*x: int) -> bool:
        body, head = _header_features(*x)
        return model.score(head) > model.score(body)

    good = cut(often.where(is_header(*evidence, F.length("key"))).select("key", "kh"))
    wrong = cut(_within_two(keys.join(good, "key", "left_anti").select("key"), good))
    loose = survey.where("kh is not null and line is not null").join(good.select("kh"), "kh", "left_semi").select("text_id", "line")
    out = at_edge.join(good.select("key").unionByName(wrong), "key").select("text_id", "line").unionByName(loose)
    return out.groupBy("text_id").agg(F.sort_array(F.collect_set("line")).alias("header_lines"))


def _within_two(keys: DataFrame, good: DataFrame) -> DataFrame:
    """Distinct ``keys`` within two edits of one of ``good`` (within one below eight letters), by a pigeonhole join: one of k + 1 segments is whole.

    A segment shifts by at most the edits before it, and to the other end by at most those behind it.
    """
    ends = lambda df: df.withColumn("at", F.expr("cast(floor(i * len / (k + 1)) as int)")).withColumn("width", F.expr("cast(floor((i + 1) * len / (k + 1)) as int) - at"))
    segs = good.select(F.col("key").alias("good"), F.length("key").alias("len")).withColumn("k", F.when(F.col("len") >= 8, 2).otherwise(1))
    segs = ends(segs.select("*", F.explode(F.sequence(F.lit(0), "k")).alias("i"))).withColumn("seg", F.expr("substring(good, at + 1, width)"))
    shapes = segs.select("len", "k", "i", "at", "width").distinct()
    v = keys.select("key", F.length("key").alias("n"), F.explode(F.sequence(F.length("key") - 2, F.length("key") + 2)).alias("len"))
    v = v.join(shapes, "len").where("abs(n - len) <= k")
    low, high = F.expr("greatest(0, at - i, at + n - len - (k - i))"), F.expr("least(n - width, at + i, at + n - len + (k - i))")
    v = v.select("key", "len", "i", "width", low.alias("lo"), high.alias("hi")).where("lo <= hi").select("key", "len", "i", "width", F.explode(F.sequence("lo", "hi")).alias("pos"))
    v = v.select("key", "len", "i", F.expr("substring(key, pos + 1, width)").alias("seg")).distinct()
    return v.join(segs.select("good", "len", "i", "k", "seg"), ["len", "i", "seg"]).where("levenshtein(key, good, k) >= 0").select("key").distinct()


# --- mining and deciding over distinct words -------------------------------------------------------


def _words(counts: DataFrame) -> DataFrame:
    """Every word with its count, or that of its other-cased form: w, n, asked (it stands in the corpus or a broken word may be it)."""
    plain = counts.where(~F.substring("item", 1, 1).isin(FIVE, THREE, PAIR)).select(F.col("item").alias("w"), "n", F.lit(True).alias("asked"))
    p = F.split("item", PAIR)
    pairs = counts.where(F.substring("item", 1, 1) == PAIR).select(F.explode(F.array(F.concat(p[1], p[2]), F.concat(p[1], F.lit("-"), p[2]), p[1], p[2])).alias("w"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    first = F.substring("w", 1, 1)
    other = F.concat(F.when(F.lower(first) == first, F.upper(first)).otherwise(F.lower(first)), F.expr("substring(w, 2)"))
    swapped = plain.select(other.alias("w"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("asked"), F.col("n").alias("m")).where(F.length("w") > 1)
    every = plain.unionByName(pairs).withColumn("m", F.lit(0).cast("long")).unionByName(swapped)
    every = every.where(F.length("w").between(1, LONGEST_WORD)).groupBy("w").agg(F.sum("n").alias("own"), F.max("m").alias("m"), F.max("asked").alias("asked"))
    return every.select("w", F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("m")).alias("n"), "asked")


def _gaps(words: DataFrame, width: int, *cols: str) -> DataFrame:
    """Each word with ``width`` letters taken out at each place: gap, at, out, and the given columns."""
    return words.where(F.length("w") >= 2).select("w", *cols, F.explode(F.sequence(F.lit(1), F.length("w") - (width - 1))).alias("at")).select(
        *cols, "at", F.expr(f"concat(substring(w, 1, at - 1), '\\u0001', substring(w, at + {width}))").alias("gap"), F.expr(f"substring(w, at, {width})").alias("out"))


def _pairs(words: DataFrame) -> DataFrame:
    """A word and a more frequent, known one that it may be a misreading of: x, nx, w, nw, at, a (as written), b (as meant)."""
    x = words.where("asked").select(F.col("w").alias("x"), "w", F.col("n").alias("nx"))
    y = words.where(F.col("n") >= KNOWN).where(F.length("w") > 1).select(F.col("w").alias("y"), "w", F.col("n").alias("nw"))
    out = None
    for i, j in ((1, 1), (1, 2), (2, 1)):
        a = _gaps(x, i, "x", "nx").withColumnRenamed("out", "a")
        b = _gaps(y, j, "y", "nw").select("gap", "y", "nw", F.col("out").alias("b"))
        both = a.join(b, "gap").where("nw > nx and lower(a) <> lower(b)")
        if i != j:
            both = both.where("instr(a, b) = 0 and instr(b, a) = 0")
        both = both.select("x", "nx", F.col("y").alias("w"), "nw", "at", "a", "b")
        out = both if out is None else out.unionByName(both)
    return out.where(F.concat("a", "b").rlike(r"^(?U)[\w!|]+$"))


def _confusions(pairs: DataFrame) -> DataFrame:
    """Confusions that explain many rare words by frequent ones: a, b, support."""
    tell = pairs.where((F.col("nx") > 0) & (F.col("nw") >= RARER * F.col("nx")) & ((F.length("w") >= 4) | F.col("w").rlike(r"\d")) & (F.length("x") > 1))
    # Numbers have few shapes, so their confusions count by occurrences.
    numeric = F.min(F.col("w").rlike(r"^[\d.–/]+$"))
    found = tell.groupBy("a", "b").agg(F.count_distinct("w").alias("support"), F.sum("nx").alias("times"), numeric.alias("numeric"))
    return found.where((F.col("support") >= LEAST_WORDS) | ((F.col("b") == "9") & F.col("numeric") & (F.col("times") >= 4 * LEAST_WORDS))).select("a", "b", "support")


def _kind(c: str) -> str:
    return "-" if not c else "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "."


def edit_options(x: str, nx: int, found: list) -> list[list[str]]:
    """Features of keeping a word and of each edit (w, nw, at, a, b, support) that may have been meant."""
    mixed = bool(_DIGIT.search(x)) and any(c.isalpha() for c in x)
    out = [["keep", f"keep own{_step(nx)}", f"keep mixed{mixed}", f"keep long{min(len(x), 8)}"]]
    for w, nw, at, a, b, support in found:
        kind = "replace" if len(a) == len(b) else "delete" if len(b) < len(a) else "insert"
        r = _ratio(nw, nx)
        before, after = _kind(x[at - 2 : at - 1] if at > 1 else ""), _kind(x[at - 1 + len(a) : at + len(a)])
        out.append([kind, f"{a}>{b}", f"gain{_step(nw)}", f"ratio{r}", f"{kind} ratio{r}", f"support{_step(support)}", f"{before}{_kind(a[0])}{after}", f"long{min(len(w), 6)} ratio{r}", f"mixed{mixed} ratio{r}"])
    return out


def _decided_words(words: DataFrame) -> DataFrame:
    """What misread words were: item, meant."""
    pairs = cut(_pairs(words))
    ops = cut(_confusions(pairs))
    option = F.struct("w", "nw", "at", "a", "b", "support")
    each = cut(pairs.join(ops, ["a", "b"]).groupBy("x", "nx").agg(F.sort_array(F.collect_list(option)).alias("found"), F.max("nw").alias("best")))
    noisy = (F.col("nx") > 0) & (F.col("best") >= F.greatest(F.lit(2 * KNOWN), RARER * F.col("nx")))
    # Words of other neighbours than the confusions explain are what they are, and so are frequent ones.
    sound = (F.col("nx") >= KNOWN) & (F.col("best") < RARER * F.col("nx"))
    sample = lambda c: each.where(c).orderBy(F.xxhash64("x"), "x").limit(EXAMPLES // 2).collect()
    examples = []
    for r in sample(noisy):
        options = edit_options(r["x"], r["nx"], r["found"])
        examples.append((options, 1 + max(range(len(r["found"])), key=lambda k: (r["found"][k]["nw"], r["found"][k]["support"]))))
    examples += [(edit_options(r["x"], r["nx"], r["found"]), 0) for r in sample(sound)]
    model = Perceptron().train(examples)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x, nx, found in zip(b["x"], b["nx"], b["found"], strict=True):
                found = [tuple(f[c] for c in ("w", "nw", "at", "a", "b", "support")) for f in found]
                scores = [model.score(f) for f in edit_options(x, nx, found)]
                k = max(range(len(scores)), key=scores.__getitem__)
                if k:
                    rows.append((x, found[k - 1][0]))
            if rows:
                yield pd.DataFrame(rows, columns=["item", "meant"])

    once = cut(each.select("x", "nx", "found").mapInPandas(decide, "item string, meant string"))
    # A second misreading in the same word.
    twice = once.select(F.col("item").alias("meant"), F.col("meant").alias("then"))
    return once.join(twice, "meant", "left").select("item", F.coalesce(F.when(F.col("then") != F.col("item"), F.col("then")), "meant").alias("meant"))


def han_options(op: str, support: int, n5: int, g5: int, n3: int, g3: int) -> list[list[str]]:
    """Features of keeping a Chinese character and of replacing it, from the counts of what stands around it, five and three characters wide."""
    r5, r3 = _ratio(g5, n5), _ratio(g3, n3)
    known = "seen" if g5 >= KNOWN else "new"
    return [[f"keep own{_step(n5)}", f"keep three{_step(n3)}"], [f"{op}", f"support{_step(support)}", f"{known} five{r5}", f"{known} three{r3}", f"five{r5} three{r3}", f"gain{_step(g3)}"]]


def _decided_characters(counts: DataFrame) -> DataFrame:
    """What misread Chinese characters were, by the five characters around them: item, meant."""
    five = counts.where(F.substring("item", 1, 1) == FIVE).select(F.expr("substring(item, 2)").alias("c"), "n")
    three = counts.where(F.substring("item", 1, 1) == THREE).select(F.expr("substring(item, 2)").alias("c3"), F.col("n").alias("n3"))
    five = five.withColumn("mid", F.expr("substring(c, 3, 1)")).withColumn("frame", F.expr("concat(substring(c, 1, 2), substring(c, 4, 2))"))
    top = five.groupBy("frame").agg(F.max_by("mid", F.struct("n", "mid")).alias("meant"), F.max("n").alias("most"))
    tell = five.join(top, "frame").where((F.col("most") >= RARER * F.col("n")) & (F.col("mid") != F.col("meant")) & F.col("meant").rlike("[一-鿿]"))
    ops = tell.groupBy("mid", "meant").agg(F.count_distinct("c").alias("support")).where(F.col("support") >= LEAST_WORDS)
    may = five.join(ops, "mid").withColumn("alt", F.expr("concat(substring(c, 1, 2), meant, substring(c, 4, 2))"))
    may = may.withColumn("c3", F.expr("substring(c, 2, 3)")).withColumn("alt3", F.expr("substring(alt, 2, 3)"))
    may = may.join(five.select(F.col("c").alias("alt"), F.col("n").alias("g5")), "alt", "left").join(three, "c3", "left")
    may = may.join(three.select(F.col("c3").alias("alt3"), F.col("n3").alias("g3")), "alt3", "left").fillna(0, ["g5", "n3", "g3"])
    may = cut(may.where("g3 > 0 or g5 > 0").select("c", "mid", "meant", "support", F.col("n").alias("n5"), "g5", "n3", "g3"))
    sample = lambda c: may.where(c).orderBy(F.xxhash64("c"), "c", "meant").limit(EXAMPLES // 2).collect()
    rows = [(r, 1) for r in sample((F.col("g5") >= F.greatest(F.lit(KNOWN), RARER * F.col("n5"))) & (F.col("n5") > 0))]
    rows += [(r, 0) for r in sample((F.col("n5") >= KNOWN) & (F.col("g5") < RARER * F.col("n5")))]
    examples = []
    for r, gold in rows:
        op = f"{r['mid']}>{r['meant']}"
        examples.append((han_options(op, r["support"], r["n5"], r["g5"], r["n3"], r["g3"]), gold))
        # The same place as if its wording had never been seen: three characters must do.
        examples.append((han_options(op, r["support"], 1, 0, max(1, r["n3"] - r["n5"] + 1), max(0, r["g3"] - r["g5"])), gold if gold == 0 or r["g3"] - r["g5"] >= KNOWN else 0))
    model = Perceptron().train(examples)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c, mid, meant, support, n5, g5, n3, g3 in b.itertuples(index=False, name=None):
                keep, change = (model.score(f) for f in han_options(f"{mid}>{meant}", support, n5, g5, n3, g3))
                if change > keep:
                    rows.append((FIVE + c, meant, change - keep))
            if rows:
                yield pd.DataFrame(rows, columns=["item", "meant", "score"])

    found = may.mapInPandas(decide, "item string, meant string, score double")
    return found.groupBy("item").agg(F.max_by("meant", F.struct("score", "meant")).alias("meant"))


def join_options(mark: str, left: str, right: str, whole: int, parted: int, nl: int, nr: int) -> list[list[str]]:
    """Features of leaving a line end as it is and of joining the word there."""
    known = f"{whole > 0}{parted > 0}"
    sides = f"{nl >= KNOWN}{nr >= KNOWN}"
    return [["leave", f"leave parted{min(4, _step(parted))}"], ["join", f"whole{min(4, _step(whole))}", f"known{known} ratio{_ratio(whole, parted)}", f"mark{mark}", f"known{known} sides{sides}", f"known{known} {_kind(left[-1:])}{_kind(right[:1])}", f"known{known} short{min(3, len(left))}"]]


def _decided_joins(counts: DataFrame, words: DataFrame, meant: DataFrame) -> DataFrame:
    """Broken words that are written without the hyphen: item, meant (empty)."""
    p = F.split("item", PAIR)
    pairs = counts.where(F.substring("item", 1, 1) == PAIR).select("item", "n", p[1].alias("left"), p[2].alias("right"), p[3].alias("mark"))
    pairs = pairs.withColumn("whole", F.concat("left", "right")).withColumn("parted", F.concat("left", F.lit("-"), "right"))
    # A broken word may be misread as well: what it was meant to be is what counts.
    n = words.select("w", "n")
    told = n.join(meant.select(F.col("item").alias("w"), "meant"), "w", "left").select("w", "n", F.coalesce("meant", "w").alias("m"))
    told = told.join(n.select(F.col("w").alias("m"), F.col("n").alias("nm")), "m", "left").select("w", F.greatest("n", F.coalesce("nm", F.lit(0))).alias("n"))
    for c, frm in (("whole", told), ("parted", told), ("left", n), ("right", n)):
        pairs = pairs.join(frm.select(F.col("w").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    pairs = cut(pairs.fillna(0, ["n_whole", "n_parted", "n_left", "n_right"]).select("item", "left", "right", "mark", "n_whole", "n_parted", "n_left", "n_right"))
    examples = []
    for r in pairs.where("n_whole > 0 or n_parted > 0").orderBy(F.xxhash64("item"), "item").limit(EXAMPLES // 2).collect():
        gold = int(r["n_whole"] >= r["n_parted"])
        for seen in (1, 0):
            examples.append((join_options(r["mark"], r["left"], r["right"], seen * r["n_whole"], seen * r["n_parted"], r["n_left"], r["n_right"]), gold))
    model = Perceptron().train(examples)
    fallback = not examples

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            items = []
            for item, left, right, mark, whole, parted, nl, nr in b.itertuples(index=False, name=None):
                leave, join = (model.score(f) for f in join_options(mark, left, right, whole, parted, nl, nr))
                # Without any example (a tiny corpus) only the mark that is no hyphen tells.
                if (mark == "¬") if fallback else join > leave:
                    items.append(item)
            if items:
                yield pd.DataFrame({"item": items, "meant": ""})

    return pairs.mapInPandas(decide, "item string, meant string")


def decisions(survey: DataFrame) -> DataFrame:
    """All edits that differ from keep: item (word, Chinese context or broken word), meant."""
    counts = cut(survey.where("item is not null").groupBy("item").agg(F.sum("n").alias("n")))
    words = cut(_words(counts))
    edits = cut(_decided_words(words))
    return cut(edits.unionByName(_decided_characters(counts)).unionByName(_decided_joins(counts, words, edits)))


# --- second pass -----------------------------------------------------------------------------------


def judge(text: str, head: set[int], told: dict[str, str], repair: bool = False) -> tuple[list[tuple[int, str]], str]:
    """Noisy lines (1-based line, kind) of a text, and the text repaired into paragraphs if asked; ``told`` are the decisions."""
    lines = folded_lines(text)
    body, pages, found = furniture(lines, head)
    out = [(i, "page") for i in pages] + [(i, "header") for i in found]
    bad: set[int] = set()
    fixed = {i: lines[i] for i in body} if repair else {}
    plain = lambda i: not _TABLE.search(lines[i]) and not _HEADING.match(lines[i])
    get = told.get
    for i, words in line_words(lines, body):
        wrong = [(w, m) for w in words if (m := get(shape(w))) is not None]
        if wrong and plain(i):
            bad.add(i)
            for w, m in wrong if repair else ():
                s = w.strip(".?!'`*")
                fixed[i] = re.sub(rf"(?<![^\s,;:()\[\]<>=\"]){re.escape(w)}(?![^\s,;:()\[\]<>=\"])", lambda _, w=w, s=s, m=m: w.replace(s, _restore(s, m), 1), fixed[i])
    if not text.isascii():
        for i, c in contexts(lines, body):
            m = get(FIVE + c)
            if m is not None and plain(i):
                bad.add(i)
                if repair:
                    fixed[i] = _set_right(fixed[i], c, m)
    joined = set()
    for i, nxt, left, right in broken_words(lines, body):
        if plain(i) and get(pair_item(left, right)) is not None:
            out.append((i, "hyphen"))
            joined.add(i)
            own = shape(left.rstrip("-¬"))
            word = own + shape(right)
            m = get(word)
            if m is not None:
                spot = next((k for k, (a, b) in enumerate(zip(word, m, strict=False)) if a != b), len(word) - 1)
                bad.add(i if spot < len(own) else nxt)
    out += [(i, "misread") for i in bad if plain(i)]
    return sorted((i + 1, k) for i, k in out), _paragraphs(lines, body, fixed, joined) if repair else ""


def _paragraphs(lines: list[str], body: list[int], fixed: dict[int, str], joined: set[int]) -> str:
    """Body lines run on; paragraphs end at blank lines, but not where furniture stands beside them."""
    paras, line, rest = [], "", set(body)
    for i, x in enumerate(lines):
        if i in rest and (_HEADING.match(x) or _TABLE.search(x)) and x.strip():
            paras += [p for p in (line.strip(), fixed[i].strip()) if p]
            line = ""
        elif i in rest and x.strip():
            t = fixed[i].strip()
            if i in joined:
                line += re.sub(r"[-¬]\s*$", "", t)
            else:
                line += t + ("" if _HAN.match(t[-1]) else " ")
        elif i in rest and line and not _furniture_follows(lines, i, rest):
            paras.append(line.strip())
            line = ""
    if line:
        paras.append(line.strip())
    return "\n\n".join(paras)


def _furniture_follows(lines: list[str], i: int, body: set[int]) -> bool:
    """True if the blank line stands beside furniture, that is, at a page edge."""
    for step in (1, -1):
        k = i + step
        while 0 <= k < len(lines) and not lines[k].strip():
            k += step
        if 0 <= k < len(lines) and k not in body:
            return True
    return False


def _restore(written: str, meant: str) -> str:
    """The meant shape with the written digits put back where it has digits."""
    digits = iter([c for c in written if c.isdigit()])
    return "".join(next(digits, "0") if c == "9" else c for c in meant)


def _set_right(line: str, context: str, meant: str) -> str:
    """The line with the middle character of the context replaced, at the place that shares most with the context."""
    spots = [k for k, x in enumerate(line) if x == context[2]]
    if not spots:
        return line
    k = max(spots, key=lambda k: (line[k - 1 : k] == context[1]) + (line[k + 1 : k + 2] == context[3]))
    return line[:k] + meant + line[k + 1 :]


def _asked(texts: DataFrame) -> DataFrame:
    """Items of each text that may have a decision: text_id, item. ``texts`` has header_lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, items = [], []
            for text_id, text, head in zip(b["text_id"], b["full_text"], b["header_lines"], strict=True):
                lines = folded_lines(text)
                body, _, _ = furniture(lines, set(head if head is not None else ()))
                own = {shape(w) for _, words in line_words(lines, body) for w in words} | {FIVE + c for _, c in contexts(lines, body)}
                for _, _, left, right in broken_words(lines, body):
                    own |= {pair_item(left, right), shape(left.rstrip("-¬")) + shape(right)}
                ids += [text_id] * len(own)
                items += own
            if ids:
                yield pd.DataFrame({"text_id": ids, "item": items})

    return texts.mapInPandas(run, "text_id bigint, item string")


def _judged(texts: DataFrame, lines: bool) -> DataFrame:
    """Noisy lines of all texts, or else the repaired texts."""
    base = texts.select("text_id", "full_text").where(F.length("full_text") > 0)
    survey = cut(_surveyed(base))
    told = decisions(survey)
    ready = base.join(headers(survey), "text_id", "left")
    spark = texts.sparkSession
    if told.count() <= DECISIONS:
        shared = spark.sparkContext.broadcast({r["item"]: r["meant"] for r in told.collect()})
        ready = ready.withColumn("told", F.lit(None).cast("map<string,string>"))
    else:
        # More decisions than all tasks should hold: each text gets its own by a join.
        shared = None
        mine = _asked(ready).join(told, "item").groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("item", "meant"))).alias("told"))
        ready = ready.join(mine, "text_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, h, own in zip(b["text_id"], b["full_text"], b["header_lines"], b["told"], strict=True):
                mine = shared.value if shared is not None else dict(own) if own is not None else {}
                noise, clean = judge(t, set(h if h is not None else ()), mine, not lines)
                out += [(i, n, k) for n, k in noise] if lines else [(i, clean)]
            if out:
                yield pd.DataFrame(out, columns=["text_id", "line_no", "kind"] if lines else ["text_id", "clean_text"])

    return ready.mapInPandas(run, "text_id bigint, line_no bigint, kind string" if lines else "text_id bigint, clean_text string")


def noisy_lines(texts: DataFrame) -> DataFrame:
    """Lines with noise of page scans: text_id, line_no (from 1), kind (``hyphen``, ``header``, ``page``, ``misread``).

    ``texts``: text_id (unique), full_text.  Null and empty texts have none; very
    long texts are read whole; other columns are ignored; the result does not
    depend on the order of rows.
    """
    return _judged(texts, lines=True).distinct()


def repaired(texts: DataFrame) -> DataFrame:
    """Texts as continuous paragraphs without furniture, with words joined and misread characters set right: text_id, clean_text.

    Null and empty texts are left out.
    """
    return _judged(texts, lines=False)
