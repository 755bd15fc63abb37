"""Visually identical text with different characters (problem 3).

The skeleton of a text decomposes it, replaces every character by its prototype
from a look-alike table, and decomposes again; originals with equal skeletons
look the same.  The consistent form applies the same table, but leaves alone what
is ordinary where it stands: words in their own script, Greek prefixes, sub- and
superscripts, en dashes and Chinese punctuation.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХЬҮԚԜѴаеѕіјорсухһԁԛԝүѵӀӏ", "ABESIJKMHOPCTYXbYQWVaesijopcyxhdqwyvll", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿοϲϳ", "ABEZHIKMNOPTYXCJocj", strict=True))
#: Greek letters that only look Latin within a Latin word, as they stand for themselves elsewhere.
GREEK_INSIDE = dict(zip("αινρυκγ", "aivpuky", strict=True))
ARMENIAN = dict(zip("ՍՏՕԼօսհյցոզ", "USOLouhjgnq", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᎥ", "ABCDEGHJKLMPRSTVWZi", strict=True))
LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ", strict=True))
#: Latin letters of other alphabets that look like plain ones.
LATIN = dict(zip("ɑɡıȷɩʋ", "agijiu", strict=True))
SCRIPTS = {"Cyrillic": ("Ѐ-ԯ", CYRILLIC), "Greek": ("Ͱ-Ͽ", GREEK), "Armenian": ("\u0530-\u058f", ARMENIAN), "Cherokee": ("\u13a0-\u13fd", CHEROKEE), "Lisu": ("\ua4d0-\ua4ff", LISU)}
HYPHENS = "\u2010\u2011\u2043\ufe63\uff0d"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u2028\u2029"
#: The wide space of Chinese text is ordinary beside Chinese characters.
WIDE_SPACE = "\u3000"
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2065\u2066\u2067\u2068\u2069"
    "\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0\ufff9\ufffa\ufffb" + "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]))
)


def _compatible() -> dict[str, str]:
    """Letters and digits in other code points, by rules over all of Unicode.

    Full-width, mathematical, Roman and joined ones decompose into plain ones;
    raised, lowered, circled and squared ones look different and don't count.
    Small capitals look like small letters where these have the same shape.
    """
    out = {}
    for cp in range(0x80, 0x20000):
        c = chr(cp)
        tag = unicodedata.decomposition(c).partition(" ")[0]
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and plain.isascii() and plain.isalnum() and tag not in ("<super>", "<sub>", "<circle>", "<square>", "<fraction>"):
            out[c] = plain
        name = unicodedata.name(c, "")
        if name.startswith("LATIN LETTER SMALL CAPITAL ") and len(letter := name.rsplit(" ", 1)[1]) == 1 and name.count(" ") == 4:
            out[c] = letter.lower() if letter in "COSUVWXZ" else letter
    return out


COMPATIBLE = _compatible()
ALWAYS = COMPATIBLE | LATIN | {c: "-" for c in HYPHENS} | {c: " " for c in SPACES} | {c: "" for c in INVISIBLE}
LOOK = {k: v for _, table in SCRIPTS.values() for k, v in table.items()}
PROTOTYPE = ALWAYS | LOOK | GREEK_INSIDE | {WIDE_SPACE: " "}
_ALWAYS, _PROTOTYPE = str.maketrans(ALWAYS), str.maketrans(PROTOTYPE)
_LOOK, _INSIDE = str.maketrans(LOOK), str.maketrans(LOOK | GREEK_INSIDE)
_FOREIGN = re.compile(f"[{''.join(r for r, _ in SCRIPTS.values())}]")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_HAN = re.compile(r"[一-鿿]")
_SCRIPT_RUN = {s: re.compile(f"[{r}]") for s, (r, _) in SCRIPTS.items()}


def skeleton(text: str) -> str:
    """Decomposed, each character replaced by its prototype, decomposed again."""
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_PROTOTYPE))


def consistent(text: str) -> str:
    """The text in its one consistent form; unchanged if all in it is ordinary.

    The form of a word is its skeleton, composed again, unless the word is
    ordinary in its own script: a word that mixes Latin letters with look-alikes
    takes it; a word of nothing but look-alikes does too, unless the text has
    words of that script that can't be Latin.  Single Greek letters stay as they
    are, except capitals and omicron beside Latin letters or digits.
    """
    if text.isascii():
        return text
    out = unicodedata.normalize("NFC", text.translate(_ALWAYS))
    if WIDE_SPACE in out and not _HAN.search(out):
        out = out.replace(WIDE_SPACE, " ")
    if not _FOREIGN.search(out):
        return out
    own = {s: any(_whole(w, s) for w in _WORD.findall(out)) for s, run in _SCRIPT_RUN.items() if run.search(out)}

    def plain(m: re.Match) -> str:
        if not _FOREIGN.search(m.group()):
            return m.group()
        w = unicodedata.normalize("NFD", m.group())
        if _LATIN.search(w):
            flat = w[:1].translate(_LOOK) + w[1:-1].translate(_INSIDE) + w[-1:].translate(_LOOK)
        else:
            flat = w.translate(_LOOK)
            if _FOREIGN.search(flat) or any(own.get(s) and run.search(w) for s, run in _SCRIPT_RUN.items()):
                return m.group()
        return unicodedata.normalize("NFC", flat)

    return _WORD.sub(plain, out)


def _whole(word: str, script: str) -> bool:
    """True if the word is of one script and can't be written in Latin look-alikes."""
    return len(word) > 2 and all(_SCRIPT_RUN[script].match(c) for c in word) and not word.translate(_LOOK).isascii()


def suspicious(text: str) -> bool:
    """True if the text may hold a character that its consistent form changes."""
    return not text.isascii() and not _SUSPECTS.isdisjoint(set(text))


def suspect(c: Column) -> Column:
    """``suspicious`` by built-in functions: the text is shorter without such characters. Null is not suspect."""
    gone = F.translate(c, "".join(sorted(_SUSPECTS)), "")
    return F.coalesce(c.rlike(r"[^\x00-\x7f]") & (F.length(gone) < F.length(c)), F.lit(False))


_SUSPECTS = frozenset(PROTOTYPE) | {chr(c) for c in range(0x300, 0x370)}


@F.pandas_udf(T.StructType([T.StructField("clean", T.StringType()), T.StructField("skeleton", T.StringType())]))
def _unify(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"clean": [None if t is None else consistent(t) for t in texts], "skeleton": [None if t is None else skeleton(t) for t in texts]})


def unify(df: DataFrame, text: str) -> DataFrame:
    """``df`` with clean, skeleton and touched (is the stored text another than its consistent form).

    Only texts with a character of the table go through Python; for the rest the
    text is its own clean form.  Null gives null and is not touched; the empty
    text is itself.  Columns of these names are replaced.
    """
    df = df.drop("clean", "skeleton", "touched")
    may = suspect(F.col(text))
    odd = df.where(may).withColumn("_u", _unify(F.col(text))).select(*df.columns, "_u.clean", "_u.skeleton")
    odd = odd.withColumn("touched", F.col("clean") != F.col(text))
    even = df.where(~may).select("*", F.col(text).alias("clean"))
    even = even.withColumn("skeleton", F.when(~F.col(text).rlike(r"[^\x00-\x7f]"), F.col(text)).otherwise(_decomposed(F.col(text)))).withColumn("touched", F.lit(False))
    return odd.unionByName(even)


@F.pandas_udf(T.StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else skeleton(t) for t in texts], dtype=object)


def touched(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Key columns of the rows whose text is not in its consistent form."""
    found = df.where(suspect(F.col(text))).select(*keep, text).withColumn("_u", _unify(F.col(text)))
    # Exact check: a skeleton that differs makes a candidate; ordinary words in their own script drop out.
    return found.where((F.col("_u.skeleton") != F.col(text)) & (F.col("_u.clean") != F.col(text))).select(*keep)


def look_alikes(df: DataFrame, text: str) -> DataFrame:
    """Groups of different originals with one skeleton: skeleton, n_rows, n_forms, form (the most frequent consistent one).

    Counts are added up per original before groups are formed, so frequent texts
    cost one row.  Nulls are left out.
    """
    forms = unify(df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("original")).agg(F.count("*").alias("n")), "original")
    out = forms.groupBy("skeleton").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_forms"), F.max_by("clean", F.struct((~F.col("touched")).alias("a"), F.col("n").alias("b"), F.col("clean").alias("c"))).alias("form"),
    )
    return out.where("n_forms > 1")


def folded(c: Column) -> Column:
    """Look-alikes to Latin by built-in functions alone, for names that are compared, not kept."""
    one = {k: v for k, v in (LOOK | ALWAYS | {WIDE_SPACE: " "}).items() if len(v) == 1}
    gone = INVISIBLE
    for k, v in COMPATIBLE.items():
        if len(v) > 1 and k in "ﬀﬁﬂﬃﬄﬅﬆ":
            c = F.replace(c, F.lit(k), F.lit(v))
    return F.translate(c, "".join(one) + gone, "".join(one.values()))
