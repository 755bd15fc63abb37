"""Quantities recorded in different units (problem 7).

Every way in which a row may state its quantity is a candidate: the number with a
unit inside ``value``, with the column ``unit``, or with a unit in the running
text.  A candidate must obey the physical identity of its quantity (a surface
area is an area over a mass, a flow a volume over a time), which decides what the
unit's letters mean.  Among those left, the one with the least log residual
against what the text restates is taken; where different candidates are equally
good, the row is flagged as not unique.  No row is compared with another and
nothing is shuffled.

Rows of one node obey identities among each other, too: a mean pore width is four
pore volumes over the surface.  ``infer_units`` uses them for rows without a unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import units as U
from weft.functions.names import join_on
from weft.session import cut

_MANT = r"(?:\d{1,3}(?:[ ,]\d{3})+(?:\.\d+)?(?!\d)|\d+(?:[.,]\d+)?|\.\d+)"
NUM = rf"[-−+]?{_MANT}(?:\s?[x×*·]\s?10\^?[-−+]?\d+|[eE][-−+]?\d+)?"
#: Words before a number that don't change it, and numbers in words.
ABOUT = r"(?i)^(?:about|approx\.?|approximately|around|circa|ca\.?|c\.|roughly|nearly|etwa|rund|ungefähr|约为|大约|约|[~≈∼])\s*"
WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
_TO = r"(?:\s*(?:~|–|—|−|∼|-|…)\s*|\s+(?:to|bis|till|and|und)\s+|\s*[至到]\s*)"
SPAN = rf"^(?:(?i:between|from|von|zwischen)\s+)?({NUM}){_TO}({NUM})\s*(\D.*)?$"
TWICE = rf"^(?:(?i:between|from|von|zwischen)\s+)?({NUM})\s*(\D.*?){_TO}({NUM})\s*(\D.*)$"
SINGLE = rf"^({NUM})\s*(.*)$"
_HOURS, _MINS = r"(?:d|days?|h|hrs?|hours?|小时)", r"(?:min|mins|minutes?|m|分钟?|h|hrs?|hours?)"
MIXED = rf"^({NUM})\s*({_HOURS})\.?[\s,]*(?:and\s+)?({NUM})\s*({_MINS})\.?$"
PLAIN = r"^-?\d+(\.\d+)?$"
#: Two readings count as one if their logarithms differ by less.
TOLERANCE = 1e-6


def number(c: Column) -> Column:
    """A written number as double: thousands by comma or blank, decimal comma, powers of ten.

    A comma before exactly three digits groups thousands, unless a zero stands
    before it.  Null if it is no number.
    """
    t = F.regexp_replace(F.translate(c, "−×*·", "-xxx"), r"\s?x\s?10\^?", "e")
    t = F.regexp_replace(t, r"(?<=[1-9]|[1-9]\d|[1-9]\d\d|\d[ ,]\d{3})[ ,](?=\d{3}(?:\D|$))", "")
    t = F.regexp_replace(F.regexp_replace(t, ",", "."), " ", "")
    return F.when(c.rlike(PLAIN), c.try_cast("double")).otherwise(t.try_cast("double"))


def _words(c: Column) -> Column:
    """The text with a number word at its start written in digits."""
    word = F.lower(F.regexp_extract(c, r"^([A-Za-z]+)(?:\s|$)", 1))
    hit = F.element_at(U.constant_map({k: str(v) for k, v in WORDS.items()}, "map<string,string>"), word)
    return F.when(hit.isNotNull(), F.concat(hit, F.substring(c, F.length(word) + 1, F.length(c)))).otherwise(c)


def _parsed(df: DataFrame) -> DataFrame:
    """Numbers ``lo`` and ``hi`` of ``value`` and the text after them, ``inner`` (the unit, if there is one)."""
    t = F.col("_t")
    df = df.withColumn("_t", F.regexp_replace(F.translate(F.col("value"), "     　", "      "), r"^\s+|\s+$", ""))
    # Most values are plain numbers: one test tells, and the patterns are left alone.
    df = df.withColumn("_p", F.coalesce(t.rlike(PLAIN), F.lit(False))).withColumn("_t", F.when(F.col("_p"), t).otherwise(_words(F.regexp_replace(t, ABOUT, ""))))
    how, patterns = F.col("_how"), {"mixed": MIXED, "span": SPAN, "twice": TWICE, "single": SINGLE}
    df = df.withColumn("_how", F.when(F.col("_p"), "plain").otherwise(F.coalesce(*[F.when(t.rlike(p), k) for k, p in patterns.items()])))

    def part(**group: int) -> Column:
        return F.coalesce(*[F.when(how == k, F.regexp_extract(t, patterns[k], g)) for k, g in group.items()])

    df = df.withColumn("_a", F.when(how == "plain", t).otherwise(part(mixed=1, span=1, twice=1, single=1))).withColumn("_b", part(mixed=3, span=2, twice=3))
    df = df.withColumn("_u1", part(mixed=2, twice=2)).withColumn("inner", part(mixed=4, span=3, twice=4, single=2))
    df = df.withColumn("lo", number(F.col("_a"))).withColumn("hi", F.coalesce(number(F.col("_b")), F.when(how.isin("single", "plain"), F.col("lo"))))
    return df


def _log_gap(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.abs(F.ln(a) - F.ln(b))).otherwise(F.when(a == b, 0.0).otherwise(1e9))


def normalise(quantities: DataFrame, reference: DataFrame) -> DataFrame:
    """All columns of ``quantities`` plus low, high (in the common unit), common_unit, resolution, stated_in, unique, as_is.

    ``quantities``: quantity, value, unit, source_text; ``reference`` (a fixed
    table of a row per quantity): quantity, common_unit, resolution.  Columns of
    the same names as the added ones are replaced.  Rows that state no number or
    no fitting unit have null low and high.  ``stated_in`` is ``value``, ``unit``
    or ``text``; ``unique`` is false where equally good readings differ;
    ``as_is`` marks plain decimals in exactly the common unit.  Nulls, empty and
    long texts are read like any other; repeated rows come out once each.
    """
    added = ["low", "high", "common_unit", "resolution", "stated_in", "unique", "as_is"]
    base = quantities.drop(*added)
    names = base.columns
    ref = reference.select("quantity", "common_unit", F.col("resolution").cast("double").alias("resolution"))
    ref = ref.withColumn("_t_fo", U.factor_offset(F.col("quantity"), F.col("common_unit")))
    df = base.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in names])).select("_row", "quantity", "value", "unit", "source_text")
    # quantity_ref is a fixed table of a few rows
    df = df.join(F.broadcast(ref.dropDuplicates(["quantity"])), "quantity", "left")
    df = _parsed(df)
    q = F.col("quantity")
    df = df.withColumn("_fo_in", F.when(F.length("inner") > 0, U.factor_offset(q, F.col("inner"))))
    df = df.withColumn("_fo_u1", F.when(F.length(F.trim("_u1")) > 0, U.factor_offset(q, F.col("_u1"))))
    df = df.withColumn("_fo_un", F.when(F.length("unit") > 0, U.factor_offset(q, F.col("unit"))))
    # Mentions in the running text: number or span, and a unit that fits the quantity.
    spot = rf"(?<![\w.,])({NUM})(?:{_TO}({NUM}))?\s?({U.mention_pattern()})"
    text = F.regexp_replace(F.translate(F.col("source_text"), "²³⁻¹", "23-1"), r"(?<=[A-Za-z])\^", "")
    # The text is searched once; the parts of a mention are then read from the mention alone.
    mention, part = rf"^({NUM})(?:{_TO}({NUM}))?\s?(.+)$", F.regexp_extract
    df = df.withColumn("_m", F.when(F.col("source_text").rlike(r"\d"), F.regexp_extract_all(text, F.lit(spot), F.lit(0))))
    df = df.withColumn("_m", F.transform("_m", lambda x: F.struct(part(x, mention, 1).alias("a"), part(x, mention, 2).alias("b"), part(x, mention, 3).alias("u"))))
    df = df.withColumn("_said", F.transform("_m", lambda x: F.struct(
        number(x["a"]).alias("lo"), F.coalesce(number(F.nullif(x["b"], F.lit(""))), number(x["a"])).alias("hi"), U.factor_offset(q, x["u"]).alias("fo"))))
    df = df.withColumn("_said", F.coalesce(F.filter("_said", lambda x: x["fo"].isNotNull() & x["lo"].isNotNull()), F.array().cast("array<struct<lo:double,hi:double,fo:array<double>>>")))
    t = F.col("_t_fo")
    common = lambda v, fo: (v * fo[0] + fo[1] - t[1]) / t[0]
    df = df.withColumn("_said", F.transform("_said", lambda x: F.struct(x["lo"].alias("raw_lo"), x["hi"].alias("raw_hi"), common(x["lo"], x["fo"]).alias("lo"), common(x["hi"], x["fo"]).alias("hi"))))
    one = lambda rank, name, lo, hi: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("stated_in"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    lo, hi, how = F.col("lo"), F.col("hi"), F.col("_how")
    fin, fun, fu1 = F.col("_fo_in"), F.col("_fo_un"), F.col("_fo_u1")
    total = common(lo, fu1) + common(hi, fin)
    in_value = F.when(how == "mixed", one(1, "value", total, total)).when(how == "twice", one(1, "value", common(lo, fu1), common(hi, fin))).otherwise(one(1, "value", common(lo, fin), common(hi, fin)))
    bare = F.length(F.coalesce("inner", F.lit(""))) == 0
    from_unit = F.when(bare, one(2, "unit", common(lo, fun), common(hi, fun)))
    said = F.transform(F.filter("_said", lambda x: lo.isNull() | (bare & (_log_gap(x["raw_lo"], lo) < TOLERANCE) & (_log_gap(x["raw_hi"], hi) < TOLERANCE))),
                       lambda x: one(3, "text", x["lo"], x["hi"]))
    df = df.withColumn("_c", F.filter(F.concat(F.array(in_value, from_unit), said), lambda c: c["lo"].isNotNull() & c["hi"].isNotNull()))
    residual = lambda c: F.coalesce(F.array_min(F.transform("_said", lambda x: _log_gap(x["lo"], c["lo"]) + _log_gap(x["hi"], c["hi"]))), F.lit(0.0))
    df = df.withColumn("_c", F.array_sort(F.transform("_c", lambda c: F.struct(F.round(residual(c), 6).alias("residual"), c["rank"].alias("rank"), c["lo"].alias("lo"), c["hi"].alias("hi"), c["stated_in"].alias("stated_in")))))
    best = F.get("_c", F.lit(0))
    df = df.withColumn("_best", best)
    rivals = F.filter("_c", lambda c: (c["residual"] == F.col("_best.residual")) & ((_log_gap(c["lo"], F.col("_best.lo")) > TOLERANCE) | (_log_gap(c["hi"], F.col("_best.hi")) > TOLERANCE)))
    as_is = F.coalesce((F.col("unit") == F.col("common_unit")) & F.col("value").rlike(PLAIN), F.lit(False))
    return df.select(
        *[F.col("_row").getField(c).alias(c) for c in names],
        F.col("_best.lo").alias("low"), F.col("_best.hi").alias("high"), "common_unit", "resolution", F.col("_best.stated_in").alias("stated_in"),
        F.when(F.col("_best").isNotNull(), F.size(rivals) == 0).alias("unique"), as_is.alias("as_is"),
    )


def converted(quantities: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows that needed conversion, in steps of the resolution: quantity_id, low_steps, high_steps."""
    done = normalise(quantities, reference)
    steps = lambda c: F.rint(F.round(F.col(c) / F.col("resolution"), 6)).cast("long")
    row = F.struct("quantity_id", steps("low").alias("low_steps"), steps("high").alias("high_steps"))
    # By inline, as a filter over computed columns would have them computed again below it.
    return done.select(F.inline(F.when(F.col("low").isNotNull() & ~F.col("as_is"), F.array(row))))


#: Identities among the rows of a node: product of quantities with these exponents,
#: in common units, is the constant.  d = 4 V / A with d in nm, V in cm3/g, A in m2/g.
NODE_IDENTITIES = {"mean_pore_width": ({"pore_diameter": 1, "pore_volume": -1, "surface_area": 1}, 4000.0)}
#: The log residual up to which an identity holds: pores are no cylinders, so values may be off by a factor of 1.5.
MOST_RESIDUAL = 0.405


def tried(quantity: str) -> dict[str, float]:
    """All units of a quantity that differ, by their first spelled form, with the factor to its base units."""
    out: dict[str, float] = {}
    num, den = U.IDENTITIES[quantity][0]
    for (b, _), below in U.FORMS[den].items():
        for (a, _), top in U.FORMS[num].items():
            name = top.split("|")[0] + (f"/{below.split('|')[0]}" if den != "one" else "")
            if not any(abs(a / b / f - 1) < 1e-9 for f in out.values()):
                out[name] = a / b
    return out


def infer_units(normalised: DataFrame) -> DataFrame:
    """Units of rows without one, by identities among the quantities of a node.

    ``normalised`` as from ``normalise``.  For each node and identity, one value
    of each quantity is taken (the smallest quantity_id; stated ones first), all
    combinations of the tried units are compared by the log residual of the
    identity, and the least one is returned with the residual and with
    ``unique`` false if another combination comes as close.  Where even the least
    residual is above ``MOST_RESIDUAL`` the identity doesn't hold and there is no
    unit (null, not unique).  Each further row
    without a unit stands in for its quantity beside the values so found of the
    others, and is not unique where these are not.  Per row the work is bounded
    by the number of tried units.  Nodes without a missing unit, or lacking a
    quantity of the identity, give no rows.
    """
    node = ["paper_name", "catalyst_id", "node_id"]
    raw = cut(_parsed(normalised.where(F.col("quantity").isin(*{q for powers, _ in NODE_IDENTITIES.values() for q in powers})).select(*node, "quantity_id", "quantity", "value", "low", "high")).select(*node, "quantity_id", "quantity", "low", "high", "lo", "hi"))
    out = None
    for name, (powers, constant) in NODE_IDENTITIES.items():
        rows = raw.where(F.col("quantity").isin(*powers) & (F.col("low").isNotNull() | (F.col("lo") > 0)))
        pick = F.struct(F.col("low").isNull().alias("open"), F.col("quantity_id").alias("quantity_id"), F.sqrt(F.col("low") * F.col("high")).alias("known"), F.sqrt(F.col("lo") * F.coalesce("hi", "lo")).alias("bare"))
        sets = rows.groupBy(*node).agg(*[F.min(F.when(F.col("quantity") == q, pick)).alias(q) for q in powers])
        full = F.lit(True)
        for q in powers:
            full = full & F.col(q).isNotNull()
        sets = sets.where(full)
        sets = cut(_ranked(sets, powers, constant))
        best = F.col("_r")[0]
        open_one = F.col("open")
        rows_out = F.array(*[F.struct(F.lit(q).alias("quantity"), F.col(f"{q}.quantity_id").alias("quantity_id"), F.when(F.col("_holds"), best["units"][i]).alias("unit"), F.col(f"{q}.open").alias("open")) for i, q in enumerate(powers)])
        got = sets.select(*node, F.lit(name).alias("identity"), F.inline(rows_out), best["residual"].alias("residual"), F.col("_ok").alias("unique")).where(open_one).drop("open")
        # Further rows: every quantity but the row's own has the value found above.
        solved = sets.select(*node, F.col("_ok").alias("_node_ok"), *[F.struct(F.lit(False).alias("open"), F.col(f"{q}.quantity_id").alias("quantity_id"), best["values"][i].alias("known"), F.lit(None).cast("double").alias("bare")).alias(q) for i, q in enumerate(powers)])
        more = join_on(rows.where("low is null").select(*node, "quantity", pick.alias("_pick")), solved, node, "inner")
        taken = F.coalesce(*[F.when(F.col("quantity") == q, F.col("_pick.quantity_id") == F.col(f"{q}.quantity_id")) for q in powers])
        more = more.where(~taken).select(*node, "quantity", "_node_ok", F.col("_pick.quantity_id").alias("quantity_id"), *[F.when(F.col("quantity") == q, F.col("_pick")).otherwise(F.col(q)).alias(q) for q in powers])
        more = _ranked(more, powers, constant)
        unit = F.coalesce(*[F.when(F.col("quantity") == q, best["units"][i]) for i, q in enumerate(powers)])
        got = got.unionByName(more.select(*node, F.lit(name).alias("identity"), "quantity", "quantity_id", F.when(F.col("_holds"), unit).alias("unit"), best["residual"].alias("residual"), (F.col("_ok") & F.col("_node_ok")).alias("unique")))
        out = got if out is None else out.unionByName(got)
    return out


def _ranked(sets: DataFrame, powers: dict[str, int], constant: float) -> DataFrame:
    """The combinations of units in order of residual, ``_r``, and whether the first has no rival, ``_ok``."""
    combos = F.array(F.struct(F.array().cast("array<string>").alias("units"), F.array().cast("array<double>").alias("values"), F.lit(-1.0 * _ln(constant)).alias("log")))
    for q, power in powers.items():
        # Known values are in the common unit, whose factor is that of the first identity's unit.
        common = _common(q)
        options = F.when(F.col(f"{q}.open"), F.array(*[F.struct(F.lit(u).alias("u"), (F.col(f"{q}.bare") * (f / common)).alias("v")) for u, f in tried(q).items()])).otherwise(
            F.array(F.struct(F.lit(None).cast("string").alias("u"), F.col(f"{q}.known").alias("v"))))
        combos = _crossed(combos, options, power)
    ranked = F.array_sort(F.transform(combos, lambda c: F.struct(F.round(F.abs(c["log"]), 6).alias("residual"), c["units"].alias("units"), c["values"].alias("values"))))
    sets = sets.withColumn("_r", ranked).withColumn("_holds", F.col("_r")[0]["residual"] <= MOST_RESIDUAL)
    return sets.withColumn("_ok", F.col("_holds") & (F.size(F.filter("_r", lambda c: c["residual"] <= F.col("_r")[0]["residual"] + TOLERANCE)) == 1))


def _crossed(combos: Column, options: Column, power: int) -> Column:
    return F.flatten(F.transform(combos, lambda c: F.transform(options, lambda o: F.struct(
        F.concat(c["units"], F.array(o["u"])).alias("units"), F.concat(c["values"], F.array(o["v"])).alias("values"), (c["log"] + F.ln(o["v"]) * power).alias("log")))))


def _ln(x: float) -> float:
    from math import log

    return log(x)


def _common(quantity: str) -> float:
    """Factor of the unit in which an identity takes a quantity: nm, cm3/g, m2/g."""
    num, den = U.IDENTITIES[quantity][0]
    return next(a for a, _ in U.FORMS[num] if a == 1) / next(a for a, _ in U.FORMS[den] if a == 1)
