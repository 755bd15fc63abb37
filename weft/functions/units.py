"""Units: spelled forms, dimensions and factors, and the expressions that read them.

A unit text is a numerator over a denominator.  What a spelled form means depends
on the dimension that is asked for (``C`` is a temperature or a charge, ``h`` an
hour, ``A`` an angstrom or an ampere), so forms are looked up under a dimension.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.  Dimension: {factor to the base unit: spelled forms}; the base unit
#: has factor 1.  Temperatures carry an offset as well: base = value * factor + offset.
FORMS: dict[str, dict[tuple[float, float], str]] = {
    "temperature": {
        (1, 0): "K|kelvin|Kelvin|kelvins|deg K|°K|degrees K|degrees Kelvin",
        (1, 273.15): "C|°C|° C|℃|degC|deg C|deg. C|degrees C|Celsius|celsius|degrees Celsius|degree C|oC",
        (5 / 9, 273.15 - 32 * 5 / 9): "F|°F|° F|℉|degF|deg F|deg. F|degrees F|Fahrenheit|fahrenheit|degrees Fahrenheit",
        (5 / 9, 0): "°R|Rankine|degR",
    },
    "step": {
        (1, 0): "K|kelvin|Kelvin|deg K|C|°C|° C|℃|degC|deg C|deg. C|degrees C|Celsius|celsius",
        (5 / 9, 0): "F|°F|° F|℉|degF|deg F|deg. F|degrees F|Fahrenheit|fahrenheit",
    },
    "time": {
        (1, 0): "s|sec|secs|sec.|second|seconds|Sekunden|秒",
        (60, 0): "min|min.|mins|mins.|minute|minutes|Minuten|分钟|分",
        (3600, 0): "h|h.|hr|hr.|hrs|hrs.|hour|hours|Stunde|Stunden|小时",
        (86400, 0): "d|d.|day|days|Tag|Tage|天",
        (604800, 0): "week|weeks|wk", (1e-3, 0): "ms|millisecond|milliseconds",
    },
    "pressure": {
        (1, 0): "Pa|pascal|pascals", (100, 0): "hPa|mbar|millibar|millibars", (1e3, 0): "kPa|kpa|KPa|kilopascal|kilopascals",
        (1e6, 0): "MPa|Mpa|megapascal|megapascals", (1e5, 0): "bar|bars|bar(a)|bara|bar a|bar abs", (1e9, 0): "GPa",
        (101325, 0): "atm|atm.|atmosphere|atmospheres", (101325 / 760, 0): "Torr|torr|mmHg|mm Hg",
        (6894.757293168361, 0): "psi|psia|psi(a)",
    },
    "force": {(1, 0): "N|newton|newtons", (4.4482216152605, 0): "lbf", (1e3, 0): "kN"},
    "area": {(1, 0): "m2|sq m|sq. m|square metre|square metres", (1e-4, 0): "cm2|sq cm", (1e-6, 0): "mm2", (1e-18, 0): "nm2", (0.00064516, 0): "in2|sq in"},
    "volume": {
        (1, 0): "cm3|mL|ml|cc|millilitre|millilitres|milliliter|milliliters|ccm|Ncm3|NmL",
        (1e3, 0): "L|l|dm3|litre|litres|liter|liters", (1e-3, 0): "mm3|µL|uL|µl|ul|microlitre|microlitres", (1e6, 0): "m3",
    },
    "length": {
        (1, 0): "nm|nanometre|nanometres|nanometer|nanometers", (0.1, 0): "Å|A|angstrom|angstroms|Angstrom|Angstroms|ångström|Ångström",
        (1e3, 0): "µm|um|micron|microns|micrometre|micrometres|micrometer|micrometers", (1e6, 0): "mm", (1e7, 0): "cm", (1e-3, 0): "pm",
    },
    "mass": {
        (1, 0): "g|g.|gm|gms|gram|grams|gramme|grammes|克", (1e-3, 0): "mg|mgs|milligram|milligrams|毫克",
        (1e3, 0): "kg|Kg|KG|kgs|kilogram|kilograms|千克", (1e-6, 0): "µg|ug|microgram|micrograms", (1e6, 0): "t|tonne|tonnes", (453.59237, 0): "lb|lbs",
    },
    "fraction": {
        (1, 0): "mass fraction|wt fraction|weight fraction|wt. fraction|fraction by weight",
        (1e-2, 0): "wt%|wt %|wt.%|wt. %|w%|mass%|mass %|mass-%|weight %|weight-%|weight percent|mass percent|wt-%|% by weight|% by mass|% (w/w)|% w/w|%(w/w)|wtpct",
        (1e-6, 0): "ppmw|ppm by weight|ppm (w/w)|wtppm|wt ppm|ppm w/w",
    },
    "one": {(1, 0): "1|"},
}
#: Physical identities: a quantity is a quotient of dimensions, in one or more ways.
IDENTITIES: dict[str, tuple[tuple[str, str], ...]] = {
    "temperature": (("temperature", "one"),),
    "time": (("time", "one"),),
    "pressure": (("pressure", "one"), ("force", "area")),
    "surface_area": (("area", "mass"),),
    "pore_volume": (("volume", "mass"),),
    "pore_diameter": (("length", "one"),),
    "mass": (("mass", "one"),),
    "loading": (("fraction", "one"), ("mass", "mass")),
    "flow_rate": (("volume", "time"),),
    "heating_rate": (("step", "time"),),
    "space_velocity": (("one", "time"),),
}
#: The forms that end in a percent sign and the like come whole; no slash in them divides.
_WHOLE = {f for fs in FORMS["fraction"].values() for f in fs.split("|")}

_SUP = ("²³⁻¹−–μ", "23-1--µ")


def _all_forms() -> list[str]:
    return sorted({f for d, fs in FORMS.items() if d != "one" for spelled in fs.values() for f in spelled.split("|")}, key=lambda f: (-len(f), f))


def tidy(c: Column) -> Column:
    """One notation for a unit text: ``m² g⁻¹``, ``m^2/g``, ``m2.g-1`` and ``m2 per g`` all become ``m2/g``.

    Blanks around it go; null stays null; forms with a slash of their own stay whole.
    """
    t = F.translate(F.btrim(c, F.lit(" \t    ")), *_SUP)
    whole = t.isin(*sorted(_WHOLE))
    u = F.regexp_replace(t, r"\^", "")
    u = F.regexp_replace(u, r"\bper\b\s*", "/")
    u = F.regexp_replace(u, r"[\s.·*]*\b([A-Za-zµ]+)\s?-1\b", "/$1")
    u = F.regexp_replace(u, r"\s*/\s*", "/")
    # A form of letters alone is what it is; only the others are worked on.
    return F.when(whole | ~t.rlike(r"[\s/^.·*\-]|per"), t).otherwise(F.regexp_replace(u, r"^1/", "/"))


def constant_map(d: dict, kind: str) -> Column:
    """A map as one constant; it is folded once, while a call of create_map swells every plan."""
    return F.from_json(F.lit(json.dumps(d)), kind)


def _lookup() -> Column:
    """Forms by dimension; a map is searched entry by entry, so two small ones are faster than one of all."""
    forms = {d: {f: [float(a), float(b)] for (a, b), spelled in fs.items() for f in spelled.split("|")} for d, fs in FORMS.items()}
    return constant_map(forms, "map<string,map<string,array<double>>>")


def _ways(quantity: Column) -> Column:
    return F.element_at(constant_map({q: [{"num": n, "den": d} for n, d in ways] for q, ways in IDENTITIES.items()}, "map<string,array<struct<num:string,den:string>>>"), quantity)


def factor_offset(quantity: Column, unit: Column) -> Column:
    """Factor and offset of a unit text for a quantity, as array; null if it doesn't measure the quantity.

    Readings of numerator and denominator are combined under each identity of
    the quantity; a combination counts if its dimensions match it exactly.
    """
    table, unit = _lookup(), tidy(unit)
    parts = F.transform(F.array(unit), lambda u: F.when(u.isin(*sorted(_WHOLE)), F.array(u, F.lit(""))).otherwise(F.split(u, "/", 2)))
    each = F.transform(parts, lambda p: F.transform(_ways(quantity), lambda w: F.struct(
        F.element_at(F.element_at(table, w["num"]), p[0]).alias("a"),
        F.element_at(F.element_at(table, w["den"]), F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("b"),
    )))
    fits = F.filter(F.flatten(each), lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    return F.get(F.transform(fits, lambda x: F.array(x["a"][0] / x["b"][0], x["a"][1])), F.lit(0))


def convert(value: Column, quantity: Column, source: Column, target: Column) -> Column:
    """``value`` of a quantity from one unit to another; null where a unit doesn't measure it."""
    s, t = factor_offset(quantity, source), factor_offset(quantity, target)
    return (value * s[0] + s[1] - t[1]) / t[0]


def mention_pattern() -> str:
    """A unit as it stands in running text (superscripts written plain), after a number: a form, perhaps divided by another."""
    from re import escape

    forms = [f for f in _all_forms() if f]
    atom = "(?:" + "|".join(escape(f) for f in forms) + ")"
    over = rf"(?:\s?/\s?{atom}|[ .·]{atom}-1|\s+per\s+{atom})"
    return rf"(?:(?:1?/\s?|per\s+){atom}|{atom}-1|(?:sq\.? )?{atom}{over}?)(?![A-Za-zµ])"
