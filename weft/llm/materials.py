"""Free names mapped to a canonical list (problem 2), with built-in functions only.

Names are folded and stripped of what doesn't change the substance; the reference
list is spelled out into aliases.  What is not an alias exactly goes through a
pigeonhole join: an alias cut into k + 1 segments shares at least one segment, at
a shifted position, with every name within k edits.  Pairs from the join on
positional substrings are verified by ``levenshtein``; an anti-join reports the
rest.  Compounds that can be written with the words of the list but are not in
it are aliases without an entry: a name closest to one of them denotes another
compound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.units import constant_map
from weft.llm.confusables import folded
from weft.session import cut

#: German stems of the words of compound names, and charges of anions by formula.
GERMAN = {
    "copper": "kupfer", "iron": "eisen", "silver": "silber", "sodium": "natrium", "potassium": "kalium", "zinc": "zink", "manganese": "mangan",
    "lanthanum": "lanthan", "praseodymium": "praseodym", "bismuth": "bismut", "titanium": "titan", "cerium": "cer", "tungsten": "wolfram", "tin": "zinn",
    "lead": "blei", "hydrogen": "wasserstoff", "mercury": "quecksilber", "neodymium": "neodym", "molybdenum": "molybdän", "chromium": "chrom",
    "tantalum": "tantal", "niobium": "niob", "platinum": "platin",
}
ANION_CHARGE = {"O": 2, "SO4": 2, "NO3": 1, "C2H3O2": 1, "Cl": 1, "F": 1, "Br": 1, "CO3": 2, "OH": 1, "PO4": 3, "C2O4": 2, "C6H5O7": 3, "I": 1, "S": 2}
#: Other names in use, by canonical name.
SYNONYMS = {
    "zirconium dioxide": "zirconia|zirconium oxide", "titanium dioxide": "titania|titanium oxide", "cerium dioxide": "ceria|cerium oxide",
    "fumed silica": "pyrogenic silica|fumed sio2|pyrogenic sio2|fumed silicon dioxide", "colloidal silica": "silica sol|colloidal sio2|silica colloid",
    "alpha-alumina": "alpha alumina|alumina (alpha)|alpha-al2o3|α-alumina|α-al2o3", "theta-alumina": "theta alumina|alumina (theta)|theta-al2o3|θ-alumina|θ-al2o3",
    "gamma-alumina": "gamma alumina|alumina (gamma)|gamma-al2o3|γ-alumina|γ-al2o3", "beta zeolite": "zeolite beta|h-beta|bea zeolite|zeolite β|β-zeolite|β zeolite",
    "mordenite": "h-mordenite|mor zeolite|mordenite zeolite|zeolite mordenite", "ferrierite": "h-ferrierite|fer zeolite|ferrierite zeolite|zeolite ferrierite", "kaolin": "kaolin clay|china clay",
    "activated carbon": "active carbon|activated charcoal|carbon, activated|active charcoal", "cordierite monolith": "cordierite honeycomb|cordierite honeycombs|cordierite monoliths",
    "polyvinyl alcohol": "poly(vinyl alcohol)|pva|polyvinylalcohol", "ethanol": "ethyl alcohol|etoh|abs. ethanol|absolute ethanol",
    "ethylene glycol": "ethylenglycol|ethane-1,2-diol|meg|1,2-ethanediol", "urea": "carbamide|urea prills", "deionized water": "di water|demineralized water|deionised water|demineralised water",
    "ammonium heptamolybdate": "ahm|ammonium molybdate", "ammonium metatungstate": "amt|ammonium meta-tungstate|ammonium tungstate",
    "ammonium metavanadate": "ammonium vanadate|ammonium meta-vanadate|amv", "tetraethyl orthosilicate": "teos|tetraethoxysilane|tetraethylorthosilicate|ethyl silicate",
    "chloroplatinic acid": "hexachloroplatinic acid|cpa", "boehmite": "pseudoboehmite", "oxalic acid": "ethanedioic acid", "nitric acid": "dilute nitric acid",
}
#: Words around a name that don't change the substance.
AROUND = (
    "aqueous", "solid", "anhydrous", "absolute", "solution", "powder", "powders", "crystals", "pellets", "granules", "flakes", "milled", "ground", "dried", "fresh", "pure",
    "hydrate", "hemihydrate", "monohydrate", "dihydrate", "trihydrate", "tetrahydrate", "pentahydrate", "hexahydrate", "heptahydrate", "octahydrate", "nonahydrate", "decahydrate",
)
MAX_EDITS = 4


def edits_for(length: Column) -> Column:
    """Edits allowed for an alias: none for codes of three, one up to five characters, then one in three, at most ``MAX_EDITS``."""
    return F.when(length < 4, 0).when(length < 6, 1).otherwise(F.least(F.lit(MAX_EDITS), F.floor(length / 3).cast("int")))


def _formula(c: Column) -> Column:
    """A formula without water of crystallisation and with plain digits."""
    c = F.translate(F.regexp_replace(folded(c), r"\s+", " "), "₀₁₂₃₄₅₆₇₈₉", "0123456789")
    return F.trim(F.regexp_replace(c, r"\s*(?:[·.*•]|\bx\b)\s*(?:\d+(?:\.\d+)?|[nx])?\s*H2O\s*$", ""))


def _plain(c: Column) -> Column:
    """Lower-case, single blanks, no grade, lot, strength or brackets of them."""
    c = F.lower(F.trim(F.regexp_replace(folded(c), r"(?U)\s+", " ")))
    c = F.regexp_replace(c, r"\s*,?\s*(?:lot|batch|charge)\b.*$", "")
    c = F.regexp_replace(c, r"\s*\((?:[^()]*%[^()]*|[^()]*grade[^()]*|p\.?a\.?|anhydrous|aq\.?)\)", "")
    c = F.regexp_replace(c, r",?\s*\d+(?:[.,]\d+)?\s*(?:m|mol/l|mol l-1|wt ?%|%)\s*$", "")
    c = F.regexp_replace(c, r"(粉末|溶液|水合物|固体|晶体)$", "")
    c = F.regexp_replace(c, r"^(?:aq\.|abs\.(?! ethanol))\s*", "")
    return F.replace(c, F.lit("sulph"), F.lit("sulf"))


def _state(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(c, r"(?i)\((i{1,3}|iv|v|vi{0,2})\)", 1)), F.lit(""))


def metals(reference: DataFrame) -> DataFrame:
    """Words and symbols of compounds that the list spells as two words with a formula: metal, symbol, anion, state."""
    two = reference.where(F.col("canonical_name").rlike(r"^[a-z]+ [a-z]+$") & F.col("formula").isNotNull())
    cut = rf"^([A-Z][a-z]?)(\d*)\(?({'|'.join(sorted(ANION_CHARGE, key=len, reverse=True))})\)?(\d*)$"
    part = lambda k: F.regexp_extract("formula", cut, k)
    n = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).cast("int"), F.lit(1))
    charge = F.element_at(constant_map(ANION_CHARGE, "map<string,int>"), part(3))
    roman = F.get(F.array(*[F.lit(x) for x in ("I", "II", "III", "IV", "V", "VI")]), (n(4) * charge / n(2)).cast("int") - 1)
    word = lambda k: F.split("canonical_name", " ")[k]
    return two.where(F.col("formula").rlike(cut)).select("material_id", word(0).alias("metal"), word(1).alias("anion"), part(1).alias("symbol"), roman.alias("state"))


def aliases(reference: DataFrame) -> DataFrame:
    """The list spelled out: alias, material_id (null for a compound that is not in the list), state, kind (``name`` or ``formula``).

    The list is small; the other compounds are its own metals by its own anions.
    """
    m = cut(metals(reference))
    german = constant_map(GERMAN, "map<string,string>")
    pairs = _combinations(m).join(m, ["metal", "symbol", "anion"], "left").select("metal", "symbol", F.regexp_replace("anion", "^di(?=oxide)", "").alias("anion"), "material_id", "state").groupBy("metal", "symbol", "anion").agg(F.max("material_id").alias("material_id"), F.max("state").alias("state"))
    stem = F.coalesce(F.element_at(german, F.col("metal")), F.col("metal"))
    spelled = F.array(F.concat_ws(" ", "metal", "anion"), F.concat_ws(" ", F.lower("symbol"), "anion"), F.concat(stem, F.regexp_replace("anion", "e$", "")))
    names = pairs.select(F.explode(spelled).alias("alias"), "material_id", "state")
    extra = constant_map({k: v.split("|") for k, v in SYNONYMS.items()}, "map<string,array<string>>")
    listed = F.concat(F.array(F.lower("canonical_name"), F.col("name_zh")), F.coalesce(F.element_at(extra, F.col("canonical_name")), F.array().cast("array<string>")))
    direct = reference.select(F.explode(listed).alias("alias"), "material_id", F.lit(None).cast("string").alias("state"))
    direct = direct.join(m.select("material_id", F.col("state").alias("s")), "material_id", "left").select("alias", "material_id", F.col("s").alias("state"))
    text = names.unionByName(direct).where("alias is not null and alias <> ''").groupBy("alias").agg(F.max("material_id").alias("material_id"), F.max("state").alias("state"))
    formulas = reference.where("formula is not null").groupBy(F.col("formula").alias("alias")).agg(F.max("material_id").alias("material_id"))
    return text.select("alias", "material_id", "state", F.lit("name").alias("kind")).unionByName(formulas.select("alias", "material_id", F.lit(None).cast("string").alias("state"), F.lit("formula").alias("kind")))


def _combinations(m: DataFrame) -> DataFrame:
    """Every metal of the list with every anion of the list; the anions, a few words, become one constant."""
    anions = sorted(r["anion"] for r in m.select("anion").distinct().collect())
    return m.select("metal", "symbol").distinct().select("metal", "symbol", F.explode(F.array(*[F.lit(a) for a in anions]) if anions else F.array().cast("array<string>")).alias("anion"))


def variants(names: DataFrame) -> DataFrame:
    """Ways to read each distinct name: name, variant, state, kind."""
    df = names.select("name", _formula(F.col("name")).alias("f"), _plain(F.col("name")).alias("p"), _state(F.col("name")).alias("state"))
    df = df.withColumn("p", F.trim(F.regexp_replace("p", r"\s*\((?:i{1,3}|iv|v|vi{0,2})\)\s*", " ")))
    df = df.withColumn("p", F.regexp_replace("p", r"\s*[·.*•]\s*(?:\d+|[nx])?\s*h2o$", ""))
    # Words near a word of AROUND go, unless nothing would be left.
    known = F.array(*[F.lit(w) for w in AROUND])
    words = F.split("p", " ")
    around = lambda w: F.exists(known, lambda k: F.when(F.length(k) < 6, w == k).otherwise(F.levenshtein(w, k, 2) >= 0))
    kept = F.filter(words, lambda w: ~around(w))
    df = df.withColumn("q", F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.col("p")))
    df = df.withColumn("q", F.regexp_replace("q", r"[\s,;]+$", ""))
    turned = F.regexp_replace("q", r"^(\S+?)\s*(?:,| -| of|, of)\s+(\S+)$", "$2 $1")
    spaced = F.regexp_replace("q", r"^([^\s-]+)-([^\s-]+)$", "$1 $2")
    long_ = F.regexp_replace(F.regexp_replace("q", r"\b(oxid|sulf|acet|brom|carb|citr|nitr|oxal|hydr|phos|chlo|fluo)\.$", "$1~"), "~$", "~")
    full = constant_map({"oxid": "oxide", "sulf": "sulfate", "acet": "acetate", "brom": "bromide", "carb": "carbonate", "citr": "citrate", "nitr": "nitrate", "oxal": "oxalate", "hydr": "hydroxide", "phos": "phosphate", "chlo": "chloride", "fluo": "fluoride"}, "map<string,string>")
    short = F.regexp_extract(long_, r"(\w{4})~$", 1)
    written = F.when(short != "", F.concat(F.regexp_replace(long_, r"\w{4}~$", ""), F.element_at(full, short)))
    single = F.regexp_replace("q", r"s$", "")
    read = F.array_distinct(F.filter(F.array("p", "q", turned, spaced, single, written), lambda v: v.isNotNull() & (v != "")))
    rows = F.concat(F.transform(read, lambda v: F.struct(v.alias("variant"), F.lit("name").alias("kind"))), F.array(F.struct(F.col("f").alias("variant"), F.lit("formula").alias("kind"))))
    return df.select("name", "state", F.inline(rows))


def _segments(aliases: DataFrame) -> DataFrame:
    """Each alias of edits k cut into k + 1 segments: alias, len, k, i, at (0-based), seg."""
    a = aliases.where("kind = 'name'").select("alias", F.length("alias").alias("len")).distinct().withColumn("k", edits_for(F.col("len"))).where("k > 0")
    a = a.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    a = a.withColumn("at", F.floor(F.col("i") * F.col("len") / (F.col("k") + 1)).cast("int")).withColumn("to", F.floor((F.col("i") + 1) * F.col("len") / (F.col("k") + 1)).cast("int"))
    return a.select("alias", "len", "k", "i", "at", F.expr("substring(alias, at + 1, to - at)").alias("seg"))


def near(left: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs of a variant and an alias within the alias's edits: variant, alias, edits.

    For each length an alias may have, a variant yields its substrings where a
    segment could stand: shifted by at most i to one side, and by at most k - i
    beyond the difference of lengths, as edits before and after it must suffice.
    """
    segs = _segments(aliases)
    shape = segs.select("len", "k", "i", "at", F.length("seg").alias("width")).distinct()
    shapes = shape.groupBy("len").agg(F.collect_list(F.struct("k", "i", "at", "width")).alias("parts"))
    # Variants are short, but each makes many substrings: they are spread over all cores before that.
    v = left.select("variant", F.length("variant").alias("n")).distinct().repartition(left.sparkSession.sparkContext.defaultParallelism, "variant")
    v = v.select("variant", "n", F.explode(F.sequence(F.col("n") - MAX_EDITS, F.col("n") + MAX_EDITS)).alias("len")).where("len > 0")
    v = v.join(shapes, "len").select("variant", "n", "len", F.inline("parts")).where("abs(n - len) <= k")
    low = F.greatest(F.lit(0), F.expr("at - i"), F.expr("at + n - len - (k - i)"))
    high = F.least(F.expr("n - width"), F.expr("at + i"), F.expr("at + n - len + (k - i)"))
    v = v.select("variant", "len", "i", "width", low.alias("lo"), high.alias("hi")).where("lo <= hi").select("variant", "len", "i", "width", F.explode(F.sequence("lo", "hi")).alias("pos"))
    v = v.select("variant", "len", "i", F.expr("substring(variant, pos + 1, width)").alias("seg")).distinct()
    pairs = v.join(segs.select("alias", "len", "i", "k", "seg"), ["len", "i", "seg"]).select("variant", "alias", "k").distinct()
    return pairs.withColumn("edits", F.expr("levenshtein(variant, alias, k)")).where("edits >= 0").select("variant", "alias", "edits")


def match(names: DataFrame, reference: DataFrame) -> DataFrame:
    """The entry of each distinct name: name, material_id, alias, edits; material_id is null for names without an entry.

    ``names``: name and n (how many rows carry it); ``reference``: material_id,
    canonical_name, formula, name_zh (formula and name_zh may be null).  The
    alias with the fewest edits wins; among equals, the one that more rows name
    exactly, then the smaller one.  A stated oxidation state that is not that of
    the entry's formula makes it another compound.  Blank names have no entry.
    """
    table = cut(aliases(reference))
    names = cut(names)
    read = cut(variants(names.where(F.trim("name") != "")))
    sure = read.join(table, (read["variant"] == table["alias"]) & (read["kind"] == table["kind"])).select("name", read["state"].alias("said"), "alias", "material_id", table["state"].alias("state"), F.lit(0).alias("edits"))
    open_ = read.where("kind = 'name'").join(sure.select("name").distinct(), "name", "left_anti")
    pairs = cut(near(open_, table))
    loose = open_.join(pairs, "variant").join(table.where("kind = 'name'").select("alias", "material_id", F.col("state").alias("s")), "alias").select("name", F.col("state").alias("said"), "alias", "material_id", F.col("s").alias("state"), "edits")
    weights = sure.join(names.select("name", "n"), "name").groupBy("alias").agg(F.sum("n").alias("weight"))
    both = sure.unionByName(loose).join(weights, "alias", "left")
    best = both.groupBy("name").agg(F.min_by(F.struct("alias", "material_id", "edits", "said", "state"), F.struct("edits", (-F.coalesce("weight", F.lit(0))).alias("w"), "alias")).alias("b"))
    found = best.select("name", "b.alias", "b.edits", F.when(F.col("b.said").isNull() | F.col("b.state").isNull() | (F.col("b.said") == F.col("b.state")), F.col("b.material_id")).alias("material_id"))
    # The unmatched come from the anti-join.
    rest = names.select("name").join(found.select("name"), "name", "left_anti").select("name", F.lit(None).cast("string").alias("alias"), F.lit(None).cast("int").alias("edits"), F.lit(None).cast("long").alias("material_id"))
    return found.unionByName(rest)


def map_names(nodes: DataFrame, reference: DataFrame) -> DataFrame:
    """``nodes`` of type chemical with the entry of their name: row_id, name, material_id, canonical_name, exact.

    Distinct names are matched, so a name on a third of all rows is matched once.
    Null names are left out.
    """
    rows = nodes.where("type = 'chemical' and name is not null").select("row_id", "name")
    found = match(rows.groupBy("name").agg(F.count("*").alias("n")), reference)
    listed = reference.select("material_id", "canonical_name")
    return rows.join(found, "name").join(listed, "material_id", "left").select("row_id", "name", "material_id", "canonical_name", F.coalesce(F.col("name") == F.col("canonical_name"), F.lit(False)).alias("exact"))
