"""Normalisation of unit notation, and extraction of values with units."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regex import ENDS, ND, NOT_WORD, STARTS, WORD, WS, replace_all, spans

# Superscripts, in order of application; the last three keep their case.
SUPERSCRIPTS = [("m", "2", "m²"), ("m", "3", "m³"), ("cm", "2", "cm²"), ("cm", "3", "cm³"), ("mm", "2", "mm²"), ("mm", "3", "mm³"), ("ft", "2", "ft²"), ("ft", "3", "ft³")]
RATES = [("m", "/h", "m³/h"), ("Nm", "/h", "Nm³/h"), ("m", "/s", "m³/s")]

# Notation of units and its normal form, in order of declaration.
UNIT_MAP = {
    "℃": "°C", "℉": "°F", "deg C": "°C", "deg F": "°F", "degC": "°C", "degF": "°F",
    "Bar a": "bar(a)", "Bar g": "bar(g)", "bar a": "bar(a)", "bar g": "bar(g)", "bara": "bar(a)", "barg": "bar(g)",
    "KPa": "kPa", "Kpa": "kPa", "MPa": "MPa", "Mpa": "MPa", "PSI": "psi", "PSIG": "psig", "PSIA": "psia",
    "m /h": "m³/h", "m3/h": "m³/h", "m3/hr": "m³/h", "M3/H": "m³/h", "Nm /h": "Nm³/h", "Nm3/h": "Nm³/h",
    "kg/hr": "kg/h", "KG/H": "kg/h", "t/hr": "t/h", "T/H": "t/h",
    "m ": "m³", "m3": "m³", "M3": "m³", "cubic meter": "m³", "cubic meters": "m³", "liter": "L", "litre": "L",
    "KW": "kW", "Kw": "kW", "MW": "MW", "Mw": "MW", "HP": "hp",
    "MM": "mm", "CM": "cm", "M": "m", "KG": "kg", "Kg": "kg", "TON": "t", "TONS": "t", "%wt": "wt%", "%vol": "vol%",
}

# Spacing of numbers and units, then ranges, tolerances, dimensions and percentages.
SPACING_RULES = [(rf"({ND})([a-zA-Z])", "$1 $2"), (rf"({ND}){WS}+([°℃℉])", "$1$2"), (rf"({ND}){WS}{{2,}}([a-zA-Z])", "$1 $2")]
SPECIAL_RULES = [
    (rf"({ND}+){WS}*[-–—]{WS}*({ND}+){WS}*([a-zA-Z°])", "$1-$2 $3"), (rf"({ND}+){WS}*[±]{WS}*({ND}+)", "$1±$2"),
    (rf"({ND}+){WS}*[xX×]{WS}*({ND}+)", "$1×$2"), (rf"({ND}+){WS}*%", "$1%"),
]

# What follows a number to make a quantity, in order; each ends at a word boundary.
QUANTITY_ENDS = ["[°℃℉]C?", rf"bar{WS}*\(?[ag]\)?", "[kKmM]?Pa", "psi[ag]?", "m[²³]?/[hs]", "[kKtT]/h", "[kKmM]?W", "hp", "[mkc]?m[²³]?", "[kKtT]g?", "%"]


def boundary_before(key: str) -> str:
    """Lookbehind for a word boundary before ``key``."""
    return STARTS if re.match(r"\w", key) else rf"(?<={WORD})"


def boundary_after(key: str) -> str:
    """Lookahead for a word boundary after ``key``."""
    return ENDS if re.search(r"\w$", key) else rf"(?={WORD})"


def unit_keys() -> list[tuple[str, str]]:
    """The unit map, longest notation first; equal lengths as declared."""
    return sorted(UNIT_MAP.items(), key=lambda kv: -len(kv[0]))


def fix_superscripts(text: Column) -> Column:
    """``m 2`` to ``m²`` and the like; no boundary before the unit."""
    rules = [(rf"(?iu){a}{WS}*{b}{ENDS}", to) for a, b, to in SUPERSCRIPTS] + [(rf"{a}{WS}*{b}{ENDS}", to) for a, b, to in RATES]
    return replace_all(text, rules)


def map_units(text: Column, ignore_case: bool = True) -> Column:
    """Every notation of the map between word boundaries to its normal form, the longest first.

    Of the some fifty replacements only those run whose notation the text holds at
    all: normal forms are notations of themselves, so no replacement makes a match
    for a later one.  The text is folded once to look for them.
    """
    flag = "(?iu)" if ignore_case else ""
    # The signs that equal an ASCII letter without regard to case, though their small letter is another.
    fold = (lambda t: F.lower(F.translate(t, "ſıİK", "siik"))) if ignore_case else (lambda t: t)
    rules = F.array(*[
        F.struct(F.lit(k.lower() if ignore_case else k).alias("key"), F.lit(f"{flag}{boundary_before(k)}{re.escape(k)}{boundary_after(k)}").alias("pattern"), F.lit(to).alias("to"))
        for k, to in unit_keys()
    ])
    within = lambda f: F.filter(rules, lambda r: F.contains(f, r["key"]))
    replaced = lambda t: F.aggregate(F.get(F.transform(F.array(fold(t)), within), F.lit(0)), t, lambda out, r: F.regexp_replace(out, r["pattern"], r["to"]))
    return F.get(F.transform(F.array(text), replaced), F.lit(0))


def fix_spacing(text: Column) -> Column:
    """One space between a number and its unit, none before degrees."""
    return replace_all(text, SPACING_RULES)


def fix_special(text: Column) -> Column:
    """Ranges, tolerances, dimensions and percentages."""
    return replace_all(text, SPECIAL_RULES)


def normalize_units(text: Column, superscripts: bool = True, spacing: bool = True, ignore_case: bool = True) -> Column:
    """The stages in order: superscripts, map, spacing, special patterns; null and empty texts stay."""
    out = fix_superscripts(text) if superscripts else text
    out = map_units(out, ignore_case)
    out = fix_spacing(out) if spacing else out
    return F.when(text == "", text).otherwise(fix_special(out))


def quantity_patterns() -> list[str]:
    """Patterns of a number with a unit, in order."""
    out = []
    for end in QUANTITY_ENDS:
        # The last sign of an end may be optional, so the boundary is written for either case.
        close = rf"(?:(?<={WORD}){ENDS}|(?<={NOT_WORD})(?={WORD}))"
        out.append(rf"(?iu){STARTS}{ND}+\.?{ND}*{WS}*{end}{close}")
    return out


def extract_units(rows: DataFrame, id_col: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every value with a unit: ``keep``, ``id_col``, ``pattern_no``, ``seq``, ``text``, ``start``, ``end``, ``normalized``.

    Overlapping matches of different patterns are all kept; the order is by
    pattern, then by place.  Null and empty texts give no rows.
    """

    def hit(n: int):
        return lambda m: F.struct(F.lit(n).alias("pattern_no"), m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("text"))

    per = [F.transform(spans(F.col("_text"), p), hit(n)) for n, p in enumerate(quantity_patterns())]
    own = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    kept = [F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)]
    texts = rows.select(*own, F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").rlike(ND))
    hits = texts.select(*[f"_keep{i}" for i in range(len(keep))], "_id", F.posexplode(F.concat(*per)).alias("seq", "hit"))
    return hits.select(*kept, F.col("_id").alias(id_col), "hit.pattern_no", "seq", "hit.text", "hit.start", "hit.end", normalize_units(F.col("hit.text")).alias("normalized"))


def unit_statistics(units: DataFrame, *groups: str) -> DataFrame:
    """Per group: ``normalized`` with its count, first place and distinct originals; the most common of a group has ``rank`` 1 (ties: first seen)."""
    from pyspark.sql import Window

    counted = units.groupBy(*groups, "normalized").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.count_distinct("text").alias("n_variants"), F.array_sort(F.collect_set("text")).alias("variants"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("n"), "first_seq", "normalized")))
