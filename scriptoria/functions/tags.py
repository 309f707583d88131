"""Equipment tags: normal form, extraction, replacement, validation, and the parts of an instrument tag."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regex import LETTER, ND, WS, spans, strip

_SEP = rf"(?:-|{WS})?"
_TAIL = f"{LETTER}?"


def _any_case(letters: str) -> str:
    fold = {"K": "K", "S": "ſ", "I": "İı"}
    return "[" + "".join(c + c.lower() + fold.get(c, "") for c in letters) + "]"


# Tag types in order of priority.
PATTERNS: list[tuple[str, str]] = [
    ("valve", f"{LETTER}{{2,3}}{_SEP}{ND}{{3,5}}{_TAIL}"),
    ("pump", f"{_any_case('P')}{_SEP}{ND}{{3,4}}{_TAIL}"),
    ("compressor", f"{_any_case('CK')}{_SEP}{ND}{{3,5}}{_TAIL}"),
    ("vessel", f"{_any_case('VDT')}{_SEP}{ND}{{3,4}}{_TAIL}"),
    ("heat_exchanger", f"{_any_case('EH')}{_SEP}{ND}{{3,4}}{_TAIL}"),
    ("instrument", f"{_any_case('PTFL')}{_any_case('IQRCAHLS')}{{1,2}}{_SEP}{ND}{{3,5}}{_TAIL}"),
    ("general", f"{LETTER}{{2,4}}{_SEP}{ND}{{2,5}}{_TAIL}"),
]
ISA_PATTERNS: list[tuple[str, str]] = [
    *((name, f"{_any_case(letter)}{_any_case('IQRCAHLS')}{{1,3}}{_SEP}{ND}{{3,5}}{_TAIL}") for name, letter in (("flow", "F"), ("pressure", "P"), ("temperature", "T"), ("level", "L"), ("analysis", "A"))),
    *(p for p in PATTERNS if p[0] != "instrument"),
]
# Meaning of the first and of the following letters of an instrument tag.
VARIABLES = {"F": "Flow", "P": "Pressure", "T": "Temperature", "L": "Level", "A": "Analysis", "V": "Vibration", "E": "Voltage", "I": "Current", "Q": "Quantity", "S": "Speed", "W": "Weight", "Z": "Position"}
FUNCTIONS = {"I": "Indicator", "C": "Controller", "T": "Transmitter", "S": "Switch", "V": "Valve", "E": "Element", "A": "Alarm", "H": "High", "L": "Low", "R": "Recorder", "Q": "Totalizer"}


def pattern_by_name(name: str, patterns: list[tuple[str, str]] = PATTERNS) -> tuple[str, str] | None:
    """The first pattern of a type; None where there is none."""
    return next((p for p in patterns if p[0] == name), None)


def normalize_tag(tag: Column, uppercase: bool = True, standardize: bool = True, remove_spaces: bool = True, separator: str = "-") -> Column:
    """Normal form of a tag; null and empty stay."""
    out = strip(tag)
    out = F.upper(out) if uppercase else out
    if standardize:
        out = F.regexp_replace(out, rf"(?:{WS}|[-_/\\])+", separator.replace("\\", "\\\\").replace("$", "\\$"))
    elif remove_spaces:
        out = F.replace(out, F.lit(" "), F.lit(""))
    kept = re.escape(separator) if standardize else "-"
    return F.when(tag == "", tag).otherwise(F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}_{kept}]", ""))


def tag_hits(text: Column, patterns: list[tuple[str, str]] = PATTERNS, **how) -> Column:
    """Tags of a text in order of place: array of (start, prio, end, original, type, normalized).

    Of each normal form only the first hit by pattern order, then place, is kept.
    """
    none = F.array().cast("array<struct<start:int,prio:int,end:int,original:string,type:string,normalized:string>>")

    def hit(prio: int, kind: str):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(prio).alias("prio"), m["end"].alias("end"), m["match"].alias("original"), F.lit(kind).alias("type"), normalize_tag(m["match"], **how).alias("normalized"))

    hits = F.concat(none, *[F.transform(spans(text, p), hit(n, kind)) for n, (kind, p) in enumerate(patterns)])
    first = F.aggregate(hits, none, lambda kept, h: F.when(F.exists(kept, lambda k: k["normalized"] == h["normalized"]), kept).otherwise(F.concat(kept, F.array(h))))
    return F.array_sort(first)


def extract_tags(rows: DataFrame, id_col: str, text_col: str = "text", patterns: list[tuple[str, str]] = PATTERNS, limit: int | None = None, **how) -> DataFrame:
    """One row for each tag of a text: ``id_col``, ``seq``, ``original``, ``normalized``, ``type``, ``start``, ``end``.

    ``limit`` reads only so many characters, where a caller wants that; the
    default reads whole texts.  Null and empty texts give no rows.
    """
    text = F.col("_text") if limit is None else F.substring("_text", 1, limit)
    own = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").rlike(ND))
    hits = own.select("_id", F.posexplode(tag_hits(text, patterns, **how)).alias("seq", "h"))
    return hits.select(F.col("_id").alias(id_col), "seq", "h.original", "h.normalized", "h.type", "h.start", "h.end")


def replace_tags(text: Column, patterns: list[tuple[str, str]] = PATTERNS, normalize: bool = True, **how) -> Column:
    """Text with the kept hits replaced by their normal forms, from right to left."""
    if not normalize:
        return text
    hits = F.reverse(tag_hits(text, patterns, **how))
    return F.aggregate(hits, text, lambda t, h: F.concat(F.substring(t, F.lit(1), h["start"]), h["normalized"], F.substring(t, h["end"] + 1, F.length(t))))


def tag_type(tag: Column, patterns: list[tuple[str, str]] = PATTERNS, **how) -> Column:
    """Type of the first pattern that the whole normal form matches; null where none does."""
    own = normalize_tag(tag, **how)
    out = F.lit(None).cast("string")
    for name, p in reversed(patterns):
        out = F.when(own.rlike(rf"\A(?:{p})\z"), F.lit(name)).otherwise(out)
    return out


def validate_tag(tag: Column, patterns: list[tuple[str, str]] = PATTERNS, **how) -> Column:
    """Struct of ``valid``, ``normalized``, ``type`` and ``message`` (null where valid)."""
    kind = tag_type(tag, patterns, **how)
    return F.struct(kind.isNotNull().alias("valid"), normalize_tag(tag, **how).alias("normalized"), kind.alias("type"), F.when(kind.isNull(), F.lit("Tag does not match any known pattern")).alias("message"))


def group_tags(tags: DataFrame, *groups: str) -> DataFrame:
    """Per group and type: the normal forms in order of place."""
    return tags.groupBy(*groups, "type").agg(F.array_sort(F.collect_list(F.struct("seq", "normalized"))).alias("_t")).select(*groups, "type", F.transform("_t", lambda t: t["normalized"]).alias("tags"))


def tag_statistics(tags: DataFrame, *groups: str) -> DataFrame:
    """Per group: ``total_tags``, ``unique_tags``, ``most_common_type`` (ties: the type seen first) and its count."""
    per = tags.groupBy(*groups, "type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.collect_set("normalized").alias("_s"))
    best = F.max_by("type", F.struct("n", -F.col("first_seq"), "type"))
    return per.groupBy(*groups).agg(F.sum("n").alias("total_tags"), F.sum(F.size("_s")).alias("unique_tags"), best.alias("most_common_type"), F.max("n").alias("most_common_count"))


def _meaning(code: Column, names: dict[str, str]) -> Column:
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def parse_isa_tag(tag: Column, **how) -> Column:
    """Struct of the parts of an instrument tag; ``valid`` is false where the normal form doesn't begin as one."""
    own = normalize_tag(tag, **how)
    pattern = rf"\A([A-Z])([A-Z]{{0,3}})-?({ND}{{3,5}})([A-Z])?"
    valid = F.coalesce(own.rlike(pattern), F.lit(False))
    part = lambda n: F.when(valid, F.regexp_extract(own, pattern, n))
    codes = F.filter(F.split(part(2), "", -1), lambda c: c != "")
    return F.struct(
        valid.alias("valid"), own.alias("tag"), _meaning(part(1), VARIABLES).alias("variable"), part(1).alias("variable_code"),
        F.transform(codes, lambda c: _meaning(c, FUNCTIONS)).alias("functions"), codes.alias("function_codes"), part(3).alias("loop_number"), part(4).alias("suffix"),
    )
