"""Regular-expression building blocks with one meaning for all Unicode text.

The engine's ``\\s``, ``\\d``, ``\\w`` and ``\\b`` cover ASCII only; the classes here
cover Unicode and are written so that Java and RE2 read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, decimal digits, word characters; for use in and out of brackets.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
ND = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
#: Word boundaries before and after a word character.
STARTS = rf"(?<!{WORD})"
ENDS = rf"(?!{WORD})"
#: ASCII letters in either case and the letters that fold into them.
LETTER = "[A-Za-zſİıK]"


def strip(text: Column) -> Column:
    """Text without Unicode white space at either end."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def strip_lines(text: Column) -> Column:
    """Text with every line stripped."""
    return F.array_join(F.transform(F.split(text, "\n", -1), strip), "\n")


def is_upper(text: Column) -> Column:
    """True if there are letters with case and none of them is lower case."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def replace_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) rules in order."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def replace_first(text: Column, what: Column, by: Column) -> Column:
    """Replace the first literal occurrence; the text itself where there is none."""
    at = F.position(what, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + F.length(what), F.length(text)))).otherwise(text)


def spans(text: Column, pattern: str) -> Column:
    """All matches with their places: array of (match, start, end), in code points.

    The places follow from the pieces between the matches; an empty array where
    nothing matches, null for a null text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Bound to a lambda variable, else the text would be split again for every match.
    parts = F.array(F.struct(found.alias("m"), F.split(text, pattern, -1).alias("g")))

    def size(items: Column, n: Column) -> Column:
        return F.aggregate(F.slice(items, F.lit(1), n), F.lit(0), lambda total, x: total + F.length(x))

    def places(s: Column) -> Column:
        def one(match: Column, i: Column) -> Column:
            at = F.array(size(s["g"], i + 1) + size(s["m"], i))
            return F.get(F.transform(at, lambda a: F.struct(match.alias("match"), a.alias("start"), (a + F.length(match)).alias("end"))), F.lit(0))

        return F.transform(s["m"], one)

    return F.get(F.transform(parts, places), F.lit(0))
