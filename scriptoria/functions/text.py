"""Text normalisation: control signs, Unicode repair, white space, punctuation, paragraphs, protected parts.

All functions map a string column to a column; null and empty texts stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .regex import ND, WS, is_upper, replace_all, replace_first, strip, strip_lines

# Mis-decoded sequences and their repair, in order of application.
MOJIBAKE = [
    ("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ('â€"', "–"), ("â€¦", "..."), ("Ã©", "é"), ("Ã¨", "è"), ("Ã ", "à"), ("Ã§", "ç"), ("Ã±", "ñ"),
    (" ", " "), (" ", "\n"), (" ", "\n\n"),
]

# Rules of the white-space stage (before lines are stripped) and of the punctuation stage.
SPACE_RULES = [(" +", " "), ("\t+", " "), ("\r\n", "\n"), ("\r", "\n"), ("\n{3,}", "\n\n")]
PUNCTUATION_RULES = [
    (rf"{WS}+([.,;:!?])", "$1"), ("([.,;:!?])([A-Za-z])", "$1 $2"), (rf'{WS}+"', '"'), (rf'"{WS}+', '"'), (rf"{WS}+\)", ")"), (rf"\({WS}+", "("),
    (rf"{WS}+-{WS}+", " - "), (rf"({ND}+){WS}*-{WS}*({ND}+)", "$1-$2"), (rf"\.{WS}+\.{WS}+\.", "..."), (r"\.{4,}", "..."),
]

# Openings of a new paragraph, besides short lines in capitals.
PARAGRAPH_STARTS = rf"^{ND}+[.)]{WS}+|^[-•*]{WS}+|^[A-Z][^.!?]*:{WS}*$"

# Equations that stay as they are, with the prefix of their placeholders.
EQUATIONS = [(r"\$[^$]+\$", "MATH"), (r"\\\([^)]+\\\)", "MATH"), (r"\\\[[^\]]+\\\]", "MATHBLOCK")]


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the column ``_text`` in composed form."""
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        made = [t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(made, batch.schema.field(at).type))


def remove_control(text: Column) -> Column:
    """Every sign of a Unicode category C, except line feed, carriage return and tab, becomes a space."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\r\t]]", " ")


def fix_unicode(text: Column) -> Column:
    """Composed accents, mis-decoded sequences repaired in order, zero-width signs deleted."""
    # Only texts with other than ASCII signs go to Python; for the rest it sees a null.
    return _repair(F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text))


def _repair(text: Column) -> Column:
    for bad, good in MOJIBAKE:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return F.regexp_replace(text, "[​‌‍﻿]", "")


def fix_spaces(text: Column) -> Column:
    """Runs of spaces and of tabs to one space, one kind of line end, no more than one blank line, lines stripped."""
    return strip_lines(replace_all(text, SPACE_RULES))


def fix_punctuation(text: Column) -> Column:
    """Spacing around punctuation, quotes, brackets, dashes and ellipses."""
    return replace_all(text, PUNCTUATION_RULES)


def normalize_text(text: Column, control: bool = True, unicode: bool = True, spaces: bool = True, punctuation: bool = True) -> Column:
    """The stages in order, each on its switch, then strip."""
    out = text
    for on, stage in ((control, remove_control), (unicode, fix_unicode), (spaces, fix_spaces), (punctuation, fix_punctuation)):
        out = stage(out) if on else out
    return F.when(text == "", text).otherwise(strip(out))


def starts_paragraph(line: Column) -> Column:
    """True for a stripped line that opens a paragraph: number, bullet, label with colon, or up to five words in capitals."""
    return line.rlike(PARAGRAPH_STARTS) | (is_upper(line) & (F.size(F.filter(F.split(line, rf"{WS}+", -1), lambda w: w != "")) <= 5))


def paragraphs(text: Column, split: bool = True, **switches: bool) -> Column:
    """Array of the paragraphs of the normalised text; empty for null and blank texts.

    Blocks end at blank lines; within a block a line that ``starts_paragraph``
    begins a new one; lines are joined by a space.
    """
    clean = normalize_text(text, **switches)
    none = F.array().cast("array<string>")
    if not split:
        return F.when(F.coalesce(clean, F.lit("")) == "", none).otherwise(F.array(clean))

    def of_block(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n", -1), strip), lambda x: x != "")
        # Lines that go on are joined by a space, the others by a line feed, which no line holds; then one split.
        marked = F.transform(lines, lambda x, i: F.concat(F.when(i == 0, "").when(starts_paragraph(x), "\n").otherwise(" "), x))
        return F.split(F.array_join(marked, ""), "\n", -1)

    blocks = F.split(F.coalesce(clean, F.lit("")), "\n\n", -1)
    return F.filter(F.transform(F.flatten(F.transform(blocks, of_block)), strip), lambda p: p != "")


_KEPT = "array<struct<mark:string,part:string>>"


def protect_equations(text: Column) -> Column:
    """Struct of the text with placeholders for equations, and the array of (mark, part)."""
    state = F.struct(text.alias("text"), F.array().cast(_KEPT).alias("kept"))

    def step(prefix: str):
        def one(s: Column, part: Column) -> Column:
            mark = F.concat(F.lit(f"__{prefix}_"), F.size(s["kept"]).cast("string"), F.lit("__"))
            return F.struct(replace_first(s["text"], part, mark).alias("text"), F.concat(s["kept"], F.array(F.struct(mark.alias("mark"), part.alias("part")))).alias("kept"))

        return one

    for pattern, prefix in EQUATIONS:
        found = F.regexp_extract_all(state["text"], F.lit(pattern), F.lit(0))
        state = F.aggregate(found, state, step(prefix))
    return state


def protect_tables(text: Column) -> Column:
    """Struct of the text with a placeholder for each pipe table, and the array of (mark, part).

    A line with two or more pipes is in a table; within one, blank lines and
    lines with three dashes go on with it.
    """
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("open"), F.array().cast(_KEPT).alias("kept"))

    def close(s: Column) -> Column:
        mark = F.concat(F.lit("__TABLE_"), F.size(s["kept"]).cast("string"), F.lit("__"))
        table = F.struct(mark.alias("mark"), F.array_join(s["open"], "\n").alias("part"))
        return F.when(F.size(s["open"]) == 0, s).otherwise(
            F.struct(F.concat(s["out"], F.array(mark)).alias("out"), F.array().cast("array<string>").alias("open"), F.concat(s["kept"], F.array(table)).alias("kept"))
        )

    def step(s: Column, line: Column) -> Column:
        row = (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))) >= 2
        more = (F.size(s["open"]) > 0) & ((strip(line) == "") | F.contains(line, F.lit("---")))
        within = F.struct(s["out"].alias("out"), F.concat(s["open"], F.array(line)).alias("open"), s["kept"].alias("kept"))
        done = close(s)
        outside = F.struct(F.concat(done["out"], F.array(line)).alias("out"), done["open"].alias("open"), done["kept"].alias("kept"))
        return F.when(row | more, within).otherwise(outside)

    return F.aggregate(F.split(text, "\n", -1), zero, step, lambda s: F.struct(F.array_join(close(s)["out"], "\n").alias("text"), close(s)["kept"].alias("kept")))


def restore(text: Column, kept: Column) -> Column:
    """Put the kept parts back in place of their marks."""
    return F.aggregate(kept, text, lambda t, k: F.replace(t, k["mark"], k["part"]))


def _protected(text: Column, equations: bool = True, tables: bool = True) -> Column:
    """Struct of the text with placeholders (``text``) and the kept parts of equations and of tables (``first``, ``second``)."""
    none = F.array().cast(_KEPT)

    def after(first: Column) -> Column:
        # A text without a line of two pipes has no table: it stays as it is.
        second = F.when(first["text"].rlike(r"\|[^\n]*\|"), protect_tables(first["text"])).otherwise(F.struct(first["text"].alias("text"), none.alias("kept"))) if tables else F.struct(first["text"].alias("text"), none.alias("kept"))
        return _bound(second, lambda s: F.struct(s["text"].alias("text"), first["kept"].alias("first"), s["kept"].alias("second")))

    return _bound(protect_equations(text) if equations else F.struct(text.alias("text"), none.alias("kept")), after)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, as a lambda variable, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def normalize_technical(text: Column, equations: bool = True, tables: bool = True, **switches: bool) -> Column:
    """``normalize_text`` that leaves equations and pipe tables as they are.

    Equations are put back before tables, so an equation inside a table keeps its placeholder.
    """
    current, first, second = text, None, None
    if equations:
        first = protect_equations(current)
        current = first["text"]
    if tables:
        second = protect_tables(current)
        current = second["text"]
    out = normalize_text(current, **switches)
    if first is not None:
        out = restore(out, first["kept"])
    if second is not None:
        out = restore(out, second["kept"])
    return F.when(F.coalesce(text, F.lit("")) == "", text).otherwise(out)


def with_technical(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """Rows with ``normalize_technical`` of a text as a further column, for whole tables.

    Each step is made once, and rows pass through Python as a stream.  A column
    function with a Python part keeps whole rows in a queue until their values
    are back, on disk where memory is short.
    """
    made = rows.withColumn("_state", _protected(F.col(text_col)))
    made = made.select(*rows.columns, remove_control(F.col("_state.text")).alias("_text"), F.col("_state.first").alias("_first"), F.col("_state.second").alias("_second"))
    made = made.mapInArrow(_compose, made.schema)
    clean = strip(fix_punctuation(fix_spaces(_repair(F.col("_text")))))
    out = restore(restore(clean, F.col("_first")), F.col("_second"))
    return made.select(*rows.columns, F.when(F.coalesce(text_col, F.lit("")) == "", F.col(text_col)).otherwise(out).alias(name))
