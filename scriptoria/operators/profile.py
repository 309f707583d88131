"""Quality profiles of extracted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import WS, strip
from ..functions.text import normalize_text
from ..functions.units import extract_units, normalize_units, unit_statistics

# Symbols and notations whose occurrences are counted.
SYMBOLS = ["℃", "°C", "℉", "°F", "m /h", "m³/h", "bar g", "bar a", "±", "×", "²", "³"]
#: Share of empty blocks above which a corpus gets a warning, in percent.
EMPTY_WARNING = 5.0
#: Characters above which a page counts as a page of text.
PAGE_CHARS = 100


def _ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), digits)


def document_profile(blocks: DataFrame) -> DataFrame:
    """Per document: pages, blocks, characters, empty blocks and their averages; 0 where there is no base."""
    empty = F.coalesce(strip(F.col("text")), F.lit("")) == ""
    per = blocks.groupBy("doc_id").agg(F.count_distinct("page_num").alias("pages"), F.count("*").alias("blocks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_if(empty).alias("empty_blocks"))
    return per.select(
        "*", _ratio(F.col("blocks"), F.col("pages")).alias("avg_blocks_per_page"), _ratio(F.col("chars"), F.col("blocks")).alias("avg_chars_per_block"), _ratio(100 * F.col("empty_blocks"), F.col("blocks")).alias("empty_percent"),
    )


def rotated_pages(records: DataFrame) -> DataFrame:
    """Pages that are turned: ``doc_id``, ``page_num``, ``rotation``, once each; null counts as not turned."""
    return records.filter("rotation <> 0").select("doc_id", "page_num", "rotation").distinct()


def wrong_counts(pages: DataFrame, records: DataFrame) -> DataFrame:
    """Pages whose recorded number of characters isn't that of their text; pages without a record or without text count as 0."""
    own = pages.groupBy("doc_id", "page_num").agg(F.max("char_count").cast("bigint").alias("actual"))
    reported = records.groupBy("doc_id", "page_num").agg(F.max("char_count").alias("reported"))
    both = reported.join(own, ["doc_id", "page_num"], "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("bigint")))
    return both.filter(~F.col("reported").eqNullSafe(F.col("actual"))).select("doc_id", "page_num", "reported", "actual")


def structure_histogram(blocks: DataFrame) -> DataFrame:
    """Blocks by structure type (null: unknown), with their share in percent."""
    per = blocks.groupBy(F.coalesce("structure_type", F.lit("unknown")).alias("structure_type")).agg(F.count("*").alias("n"))
    total = blocks.agg(F.count("*").alias("n")).scalar()
    return per.select("structure_type", "n", _ratio(100 * F.col("n"), total).alias("percent"))


def font_statistics(blocks: DataFrame) -> DataFrame:
    """Smallest, largest and mean font size per document; null and zero sizes don't count."""
    return blocks.filter("font_size <> 0").groupBy("doc_id").agg(F.min("font_size").alias("min_size"), F.max("font_size").alias("max_size"), F.round(F.avg("font_size"), 6).alias("avg_size"))


def common_fonts(blocks: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` font sizes of each document; ties go to the smaller size."""
    per = blocks.filter("font_size <> 0").groupBy("doc_id", "font_size").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "font_size"))
    return per.withColumn("rank", rank).filter(F.col("rank") <= top)


def suspicious_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with signs beyond ASCII other than degrees and superscripts; ``sample`` are the first fifty signs."""
    return blocks.filter(F.col("text").rlike(r"[^\x00-\x7F°²³℃℉]")).select("block_id", "doc_id", "page_num", F.substring("text", 1, 50).alias("sample"))


def symbol_counts(rows: DataFrame, group: str = "doc_id") -> DataFrame:
    """Occurrences of each symbol per group, where there are any."""
    def times(symbol: str) -> Column:
        return F.floor((F.length("text") - F.length(F.replace("text", F.lit(symbol), F.lit("")))) / len(symbol))

    each = F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), times(s).alias("n")) for s in SYMBOLS]))
    return rows.filter(F.col("text").isNotNull()).select(group, each.alias("s")).filter("s.n > 0").groupBy(group, "s.symbol").agg(F.sum("s.n").alias("n"))


def corpus_rollup(blocks: DataFrame) -> DataFrame:
    """Profile by document and, in the row with a null ``doc_id``, of the whole corpus, with a warning for many empty blocks."""
    empty = F.coalesce(strip(F.col("text")), F.lit("")) == ""
    named = blocks.select(F.coalesce("doc_id", F.lit("")).alias("doc_id"), "page_num", F.length("text").alias("_n"), empty.alias("_e"))
    pages = named.groupBy("doc_id", "page_num").agg(F.count("*").alias("b"), F.sum("_n").alias("c"), F.count_if("_e").alias("e"))
    per = pages.rollup("doc_id").agg(F.count("*").alias("pages"), F.sum("b").alias("blocks"), F.coalesce(F.sum("c"), F.lit(0)).alias("chars"), F.sum("e").alias("empty_blocks"))
    percent = _ratio(100 * F.col("empty_blocks"), F.col("blocks"))
    return per.select("*", percent.alias("empty_percent"), (percent > EMPTY_WARNING).alias("warning"))


def normalized_blocks(blocks: DataFrame) -> DataFrame:
    """Per document: blocks whose text the text and unit normalisation changes."""
    changed = ~normalize_units(normalize_text(F.col("text"))).eqNullSafe(F.col("text"))
    return blocks.withColumn("_c", changed).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if("_c").alias("changed"))


def first_of_structure(blocks: DataFrame, first: int = 3) -> DataFrame:
    """The first blocks of each structure type in order of document, page and number."""
    w = Window.partitionBy("structure_type").orderBy("doc_id", "page_num", "block_num", "block_id")
    named = blocks.withColumn("structure_type", F.coalesce("structure_type", F.lit("unknown")))
    return named.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= first).select("structure_type", "n", "block_id", "text")


def specification_rows(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Rows of a parameter table: ``parameter``, ``value``, ``unit`` of each line between a head line (with Parameter and Value) and ``Notes:``.

    Lines of fewer than three words have no unit, lines of one word are left out.
    """
    zero = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("lines"))

    def step(s: Column, line: Column) -> Column:
        head = F.contains(line, F.lit("Parameter")) & F.contains(line, F.lit("Value"))
        ends = F.contains(line, F.lit("Notes:"))
        take = s["on"] & ~head & ~ends & (strip(line) != "")
        return F.struct((head | (s["on"] & ~ends)).alias("on"), F.when(take, F.concat(s["lines"], F.array(strip(line)))).otherwise(s["lines"]).alias("lines"))

    lines = F.aggregate(F.split(F.col(text_col), "\n", -1), zero, step, lambda s: s["lines"])
    rows = texts.select(F.col(id_col).alias("_id"), F.posexplode(lines).alias("seq", "line")).withColumn("w", F.split("line", f"{WS}+", -1)).filter("size(w) > 1")
    n = F.size("w")
    value = F.array_join(F.when(n > 2, F.slice("w", F.lit(2), n - 2)).otherwise(F.slice("w", F.lit(2), F.lit(1))), " ")
    return rows.select(F.col("_id").alias(id_col), "seq", F.get("w", F.lit(0)).alias("parameter"), value.alias("value"), F.when(n > 2, F.get("w", n - 1)).alias("unit"))


#: Characters of a document that its unit profile reads: the profile is a look at its beginning by definition.
PROFILE_CHARS = 100_000


def unit_profile(pages: DataFrame, chars: int = PROFILE_CHARS) -> DataFrame:
    """Units in the first ``chars`` characters of each document, whose pages are joined by a space.

    ``pages`` has ``doc_id``, ``page_num``, ``full_text``.  Columns: ``doc_id``,
    ``total_units``, ``unique_units``, ``most_common`` (ties: seen first) with its
    ``most_common_count``, ``n_spelled_differently`` and ``needs_normalization``: the
    units that the text writes in several ways, with the ways.  Documents without
    units have no row.
    """
    page = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num"))
    before = F.sum(F.length("full_text") + 1).over(Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1))
    # Only the pages that begin within the limit are put together.
    shown = pages.select("doc_id", page.alias("n"), "full_text", F.coalesce(before, F.lit(0)).alias("before")).filter(F.col("before") < chars)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "full_text"))), lambda p: p["full_text"]), " ")
    found = extract_units(shown.groupBy("doc_id").agg(F.substring(text, 1, chars).alias("text")), "doc_id")
    per = unit_statistics(found, "doc_id")
    several = F.col("n_variants") > 1
    return per.groupBy("doc_id").agg(
        F.sum("n").alias("total_units"), F.count("*").alias("unique_units"), F.max_by("normalized", F.when(F.col("rank") == 1, 1)).alias("most_common"), F.max("n").alias("most_common_count"),
        F.count_if(several).alias("n_spelled_differently"), F.array_sort(F.collect_list(F.when(several, F.struct("normalized", "variants")))).alias("needs_normalization"),
    )


def page_flags(pages: DataFrame) -> DataFrame:
    """Pages as ``text`` or ``non-text`` by their number of characters; null counts as 0."""
    return pages.select("doc_id", "page_num", "char_count", F.when(F.coalesce("char_count", F.lit(0)) > PAGE_CHARS, "text").otherwise("non-text").alias("content"))
