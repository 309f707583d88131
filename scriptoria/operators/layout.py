"""Page layout: reading order, word joins across lines, merging of near blocks, page assembly, headings.

Blocks are rows (doc_id, page_num, block_num, text, bbox, font_size, font_name);
a page is gathered into one sorted array, and the order-dependent steps are folds
over it.  Missing boxes count as boxes at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import strip

BLOCK = "struct<y0:double,x0:double,seq:int,x1:double,y1:double,text:string,font_size:double,font_name:string>"


def latest_blocks(blocks: DataFrame) -> DataFrame:
    """One row for each ``block_id``, the one extracted last; blank and null texts are left out."""
    order = F.struct("extracted_at", "text", "font_size", "font_name", "structure_type")
    fields = ("doc_id", "page_num", "block_num", "text", "bbox", "font_size", "font_name", "structure_type")
    one = blocks.groupBy("block_id").agg(F.max_by(F.struct(*fields), order).alias("b"))
    return one.select("block_id", "b.*").filter(strip(F.col("text")) != "")


def scan_spans(pages: DataFrame) -> DataFrame:
    """Blocks of extracted pages: ``doc_id``, ``page_num``, ``block_num``, ``text``, ``bbox``, ``font_size``, ``font_name``.

    ``pages`` has ``blocks`` of (type, lines of (spans of (text, bbox, size,
    font))); only text blocks (type 0) count, texts are stripped, empty ones
    dropped, and the kept spans of a page numbered from 0.
    """
    b = pages.select("doc_id", "page_num", F.posexplode("blocks").alias("_b", "block")).filter("block.type = 0")
    lines = b.select("doc_id", "page_num", "_b", F.posexplode("block.lines").alias("_l", "line"))
    spans = lines.select("doc_id", "page_num", "_b", "_l", F.posexplode("line.spans").alias("_s", "span"))
    kept = spans.withColumn("text", strip(F.col("span.text"))).filter("text <> ''")
    n = F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy("_b", "_l", "_s")) - 1
    return kept.select("doc_id", "page_num", n.alias("block_num"), "text", "span.bbox", F.col("span.size").alias("font_size"), F.col("span.font").alias("font_name"))


def page_arrays(blocks: DataFrame) -> DataFrame:
    """Per page: ``blocks`` in reading order (y0, x0, number)."""
    at = lambda f: F.coalesce(F.col(f"bbox.{f}"), F.lit(0.0))
    item = F.struct(at("y0").alias("y0"), at("x0").alias("x0"), F.col("block_num").cast("int").alias("seq"), at("x1").alias("x1"), at("y1").alias("y1"), "text", "font_size", "font_name")
    return blocks.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(item)).alias("blocks"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks with their ``position`` (from 0) on the page."""
    pages = page_arrays(blocks)
    return pages.select("doc_id", "page_num", F.posexplode("blocks").alias("position", "b")).select("doc_id", "page_num", "position", F.col("b.seq").alias("block_num"), "b.text")


def _with(b: Column, **new: Column) -> Column:
    names = ("y0", "x0", "seq", "x1", "y1", "text", "font_size", "font_name")
    return F.struct(*[(new[n] if n in new else b[n]).alias(n) for n in names])


def dehyphenate(blocks: Column, threshold: float = 10.0) -> Column:
    """Join words cut at line ends.

    A block that ends with a hyphen takes the first word of the next block if
    that stands on another line; what remains of the next block stays a block of
    its own and is not looked at again.
    """
    none = F.array().cast(f"array<{BLOCK}>")
    paired = F.transform(blocks, lambda b, i: F.struct(b.alias("b"), F.get(blocks, i + 1).alias("next")))

    def step(s: Column, p: Column) -> Column:
        b, nxt = p["b"], p["next"]
        joins = F.coalesce(b["text"].endswith("-") & nxt.isNotNull() & (F.abs(b["y0"] - nxt["y0"]) > threshold), F.lit(False))
        cut = F.instr(nxt["text"], " ")
        word = F.when(cut > 0, F.substring(nxt["text"], F.lit(1), cut - 1)).otherwise(nxt["text"])
        rest = F.when(cut > 0, F.substring(nxt["text"], cut + 1, F.length(nxt["text"]))).otherwise(F.lit(""))
        glued = _with(b, text=F.concat(F.substring(b["text"], F.lit(1), F.length(b["text"]) - 1), word))
        left = F.when(rest == "", none).otherwise(F.array(_with(nxt, text=rest)))
        joined = F.struct(F.concat(s["out"], F.array(glued), left).alias("out"), F.lit(True).alias("skip"))
        plain = F.struct(F.concat(s["out"], F.array(b)).alias("out"), F.lit(False).alias("skip"))
        skipped = F.struct(s["out"].alias("out"), F.lit(False).alias("skip"))
        return F.when(s["skip"], skipped).when(joins, joined).otherwise(plain)

    return F.aggregate(paired, F.struct(none.alias("out"), F.lit(False).alias("skip")), step, lambda s: s["out"])


def merge_near(blocks: Column, threshold: float = 10.0) -> Column:
    """Merge neighbours on one line: text joined by a space, box the union, number and font of the first.

    Each block is compared with the box grown so far; blocks that overlap merge too.
    """
    none = F.array().cast(f"array<{BLOCK}>")

    def step(done: Column, b: Column) -> Column:
        cur = F.try_element_at(done, F.lit(-1))
        near = F.coalesce((F.abs(cur["y0"] - b["y0"]) < threshold) & (b["x0"] - cur["x1"] < 2 * threshold), F.lit(False))
        both = _with(cur, y0=F.least(cur["y0"], b["y0"]), x0=F.least(cur["x0"], b["x0"]), x1=F.greatest(cur["x1"], b["x1"]), y1=F.greatest(cur["y1"], b["y1"]), text=F.concat(cur["text"], F.lit(" "), b["text"]))
        return F.when(near, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(b)))

    return F.aggregate(blocks, none, step)


def assemble_pages(blocks: DataFrame, threshold: float = 10.0, fix_hyphens: bool = True) -> DataFrame:
    """Per page with blocks: ``blocks`` after sorting, joining and merging, ``full_text``, ``char_count``, ``block_count``."""
    out = F.col("blocks")
    out = dehyphenate(out, threshold) if fix_hyphens else out
    out = F.array_sort(merge_near(out, threshold)) if threshold > 0 else F.array_sort(out)
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), " ")
    return page_arrays(blocks).withColumn("blocks", out).select("doc_id", "page_num", "blocks", text.alias("full_text"), F.length(text).alias("char_count"), F.size("blocks").alias("block_count"))


def all_pages(pages: DataFrame, records: DataFrame) -> DataFrame:
    """Assembled pages with size and rotation of every recorded page; pages without blocks have none and an empty text."""
    one = records.groupBy("doc_id", "page_num").agg(F.max(F.struct("width", "height", "rotation", "image_count")).alias("r")).select("doc_id", "page_num", "r.*")
    return one.join(pages, ["doc_id", "page_num"], "left").select(
        "doc_id", "page_num", "width", "height", "rotation", "image_count", F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")).alias("blocks"),
        F.coalesce("full_text", F.lit("")).alias("full_text"), F.coalesce("char_count", F.lit(0)).alias("char_count"), F.coalesce("block_count", F.lit(0)).alias("block_count"),
    )


def document_statistics(pages: DataFrame) -> DataFrame:
    """Per document: ``total_pages``, ``total_blocks``, ``total_characters``, ``avg_blocks_per_page`` (0 without pages)."""
    per = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.sum("block_count").alias("total_blocks"), F.sum("char_count").alias("total_characters"))
    return per.withColumn("avg_blocks_per_page", F.coalesce(F.try_divide(F.col("total_blocks").cast("double"), "total_pages"), F.lit(0.0)))


def heading_type(font_size: Column, average: Column) -> Column:
    """Structure type of a block from its font size against the document's average; null where there is no average."""
    return (
        F.when(average.isNull(), None).when(F.coalesce(font_size, F.lit(0.0)) == 0, "unknown")
        .when(font_size > 1.3 * average, "heading1").when(font_size > 1.15 * average, "heading2").when(font_size > 1.05 * average, "heading3").otherwise("paragraph")
    )


def classify_headings(blocks: DataFrame) -> DataFrame:
    """Blocks (rows with ``doc_id`` and ``font_size``) with ``structure_type``.

    The average, rounded so that it doesn't hang on the order of summation, is taken over the sizes of the whole document that are neither
    null nor 0; it is aggregated and joined, so a large document is not gathered
    in one place.
    """
    average = blocks.filter("font_size <> 0").groupBy("doc_id").agg(F.round(F.avg("font_size"), 9).alias("_avg"))
    return blocks.drop("structure_type").join(average, "doc_id", "left").withColumn("structure_type", heading_type(F.col("font_size"), F.col("_avg"))).drop("_avg")


def block_rows(pages: DataFrame) -> DataFrame:
    """Rows of the blocks of assembled pages, with their ``position`` on the page."""
    return pages.select("doc_id", "page_num", F.posexplode("blocks").alias("position", "b")).select(
        "doc_id", "page_num", "position", F.col("b.seq").alias("block_num"), "b.text", "b.font_size", "b.font_name", F.struct("b.x0", "b.y0", "b.x1", "b.y1").alias("bbox"),
    )
