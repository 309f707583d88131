"""Markdown of pages and documents from classified blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import ND, WS, strip


def _kind() -> Column:
    return F.coalesce("structure_type", F.lit("paragraph"))


def structure_runs(blocks: DataFrame) -> DataFrame:
    """Blocks with ``kind`` and ``run``, the number (from 0) of the run of equal structure types on the page."""
    w = Window.partitionBy("doc_id", "page_num").orderBy("position")
    changed = F.when(F.lag("_k").over(w) == F.col("_k"), 0).otherwise(1)
    return blocks.withColumn("_k", _kind()).withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumnRenamed("_k", "kind").drop("_c")


def is_list_item(text: Column) -> Column:
    """True for a numbered or bulleted item."""
    return text.rlike(rf"^{ND}+[.)]{WS}+|^[-•*]{WS}+")


def format_list_item(text: Column) -> Column:
    """List items in Markdown's notation; other texts as they are."""
    numbered = F.regexp_replace(text, rf"^({ND}+)[.)]{WS}*", "$1. ")
    bulleted = F.regexp_replace(text, rf"^[-•*]{WS}*", "- ")
    return F.when(~is_list_item(text), text).when(text.rlike(rf"^{ND}"), numbered).otherwise(bulleted)


def _note(bbox: bool, fonts: bool) -> Column:
    parts = []
    if bbox:
        parts.append(F.format_string("bbox:(%s, %s, %s, %s)", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1"))
    if fonts:
        parts += [F.concat(F.lit("size:"), F.coalesce(F.col("font_size").cast("string"), F.lit("None"))), F.concat(F.lit("font:"), F.coalesce("font_name", F.lit("None")))]
    return F.concat(F.lit("<!-- "), F.concat_ws(", ", *parts), F.lit(" -->"))


def block_markdown(bbox: bool = False, fonts: bool = False) -> Column:
    """Markdown of one block row with ``kind``, ``text`` and ``font_size``; blank texts give an empty part."""
    text = strip(F.coalesce("text", F.lit("")))
    size = F.coalesce("font_size", F.lit(0.0))
    marks = F.when((F.col("kind") == "heading1") | (size > 16), "#").when((F.col("kind") == "heading2") | (size > 14), "##").otherwise("###")
    heading, para = F.concat(marks, F.lit(" "), text), format_list_item(text)
    if bbox or fonts:
        heading, para = F.concat(heading, F.lit("\n"), _note(bbox, fonts)), F.concat(_note(bbox, fonts), F.lit("\n"), para)
    return F.when(text == "", "").when(F.col("kind").startswith("heading"), heading).otherwise(para)


def page_markdown(blocks: DataFrame, bbox: bool = False, fonts: bool = False) -> DataFrame:
    """Per page: ``markdown``: a page comment, every heading a part, every run of other blocks a part.

    ``blocks`` are rows with ``doc_id``, ``page_num``, ``position``, ``text``,
    ``structure_type``, ``font_size``.  Blocks whose structure is unknown group
    apart from paragraphs and look like them.
    """
    runs = structure_runs(blocks).withColumn("md", block_markdown(bbox, fonts))
    heading = F.col("kind").startswith("heading")
    part = runs.withColumn("_part", F.when(heading, F.col("position")).otherwise(-1))
    joined = part.groupBy("doc_id", "page_num", "run", "_part").agg(F.min("position").alias("_at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "md"))), lambda x: x["md"]), "\n").alias("md"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "md"))), lambda x: x["md"]), "\n\n")
    pages = joined.groupBy("doc_id", "page_num").agg(body.alias("_body"))
    return pages.select("doc_id", "page_num", F.concat(F.lit("<!-- Page "), (F.col("page_num") + 1).cast("string"), F.lit(" -->\n\n"), "_body").alias("markdown"))


def document_markdown(pages: DataFrame, documents: DataFrame | None = None, page_breaks: bool = True) -> DataFrame:
    """Per document: ``markdown`` of its pages in order, with front matter for documents named in ``documents``.

    ``documents`` has ``doc_id``, ``file_path``, ``total_pages``, ``total_blocks``,
    ``total_characters``.  Without a row (or path) there is no front matter.
    """
    between = "\n\n---\n\n" if page_breaks else "\n"
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "markdown"))), lambda p: p["markdown"]), between)
    body = pages.groupBy("doc_id").agg(text.alias("markdown"))
    if documents is None:
        return body
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    front = F.concat(
        F.lit("---\nsource: "), "file_path", F.lit("\ntotal_pages: "), count("total_pages"), F.lit("\ntotal_blocks: "), count("total_blocks"),
        F.lit("\ntotal_characters: "), count("total_characters"), F.lit("\n---\n\n"),
    )
    info = documents.select("doc_id", front.alias("_front"))
    return body.join(info, "doc_id", "left").select("doc_id", F.concat(F.coalesce("_front", F.lit("")), "markdown").alias("markdown"))


def structured_markdown(blocks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Per document: ``markdown``, ``headings``, ``pages``, ``statistics`` and ``source_file``.

    ``headings`` are structs of text, level, page and font size in reading order;
    ``pages`` of page number, characters and blocks; ``statistics`` adds them up.
    ``documents`` is as for ``document_markdown`` and gives the source file, null
    where it has none.
    """
    text = F.length(F.coalesce("text", F.lit("")))
    # Blocks of a page are joined by one sign.
    per = blocks.groupBy("doc_id", "page_num").agg((F.sum(text) + F.count("*") - 1).alias("char_count"), F.count("*").alias("block_count"))
    pages = per.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_num", "char_count", "block_count"))).alias("pages"),
        F.struct(F.sum("block_count").alias("total_blocks"), F.sum("char_count").alias("total_characters"), F.round(F.avg("block_count"), 6).alias("avg_blocks_per_page")).alias("statistics"),
    )
    found = headings(blocks).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "position", "text", "level", "font_size"))).alias("_h"))
    body = document_markdown(page_markdown(blocks), documents)
    out = body.join(pages, "doc_id").join(found, "doc_id", "left")
    out = out.join(documents.select("doc_id", F.col("file_path").alias("source_file")), "doc_id", "left") if documents is not None else out.withColumn("source_file", F.lit(None).cast("string"))
    shown = F.transform(F.coalesce("_h", F.array().cast("array<struct<page:int,position:int,text:string,level:string,font_size:double>>")), lambda h: F.struct(h["text"].alias("text"), h["level"].alias("level"), h["page"].alias("page"), h["font_size"].alias("font_size")))
    return out.select("doc_id", "markdown", shown.alias("headings"), "pages", "statistics", "source_file")


def headings(blocks: DataFrame) -> DataFrame:
    """Headings of documents: ``doc_id``, ``page``, ``position``, ``text``, ``level``, ``font_size``."""
    return blocks.filter(_kind().startswith("heading")).select("doc_id", F.col("page_num").alias("page"), "position", F.coalesce("text", F.lit("")).alias("text"), F.col("structure_type").alias("level"), F.coalesce("font_size", F.lit(0.0)).alias("font_size"))
