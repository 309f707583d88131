"""Chunks of Markdown documents and of classified blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import strip

Size = Callable[[Column], Column]


def pack(text: Column, max_size: int = 1000, overlap: int = 50, size: Size = F.length) -> Column:
    """Greedy packing of the paragraphs of a text: array of chunk texts.

    A chunk is closed when the next paragraph would pass ``max_size``; with an
    overlap the next chunk starts with the last paragraph of the one before, which
    counts in characters.  A paragraph larger than the limit stays whole, and the
    joins between paragraphs don't count.  Sizes are taken once for each paragraph,
    by ``size.many`` over all of them where the function has it.
    """
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("buf"), F.lit(0).alias("cur"), none.alias("out"))

    paragraphs = F.split(text, "\n\n", -1)
    sizes = size.many(paragraphs) if hasattr(size, "many") else F.transform(paragraphs, size)

    def step(s: Column, item: Column) -> Column:
        p, n = item["p"], item["n"]
        full = (s["cur"] + n > max_size) & (F.size(s["buf"]) > 0)
        out = F.concat(s["out"], F.array(F.array_join(s["buf"], "\n\n")))
        last = F.try_element_at(s["buf"], F.lit(-1))
        opened = F.array(last, p) if overlap > 0 else F.array(p)
        carried = n + F.length(last) if overlap > 0 else n
        fresh = F.struct(opened.alias("buf"), carried.alias("cur"), out.alias("out"))
        more = F.struct(F.concat(s["buf"], F.array(p)).alias("buf"), (s["cur"] + n).alias("cur"), s["out"].alias("out"))
        return F.when(full, fresh).otherwise(more)

    def finish(s: Column) -> Column:
        return F.when(F.size(s["buf"]) > 0, F.concat(s["out"], F.array(F.array_join(s["buf"], "\n\n")))).otherwise(s["out"])

    return F.aggregate(F.arrays_zip(paragraphs.alias("p"), sizes.alias("n")), zero, step, finish)


def sections(documents: DataFrame) -> DataFrame:
    """Sections of Markdown: ``doc_id``, ``section``, ``heading``, ``level``, ``content``, ``page_start``, ``page_end``.

    A line that starts with ``#`` opens a section; what stands before the first
    one is a section without heading, from its first line that isn't blank.  The
    page marks in a section give its pages, counted from 0; page 0 doesn't stick as
    a start, and the first line of a section without heading isn't read for marks.
    Blank sections keep a row with a blank ``content``.  Lines are rows here, not a
    fold over an array, so a document of millions of lines takes linear time.
    """
    lines = documents.select("doc_id", F.posexplode(F.split(F.coalesce("markdown", F.lit("")), "\n", -1)).alias("i", "line"))
    doc = Window.partitionBy("doc_id")
    hashes = F.regexp_extract("line", "^(#*)", 1)
    marked = lines.withColumn("head", F.length(hashes) > 0).withColumn("s", F.sum(F.col("head").cast("int")).over(doc.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.min(F.when((F.col("s") == 0) & (strip(F.col("line")) != ""), F.col("i"))).over(doc)
    kept = marked.withColumn("first", first).filter((F.col("s") > 0) | (F.col("i") >= F.col("first")))
    n = F.regexp_extract("line", r"Page (\d+)", 1)
    read = ~F.col("head") & ~((F.col("s") == 0) & (F.col("i") == F.col("first"))) & F.contains("line", F.lit("<!-- Page")) & (n != "")
    paged = kept.withColumn("p", F.when(read, n.try_cast("int") - 1))
    per = paged.groupBy("doc_id", "s").agg(
        F.max(F.when(F.col("head"), strip(F.substring("line", F.length(hashes) + 1, F.length("line"))))).alias("heading"),
        F.coalesce(F.max(F.when(F.col("head"), F.length(hashes))), F.lit(0)).alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("i", "line")))), lambda x: x["line"]), "\n").alias("content"),
        F.coalesce(F.min_by("p", F.when(F.col("p") != 0, F.col("i"))), F.lit(0)).alias("page_start"),
        F.coalesce(F.max_by("p", F.when(F.col("p").isNotNull(), F.col("i"))), F.lit(0)).alias("page_end"),
    )
    number = (F.row_number().over(doc.orderBy("s")) - 1).cast("int")
    return per.select("doc_id", number.alias("section"), "heading", "level", "content", "page_start", "page_end")


def section_paths(sections: DataFrame, between: str = " > ") -> DataFrame:
    """Sections (``doc_id``, ``section``, ``heading``, ``level``) with ``section_path``: their headings from the top down.

    The path of a section holds the last heading of each smaller level that no
    heading of a still smaller level has closed; sections without heading have an
    empty path.  Levels beyond six nest in the sixth.
    """
    before = Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    own = F.least(F.col("level"), F.lit(7))
    last = {n: F.max(F.when(F.col("level") == n, F.struct("section", "heading"))).over(before) for n in range(1, 7)}
    marked = sections.select("*", *[last[n].alias(f"_h{n}") for n in last])
    parts = []
    for n in range(1, 7):
        open_ = (own > n) & F.col(f"_h{n}").isNotNull()
        for k in range(1, n):
            open_ &= F.coalesce(F.col(f"_h{k}.section") < F.col(f"_h{n}.section"), F.lit(True))
        parts.append(F.when(open_, F.col(f"_h{n}.heading")))
    path = F.when(F.col("level") > 0, F.concat_ws(between, *parts, "heading")).otherwise("")
    return marked.select(*sections.columns, path.alias("section_path"))


def chunk_id(doc_id: Column, index: Column) -> Column:
    """Id of a chunk; indexes of more than four digits stay whole."""
    return F.format_string("%s_chunk_%04d", doc_id, index)


def _number(pieces: DataFrame, *order: str) -> DataFrame:
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return pieces.withColumn("chunk_index", index).select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "text", "doc_id", "page_start", "page_end", F.length("text").alias("char_count"),
        "token_count", "chunk_index", F.lit(None).cast("string").alias("parent_chunk_id"), "heading", "level", "metadata",
    )


def chunk_markdown(documents: DataFrame, max_size: int = 1000, overlap: int = 50, tokens: Size | None = None) -> DataFrame:
    """Chunks of Markdown documents (``doc_id``, ``markdown``).

    Sizes are characters, or tokens where a counting function is given (then
    ``token_count`` is filled, else it is 0).  Blank sections give no chunk and
    take no number.
    """
    size = tokens or F.length
    body = sections(documents).filter(strip(F.col("content")) != "")
    small = size(F.col("content")) <= max_size
    texts = F.when(small, F.array("content")).otherwise(pack(F.col("content"), max_size, overlap, size))
    pieces = body.select("doc_id", "section", "heading", "level", "page_start", "page_end", F.posexplode(texts).alias("sub", "text"))
    counted = pieces.withColumn("token_count", tokens(F.col("text")).cast("int") if tokens else F.lit(0)).withColumn("metadata", F.create_map().cast("map<string,string>"))
    return _number(counted, "section", "sub")


def block_groups(blocks: DataFrame) -> DataFrame:
    """Groups of blocks under their headings, page by page: ``doc_id``, ``page_num``, ``group``, ``heading``, ``level``, ``text``, ``n_blocks``."""
    kind = F.coalesce("structure_type", F.lit("paragraph"))
    opens = kind.startswith("heading")
    level = F.when(kind == "heading1", 1).when(kind == "heading2", 2).otherwise(3)
    w = Window.partitionBy("doc_id", "page_num").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    marked = blocks.select("doc_id", "page_num", "position", F.coalesce("text", F.lit("")).alias("text"), opens.alias("_o"), level.alias("_l"))
    numbered = marked.withColumn("group", F.sum(F.col("_o").cast("int")).over(w))
    body = F.array_sort(F.collect_list(F.when(~F.col("_o"), F.struct("position", "text"))))
    per = numbered.groupBy("doc_id", "page_num", "group").agg(
        F.max(F.when(F.col("_o"), F.col("text"))).alias("heading"), F.coalesce(F.max(F.when(F.col("_o"), F.col("_l"))), F.lit(0)).alias("level"),
        F.array_join(F.transform(body, lambda b: b["text"]), "\n").alias("text"), F.count_if(~F.col("_o")).cast("int").alias("n_blocks"),
    )
    return per


def chunk_blocks(blocks: DataFrame, max_size: int = 1000, overlap: int = 50, tokens: Size | None = None) -> DataFrame:
    """Chunks of classified blocks, group by group; a heading without blocks gives a chunk with an empty text."""
    texts = pack(F.col("text"), max_size, overlap, tokens or F.length)
    pieces = block_groups(blocks).select("doc_id", F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"), "group", "heading", "level", F.create_map(F.lit("blocks"), F.col("n_blocks").cast("string")).alias("metadata"), F.posexplode(texts).alias("sub", "text"))
    counted = pieces.withColumn("token_count", tokens(F.col("text")).cast("int") if tokens else F.lit(0))
    return _number(counted, "page_start", "group", "sub")


def document_id(path: Column) -> Column:
    """Id of a document from its path: the first eight signs of the md5 sum, ``unknown`` for null."""
    return F.coalesce(F.substring(F.md5(path), 1, 8), F.lit("unknown"))


def stem_id(path: Column) -> Column:
    """Id of a document from the name of its file: spaces to underscores, twenty signs."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")
    return F.substring(F.replace(stem, F.lit(" "), F.lit("_")), 1, 20)


def chunk_statistics(chunks: DataFrame, *groups: str) -> DataFrame:
    """Sizes of chunks: ``total_chunks``, ``avg_size``, ``min_size``, ``max_size``, ``total_size``, ``levels``, ``first_page``, ``last_page``.

    ``avg_size``, ``min_size``, ``max_size`` and ``total_size`` are 0 where there are no chunks.
    """
    n = F.length("text")
    return chunks.groupBy(*groups).agg(
        F.count("*").alias("total_chunks"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_size"), F.coalesce(F.min(n), F.lit(0)).alias("min_size"), F.coalesce(F.max(n), F.lit(0)).alias("max_size"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_size"), F.array_sort(F.collect_set("level")).alias("levels"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"),
    )


def expand_window(hits: DataFrame, chunks: DataFrame, width: int = 1) -> DataFrame:
    """Each hit (``doc_id``, ``chunk_index``) with its neighbours up to ``width`` away.

    The hit's range is unrolled to exact keys, so the join is a plain equi-join.
    """
    around = hits.select("doc_id", F.col("chunk_index").alias("hit_index"), F.explode(F.sequence(F.col("chunk_index") - width, F.col("chunk_index") + width)).alias("chunk_index"))
    return around.join(chunks.select("doc_id", "chunk_index", "chunk_id", "text"), ["doc_id", "chunk_index"])


def parent_chunks(chunks: DataFrame, max_size: int = 1600) -> DataFrame:
    """Chunks with ``parent_chunk_id``: neighbours of a document share a parent of about ``max_size`` characters.

    The parent number is the running size before a chunk over ``max_size``, so a
    parent passes the size by less than its last chunk.  Null texts have size 0.
    """
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.coalesce(F.length("text"), F.lit(0))
    number = F.floor((F.sum(size).over(w) - size) / max_size).cast("int")
    return chunks.drop("parent_chunk_id").withColumn("_p", number).withColumn("parent_chunk_id", F.format_string("%s_parent_%04d", F.col("doc_id"), F.col("_p"))).drop("_p")


def expand_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Small to big: for each parent of a hit (``chunk_id``), the text of all its chunks in order, once."""
    wanted = hits.select("chunk_id").distinct().join(chunks, "chunk_id").select("parent_chunk_id").distinct()
    parts = chunks.join(wanted, "parent_chunk_id", "left_semi").groupBy("parent_chunk_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("_t"))
    return parts.select("parent_chunk_id", "doc_id", F.size("_t").alias("n_chunks"), F.array_join(F.transform("_t", lambda x: x["text"]), "\n\n").alias("text"))
