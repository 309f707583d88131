"""Queries of the operators for training data, over the whole tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from . import encoding, leakage, one_form, quality, repeated_lines, splitting, truncation


def _texts(spark: SparkSession, root: str) -> DataFrame:
    blocks = table(spark, root, "text_blocks").select(F.lit("text_blocks").alias("origin"), F.col("block_id").alias("row_id"), "text")
    chunks = table(spark, root, "chunks").select(F.lit("chunks").alias("origin"), F.col("chunk_id").alias("row_id"), "text")
    return blocks.unionByName(chunks)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return repeated_lines.find_repeated_lines(table(spark, root, "chunks"), table(spark, root, "source_files"))


def p1_cleaned(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "chunks")
    return repeated_lines.remove_lines(chunks, p1_found(spark, root)).select("chunk_id", "loaded_at", "text")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    texts = _texts(spark, root)
    return one_form.find_lookalikes(texts, "row_id", scores=one_form.train_scores(texts))


def p3_classes(spark: SparkSession, root: str) -> DataFrame:
    texts = _texts(spark, root)
    return one_form.lookalike_classes(texts, "row_id", scores=one_form.train_scores(texts))


def p3_forms(spark: SparkSession, root: str) -> DataFrame:
    texts = _texts(spark, root)
    return one_form.one_form(texts, "row_id", keep=("origin",), scores=one_form.train_scores(texts))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return quality.find_unnatural(table(spark, root, "chunks"))


def p4_statistics(spark: SparkSession, root: str) -> DataFrame:
    return quality.document_statistics(table(spark, root, "chunks"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return splitting.find_oversized(table(spark, root, "chunks"), table(spark, root, "chunk_limits"))


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_oversized(table(spark, root, "chunks"), table(spark, root, "chunk_limits"))


def p5_audit(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of each oversized chunk that break a rule: of size, text, heading, order, overlap, or the end of the text."""
    chunks, limits = table(spark, root, "chunks"), table(spark, root, "chunk_limits")
    pieces = splitting.split_oversized(chunks, limits, oversized_only=True)
    whole = splitting.with_limits(chunks, limits).select(F.col("item").alias("chunk_id"), F.col("text").alias("whole"), F.col("heading").alias("own"), "measure", "max_size", "overlap_size").distinct()
    before = F.lag("end").over(Window.partitionBy("chunk_id").orderBy("piece_no"))
    both = pieces.withColumn("before", before).join(whole, "chunk_id")
    size, shared = (splitting.text_size(t, F.col("measure")) for t in (F.col("text"), F.expr("substring(whole, start + 1, before - start)")))
    wanted = F.least("overlap_size", splitting.text_size(F.expr("left(whole, before)"), F.col("measure")))
    late = (shared < wanted) & F.expr("substring(whole, start, 1)").rlike(r"\p{M}")  # the overlap begins after a letter and its marks
    wrong = (
        (size > F.col("max_size")) | (F.col("text") != F.expr("substring(whole, start + 1, `end` - start)")) | ~F.col("heading").eqNullSafe(F.col("own"))
        | F.coalesce((F.col("start") > F.col("before")) | (F.col("end") <= F.col("before")) | ((shared != wanted) & ~late), F.col("start") != 0)
        | (F.col("piece_no") == F.col("n_pieces") - 1) & (F.col("end") != F.length("whole"))
    )
    return both.groupBy("chunk_id").agg(F.count_if(wrong).alias("n_wrong"))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, root, "documents"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, root: str) -> DataFrame:
    return leakage.find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items"), ("question", "passage"), short=True)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.find_truncated(table(spark, root, "documents"))


def p8_rates(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, root, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_cleaned, p3_found, p3_classes, p3_forms, p4_found, p4_statistics, p5_found, p5_pieces, p5_audit, p6_ids, p7_found, p7_passages, p8_found, p8_rates)
}

#: Where DuckDB can state the same result over whole tables.
_OVERSIZED = """
    from chunks join chunk_limits l on l.profile = metadata['profile']
    where case l.measure when 'chars' then length(text)
          else len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda t: t <> '')) end > l.max_size
"""
ORACLE: dict[str, str] = {
    "p5_found": f"select distinct chunk_id {_OVERSIZED}",
    "p5_audit": f"select distinct chunk_id, 0::bigint as n_wrong {_OVERSIZED}",
}
