"""All queries of the core, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import service, tags, text, tokens, units
from ..functions.regex import ND
from ..operators import bm25, chunking, detect, evaluation, layout, markdown, profile, quantities, retrieval
from ..session import shared_dir, state, table
from ..sources import files
from . import oracle

#: Ranks of the public vocabulary by which tokens are counted.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = oracle.SQL


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under the name of its function."""
    QUERIES[f.__name__] = f
    return f


# --- inputs ---------------------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, root: str) -> DataFrame:
    blocks = table(spark, root, "text_blocks").select(F.lit("text_blocks").alias("origin"), "doc_id", F.col("block_id").alias("row_id"), "text")
    chunks = table(spark, root, "chunks").select(F.lit("chunks").alias("origin"), "doc_id", F.col("chunk_id").alias("row_id"), "text")
    return blocks.unionByName(chunks)


def _distinct_texts(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root).filter("text is not null").select("origin", "row_id", "text").distinct()


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    return layout.latest_blocks(table(spark, root, "text_blocks"))


def _placed(spark: SparkSession, root: str) -> DataFrame:
    """Blocks with their position on the page and the structure type of the table."""
    order = layout.reading_order(_blocks(spark, root)).select("doc_id", "page_num", "block_num", "position")
    return _blocks(spark, root).join(order, ["doc_id", "page_num", "block_num"])


def _markdown(spark: SparkSession, root: str) -> DataFrame:
    return markdown.document_markdown(markdown.page_markdown(_placed(spark, root)))


def _records(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "page_records").distinct()


def _stage(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """Query that applies a column function to every distinct text."""
    return lambda spark, root: _distinct_texts(spark, root).select("origin", "row_id", f(F.col("text")).alias("result"))


def _questions(spark: SparkSession, root: str) -> DataFrame:
    """The stated query set of searches: titles of the documents whose id is divisible by 50."""
    return table(spark, root, "documents").filter("doc_id % 50 = 0 and title is not null").select(F.col("doc_id").alias("query"), F.col("title").alias("text"))


def _index(spark: SparkSession, root: str, column: str = "text") -> bm25.Index:
    """Index of the documents, built once and then read from the shared folder as long as it is there and the table is the same."""
    documents = table(spark, root, "documents")
    key = (spark.sparkContext.applicationId, column, state(spark, f"{root}/documents.parquet"))
    path = _INDEXES.get(key)
    if path is None or not state(spark, path):
        path = _INDEXES[key] = f"{shared_dir(spark)}/documents-index-{uuid.uuid4().hex}"
        bm25.build(documents, "doc_id", column, store=True, path=path)
    return bm25.Index.load(spark, path)


_INDEXES: dict[tuple, str] = {}


# --- detection and layout -------------------------------------------------------------------------------------------


@query
def detect_page_text(spark, root):
    pages = layout.assemble_pages(_blocks(spark, root), threshold=0, fix_hyphens=False)
    return pages.select("doc_id", "page_num", detect.has_text(F.col("full_text")).alias("has_text"))


@query
def detect_doc_type(spark, root):
    return detect.detect_type(_records(spark, root), flag=F.coalesce("has_text", F.lit(False))).withColumn("confidence", F.round("confidence", 6))


@query
def path_check(spark, root):
    return table(spark, root, "source_files").select("doc_id", "revision", detect.valid_path(F.col("file_path")).alias("error"))


@query
def reading_order(spark, root):
    return layout.reading_order(_blocks(spark, root))


def _cut(spark: SparkSession, root: str) -> DataFrame:
    """Blocks of which those with an odd number end with a hyphen; the tables hold next to none."""
    return _blocks(spark, root).withColumn("text", F.when(F.col("block_num") % 2 == 1, F.concat("text", F.lit("-"))).otherwise(F.col("text")))


@query
def dehyphenate(spark, root):
    pages = layout.page_arrays(_cut(spark, root)).withColumn("blocks", layout.dehyphenate(F.col("blocks")))
    return pages.select("doc_id", "page_num", F.posexplode("blocks").alias("position", "b")).select("doc_id", "page_num", "position", F.col("b.seq").alias("block_num"), "b.text")


@query
def merge_blocks(spark, root):
    pages = layout.page_arrays(_blocks(spark, root)).withColumn("blocks", layout.merge_near(F.col("blocks")))
    return pages.select("doc_id", "page_num", F.posexplode("blocks").alias("position", "b")).select("doc_id", "page_num", "position", F.col("b.seq").alias("block_num"), "b.x0", "b.y0", "b.x1", "b.y1", "b.text")


@query
def page_assemble(spark, root):
    pages = layout.assemble_pages(_blocks(spark, root), threshold=0, fix_hyphens=False)
    return layout.all_pages(pages, table(spark, root, "page_records")).select("doc_id", "page_num", "block_count", "char_count", "full_text")


@query
def page_assemble_merged(spark, root):
    return layout.assemble_pages(_cut(spark, root)).select("doc_id", "page_num", "block_count", "char_count", "full_text")


@query
def doc_statistics(spark, root):
    return layout.document_statistics(_records(spark, root).select("doc_id", "block_count", "char_count")).withColumn("avg_blocks_per_page", F.round("avg_blocks_per_page", 6))


@query
def heading_classify(spark, root):
    return layout.classify_headings(_blocks(spark, root)).select("block_id", "structure_type")


# --- text, units, tags ----------------------------------------------------------------------------------------------

for _name, _f in {
    "text_control_chars": text.remove_control, "text_unicode_fix": text.fix_unicode, "text_whitespace": text.fix_spaces, "text_punctuation": text.fix_punctuation,
    "text_normalize": text.normalize_text, "unit_superscript": units.fix_superscripts, "unit_map": units.map_units,
    "unit_spacing": units.fix_spacing, "unit_special": units.fix_special, "unit_normalize": units.normalize_units, "tag_normalize": tags.normalize_tag, "tag_replace": tags.replace_tags,
    "md_list_format": markdown.format_list_item,
}.items():
    QUERIES[_name] = _stage(_f)


@query
def text_technical(spark, root):
    return text.with_technical(_distinct_texts(spark, root), "text", "result").select("origin", "row_id", "result")


@query
def text_paragraphs(spark, root):
    return _distinct_texts(spark, root).select("origin", "row_id", F.posexplode(text.paragraphs(F.col("text"))).alias("seq", "paragraph"))


@query
def unit_extract(spark, root):
    return units.extract_units(_blocks(spark, root), "block_id")


@query
def unit_stats(spark, root):
    found = units.extract_units(_blocks(spark, root), "block_id", keep=("doc_id",))
    return units.unit_statistics(found, "doc_id").drop("variants", "first_seq")


def _tags(spark: SparkSession, root: str, **how) -> DataFrame:
    return tags.extract_tags(_blocks(spark, root), "block_id", **how)


@query
def tag_extract(spark, root):
    return _tags(spark, root)


@query
def tag_extract_isa(spark, root):
    return _tags(spark, root, patterns=tags.ISA_PATTERNS)


@query
def tag_extract_named(spark, root):
    return _tags(spark, root, patterns=[tags.pattern_by_name("pump")])


@query
def tag_custom(spark, root):
    return _tags(spark, root, patterns=[("reference", rf"ref\. {ND}{{7}}/{ND}+")])


@query
def tag_validate(spark, root):
    v = tags.validate_tag(F.col("original"))
    return _tags(spark, root).select("original").distinct().select("original", v["valid"].alias("valid"), v["normalized"].alias("normalized"), v["type"].alias("type"))


@query
def tag_group(spark, root):
    return tags.group_tags(_tags(spark, root), "block_id").select("block_id", "type", F.array_join("tags", ",").alias("tags"))


@query
def tag_stats(spark, root):
    return tags.tag_statistics(_tags(spark, root), "block_id")


@query
def tag_parse_isa(spark, root):
    p = tags.parse_isa_tag(F.col("original"))
    own = _tags(spark, root).select("original").distinct().select("original", p.alias("p"))
    return own.select("original", "p.valid", "p.tag", "p.variable", "p.variable_code", F.array_join("p.functions", ",").alias("functions"), "p.loop_number", "p.suffix")


# --- Markdown and chunks --------------------------------------------------------------------------------------------


@query
def md_runs(spark, root):
    return markdown.structure_runs(_placed(spark, root)).select("block_id", "kind", "run")


@query
def md_page(spark, root):
    return markdown.page_markdown(_placed(spark, root))


@query
def md_document(spark, root):
    info = table(spark, root, "source_files").filter("revision = 1").select("doc_id", "file_path", "total_pages", F.lit(None).cast("bigint").alias("total_blocks"), F.lit(None).cast("bigint").alias("total_characters"))
    return markdown.document_markdown(markdown.page_markdown(_placed(spark, root)), info)


@query
def md_with_structure(spark, root):
    info = table(spark, root, "source_files").filter("revision = 1").select("doc_id", "file_path", "total_pages", F.lit(None).cast("bigint").alias("total_blocks"), F.lit(None).cast("bigint").alias("total_characters"))
    s = markdown.structured_markdown(_placed(spark, root), info)
    shown = lambda c, *f: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in f])), ",")
    return s.select("doc_id", F.length("markdown").alias("n_markdown"), shown("headings", "page", "level", "text").alias("headings"), shown("pages", "page_num", "char_count", "block_count").alias("pages"), "statistics.total_blocks", "statistics.total_characters", "statistics.avg_blocks_per_page", "source_file")


@query
def md_structure(spark, root):
    return markdown.headings(_placed(spark, root))


@query
def chunk_sections(spark, root):
    return chunking.sections(_markdown(spark, root))


@query
def chunk_pack(spark, root):
    docs = table(spark, root, "documents").filter("text is not null")
    return docs.select("doc_id", F.posexplode(chunking.pack(F.col("text"))).alias("sub", "text"))


@query
def chunk_markdown(spark, root):
    return chunking.chunk_markdown(_markdown(spark, root)).drop("metadata")


@query
def chunk_extraction(spark, root):
    return chunking.chunk_blocks(_placed(spark, root)).withColumn("metadata", F.col("metadata")["blocks"])


@query
def chunk_stats(spark, root):
    return chunking.chunk_statistics(chunking.chunk_markdown(_markdown(spark, root)), "doc_id").withColumn("avg_size", F.round("avg_size", 6)).withColumn("levels", F.array_join(F.transform("levels", lambda x: x.cast("string")), ","))


@query
def section_path(spark, root):
    return chunking.section_paths(chunking.sections(_markdown(spark, root))).select("doc_id", "section", "section_path")


@query
def chunk_pack_tokens(spark, root):
    """Packing by tokens, here the pieces between white space."""
    docs = table(spark, root, "documents").filter("text is not null")
    return docs.select("doc_id", F.posexplode(chunking.pack(F.col("text"), 120, 50, tokens.words)).alias("sub", "text"))


@query
def chunk_token_counts(spark, root):
    """Tokens of every chunk by a public vocabulary, where the table has none or a stale number."""
    counter = tokens.TokenCounter(spark, VOCABULARY)
    return table(spark, root, "chunks").select("chunk_id", "loaded_at", counter(F.col("text")).alias("token_count"))


@query
def chunk_doc_id(spark, root):
    return table(spark, root, "source_files").select("file_path", chunking.document_id(F.col("file_path")).alias("hash_id"), chunking.stem_id(F.col("file_path")).alias("stem_id")).distinct()


@query
def expand_window(spark, root):
    """Neighbours of every chunk."""
    chunks = table(spark, root, "chunks")
    hits = chunks.select("doc_id", "chunk_index").distinct()
    one = chunks.select("doc_id", "chunk_index", "chunk_id", "text").distinct()
    return chunking.expand_window(hits, one).select("doc_id", "hit_index", "chunk_index", "chunk_id")


@query
def small_to_big(spark, root):
    """Parents of every chunk."""
    chunks = table(spark, root, "chunks").groupBy("doc_id", "chunk_index", "chunk_id").agg(F.max("text").alias("text"))
    return chunking.expand_parents(chunks, chunking.parent_chunks(chunks))


# --- keyword search -------------------------------------------------------------------------------------------------


@query
def bm25_tokenize(spark, root):
    return table(spark, root, "documents").select("doc_id", F.explode(bm25.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query
def bm25_df_idf(spark, root):
    return _index(spark, root).terms.withColumn("idf", F.round("idf", 6))


@query
def bm25_search(spark, root):
    one = spark.createDataFrame([(1, "screw compressor suction pressure")], "query int, text string")
    return bm25.search(_index(spark, root), one, 10).drop("query").withColumn("score", F.round("score", 6))


@query
def bm25_batch_search(spark, root):
    return bm25.search(_index(spark, root), _questions(spark, root), 5).withColumn("score", F.round("score", 6))


@query
def bm25_min_score(spark, root):
    return bm25.search(_index(spark, root), _questions(spark, root), 20, min_score=8.0).withColumn("score", F.round("score", 6))


@query
def bm25_stats(spark, root):
    return bm25.statistics(_index(spark, root)).withColumn("avg_len", F.round("avg_len", 6))


@query
def bm25_save_load(spark, root):
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    _index(spark, root).save(path)
    return bm25.search(bm25.Index.load(spark, path), _questions(spark, root), 5).withColumn("score", F.round("score", 6))


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Documents to chunks to an index to the five best chunks of a query."""
    docs = table(spark, root, "documents").filter("text is not null")
    chunks = docs.select("doc_id", F.posexplode(chunking.pack(F.col("text"))).alias("sub", "text")).withColumn("chunk_id", chunking.chunk_id(F.col("doc_id").cast("string"), F.col("sub")))
    one = spark.createDataFrame([(1, "screw compressor suction pressure")], "query int, text string")
    hits = bm25.search(bm25.build(chunks, "chunk_id", store=True), one, 5)
    return hits.join(chunks, hits.doc == chunks.chunk_id).select("rank", "chunk_id", "doc_id", F.round("score", 6).alias("score"), "text")


@query
def pipeline_search(spark, root):
    return flagship(spark, root)


# --- profiles -------------------------------------------------------------------------------------------------------


def _once(spark: SparkSession, root: str) -> DataFrame:
    """One row for each block, blank texts kept."""
    b = table(spark, root, "text_blocks")
    fields = ("doc_id", "page_num", "block_num", "text", "font_size", "font_name", "structure_type")
    return b.groupBy("block_id").agg(F.max_by(F.struct(*fields), F.struct("extracted_at", "text")).alias("b")).select("block_id", "b.*")


@query
def qa_profile(spark, root):
    return profile.document_profile(_once(spark, root))


@query
def qa_rotated_pages(spark, root):
    return profile.rotated_pages(table(spark, root, "page_records"))


@query
def qa_charcount_audit(spark, root):
    pages = layout.assemble_pages(_blocks(spark, root), threshold=0, fix_hyphens=False)
    return profile.wrong_counts(pages, table(spark, root, "page_records"))


@query
def qa_structure_hist(spark, root):
    return profile.structure_histogram(_once(spark, root))


@query
def qa_font_stats(spark, root):
    return profile.font_statistics(_once(spark, root))


@query
def qa_font_top5(spark, root):
    return profile.common_fonts(_once(spark, root))


@query
def qa_suspicious(spark, root):
    return profile.suspicious_blocks(_once(spark, root))


@query
def qa_unit_profile(spark, root):
    pages = layout.assemble_pages(_blocks(spark, root), threshold=0, fix_hyphens=False)
    several = F.transform("needs_normalization", lambda x: F.concat_ws("=", x["normalized"], F.array_join(x["variants"], "/")))
    return profile.unit_profile(pages).withColumn("needs_normalization", F.array_join(several, ","))


@query
def qa_symbol_counts(spark, root):
    return profile.symbol_counts(_once(spark, root))


@query
def qa_rollup(spark, root):
    return profile.corpus_rollup(_once(spark, root))


@query
def qa_normalized_blocks(spark, root):
    return profile.normalized_blocks(_once(spark, root))


@query
def qa_first_of_structure(spark, root):
    return profile.first_of_structure(_once(spark, root))


@query
def qa_specification_rows(spark, root):
    """Lines of chunks read as a parameter table, under a head put before each text; the tables hold no such head."""
    chunks = table(spark, root, "chunks").filter("text is not null").select("chunk_id", F.concat(F.lit("Parameter Value Unit\n"), "text").alias("text")).distinct()
    return profile.specification_rows(chunks, "chunk_id")


@query
def qa_page_flag(spark, root):
    return profile.page_flags(_records(spark, root))


# --- sources and service --------------------------------------------------------------------------------------------


@query
def ingest_changed_only(spark, root):
    every = table(spark, root, "source_files").select("doc_id", "revision", "checksum")
    return files.changed_files(every.filter("revision > 1"), every.filter("revision = 1"))


@query
def map_mask(spark, root):
    """Metadata of chunks with a secret header put among it, masked."""
    full = F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("X-API-Key"), F.col("chunk_id")))
    masked = table(spark, root, "chunks").select("chunk_id", "loaded_at", service.mask_headers(full).alias("m"))
    return masked.select("chunk_id", "loaded_at", F.col("m")["profile"].alias("profile"), F.col("m")["X-API-Key"].alias("key"))


@query
def uptime_format(spark, root):
    return table(spark, root, "source_files").select("doc_id", "revision", service.format_uptime(F.col("file_size")).alias("uptime"))


# --- retrieval and evaluation ---------------------------------------------------------------------------------------


@query
def vec_topk(spark, root):
    v = table(spark, root, "embeddings")
    return retrieval.vector_top_k(v, v.filter("vec_id % 50 = 0"), 10).withColumn("score", F.round("score", 6))


@query
def rrf_fuse(spark, root):
    by_text = bm25.search(_index(spark, root), _questions(spark, root), 50)
    by_title = bm25.search(_index(spark, root, "title"), _questions(spark, root), 50)
    return retrieval.fuse_rankings(by_text, by_title, top=20).withColumn("score", F.round("score", 6))


@query
def metadata_filter(spark, root):
    return retrieval.only(table(spark, root, "documents"), doc_category=["sop", "manual"], lang=["en"]).select("doc_id", "doc_category", "lang")


@query
def locate_tag(spark, root):
    return retrieval.locate_tag(_blocks(spark, root), "kt 228").drop("bbox")


@query
def query_intent(spark, root):
    return table(spark, root, "eval_items").select("item_id", retrieval.intent(F.col("question")).alias("intent"), retrieval.normalize_query(F.col("question")).alias("normalized"))


@query
def doc_category_rules(spark, root):
    return table(spark, root, "documents").select("doc_id", retrieval.document_category(F.col("title")).alias("category"))


@query
def recall_mrr_ndcg(spark, root):
    hits = bm25.search(_index(spark, root), _questions(spark, root), 10)
    relevant = _questions(spark, root).join(table(spark, root, "documents").select("doc_id", "title"), F.col("text") == F.col("title")).select("query", F.col("doc_id").alias("doc"))
    return evaluation.ranking_measures(hits, relevant, 10)


@query
def citation_pr(spark, root):
    chunks = table(spark, root, "chunks").withColumn("query", F.col("metadata")["profile"])
    return evaluation.citation_measures(chunks.select("query", "doc_id", F.col("page_start").alias("page")), chunks.select("query", "doc_id", F.col("page_end").alias("page")))


@query
def latency_percentiles(spark, root):
    events = table(spark, root, "events").select("event_type", F.date_trunc("day", "ts").alias("day"), F.col("value").alias("latency"), (F.col("event_type") == "error").alias("failed"))
    return evaluation.latency_report(events, "event_type", "day")


@query
def cache_hit_rate(spark, root):
    events = table(spark, root, "events").select("event_type", F.col("value").alias("latency"), (F.col("event_type") == "error").alias("failed"), (F.col("user_id") % 3 == 0).alias("cached"))
    return evaluation.latency_report(events, "event_type")


@query
def alert_windows(spark, root):
    events = table(spark, root, "events").select("ts", F.col("value").alias("latency"), (F.col("event_type") == "error").alias("failed"))
    return evaluation.alerts(events, max_p95=100.0, max_errors=0.5)


@query
def stratified_sample(spark, root):
    return evaluation.stratified_sample(table(spark, root, "eval_items"), ["category", "difficulty"], 3, "item_id").select("item_id", "category", "difficulty")


@query
def config_score(spark, root):
    """Sites as configurations, with shares of their documents as parts."""
    d = table(spark, root, "documents").filter("source is not null")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    runs = d.groupBy("source").agg(
        share(F.col("lang") == "en").alias("faithfulness"), share(F.col("title").isNotNull()).alias("citation"), share(F.col("doc_category") == "sop").alias("recall_at_10"),
        share(F.col("n_chars") > 1000).alias("latency"), share(F.col("n_chars").isNull()).alias("cost"),
    )
    return evaluation.configuration_score(runs).select("source", "score")


@query
def cohen_kappa(spark, root):
    both = table(spark, root, "source_files").join(table(spark, root, "sites").select("site", "main_lang"), "site")
    return evaluation.cohen_kappa(both, "lang", "main_lang")


@query
def distinct_context(spark, root):
    """Texts are compared by their digests, so that none is moved."""
    hits = bm25.search(_index(spark, root), _questions(spark, root), 10)
    texts = table(spark, root, "documents").select(F.col("doc_id").alias("doc"), F.unhex(F.sha2("text", 256)).alias("text"))
    return retrieval.distinct_context(hits.join(texts, "doc")).select("query", "doc", "rank")


# --- quantities -----------------------------------------------------------------------------------------------------


def _quantity_inputs(spark: SparkSession, root: str) -> tuple[DataFrame, ...]:
    return _texts(spark, root), table(spark, root, "source_files"), table(spark, root, "sites"), table(spark, root, "unit_reference")


@query
def p2_found(spark, root):
    return quantities.find_foreign_quantities(*_quantity_inputs(spark, root))


@query
def p2_values(spark, root):
    return quantities.quantities(*_quantity_inputs(spark, root))


