"""Retrieval beside keywords: vectors, fusion of rankings, filters, and finding a tag on the page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import WS
from ..functions.tags import extract_tags, normalize_tag
from ..session import require

#: Query vectors scored in one pass over the table; a larger query set takes more passes.
QUERY_BLOCK = 4096

# Words that carry no meaning in a query.
STOPWORDS = "a an and are as at be by for from in is it of on or the to was what which with và là của các cho có trong một những được".split()


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` vectors of the highest cosine for each query: ``query``, ``id``, ``score``, ``rank``; a query may find itself.

    Exact.  A block of query vectors goes to every worker, each partition keeps
    its best ``k`` per query, and only these are ranked together.  Null, empty and
    zero vectors score nothing; ties go to the smaller id.  Vectors of another
    length than the query are left out.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = require(vectors, id_col, vector_col).filter(F.size(vector_col) > 0)
    out: DataFrame | None = None
    block: list[tuple] = []

    def scored(part: list[tuple]) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(([r[0] for r in part], np.array([r[1] for r in part], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            size = np.linalg.norm(q, axis=1, keepdims=True)
            q = q / np.where(size == 0, 1, size)
            best: list[list[tuple[float, object]]] = [[] for _ in names]
            for batch in batches:
                lists = batch.column(1)
                same = [i for i, n in enumerate(pa.compute.list_value_length(lists).to_pylist()) if n == q.shape[1]]
                if not same:
                    continue
                own = lists.take(pa.array(same))
                v = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(same), -1)
                ids = batch.column(0).take(pa.array(same)).to_pylist()
                norm = np.linalg.norm(v, axis=1)
                ok = np.isfinite(norm) & (norm > 0)
                scores = np.round((q @ np.where(ok[:, None], v, 0).T) / np.where(ok, norm, 1), 9)
                scores[:, ~ok] = -np.inf
                for i, row in enumerate(scores):
                    near = np.argpartition(-row, min(k, len(row)) - 1)[:k] if len(row) > k else np.arange(len(row))
                    edge = row[near].min()
                    near = np.flatnonzero(row >= edge) if len(row) > k else near
                    best[i] = sorted(best[i] + [(-row[j], ids[j]) for j in near.tolist() if np.isfinite(row[j])])[:k]
            found = [(n, i, -s) for n, b in zip(names, best) for s, i in b]
            cols = list(zip(*found)) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], id_type), pa.array(cols[2], pa.float64())], names=["query", "id", "score"])

        return rows.mapInArrow(run, f"query {kind}, id {kind}, score double")

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(vectors.schema[id_col].dataType)
    parts: list[DataFrame] = []
    for r in require(queries, id_col, vector_col).filter(F.size(vector_col) > 0).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == QUERY_BLOCK:
            parts.append(scored(block))
            block = []
    if block or not parts:
        parts.append(scored(block) if block else vectors.sparkSession.createDataFrame([], f"query {kind}, id {kind}, score double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def fuse_rankings(*rankings: DataFrame, k: int = 60, top: int = 60, id_col: str = "doc") -> DataFrame:
    """Reciprocal rank fusion of rankings (``query``, ``id_col``, ``rank``): ``query``, ``id_col``, ``score``, ``rank``; ties by id."""
    all_ = rankings[0].select("query", id_col, "rank")
    for r in rankings[1:]:
        all_ = all_.unionByName(r.select("query", id_col, "rank"))
    fused = all_.groupBy("query", id_col).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), id_col))
    return fused.withColumn("rank", rank).filter(F.col("rank") <= top)


def only(rows: DataFrame, **allowed: list) -> DataFrame:
    """Rows whose columns have one of the allowed values; an empty list allows nothing, None everything."""
    for column, values in allowed.items():
        if values is not None:
            rows = rows.filter(F.col(column).isin(list(values)))
    return rows


def locate_tag(blocks: DataFrame, tag: str) -> DataFrame:
    """Blocks that carry a tag: ``doc_id``, ``page_num``, ``block_id``, ``bbox``, ``snippet``, ``score``; those with a box first.

    The score is the share of the block's text that the tag makes up.
    """
    hits = extract_tags(blocks, "block_id").filter(F.col("normalized") == normalize_tag(F.lit(tag))).select("block_id", (F.col("end") - F.col("start")).alias("_n")).groupBy("block_id").agg(F.max("_n").alias("_n"))
    found = blocks.join(hits, "block_id").select("doc_id", "page_num", "block_id", "bbox", F.substring("text", 1, 120).alias("snippet"), F.round(F.col("_n") / F.length("text"), 6).alias("score"))
    return found.orderBy(F.col("bbox").isNotNull().desc(), F.desc("score"), "doc_id", "page_num", "block_id")


def intent(query: Column) -> Column:
    """Kind of a question: locate, report, explain or qa."""
    q = F.lower(query)
    return (
        F.when(q.rlike(r"where is|locate|which page|find tag|ở đâu|vị trí|trang nào"), "locate").when(q.rlike(r"report|summar|list all|báo cáo|tổng hợp|liệt kê"), "report")
        .when(q.rlike(r"\bwhy\b|explain|how does|tại sao|vì sao|giải thích"), "explain").otherwise("qa")
    )


def document_category(title: Column) -> Column:
    """Category of a document from its title: pid, datasheet, sop, om or other."""
    t = F.lower(title)
    return F.when(t.rlike(r"p&id|\bpid\b|piping and instrument"), "pid").when(t.rlike(r"data ?sheet|bảng dữ liệu|specification"), "datasheet").when(t.rlike(r"\bsop\b|procedure|quy trình"), "sop").when(t.rlike(r"manual|operation|maintenance|hướng dẫn|bảo dưỡng"), "om").otherwise("other")


def normalize_query(query: Column) -> Column:
    """Query in lower case, with single spaces and without stop words; a query of stop words alone keeps them."""
    words = F.filter(F.split(F.lower(query), f"{WS}+", -1), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(STOPWORDS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def distinct_context(hits: DataFrame, text_col: str = "text") -> DataFrame:
    """Hits without repeated texts within a query; the best rank stays, null texts count as one text."""
    first = F.row_number().over(Window.partitionBy("query", text_col).orderBy("rank"))
    return hits.withColumn("_n", first).filter(F.col("_n") == 1).drop("_n")
