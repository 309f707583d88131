import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from scriptoria.functions import tokens
from scriptoria.operators import bm25, chunking, detect, evaluation, layout, markdown, profile, retrieval
from scriptoria.sources import files
from scriptoria.streaming import ingest

BLOCK = "doc_id string, page_num int, block_num int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, font_size double, font_name string"


def blocks_of(spark, *rows, page=0):
    return spark.createDataFrame([("d", page, i, t, None if b is None else tuple(map(float, b)), fs, "f") for i, (t, b, fs) in enumerate(rows)], BLOCK)


# --- detection


@pytest.mark.parametrize("flags, kind, sure", [([], "unknown", 0.0), ([1] * 5, "vector", 1.0), ([0] * 5, "scan", 1.0), ([1, 0, 0, 0, 0], "mixed", 0.8), ([1, 1, 0, 0, 0], "mixed", 0.6), ([1, 1, 1, 1, 0], "mixed", 0.8), ([1] * 5 + [0] * 9, "vector", 1.0)])
def test_types(spark, flags, kind, sure):
    rows = [("d", n, "x" * (51 if f else 50)) for n, f in enumerate(flags)] or [("d", 7, "late page")]
    got = detect.detect_type(spark.createDataFrame(rows, "doc_id string, page_num int, text string")).first()
    assert (got.type, round(got.confidence, 6)) == (kind, sure)


def test_paths(spark):
    df = spark.createDataFrame([("a.PDF", True), ("b.txt", True), ("c.pdf", False), (None, True)], "p string, e boolean")
    assert [r[0] for r in df.select(detect.valid_path(F.col("p"), F.col("e"))).collect()] == [None, "not a PDF file", "file not found", "file not found"]


# --- layout


def test_spans(spark):
    row = ("d", 0, [(0, [([("  a ", (0.0, 0.0, 1.0, 1.0), 9.0, "f"), (" ", (0.0, 0.0, 1.0, 1.0), 9.0, "f")],), ([("b", (0.0, 0.0, 1.0, 1.0), 8.0, "f")],)]), (1, [])])
    schema = "doc_id string, page_num int, blocks array<struct<type:int,lines:array<struct<spans:array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,size:double,font:string>>>>>>"
    assert [(r.block_num, r.text) for r in layout.scan_spans(spark.createDataFrame([row], schema)).orderBy("block_num").collect()] == [(0, "a"), (1, "b")]


def texts_of(df, column):
    return [[b.text for b in r[0]] for r in df.select(column).collect()][0]


def test_hyphens(spark):
    pages = layout.page_arrays(blocks_of(spark, ("This is a hyphen-", (0, 0, 9, 9), 9.0), ("ated word example-", (0, 20, 9, 29), 9.0), ("Another line", (0, 40, 9, 49), 9.0), ("end-", (0, 60, 9, 69), 9.0)))
    assert texts_of(pages, layout.dehyphenate(F.col("blocks"))) == ["This is a hyphenated", "word example-", "Another line", "end-"]
    near = layout.page_arrays(blocks_of(spark, ("pre-", (0, 0, 9, 9), 9.0), ("fix", (10, 5, 19, 9), 9.0)))
    assert texts_of(near, layout.dehyphenate(F.col("blocks"))) == ["pre-", "fix"]
    one = layout.page_arrays(blocks_of(spark, ("hy-", (0, 0, 9, 9), 9.0), ("phen", (0, 20, 9, 29), 9.0)))
    assert texts_of(one, layout.dehyphenate(F.col("blocks"))) == ["hyphen"]


def test_merging_uses_the_grown_box(spark):
    pages = layout.page_arrays(blocks_of(spark, ("a", (0, 0, 10, 10), 9.0), ("b", (25, 9, 40, 19), 8.0), ("c", (59, 9.5, 70, 19), 7.0), ("d", (200, 9.6, 210, 19), 7.0), ("e", None, None)))
    got = [(b.text, b.x0, b.y0, b.x1) for b in pages.select(layout.merge_near(F.col("blocks"))).first()[0]]
    assert got == [("a e b c", 0.0, 0.0, 70.0), ("d", 200.0, 9.6, 210.0)]


def test_pages(spark):
    pages = layout.assemble_pages(blocks_of(spark, ("b", (0, 200, 5, 210), 9.0), ("a", (0, 100, 5, 110), 9.0)))
    r = pages.first()
    assert (r.full_text, r.char_count, r.block_count) == ("a b", 3, 2)
    records = spark.createDataFrame([("d", 0, 595.0, 842.0, 90, 1), ("d", 0, 595.0, 842.0, 90, 1), ("d", 1, 595.0, 842.0, None, 0)], "doc_id string, page_num int, width double, height double, rotation int, image_count int")
    every = {x.page_num: x for x in layout.all_pages(pages, records).collect()}
    assert len(every) == 2 and (every[1].block_count, every[1].full_text, every[0].rotation) == (0, "", 90)
    s = layout.document_statistics(layout.all_pages(pages, records)).first()
    assert (s.total_pages, s.total_blocks, s.total_characters, s.avg_blocks_per_page) == (2, 2, 3, 1.0)


def test_headings(spark):
    df = blocks_of(spark, *[("x", (0, i, 1, 1), s) for i, s in enumerate([20.0, 12.0, 11.0, 10.0, 0.0, None, 4.0, 3.0])])
    got = {r.block_num: r.structure_type for r in layout.classify_headings(df).collect()}
    assert got == {0: "heading1", 1: "heading2", 2: "heading3", 3: "paragraph", 4: "unknown", 5: "unknown", 6: "paragraph", 7: "paragraph"}
    none = layout.classify_headings(blocks_of(spark, ("x", (0, 0, 1, 1), None))).first()
    assert none.structure_type is None


# --- Markdown


def placed(spark, *rows):
    return spark.createDataFrame([("d", p, i, t, k, fs) for i, (p, t, k, fs) in enumerate(rows)], "doc_id string, page_num int, position int, text string, structure_type string, font_size double")


def test_page_markdown(spark):
    df = placed(spark, (0, "Title", "heading1", 20.0), (0, "Sub", "heading3", 15.0), (0, "1) one", None, 9.0), (0, "• two", "paragraph", 9.0), (0, " ", "heading2", None), (0, "x", "unknown", 9.0))
    assert markdown.page_markdown(df).first().markdown == "<!-- Page 1 -->\n\n# Title\n\n## Sub\n\n1. one\n- two\n\n\n\nx"


def test_document_markdown(spark):
    pages = markdown.page_markdown(placed(spark, (0, "a", None, 9.0), (1, "b", None, 9.0)))
    info = spark.createDataFrame([("d", "f.pdf", 2, 2, None)], "doc_id string, file_path string, total_pages int, total_blocks int, total_characters int")
    assert markdown.document_markdown(pages, info).first().markdown == "---\nsource: f.pdf\ntotal_pages: 2\ntotal_blocks: 2\ntotal_characters: 0\n---\n\n<!-- Page 1 -->\n\na\n\n---\n\n<!-- Page 2 -->\n\nb"
    assert markdown.document_markdown(pages, page_breaks=False).first().markdown == "<!-- Page 1 -->\n\na\n<!-- Page 2 -->\n\nb"


# --- chunks


def brute_pack(text, most, overlap):
    out, buf, cur = [], [], 0
    for p in text.split("\n\n"):
        if cur + len(p) > most and buf:
            out.append("\n\n".join(buf))
            buf, cur = ([buf[-1], p], len(p) + len(buf[-1])) if overlap else ([p], len(p))
        else:
            buf.append(p)
            cur += len(p)
    return [*out, "\n\n".join(buf)] if buf else out


@pytest.mark.parametrize("most, overlap", [(10, 0), (10, 5), (1, 1), (100, 1)])
def test_packing(apply, most, overlap):
    texts = ["aaaa\n\nbbbb\n\ncccc\n\ndddddddddddddddd\n\ne", "", "one", "\n\n\n\n"]
    assert apply(lambda t: chunking.pack(t, most, overlap), *texts) == [brute_pack(t, most, overlap) for t in texts]


MD = "\n\nintro <!-- Page 9 -->\nmore\n# Head one\n<!-- Page 1 -->\ntext\n<!-- Page 3 -->\n##Empty\n### \nlast"


def test_sections(spark):
    got = [(r.section, r.heading, r.level, r.content, r.page_start, r.page_end) for r in chunking.sections(spark.createDataFrame([("d", MD), ("e", ""), ("f", None)], "doc_id string, markdown string")).orderBy("doc_id", "section").collect()]
    assert got == [(0, None, 0, "intro <!-- Page 9 -->\nmore", 0, 0), (1, "Head one", 1, "<!-- Page 1 -->\ntext\n<!-- Page 3 -->", 2, 2), (2, "Empty", 2, "", 0, 0), (3, "", 3, "last", 0, 0)]


def test_chunks_of_markdown(spark):
    df = spark.createDataFrame([("d", MD)], "doc_id string, markdown string")
    got = [(r.chunk_id, r.heading, r.token_count, r.parent_chunk_id) for r in chunking.chunk_markdown(df).orderBy("chunk_index").collect()]
    assert got == [("d_chunk_0000", None, 0, None), ("d_chunk_0001", "Head one", 0, None), ("d_chunk_0002", "", 0, None)]
    words = lambda t: F.size(F.split(t, r"\s+"))
    assert chunking.chunk_markdown(df, 3, 0, tokens=words).agg(F.max("token_count")).first()[0] > 0
    assert spark.range(1).select(chunking.chunk_id(F.lit("d"), F.lit(12345))).first()[0] == "d_chunk_12345"


def test_chunks_of_blocks(spark):
    df = placed(spark, (0, "before", None, 9.0), (0, "Head", "heading1", 9.0), (0, "a", "paragraph", 9.0), (0, "b", "unknown", 9.0), (0, "Bare", "heading3", 9.0), (1, "c", None, 9.0))
    got = [(r.chunk_index, r.heading, r.level, r.text, r.page_start, r.metadata["blocks"]) for r in chunking.chunk_blocks(df).orderBy("chunk_index").collect()]
    assert got == [(0, None, 0, "before", 0, "1"), (1, "Head", 1, "a\nb", 0, "2"), (2, "Bare", 3, "", 0, "0"), (3, None, 0, "c", 1, "1")]
    s = chunking.chunk_statistics(chunking.chunk_blocks(df), "doc_id").first()
    assert (s.total_chunks, s.min_size, s.max_size, s.total_size, s.levels, s.first_page, s.last_page) == (4, 0, 6, 10, [0, 1, 3], 0, 1)
    empty = chunking.chunk_statistics(chunking.chunk_blocks(df).filter("false")).first()
    assert (empty.total_chunks, empty.avg_size, empty.total_size) == (0, 0.0, 0)


def test_ids_and_windows(spark):
    row = spark.createDataFrame([("x/Data Sheet for CO2 Compressor.rev0.pdf",)], "p string").select(chunking.document_id(F.col("p")), chunking.stem_id(F.col("p")), chunking.document_id(F.lit(None).cast("string"))).first()
    assert len(row[0]) == 8 and row[1] == "Data_Sheet_for_CO2_C" and row[2] == "unknown"
    chunks = spark.createDataFrame([("d", i, f"c{i}", "t") for i in range(4)], "doc_id string, chunk_index int, chunk_id string, text string")
    hits = spark.createDataFrame([("d", 0), ("d", 2)], "doc_id string, chunk_index int")
    assert sorted((r.hit_index, r.chunk_index) for r in chunking.expand_window(hits, chunks).collect()) == [(0, 0), (0, 1), (2, 1), (2, 2), (2, 3)]


def test_parents(spark):
    chunks = spark.createDataFrame([("d", i, f"c{i}", t) for i, t in enumerate(["aaaa", None, "bbbb", "cc", "dddddddd"])], "doc_id string, chunk_index int, chunk_id string, text string")
    got = chunking.parent_chunks(chunks, 5)
    assert [r.parent_chunk_id[-1] for r in got.orderBy("chunk_index").collect()] == ["0", "0", "0", "1", "2"]
    big = chunking.expand_parents(spark.createDataFrame([("c0",), ("c2",), ("none",)], "chunk_id string"), got).collect()
    assert [(r.n_chunks, r.text) for r in big] == [(3, "aaaa\n\nbbbb")]


# --- keyword search


def okapi(texts, query, k1=1.2, b=0.75, eps=0.25):
    import re

    words = lambda t: [w for w in re.findall(r"\w+", (t or "").lower()) if len(w) > 2]
    docs = [words(t) for t in texts]
    avg = sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else eps * mean for w, v in idf.items()}
    return [sum(idf.get(w, 0) * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / avg)) for w in words(query)) for d in docs]


TEXTS = ["steam turbine casing", "compressor steam drain steam", "the pump and the compressor", "áp suất vận hành", "", None, "steam the valve and the line"]


@pytest.mark.parametrize("query", ["steam compressor", "the steam the", "unknown words", "áp suất", ""])
def test_search_against_formula(spark, query, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc int, text string")
    index = bm25.build(df, "doc")
    index.save(str(tmp_path / "index"))
    want = sorted(((round(s, 9), i) for i, s in enumerate(okapi(TEXTS, query))), reverse=True)
    for own in (index, bm25.Index.load(spark, str(tmp_path / "index"))):
        got = bm25.search(own, spark.createDataFrame([(1, query)], "query int, text string"), 5).orderBy("rank").collect()
        assert [(r.doc, round(r.score, 6)) for r in got] == [(i, round(s, 6)) for s, i in want[:5]]
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]


def test_search_edges(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc int, text string")
    index = bm25.build(df, "doc")
    q = spark.createDataFrame([(1, "steam"), (1, "steam"), (2, "nothing")], "query int, text string")
    assert bm25.search(index, q, 3, min_score=0.01).select("query").distinct().count() == 1
    assert bm25.search(index, q, 2).count() == 4
    empty = bm25.build(df.filter("false"), "doc")
    assert bm25.search(empty, q, 3).count() == 0 and bm25.statistics(empty).first().status == "empty"
    s = bm25.statistics(index).first()
    assert (s.num_documents, s.min_len, s.total_tokens, s.status) == (7, 0, 21, "ready")
    assert bm25.rerank(q) is q


def shuffled(df):
    """Rows that the plan of a collected table has written to shuffles."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        found = p.metrics().get("shuffleRecordsWritten")
        total += found.get().value() if found.isDefined() else 0
        children = p.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return total


def test_batch_search_over_segments(spark, monkeypatch):
    """Many queries over several segments, with ties and fillers, against the formula; no row for each pair of query and document."""
    monkeypatch.setattr(bm25, "SEGMENT_WORDS", 150, raising=False)
    monkeypatch.setattr(bm25, "SEGMENT_DOCS", 40, raising=False)
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 30, raising=False)
    rng = random.Random(3)
    common, rare = ["pump", "valve", "the", "seal"], [f"tag{i}" for i in range(60)]
    texts = [" ".join(rng.choices(common, k=rng.randint(1, 6)) + rng.choices(rare, k=rng.randint(0, 2))) for _ in range(400)]
    texts[7], texts[8], texts[9] = None, "", "the " * 300
    asked = [" ".join(rng.choices(common, k=2) + rng.choices(rare, k=rng.randint(0, 2))) for _ in range(70)] + ["", "unknown"]
    index = bm25.build(spark.createDataFrame([(f"d{i:03}", t) for i, t in enumerate(texts)], "doc string, text string").repartition(2), "doc")
    queries = spark.createDataFrame([*enumerate(asked), (None, "pump seal")], "query int, text string")
    hits = bm25.search(index, queries, 6)
    got: dict = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append((r.doc, round(r.score, 6)))
    for q, text in [*enumerate(asked), (None, "pump seal")]:
        want = sorted(((round(s, 9), f"d{i:03}") for i, s in enumerate(okapi(texts, text))), reverse=True)[:6]
        assert got[q] == [(i, round(s, 6)) for s, i in want], text
    assert 0 < shuffled(hits) < len(texts) * len(asked) / 4
    few = spark.createDataFrame([(1, "pump tag5")], "query int, text string")
    every = {r.doc: round(r.score, 6) for r in bm25.scores(index, few).collect()}
    assert every == {f"d{i:03}": round(s, 6) for i, s in enumerate(okapi(texts, "pump tag5")) if {"pump", "tag5"} & set((texts[i] or "").split())}


@pytest.mark.parametrize("n_docs", [60, 1200])
def test_search_rows_grow_with_queries_only(spark, monkeypatch, n_docs):
    """However many segments and partitions an index has, each core gives out its best once."""
    monkeypatch.setattr(bm25, "SEGMENT_DOCS", 10)
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["pump", "valve", "seal", "casing"], k=rng.randint(1, 4)) + [f"tag{i}"] * (i % 7)) for i in range(n_docs)]
    index = bm25.build(spark.createDataFrame([*enumerate(texts)], "doc int, text string").repartition(6), "doc")
    queries = spark.createDataFrame([(i, f"pump tag{i}") for i in range(20)], "query int, text string")
    terms = index.terms
    block = [(q.query, terms.filter(terms.term.isin(q.text.split())).selectExpr("term", "idf as weight").collect()) for q in queries.collect()]
    asked = terms.select(bm25.bucket(terms.term).alias("bucket"), "term")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = bm25._best(index, asked, block, queries.schema["query"].dataType, 3)
        assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        hits = bm25.search(index, queries, 3).orderBy("query", "rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i in (0, 1, 7, 19):
        want = sorted(((round(s, 9), d) for d, s in enumerate(okapi(texts, f"pump tag{i}"))), reverse=True)[:3]
        assert [(round(r.score, 6), r.doc) for r in hits if r.query == i] == [(round(s, 6), d) for s, d in want]


def test_search_gives_out_nothing_below_min_score(spark):
    texts = [f"pump valve item{i}" if i % 10 else "pump casing flange gasket" for i in range(200)]
    index = bm25.build(spark.createDataFrame([*enumerate(texts)], "doc int, text string").repartition(4), "doc")
    queries = spark.createDataFrame([(1, "casing flange"), (2, "item7"), (3, "nothing")], "query int, text string")
    every = {q: sorted(((round(s, 9), d) for d, s in enumerate(okapi(texts, t))), reverse=True)[:20] for q, t in ((1, "casing flange"), (2, "item7"), (3, "nothing"))}
    for least in (1.0, every[1][0][0], every[2][0][0] + 0.5):
        hits = bm25.search(index, queries, 20, min_score=least)
        got = [(r.query, round(r.score, 6), r.doc) for r in hits.orderBy("query", "rank").collect()]
        assert got == [(q, round(s, 6), d) for q in every for s, d in every[q] if s >= least]
    some, whole = bm25.search(index, queries, 20, min_score=1.0), bm25.search(index, queries, 20)
    assert (len(some.collect()), len(whole.collect())) == (21, 60)
    assert shuffled(some) < shuffled(whole)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_equal_scores_give_no_further_rows(spark, monkeypatch, kind):
    """Of documents that score the same, in whichever segment, the last ids are given out and no more."""
    monkeypatch.setattr(bm25, "SEGMENT_DOCS", 10)
    ids = random.Random(1).sample(range(1000), 400)
    rows = spark.createDataFrame([(i, "pump valve" if i % 2 else "casing") for i in ids] + [(None, "pump valve")], "doc int, text string").selectExpr(f"cast(doc as {kind}) as doc", "text")
    index = bm25.build(rows.repartition(3), "doc")
    hits = bm25.search(index, spark.createDataFrame([(1, "pump"), (2, "unknown")], "query int, text string"), 4)
    got = [(r.query, r.doc) for r in hits.orderBy("query", "rank").collect()]
    of = [int, str][kind == "string"]
    every = sorted(map(of, ids), reverse=True)
    assert got == [(1, i) for i in [i for i in every if int(i) % 2][:4]] + [(2, i) for i in every[:4]]
    given = bm25._best(index, index.terms.select(bm25.bucket(index.terms.term).alias("bucket"), "term"), [(1, []), (2, [])], IntegerType(), 4)
    assert given.count() <= 2 * 4 * spark.sparkContext.defaultParallelism


def shuffled_by_jobs(spark, f):
    """Rows that all jobs of a function have written to shuffles."""
    group = f"shuffled-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        f()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_saving_a_stored_index_moves_nothing(spark, tmp_path):
    texts = [f"pump valve item{i} item{i % 50}" for i in range(300)]
    made = bm25.build(spark.createDataFrame([*enumerate(texts)], "doc int, text string").repartition(4), "doc")
    assert shuffled_by_jobs(spark, lambda: bm25._save_postings(made.postings, str(tmp_path / "other"))) > 0
    made.save(str(tmp_path / "index"))
    stored = bm25.Index.load(spark, str(tmp_path / "index"))
    assert shuffled_by_jobs(spark, lambda: stored.save(str(tmp_path / "again"))) == 0
    again = bm25.Index.load(spark, str(tmp_path / "again"))
    key = lambda i: sorted((r.segment, r.term or "", r.bucket, r.n, bytes(r.places or b""), bytes(r.counts or b""), r.docs or [], r.lens or []) for r in i.postings.collect())
    assert key(again) == key(stored) == key(made)
    assert sorted(again.terms.collect()) == sorted(stored.terms.collect()) and again.corpus.collect() == stored.corpus.collect()


# --- profiles


def test_profiles(spark):
    df = spark.createDataFrame([("b1", "d", 0, "Hello", 9.0, None), ("b2", "d", 0, " ", 10.0, "paragraph"), ("b3", "d", 1, None, None, "paragraph"), ("b4", "e", 0, "5 m³/h × 3 ℃℃ é", 0.0, "heading1")], "block_id string, doc_id string, page_num int, text string, font_size double, structure_type string")
    p = {r.doc_id: r for r in profile.document_profile(df).collect()}
    assert (p["d"].pages, p["d"].blocks, p["d"].chars, p["d"].empty_blocks, p["d"].empty_percent) == (2, 3, 6, 2, 66.666667)
    assert {r.structure_type: (r.n, r.percent) for r in profile.structure_histogram(df).collect()} == {"unknown": (1, 25.0), "paragraph": (2, 50.0), "heading1": (1, 25.0)}
    assert [(r.doc_id, r.min_size, r.max_size) for r in profile.font_statistics(df).collect()] == [("d", 9.0, 10.0)]
    assert [r.block_id for r in profile.suspicious_blocks(df).collect()] == ["b4"]
    assert {r.symbol: r.n for r in profile.symbol_counts(df).collect()} == {"℃": 2, "m³/h": 1, "×": 1, "³": 1}
    total = [r for r in profile.corpus_rollup(df).collect() if r.doc_id is None][0]
    assert (total.blocks, total.empty_blocks, total.warning) == (4, 2, True)
    assert profile.corpus_rollup(df.filter("false")).filter("blocks > 0").count() == 0


def test_specification_rows(spark):
    df = spark.createDataFrame([(1, "x\nParameter Value Unit\nFlow 10 - 20 kg/h\nName ABC\nlone\nNotes: end\nFlow 1 m")], "id int, text string")
    assert [(r.parameter, r.value, r.unit) for r in profile.specification_rows(df, "id").orderBy("seq").collect()] == [("Flow", "10 - 20", "kg/h"), ("Name", "ABC", None)]


# --- retrieval and evaluation


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = [[float(x) for x in r] for r in rng.normal(size=(60, 8))]
    rows = [(i, x) for i, x in enumerate(v)] + [(100, None), (101, [0.0] * 8), (102, [1.0]), (103, v[0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = {}
    for r in retrieval.vector_top_k(df, df.filter("vec_id in (0, 7, 100)"), 5).collect():
        got.setdefault(r.query, []).append((r["rank"], r.id))
    a = np.array([np.float32(x).astype(float) for x in v])
    for q in (0, 7):
        s = {i: round(float(a[q] @ a[i] / np.linalg.norm(a[q]) / np.linalg.norm(a[i])), 9) for i in range(60)} | {103: round(float(a[q] @ a[0] / np.linalg.norm(a[q]) / np.linalg.norm(a[0])), 9)}
        want = sorted(s, key=lambda i: (-s[i], i))[:5]
        assert [i for _, i in sorted(got[q])] == want
    assert 100 not in got
    assert retrieval.vector_top_k(df, df.filter("false"), 5).count() == 0


def test_fusion_and_rules(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, doc int, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query int, doc int, rank int")
    assert [(r.doc, r.score) for r in retrieval.fuse_rankings(a, b).orderBy("rank").collect()] == [(11, round(1 / 62 + 1 / 61, 9)), (10, round(1 / 61, 9))]
    q = spark.createDataFrame([("Where is PV-101?",), ("Why does it leak",), ("the of",), (None,)], "q string").select(retrieval.intent(F.col("q")), retrieval.normalize_query(F.col("q"))).collect()
    assert [r[0] for r in q] == ["locate", "explain", "qa", "qa"] and q[2][1] == "the of"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    assert retrieval.only(rows, k=["a"]).count() == 1 and retrieval.only(rows, k=[]).count() == 0 and retrieval.only(rows, k=None).count() == 3


def test_measures(spark):
    hits = spark.createDataFrame([(1, 5, 2), (1, 6, 1), (1, 5, 2)], "query int, doc int, rank int")
    good = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "query int, doc int")
    m = {r["query"]: r for r in evaluation.ranking_measures(hits, good, 5).collect()}
    assert (m[1].recall, m[1].mrr, m[2].recall, m[2].mrr) == (0.5, 0.5, 0.0, 0.0)
    assert m[1].ndcg == round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6)
    labels = spark.createDataFrame([("a", "a")] * 4 + [("a", "b")] + [("b", "b")] * 3 + [(None, "a")], "label_a string, label_b string")
    k = evaluation.cohen_kappa(labels).first()
    assert (k.n, k.observed, k.kappa) == (8, 0.875, 0.75)
    assert evaluation.cohen_kappa(labels.filter("false")).first().kappa is None
    s = evaluation.stratified_sample(spark.range(50).withColumn("g", F.col("id") % 2), ["g"], 3, "id")
    assert s.count() == 6 and sorted(map(str, s.collect())) == sorted(map(str, evaluation.stratified_sample(spark.range(50).withColumn("g", F.col("id") % 2).repartition(5), ["g"], 3, "id").collect()))


# --- sources and streams


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"abc")
    (tmp_path / "in/b.txt").write_bytes(b"no")
    found = files.read_folder(spark, str(tmp_path / "in"))
    assert [r.length for r in found.collect()] == [3]

    def reader(content):
        if content == b"abc":
            yield {"page_num": 0, "text": "abc"}

    def broken(content):
        raise ValueError("cannot read")

    assert files.extract_pages(found, reader, "page_num int, text string").first().text == "abc"
    assert files.extract_pages(found, broken, "page_num int, text string").first().error == "cannot read"
    sums = files.file_checksum(found).withColumnRenamed("path", "doc_id").select("doc_id", "checksum")
    assert files.changed_files(sums, sums).count() == 0 and files.changed_files(sums, sums.filter("false")).count() == 1
    docs = spark.createDataFrame([("d", "# x\ny", 3)], "doc_id string, markdown string, pages int")
    files.write_markdown(docs, str(tmp_path / "md"))
    assert [r.value for r in spark.read.text(str(tmp_path / "md/markdown")).collect()] == ["# x", "y"]
    files.write_markdown(spark.createDataFrame([("a/b", "é"), ("a b", "2"), ("n", None)], "doc_id string, markdown string"), str(tmp_path / "md2"), buckets=1)
    listed = {r.doc_id: r.file for r in spark.read.parquet(str(tmp_path / "md2/files")).collect()}
    assert len(set(listed.values())) == 2 and (tmp_path / "md2" / listed["a/b"]).read_text() == "é" and "n" not in listed
    files.write_extractions(spark.createDataFrame([("f.pdf", 1)], "file_path string, total_pages int"), str(tmp_path / "ex"))
    back = files.read_extractions(spark, str(tmp_path / "ex")).first()
    assert (back.file_path, back.total_pages, back.pages) == ("f.pdf", 1, None)


def test_token_counts(spark, tmp_path):
    """Counts and packing by a vocabulary of bytes and a few pairs, against the same merges by hand."""
    import base64

    ranks = [bytes([i]) for i in range(256)] + [b"th", b"the", b" a", b"ab"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(r) + b" %d\n" % i for i, r in enumerate(ranks)))
    count = tokens.TokenCounter(spark, str(path))
    df = spark.createDataFrame([(1, "the ab"), (2, ""), (3, None), (4, "thé")], "i int, text string")
    assert [r.n for r in df.select("i", count(F.col("text")).alias("n")).orderBy("i").collect()] == [3, 0, None, 3]
    text = "the the\n\nab ab ab\n\nthe"
    packed = lambda most: spark.range(1).select(chunking.pack(F.lit(text), most, 0, count).alias("p")).first().p
    assert packed(7) == ["the the", "ab ab ab\n\nthe"] and packed(100) == [text]
    assert [r.token_count for r in chunking.chunk_markdown(spark.createDataFrame([("d", "# H\nthe ab")], "doc_id string, markdown string"), tokens=count).collect()] == [3]


def test_section_paths(spark):
    heads = [(0, None, 0), (1, "A", 1), (2, "A1", 2), (3, "A1x", 4), (4, "A2", 2), (5, "B", 1), (6, "Bx", 3), (7, "By", 2), (8, "deep", 9)]
    df = spark.createDataFrame([("d", *h) for h in heads], "doc_id string, section int, heading string, level int")
    got = [r.section_path for r in chunking.section_paths(df).orderBy("section").collect()]
    assert got == ["", "A", "A > A1", "A > A1 > A1x", "A > A2", "B", "B > Bx", "B > By", "B > By > deep"]


def test_unit_profile(spark):
    pages = spark.createDataFrame([("d", 0, "5 barg and 5 bar(g)"), ("d", 1, "7 kPa"), ("e", 0, "none")], "doc_id string, page_num int, full_text string")
    r = profile.unit_profile(pages).collect()
    assert [(x.doc_id, x.n_spelled_differently > 0 or x.total_units > 0) for x in r] == [("d", True)]
    assert profile.unit_profile(pages, chars=3).count() == 0


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("b1", "10 barg", "2024-01-01 00:00:00"), ("b1", "10 barg", "2024-01-01 00:01:00"), ("b2", "x ,y", "2024-01-01 00:02:00")], "id string, text string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(src)
    stream = ingest.first_seen(ingest.normalized_stream(ingest.file_stream(spark, src, "id string, text string, ts timestamp")), "id", "ts")
    q = ingest.start(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["10 bar(g)", "x, y"]
    calls = spark.createDataFrame([("2024-01-01 00:00:00", 9.0, False), ("2024-01-01 00:06:00", 1.0, False)], "ts string, latency double, failed boolean").withColumn("ts", F.to_timestamp("ts"))
    assert evaluation.alerts(calls).count() == 1
