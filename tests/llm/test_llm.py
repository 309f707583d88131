"""Training-data operators against brute force, and their edge cases."""

import math
import os
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("scriptoria.llm")
from scriptoria.functions.lookalike import plain  # noqa: E402
from scriptoria.llm import encoding, leakage, one_form, quality, repeated_lines, splitting, truncation  # noqa: E402
from scriptoria.llm.queries import ORACLE, QUERIES  # noqa: E402

QUIET = [HealthCheck.function_scoped_fixture]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- 1: repeated lines


def chunk_table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, text string")


def test_repeated_lines(spark):
    notice = ["Copy no. {} - ALL rights", "copy NO {}: all  rights", "Сopy no. {}, all-rights", "Ｃｏｐｙ no. {} all ri​ghts", "copy_no {} (all rights)"]
    rows = [(f"c{i}", f"d{i}", f"own line {'x' * i}\n" + notice[i % 5].format(i) + f"\n12 / {i}") for i in range(12)]
    rows += [("c0", "d0", rows[0][2]), ("n", "d1", None), ("e", "d2", ""), ("q", None, "copy no 1 all rights"), (None, "d3", "copy no 2 all rights"), ("z", "lost", "copy no 3 all rights")]
    sources = spark.createDataFrame([(f"d{i}", "S") for i in range(12)] + [("d0", "S"), (None, "S"), ("d1", "S")], "doc_id string, site string")
    chunks = chunk_table(spark, rows)
    got = repeated_lines.find_repeated_lines(chunks, sources)
    assert rows_of(got) == sorted([(f"c{i}", 1) for i in range(12)] + [(None, 0)], key=repr)
    clean = {r.chunk_id: r.text for r in repeated_lines.remove_lines(chunks, got).collect()}
    assert clean["c1"] == "own line x\n12 / 1" and clean["n"] is None and clean["e"] == "" and len(clean) == 17
    extra = chunks.withColumn("site", F.lit("X")).withColumn("template", F.lit(1)).withColumn("places", F.lit(1))
    assert rows_of(repeated_lines.find_repeated_lines(extra, sources.withColumn("n", F.lit(1)))) == rows_of(got)
    assert repeated_lines.find_repeated_lines(chunks.filter("false"), sources).count() == 0
    assert repeated_lines.find_repeated_lines(chunks, sources.filter("false")).count() == 0


def test_repeated_lines_thresholds(spark):
    """A line in 7 of 140 documents is in 5 % of them; one in 6 isn't; fewer than 5 documents never do."""
    rows = [(f"c{i}", f"d{i}", "\n".join(["seven"] * (i < 7) + ["six"] * (i < 6) + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}"])) for i in range(140)]
    small = [(f"s{i}", f"t{i}", "four") for i in range(4)]
    sources = spark.createDataFrame([(f"d{i}", "A") for i in range(140)] + [(f"t{i}", "B") for i in range(4)], "doc_id string, site string")
    got = repeated_lines.find_repeated_lines(chunk_table(spark, rows + small), sources)
    assert rows_of(got) == sorted((f"c{i}", 0) for i in range(7))


def test_template_tree_merges(monkeypatch):
    a, b = repeated_lines.TemplateTree(), repeated_lines.TemplateTree(depth=1)
    for line in ("Page 3 of 9", "rev 2", "x", "a1b2c3d4"):
        t = repeated_lines.tokens_of(line)
        assert a.template(t) == a.template(t) == b.template(t)
    assert a.place(repeated_lines.tokens_of("Copy no. 3 of the plant")) == a.place(repeated_lines.tokens_of("C O P Y, no 14 (of the plant)"))
    assert a.place(repeated_lines.tokens_of("Copy no 3 of the plant"))[0] == a.place(repeated_lines.tokens_of("Copy no 3 of the plans"))[0] != a.place(repeated_lines.tokens_of("Copy of the plant no 3"))[0]
    assert repeated_lines.tokens_of("Confidential, page 3") == ("conf", "iden", "tial", "page", repeated_lines.SLOT)
    assert repeated_lines.tokens_of("12 / 3") == () and repeated_lines.tokens_of("") == ()
    assert a.template(repeated_lines.tokens_of("Page 3 of 9")) == a.template(repeated_lines.tokens_of("PAGE 12 OF 144!"))
    assert a.template(repeated_lines.tokens_of("page 3")) != a.template(repeated_lines.tokens_of("page"))


# --- 3: one form


def test_forms():
    f = one_form.Forms()
    same = ["Сompany", "Company", "Ｃompany", "Com​pany", "Ϲompany", "Com­pany"]
    assert {f.form(t) for t in same} == {"Company"}
    assert f.form("a b c　d") == "a b c d" and f.form("FCV‐342‑1") == "FCV-342-1"
    assert f.form("é") == "é" and f.form("ệ") == unicodedata.normalize("NFC", "ệ")
    different = ["m2", "m²", "M2", "m 2", "ḿ2", "m3", "m–2", "m-2"]
    assert len({f.form(t) for t in different}) == len(different)
    assert f.form("Kлапaн") == f.form("Клапан") == "Клапан"


def test_forms_by_compatibility_and_shape():
    f = one_form.Forms()
    for a, b in [("ﬁlter", "filter"), ("ｶﾞｽ", "ガス"), ("𝐏ump", "Pump"), ("￠", "¢"), ("ⅠⅤ", "IV"), ("Ⅳ", "IV"), ("a\u2003b", "a b"), ("x\ufe0f\u202ay", "xy"), ("օil", "oil"), ("Ꭺir", "Air"), ("ﷲ", "الله")]:
        assert f.form(a) == f.form(b), (a, b)
    for a, b in [("①", "1"), ("m²", "m2"), ("½", "1⁄2"), ("℃", "°C"), ("…", "..."), ("ſ", "s"), ("І", "l")]:
        assert f.form(a) != f.form(b), (a, b)


def test_scores_count_every_text(spark):
    """Texts without letters of another script count too, and decide the palochka."""
    texts = ["level level", "line valve", None, "", "Клапан", "level"]
    scores = one_form.train_scores(spark.createDataFrame([(t,) for t in texts], "text string"))
    count = Counter(p for t in texts for w in (t or "").split() for p in one_form._bigrams(w))
    first = Counter()
    for p, n in count.items():
        first[p[0]] += n * (n > 1)
    assert scores == {p: math.log((n + 1) / (first[p[0]] + 64)) for p, n in count.items() if n > 1}
    assert one_form.Forms(scores).form("Ӏevel") == "level"


def test_scores_decide_between_shapes():
    """The palochka is read as the letter that the bigrams make likely in its token."""
    f = one_form.Forms({" l": -1.0, "le": -1.0, "ie": -9.0, " i": -2.0, "in": -1.0, "ln": -9.0})
    assert f.form("Ӏevel") == f.form("level") != f.form("Ievel")
    assert f.form("Ӏn") == f.form("In") == f.form("Іn") != f.form("ln")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aсoоeеКKлΔpр​­é́- ", max_size=12), st.text(alphabet="aсoоeеКKлΔpр​­é́- ", max_size=12))
def test_equal_form_means_equal_look(a, b):
    f = one_form.Forms({"ла": -1.0, "ко": -2.0, "co": -1.5})
    assert (f.form(a) == f.form(b)) == (plain(a) == plain(b))
    assert plain(f.form(a)) == plain(a)


def test_lookalike_pairs(spark):
    texts = [("a", "Valve"), ("b", "Vаlve"), ("c", "Valve"), ("d", "valve"), ("e", "Val​ve"), ("f", None), ("g", None), ("h", ""), ("i", "​"), (None, "Vаlve"), ("a", "Valve"), ("b", "Vаlve")]
    df = spark.createDataFrame([("x", i, t) for i, t in texts] + [("y", "k", "Vаlve"), (None, "l", "Valve"), (None, "m", "Vаlve")], "origin string, row_id string, text string")
    got = {(r.origin, r.id_a, r.id_b) for r in one_form.find_lookalikes(df, "row_id").collect()}
    assert got - {(None, "l", "m")} == {("x", "a", "b"), ("x", "a", "e"), ("x", "b", "c"), ("x", "b", "e"), ("x", "c", "e"), ("x", "h", "i")}
    assert one_form.find_lookalikes(df.filter("false"), "row_id").count() == 0
    extra = df.withColumn("form", F.lit(1)).withColumn("raw", F.lit(2)).withColumn("id_a", F.lit(3))
    assert {(r.origin, r.id_a, r.id_b) for r in one_form.find_lookalikes(extra, "row_id").collect()} == got
    classes = [(r.origin, r.row_id, r["class"], r.wording) for r in one_form.lookalike_classes(df, "row_id").collect()]
    assert {(a[0], a[1], b[1]) for a in classes for b in classes if a[::2] == b[::2] and a[3] != b[3] and a[1] < b[1]} == got
    forms = one_form.one_form(df, "row_id", keep=("origin",), scores=one_form.train_scores(df))
    assert forms.count() == df.count() and forms.filter("row_id = 'f'").first().form is None


def test_lookalikes_against_brute_force(spark):
    rng = random.Random(1)
    swaps = {"a": "а", "o": "ο", "e": "ｅ", " ": " ", "-": "‐"}
    base = ["a pump", "one-two", "sea level", "oil"]
    rows = [(f"r{i:03}", "".join(swaps.get(c, c) if rng.random() < 0.2 else c for c in rng.choice(base))) for i in range(80)]
    df = spark.createDataFrame([("x", *r) for r in rows], "origin string, row_id string, text string")
    want = sorted(("x", a, b) for a, s in rows for b, t in rows if a < b and s != t and plain(s) == plain(t))
    assert rows_of(one_form.find_lookalikes(df, "row_id")) == want


# --- 4: quality


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .|\n-1•\t#é", max_size=60), st.integers(1, 20))
def test_segments_do_not_matter(text, size):
    assert quality.text_counts(text, size) == quality.text_counts(text, 10**9)
    assert quality.text_counts(text, size)[0] == len(text)


def test_line_kinds():
    for kind, lines in {
        "prose": ["The pump was lubricated before the night shift.", "Keep 5 kg/s as a limit for the drain; beyond it scale is likely.", "Printed on 22.12.2024 at Orrin Flats station 14", "Skarrow  controlled  copy  no.  48  -  uncontrolled", "Đội bảo dưỡng thấy rò phớt phía sau gioăng.", ""],
        "list": ["• hydraulic blower drain plug", "3) standby air cooler the floor", "(b) idle turbine", "PSV-625  heated silo feeder casing, 783 Kw"],
        "table": ["| KT-1 | pump | 3 | OK |", "|---|---|---|", "FCV-1\tpump\t3\tTBC", "KT-228; duplex pump; 28.5; 86.1; cooling water", "XV805   nằm ngang tháp   5,43   7,06   TBC"],
        "junk": ["__________________", "69.09,494.58 492.30,240.86 682.88,763.96", "d974 5bd0 b741 e644 e886", "~;=ers=zed=s=#o§fee#e* the *ntak§ channe*l |##", "nLVdq93Gfvmj3oB7XTHHvSzJO6c9bP6I8rJQvrjcBBGIPau8jVsz3Z", "●○●○●○●○●○●○●○"],
    }.items():
        assert [quality.line_kind(x) for x in lines] == [kind] * len(lines)


def test_statistics(spark):
    prose, table = "The pump is here.\nIt was not running", "| a | pump | 3 |\n" * 9
    rows = [("c1", "d", prose, 36), ("c1", "d", prose, None), ("c2", "d", table, 10), ("c3", "e", prose, 36), ("c4", "f", None, None), ("c5", "f", "", 0), (None, "e", "x y", 1), (None, "e", "x y", 1), ("c6", None, "• item one\n• item two", 1)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, char_count int")
    got = {r.doc_id: r for r in quality.document_statistics(df).collect()}
    assert got["d"].n_chars == len(prose) + len(table) and got["d"].kind == "table" and got["d"].n_chunks == 2
    e = got["e"]
    assert (e.n_words, e.n_common, e.n_lines, e.n_ended, e.kind, e.n_wrong_size) == (10, 5, 3, 1, "prose", 1)
    assert got["f"].kind is None and got["f"].mean_word_len is None and got[None].kind == "list"
    assert rows_of(quality.find_unnatural(df)) == sorted([("d", "table"), (None, "list")], key=repr)
    extra = df.withColumn("n_chars", F.lit(7)).withColumn("kind", F.lit("x"))
    assert rows_of(quality.find_unnatural(extra)) == rows_of(quality.find_unnatural(df))
    assert quality.document_statistics(df.filter("false")).count() == 0


def test_long_texts_are_counted_in_many_tasks(spark):
    """Segments are dealt out, merged in two rounds, and give the counts of the whole; repeated rows count once."""
    line = "The pump is here, and the valve is not.\n"
    texts = {"a": line * 700, "b": "x" * 5000, "c": "| a | pump | 3 |\n" * 900 + "end", "d": line, "e": "\n" * 3000}
    rows = [(i, "D", t, len(t)) for i, t in texts.items()] + [("a", "D", texts["a"], 28_000), (None, "D", texts["c"], 1), (None, "D", texts["c"], 1), (None, "D", texts["a"], 1)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, char_count int")
    got = sorted((r.chunk_id or "-", *(r[c] for c in quality.COUNTS)) for r in quality.chunk_counts(df, segment=41).collect())
    assert got == sorted((i, *quality.text_counts(t)) for i, t in [*texts.items(), ("-", texts["c"]), ("-", texts["a"])])


def test_common_words_beside_signs():
    counts = dict(zip(quality.COUNTS, quality.text_counts("The pump, and the valve. Not now, then.")))
    assert (counts["n_words"], counts["n_common"]) == (8, 5)


def test_rules_on_ratios(spark):
    """Prose by its ratios is never unnatural; text whose ratios fail most rules always is."""
    prose = "\n".join(f"{n}. The pump is in use when the valve of the line has been shut." for n in range(1, 30))
    odd = "\n".join(["Zug Rohr 12345678901234 Naht 123456789012 Blech 1234567"] * 12)
    df = spark.createDataFrame([("a", "p", prose, 1), ("b", "o", odd, 1)], "chunk_id string, doc_id string, text string, char_count int")
    got = {r.doc_id: r for r in quality.document_statistics(df).collect()}
    assert got["p"].share_list > 0.9 and got["p"].n_failed == 0 and got["p"].kind == "prose"
    assert got["o"].n_failed >= 3 and got["o"].kind == "junk"


# --- 5: splitting


def units(text, measure):
    return len(re.findall(r"[^ \t\n\r]+", text)) if measure == "tokens" else len(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n\r\t#;é", max_size=90), st.sampled_from(["tokens", "chars"]), st.integers(1, 12), st.integers(0, 14))
def test_pieces_cover_fit_and_overlap(text, measure, most, overlap):
    ranges = splitting.split_text(text, measure, most, overlap)
    shared = min(overlap, most - 1)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(text)
    assert all(units(text[a:b], measure) <= most for a, b in ranges)
    for (a, b), (c, d) in zip(ranges, ranges[1:]):
        assert a <= c <= b < d or (b == d and a < c)
        if measure == "chars":
            assert b - c == min(shared, b)
        elif units(text[:b], measure) >= shared:
            assert units(text[c:b], measure) == shared
    assert (len(ranges) > 1) == (units(text, measure) > most)


def test_natural_boundaries():
    text = "# A\none two three\n\nfour five\n# B\nsix. Seven eight nine"
    cut = lambda most: [text[a:b] for a, b in splitting.split_text(text, "tokens", most, 0)]
    assert cut(8) == ["# A\none two three\n\nfour five\n", "# B\nsix. Seven eight nine"]
    assert cut(5) == ["# A\none two three\n\n", "four five\n", "# B\nsix. ", "Seven eight nine"]
    assert [b - a for a, b in splitting.split_text("x" * 25, "chars", 10, 0)] == [10, 10, 5]
    assert splitting.split_text("x" * 25, "tokens", 1, 0) == [(0, 25)]
    with pytest.raises(ValueError):
        splitting.split_text("a b", "words", 1, 0)


def test_sections_nest_and_lists_nest():
    cut = lambda text, most, measure="tokens": [text[a:b] for a, b in splitting.split_text(text, measure, most, 0)]
    w = lambda n: " ".join(["word"] * n)
    text = f"# A\n{w(30)}\n## A1\n{w(30)}\n## A2\n{w(30)}\n# B\n{w(30)}\n"
    assert [p[:4].strip() for p in cut(text, 80)] == ["# A", "## A", "# B"] and cut(text, 80)[1].startswith("## A2")
    assert cut(text, 300) == [text] and len(cut(text, 99)) == 2
    items = "- a b c\n  - a1 x\n  - a2 x\n- d e f\n  more of d\n  - d1 x\ntail line here"
    assert cut(items, 11) == ["- a b c\n  - a1 x\n  - a2 x\n", "- d e f\n  more of d\n  - d1 x\n", "tail line here"]
    assert cut(items, 7) == ["- a b c\n  - a1 x\n", "  - a2 x\n", "- d e f\n  more of d\n", "  - d1 x\n", "tail line here"]
    deep = "".join(f"{' ' * i}- item\n" for i in range(3000))
    assert "".join(cut(deep, 2)) == deep and len(cut(deep, 2)) == 3000
    blank = "\n \n# A\n\none two\n\nthree four\n"
    assert cut(blank, 4) == ["\n \n# A\n\none two\n\n", "three four\n"]


def test_no_cut_inside_a_sign():
    e, flag, family = "e\u0301", "\U0001f1e9\U0001f1ea", "\U0001f468\u200d\U0001f469\u200d\U0001f467"
    for sign, most in ((e, 3), (flag, 3), (family, 7), ("한", 4)):
        text = sign * 9
        for overlap in (0, 1):
            for a, b in splitting.split_text(text, "chars", most, overlap):
                assert a % len(sign) == 0 and b % len(sign) == 0 and 0 < b - a <= most
    assert [b - a for a, b in splitting.split_text("a" + "\u0301" * 9, "chars", 4, 0)] == [4, 4, 2]


def test_oversized(spark):
    rows = [("a", "one two three four", "H", {"profile": "t"}), ("a", "one two three four", "H", {"profile": "t"}), ("b", "one two", None, {"profile": "t"}), ("c", "x" * 9, "", {"profile": "k"}), ("d", None, "H", {"profile": "t"}), ("e", "many words without a known profile", "H", {"profile": "?"}), ("f", "w " * 9, "H", None), (None, "one two three four", "H", {"profile": "t"}), ("g", "a b c", "H", {"profile": "t"}), ("h", "", None, {"profile": "k"})]
    df = spark.createDataFrame(rows, "chunk_id string, text string, heading string, metadata map<string,string>")
    limits = spark.createDataFrame([("t", "tokens", 3, 1), ("k", "chars", 4, 0), ("n", None, None, None)], "profile string, measure string, max_size int, overlap_size int")
    assert rows_of(splitting.find_oversized(df, limits)) == [("a",), ("c",), (None,)]
    pieces = splitting.split_oversized(df, limits).filter("chunk_id = 'a'").distinct().orderBy("piece_no").collect()
    assert [(p.text, p.heading, p.oversized) for p in pieces] == [("one two ", "H", True), ("two three four", "H", True)]
    whole = {r.chunk_id: r for r in splitting.split_oversized(df, limits).filter("not oversized").collect()}
    assert set(whole) == {"b", "d", "e", "f", "g", "h"} and whole["d"].text is None and whole["d"].end == 0
    extra = df.withColumn("profile", F.lit("x")).withColumn("size", F.lit(1)).withColumn("item", F.lit(1)).withColumn("measure", F.lit("chars"))
    assert rows_of(splitting.find_oversized(extra, limits)) == rows_of(splitting.find_oversized(df, limits))
    assert splitting.split_oversized(df.filter("false"), limits).count() == 0
    assert splitting.find_oversized(df, limits.filter("false")).count() == 0


def test_second_loads(spark):
    """A chunk loaded twice gives its pieces once; another text, heading or profile is another chunk."""
    long, once = "one two three four", [("a", 0), ("a", 1)]
    rows = [("a", long, "H", {"profile": "t"})] * 3 + [("b", "one two", None, {"profile": "t"})] * 2 + [("d", None, None, None)] * 2 + [(None, long, "H", {"profile": "t"})] * 2
    df = spark.createDataFrame(rows, "chunk_id string, text string, heading string, metadata map<string,string>")
    limits = spark.createDataFrame([("t", "tokens", 3, 1), ("k", "chars", 99, 0)], "profile string, measure string, max_size int, overlap_size int")
    places = lambda x, **how: rows_of(splitting.split_oversized(x, limits, **how).select("chunk_id", "piece_no"))
    assert places(df) == sorted([*once, ("b", 0), ("d", 0), (None, 0), (None, 1)], key=repr)
    assert places(df, oversized_only=True) == sorted([*once, (None, 0), (None, 1)], key=repr)
    other = spark.createDataFrame([("a", long + ".", "H", {"profile": "t"}), ("a", long, None, {"profile": "t"}), ("a", long, "H", {"profile": "k"})], df.schema)
    assert places(df.filter("chunk_id = 'a'").unionByName(other)) == sorted([*once * 3, ("a", 0)], key=repr)


# --- 6: encoding

VOCABULARY = os.path.join(encoding.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)] + [b""]
    h = encoding.PerfectHash(keys, list(range(len(keys))))
    assert h.lookup(keys) == list(range(len(keys))) and sorted(map(bytes, h.keys)) == sorted(keys)
    assert h.lookup([b"stranger", b"-1"]) == [None, None] and h.lookup([]) == []
    assert encoding.PerfectHash([], []).lookup([b"x"]) == [None]


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab' \n\tét1#<|endoftext|>", max_size=60)))
def test_ids_are_those_of_the_public_library(text):
    import tiktoken

    own = encoding.encoder(VOCABULARY)
    theirs = tiktoken.Encoding("own", pat_str=encoding.PRE_TOKEN, mergeable_ranks=own.ranks, special_tokens={})
    ids = own.encode_many([text])[0]
    assert ids == theirs.encode_ordinary(text) and theirs.decode(ids) == text


@needs_vocabulary
def test_corpus(spark):
    long = "Áp suất " * 20_000
    df = spark.createDataFrame([(1, "the pump"), (1, "the pump"), (2, ""), (3, None), (None, "x"), (4, long), (5, "  \n")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = encoding.encode_corpus(df)
    assert got.columns == ["doc_id", "ids"] and got.count() == 7
    by = {r.doc_id: r.ids for r in got.collect()}
    assert by[2] == [] and by[3] == [] and len(by[1]) == 2 and len(by[4]) > 20_000 and by[5]
    assert encoding.encode_corpus(df.filter("false")).count() == 0


# --- 7: leakage


def brute_leaks(docs, items, most):
    out = set()
    for d, t in docs:
        w = leakage.words_of(t or "")
        runs = {tuple(w[i : i + most]) for i in range(len(w) - most + 1)}
        for k, p in items:
            q = leakage.words_of(p or "")
            if any(tuple(q[i : i + most]) in runs for i in range(len(q) - most + 1)):
                out.add((d, k))
    return sorted(out)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=16), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("ab"), max_size=14), min_size=1, max_size=4), st.integers(1, 6))
def test_runs_against_brute_force(docs, items, most):
    d, i = [(n, " ".join(x)) for n, x in enumerate(docs)], [(n, " ".join(x)) for n, x in enumerate(items)]
    tests = leakage.TestTexts([(k, "passage", p) for k, p in i], most)
    assert sorted({(n, tests.items[h[0]][0]) for n, t in d for h in tests.runs(t)}) == brute_leaks(d, i, most)


def test_leaks(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    part = lambda a, b: " ".join(passage.split()[a:b])
    docs = [(1, "start " + part(3, 18) + " end"), (2, part(3, 17)), (3, part(0, 15).upper().replace(" ", " - \n").replace("O", "О")), (4, None), (5, ""), (6, part(0, 8) + " gap " + part(8, 16)), (7, "filler " * 50_000 + passage), (1, "start " + part(3, 18) + " end"), (None, passage), (8, "wor­d0 " + part(1, 15))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(9)).withColumn("start", F.lit(9))
    items = spark.createDataFrame([(10, "q", passage), (11, "q", "too short"), (12, "q", None), (10, "q", passage), (None, "q", passage), (13, "q", part(2, 30))], "item_id bigint, question string, passage string")
    got = leakage.find_leaks(df, items)
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    assert pairs == {(1, 10), (3, 10), (7, 10), (None, 10), (8, 10), (1, 13), (7, 13), (None, 13)}
    r = got.filter("doc_id = 1 and item_id = 10").first()
    assert ("start " + part(3, 18) + " end")[r.start : r.end] == part(3, 18) and (r.n_words, r.item_word) == (15, 3)
    r = got.filter("doc_id = 8").first()
    assert (r.start, r.n_words) == (0, 15)
    assert leakage.find_leaks(df.filter("false"), items).count() == 0 and leakage.find_leaks(df, items.filter("false")).count() == 0


def test_leaked_questions(spark):
    """Test texts below the least run are found where they stand as a whole."""
    question, passage = "Which pump feeds the north rack at night?", " ".join(f"word{i}" for i in range(20))
    docs = [(1, f"Asked: which PUMP feeds\nthe north rack at night? Nobody knew. {question}"), (2, "Which pump feeds the north rack"), (3, question), (4, passage), (5, " ".join(passage.split()[:14])), (6, "Which pump feeds the north rack at nightfall"), (7, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(10, question, passage), (11, "?!", None), (12, "the north rack", "x y")], "item_id bigint, question string, passage string")
    got = leakage.find_leaks(df, items, ("question", "passage"), short=True)
    assert rows_of(got.select("doc_id", "item_id", "field", "n_words", "item_word")) == sorted(
        [(1, 10, "question", 8, 0)] * 2 + [(3, 10, "question", 8, 0), (4, 10, "passage", 20, 0), *[(d, 12, "question", 3, 0) for d in (1, 1, 2, 3, 6)]], key=repr
    )
    assert sorted(docs[0][1][r.start : r.end] for r in got.filter("doc_id = 1 and item_id = 10").collect()) == [question[:-1], "which PUMP feeds\nthe north rack at night"]
    assert rows_of(leakage.find_leaks(df, items, ("question", "passage")).select("doc_id", "item_id")) == [(4, 10)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=16), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("ab"), max_size=14), min_size=1, max_size=4), st.integers(1, 6))
def test_short_texts_against_brute_force(docs, items, most):
    d, i = [(n, " ".join(x)) for n, x in enumerate(docs)], [(n, " ".join(x)) for n, x in enumerate(items)]
    tests = leakage.TestTexts([(k, "passage", p) for k, p in i], most, short=True)
    want = {pair for k, p in i if p for pair in brute_leaks(d, [(k, p)], min(most, len(p.split())))}
    assert {(n, tests.items[h[0]][0]) for n, t in d for h in tests.runs(t)} == want


def test_many_hits_take_linear_time():
    """Repeats of a passage, and one passage of many blocks, cost no more for each word the longer the text is."""
    passage = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"v{i}" for i in range(60_000))
    tests = leakage.TestTexts([(1, "passage", passage), (2, "passage", long)])
    hits = tests.runs(" x ".join([passage] * 20_000) + " " + long)
    assert len(hits) == 20_001 and hits[-1][0] == 1 and hits[-1][3] == 60_000 and {h[3] for h in hits[:-1]} == {30}


def test_question_query(spark, tmp_path):
    spark.createDataFrame([(1, "He asked which pump feeds the north rack at night.")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, "Which pump feeds the north rack at night?", None)], "item_id bigint, question string, passage string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert rows_of(QUERIES["p7_passages"](spark, str(tmp_path)).select("doc_id", "item_id", "field")) == [(1, 10, "question")]
    assert QUERIES["p7_found"](spark, str(tmp_path)).count() == 0


def test_offsets():
    for t in ("Thе wo​rd, é", "ẞ ǅ", "áb c", ""):
        assert [w for w, _, _ in leakage.words_with_offsets(t)] == leakage.words_of(t)
    assert leakage.words_with_offsets("x: wo​rd") == [("x", 0, 1), ("word", 3, 8)]


def test_sets_of_test_texts(spark, monkeypatch):
    monkeypatch.setattr(leakage, "AUTOMATON_CHARS", 10)
    df = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e"), (2, "d e f g h"), (3, "x y z u v")], "item_id bigint, passage string")
    assert {r.item_id for r in leakage.find_leaks(df, items, min_words=4).collect()} == {1, 2}


# --- 8: truncation

SENTENCES = ["The line carries oil to the pump.", "Keep the valve dry before the test.", "When the pump stops, check the seal.", "The crew found scale behind the baffle."]


def corpus(n=60):
    rng = random.Random(2)
    docs = []
    for i in range(n):
        body = " ".join(rng.choice(SENTENCES) for _ in range(5))
        docs.append((i, f"Title number {i}\n{body}" + rng.choice(["", "\nEnd of section", "\n• drain plug", "\n- pump | seal"]), "S"))
    return docs


@pytest.mark.parametrize("parts", [1, 7])
def test_truncated(spark, parts):
    full = "Title x\nThe line carries oil to the pump. " + "Keep the valve dry before the test. " * 3
    cut = [(100, "Title\nKeep the valve dry. The line carr", "S"), (101, "Title\nThe crew found sca...", "S"), (102, "Title\nWhen the pump st�", "S"), (103, "Title\nThe crew found", "S"), (104, full[:60], "T"), (104, full[:60], "T"), (105, full[:60], None), (106, "T\nKeep the valve dry before the test.\nTh", "S")]
    fine = [(200, full, "T"), (201, None, "S"), (202, "", "S"), (203, " \n", "S"), (204, full.strip(), None), (205, "| a | b |\n| c | d |", "S"), (206, "Text ends.\nIssued by the works", "S")]
    df = spark.createDataFrame(corpus() + cut + fine, "doc_id bigint, text string, source string")
    assert {r.doc_id for r in truncation.find_truncated(df, partitions=parts).collect()} == {c[0] for c in cut}
    rates = {r.source: r for r in truncation.truncation_rates(df, partitions=parts).collect()}
    assert (rates["T"].n_texts, rates["T"].n_cut, rates[None].n_cut) == (3, 2, 1)


def test_truncated_edges(spark):
    df = spark.createDataFrame(corpus(5), "doc_id bigint, text string, source string")
    extra = df.withColumn("id", F.lit(1)).withColumn("what", F.lit("x")).withColumn("cut", F.lit(True)).withColumn("part", F.lit(0))
    assert rows_of(truncation.find_truncated(extra)) == rows_of(truncation.find_truncated(df))
    assert truncation.find_truncated(df.filter("false")).count() == 0 and truncation.truncation_rates(df.filter("false")).count() == 0
    long = spark.createDataFrame([(1, "The pump is dry. " * 30_000, "S"), (2, "The pump is dry. " * 30_000 + "The pu", "S"), (None, "The pump is w", "S"), (3, "The pump is w", "S")], "doc_id bigint, text string, source string")
    assert rows_of(truncation.find_truncated(long)) == [(2,), (3,), (None,)]


@pytest.mark.parametrize("times", [1, 100])
def test_truncated_at_any_size(spark, times):
    """What starts a few lines of its own (here codes of one letter) hides no cut word, however often the texts occur."""
    sentences = ["Die Pumpe steht dort.", "Der Filter war dicht.", "Vor dem Anfahren entlüften.", "Anlage danach spülen."]
    texts = [f"{' '.join(sentences[i % 4 :])}\n{'DV'[i % 2]} gehört zu Anhang {i}\n{sentences[i % 3]}" for i in range(8)]
    texts += ["Die Pumpe steht dort.\nEnde der Seite\nDer Filter war dicht."]
    cut, fine = ["Der Filter war dicht.\nD", "Die Pumpe steht dort.\nV", "Vor dem Anfahren entlüften.\nVo", "Anlage danach spülen.\nDie"], ["Der Filter war dicht.\nEnde"]
    docs = [(1000 * k + i, f"Titel {'x' * k}\n{t}", "S") for k in range(times) for i, t in enumerate(texts + cut + fine)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    found = {r.doc_id for r in truncation.find_truncated(df).collect()}
    assert found == {1000 * k + len(texts) + i for k in range(times) for i in range(len(cut))}


@settings(max_examples=12, deadline=None, suppress_health_check=QUIET)
@given(st.lists(st.text(alphabet="ab c.", min_size=1, max_size=6), min_size=1, max_size=20))
def test_prefixes_against_brute_force(spark, texts):
    """Texts that a longer one continues within a word or sentence are found, however the sort is cut."""
    df = spark.createDataFrame([(i, t, "S") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    want = {i for i, t in enumerate(texts) if t.strip() and any(truncation.continues(t, u) for u in texts)}
    got = {r.doc_id for r in truncation.find_truncated(df, partitions=4).collect()}
    assert want <= got


def test_prefixes_along_all_copies(spark):
    """A text is compared with every text that shares it, not with the next one; blanks alone continue nothing; copies don't matter."""
    one = ["The pump was st", "The pump was st ", "The pump was st\t \n", "The pump was started."]
    long = "The crew found scale behind the baffle. " * 400
    texts = one + [long + "Then the se", long + "Then the seal was dry.", long] + ["Dry seal. " * 9 + "The ", "Dry seal. " * 9 + "The pump"] * 40
    df = spark.createDataFrame([(i, t, "S") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    by = {r.doc_id for r in truncation.text_ends(df).filter("evidence = 'prefix'").collect()}
    assert by == {i for i, t in enumerate(texts) if any(truncation.continues(t, u) for u in texts)} and {0, 4, 7, 9} <= by and not {1, 2, 3, 5, 6, 8} & by


def test_limits_of_a_source(spark):
    """Several limits of one source, one of them in bytes; the evidence names them."""
    full = [(i, f"The line {i} carries oil to the pump. Keep the valve dry.", "S") for i in range(40)]
    body = lambda i: f"Line {i} is shut. Die Pumpe läuft {'ü' * i}" + " mit Öl und Dampf" * 20
    cut = [(100 + i, body(i)[:120], "S") for i in range(3)] + [(200 + i, body(10 + i).encode()[:200].decode(errors="ignore"), "S") for i in range(3)]
    rows = {r.doc_id: r for r in truncation.text_ends(spark.createDataFrame(full + cut, "doc_id bigint, text string, source string")).collect()}
    assert {i: r.evidence for i, r in rows.items() if r.cut} == {c[0]: "limit" for c in cut}


# --- queries


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, data, name):
    columns = {"p1_found": ["chunk_id", "line_no"], "p3_found": ["origin", "id_a", "id_b"], "p4_found": ["doc_id", "kind"], "p5_found": ["chunk_id"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}
    df = QUERIES[name](spark, data)
    assert df.count() > 0
    assert df.columns == columns.get(name, df.columns)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_against_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    assert rows_of(QUERIES[name](spark, data)) == sorted(con.sql(ORACLE[name]).fetchall(), key=repr)


def test_found_lines_against_brute_force(spark, data):
    import duckdb

    chunks = duckdb.sql(f"select chunk_id, doc_id, text from '{data}/chunks.parquet'").fetchall()
    site = dict(duckdb.sql(f"select doc_id, site from '{data}/source_files.parquet'").fetchall())
    docs = Counter(site[d] for d in {c[1] for c in chunks})
    cover, where = defaultdict(set), defaultdict(set)
    for c, d, t in chunks:
        for n, line in enumerate((t or "").split("\n")):
            key = re.sub(r"\d+", "0", re.sub(r"[\W_]+", "", plain(line).casefold()))
            if re.search(r"[^\W\d_]", key):
                cover[site[d], key].add(d)
                where[site[d], key].add((c, n))
    want = {p for k, v in cover.items() if len(v) >= 5 and 20 * len(v) >= docs[k[0]] for p in where[k]}
    assert {(r.chunk_id, r.line_no) for r in QUERIES["p1_found"](spark, data).collect()} == want
