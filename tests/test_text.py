import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptoria.functions import service, text
from scriptoria.functions.regex import spans, strip


def test_control_signs_become_spaces(apply):
    assert apply(text.remove_control, "a\x00b\tc\nd\re", "zero​width", "soft­hyphen", "", None) == ["a b\tc\nd\re", "zero width", "soft hyphen", "", None]


def test_unicode_repair_in_order(apply):
    assert apply(text.fix_unicode, "é", "donâ€™t", "waitâ€¦", 'aâ€"b', "Ã©tÃ©", "Ã la", "a b c d", "x​y") == ["é", "don't", 'wait"¦', 'a""b', "été", "àla", "a b\nc\n\nd", "xy"]


def test_spaces(apply):
    assert apply(text.fix_spaces, " \t ", "a \t b", "a\r\nb\rc", "a\n\n\n\nb", "a\n \n \nb", "  a  \n  b ") == ["", "a   b", "a\nb\nc", "a\n\nb", "a\n\n\nb", "a\nb"]


def test_punctuation(apply):
    got = apply(text.fix_punctuation, "Hello , world !", "one.two", "e.g.", 'said "Hi" and', "( a )", "x - y", "1 - 2 - 3", "wait....", "end\n- item", "3.14")
    assert got == ["Hello, world!", "one. two", "e. g.", 'said"Hi"and', "(a)", "x - y", "1-2 - 3", "wait...", "end - item", "3.14"]


def test_whole_normalisation(apply):
    assert apply(text.normalize_text, "  A  b ,c​ ", "", None, " ") == ["A b, c", "", None, ""]
    assert apply(lambda t: text.normalize_text(t, control=False, punctuation=False), "a​b ,") == ["ab ,"]


def test_paragraphs(apply):
    got = apply(text.paragraphs, "one\ntwo\n\nthree", "HEADING HERE\nbody line\n1. first\nmore\n2) second", "Label:\ntext", "", None, "• a\n• b")
    assert got == [["one two", "three"], ["HEADING HERE body line", "1. first more", "2) second"], ["Label: text"], [], [], ["• a", "• b"]]
    assert apply(lambda t: text.paragraphs(t, split=False), "a\n\nb", " ") == [["a\n\nb"], []]


def test_protected_parts(apply):
    got = apply(text.normalize_technical, "cost $a , b$ , then", "\\( x , y \\) ,z", "a ,b\n| x , y | z |\n|---|---|\n| 1 , 2 | 3 |\nend ,here", "| $p , q$ | r |", "", None)
    assert got == ["cost $a , b$, then", "\\( x , y \\), z", "a, b\n| x , y | z |\n|---|---|\n| 1 , 2 | 3 |\nend, here", "| __MATH_0__ | r |", "", None]


def test_technical_of_tables(spark):
    """Rows in a stream give the texts of the column function; no operator queues whole rows for Python."""
    texts = ["cost $a , b$ , then", "\\( x , y \\) ,z", "a ,b\n| x , y | z |\n|---|---|\n| 1 , 2 | 3 |\nend ,here", "| $p , q$ | r |", "", None, "e\u0301 ,a\u0007b | c", "a |\n| b , c", "$ , $ | x |\n\n---\n ."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = text.with_technical(df, "text", "out")
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    want = df.select("i", text.normalize_technical(F.col("text")).alias("out"))
    assert sorted((r.i, r.out) for r in got.collect()) == sorted((r.i, r.out) for r in want.collect())


def brute_spans(t, p):
    return [(m.group(), m.start(), m.end()) for m in re.finditer(p, t)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1 \U0001f600-", max_size=25), min_size=1, max_size=8))
def test_spans_are_those_of_finditer(apply, texts):
    got = apply(lambda c: spans(c, "[ab]+1?"), *texts)
    assert [[tuple(x) for x in g] for g in got] == [brute_spans(t, "[ab]+1?") for t in texts]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\n  　\x85ax", max_size=12), min_size=1, max_size=8))
def test_strip_is_pythons(apply, texts):
    assert apply(strip, *texts) == [t.strip() for t in texts]


def test_composition_is_pythons(apply):
    texts = [unicodedata.normalize("NFD", t) for t in ("Áp suất vận hành", "Rührwerk", "Đường ống")]
    assert apply(text.fix_unicode, *texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_service_helpers(spark):
    row = spark.range(1).select(
        service.mask_headers(F.create_map(F.lit("Cookie"), F.lit("a"), F.lit("Accept"), F.lit("b"))).alias("m"), *[service.format_uptime(F.lit(s)).alias(f"u{i}") for i, s in enumerate((0, 59, 3600, 90061.9))],
    ).first()
    assert row.m == {"Cookie": "***MASKED***", "Accept": "b"}
    assert [row.u0, row.u1, row.u2, row.u3] == ["0s", "59s", "1h 0s", "1d 1h 1m 1s"]
