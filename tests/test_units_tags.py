import re

import pytest

from scriptoria.functions import tags, units


def test_superscripts(apply):
    assert apply(units.fix_superscripts, "5 m2", "m 3", "cm2", "item 2", "km/h", "ft 2", "5 Nm /h", "M2") == ["5 m²", "m³", "cm²", "item²", "km³/h", "ft²", "5 Nm³/h", "m²"]


def test_map(apply):
    assert apply(units.map_units, "5 KPa", "10 barg", "bar a", "25℃ ", "5 m long", "2 TONS", "kg/hr", "3 mw", "M", "liter") == ["5 kPa", "10 bar(g)", "bar(a)", "25℃ ", "5 m³long", "2 t", "kg/h", "3 MW", "m", "L"]
    assert apply(lambda t: units.map_units(t, ignore_case=False), "3 mw 4 Mw") == ["3 mw 4 MW"]


def test_spacing_and_special(apply):
    assert apply(units.fix_spacing, "10bar", "25 °C", "5   kg", "KT06101A") == ["10 bar", "25°C", "5 kg", "KT06101 A"]
    assert apply(units.fix_special, "10 - 20bar", "5 ± 1", "2 x 3", "50 %") == ["10-20 bar", "5±1", "2×3", "50%"]
    assert apply(units.normalize_units, "", None, "flow 5 m3/h at 20deg C") == ["", None, "flow 5 m³/h at 20 deg C"]


def test_extraction_against_brute_force(spark):
    ends = [r"[°℃℉]C?", r"bar\s*\(?[ag]\)?", "[kKmM]?Pa", "psi[ag]?", "m[²³]?/[hs]", "[kKtT]/h", "[kKmM]?W", "hp", "[mkc]?m[²³]?", "[kKtT]g?", "%"]
    texts = ["Design 25 bar g and 25 bar, 10 kPa; 5 m³/h, 100 kg/h", "25%x 25% 3.5MW 12 hp", "20 °C 5 mm² 7 psig áp 8 Pa", "no number", "", None, "x5 bar(g) 5 bar(a)b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r.pattern_no, r.start, r.end, r.text) for r in units.extract_units(df, "id").collect())
    want = sorted((i, n, m.start(), m.end(), m.group()) for i, t in enumerate(texts) if t for n, e in enumerate(ends) for m in re.finditer(rf"\b\d+\.?\d*\s*{e}\b", t, re.I))
    assert got == want


def test_unit_statistics(spark):
    df = spark.createDataFrame([(1, 0, "5 KPa", "5 kPa"), (1, 1, "5 kPa", "5 kPa"), (1, 2, "2 m", "2 m")], "doc int, seq int, text string, normalized string")
    rows = {r.normalized: r for r in units.unit_statistics(df, "doc").collect()}
    assert (rows["5 kPa"].n, rows["5 kPa"].n_variants, rows["5 kPa"].rank, rows["2 m"].rank) == (2, 2, 1, 2)


def test_tag_forms(apply):
    assert apply(tags.normalize_tag, "pv-101", "PV 101", "pv_101", "  PV-101  ", "", None, "kt/06101") == ["PV-101"] * 4 + ["", None, "KT-06101"]
    assert apply(lambda t: tags.normalize_tag(t, standardize=False), "pv 101") == ["PV101"]
    assert apply(lambda t: tags.normalize_tag(t, separator="."), "pv-101") == ["PV.101"]


def brute_tags(t, patterns):
    found, seen = [], set()
    for n, (kind, p) in enumerate(patterns):
        p = p.replace(r"\p{Nd}", r"\d").replace(r"\p{Z}", " ")
        for m in re.finditer(p, t):
            norm = re.sub(r"[^\w-]", "", re.sub(r"[\s\-_/\\]+", "-", m.group().strip().upper()))
            if norm not in seen:
                seen.add(norm)
                found.append((m.start(), n, m.end(), m.group(), kind, norm))
    return sorted(found)


TEXTS = ["Pump P-101 feeds PV-101 and FIC 201, KT06101, T-305", "Page 123 from 2023", "PT-301; ABPI-301 P 101 p-101", "", "none here", "É-101 ſ1234 K123"]


@pytest.mark.parametrize("patterns", [tags.PATTERNS, tags.ISA_PATTERNS])
def test_tags_against_brute_force(spark, patterns):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = sorted((r.id, r.seq, r.start, r.end, r.original, r.type, r.normalized) for r in tags.extract_tags(df, "id", patterns=patterns).collect())
    want = sorted((i, s, h[0], h[2], h[3], h[4], h[5]) for i, t in enumerate(TEXTS) for s, h in enumerate(brute_tags(t, patterns)))
    assert got == want


def test_tag_quirks(spark):
    df = spark.createDataFrame([(1, "PV-101 and KT06101")], "id int, text string")
    assert [(r.normalized, r.type) for r in tags.extract_tags(df, "id").orderBy("seq").collect()] == [("PV-101", "valve"), ("V-101", "vessel"), ("KT06101", "valve"), ("T0610", "vessel")]


def test_replacement_against_brute_force(apply):
    def brute(t):
        for start, _, end, *_rest, norm in reversed(brute_tags(t, tags.PATTERNS)):
            t = t[:start] + norm + t[end:]
        return t

    texts = ["see pv 101 and p 205a", "fic-201 next to FIC 201", "no tags", ""]
    assert apply(tags.replace_tags, *texts) == [brute(t) for t in texts]
    assert apply(lambda t: tags.replace_tags(t, normalize=False), texts[0]) == [texts[0]]


def test_validation_and_parts(apply):
    got = apply(tags.validate_tag, "PV-101", "pv 101", "INVALID", "123", "P-101")
    assert [(g.valid, g.type) for g in got] == [(True, "valve"), (True, "valve"), (False, None), (False, None), (True, "pump")]
    fic, psh, bad = apply(tags.parse_isa_tag, "FIC-101", "pshh-0101b", "123")
    assert (fic.variable, fic.functions, fic.loop_number, fic.suffix) == ("Flow", ["Indicator", "Controller"], "101", "")
    assert (psh.variable, psh.functions, psh.loop_number, psh.suffix) == ("Pressure", ["Switch", "High", "High"], "0101", "B")
    assert not bad.valid and bad.variable is None


def test_groups_and_statistics(spark):
    df = spark.createDataFrame([(1, "P-101 P-102 PV-300")], "id int, text string")
    hits = tags.extract_tags(df, "id")
    assert {r.type: r.tags for r in tags.group_tags(hits, "id").collect()} == {"pump": ["P-101", "P-102"], "valve": ["PV-300"], "vessel": ["V-300"]}
    s = tags.tag_statistics(hits, "id").first()
    assert (s.total_tags, s.unique_tags, s.most_common_type, s.most_common_count) == (4, 4, "pump", 2)


def test_unit_map_against_every_replacement(spark):
    """Leaving out the replacements whose notation a text doesn't hold changes nothing."""
    import random
    import re

    from pyspark.sql import functions as F

    from scriptoria.functions.regex import replace_all

    rng = random.Random(5)
    parts = [*units.UNIT_MAP, " ", " ", "5", "m", "M", "x", "ſ", "ı", "İ", "K", "ß", "³", "/h", "%", "(", ".", "é"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.7 else rng.choice(parts).swapcase() for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string").repartition(4)
    for ignore in (True, False):
        flag = "(?iu)" if ignore else ""
        every = replace_all(F.col("t"), [(f"{flag}{units.boundary_before(k)}{re.escape(k)}{units.boundary_after(k)}", to) for k, to in units.unit_keys()])
        assert df.filter(~units.map_units(F.col("t"), ignore).eqNullSafe(every)).collect() == []
