import random

import pytest
from pyspark.sql import functions as F

from scriptoria.operators import quantities as Q

UNITS = [
    ("kPa", "pressure", 1.0, 0.0, True), ("bar", "pressure", 100.0, 0.0, False), ("bar(g)", "pressure", 100.0, 101.325, False), ("MPa", "pressure", 1000.0, 0.0, False), ("psi", "pressure", 6.894757, 0.0, False),
    ("°C", "temperature", 1.0, 0.0, True), ("°F", "temperature", 5 / 9, -160 / 9, False), ("K", "temperature", 1.0, -273.15, False), ("kg/h", "mass_flow", 1.0, 0.0, True), ("t/h", "mass_flow", 1000.0, 0.0, False),
    ("m³/h", "volume_flow", 1.0, 0.0, True), ("US gpm", "volume_flow", 0.2271247, 0.0, False), ("mm", "length", 1.0, 0.0, True), ("m", "length", 1000.0, 0.0, False), ("inch", "length", 25.4, 0.0, False), ("kW", "power", 1.0, 0.0, True), ("MW", "power", 1000.0, 0.0, False), ("kg", "mass", 1.0, 0.0, True), ("t", "mass", 1000.0, 0.0, False),
]
TEXT = "origin string, doc_id string, row_id string, text string"


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame([("d.", "Dot"), ("d,", "Comma"), ("d,", "Comma"), ("d0", None), (None, "Dot")], "doc_id string, site string"),
        spark.createDataFrame([("Dot", "."), ("Comma", ","), (None, None)], "site string, decimal_mark string"),
        spark.createDataFrame(UNITS, "unit string, dimension string, factor double, shift double, is_common boolean"),
    )


def found(spark, tables, *texts, doc="d."):
    rows = spark.createDataFrame([("chunks", doc, str(i), t) for i, t in enumerate(texts)], TEXT)
    out = {}
    for r in Q.quantities(rows, *tables).collect():
        out.setdefault(int(r.row_id), []).append((r.unit, round(r.value_common, 3)))
    return [sorted(out.get(i, [])) for i in range(len(texts))]


def test_places_of_units(spark, tables):
    got = found(
        spark, tables, "rose to 12 bar at once", "Pressure pump P-101 (Bar): 2.5", "Pressure [barg] = 1", "Flow, T/H: 3", "Weight | 4 | tonnes (ref. 1/2)", "2.5 - 3 MPa", "at 20 to 30 degC", "V-123 K", "item 9 in drawing 8, 24 V, 50 Hz, 316L", "length 5 in. long and 2\" wide",
    )
    assert got == [
        [("bar", 1200.0)], [("bar", 250.0)], [("bar(g)", 201.325)], [("t/h", 3000.0)], [("t", 4000.0)], [("MPa", 2500.0), ("MPa", 3000.0)], [("°C", 20.0), ("°C", 30.0)], [], [], [("inch", 50.8), ("inch", 127.0)],
    ]


def test_columns(spark, tables):
    assert found(spark, tables, "reach 366 ℃ before", "870.7℉ as a limit", "at 20 ° C or 21º C") == [[("°C", 366.0)], [("°F", 465.944)], [("°C", 20.0), ("°C", 21.0)]]
    table = "Tag Pelmast | Use | pressure [bar] | mass, KG | Note\n|---|---|---|---|---|\nP-1 | pump | 2 | 7 | OK\nfooter line\nP-2 | fan | - | 8 | TBC\n\nItem | Use | power | mass | Note\nP-3 | pump | 5 | 6 | OK"
    assert found(spark, tables, table, table.replace(" | ", "\t").replace("|---|---|---|---|---|\n", "")) == [[("bar", 200.0), ("kg", 7.0), ("kg", 8.0)]] * 2


def test_tight_rows_long_units_and_unbounded_labels(spark, tables):
    assert found(spark, tables, "AG-389|lining|25.5 metres|19.7 t/h|", "a\t25.5 metres\t19.7 t/h", "a;3 bar;4 MPa;ok", "P-1|x|2 bar||OK") == [[("m", 25500.0), ("t/h", 19700.0)]] * 2 + [[("MPa", 4000.0), ("bar", 300.0)], [("bar", 200.0)]]
    assert found(spark, tables, "flow of 5 kilograms per hour", "7 cubic metres per hour then", "9 gallons per minute", "2 pounds per square inch", "1 t per hour", "3 t / h", "12 Kubikmeter pro Stunde", "6 metres per") == [
        [("kg/h", 5.0)], [("m³/h", 7.0)], [("US gpm", 2.044)], [("psi", 13.79)], [("t/h", 1000.0)], [("t/h", 3000.0)], [("m³/h", 12.0)], [("m", 6000.0)],
    ]
    wide = "Tag of pump   Use   power (MW)   mass, t   Basis\nP-1   feed pump   16   4.5   \nP-2   old fan   -   7   OK"
    assert found(spark, tables, wide, f"flow ({'x' * 5000}) = 3; at last ({' ' * 400}bar) = 2") == [[("MW", 16000.0), ("t", 4500.0), ("t", 7000.0)], [("bar", 200.0)]]


def test_index_proposes_whatever_is_near(tables):
    index = Q.UnitIndex([u[0] for u in UNITS])
    rng = random.Random(7)
    for name, _, _, most in index.names:
        for _ in range(3):  # a sign of glue put anywhere, a change of case
            at = rng.randrange(len(name) + 1)
            s = name[:at] + rng.choice(" ._-") + name[at:]
            assert Q.distance(s, name) > most or index.unit(s) is not None
    for name, unit, _, most in index.names:  # whatever the bounds leave out is far from every name
        for s in (name + " at the feed pump", name + "s" * 4, name + "." * 30, name.upper() + "s"):
            near = min((Q.distance(s, n), u) for n, u, _, m in index.names if Q.distance(s, n) <= m) if any(Q.distance(s, n) <= m for n, _, _, m in index.names) else None
            assert index.proposals(s) or near is None
    assert index.unit("x" * 100_000) is None and index.unit("") is None and Q.UnitIndex([]).unit("bar") is None


def test_number_notation(spark, tables):
    assert found(spark, tables, "1,234.5 bar", "2 345 kg", "−5.16 °C", "from -4 °C") == [[("bar", 123450.0)], [("kg", 2345.0)], [("°C", -5.16)], [("°C", -4.0)]]
    assert found(spark, tables, "1.234,5 bar", "0,5 MW", "12 345 kg", doc="d,") == [[("bar", 123450.0)], [("MW", 500.0)], [("kg", 12345.0)]]
    assert found(spark, tables, "0.5 MW", doc="d0") == [[("MW", 500.0)]] and found(spark, tables, "0.5 MW", doc="unknown") == [[("MW", 500.0)]]


def test_spellings(spark, tables):
    names = {"kelvin": "K", "KELVIN": "K", "deg. F": "°F", "℉": "°F", "M3/H": "m³/h", "m3/hr": "m³/h", "gal/min": "US gpm", "GPM": "US gpm", "bar gauge": "bar(g)", "bara": "bar", "PSIA": "psi", "megapascal": "MPa", "tonnes/h": "t/h", "tấn": "t", "metres": "m", "kilopascals": "kPa", "weeks": None, "V": None, "C": None, "of": None, "in": None, "to": None, "a": None}
    df = spark.createDataFrame([(Q.spelling(n),) for n in names] + [(None,)], "spelling string")
    got = {r.spelling: r.unit for r in Q.unit_aliases(df, tables[2]).collect()}
    assert {n: got.get(Q.spelling(n)) for n in names} == names


def test_distance_is_symmetric_and_zero_on_itself():
    rng = random.Random(3)
    words = ["".join(rng.choice("kPaMbar g()/h²s") for _ in range(rng.randint(0, 6))) for _ in range(60)]
    for a in words:
        assert Q.distance(a, a) == 0
        for b in words[:12]:
            assert abs(Q.distance(a, b) - Q.distance(b, a)) < 1e-9


def test_edges(spark, tables):
    long = "filler " * 60_000 + "at 3 bar"
    rows = spark.createDataFrame([("chunks", "d.", "a", long), ("chunks", "d.", "a", long), ("chunks", None, "b", "3 bar"), (None, "d.", None, "4 bar"), ("chunks", "d.", "c", None), ("chunks", "d.", "d", ""), ("chunks", "d.", "e", "３ ｂａｒ")], TEXT)
    extra = rows.withColumn("number", F.lit("x")).withColumn("spelling", F.lit("y")).withColumn("unit", F.lit("z"))
    for df in (rows, extra):
        got = sorted((r.row_id or "-", r.value_common) for r in Q.find_foreign_quantities(df, *tables).collect())
        assert got == [("-", 400), ("a", 300), ("b", 300), ("e", 300)]
    assert Q.find_foreign_quantities(rows.filter("false"), *tables).count() == 0
    assert Q.find_foreign_quantities(rows, *tables[:2], tables[2].filter("false")).count() == 0
    assert Q.find_foreign_quantities(rows, tables[0].filter("false"), *tables[1:]).count() == 4
