"""Scalar functions against vectors of written forms."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import texts as X


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


STRICT = {
    "1'234.50": ("ok", 1234.5), "1’234.50": ("ok", 1234.5), "1 234,50": ("ok", 1234.5), "CHF 1'234.50": ("ok", 1234.5), "Fr. 1'234.50": ("ok", 1234.5), "123'456'789.00": ("ok", 123456789.0), "0.00": ("ok", 0.0), "-1'234.50": ("ok", -1234.5), "1'365.--": ("ok", 1365.0),
    "12,345": ("ok", 12345.0), "7.793": ("ok", 7793.0), "0.125": ("garbage", None), "1.234,50": ("garbage", None), "{CHF 8.718}": ("garbage", None), "[1234.50]": ("garbage", None), "1234.50abc": ("garbage", None), "ca. 1234.50": ("garbage", None), "1,234.56": ("ok", 1234.56),
    "": ("null", None), "-": ("null", None), "–": ("null", None), "–.–": ("null", None), "-.-": ("null", None), ".--": ("null", None), "１２.５０": ("ok", 12.5), None: ("null", None),
}


def test_strict_amounts(spark):
    got = run(spark, A.strict_amount, list(STRICT))
    assert [(g.status, None if g.value is None else float(g.value)) for g in got] == list(STRICT.values())


def test_tolerant_amounts(spark):
    got = run(spark, A.amount_cents, ["57 709,60", "-CHF 99'999.99", "9.–", "+310.00", "132436.4900", " 7.5", "n/a", "", None, "9'999'999.99"])
    assert [None if g is None else float(g) for g in got] == [57709.6, -99999.99, 9.0, 310.0, 132436.49, 7.5, None, None, None, 9999999.99]


def test_cells_and_parts(spark):
    assert [None if g is None else float(g) for g in run(spark, A.cell_amount, ["2021", "35%", "31.12.2021", "1'200.00", "1°200.00", "12 500.00", "Total", "31.12."])] == [None, None, None, 1200.0, 1200.0, 12500.0, None, None]
    assert run(spark, A.split_amounts, ["1'000.00 10.00", "1 000.00 10.00", "10.00", "10.00 5"]) == [["1000.00", "10.00"], ["1000.00", "10.00"], None, None]


def test_spellings_and_lenient(spark):
    forms = run(spark, lambda c: A.spellings(c.cast("decimal(18,2)")), ["1234.00"])[0]
    assert {"1'234.00", "1’234.00", "1 234,00", "1234.-", "1'234.–", "1234"} <= set(forms)
    assert run(spark, A.lenient, ["1'200.00", "1 200,50", None]) == ["1200", "1200.50", ""]
    assert run(spark, lambda c: A.shown_amount(c.cast("decimal(18,4)")), ["12164.855", "-5"]) == ["12'164.86", "-5.00"]


def test_ibans(spark):
    assert run(spark, A.iban_state, ["CH52 0772 0532 7777 6861 8", "CH52 0772 0532 7777 6861 9", "CHxx xxxx xxxx xxxx 7270", "CH52", "CH52 0772"]) == ["ok", "checksum", "masked", "masked", "length"]


def test_dates(spark):
    assert [str(d) if d else None for d in run(spark, X.parsed_date, ["31.12.2024", "1.1.2024", "2024-01-01", "01/01/2024", "2024.01.01", "99.99.2024", None])] == ["2024-12-31", "2024-01-01", "2024-01-01", None, None, None, None]


def test_keys(spark):
    got = run(spark, X.position_parts, ["a.pdf|Zins", "a.pdf|Zins#2", "a.pdf|Konto #1234", "a.pdf|Konto #12", "a.pdf|Zins#02", "a.pdf|Zins#1"])
    assert [(g.doc, g.target, g.pos) for g in got] == [("a.pdf", "Zins", 1), ("a.pdf", "Zins", 2), ("a.pdf", "Konto #1234", 1), ("a.pdf", "Konto #12", 1), ("a.pdf", "Zins#02", 1), ("a.pdf", "Zins#1", 1)]
    assert run(spark, X.line_order, ["16.6", "2", "x", ""]) == [[16, 6], [2], [999], [999]]


def test_names(spark):
    assert run(spark, X.clean_person, ["Muster Hans, 01.02.1980", "Hans Muster, 8000 Oberwil", "Muster, Hans, Weg 3"]) == ["Muster Hans", "Hans Muster", "Muster"]
    assert run(spark, X.name_tokens, ["Zoë  MÜLLER, zoë"]) == [["muller", "zoe"]]
    assert run(spark, X.resolved_glyphs, ["J(cid:228)hr(cid:999)"]) == ["Jähr"]
    assert run(spark, lambda c: X.role_of(c, ["mann", "frau"]), ["mann", "Hans (frau)", "Hans (x)"]) == ["mann", "frau", None]


def test_states(spark):
    got = run(spark, lambda c: X.value_state(c, c.try_cast("double")), [None, "-", "manual_review:x", "not_in_beleg_by_design", "0.00", "12.00"])
    assert got == ["absent", "placeholder", "marker", "by_design", "zero", "real"]


def test_anchors(spark):
    got = run(spark, X.anchor_parts, ["S.2 (1.0, 2.5, 3.0, 4.0)", "frei", None])
    assert [(g.page, g.bbox) for g in got] == [(2, [1.0, 2.5, 3.0, 4.0]), (1, None), (1, None)]


@pytest.mark.parametrize("text,want", [("wärmt dach", True), ("baut aus", False), ("dach baut", None), ("", None)])
def test_one_of_two(spark, text, want):
    assert run(spark, lambda c: X.one_of_two(c, "dach", "baut"), [text]) == [want]
