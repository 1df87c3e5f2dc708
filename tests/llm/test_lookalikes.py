from ledgerloom.llm.lookalikes import consistent_run, plain_form, repaired


def test_plain_form_of_single_characters():
    assert plain_form("Vögt") == "Vögt"
    assert plain_form("１２＇３") == "12'3"
    assert plain_form("5​5­1﻿") == "551"
    assert plain_form("𝟑𝟏.𝟏𝟐.") == "31.12."
    assert plain_form("1 200") == "1 200"
    assert plain_form("d’intérêts") == "d'intérêts"
    assert plain_form("m² ½ ① – «x» ‘Original’ (cid:228)") == "m² ½ ① – «x» ‘Original’ (cid:228)"


def test_runs_of_mixed_scripts():
    assert consistent_run("Kаnton") == "Kanton"
    assert consistent_run("СНF") == "CHF"
    assert consistent_run("Справка") is None
    assert consistent_run("Zürich") is None
    assert consistent_run("Итогo") == "Итого"


def test_repair_needs_the_word_in_the_corpus(spark):
    rows = [
        (1, "Kanton Bern", "x"),
        (2, "Kаnton", "x"),
        (3, "Qwаxyz", "x"),
        (4, "Справка", "x"),
        (5, None, "x"),
        (6, "", "x"),
        (7, "  zwei  Blanks ", "x"),
        (8, "Kаnton", "x"),
        (8, "Kаnton", "x"),
        (9, "Kanton​ " * 5000, None),
    ]
    df = spark.createDataFrame(rows, "id int, text string, _fixed string")
    out = sorted((r.id, r.konsistent[:12]) for r in repaired(df).collect())
    assert out == [(2, "Kanton"), (8, "Kanton"), (8, "Kanton"), (9, "Kanton Kanto")]


def test_empty_table(spark):
    assert repaired(spark.createDataFrame([], "id int, text string")).count() == 0


def test_other_columns_keep_types_and_nulls(spark):
    df = spark.createDataFrame([(2**60 + 1, "5​", {"a": 1}, [1.5]), (None, "6​", None, None)], "id long, text string, m map<string,int>, xs array<double>")
    out = sorted(repaired(df).collect(), key=lambda r: r.konsistent)
    assert [(r.id, r.konsistent, r.m, r.xs) for r in out] == [(2**60 + 1, "5", {"a": 1}, [1.5]), (None, "6", None, None)]


def test_glued_words_and_initials(spark):
    df = spark.createDataFrame([(1, "Christoph Muster"), (2, "ChristophMuѕter"), (3, "cMuѕter"), (4, "gmuѕter"), (5, "C. Muster und G. Muster"), (6, "xmuѕter")], "id long, text string")
    assert sorted((r.id, r.konsistent) for r in repaired(df).collect()) == [(2, "ChristophMuster"), (3, "cMuster"), (4, "gmuster")]


def test_words_of_other_scripts_stay(spark):
    rows = ["Привет мир, а ты", "у нас сор", "Η Μαρία και ο Νίκος", "Α και Ο", "Ես ու դու սոսո", "la copie a y cop o", "Kаnton а", "Kanton Bern a co ch", "Со.", "сор", "104а", "СН-3132", "Κ. Muster", "Итогo", "Итого"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    out = {r.text: r.konsistent for r in repaired(df).collect()}
    assert out == {"Kаnton а": "Kanton a", "Со.": "Co.", "104а": "104a", "СН-3132": "CH-3132", "Итогo": "Итого"}


def test_dominant_script():
    assert consistent_run("Мuster") == "Muster" and consistent_run("Москвa") == "Москва"
    assert consistent_run("сор") is None and consistent_run("СH") == "CH" and consistent_run("СH", "CYRILLIC") == "СН"
