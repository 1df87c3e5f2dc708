"""Operators on small fixtures, against plain Python where the logic is sequential."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import extract as E
from ledgerloom.operators import positions as P
from ledgerloom.operators import relate as R
from ledgerloom.operators import rules as Q
from ledgerloom.operators import scale
from ledgerloom.operators import store as S
from ledgerloom.operators import summarize as Z
from ledgerloom.operators import words as O


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


WORDS = "d string, page int, word_id long, x0 double, top double, x1 double, bottom double, text string"


def test_rows_by_gap_and_by_mean(spark):
    # two lines 3.5 apart whose boxes overlap, and one far below
    data = [("a", 1, 1, 10.0, 100.0, 30.0, 110.0, "Zins"), ("a", 1, 2, 40.0, 103.5, 60.0, 113.5, "12.00"), ("a", 1, 3, 10.0, 130.0, 30.0, 140.0, "Total"), ("a", 1, 4, 45.0, 130.5, 80.0, 140.5, "5.00")]
    df = spark.createDataFrame(data, WORDS)
    assert rows(O.gap_rows(df, ["d", "page"]), "word_id", "row_no") == [(1, 1), (2, 2), (3, 3), (4, 3)]
    assert rows(O.nearest_rows(df, ["d", "page"], key="word_id"), "word_id", "row_no") == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_cells_margin_and_labels(spark):
    data = [("a", 1, 1, 10.0, 0.0, 20.0, 9.0, "Zins"), ("a", 1, 2, 24.0, 0.0, 40.0, 9.0, "brutto"), ("a", 1, 3, 60.0, 0.0, 80.0, 9.0, "12.00"), ("a", 1, 4, 5.0, 30.0, 9.0, 39.0, "7"), ("a", 1, 5, 90.0, 0.0, 99.0, 9.0, "CHF"), ("a", 1, 6, 105.0, 0.0, 120.0, 9.0, "5.00")]
    df = O.gap_rows(spark.createDataFrame(data, WORDS), ["d", "page"])
    cells = O.cells(df, ["d", "page", "row_no"])
    assert rows(O.row_texts(cells, ["d", "page", "row_no"]), "row_no", "row_text") == [(1, "Zins brutto | 12.00 CHF 5.00"), (2, "7")] or rows(cells, "row_no", "cell")[0] == (1, "12.00 CHF 5.00")
    assert rows(O.without_margin(df, ["d", "page", "row_no"], width=595), "word_id") == [(1,), (2,), (3,), (5,), (6,)]
    left = O.label_left(df, ["d", "page", "row_no"], F.col("text").rlike("^\\d+\\.\\d\\d$"))
    assert rows(left, "label", "amount") == [("CHF", "5.00"), ("Zins brutto", "12.00")]


def test_windows_and_values(spark):
    data = [("a", 1, i, float(20 * i), 0.0, 20.0 * i + 15, 9.0, w) for i, w in enumerate("Konto 24 652.55 CHF 24'652.55".split())]
    df = spark.createDataFrame(data, WORDS)
    assert O.windows(df, ["d"], "word_id", most=3).count() == 5 + 4 + 3
    values = spark.createDataFrame([("a", "24652.55"), ("a", "9.99")], "d string, v string")
    got = O.located(values, df, "d", "word_id", value="v")
    assert sorted((r.v, r.at, r.size) for r in got.collect()) == [("24652.55", 4, 1), ("9.99", None, None)]
    assert rows(O.thousands_joined(df, ["d"], "word_id"), "at", "joined") == [(2, "24652.55")]


def test_neighbours_in_bands(spark):
    labels = spark.createDataFrame([("a", 10.0, 50.0, 29.0, "Zins"), ("a", 10.0, 50.0, 100.0, "Saldo")], "d string, x0 double, x1 double, top double, label string")
    values = spark.createDataFrame([("a", 60.0, 80.0, 31.0, "12.00"), ("a", 20.0, 45.0, 59.0, "7.00"), ("a", 300.0, 320.0, 55.0, "1.00"), ("a", 60.0, 80.0, 300.0, "2.00")], "d string, x0 double, x1 double, top double, value string")
    pairs = O.neighbours(labels, values, ["d"])
    assert rows(pairs, "label", "value", "where") == [("Zins", "12.00", "beside"), ("Zins", "7.00", "below")]
    assert rows(O.nearest_value(pairs, ["d", "label"]), "label", "value") == [("Zins", "12.00")]


def test_single_values_and_sections(spark):
    df = spark.createDataFrame([("k", "5", 1), ("k", "6", 2), ("m", "5", 1), ("m", "6", 1), ("n", "5", 3), ("n", "5", 4)], "k string, v string, d int")
    assert rows(O.single_value(df, ["k"], "v", "d"), "k", "value", "state") == [("k", "6", "newest"), ("m", "5 / 6", "contradiction"), ("n", "5", "single")]
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(["x", "Konto 1", "y", "Konto 2", "z"])], "d string, n int, t string")
    assert rows(O.sections(lines, ["d"], ["n"], F.col("t").startswith("Konto")), "n", "section") == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)]


def test_readings_merged(spark):
    schema = "d string, y double, line string"
    a = spark.createDataFrame([("d", 10.0, "Brut%% 12"), ("d", 50.0, "nur links")], schema)
    b = spark.createDataFrame([("d", 12.0, "Bruttolohn total 12"), ("d", 90.0, "nur rechts")], schema)
    assert rows(O.better_lines(a, b, ["d"], score=O.readability(F.col("line"))), "line") == [("Bruttolohn total 12",), ("nur links",), ("nur rechts",)]


def test_as_of_and_ranges(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", 3)], "i int, k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 3, 30), ("a", 3, 31), ("b", 10, 99)], "k string, s int, v int")
    assert rows(R.as_of(left, right, ["k"], "t", "s", ["v"]).fillna(-1), "i", "v") == [(1, 31), (2, -1), (3, -1), (4, 31)]
    ranges = spark.createDataFrame([("a", 0.0, 25.0, "r"), ("a", 24.0, 24.5, "s")], "k string, lo double, hi double, n string")
    points = spark.createDataFrame([("a", 24.2), ("a", 26.0), ("b", 1.0), ("a", 0.0)], "k string, p double")
    assert rows(R.in_range(points, ranges, ["k"], "p", "lo", "hi", 10.0), "p", "n") == [(0.0, "r"), (24.2, "r"), (24.2, "s")]


def test_pairs_cover_and_sets(spark):
    debts = spark.createDataFrame([("g", "m1", "d1"), ("g", "", "d2"), ("g", "", "d3")], "g string, m string, l string")
    rates = spark.createDataFrame([("g", "", "z1"), ("g", "m1", "z2")], "g string, m string, r string")
    assert rows(R.paired(debts, rates, ["g"], "m", "l", "r"), "l", "r", "art") == [("d1", "z2", "mark"), ("d2", "z1", "position")]
    items = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "i int, k string")
    stock = spark.createDataFrame([("x",)], "k string")
    assert rows(R.covered(items, stock, ["k"], "i"), "i", "covered") == [(1, True), (2, False), (3, False)]
    sets = spark.createDataFrame([("o", 1, ["hans", "muster", "x"]), ("o", 2, ["hans"])], "o string, r int, t array<string>")
    members = spark.createDataFrame([("o", 7, ["hans", "muster"])], "o string, m int, mt array<string>")
    assert rows(R.contained(sets, members, ["o"], ["r"], "t", "mt", "m"), "r", "m") == [(1, 7)]


def test_positions_against_plain_python(spark):
    rng = random.Random(4)
    data = [(g, i, rng.choice([None, None, rng.randint(1, 9)])) for g in "ab" for i in range(25)]
    df = spark.createDataFrame(data, "g string, i int, given int")
    want_next, want_free = {}, {}
    for g in "ab":
        top, used = 0, {x for h, _, x in data if h == g and x}
        for h, i, x in data:
            if h != g:
                continue
            top = top + 1 if x is None else max(top, x)
            if x is None:
                want_next[g, i] = top
                n = next(k for k in range(1, 99) if k not in used)
                used.add(n)
                want_free[g, i] = n
            else:
                want_next[g, i] = want_free[g, i] = x
    assert {(r.g, r.i): r.pos_new for r in P.lowest_free(df, ["g"], ["i"], "given").collect()} == want_free
    assert {(r.g, r.i): r.pos_new for r in P.kept_or_next(df, ["g"], ["i"], "given").collect()} == want_next
    plain = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("a", 4, None), ("b", 1, 2)], "g string, i int, given int")
    assert rows(P.kept_or_next(plain, ["g"], ["i"], "given"), "g", "i", "pos_new") == [("a", 1, 1), ("a", 2, 5), ("a", 3, 6), ("a", 4, 7), ("b", 1, 2)]


def test_numbers_over_range_partitions(spark):
    values = list(range(1, 301))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    assert rows(scale.numbered_globally(df, ["v"], "n"), "v", "n") == [(v, v) for v in range(1, 301)]
    ids = P.next_ids(df.limit(3), spark.createDataFrame([("p0009",), ("p0010",)], "id string"), "id", "p", 4, ["v"])
    assert sorted(r.id for r in ids.collect()) == ["p0011", "p0012", "p0013"]


def test_auroc_and_modes(spark):
    rng = random.Random(2)
    data = [(rng.choice([0.1, 0.2, 0.3, 0.4]), rng.random() < 0.4) for _ in range(120)]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "s double, y boolean")
    assert abs(Z.auroc(df, "s", "y").collect()[0].auroc - want) < 1e-9
    assert Z.auroc(df.where("y"), "s", "y").collect()[0].auroc is None
    m = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2)], "k string, v int")
    assert rows(Z.strict_mode(m, ["k"], "v").fillna(-1), "k", "v") == [("a", 1), ("b", -1)]
    assert rows(Z.upper_median(m, ["k"], "v"), "k", "median") == [("a", 1), ("b", 2)]


def test_store_rules(spark):
    old = spark.createDataFrame([("p1", "5", "geprueft"), ("p2", "6", "vorschlag"), ("p3", "7", "geprueft")], "id string, v string, s string")
    new = spark.createDataFrame([("p1", "9", "geprueft"), ("p2", "8", "vorschlag")], "id string, v string, s string")
    locked = F.col("s") == "geprueft"
    assert rows(S.changed_values(old, new, "id", ["v"], locked), "id", "v_before", "v_after") == [("p1", "5", "9")]
    assert rows(S.vanished(old, new, ["id"], locked), "id") == [("p3",)]
    assert rows(S.protocol(old, new, "id", ["v"]), "id", "vorher", "nachher") == [("p1", "5", "9"), ("p2", "6", "8")]
    assert rows(S.merged(old, new, ["id"], ["v"]), "id", "v", "action") == [("p1", "9", "update"), ("p2", "8", "update"), ("p3", "7", "keep")]
    assert rows(S.field_merged(old, spark.createDataFrame([("p1", ""), ("p9", "1")], "id string, v string"), ["id"], ["v"]), "id", "v") == [("p1", "5"), ("p2", "6"), ("p3", "7"), ("p9", "1")]


def test_types_and_fields(spark):
    docs = spark.createDataFrame([(1, "Lohn Lohn Netto Zins"), (2, "Zins Lohn"), (3, "nichts"), (4, "a b c Zins")], "i int, t string")
    assert rows(E.typed(docs, "t", {"lohn": "lohn|netto|Lohn|Netto", "bank": "Zins"}, head=3), "i", "typ") == [(1, "lohn"), (2, "multiple"), (3, "unknown"), (4, "bank")]
    got = E.extracted(spark.createDataFrame([("Saldo 1.00 dann Saldo 2.00",), ("x",)], "t string"), "t", [E.Rule("s", "Saldo ([0-9.]+)", last=True), E.Rule("e", "Saldo ([0-9.]+)")])
    assert {(r.s, r.e) for r in got.collect()} == {("2.00", "1.00"), (None, None)}


def test_findings(spark):
    df = spark.createDataFrame([(1, 100.0, 90.0), (2, 100.0, 120.0), (3, None, 5.0)], "i int, a double, b double")
    checks = [Q.Check("swap", "unstimmig", Q.swapped(F.col("a"), F.col("b"))), Q.Check("sum", "hinweis", Q.off_sum(F.col("a"), [F.col("b")], 5))]
    assert rows(Q.findings(df, ["i"], checks), "i", "code") == [(1, "sum"), (2, "sum"), (2, "swap")]


def test_phrases_do_not_overlap(spark):
    words = spark.createDataFrame([("d", i, w) for i, w in enumerate("Muster AG Muster AG Bern Muster".split())], "d string, n int, text string")
    names = spark.createDataFrame([("Muster AG",), ("Muster AG Bern",), ("AG Muster",)], "p string")
    assert rows(R.phrases(words, names, ["d"], "n", "p", 3), "start", "window") == [(0, "Muster AG"), (2, "Muster AG Bern")]


def test_label_spans_headers_and_sums(spark):
    data = [("a", 1, 1, 10.0, 0.0, 30.0, 9.0, "Brutto"), ("a", 1, 2, 34.0, 0.0, 60.0, 9.0, "Lohn"), ("a", 1, 3, 10.0, 30.0, 30.0, 39.0, "Lohn"), ("a", 1, 4, 10.0, 60.0, 30.0, 69.0, "Total"), ("a", 1, 5, 50.0, 60.0, 70.0, 69.0, "9.00")]
    df = spark.createDataFrame(data, WORDS)
    labels = spark.createDataFrame([("Brutto Lohn",), ("Lohn Lohn",), ("Total",)], "label string")
    assert rows(O.label_spans(df, ["d"], "word_id", labels, "label"), "start", "size", "label") == [(1, 2, "Brutto Lohn"), (4, 1, "Total")]
    cells = O.cells(O.gap_rows(df, ["d", "page"]), ["d", "page", "row_no"])
    found = O.below_header(cells, ["d", "page"], F.col("cell").startswith("Brutto"), F.col("cell") == "Total", F.col("cell").rlike("^\\d"))
    assert rows(found, "header", "value") == [("Brutto Lohn", "9.00")]
    amounts = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, 5.0), ("a", 4, 5.0)], "d string, n int, v double")
    assert rows(O.sums_up_to(amounts, ["d"], ["n"], "v"), "n") == [(3,)]


def test_least_score_under_spans(spark):
    tokens = spark.createDataFrame([("a", 0, "abc", 0.9), ("a", 1, "de", 0.2), ("a", 2, "fgh", 0.5)], "d string, n int, w string, p double")
    spans = spark.createDataFrame([("a", 0, 3), ("a", 2, 4), ("a", 5, 8)], "d string, start int, end int")
    assert rows(O.span_minimum(tokens, spans, "d", "n", "w", "p", width=2), "start", "least", "tokens") == [(0, 0.9, 1), (2, 0.2, 2), (5, 0.5, 1)]


def test_sole_rows_and_column_meanings(spark):
    df = spark.createDataFrame([("a", "2022", "5"), ("a", "2021", "6"), ("b", "2022", "1"), ("b", "2022", "2"), ("c", "2020", "1")], "k string, y string, v string")
    got = Z.sole_row(df, ["k"], F.col("y") == "2022", "v").collect()
    assert sorted((r.k, r.v, r.befund) for r in got) == [("a", "5", None), ("b", None, "mehrdeutig"), ("c", None, "fehlt")]
    votes = [(F.col("v") > "4", "gross"), (F.col("v") > "0", "klein")]
    meant = Z.majority(df.withColumn("s", F.lit("x")), ["s"], "k", votes).collect()
    assert sorted((r.k, r.bedeutung) for r in meant) == [("a", "gross"), ("b", "klein"), ("c", "klein")]


def test_names_of_any_character_form(spark):
    from ledgerloom.plans.ledger import members_named, sum_per_person

    names = ["Zoë\u00a0D’Arçon", "Zoe\u0308 D'Arc\u0327on", "Ｚｏë D'Arçon", "D'Ar\u200bçon, Z\u043eë", "Zoë Anders"]
    rows = [(i, f"k{i}", "d", "kk_praemienbescheinigung", "versicherte_person_name", n, None) for i, n in enumerate(names)]
    rows += [(10 + i, f"k{i}", "d", "kk_praemienbescheinigung", "praemie_kvg_total", "", "10.50") for i in range(5)]
    fields = spark.createDataFrame(rows, "row_id long, dokument_id string, dossier_id string, belegtyp string, feld string, wert_raw string, wert_decimal string")
    tables = {"field_rows": fields, "family": spark.createDataFrame([("d", 1, "Zoë", "D'Arçon")], "dossier_id string, member_id long, first_name string, last_name string")}
    assert sorted(r.row_id for r in members_named(tables.get).collect()) == [0, 1, 2, 3]
    assert {tuple(r) for r in sum_per_person(tables.get).collect()} == {("d'arcon zoe", 42.0, 4), ("anders zoe", 10.5, 1)}


def test_types_from_two_hundred_words(spark):
    from ledgerloom.plans.records import typed

    docs = spark.createDataFrame([(1, "Spende " + "wort " * 40 + "Bruttolohn Nettolohn"), (2, "Spende " + "wort " * 220 + "Bruttolohn Nettolohn")], "doc_id long, text string")
    assert {tuple(r) for r in typed({"documents": docs}.get).collect()} == {(1, "lohn", 2), (2, "spende", 1)}
