import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.operators import classify as K
from ledgerloom.operators import positions as P
from ledgerloom.operators import relate as R
from ledgerloom.operators import rules as Q
from ledgerloom.operators import scrub as C
from ledgerloom.operators import store as S
from ledgerloom.operators import summarize as Z
from ledgerloom.operators import words as O
from ledgerloom.plans.chain import RULES
from ledgerloom.session import shared_dir
from ledgerloom.sources import readers as D
from ledgerloom.sources import writers as V


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


TITLES = {
    "Lohnausweis 2024 Bruttolohn total": "lohnausweis",
    "L®hnausweis": "lohnausweis",
    "Zinsausweis Bank": "bank_zinsausweis",
    "Freizugigkeit Saldoverzeichnis Zinsabschluss": "freizuegigkeitskonto",
    "Säule 3a Prämie": "saeule_3a",
    "Prämienbescheinigung Krankheitskosten": "kk_praemienbescheinigung",
    "Festhypothek Zinsabrechnung": "hypothek_zinsbestaetigung",
    "Konto-auszug Prämie CH93 0076 2011 6238 5295 7": "bank_zinsausweis",
    "Konto-auszug Prämie": ("unknown", "multiple_belegtyp_match"),
    "Spende Kita": ("unknown", "multiple_belegtyp_match"),
    "Arbeitslosenentschädigung Taggeld": ("unknown", "unsupported_type"),
    "Certificato di salario ALV Taggeld": "lohnausweis",
    "nichts": ("unknown", "unsupported_type"),
    "": ("unknown", "unsupported_type"),
    "wort " * 250 + "Depotauszug": "wertschriftenverzeichnis",
    "Kita " + "wort " * 250 + "Depotauszug Steuerauszug": "kinderbetreuung",
}


def test_types(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)] + [(99, None)], "typ_id int, text string")
    got = {r.text: (r.typ, r.grund) for r in K.classified(df, "text").collect()}
    want = {t: (w if isinstance(w, tuple) else (w, None)) for t, w in TITLES.items()}
    assert {t: got[t] for t in want} == want and got[None][0] == "unknown"


def test_chain(spark):
    words = "Lohnausweis 2024 8. Bruttolohn total 95'400.00 11. Nettolohn Fr. 79'500.00 bis 31.12.2024".split(" ")
    data = [("a", 2, i, w) for i, w in enumerate(words)] + [("a", 1, 0, "alt"), ("b", 1, 0, "nichts"), ("c", 1, 0, None)]
    df = spark.createDataFrame(data, "dok string, at int, n int, text string")
    out = K.ledger_rows(df, RULES, document="dok", reading="at", order="n", text="text")
    got = {(r.dok, r.feld): (r.betrag, str(r.tag) if r.tag else None, r.status, r.konf) for r in out.collect()}
    assert got["a", "bruttolohn_pos8"] == (95400.0, None, "ok", 1.0) and got["a", "nettolohn_pos11"] == (79500.0, None, "ok", 1.0)
    assert got["a", "periode_bis"] == (None, "2024-12-31", "ok", 1.0) and got["a", "bvg_abzug_pos10a"][2] == "fehlt"
    assert got["b", None][2] == got["c", None][2] == "fehlt"
    assert K.ledger_rows(df.limit(0), RULES, document="dok", reading="at", order="n", text="text").count() == 0


def test_strict_amount_forms(spark):
    forms = {"Fr 100.00": 100.0, "SFr 5.00": 5.0, "1'365.—": 1365.0, "1'365.--": 1365.0, "7.793": 7793.0, "1.234.567.890.123.456.789.012": 1.234567890123456789012e21, "0.125": None, "1.234,50": None, "1,234.50": 1234.5, "{CHF 8.718}": None, "ca. 1234.50": None, "–.–": None}
    df = spark.createDataFrame([(k,) for k in forms], "t string")
    got = {r.t: r.v for r in df.select("t", A.strict_amount(F.col("t"))["value"].cast("double").alias("v")).collect()}
    assert got == forms


def test_amount_modes(spark):
    df = spark.createDataFrame([("1'234,50",), ("1.234,50",), ("35 %",), ("0.—",), ("abc",), (None,), ("null",), ("1 200.5",)], "t string")
    c = F.col("t")
    got = {r.t: tuple(r)[1:] for r in df.select("t", A.comma_amount(c), A.dot_thousands_amount(c), A.percent_amount(c), A.is_zero(c), A.plain_amount(c)).collect()}
    assert got["1'234,50"] == (1234.5, 1234.5, 1234.5, False, None) and got["1.234,50"] == (None, 1234.5, None, False, None)
    assert got["35 %"][2] == 35.0 and got["0.—"][3] and got["1 200.5"][4] == 1200.5
    assert got["abc"] == got[None] == got["null"] == (None, None, None, False, None)


def test_detectors_and_placeholders(spark, tmp_path):
    texts = [
        "AHV 756.1234.5678.97 und 7561234567897", "756 . 2302. 1234. 56", "CH9300762011623852957", "CH00 0000 0000 0000 0000 0", "Tel 044 555 12 34 044 555 12 35", "044 000 00 00", "O44", "0l4 5O5 12 34", "a.b@firma.ch c@example.com", "3196 Oberhofen", "2022 Steuerausweis", "01-123456-7", "www.firma.ch", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in C.detected(df, ["i"], "t").collect():
        got.setdefault(r.i, []).append(r.category)
    assert sorted(got[0]) == ["ahv", "ahv"] and got[1] == ["ahv"] and got[2] == ["iban"] and 3 not in got and got[4].count("phone") == 2
    assert 5 not in got and 6 not in got and got[7] == ["misread_phone"] and got[8] == ["email"] and got[9] == ["place"] and 10 not in got and got[11] == ["account"] and got[12] == ["domain"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.md").write_text("eins\nTel 044 555 12 34\n", encoding="utf-8")
    (tmp_path / "y.txt").write_text("sauber\n", encoding="utf-8")
    assert rows(C.leaks(spark, str(tmp_path)), "line", "category") == [(2, "phone")]
    with pytest.raises(ValueError, match="phone"):
        C.verified_clean(spark, str(tmp_path))
    (tmp_path / "sub" / "x.md").unlink()
    C.verified_clean(spark, str(tmp_path))


def test_strike_restore_and_states(spark):
    version = spark.createDataFrame([("a", "offen"), ("b", "geprueft"), ("c", None)], "id string, status string")
    keys = spark.createDataFrame([("a",), ("b",), ("b",), ("x",)], "id string")
    after, journal = S.struck(version, keys, ["id"], "status", F.lit(1))
    assert rows(after, "id", "status") == [("a", "gestrichen"), ("b", "gestrichen"), ("c", None)] and journal.count() == 2
    again, more = S.struck(after, keys, ["id"], "status", F.lit(2))
    assert more.count() == 0 and rows(again, "id", "status") == rows(after, "id", "status")
    back, entries = S.restored(after, journal, keys.where("id = 'b'"), ["id"], "status", F.lit(3))
    assert rows(back, "id", "status") == [("a", "gestrichen"), ("b", "geprueft"), ("c", None)] and entries.count() == 1
    twice, none = S.restored(back, journal.unionByName(entries), keys, ["id"], "status", F.lit(4))
    assert rows(twice, "id", "status") == [("a", "offen"), ("b", "geprueft"), ("c", None)] and none.count() == 1
    marks = spark.createDataFrame([(True, False, "", False, False), (False, True, "5", False, False), (False, True, " ", False, False), (True, False, "5", True, False), (True, True, "5", True, True), (None, None, None, None, None)], "c boolean, s boolean, v string, k boolean, w boolean")
    got = [r[0] for r in marks.select(S.correction_states(*[F.col(x) for x in "csvkw"])).collect()]
    assert got == ["confirmed", "confirmed", "open", "struck", "withdrawn", "open"]


def test_load_once_and_reextract(spark):
    folder = f"{shared_dir(spark)}/load-test-{spark.sparkContext.applicationId}"
    df = spark.createDataFrame([(1,), (2,), (2,)], "i int")
    assert S.loaded_once(df, folder) == 3
    with pytest.raises(ValueError):
        S.loaded_once(df, folder)
    version = spark.createDataFrame([("d", "f", "1", 10), ("d", "g", "2", 10), ("e", "f", "9", 10)], "d string, f string, v string, s int")
    fresh = spark.createDataFrame([("d", "f", "1", 20), ("d", "h", "3", 20)], "d string, f string, v string, s int")
    assert rows(S.reextracted(version, fresh, ["d", "f"], "d", ["v"], "s"), "d", "f", "v", "s") == [("d", "f", "1", 10), ("d", "h", "3", 20), ("e", "f", "9", 10)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("F", "1", "a|b", 10.0), ("F", "1", None, None), ("F", "2", "c", 0.0), ("G", "", "d", 1234.5)], "form string, line string, label string, b double")
    lines = [r.text for r in V.ledger_lines(df, "form", "line", "label", "b").orderBy("form", F.col("line").asc_nulls_last(), "rang", "text").collect()]
    assert lines[0] == "| 1 |  |  |" and "| 1 | **Zwischentotal** | 10.00 |" in lines and lines[-1] == "| | **Total** | 1'234.50 |" and any("a\\|b" in x for x in lines)
    V.text_report(V.ledger_lines(df, "form", "line", "label", "b"), ["form", "line", "rang"], str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == len(lines)
    V.ledger_csv(df, str(tmp_path / "ledger"), ["form", "label", "b"], "b")
    V.ledger_csv(df, str(tmp_path / "ledger"), ["form", "label", "b"], "b")
    assert spark.read.option("header", True).csv(str(tmp_path / "ledger")).count() == 2 and (tmp_path / "ledger.bak-1").exists()
    V.replace_json(df, str(tmp_path / "j"))
    V.replace_json(df.limit(1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1 and spark.read.json(str(tmp_path / "j.bak")).count() == 4 and not (tmp_path / "j.new").exists()
    V.snapshot(df, str(tmp_path / "s"), "20240101")
    V.snapshot(df.limit(1), str(tmp_path / "s"), "20240102")
    assert [(r.snapshot, r.rows) for r in V.snapshots(spark, str(tmp_path / "s")).collect()] == [("20240101", 4), ("20240102", 1)]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "store.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE position (id TEXT, pos INTEGER)")
        db.executemany("INSERT INTO position VALUES (?, ?)", [(f"p{i}", i) for i in range(100)])
        db.execute("CREATE TABLE leer (id TEXT)")
    df = D.sqlite_table(spark, path, "position", "id string, pos bigint, neu string", parts=3)
    assert df.count() == 100 and df.agg(F.sum("pos")).first()[0] == 4950 and df.where("neu is not null").count() == 0
    assert D.sqlite_table(spark, path, "leer", "id string").count() == 0
    with pytest.raises(ValueError):
        D.sqlite_table(spark, path, "position; drop", "id string")


def test_dispatch_and_pivot(spark):
    df = spark.createDataFrame([(1, "a", 5.0, 4.0), (2, "b", None, 1.0), (3, "z", 1.0, 2.0), (4, None, 1.0, 2.0)], "i int, typ string, x double, y double")
    plain = {"b": [Q.Check("ohne_x", "fehler", F.col("x").isNull())]}
    sums = {"a": [Q.Check("groesser", "hinweis", F.col("x") > F.col("y"))]}
    assert rows(Q.dispatched(df, ["i"], "typ", plain, sums), "i", "code") == [(1, "groesser"), (2, "ohne_x")]
    assert rows(Q.dispatched(df, ["i"], "typ", plain, sums, skip_arithmetic=True), "i", "code") == [(2, "ohne_x")]
    p = spark.createDataFrame([("k", "mann"), ("k", "kind1"), ("k", None), ("m", "")], "k string, p string")
    assert rows(Z.pivoted(p, ["k"], "p", {"mann": "mann", "": "leer"}), "k", "mann", "leer", "andere") == [("k", 1, 0, 2), ("m", 0, 1, 0)]


def test_hot_keys(spark):
    many = [(i, "hot", "s%d" % (i % 300)) for i in range(3000)] + [(9001, "x", "only"), (9002, None, "s1"), (9003, "y", None)]
    df = spark.createDataFrame(many, "i int, k string, src string")
    out = {r.i: (r.first_source, r.others) for r in P.duplicates_marked(df, ["k"], "src").collect()}
    assert len(out) == len(many) and out[5] == ("s0", 299) and out[9001] == out[9002] == out[9003] == (None, 0)
    sets = spark.createDataFrame([("o", i, ["hans", f"n{i}"]) for i in range(500)] + [("o", 900, None), ("p", 1, ["hans"])], "o string, r int, t array<string>")
    members = spark.createDataFrame([("o", 1, ["hans", "n7"]), ("o", 2, ["hans"]), ("o", 3, ["nie"]), ("o", 4, []), ("p", 5, ["hans", "n7"])], "o string, m int, mt array<string>")
    got = rows(R.contained(sets, members, ["o"], ["r"], "t", "mt", "m"), "r", "m")
    assert (7, 1) in got and sum(m == 2 for _, m in got) == 500 and len(got) == 501
    values = spark.createDataFrame([("a", float(v % 7)) for v in range(1000)] + [("b", 1.0), (None, 2.0), ("c", None)], "k string, v double")
    assert rows(Z.upper_median(values, ["k"], "v"), "k", "median", "n") == [("a", 3.0, 1000), ("b", 1.0, 1), (None, 2.0, 1)]


def test_three_readings(spark):
    lines = spark.createDataFrame([("d", 1, 10.0, "Br%t%"), ("d", 2, 11.0, "Bruttolohn total"), ("d", 2, 50.0, "nur zwei"), ("d", 3, 90.0, "nur drei"), ("e", 1, 1.0, "allein")], "d string, n int, y double, line string")
    out = O.merged_readings(lines, ["d"], "n", score=O.readability(F.col("line")))
    assert rows(out, "d", "line") == [("d", "Bruttolohn total"), ("d", "nur drei"), ("d", "nur zwei"), ("e", "allein")]
    seen = spark.createDataFrame([("k", "f", "1", "a"), ("k", "f", "1", "b"), ("k", "f", "1", "b"), ("k", "f", "2", "c")], "k string, f string, v string, s string")
    assert rows(O.merged_objects(seen, ["k"], "f", "v", "s"), "v", "sources", "first_source", "values") == [("1", 2, "a", 2), ("2", 1, "c", 2)]


def test_name_and_date_variants(spark):
    df = spark.createDataFrame([(1, "Hans Peter", "Muster"), (2, "", "Muster"), (3, None, "x")], "i int, f string, l string")
    got = {r.i: r.v for r in df.select("i", C.name_variants(F.col("f"), F.col("l")).alias("v")).collect()}
    assert {"Hans", "Peter", "Hans Peter", "Muster, Hans", "Herr Peter Muster", "H. Muster", "HansMuster", "Muster-Peter"} <= set(got[1]) and len(got[1]) == len(set(got[1]))
    assert [len(x) for x in got[1]] == sorted((len(x) for x in got[1]), reverse=True) and got[2] is None and got[3] is None
    pairs = df.where("i = 1").select(F.inline(C.name_variant_pairs(F.col("f"), F.col("l"), F.lit("Eva"), F.lit("Neu")))).collect()
    assert ("Muster, Peter", "Neu, Eva") in [tuple(r) for r in pairs]
    day = spark.createDataFrame([("1980-03-05",), (None,)], "d string").select(C.birth_date_variants(F.col("d").cast("date")).alias("v")).collect()
    assert {"5.3.1980", "05.03.80", "19800305", "05-03-1980"} <= set(day[0].v) and len(day[0].v) == 9 and day[1].v is None


def test_anonymised(spark):
    texts = ["AHV 7561234567897 vom 31.12.2022 Total 1'234.50", "geboren am 05.03.1980", "Tel 0441234567", "Bahnhofstrasse 12, 8400 Winterthur", "a@b.ch 12.00 2024", "", None, "nur 31.12.2022", "5.00 6.00"]
    df = spark.createDataFrame([(i, t, "d") for i, t in enumerate(texts)], "i int, t string, d string")
    got = [r.a for r in df.orderBy("i").select(C.anonymised(F.col("t"), F.col("d")).alias("a")).collect()]
    assert got[0].startswith("AHV 7560000000000 vom 31.12.2022 Total ") and "1'234.50" not in got[0]
    assert got[1] == "geboren am 01.01.1900" and got[2] == "Tel 044-000-00-00" and got[3] == "Musterstrasse 1, 8000 Musterhausen"
    assert got[4].startswith("anon@example.com ") and got[4].endswith(" 2024") and got[5] == "" and got[6] is None and got[7] == texts[7]
    a, b = (float(x) for x in got[8].split(" "))
    assert abs(b / a - 1.2) < 0.01 and a != 5.0


def test_value_windows(spark):
    words = ["Total", "CHF", "1", "234.50", "(1'234.50)", "Lohnausweis", "ab", "Müller"]
    df = spark.createDataFrame([("d", 1, i, w) for i, w in enumerate(words)] + [("d", 1, 99, None), ("e", 1, 0, "x")], "d string, r int, n int, text string")
    values = spark.createDataFrame([(1, "d", "1'234.50"), (2, "d", "Lohnausweis 2024"), (3, "d", "nichts"), (4, "d", None), (5, "x", "Total"), (6, "d", "CHF 1 234.50 (1"), (7, "d", "l")], "i int, d string, v string")
    got = {r.i: (r.found, r.start, r.size) for r in O.value_windows(values, df, "d", "r", "n", value="v").collect()}
    assert got == {1: ("forward", 4, 1), 2: ("backward", 5, 1), 3: ("none", None, None), 4: ("none", None, None), 5: ("none", None, None), 6: ("forward", 1, 4), 7: ("forward", 0, 1)}


def shuffled_rows(df):
    """Rows that all exchanges of the plan write when ``df`` is collected."""
    df.collect()

    def walk(plan):
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return walk(plan.plan())
        written = plan.metrics().get("shuffleRecordsWritten")
        children = plan.children()
        return (written.get().value() if written.isDefined() else 0) + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_value_windows_shuffle_each_word_once(spark):
    words = spark.createDataFrame([(f"d{d}", 1, i, f"Wort{i}{d}") for d in range(5) for i in range(40)], "d string, r int, n int, text string")
    values = spark.createDataFrame([(d, f"d{d}", f"Wort7{d} Wort8{d}") for d in range(5)], "i int, d string, v string")
    assert shuffled_rows(O.value_windows(values, words, "d", "r", "n", value="v")) <= words.count() + 2 * values.count()


def plain_windows(values, words, most=12):
    """``value_windows`` of texts as they stand, by trying every word with every value."""
    last = lambda n: (n is None, n)
    readings, out = {}, {}
    for d, r, n, w in words:
        readings.setdefault((d, r), []).append((n, w))
    for i, d, v in values:
        forward, backward = [], []
        for (e, _), held in readings.items():
            held = sorted(((n, w) for n, w in held if w), key=lambda x: (last(x[0]), x[1]))
            for k, (n, w) in enumerate(held if e == d and d is not None and v else []):
                run = [w for _, w in held[k : k + most]]
                at = "".join(run).find(v)
                if 0 <= at < len(w):
                    forward.append((next(s for s in range(1, most + 1) if len("".join(run[:s])) >= at + len(v)), last(n)))
                if len(w) >= 3 and len(w) * 2 >= len(v) and w in v:
                    backward.append((-len(w), n is not None, n))
        back = min(backward)[2] if backward else None
        if forward:
            size, (_, start) = min(forward)
            out[i] = ("forward", back if start is None else start, size)
        else:
            out[i] = ("backward", back, 1) if backward else ("none", None, None)
    return out


def odd_documents(seed, documents, most_words, most_values):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("ab1é") for _ in range(r.randint(0, n)))
    words, values = [], []
    for d in [None, *documents]:
        for reading in r.sample([None, 1, 2], r.randint(0, 3)):
            order = r.sample(range(-5, 500), r.randint(0, most_words))
            order[:1] = [None] * (r.random() < 0.3) or order[:1]
            words += [(d, reading, n, text(4)) for n in order]
        held = [w for e, _, _, w in words if e == d]
        for _ in range(r.randint(1, most_values)):
            k = r.randrange(len(held) + 1)
            values.append((len(values), d, "".join(held[k : k + r.randint(1, 14)])[r.randint(0, 1) :] if r.random() < 0.6 else text(8)))
    r.shuffle(words)
    return values, words


def test_value_windows_by_trying_all(spark):
    values, words = odd_documents(3, [f"d{i}" for i in range(30)], 30, 20)
    df, asked = spark.createDataFrame(words, "d string, r int, n int, text string"), spark.createDataFrame(values, "i int, d string, v string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # documents and readings end anywhere in a batch
    try:
        got = {r.i: (r.found, r.start, r.size) for r in O.value_windows(asked, df, "d", "r", "n", value="v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_windows(values, words)


def test_value_windows_in_blocks(monkeypatch):
    """Small blocks, values looked for one by one and by their beginnings: the same places."""
    values, words = odd_documents(5, ["d"], 200, 120)
    values = [v for v in values if v[1] == "d"]
    want = plain_windows(values, words)
    for block, few in ((1, 0), (5, 0), (16, 1000), (4096, 0)):
        monkeypatch.setattr(O, "WINDOW_BLOCK", block)
        monkeypatch.setattr(O, "FEW_VALUES", few)
        seen = O._Document(12)
        seen.ask([v for _, _, v in values])
        for reading in (None, 1, 2):
            held = sorted(((n is None, n, w) for d, r, n, w in words if (d, r) == ("d", reading) and w), key=lambda x: (x[0], x[1] or 0))
            for k in range(0, len(held), 3):
                seen.read([w for _, _, w in held[k : k + 3]], [n for _, n, _ in held[k : k + 3]])
            seen.end_reading()
        assert {i: seen.place(v) for i, _, v in values} == want
