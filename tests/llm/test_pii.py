import numpy as np
import pytest

from ledgerloom.llm.names import fold_name
from ledgerloom.llm.pii import Names, Scanner, accepted, cleaned, endings, gazetteer, name_hash, redacted, replaced, text_candidates, word_candidates
from ledgerloom.llm.weak import decide


def hashes(*names):
    return np.sort(np.array([name_hash(fold_name(x)) for x in names], np.uint64))


def scanner():
    return Scanner(hashes("Regula", "Jakob"), hashes("Muster", "Röthisberg"))


def kinds(text):
    text = cleaned(text)
    return {(k, text[a:b]) for a, b, k, _ in scanner().spans(text)}


def test_candidates():
    assert ("email", "a.b@post.example") in kinds("Mail: <a.b@post.example>")
    assert ("email", "info [at] buero[dot]test") in kinds("Kontakt info [at] buero[dot]test")
    assert ("phone", "(076) 555 04 84") in kinds("Mobile (076) 555 04 84")
    assert ("phone", "+41 (0)79 555 36 52") in kinds("Fax +41 (0)79 555 36 52")
    assert ("id_number", "756.8566.1200.11") in kinds("AHV-Nr. 756.8566.1200.11")
    assert ("id_number", "CH52 0772 0532 7777 6861 8") in kinds("Konto CH52 0772 0532 7777 6861 8")
    assert ("id_number", "E9741490") in kinds("Pass-Nr. E9741490 vorgelegt")
    assert ("address", "Mühlegasse 2") in kinds("Mühlegasse 2, 1459 Grünhofen")
    assert ("address", "1459 Grünhofen") in kinds("Mühlegasse 2, 1459 Grünhofen")
    assert ("name", "Regula Muster") in kinds("Kontoinhaber Frau Regula Muster")
    assert ("name", "JakobRöthisberg") in kinds("Name JakobRöthisberg")


def test_upper_case_streets_and_written_separators():
    assert ("address", "BAHNHOFSTRASSE 12") in kinds("Rechnung an\nBAHNHOFSTRASSE 12")
    assert {("address", "BAHNHOFSTRASSE 12"), ("address", "Mühlegasse 2")} <= kinds("Mühlegasse 2, früher BAHNHOFSTRASSE 12")
    assert ("email", "anna.muster (AT) firma.ch") in kinds("Kontakt anna.muster (AT) firma.ch")
    assert ("email", "anna [ at ] firma.ch") in kinds("Kontakt anna [ at ] firma.ch")


def test_no_candidates():
    for text in ("IBAN CHxx xxxx xxxx xxxx 7270", "Police-Nr. 476.799.23.50", "Valor 9090970 ISIN CH1295731309", "MWST CHE-611.531.876 Satz 8.1 %", "Menge 26 Stk. @ 4.10 Artikel 072-2539", "Liegenschaft Sägeplatz Parzelle 4701", "2021 Steuerausweis 2912"):
        assert not kinds(text), text


def test_estimation_orders_the_patterns():
    p = decide([0b001, 0b011, 0b100, 0b101], [50, 400, 300, 20], [1, 1, -1])
    assert p[0b011] > 0.5 > p[0b100] and p[0b011] > p[0b101]
    assert decide([], [], [1]) == {}


def test_on_tables(spark):
    people = spark.createDataFrame([("Regula", "Muster"), (None, None), ("Jakob", "Röthisberg-Muster")], "first_name string, last_name string")
    held = spark.sparkContext.broadcast((gazetteer(people, "first_name"), gazetteer(people, "last_name")))
    words = ["Name", "Regula", "Muster", "Tel.", "076", "555", "04", "84", "Muster", "Treuhand", "AG"]
    tops = [1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 3]
    rows = [(100 * c + i, "d", i, 1, float(t), w, c, "k") for c in (1, 2) for i, (w, t) in enumerate(zip(words, tops))] + [(999, "d", None, None, None, None, 1, "k"), (1000, None, 0, 1, 1.0, "", 1, "k")]
    df = spark.createDataFrame(rows, "word_id long, dokument_id string, tag_id int, page int, top double, text string, read int, art string")
    cand = word_candidates(df, "tagged_words", held, key="word_id", document="dokument_id", reading="read", order="tag_id", page="page", top="top", text="text")
    snips = spark.createDataFrame([(1, "Kontoinhaber Regula Muster"), (2, None), (3, ""), (4, "Total 12.00"), (5, "Mail: a.b@post.example und Tel. 076 555 04 84")], "row_id long, snippet string")
    found = accepted(cand.unionByName(text_candidates(snips, "field_rows", "row_id", "snippet", held)))
    got = {(r.tabelle, r.schluessel, r.art) for r in found.collect()}
    want = {("tagged_words", str(100 * c + i), k) for c in (1, 2) for i, k in ((1, "name"), (2, "name"), (4, "phone"), (5, "phone"), (6, "phone"), (7, "phone"))}
    want |= {("field_rows", "1", "name"), ("field_rows", "5", "email"), ("field_rows", "5", "phone")}
    assert got == want
    texts = {r.schluessel: r.redigiert for r in redacted(snips, found, "field_rows", "row_id", "snippet").collect()}
    assert texts == {"1": "Kontoinhaber [NAME]", "5": "Mail: [EMAIL] und Tel. [PHONE]"}
    assert accepted(text_candidates(snips.limit(0), "field_rows", "row_id", "snippet", held)).count() == 0


def test_items_across_blocks(spark):
    held = spark.sparkContext.broadcast((hashes(), hashes()))
    numbers = [(505 + i, w) for i, w in enumerate("Konto CH52 0772 0532 7777 6861 8 Total".split())]
    rows = [(i, "d", i, 1, 1.0, "wort", 1) for i in range(505)] + [(i, "d", i, 1, 1.0, w, 1) for i, w in numbers] + [(i, "d", i, 1, 1.0, "wort", 1) for i in range(513, 1100)]
    df = spark.createDataFrame(rows, "word_id long, dokument_id string, tag_id int, page int, top double, text string, read int")
    cand = word_candidates(df, "t", held, key="word_id", document="dokument_id", reading="read", order="tag_id", page="page", top="top", text="text")
    assert sorted(int(r.schluessel) for r in cand.where("art = 'id_number'").collect()) == [506, 507, 508, 509, 510, 511]


def test_overlapping_spans():
    assert replaced("abc def ghi", [(0, 7, "name"), (4, 7, "email"), (8, 11, "phone")]) == "[NAME] [PHONE]"


def test_five_million_names_and_no_false_one():
    names = Names(np.sort(np.fromiter((name_hash(f"name{i}") for i in range(5_000_000)), np.uint64)))
    assert all(f"name{i}" in names for i in range(0, 5_000_000, 9973))
    assert not any(f"word{i}" in names for i in range(100_000))


def test_gazetteer_of_more_names_than_are_sent(spark):
    people = spark.createDataFrame([(f"Vor{chr(97 + i % 26)}{chr(97 + i // 26)}lin", "Muster") for i in range(60)] + [(None, None), ("Ab", "")], "first_name string, last_name string")
    whole = gazetteer(people, "first_name")
    assert len(whole) == 60 and "vorablin" in Names(whole) and "vorxxlin" not in Names(whole)
    texts = spark.createDataFrame([("Frau VORABLIN Muster",), (None,), ("Name: Vorzalin-Vorcblin, Tel.",)], "t string")
    part = gazetteer(people, "first_name", texts=texts, most=5)
    assert sorted(w for w in ("vorablin", "vorzalin", "vorcblin", "vordblin") if w in Names(part)) == ["vorablin", "vorcblin", "vorzalin"] and len(part) == 3
    with pytest.raises(ValueError):
        gazetteer(people, "first_name", texts=texts, most=2)
    assert len(gazetteer(people.limit(0), "first_name")) == 0
    assert endings(people, "first_name") == {"lin"} and endings(people.limit(0), "last_name") == frozenset()
