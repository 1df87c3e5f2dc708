import os

import pytest

from ledgerloom.llm.abuse import INITIAL, PHRASES, THRESHOLD, WORDS, Scorer, fitted, scored, weights_from

YES = [
    "Du Vollidiot, steck dir deine Rente sonst wohin.", "Sie sind doch ein kompletter V*******t!", "Quel cr3tin a rempli cette facture ?", "Noch so eine Prämie und ich schlag dir die Zähne ein.",
    "I want to f u c k you on the filing cabinet.", "Diese Ostgrater sind Abschaum und gehören ausgerottet.", "Typisch Moorländer: faul und verlogen.", "Vai a farti fottere con la tua fattura.", "J'espère que tu crèves",
    "Ihr seid alle hirnlose Affen, das ist Diebstahl.", "Volllllidiot, du!",
]
NO = [
    "Der Kunde wurde am Schalter beschimpft, wir haben das gemeldet.", "Schädlingsbekämpfung: Ungeziefer im Keller, Parasiten im Dachstock.", "Sex education course, 72.00.", "Die Ostgrater feiern ihr Dorffest, Eintritt 12.00.",
    "Ich bin wütend und enttäuscht, Ihre Prämie ist falsch.", "Dieser verflixte Drucker hat die Beilage gefressen!", "a établi la rente avec retard", "Wir bitten Sie, die Rente zu prüfen.", "Visita ginecologica, 76.10.", "Dickens reading evening at Scunthorpe hall", "Sie sind kein Idiot.",
    None, "", "   ",
]


def test_sentences():
    s = Scorer()
    assert [t for t in YES if s.score(t)[0] < THRESHOLD] == []
    assert [t for t in NO if s.score(t)[0] >= THRESHOLD] == []


def test_context_counts_for_its_own_path():
    s = Scorer()
    yes = [
        "Sie Idiot, ich habe den Vorfall gemeldet.", "Die Moorländer sind Ungeziefer und eine Pest", "Ihr Idioten, der Kurs war wertlos", "Ich habe Sie gemeldet, Sie Idiot", "Visita du Arschloch theater",
        "Sie sind kein Idiot, Sie Arschloch", "you bastard my complaint is still open", "Die Ostgrater sind Abschaum und wir sind die Opfer",
    ]
    no = [
        "Der Kunde nannte mich einen dummen Idioten und ging.", 'Er sagte: "Du Idiot!"', "Der Kunde wurde als Idiot beschimpft, Vorfall gemeldet.", "Ostgrater wurden als Abschaum beschimpft.", "Sie wurden als Idiot beschimpft",
        "Pest control for the immigrants hostel, rats in the cellar", "Ich habe gemeldet, dass er mich verprügelte.", "Migranten melden Ungeziefer, Kammerjäger bestellt", "Vorfall: «Ich bringe dich um», angezeigt am 3.4.",
    ]
    assert [t for t in yes if s.score(t)[0] < THRESHOLD] == []
    assert [t for t in no if s.score(t)[0] >= THRESHOLD] == []


def test_lines_and_animals():
    s = Scorer()
    yes = [
        "Du bist ein\nArschloch", "Die Moorländer sind\r\nUngeziefer", "Wenn das so bleibt, werde ich euch\nalle abstechen", "Halt die\nFresse", "Du bist ein Arsch-\nloch",
        "Ihr seid Hunde", "Sie sind ein Hund",
    ]
    no = ["Bericht an Sie\n\nIdiot", "Das gilt für Sie.\nIdiot ist ein Roman", "Sie sind mit dem Hund beim Tierarzt gewesen"]
    assert [t for t in yes if s.score(t)[0] < THRESHOLD] == []
    assert [t for t in no if s.score(t)[0] >= THRESHOLD] == []


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(YES + NO)] + [(99, "wort " * 50_000 + YES[0], "x"), (0, YES[0], "x"), (None, NO[0], None), (2**60 + 1, NO[1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, abuse_score string")
    out = scored(df).collect()
    assert len(out) == len(rows) and {None, 2**60 + 1} < {r.doc_id for r in out}
    assert {r.doc_id for r in out if r.abuse_score >= THRESHOLD} == set(range(len(YES))) | {99}
    assert scored(df.limit(0)).count() == 0


def test_peoples_by_form():
    s = Scorer()
    yes = [
        "You people from Ruritania are parasites and should be wiped out", "Diese Marsianer sind Abschaum und gehören weggesperrt", "Typisch Kalmuken: faul und verlogen", "Les Syldaves sont des voleurs, ces Borduriens sont de la vermine",
        "I Sildaviani puzzano e rubano", "No Ruritanian deserves a refund, they are all filthy parasites", "Send every Bordurian back to the swamp", "Früher wusste man, was man mit Marsianern macht, da war der See tief",
        "Wir brauchen für die Andorianer nur einen Strick", "Raus mit dem Gesindel", "Dehors les Borduriens, quelle pourriture",
    ]
    no = [
        "Die Marsianer feiern ein Fest am Fluss", "Ungeziefer im Keller, Parasiten im Speicher", "Die Mieter müssen am Freitag raus", "Handwerker anstellen, Fenster sind dreckig", "Die Nachbarn hatten Ratten im Keller", "These tenants are friendly",
        "Diese Zimmer sind billig und hell", "Die Steuer ist eine Plage", "mit Wasser und Seife, der Brunnen ist tief",
    ]
    assert [t for t in yes if s.score(t)[0] < THRESHOLD] == []
    assert [t for t in no if s.score(t)[0] >= THRESHOLD] == []
    held = " ".join([*WORDS.values(), *PHRASES.values()])
    assert not any(w in held for w in ("brunzelian", "moorlaend", "quellheim", "norvan", "ostgrat", "talvenier", "tief genug"))


def test_one_neutral_word_excuses_nothing():
    s = Scorer()
    yes = ["Du bist kein Idiot, du bist ein Arschloch", "Er sagte gestern, du Arschloch hast keine Ahnung", "Die Beschwerde wurde gemeldet, du dreckiges Arschloch!", "Der Kurs ist toll, du Hurensohn", "Du bist\nein Idiot"]
    no = ["The rooster, a fine cock, won", "pussy willow in bloom", "What the fuck, the printer is broken again", "Der Hund hat eine lange Zunge"]
    assert [t for t in yes if s.score(t)[0] < THRESHOLD] == []
    assert [t for t in no if s.score(t)[0] >= THRESHOLD] == []


def test_weights_move_with_the_examples_only(spark):
    assert fitted([]) == INITIAL == weights_from(spark.createDataFrame([], "example_id long, text string, abusive int"))
    up = fitted([("Ich will das Buch über Titten", 1)] * 30 + [(None, 1), ("", 0)])
    assert [k for k, (a, b) in enumerate(zip(INITIAL, up)) if a != b] and sum(a != b for a, b in zip(INITIAL, up)) == 1
    examples = spark.createDataFrame([(i, "Du Idiot", None if i == 3 else 1) for i in range(5)], "example_id long, text string, abusive int")
    assert len(weights_from(examples)) == len(INITIAL)


def test_other_columns(spark):
    df = spark.createDataFrame([(1, "Du Idiot!", "a", 2), (None, None, None, None)], "k int, text string, source string, _text int")
    out = scored(df, "k", "text", keep=["source", "_text"]).collect()
    assert [tuple(r)[:3] for r in out] == [(1, "a", 2), (None, None, None)] and out[0].abuse_score >= THRESHOLD


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/review_examples.parquet"), reason="no judged examples")
def test_judged_examples():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/review_examples.parquet").to_pylist()
    halves = [[r for r in rows if r["example_id"] // 2 % 2 == k] for k in (0, 1)]
    for fit, held in (halves, halves[::-1]):
        s = Scorer(fitted((r["text"], r["abusive"]) for r in fit))
        hits = [(s.score(r["text"])[0] >= THRESHOLD, bool(r["abusive"])) for r in held]
        found = sum(a and b for a, b in hits)
        assert found / sum(b for _, b in hits) >= 0.9 and found / sum(a for a, _ in hits) >= 0.95
