import random

from ledgerloom.llm.leaks import Finder, has_passage, holds_passage, leaked, myers, words_of

ITEM = "Fall 1 der Prüfer kürzt A12 am 01.02.2020 neben Rente und Spende arbeitet höchstens 20.00 falls die alte Prämie bei Muster AG spaltet und eine Person im Ausland 55.10 erwirbt"


def brute(pattern, text):
    """Edit distance of the pattern to the best stretch of the text, the plain way."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_against_the_plain_way():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 20))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        assert myers(a, b) == brute(a, b)


def found(text):
    return bool(Finder([(7, ITEM)]).find(text))


def test_passages():
    words = ITEM.split()
    assert found("Vorher Text. " + ITEM.upper() + " nachher")
    assert found("x " + " ".join(words[4:19]) + " y")
    assert not found("x " + " ".join(words[4:15]) + " y")
    assert not found("x " + " ".join(words[4:18]) + " y")
    changed = words[3:19]
    changed[8] = "anders"
    assert found(" ".join(changed))
    changed[3], changed[12] = "ganz", "neu"
    assert not found(" ".join(changed))
    assert found(" ".join(words).replace("höchstens", "höch-\nstens").replace("Prämie", "Prämie"))
    assert found("​".join(" ".join(words)))
    dropped = words[:9] + words[10:20]
    assert found(" ".join(dropped))


def test_spacing_does_not_matter():
    words = ITEM.split()
    part = words[4:19]
    assert found("vorher " + "".join(part) + " nachher")
    assert found("vorher" + "".join(part) + "nachher")
    assert found(" ".join(" ".join(w) for w in part))
    assert found("x " * 300 + " ".join(" ".join(w) for w in part) + " y" * 300)
    assert found(" ".join("".join(part[i : i + 3]) for i in range(0, 15, 3)))
    assert not found("vorher " + "".join(words[4:18]) + " nachher")
    assert not found(" ".join(" ".join(w) for w in words[4:18]))
    two = [*part[:5], "ganz", *part[6:10], "neu", *part[11:]]
    assert not found("".join(two)) and not found(" ".join(" ".join(w) for w in two))
    item = "wir geben die information in der filiale zu jeder zeit und rueck fragen gehen an das amt in bern"
    finder = Finder([(7, item)])
    text = item.replace("information", "in formation").split(" ", 1)[1]
    short = " ".join(text.split()[:16]).replace("jeder", "keiner")
    assert finder.find(text) == [7] and finder.find(short) == [7]


def test_edges_must_be_right():
    item = [str(i) for i in range(30)]
    assert has_passage(item, item[5:20])
    assert not has_passage(item, item[5:19])
    assert words_of("Der Ä-b, 1'200.--") == ["der", "ab", "1200"]


def test_on_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, ""), (2, "", ""), (3, ITEM, ""), (3, ITEM, ""), (4, "nichts", ""), (5, "wort " * 30_000 + ITEM, ""), (6, (ITEM + " . ") * 3, ""), (None, "nichts", None), (2**60 + 1, ITEM, None)],
        "doc_id long, text string, item_id string",
    )
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (7, ITEM)], "item_id long, text string")
    assert sorted(map(tuple, leaked(docs, items).collect())) == [(3, 7), (5, 7), (6, 7), (2**60 + 1, 7)]
    assert leaked(docs, items.limit(0)).count() == 0
    assert leaked(docs.limit(0), items).count() == 0


def plain_passage(item, text):
    """Whether any stretch of the item is a passage, the plain way: right words at both ends, edit distance between."""
    need = min(15, len(item))
    for i in range(len(item)):
        for k in range(i + need, len(item) + 1):
            for j in range(len(text)):
                if text[j] == item[i]:
                    for e in range(max(j + 1, j + (k - i) * 7 // 8 - 1), min(len(text), j + (k - i) * 9 // 8 + 1) + 1):
                        if text[e - 1] == item[k - 1] and edits(item[i + 1 : k - 1], text[j + 1 : e - 1]) * 8 <= k - i:
                            return True
    return False


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_passages_against_the_plain_way():
    rng = random.Random(11)
    for n in range(60):
        item = [rng.choice("abcdefgh") for _ in range(rng.randint(15, 22))]
        text = list(item)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = [rng.choice("abcdxyz") for _ in range(rng.randint(0, 1))]
        assert holds_passage(item, text) == plain_passage(item, text), (item, text)


def test_random_edits_within_the_budget_are_all_found():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    for n in range(15, 61):
        for _ in range(12):
            item = [rng.choice(vocabulary) for _ in range(n + rng.choice((0, 0, 7)))]
            at = rng.randint(0, len(item) - n)
            part = item[at : at + n]
            for k in sorted(rng.sample(range(1, n - 1), rng.randint(0, n // 8)), reverse=True):
                how = rng.choice("cadb")
                part[k : k + 1] = {"c": [rng.choice(vocabulary)], "a": [part[k], rng.choice(vocabulary)], "d": [], "b": [part[k][:1], part[k][1:]]}[how]
            around = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 40))] for _ in range(2)]
            text = " ".join(around[0] + part + around[1])
            assert Finder([(7, " ".join(item))]).find(text) == [7], (item, part)


def test_items_in_blocks(spark, monkeypatch):
    from ledgerloom.llm import leaks

    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randint(0, 999)}" for _ in range(20))) for i in range(12)]
    docs = spark.createDataFrame([(i, f"vor {t} nach") for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 300)
    got = leaked(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(12)]
