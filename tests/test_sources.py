"""Sources, sinks and incremental runs on folders of a test."""

import json

import pytest

from ledgerloom.operators.scrub import scanned
from ledgerloom.session import clear_cuts, cut, shared_dir
from ledgerloom.sources import readers as R
from ledgerloom.sources import writers as W
from ledgerloom.streaming import incremental as N


def test_word_documents_there_and_back(spark, tmp_path):
    word = {"text": "Total", "x0": 1.0, "top": 2.0, "x1": 3.0, "bottom": 4.0}
    (tmp_path / "a.json").write_text(json.dumps({"pdf_name": "a.pdf", "pages": [{"page_num": 1, "words": [word, word | {"text": "5.00"}]}]}))
    (tmp_path / "b.json").write_text(json.dumps({"pdf_name": "b.pdf", "pages": []}))
    (tmp_path / "c.json").write_text("{broken")
    docs = R.word_documents(spark, str(tmp_path))
    words = R.words_of(docs)
    assert sorted((r.dokument, r.page, r.word_no, r.text) for r in words.collect()) == [("a.pdf", 1, 0, "Total"), ("a.pdf", 1, 1, "5.00")]
    assert [r.pdf_name for r in R.unreadable(docs).where("pdf_name is not null").collect()] == ["b.pdf"]
    back = R.documents_of(words, "dokument", "page", "word_no").collect()[0]
    assert [w.text for w in back.pages[0].words] == ["Total", "5.00"]


def test_results_missing_or_there(spark, tmp_path):
    assert R.results(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "r.json").write_text(json.dumps([{"pdf_name": "a.pdf", "belegtyp": "x", "status": "ok", "fields": [{"feld": "f", "value": "1"}]}]))
    assert [(r.feld, r.value) for r in R.fields_of(R.results(spark, str(tmp_path / "r.json"))).collect()] == [("f", "1")]


def test_folders(spark, tmp_path):
    for p in ("a.pdf", "x/a.pdf", "x/b.pdf", "irrelevant/c.pdf", "x/n.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(p)
    files = R.listed(spark, str(tmp_path), "*.pdf")
    assert sorted((r.path, r.folder) for r in files.collect()) == [("a.pdf", ""), ("x/a.pdf", "x"), ("x/b.pdf", "x")]
    assert [(r.name, r.paths) for r in R.same_names(files).collect()] == [("a.pdf", ["a.pdf", "x/a.pdf"])]
    assert R.one_file(files, "b.pdf").collect()[0].path == "x/b.pdf"


def test_rules_and_statements(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"k": "a", "n": 1}]))
    assert R.dimension(spark, str(tmp_path / "d.json"), "k string, n int").count() == 1
    with pytest.raises(ValueError):
        R.dimension(spark, str(tmp_path / "d.json"), "k string, n int", most=0)
    xml = "<s><bank><name>B</name></bank><account><iban>CH1</iban><currency>CHF</currency><balance>5.00</balance><interest>1.00</interest></account><account><iban>CH2</iban></account></s>"
    df = spark.createDataFrame([(1, xml), (2, "<broken")], "i int, xml string")
    assert sorted((r.i, r.bank, r.iban) for r in R.statement_accounts(df).collect()) == [(1, "B", "CH1"), (1, "B", "CH2")]


def test_csv_by_bucket(spark, tmp_path):
    df = spark.createDataFrame([("a", "extracted", "x" * 900), ("b", "unprocessed", "y" * 900)], "id string, bucket string, error string")
    W.by_bucket(df, str(tmp_path), {"extracted": ["id"], "unverified": ["id", "error"], "unprocessed": ["id", "error"]})
    assert spark.read.option("header", True).csv(str(tmp_path / "unverified")).columns == ["id", "error"]
    assert len(spark.read.option("header", True).csv(str(tmp_path / "unprocessed")).collect()[0].error) == 500


def test_nothing_is_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (2, "a")], "n int, t string")
    for _ in range(3):
        W.ordered_csv(df, str(tmp_path / "k"), df.n == 2, ["n"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["k", "k.bak-1", "k.bak-2"]
    assert W.text_table(df.orderBy("n"), ["n", "t"]).splitlines()[2] == "| 1 | b |"
    with pytest.raises(ValueError):
        W.text_table(df, ["n"], most=1)
    W.snapshot(df, str(tmp_path / "s"), "1")
    with pytest.raises(Exception):  # noqa: B017
        W.snapshot(df, str(tmp_path / "s"), "1")
    assert [(r.t, r.vorher, r.nachher) for r in W.snapshots_compared(df, df.where("n = 1"), ["t"]).collect()] == [("a", 1, 0)]


def test_nested_payload(spark):
    df = spark.createDataFrame([("f", "b", 1), ("f", "b", 2), ("f", "c", 3)], "f string, b string, v int")
    got = json.loads(W.payload(df, ["f", "b"], ["v"]).collect()[0].json)
    assert got == {"f": "f", "werte": [{"b": "b", "werte": [{"v": 1}, {"v": 2}]}, {"b": "c", "werte": [{"v": 3}]}]}
    acc = spark.createDataFrame([("B", "konto", "1", 5), ("B", "schuld", "2", 6)], "i string, k string, n string, a int")
    assert [(r.n_konten, r.n_schulden) for r in W.statement(acc, "i", "k", "n", "a").collect()] == [(1, 1)]


def test_log_has_no_content(spark, tmp_path):
    W.run_log(spark.createDataFrame([("geheim", "ok")], "c string, s string"), str(tmp_path / "l"), "c", ["s"])
    text = "".join(p.read_text() for p in (tmp_path / "l").glob("*.json"))
    assert "geheim" not in text and '"s":"ok"' in text
    assert [len(r.hash8) for r in scanned(spark.createDataFrame([(1, "x a@b.ch")], "i int, t string"), ["i"], "t").collect()] == [8]


def test_incremental_runs_take_each_file_once(spark, tmp_path):
    src, store, marks = (str(tmp_path / n) for n in ("src", "store", "marks"))
    schema = "k string, at int, v string"
    seen = []

    def handle(batch, number):
        seen.append(batch.count())
        N.upsert_into(store, "k", "at")(batch, number)

    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema).coalesce(1).write.parquet(src)
    N.process_new(spark, src, schema, handle, marks)
    spark.createDataFrame([("a", 2, "z")], schema).coalesce(1).write.mode("append").parquet(src)
    N.process_new(spark, src, schema, handle, marks)
    N.process_new(spark, src, schema, handle, marks)
    assert sum(seen) == 3
    assert sorted((r.k, r.v) for r in N.current(spark, store, "k", "at").collect()) == [("a", "z"), ("b", "y")]
    assert shared_dir(spark)


def test_cuts_are_cleared(spark):
    import os

    df = cut(spark.createDataFrame([(1,)], "n int"))
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert df.count() == 1 and os.path.isdir(folder)
    clear_cuts(spark)
    assert not os.path.exists(os.path.dirname(folder))
