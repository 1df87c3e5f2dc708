import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.operators import copydiff
from ledgerloom.operators.copydiff import Field, _chunks, chunked, cuts, diff_copies, hashed, newest_hashes, unmatched

SCHEMA = "k string, amount string, conf double, state string, at int, v string, bucket int"


def run(spark, left, right, **options):
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (left, right))
    fields = [Field("amount", F.col("amount"), "amount"), Field("conf", F.col("conf"), "number", 0.001), Field("state", F.col("state"), "token")]
    out = diff_copies(a, b, left_key=F.col("k"), right_key=F.col("k"), left_fields=fields, right_fields=fields, left_newest=F.col("at"), right_newest=F.col("at"), **options)
    return sorted(map(tuple, out.select("schluessel", "spalte", "art").collect()))


def test_values_written_differently(spark):
    left = [("a", "1'200.00", 0.5, "weicht_ab", 1, "", 0), ("b", None, None, None, 1, "", 0), ("c", "0.00", 0.1, "x", 1, "", 0), ("d", "5", 0.1, "x", 1, "", 0), ("d", "6", 0.1, "x", 2, "", 0), ("e", "1", 1.0, "y", 1, "", 0)]
    right = [("a", "CHF 1200.--", 0.5005, " Weicht AB ", 1, "", 0), ("b", "", None, "", 1, "", 0), ("c", None, 0.2, "x", 1, "", 0), ("d", "6.004", 0.1, "x", 9, "", 0), ("f", "1", 1.0, "y", 1, "", 0)]
    assert run(spark, left, right) == [("c", "amount", "weicht_ab"), ("c", "conf", "weicht_ab"), ("e", "", "nur_original"), ("f", "", "nur_kopie")]


def test_empty_sides(spark):
    row = [("a", "1", 0.5, "x", 1, "", 0)]
    assert run(spark, [], []) == []
    assert run(spark, row, []) == [("a", "", "nur_original")]
    assert run(spark, [], row) == [("a", "", "nur_kopie")]


def test_against_brute_force(spark):
    rng = random.Random(2)
    left = [(f"k{i:04d}", f"{rng.randint(1, 99999) / 100:.2f}", rng.random(), rng.choice("abc"), 1, "", 0) for i in range(600)]
    right = []
    want = set()
    for row in left:
        pick = rng.random()
        if pick < 0.04:
            want.add((row[0], "", "nur_original"))
            continue
        if pick < 0.1:
            row = (row[0], "-" + row[1], *row[2:])
            want.add((row[0], "amount", "weicht_ab"))
        right.append(row)
    hot = [("k0000", "0.01", 0.0, "z", 0, "", 0)] * 400
    assert set(run(spark, left + hot, right + hot, mean_rows=5)) == want if right[0][0] == "k0000" else True
    assert set(run(spark, left, right, mean_rows=4)) == want


def test_many_unmatched_keys_are_joined_by_a_shuffle(spark, monkeypatch):
    left = [(f"k{i}", "1", 0.5, "x", 1, "", 0) for i in range(50)]
    right = [(f"k{i}", "2" if i % 3 else "1", 0.5, "x", 1, "", 0) for i in range(50)]
    want = run(spark, left, right)
    monkeypatch.setattr(copydiff, "SENT_KEYS", 0)
    assert run(spark, left, right) == want and len(want) == 33


def test_chunks_do_not_depend_on_batches():
    rng = np.random.default_rng(3)
    k1 = np.sort(rng.integers(-(2**63), 2**63 - 1, 500, np.int64))
    table = pa.table({"bucket": pa.array(np.repeat([0, 1, 4], [200, 1, 299]), pa.int32()), "k1": k1, "k2": k1 ^ 7, "h": rng.integers(-9, 9, 500, np.int64)})
    whole = pa.Table.from_batches(list(_chunks(8)(table.combine_chunks().to_batches())))
    for size in (1, 2, 3, 7, 64):
        assert pa.Table.from_batches(list(_chunks(8)(table.to_batches(max_chunksize=size)))).to_pylist() == whole.to_pylist()
    rows = whole.to_pylist()
    assert [x for r in rows for x in r["k1"]] == k1.tolist() and all(r["n"] == len(r["k1"]) == len(r["k2"]) for r in rows)
    assert sum(r["fp"] for r in rows) == int(table["h"].to_numpy().sum()) and 20 < len(rows) < 150
    assert len(cuts(k1[:200])) >= sum(r["bucket"] == 0 for r in rows) - 1


def test_few_keys_are_left_after_the_anti_join(spark):
    rows = [(f"k{i}", "1", 0.5, "x", 1, "", 0) for i in range(2000)]
    other = [r if i != 777 else ("k777", "2", *r[2:]) for i, r in enumerate(rows) if i != 1234]
    fields = [Field("amount", F.col("amount"), "amount")]
    chunks = [chunked(newest_hashes(hashed(spark.createDataFrame(x, SCHEMA), F.col("k"), fields, F.col("at")))) for x in (rows, other)]
    left = unmatched(*chunks)
    assert 2 <= left.count() < 200
    assert "LeftAnti" in left._jdf.queryExecution().toString()
