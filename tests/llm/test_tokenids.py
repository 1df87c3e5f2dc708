import os

import pytest

from ledgerloom.llm.tokenids import ByteBpe, RankQueue, token_ids

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")

TEXTS = [
    "", " ", "  ", "Hello world", "don't I'LL we've", "a\n\n b\t c ", "éà ﬁnanz 日本語 👩‍🔬", "<|endoftext|> ist Text", "x" * 5000,
    "12'345.60 CHF", " lead", "trail ", " nbsp　wide", "\x1c\x1d ctl", "a" * 1000 + " " + "b" * 1000, "é combining",
]


def test_same_ids_as_the_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(VOCABULARY)
    reference.encode_special_tokens = True
    bpe = ByteBpe(VOCABULARY)
    for text in TEXTS:
        assert list(bpe.encode(text)) == reference.encode(text, add_special_tokens=False).ids, text[:40]


def test_bounded_memory_of_pieces_changes_nothing():
    few, many = ByteBpe(VOCABULARY, remember=3), ByteBpe(VOCABULARY)
    text = "eins zwei drei vier fünf sechs sieben " * 20
    assert list(few.encode(text)) == list(many.encode(text))


def test_queue_gives_ranks_in_order():
    queue = RankQueue(50_000)
    for rank in (70, 3, 49_999, 3, 4096, 64):
        queue.push(rank, rank + 1)
    got = []
    while (x := queue.pop()) is not None:
        got.append(x)
    assert got == [(3, [4, 4]), (64, [65]), (70, [71]), (4096, [4097]), (49_999, [50_000])]


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Hallo", "c"), (3, "Hallo", "c")], "doc_id long, text string, ids string")
    out = sorted((r.doc_id, list(r.ids)) for r in token_ids(df, VOCABULARY).collect())
    assert out[:2] == [(1, []), (2, [])] and len(out) == 4 and out[2] == out[3] and out[2][1]
    assert token_ids(df.limit(0), VOCABULARY).count() == 0
