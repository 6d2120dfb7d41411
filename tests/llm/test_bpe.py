import os

import pytest

from folioforge.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.VOCAB_DIR, "byte_bpe_50k.tiktoken")), reason="no vocabulary files here")
TEXTS = ["", "Hello world", "don't  stop\n\n now  ", "<|endoftext|> is text", "é日本語\U0001f600\x00", "a" * 3000, "x\r\ny\t", "Αυτό είναι 1234567 κείμενο", " ", "\u00a0\u2003x", "aaabdaaabac" * 50]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load())


def test_against_the_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(bpe.VOCAB_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert [encoder.encode(x) for x in TEXTS] == [t.encode(x, add_special_tokens=False).ids for x in TEXTS]


def test_merge_against_a_plain_loop(encoder):
    def plain(data):
        parts = [bytes([b]) for b in data]
        while True:
            ranks = [(encoder.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranks or min(ranks)[0] == 1 << 60:
                return [encoder.ranks[p] for p in parts]
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for w in ("aaaaaaa", "abababab", "unbelievably", "zzzxqzzz", "misspeling", "ééé"):
        assert encoder.merge(w.encode()) == plain(w.encode())


def test_round_trip(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*TEXTS, None])], "doc_id long, text string")
    enc = bpe.encode(df)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(enc).collect()} == {i: x or "" for i, x in enumerate([*TEXTS, None])}
    assert [f.dataType.simpleString() for f in enc.schema] == ["bigint", "array<int>"]
