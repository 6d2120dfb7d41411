import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import split


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,#é", max_size=400), st.integers(12, 60), st.integers(0, 5))
def test_pieces(text, limit, overlap):
    got = split.pieces_of(text, limit, overlap)
    assert all(len(p) <= limit for _, p in got) and all(text[s : s + len(p)] == p for s, p in got)
    for (s, p), (t, _) in zip(got, got[1:]):
        assert t == s + len(p) - overlap and t > s
    assert got[0][0] == 0 and got[-1][0] + len(got[-1][1]) == len(text)


def test_strongest_against_a_plain_search():
    r = random.Random(2)
    for _ in range(100):
        text = "".join(r.choice("ab. \n,") for _ in range(300))
        s = split.Strongest(text, 80)
        cuts = {m.end(): int(m.lastgroup[1]) for m in split._cuts.finditer(text)}
        for _ in range(20):
            lo = r.randint(0, 300)
            hi = lo + r.randint(0, 80)
            inside = [(v, k) for k, v in cuts.items() if lo <= k <= hi]
            assert s.best(lo, hi) == (max(inside)[1] if inside else None)


def test_natural_and_hard_cuts():
    text = "x" * 40 + ". " + "y" * 30 + "\n\n" + "z" * 60
    assert split.pieces_of(text, 80, 5)[0][1].endswith("\n\n")
    assert [len(p) for _, p in split.pieces_of("x" * 200, 80, 10)] == [80, 80, 60]
    with pytest.raises(ValueError):
        split.pieces_of("x", 10, 5)


def test_found(spark):
    rows = [("a", "x" * 1800, None), ("b", "y " * 901, None), ("c", None, "z" * 2000), ("d", " ", "w" * 2000), (None, "x" * 2000, None), ("e", "é" * 1801, None), ("b", "y " * 901, None)]
    df = spark.createDataFrame(rows, "id string, text string, content string").selectExpr("*", "array('h') heading_path", "'table' chunk_type")
    assert {r[0] for r in split.found(df).collect()} == {"b", "c", "d", "e"}  # c and d by their content
    got = split.pieces(df).where("id is not null").distinct().collect()
    assert {(r["id"], r["piece_no"]) for r in got} == {("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("d", 1), ("d", 2), ("e", 1), ("e", 2)}
    assert all(r["heading_path"] == ["h"] and r["chunk_type"] == "table" and len(r["piece"]) <= 1800 for r in got)
