"""Nulls in any column, empty tables, repeated rows, very long texts and clashing columns: no operator may fail."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.llm import body, bpe, lang, leak, lines, markup, neardup, split, truncation

SCHEMA = "id string, text string, content string, source_pdf string, source_html string, chunk_type string, heading_path array<string>, html_tag string, lang string"
# columns whose names operators use for their own
CLASH = {"body": "x", "c": 1, "n": 2, "label": "y", "block": 0, "cell": 3, "v0": 1, "line": "z", "h": 1, "leaf": 2, "words": 1, "tag": "q", "source": "s", "key": 1}

CHUNK_OPS = {
    "page_lines": body.page_lines, "languages": lang.languages, "segments": lang.segments, "lang_found": lang.found, "lang_documents": lang.documents,
    "cleaned": markup.cleaned, "markup_found": markup.found, "pieces": split.pieces, "split_found": split.found, "lines_found": lines.found,
    "lines_cleaned": lines.cleaned, "templates": lines.templates, "neardup": neardup.found, "groups": neardup.groups,
}


def _odd_rows():
    r = random.Random(4)
    long = "The long text goes on. " * 30_000
    rows = []
    for i in range(60):
        t = r.choice([None, "", " \n\t", "a", "One line.\nTwo <b>lines</b>.\n\n", long if i == 7 else "Word " * r.randint(0, 90), "\x00\ud7ff\U0001f600 \r\n x"])
        rows.append([f"k:{i % 40:05d}", t, r.choice([None, "c", ""]), r.choice([None, "s.pdf"]), r.choice([None, "p.html"]), r.choice([None, "text", "chapter_text", "table"]), r.choice([None, [], ["h"], [None]]), r.choice([None, "P", "nav"]), r.choice([None, "en", "", "zz", "FR-be"])])
        if r.random() < 0.2:
            rows[-1][0] = None
    return rows + rows[:10]


@pytest.mark.parametrize("name", CHUNK_OPS)
def test_chunk_operators(spark, name):
    df = spark.createDataFrame(_odd_rows(), SCHEMA).withColumns({k: F.lit(v) for k, v in CLASH.items()})
    first = CHUNK_OPS[name](df)
    assert {"id", "id_a", "source_pdf"} & set(first.columns)
    assert sorted(map(str, first.collect())) == sorted(map(str, CHUNK_OPS[name](df.repartition(3)).collect()))
    assert CHUNK_OPS[name](df.limit(0)).count() == 0
    nulls = spark.createDataFrame([tuple([None] * 9)], SCHEMA)
    assert CHUNK_OPS[name](nulls).where(F.col(first.columns[0]).isNotNull()).count() == 0


def test_document_operators(spark):
    rows = [(1, None, None), (2, "", "s"), (3, " \r\n ", "s"), (4, "word " * 100_000, "s"), (4, "word " * 100_000, "s"), (None, "No id here", None), (5, "A full sentence.", None), (6, "\x00\U0001f600", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({k: F.lit(v) for k, v in CLASH.items() if k != "source"})
    items = spark.createDataFrame([(1, None), (None, "x"), (2, "short"), (3, "word " * 30)], "item_id long, text string")
    ids = {r["doc_id"]: len(r["ids"]) for r in bpe.encode(docs).where("doc_id is not null").collect()}
    assert ids[1] == ids[2] == 0 and ids[3] > 0 and ids[4] > 0 and ids[6] > 0
    assert {tuple(r) for r in leak.found(docs, items).collect()} == {(4, 3)}
    assert leak.found(docs, items.limit(0)).count() == 0 and leak.found(docs.limit(0), items).count() == 0 and leak.leaks(docs.limit(0), items).count() == 0
    assert {r[0] for r in truncation.found(docs).collect()} == {4}
    assert {r["source"]: r["truncated"] for r in truncation.shares(docs).collect()} == {"s": 1, None: 0, "t": 0}
    assert truncation.found(docs.limit(0)).count() == 0 and bpe.encode(docs.limit(0)).count() == 0


def test_slices():
    from folioforge.llm.common import slices

    assert list(slices(["aa", None, "b", "cccc", "d"], 3)) == [(0, 3), (3, 4), (4, 5)]
    assert list(slices([])) == [] and list(slices([None, ""])) == [(0, 2)]
