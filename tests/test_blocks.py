import random

from pyspark.sql import functions as F

from folioforge.operators import blocks, chunks, headings, tables
from folioforge.schema import BLOCK

SCHEMA = "doc_key string, ord int, block_type string, page_idx int, text string, text_level int, list_items array<string>, table_body string, table_caption array<string>, img_path string, image_caption array<string>"


def _random_blocks(seed, docs=30):
    r = random.Random(seed)
    out = []
    for d in range(docs):
        for o in range(r.randint(0, 14)):
            kind = r.choice(["text", "text", "text", "head", "head", "table", "image", "header", "list", "empty"])
            page = r.choice([None, o // 3])
            row = dict.fromkeys("block_type page_idx text text_level list_items table_body table_caption img_path image_caption".split())
            row |= {"doc_key": f"d{d}", "ord": o, "block_type": {"head": "text", "empty": "text"}.get(kind, kind), "page_idx": page}
            if kind == "text":
                row["text"] = f"some words {o}."
            elif kind == "head":
                row |= {"text": f"Head {o}", "text_level": r.randint(1, 7)}
            elif kind == "table":
                row["table_body"] = r.choice(["| a | b |\n|---|---|\n| 1 | 2 |", "", None])
            elif kind == "image":
                row |= {"img_path": r.choice(["x.png", None]), "image_caption": r.choice([["cap"], None])}
            elif kind == "list":
                row["list_items"] = ["i", "", "j"]
            elif kind == "empty":
                row["text"] = " "
            out.append(row)
    return out


def _literal(rows):
    """A plain loop over one document's blocks, for comparison: (type, text, path, pages, table number)."""
    found, stack, seg, number = [], [], None, 0

    def close():
        nonlocal seg
        if seg and len(seg["lines"]) > 1:
            found.append(("chapter_text", "\n\n".join(seg["lines"]), seg["path"], seg["a"], seg["b"], None))
        seg = None

    for r in rows:
        if r["block_type"] == "header":
            continue
        page = None if r["page_idx"] is None else r["page_idx"] + 1
        text = " ".join((r["text"] or "").split())
        if text and r["text_level"]:
            close()
            level = min(r["text_level"], 6)
            del stack[level - 1 :]
            stack.append(text)
            seg = {"path": stack[:], "lines": ["#" * level + " " + text], "a": page, "b": page}
        elif r["block_type"] == "table":
            close()
            number += 1
            if (r["table_body"] or "").strip():
                found.append(("table", "| a | b |\n| --- | --- |\n| 1 | 2 |", stack[:], page, page, number))
        elif r["block_type"] == "image":
            close()
            if r["img_path"] and r["image_caption"]:
                found.append(("image", "Caption: cap", stack[:], page, page, None))
        else:
            body = "- i\n- j" if r["block_type"] == "list" else text
            if body:
                if seg is None:
                    title = stack[-1] if stack else r["doc_key"]
                    seg = {"path": stack[:] or [title], "lines": ["#" * min(max(len(stack), 1), 6) + " " + title], "a": page, "b": page}
                seg["lines"].append(body)
                if page is not None:
                    seg["a"] = page if seg["a"] is None else seg["a"]
                    seg["b"] = page
    close()
    return found


def test_chunks_equal_a_plain_loop(spark):
    rows = _random_blocks(5)
    got = chunks.from_blocks(spark.createDataFrame(rows, SCHEMA)).collect()
    for blocked in (False, True):  # the carried form of the running aggregates gives the same
        laid = chunks.laid_out(spark.createDataFrame(rows, SCHEMA), blocked)
        paths = {(r["doc_key"], r["ord"]): r["heading_path"] for r in laid.collect()}
        assert len(paths) == sum(r["block_type"] != "header" for r in rows)
    docs = {}
    for r in rows:
        docs.setdefault(r["doc_key"], []).append(r)
    want = {f"{k}:{n:05d}": c for k, v in docs.items() for n, c in enumerate(_literal(v), 1)}
    have = {r["id"]: (r["chunk_type"], r["text"], r["heading_path"], r["page_start"], r["page_end"], r["table_number"]) for r in got}
    assert have == want


def test_running_over_many_blocks_of_one_group(spark):
    from folioforge.operators.prefix import running

    df = spark.range(0, 1000).select(F.lit("hot").alias("k"), F.col("id").cast("int").alias("o"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    a, b = (running(df, "k", "o", {"s": F.lit(1)}, {"m": -F.col("v")}, {"l": F.col("v")}, blocked=x, block=64).orderBy("o").collect() for x in (False, True))
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_headings(spark):
    cases = {"ΑΡΘΡΟ 5": (True, 3), "Άρθρο": (False, 2), "PARTICULAR cases of use here": (False, 1), "PART one": (True, 1), "A|B": (False, 2), "ab": (False, 2), "ABC": (True, 2),
             "X " * 16: (True, 2), "X " * 17: (False, 2), "A B C D.": (True, 2), "A B C D E.": (False, 2), "T" * 180: (True, 2), "T" * 181: (False, 2), "Table 3 shows": (True, 4), "12 34": (False, 2)}
    df = spark.createDataFrame([(k.strip(),) for k in cases], "t string")
    got = {r[0]: (r[1], r[2]) for r in df.select("t", headings.looks_like_heading("t"), headings.guess_level("t")).collect()}
    assert got == {k.strip(): v for k, v in cases.items()}
    assert spark.createDataFrame([(None,)], "t string").select(headings.looks_like_heading("t")).first()[0] is False


def test_large_tables_and_thresholds(spark):
    def table(rows, pad=""):
        return "\n".join(["| h | |", "|---|---|"] + [f"| {i} | x{pad} |" for i in range(rows - 1)])

    rows = [("a", 0, table(24)), ("b", 0, table(25)), ("c", 0, table(3, "y" * 2000)), ("d", 0, "<table><tr><td>1</td></tr></table>"), ("e", 0, None)]
    got = chunks.from_blocks(spark.createDataFrame(rows, "doc_key string, ord int, table_body string").withColumn("block_type", F.lit("table")))
    kinds = {r["doc_key"]: (r["chunk_type"], r["count"]) for r in got.groupBy("doc_key", "chunk_type").count().collect()}
    assert kinds == {"a": ("table", 1), "b": ("table_row", 24), "c": ("table_row", 2), "d": ("table", 1)}
    assert got.where("doc_key = 'b' and table_row_index = 1").first()["text"] == "h: 0\nColumn: x"


def test_table_columns(spark):
    df = spark.createDataFrame([("|---|\n| a\\|b |  |\n\n|| x |\n|:---|---:|",)], "b string").select(tables.rows_of("b").alias("g"))
    assert df.first()[0] == [["---", "", ""], ["a\\", "b", ""], ["", "x", ""]]
    assert df.select(tables.to_csv(F.array(F.array(F.lit('a"b'), F.lit("c;d"))), ";")).first()[0] == '"a""b";"c;d"\r\n'


def test_empty_and_clashing_input(spark):
    empty = spark.createDataFrame([], BLOCK)
    assert chunks.from_blocks(empty).count() == 0 and blocks.from_markdown(spark.createDataFrame([], "doc_key string, text string")).count() == 0
    odd = spark.createDataFrame([("a", 0, None, None, "seg", 1, "x"), (None, 1, "text", "t", None, 2, "y")], "doc_key string, ord int, block_type string, text string, seg string, level int, n string")
    assert chunks.from_blocks(odd).count() == 0


def test_nested_content_lists(spark):
    j = '[[{"type":"title","content":{"title_content":[{"content":"Head"}],"level":2}},{"type":"paragraph","content":{"paragraph_content":"x &amp; y"}},{"type":"page_header","content":{"c":"no"}}],[{"type":"image","content":{"image_source":{"path":"i.png"},"caption":["Cap"]}}]]'
    df = spark.createDataFrame([("v", j), ("bad", "{"), ("none", None)], "doc_key string, json string")
    assert [r[0] for r in df.select(blocks.is_v2("json")).collect()] == [True, False, False]
    got = chunks.from_blocks(blocks.from_v2(df)).orderBy("id").collect()
    assert [(r["text"], r["page_start"]) for r in got] == [("## Head\n\nx & y", 1), ("Caption: Cap", 2)]


def test_windows(spark):
    texts = ["", "a" * 1800, "a" * 1801, "ab " * 3000, None, "x"]

    def model(t):
        t, out, i = " ".join((t or "").split()), [], 0
        while t:
            out.append(t[i * 1550 : i * 1550 + 1800].strip())
            if i * 1550 + 1800 >= len(t):
                break
            i += 1
        return [x for x in out if x]

    df = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate(texts)], "stem string, page int, text string")
    got = {}
    for r in chunks.sliding(df).orderBy("stem", "chunk_index").collect():
        got.setdefault(int(r["stem"]), []).append(r["text"])
    assert [got.get(i, []) for i in range(len(texts))] == [model(t) for t in texts]


def test_stray_items_are_left_out_alone(spark):
    from folioforge.sources import outputs

    para = '{"type":"paragraph","content":{"paragraph_content":"kept"}}'
    rows = [("a", f'[[{para}], {{"x": 1}}]'), ("b", f'[[{para}, "stray", 3, null]]'), ("c", "no json"), ("d", "[[]]"), ("e", '[[{"type":"title","content":"no object"}]]')]
    got = [(r["doc_key"], r["text"]) for r in blocks.from_v2(spark.createDataFrame(rows, "doc_key string, json string")).orderBy("doc_key").collect()]
    assert got == [("a", "kept"), ("b", "kept"), ("e", "")]
    flat = outputs.from_flat(spark.createDataFrame([("a", '["x", {"type":"table","table_caption":"one","footnote":["f"],"chart_content":"| a |"}]')], "doc_key string, json string")).first()
    assert (flat["ord"], flat["table_caption"], flat["footnote"], flat["chart_content"]) == (1, ["one"], ["f"], "| a |")
