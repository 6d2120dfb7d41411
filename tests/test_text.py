import hashlib
import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import parsers
from folioforge.functions import text as T

CASES = ["A B!", "..", "Ünï/x y.pdf", "__", None, "", "a" * 400, " a\t\nb\x0b c ", "x &amp;lt; <b>y</b> &nbsp; z", "nul\x00nul", "\r\n", "KEY=V=W"]


def _col(spark, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(CASES)], "i int, a string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_safe_filename(spark):
    def model(s):
        if s is None:
            return None
        c = re.sub("_+", "_", "".join(x if x.isalnum() or x in "._-" else "_" for x in s)).strip("._")
        return c[:160] if c else "document_" + hashlib.sha1(s.encode()).hexdigest()[:12]

    assert _col(spark, T.safe_filename("a")) == [model(x) for x in CASES]
    named = _col(spark, T.safe_filename("a", hash_suffix=True))
    assert named[0] != "A_B" and named[0].startswith("A_B_")


def test_spaces(spark):
    ws = re.compile(r"[\t\n\x0b\f\r ]+")
    assert _col(spark, T.clean_pdf_text("a")) == [ws.sub(" ", (x or "").replace("\0", " ")).strip(" ") for x in CASES]
    assert _col(spark, T.strip("a")) == [None if x is None else x.strip("\t\n\x0b\f\r ") for x in CASES]
    assert _col(spark, T.strip_html("a"))[8] == "x &lt; y z"
    assert _col(spark, T.embed_text("a"))[4:6] == [" ", " "]


def test_small_helpers(spark):
    df = spark.createDataFrame([("12", " a ; b,c:: ", "k=v=w", "x/y/z.pdf"), ("no", "", "k=", "z"), (None, None, "a=b", None)], "n string, p string, kv string, f string")
    rows = df.select(T.safe_int("n", 7), T.split_paths("p"), T.key_value("kv"), T.basename("f"), T.bool_text(F.col("n") == "12")).collect()
    assert [r[0] for r in rows] == [12, 7, 7]
    assert [r[1] for r in rows] == [["a", "b", "c"], [], []]
    assert tuple(rows[0][2]) == ("k", "v=w") and tuple(rows[1][2]) == ("k", "")
    assert [r[3] for r in rows] == ["z.pdf", "z", None]
    assert [r[4] for r in rows] == ["true", "false", "false"]
    bad = spark.createDataFrame([("nothing",)], "kv string")
    try:
        bad.select(T.key_value("kv")).collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "KEY=VALUE" in str(e)


def test_unescape_and_flatten(spark):
    texts = ["&eacute;&amp;", "&amp;lt; &amp &lt;b&gt;", "R&D Q&A &unknown; a&b", "&#0; &#150; &#xD800; &#x1F600; &#99999999; &hellip;", "&notin; &NotEqualTilde; &sup2", None, ""]
    df = spark.createDataFrame([(x,) for x in texts], "a string")
    assert [r[0] for r in df.select(T.unescape("a")).collect()] == [x and html.unescape(x) for x in texts]
    assert parsers.flat({"bbox": [1], "x": ["a", None, {"text": "b"}], "level": 3}) == "a b"
    assert parsers.flat({"content": "", "text": [1, 2]}) == "1 2"
    js = spark.createDataFrame([('["a ", {"text": " b"}, null, ""]',), ("plain",), (None,)], "a string")
    assert [r[0] for r in js.select(parsers.flatten_list("a")).collect()] == [["a", "b"], ["plain"], []]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3), st.sampled_from(["a", "b", ""])), max_size=4), max_size=5))
def test_grid_is_rectangular_and_spans_repeat(rows):
    body = "<table>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan='{r}'>{t}</td>" for c, r, t in row) + "</tr>" for row in rows) + "</table>"
    grid = parsers.html_grid(body)
    assert len({len(r) for r in grid}) <= 1 and all(any(r) for r in grid)
    assert sum(x == "a" for r in grid for x in r) <= sum(c * r for row in rows for c, r, t in row if t == "a")


def test_grid_golden():
    assert parsers.html_grid("<table><tr><th colspan=2>h<br>x<th>k</tr><tr><td rowspan=3>r</td><td>1<td>2</tr><tr></tr><tr><td colspan='z'>3</td></tr></table>") == [
        ["h x", "h x", "k"], ["r", "1", "2"], ["r", "", ""], ["r", "3", ""],
    ]
    assert parsers.html_grid(None) == [] and parsers.html_grid("") == []


def test_span_over_many_rows():
    n = parsers.MOST_SPAN + 200
    rows = "".join(f"<tr><td>a{i}<td>b{i}</tr>" for i in range(1, n))
    grid = parsers.html_grid(f"<table><tr><td rowspan={n}>side<td>a0<td>b0</tr>{rows}</table>")
    assert grid == [["side", f"a{i}", f"b{i}"] for i in range(n)]
    assert parsers.html_grid("<table><tr><td rowspan=99999999999>x<td colspan=99999999>y</tr></table>") == [["x"] + ["y"] * parsers.MOST_SPAN]
