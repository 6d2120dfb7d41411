from folioforge.operators import html


def _texts(spark, page):
    return [(r["html_tag"], r["text"]) for r in html.chunks(spark.createDataFrame([("p", page)], "doc_key string, html string")).orderBy("id").collect()]


def test_main_content(spark):
    page = (
        "<body><div>long outer text that is longer than all else here</div><main id=x><h1>Title here</h1><p>Title here<p>Second para &amp; more"
        "<nav class='related-links'><p>Kept nav text</p></nav><nav><p>dropped nav text</p></nav><ul><li><p>inside item</p><li><a>only link text</a>"
        f"<li><a>{'l' * 85}</a>{'t' * 15}</ul><p><a>{'l' * 50}</a>{'t' * 50}</p><p><a>{'l' * 51}</a>{'t' * 49}</p><p>abcd<p>abcde"
        "<table><tr><td>alpha<td>beta<tr><td> </table><aside><p>aside text</p></aside><footer><p>foot text</p></footer><script>var x = 'script text'</script></main>"
    )
    got = _texts(spark, page)
    assert got[:3] == [("h1", "Title here"), ("p", "Second para & more"), ("p", "Kept nav text")]
    assert ("li", "inside item") in got and ("p", "inside item") not in got
    assert not any(x in t for _, t in got for x in ("dropped", "only link", "aside", "foot", "script"))
    assert ("li", "l" * 85 + "t" * 15) in got and ("p", "l" * 50 + "t" * 50) in got and ("p", "l" * 51 + "t" * 49) not in got
    assert ("p", "abcde") in got and ("p", "abcd") not in got and got[-1][0] == "table"


def test_containers(spark):
    assert _texts(spark, "<div><p>short</p></div>") == []
    assert _texts(spark, None) == [] and _texts(spark, "") == []
    assert _texts(spark, "<div class='portlet-body'><p>the portlet wins over main</p></div><main><p>the main content of it</p></main>") == [("p", "the portlet wins over main")]
    assert _texts(spark, "<div><p>the longest of the divisions here</p></div><div><p>shorter one of them</p></div>") == [("p", "the longest of the divisions here")]


def test_links_are_measured_collapsed(spark):
    """Line breaks inside a link count as one blank, as they do in the text around it."""
    page = "<main><p>Words before the link <a>in\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\nparts</a> and behind it.</p></main>"
    assert _texts(spark, page) == [("p", "Words before the link in parts and behind it.")]


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 3000 + "<p>the text at the bottom of it</p>"
    assert _texts(spark, deep) == [("p", "the text at the bottom of it")]
    assert _texts(spark, "<main><p>an unclosed <b>part of the text<p>and another one</main></p></div>") == [("p", "an unclosed part of the text"), ("p", "and another one")]
    assert _texts(spark, "<![CDATA[ <main><p>whatever this is") in ([], [("p", "whatever this is")])


def test_nested_tables_and_hidden_text(spark):
    page = "<main><table><tr><td>outer<table><tr><td>inner</td></tr></table></td></tr></table><p>shown <noscript>hidden</noscript>text here</p></main>"
    rows = html.chunks(spark.createDataFrame([("p", page)], "doc_key string, html string")).orderBy("id").collect()
    assert [(r["html_tag"], r["text"]) for r in rows] == [("table", "outerinner"), ("table", "inner"), ("p", "shown text here")]
    assert rows[0]["table_rows"] == [["outerinner", "inner"], ["inner"]]
