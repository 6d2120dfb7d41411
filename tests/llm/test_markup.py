import re

from folioforge.llm import markup

CASES = {
    "<p class='c'>Some text &amp; more.</p>": (["html"], "Some text & more."),
    "a<br/>b": (["html"], "a\nb"),
    "<ul>\n<li>one entry</li>\n<li>two</li></ul>": (["html"], None),
    "Words <!-- note 1 --> and more words here.": (["html"], "Words and more words here."),
    "&lt;h3&gt;Title&lt;/h3&gt;": (["html"], "### Title"),
    "beyond&nbsp;this&#160;point": (["html"], "beyond this point"),
    "an **important** word": (["markdown"], "an important word"),
    "a [link](/x/y.md) here": (["markdown"], "a link here"),
    "run `code` now": (["markdown"], "run `code` now"),
    "text\n```\ncode --x\n```\ntext": (["markdown"], "text\n```\ncode --x\n```\ntext"),
    "text\n\n#### Later heading\nmore": (["markdown"], "text\n\n#### Later heading\nmore"),
    "> quoted line of text": (["markdown"], "quoted line of text"),
    "~~old~~ __new__": (["markdown"], "old new"),
    "''slanted'' and '''bold''' text": (["wiki"], "slanted and bold text"),
    "see [[Page|the page]] and [[Other]]": (["wiki"], "see the page and Other"),
    "__NOTOC__\nBody of it.": (["wiki"], None),
    "== A heading ==\ntext": (["wiki"], "## A heading\n\ntext"),
    "{| class='x'\n|-\n| a || b\n|}\nAfter the table.": (["wiki"], None),
    "It is \\textbf{very} clear.": (["latex"], "It is very clear."),
    "if $n_{1} \\leq k^{2}$ holds": (["latex"], "if $n_{1} \\leq k^{2}$ holds"),
    "\\section{Head}\nText": (["latex"], "## Head\n\nText"),
    "\\begin{itemize}\n\\item one thing\n\\end{itemize}": (["latex"], "- one thing"),
    "as said~\\cite{key1990}.": (["latex"], "as said."),
    "<b>x</b> and **y** here": (["html", "markdown"], "x and y here"),
}
PROSE = [
    "# The chunk's own heading\n\ntext", "- list\n* list\n1. list\n• list", "it costs $ 16 and $ 20", "5 * 6 and 7 * 8", "C:\\dir\\file", "see [3] and {x}", "(x < 29, y > 32)",
    "12 == 12", "~4 %", "a | b", "one_two_three", "48  |  RUNNING Head of page", "don't 'quote' it", "R&D and Q & A", "", "x < y and z",
]


def test_constructs():
    for text, (kinds, clean) in CASES.items():
        got = markup.clean(text)
        assert got[0] == kinds, text
        if clean is not None:
            assert got[1] == clean, (text, got[1])


def test_prose_is_left_alone():
    for text in PROSE:
        assert markup.clean(text) == ([], text), text
    assert markup.clean(None) == ([], None)
    assert markup.clean("intro\n\n## My heading\ntext", "My heading")[0] == []


def test_own_heading_by_the_heading_path():
    assert markup.clean("# Own one\ntext", "Own one")[0] == []
    assert markup.clean("#### Another\ntext", "Own one")[0] == ["markdown"] and markup.clean("#### No own heading\ntext", "")[0] == ["markdown"]


def test_the_first_test_lets_every_construct_through():
    """What the JVM's test stops has no markup by the rules."""
    import random

    r = random.Random(3)
    signs = ["<b>", "</i>", "&#9;", "&amp;", "\\", "*", "**x**", "[[a]]", "](b)", "{{c}}", "{|", "|-", "~~d~~", "__e__", "$", "$x^2$", "`f`", "```", "# ", "> ", "== g ==", "''h''", " ", "\n", "word", "|", "---", ":--", "!"]
    for _ in range(4000):
        text = "".join(r.choice(signs) for _ in range(r.randint(1, 6)))
        assert re.search(markup.MAYBE, text) or markup.parse(text, "")[0] == set(), text


def test_the_ratios_decide(monkeypatch):
    """Short runs of tags without text around long paragraphs go; with the threshold at 0 they stay."""
    text = "<div><span>a</span><span>b</span><span>c</span><span>d</span><span>e</span><span>f</span><span>g</span></div>" + "<p>A long sentence, with commas, that carries the text; and another one of its kind.</p>" * 4
    kept = markup.clean(text)[1]
    monkeypatch.setattr(markup, "THRESHOLD", 0.0)
    assert kept != markup.clean(text)[1] and "abc" not in kept and kept.count("long sentence") == 4


def test_tags_without_text_are_dropped():
    nodes = [(("body", "p"), "A long sentence, with commas, that carries the text of the page.")] * 3 + [(("body", "script"), "var x"), (("br",), "\n"), (("body", "div", "span"), "x")]
    assert markup.select(nodes) == [True, True, True, False, True, False]


def test_cleaned(spark):
    rows = [("0", "#### Not its own\nx", None, None), ("1", "plain", None, ["h"]), ("2", None, "a **b** c", None), ("3", "x <b>y</b>", "x [[z]]", []), ("3", "x <b>y</b>", "x [[z]]", [])]
    df = spark.createDataFrame(rows, "id string, text string, content string, heading_path array<string>").selectExpr("*", "'a.pdf' source_pdf", "'text' chunk_type")
    assert {tuple(r) for r in markup.found(df).collect()} == {("0", "markdown"), ("2", "markdown"), ("3", "html"), ("3", "wiki")}
    assert {r["id"]: r["clean"] for r in markup.cleaned(df).collect()} == {"0": "#### Not its own\nx", "2": "a b c", "3": "x y"}
