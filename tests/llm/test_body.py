import itertools
import os
import random

import pandas as pd
import pytest

from folioforge.llm import body, furniture

SENTENCE = "The numbering scheme of the joint manual follows the heading level within ten working days."


def _page(n, tag="p"):
    return [
        ("nav", "Home"), ("nav", "Press room"), ("span", "Home › News › A name"), ("aside", "This site uses cookies to measure visits. Reject Accept all"),
        ("h1", f"The title {n}"), (tag, SENTENCE), (tag, "The chapter on cookies explains how a consent notice is to be worded (42.2)."), (tag, "Print this page"),
        (tag, SENTENCE + " " + SENTENCE), ("li", "The index card"), ("li", "luyal 37"), ("div", "Related pages are cited by title, then by date (1.2.2020)."),
        ("h3", "Related pages"), ("li", "The source file"), (tag, "4.1. The annex of the act"), ("footer", "Back to top"), ("footer", "© 2010 Wen Desk. All rights reserved."),
    ]


BODY = [4, 5, 6, 8, 9, 10, 11]


def _spread(w, page):
    return [i for i, (b, _) in enumerate(body.classify(page, w)) if b]


def test_weights_and_regions():
    w = body.learn([_page(i) for i in range(20)])
    assert _spread(w, _page(99, "div")) == BODY
    assert body.best_regions([-1, 2, -1, 3, -9, 4]) == [(1, 4, 4), (5, 6, 4)]
    assert body.best_regions([-1, -2]) == [] and body.best_regions([]) == []
    assert body.best_regions([2, -1, 2], 0.5) == [(0, 1, 2), (2, 3, 2)]


def test_regions_against_all_regions():
    """The best region of all is among them; none can be enlarged or cut for a higher score; together they hold every positive line."""
    r = random.Random(1)
    for _ in range(300):
        s = [r.randint(-4, 4) for _ in range(r.randint(1, 9))]
        got = body.best_regions(s)
        every = {(i, j): sum(s[i:j]) for i, j in itertools.combinations(range(len(s) + 1), 2)}
        assert max([x for _, _, x in got], default=0) == max(0, *every.values())
        assert all(x == every[i, j] and all(y < x for (p, q), y in every.items() if i <= p and q <= j and (p, q) != (i, j)) for i, j, x in got)
        assert {k for i, j, _ in got for k in range(i, j)} >= {k for k, x in enumerate(s) if x > 0}


def test_the_region_decides():
    """Weak lines are body within the body's region and furniture away from it; with the region taken away (each line by its own sign) both turn."""
    w = body.Weights({"good": 3.0, "bad": -9.0, "meh": -0.6, "so": 0.4}, 0.0, {}, 0.0)
    page = [("p", "so"), ("p", "bad"), ("p", "good"), ("p", "meh"), ("p", "good"), ("p", "bad"), ("p", "meh")]
    got = body.classify(page, w)
    assert [b for b, _ in got] == [False, False, True, True, True, False, False]
    assert [s > 0 for _, s in got] == [True, False, True, False, True, False, False]


UNLISTED = ["Tweet this article", "Rate this page", "Back to the top of this page", "Print this article", "Share this article", "Cookie settings", "Page 3 of the web archive of the Board", "Was this article useful? Yes / No"]


def test_unlisted_wording():
    """Held out: lines that no phrase of the labeller names, told by the weights of words and tags learned from those that it names."""
    assert not any(map(furniture.seed, UNLISTED))
    pages = [_page(i) + [("p", x) for x in ("Share this page", "Was this page useful? Yes / No", "Page 7 of the Wen web archive")] + [("footer", "Back to top")] for i in range(30)]
    w = body.learn(pages)
    for x in UNLISTED:
        assert not body.classify(_page(1) + [("div", x)], w)[-1][0], x
    assert _spread(w, _page(5)) == BODY


def test_a_language_left_out():
    """Spanish pages, judged by weights from the pages of the other languages: tags, form and regions have to do. Measured: 0.966 of the lines right."""
    at = "/root/testdata/sf0.1/chunks.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    rows = pd.read_parquet(at, columns=["source_html", "id", "html_tag", "text", "content"]).dropna(subset=["source_html", "id"]).drop_duplicates(["id"]).sort_values(["source_html", "id"])
    pages: dict[str, list] = {}
    for page, tag, text, content in zip(rows["source_html"], rows["html_tag"], rows["text"], rows["content"]):
        held = text if text and text.strip() else content or ""
        pages.setdefault(page, []).extend(((tag or "").lower(), x) for x in held.split("\n") if x.strip())
    entries = {x.lower() for x in furniture.MENU["es"].split("|")} - {x.lower() for k, v in furniture.MENU.items() if k != "es" for x in v.split("|")}
    spanish = [p for p in pages.values() if any(x.strip().lower() in entries for _, x in p)]
    w = body.learn([p for p in pages.values() if p not in spanish and not any(" de la " in x for _, x in p)][:300])
    right = [b == (k is None) for p in spanish[:200] for (b, _), k in zip(body.classify(p, w), body.labels(p))]
    assert len(right) > 2000 and sum(right) / len(right) > 0.95


def test_box_entries_by_what_stands_above():
    w = body.learn([_page(i) for i in range(20)])
    page = [("h3", "Related pages"), ("li", "The source file")]
    assert [b for b, _ in body.classify(page, w)] == [False, False] and w.scores(page[1:])[0] > 0


def test_pages_of_many_chunks(spark):
    rows = []
    for p in range(6):
        for i, (tag, x) in enumerate(_page(p)):
            rows.append((f"p{p}:{i + 1:05d}", x, f"p{p}.html", tag))
    for i in range(9000):  # one page far longer than a block
        rows.append((f"hot:{i + 1:05d}", SENTENCE if i % 3 else "Print this page", "hot.html", "p"))
    df = spark.createDataFrame(rows + rows[:5], "id string, text string, source_html string, html_tag string").selectExpr("*", "cast(null as string) content")
    got = {(r["id"], r["line_no"]): r["is_body"] for r in body.page_lines(df).collect()}
    assert len(got) == len(rows)
    assert [i for i in range(17) if got[f"p3:{i + 1:05d}", 1]] == BODY
    assert all(got[f"hot:{i + 1:05d}", 1] == bool(i % 3) for i in range(9000))


def test_phrases():
    kinds = {"Home • Contact • Search": "menu", "Agenda / Prensa / Inicio": "menu", "Contact": "menu", "Lo más leído": "box", "Volver arriba": "prompt", "Build 6.3": "prompt",
             "Ce site utilise des témoins. Refuser Tout accepter": "consent", "Aviso legal > Contacto > 7.3. La mesa": "crumb", "Home rules apply here.": None,
             "Se escribe «página de inicio» en minúscula (42).": None, "Accept all changes in the draft.": None, SENTENCE: None}
    assert {k: furniture.seed(k) for k in kinds} == kinds


def test_long_lines_are_labelled_too():
    notice = "This site uses cookies to measure visits. " * 12 + "Reject Accept all"
    menu = " | ".join(["Home", "Press room", "Contact", "Help", "a name"] * 12)
    crumb = "Home   ›  News › " + " › ".join(["A name of a page"] * 30)
    assert min(map(len, (notice, menu, crumb))) > 400
    assert [furniture.seed(x) for x in (notice, menu, crumb, SENTENCE * 9)] == ["consent", "menu", "crumb", None]
    assert furniture.seed("a" + " " * 200_000 + "b") is None
