import random

from folioforge.llm import truncation

BASE = "The annex of the first proof follows the cover note in all official languages. The source file shortens the printed edition when two versions differ."
CUT = ["The annex of the first pro", "The annex of", "The cover note (642/1997)", "The cover note for brochures (more)", "The cover […]", "The cover no…", "The ann...", "The c�", "In practice,", "The cover note for \n"]
WHOLE = ["The proof.", "Is it so?", "“Quoted end.”", "(In brackets.)", "and so on, etc.", "Annex III", "- the title page", "word | 12 | word", "Contact: desk 20, Pola", "Done at Xista, 25.9.2022", "(Gofi 29/5.7.2010)",
         "Krihup Lunel, editorial desk", "/wenfixi/stay/1539.html", "The title of the first proof"]


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "if(doc_id % 2 = 0, 'a', 'b') source")


def test_endings(spark):
    texts = [f"{BASE} {t}" if i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 0) else t for i, t in enumerate(CUT)] + [f"{BASE}\n{t}" for t in WHOLE]
    texts += ["The first proof.\nA proof\nThe editorial desk\nThe proof"] * 4 + ["The second part follows the first proof.", "They read the proof.", None, "", " \n"]
    got = {r[0] for r in truncation.found(_docs(spark, texts)).collect()}
    assert got == set(range(len(CUT)))
    shares = truncation.shares(_docs(spark, texts)).collect()
    assert sum(r["truncated"] for r in shares) == len(CUT) and all(0 <= r["share"] <= 1 for r in shares)


def test_alignment():
    assert truncation.stops_inside("One two three four five six seven eight nine ten", "zero. One two three four five six seven eight nine ten eleven twelve.")
    assert truncation.stops_inside("One two three four five six seven eight nine te (more)", "One two three four five six seven eight nine ten eleven.")
    assert not truncation.stops_inside("One two three four five six seven eight nine ten", "One two three four five six seven eight nine ten")
    assert not truncation.stops_inside("One two three four five six seven eight nine ten.", "One two three four five six seven eight nine ten. More.")
    assert not truncation.stops_inside("", "x") and not truncation.stops_inside("short", "short text")


def test_near_copy_shows_the_cut(spark):
    """A short last line could be a heading; its near copy shows that the line goes on."""
    r = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    text = "\n".join(" ".join(r.choice(words) for _ in range(12)).capitalize() + "." for _ in range(20))
    full = text + "\nThe title of the proof was kept in the file."
    cut = text + "\nThe title of the proof"
    got = {x["doc_id"]: x["early"] for x in truncation.judged(_docs(spark, [full, cut, full])).collect()}
    assert got == {0: False, 1: True, 2: False}
    assert {x[0] for x in truncation.found(_docs(spark, [full, cut, full])).collect()} == {1}


def test_cut_is_found_behind_a_longer_variant(spark):
    """The longest text of a cut text's cells has another ending; the copy that goes on is another one. Among the others are texts that are no near copies."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(900)]
    sentence = lambda n=12: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    texts, want = [], set()
    for family in range(3):
        base = "\n".join(sentence() for _ in range(150))
        for v in range(6):
            own = f"{base}\nTitle {sentence(9)[:-1].lower()} was kept in the file."
            texts += [own, own[: own.index(" was kept") - v % 2]]
            want.add(len(texts) - 1)
        texts += [f"{base}\n{sentence(40)}", base[: len(base) * 3 // 4] + "\nTitle of the proof", "\n".join([base[: len(base) * 2 // 3], sentence(400), own])]
    got = {x["doc_id"] for x in truncation.judged(_docs(spark, texts)).where("early").collect()}
    assert got == want
    s = [set(zip(*(w[k:] for k in range(5)))) for w in (truncation.WORD.findall(t.lower()) for t in texts)]
    assert got == {i for i in range(len(texts)) if any(len(s[i] & s[j]) >= 0.8 * len(s[i]) and truncation.stops_inside(texts[i], texts[j]) for j in range(len(texts)))}


def test_copies_do_not_vouch_for_their_own_last_word(spark):
    """A cut text stays a case however often it is delivered; a word that closes lines of other texts still closes one."""
    cut, cut2, title = f"{BASE}\nThe annex of the fir", f"{BASE}\nThe annex\nof the seco\n", f"{BASE}\nA proof in annexes"
    marked = f"{BASE}\nThe proof in annexes )"
    others = [f"{BASE} They kept {k} annexes.\nThe end." for k in range(3)]
    texts = [cut, cut2, title, marked] + others
    for n in (1, 2, 9):
        docs = _docs(spark, [t for t in texts for _ in range(n if t in (cut, cut2, title, marked) else 1)])
        got = {r[0] for r in truncation.found(docs).collect()}
        assert got == set(range(2 * n))


def test_forms_and_endings():
    assert truncation.form("The first proof") == "sa" and truncation.form("- an entry") == "s-" and truncation.form("a | b") == "sa|" and truncation.form("12 pages") == "s0"
    assert truncation.form("One is done. The next") == "p" and truncation.form("12.3. The next part") == "s0" and truncation.form("x" * 111) == "p"
    assert truncation.ending("A proof.\nThe annex of")[:3] == ("open", "sa", "of") and truncation.ending("So (more)")[0] == "omitted" and truncation.ending("So it is.”")[0] == "stop"


def _sentences(r, n, size=12):
    return [" ".join(f"w{r.randrange(900)}" for _ in range(size)).capitalize() + "." for _ in range(n)]


def test_a_cut_of_any_length_meets_its_copy(spark):
    """Copies cut at a tenth to nine tenths, with a heading-like last line that no score could tell: only the alignment with the copy shows it."""
    r = random.Random(6)
    texts, want, n = [], set(), 0
    for k in range(60):
        lines = _sentences(r, 40)
        share = (k % 9 + 1) / 10
        at = max(4, int(len(lines) * share))
        title = "Title " + " ".join(f"w{r.randrange(900)}" for _ in range(3))
        full = "\n".join(lines[:at] + [f"{title} was kept in the file."] + lines[at:])
        edited = full.replace(lines[1], lines[1].replace(" ", " also ", 1)) if k % 2 else full
        texts += [edited, "\n".join(lines[:at] + [title])]
        want.add(len(texts) - 1)
    got = {x["doc_id"] for x in truncation.judged(_docs(spark, texts)).where("early").collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_alignment_and_terminality_decide(spark, monkeypatch):
    """Without the alignment a cut before a word that ends headings is lost; without the scores the cuts that have no copy are."""
    r = random.Random(8)
    lines = _sentences(r, 20)
    heads = ["The proof", "A title of the proof", "The annex"]
    other = ["\n".join([heads[i % 3], *_sentences(r, 6)]) for i in range(30)]
    full = "\n".join(lines[:10] + ["The title of the proof was kept in the file."] + lines[10:])
    texts = [full, "\n".join(lines[:10] + ["The title of the proof"]), "\n".join([*_sentences(r, 5), "The annex of the"]), "\n".join([*_sentences(r, 5), "The proof"])] + other
    docs = _docs(spark, texts)
    assert {x[0] for x in truncation.found(docs).collect()} == {1, 2}
    monkeypatch.setattr(truncation, "SIMILARITY", 2.0)
    assert {x[0] for x in truncation.found(docs).collect()} == {2}
    monkeypatch.undo()
    monkeypatch.setattr(truncation, "TERMINAL", 0.0)
    assert {x[0] for x in truncation.found(docs).collect()} == {1}


def test_unlisted_signatures_and_endings(spark):
    """Endings that no rule names: told by their form and their closing word, from the headings and entries of other texts."""
    r = random.Random(9)
    texts = ["\n".join([f"Part {i} of the file", *_sentences(r, 5), "Short line here", "- an entry", *_sentences(r, 2)]) for i in range(40)]
    ends = ["Signed: M. Alva", "For the board, P. Lund", "Version 4.2", "Place of the file", "ISBN 978-3-16-148410-0", "- an entry"]
    cuts = ["W1 w2 w3 w4. The w5 w6 of the", "W1 w2 w3 w4. The w5 w6, w7 w8 w9 and w1"]
    texts += ["\n".join([*_sentences(r, 5), x]) for x in ends + cuts]
    assert {x[0] for x in truncation.found(_docs(spark, texts)).collect()} == {46, 47}
