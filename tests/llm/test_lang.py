import random

from folioforge.llm import lang

WORDS = {
    "en": "the house style of words and which that with from have this should would".split(),
    "fr": "le la les des une dans avec pour cette leur être nous chaque sont mais".split(),
    "de": "der die das und nicht eine mit für auf sich werden wurde zwischen über ist".split(),
}


def _sentence(r, k, n=14):
    return " ".join(r.choice(WORDS[k]) for _ in range(n)).capitalize() + "."


def _rows(seed, n, wrong=0.1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        k = r.choice(list(WORDS))
        out.append((r.choice(list(WORDS)) if r.random() < wrong else k, " ".join(_sentence(r, k) for _ in range(4)), k))
    return out


def test_held_out_accuracy_with_wrong_labels():
    m = lang.fit([(a, t) for a, t, _ in _rows(1, 150)])
    test = _rows(2, 200, 0)
    got, conf = m.classify([lang.running(t)[0] for _, t, _ in test])
    right = sum(m.langs[g] == k for g, (_, _, k) in zip(got, test) if g >= 0)
    assert right >= 0.97 * len(test) and conf.min() >= 0 and conf.max() <= 1
    none, _ = m.classify(["zzyx qqwv xkcd bbrt wwpq zzkj."])
    assert none[0] == -1


def test_named_labels(spark):
    labels = {"en": "en", " EN ": "en", "en-GB": "en", "eng": "en", "FR_be": "fr", "fre": "fr", "und": None, "xx": None, "": None, None: None, "english": None}
    df = spark.createDataFrame([(k,) for k in labels], "lang string")
    assert {r[0]: r[1] for r in df.select("lang", lang.named(df["lang"])).collect()} == labels


def test_running_text_leaves_headings_out():
    text = "# The heading of this chunk\n\nThe first sentence stands here with words. A second one follows it.\n\nTHE RUNNING HEAD — 12\n\n12  |  WENBA The title\n\n• an entry of a list\nSo he said (fr: la colonne des monnaies) in short, it is so."
    assert lang.running(text) == ["The first sentence stands here with words.", "A second one follows it.", "So he said  in short, it is so."]
    assert lang.running(None) == [] and lang.running("") == []


def test_chunks(spark):
    r = random.Random(5)
    m = lang.fit([(a, t) for a, t, _ in _rows(3, 150, 0)])
    en, fr = (" ".join(_sentence(r, k) for _ in range(3)) for k in ("en", "fr"))
    rows = [("1", en + "\n\n" + fr, "en-GB"), ("2", fr, "fra"), ("3", en, None), ("4", en + " Le mot ici.", "EN"), ("5", None, "de"), ("2", fr, "fra")]
    df = spark.createDataFrame(rows, "id string, text string, lang string").selectExpr("*", "cast(null as string) content", "'a.pdf' source_pdf", "'text' chunk_type")
    assert {tuple(x) for x in lang.found(df, m).collect()} == {("1", "fr"), ("3", "en")}
    doc = lang.documents(df, m).first()
    assert doc["lang"] == "en" and 0 < doc["confidence"] <= 1 and doc["languages"] >= 2
    assert lang.segments(df, m).where("id = '1'").count() == 6
