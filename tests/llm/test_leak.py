import random

from folioforge.llm import leak

VOCAB = [f"v{i}" for i in range(300)]


def _texts(seed):
    r = random.Random(seed)
    items = [(100 + i, " ".join(r.choice(VOCAB) for _ in range(r.randint(8, 60)))) for i in range(12)]
    docs = []
    for i in range(60):
        w = [r.choice(VOCAB) for _ in range(r.randint(0, 120))]
        if r.random() < 0.6:
            src = r.choice(items)[1].split()
            n = r.choice([10, 11, 12, 13, 40])
            a = r.randint(0, max(0, len(src) - n))
            at = r.randint(0, len(w))
            w[at:at] = src[a : a + n]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w).upper() if i % 5 == 0 else " ".join(w)))
    return docs, items


def _runs(t, n=12):
    w = t.lower().replace(",", " ").split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def test_against_brute_force(spark):
    docs, items = _texts(1)
    want = {(d, i) for d, t in docs for i, u in items if _runs(t) & _runs(u)}
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert want and {tuple(x) for x in leak.found(d, i).collect()} == want
    old, leak.MOST_BITS = leak.MOST_BITS, 1 << 10  # bitmaps far too small for the items: more windows go to the join, none is lost
    try:
        assert {tuple(x) for x in leak.found(d, i).collect()} == want
    finally:
        leak.MOST_BITS = old
    assert {x["item_id"] for x in leak.report(d.selectExpr("*", "'s' source"), i).collect()} == {b for _, b in want}


def test_edit_distance():
    def plain(a, b):
        d = list(range(len(b) + 1))
        for x in a:
            p, d[0] = d[0], d[0] + 1
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    r = random.Random(7)
    for _ in range(300):
        a, b = (r.choices("abc", k=r.randint(0, 9)) for _ in range(2))
        most = r.randint(0, 4)
        assert leak.edit_distance(a, b, most) == min(plain(a, b), most + 1)
        assert leak.edit_distance(a, b, most, True) == min(most + 1, *(plain(a[:k], b) for k in range(len(a) + 1)))


def _edited(r, w, edits):
    """`edits` words inserted, deleted or replaced at places that lie apart, with the ends kept, so that the passage stays one window."""
    w = list(w)
    for k in sorted(r.sample(range(1, len(w) - 1), edits), reverse=True):
        w[k : k + 1] = r.choice([[], ["edit"], [w[k], "edit"]])
    return w


def test_recall_of_single_windows(spark):
    """Passages that have just one window in their item (24 words), alone in a text: 1, 2 and 3 edits."""
    for vocabulary in (300, 5000):
        r = random.Random(vocabulary)
        items = [(i, [f"v{r.randrange(vocabulary)}" for _ in range(24)]) for i in range(240)]
        docs = [(i * 10 + e, "before " * 30 + " ".join(_edited(r, w, e)) + " after" * 30) for i, w in items for e in (1, 2, 3)]
        got = leak.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
        hit = {x["doc_id"] for x in got if x["doc_id"] // 10 == x["item_id"]}
        for e in (1, 2, 3):
            assert len({d for d in hit if d % 10 == e}) >= 0.95 * len(items), (vocabulary, e)


def test_short_items(spark):
    """Items of 12 to 23 words are one window of their own length; of 11 words none."""
    r = random.Random(5)
    items = [(n, [f"w{r.randrange(4000)}" for _ in range(n)]) for n in range(10, 24)]
    docs = [(n, "x " * 20 + " ".join(w) + " y" * 20) for n, w in items] + [(100 + n, " ".join(_edited(r, w, 1))) for n, w in items]
    i = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in leak.leaks(spark.createDataFrame(docs, "doc_id long, text string"), i).collect()}
    assert {k for k, e in got.items() if e == 0} == {(n, n) for n in range(12, 24)}
    assert sum(got.get((100 + n, n)) == 1 for n in range(12, 24)) >= 11


def test_the_walk_decides(spark, monkeypatch):
    """With keys that the texts' windows never share with the items' nothing is found; with an edit check that lets nothing through neither."""
    d, i = (spark.createDataFrame([(1, " ".join(VOCAB[:40]))], f"{n} long, text string") for n in ("doc_id", "item_id"))
    assert leak.found(d, i).count() == 1
    monkeypatch.setattr(leak.Walk, "keys", lambda self, h, starts, repeat: leak.np.random.default_rng().integers(1, 1 << 63, len(starts), dtype=leak.np.uint64))
    assert leak.found(d, i).count() == leak.leaks(d, i).count() == 0


def test_hot_window(spark):
    """One passage in most documents and in many items: compared once, given for each document and item."""
    text = " ".join(VOCAB[:30])
    d = spark.range(3000).selectExpr("id doc_id", f"concat('n', id, ' {text} m', id) text")
    i = spark.range(20).selectExpr("id item_id", f"concat('{text} z', id) text")
    assert leak.found(d, i).count() == 60_000
