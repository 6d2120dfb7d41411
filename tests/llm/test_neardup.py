import random
import re

import numpy as np

from folioforge.llm import neardup
from folioforge.llm.shingles import Signer

VOCAB = [f"w{i}" for i in range(400)]


def _corpus(seed, n=120):
    r = random.Random(seed)
    rows, k = [], 0
    for _ in range(n):
        t = [r.choice(VOCAB) for _ in range(r.randint(30, 160))]
        kind = r.choice(["text", "chapter_text"])
        for _ in range(r.choice([1, 1, 2, 3])):
            u = list(t)
            for _ in range(r.choice([0, 0, 1, 3, 6])):
                u[r.randrange(len(u))] = r.choice(VOCAB)
            rows.append((f"id{k}", " ".join(u), kind if r.random() < 0.9 else "text"))
            k += 1
    return rows


def _sets(rows, width=3, least=40):
    out = {}
    for i, t, kind in rows:
        w = re.findall(r"[^\W_]+", t.lower())
        if len(w) >= least:
            out[i] = (kind, set(zip(*(w[k:] for k in range(width)))))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, chunk_type string").selectExpr("*", "cast(null as string) content", "'a.pdf' source_pdf")


def test_pairs_against_brute_force(spark):
    rows = _corpus(1)
    s = _sets(rows)
    want = {(a, b) for a in s for b in s if a < b and s[a][0] == s[b][0] and len(s[a][1] & s[b][1]) >= 0.7 * len(s[a][1] | s[b][1])}
    df = _frame(spark, rows + rows[:7])
    got = {tuple(x) for x in neardup.found(df).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 40
    groups = {x["id"]: x["group_id"] for x in neardup.groups(df).collect()}
    assert all(groups[a] == groups[b] for a, b in got) and set(groups) == {x for p in got for x in p}


def test_embedding_is_a_lower_bound():
    r = random.Random(3)
    signer = Signer(3, 2, 2, neardup.SEGMENTS)
    for _ in range(50):
        a = [r.choice(VOCAB) for _ in range(90)]
        b = [x if r.random() < 0.8 else r.choice(VOCAB) for x in a]
        at, s, starts = signer.sets([" ".join(a), " ".join(b)], 3)
        c = signer.counts(s, starts).astype(int)
        x, y = set(s[: starts[1]].tolist()), set(s[starts[1] :].tolist())
        d = np.abs(c[0] - c[1]) % 8
        assert np.minimum(d, 8 - d).sum() <= np.abs(c[0] - c[1]).sum() <= len(x ^ y) and c.sum() == len(x) + len(y)


def test_packed_distance(spark):
    r = random.Random(5)
    rows, want = [], []
    for i in range(20):
        a, b = ([r.randrange(8) for _ in range(63)] for _ in range(2))
        pack = lambda v: [sum(x << (3 * k) for k, x in enumerate(v[j : j + 21])) for j in (0, 21, 42)]
        rows.append((i, *pack(a), *pack(b)))
        want.append(sum(min(abs(x - y), 8 - abs(x - y)) for x, y in zip(a, b)))
    df = spark.createDataFrame(rows, "i int, a0 long, a1 long, a2 long, b0 long, b1 long, b2 long").selectExpr("i", "struct(a0 v0, a1 v1, a2 v2) x", "struct(b0 v0, b1 v1, b2 v2) y")
    assert [x[0] for x in df.orderBy("i").selectExpr(neardup.manhattan("x", "y")).collect()] == want


def test_large_class_of_copies_is_a_star(spark):
    text = " ".join(VOCAB[:60])
    near = " ".join(VOCAB[:59] + ["other"])
    n = neardup.ALL_PAIRS + 16
    rows = [(f"c{i:03d}", text, "text") for i in range(n)] + [("z0", near, "text"), ("z1", near, "text")]
    got = {tuple(x) for x in neardup.found(_frame(spark, rows)).collect()}
    assert got == {("c000", f"c{i:03d}") for i in range(1, n)} | {("z0", "z1"), ("c000", "z0"), ("c000", "z1")}
    assert {x["group_id"] for x in neardup.groups(_frame(spark, rows)).collect()} == {"c000"}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (200, 200)]
    got = {x["node"]: x["root"] for x in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[102] == 100 and got[200] == 200


def test_components_of_long_chains_with_shuffled_ids(spark):
    r = random.Random(7)
    ids = r.sample(range(-(10**15), 10**15), 2200)
    chains = [ids[:1500], sorted(ids[1500:2100]), ids[2100:]]
    edges = [(a, b) for c in chains for a, b in zip(c, c[1:])]
    r.shuffle(edges)
    got = {x["node"]: x["root"] for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(c) for c in chains for x in c}


def test_large_cells_are_dealt(spark, monkeypatch):
    """Variants of one text, a third of all rows, in the same cells: dealt over parts, every pair is met once as without."""
    r = random.Random(12)
    base = [r.choice(VOCAB) for _ in range(80)]
    rows = []
    for k in range(60):
        u = list(base)
        u[r.randrange(len(u))] = f"own{k}"
        rows.append((f"v{k:02d}", " ".join(u), "text"))
    rows += [(f"o{k}", " ".join(r.choice(VOCAB) for _ in range(60)), "text") for k in range(120)]
    df = _frame(spark, rows)
    want = {tuple(x) for x in neardup.found(df).collect()}
    assert len(want) == 60 * 59 // 2
    monkeypatch.setattr(neardup, "LARGE", 7)
    monkeypatch.setattr(neardup, "SAMPLED", 1)
    assert {tuple(x) for x in neardup.found(df).collect()} == want


def test_copies_around_the_limit_of_all_pairs(spark):
    """Up to ALL_PAIRS copies in all pairs, beyond that each linked to the least id; the other text is linked either way."""
    r = random.Random(13)
    text = [r.choice(VOCAB) for _ in range(60)]
    near = " ".join(["other", *text[1:]])
    for n in (24, 25, 26):
        got = {tuple(x) for x in neardup.found(_frame(spark, [(f"c{k:02d}", " ".join(text), "text") for k in range(n)] + [("z", near, "text")])).collect()}
        assert len(got) == (n * (n - 1) // 2 + n if n <= neardup.ALL_PAIRS else n - 1 + 1)
        assert ("c00", "z") in got
