import math
import random

from pyspark.sql import functions as F

from folioforge.operators import index, retrieve

DOCS = [(1, "a b c a"), (2, "a b"), (3, "a"), (4, None), (5, "z z z c"), (6, "a d")]


def _bm25(query, k):
    toks = {i: (t or "").split() for i, t in DOCS}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    s = {i: round(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split()), 6) for i, t in toks.items()}
    return sorted(s.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_bm25_fills_with_zeros(spark):
    ix = index.lexical(spark.createDataFrame(DOCS, "doc_id long, text string"))
    qs = [(0, "a c c"), (1, "nothing"), (2, "z"), (3, ""), (4, None)]
    got = retrieve.bm25(ix, spark.createDataFrame(qs, "query_id int, text string"), 5).collect()
    for q, t in qs:
        mine = [(r["key"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert mine == _bm25(t or "", 5)


def test_vectors(spark):
    r = random.Random(1)
    vs = [(i, [r.random() for _ in range(4)]) for i in range(30)] + [(99, None)]
    e = spark.createDataFrame(vs, "key long, embedding array<float>")
    got = retrieve.vectors(e, e.where("key < 3").select(F.col("key").alias("query_id"), "embedding"), 4, block=2).collect()
    for q in range(3):
        want = sorted((round(math.dist(v, vs[q][1]), 4), i) for i, v in vs[:30])[:4]
        assert [(round(x["score"], 4), x["key"]) for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == want


def test_fusion(spark):
    lists = lambda rows: spark.createDataFrame(rows, "query_id int, key string, rank int")
    v, x = lists([(0, "a", 0), (0, "b", 1), (0, "c", 2)]), lists([(0, "c", 0), (0, "d", 1), (0, "d", 2)])
    got = [(r["key"], round(r["score"], 9)) for r in retrieve.fuse(v, x, 10).orderBy("rank").collect()]
    want = {"a": 0.55 / 60, "b": 0.55 / 61, "c": 0.55 / 62 + 0.45 / 60, "d": 0.45 / 61}
    assert got == [(k, round(s, 9)) for k, s in sorted(want.items(), key=lambda z: -z[1])]
    twice = {r["key"]: r["score"] for r in retrieve.fuse(v, x, 10, count_repeats=True).collect()}
    assert round(twice["d"], 9) == round(0.45 / 61 + 0.45 / 62, 9)
    assert retrieve.fuse(v.limit(0), x.limit(0)).count() == 0


def test_rankings(spark):
    c = spark.createDataFrame([(0, f"k{i}", i, "red fox", "fox" if i == 2 else "dog") for i in range(4)], "query_id int, key string, rank int, query string, text string")
    assert [r["key"] for r in retrieve.rerank(c, 2).orderBy("place").collect()] == ["k2", "k0"]
    assert [r["key"] for r in retrieve.rerank(c, 2, lambda q, t: [-float(i) for i in range(len(q))]).orderBy("place").collect()][0] in {"k0", "k1", "k2", "k3"}
    said = spark.createDataFrame([(0, [2, 9, 2, None, 0])], "query_id int, ranking array<int>")
    assert [r["key"] for r in retrieve.apply_ranking(c, said).orderBy("place").collect()] == ["k2", "k0", "k1", "k3"]
    assert [r["key"] for r in retrieve.apply_ranking(c, said, 3, dedupe=False).orderBy("place").collect()] == ["k2", "k2", "k0"]
    rounds = spark.createDataFrame([(0, 0, 0, "a"), (0, 1, 0, "b"), (0, 1, 1, "a"), (0, 0, 1, "c")], "query_id int, round int, place int, key string")
    assert [r["key"] for r in retrieve.union_rounds(rounds).orderBy("position").collect()] == ["a", "c", "b"]


def test_index_tables(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    ix = index.lexical(docs, store=False)
    back = ix.write(str(tmp_path / "ix"))
    assert back.terms.count() == ix.terms.count() == 5 and back.corpus.first()["n"] == 6
    q = spark.createDataFrame([(0, "a c c"), (1, "z")], "query_id int, text string")
    a, b = (retrieve.bm25(x, q, 4).orderBy("query_id", "rank") for x in (ix, back))
    assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()]
    folders = [f.name for f in (tmp_path / "ix" / "postings").iterdir() if f.is_dir()]
    assert 1 < len(folders) <= 5 and all(f.startswith("bucket=") for f in folders)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.jsonl").write_text("x")
    one = index.fingerprint(spark, [str(tmp_path / "f")]).first()[0]
    (tmp_path / "f" / "a.jsonl").write_text("y")
    two = index.fingerprint(spark, [str(tmp_path / "f")]).first()[0]
    meta = index.meta(spark, "n", "d", ["p"], 1, one, "m")
    assert one != two and not index.stale(meta, one, "m") and index.stale(meta, two, "m") and index.stale(meta, one, "o") and index.stale(None, one, "m") and index.stale(meta, one, "m", True)
    e = index.embedded(docs, lambda ts: [[float(len(t))] for t in ts], index.EMBEDDERS["local"])
    assert {r["key"]: r["embedding"][0] for r in e.collect()}[4] == 1.0
    empty = index.lexical(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.terms.count() == 0 and retrieve.bm25(empty.write(str(tmp_path / "none")), q, 4).count() == 0


def test_vectors_against_plain_distances(spark):
    """Ties by key, several batches and tasks, keys that are texts."""
    r = random.Random(4)
    vs = [(f"k{i:03d}", [r.randrange(3) / 2 for _ in range(5)]) for i in range(400)]
    e = spark.createDataFrame(vs, "key string, embedding array<float>").repartition(5)
    got = retrieve.vectors(e, e.where("key < 'k007'").select(F.col("key").alias("query_id"), "embedding"), 9).collect()
    for q, v in vs[:7]:
        want = sorted((round(math.dist(v, u), 6), k) for k, u in vs)[:9]
        assert [(x["score"], x["key"]) for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == want
    assert retrieve.vectors(e.limit(0), e.limit(3).select(F.col("key").alias("query_id"), "embedding")).count() == 0
    assert retrieve.vectors(e, e.limit(0).select(F.col("key").alias("query_id"), "embedding")).count() == 0


def test_no_sort_over_all_pairs(spark):
    """The index streams through one task step that gives k rows a query; only these are sorted, and nothing is joined."""
    e = spark.range(1000).selectExpr("id as key", "array(cast(id as float), 1f) embedding")
    plan = retrieve.vectors(e, e.where("key < 3").selectExpr("key as query_id", "embedding"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert plan.rindex("MapInArrow") > plan.rindex("Sort")  # the leaf side is printed last


def test_filter_before_the_cut(spark):
    """A selective filter on the metadata still fills the list."""
    from folioforge.plans import engine

    docs = spark.range(300).selectExpr("id as doc_id", "concat('alpha beta ', id) as text")
    chunks = docs.selectExpr("doc_id as key", "cast(doc_id as string) label", "text", "doc_id % 100 = 99 as rare")
    e = engine.Engine(spark, index.lexical(docs), chunks, settings=engine.Settings(candidates=5, top=5))
    q = spark.createDataFrame([(0, "alpha")], "query_id int, query string")
    assert {r["key"] for r in e.retrieve(q, "rare").collect()} == {99, 199, 299}
