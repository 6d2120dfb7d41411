"""Retrieval for a batch of queries: lexical and vector top-k, weighted reciprocal-rank fusion, re-ranking, union over rounds.

Everything is keyed by query_id, so one plan answers any number of queries. Scores are rounded to PLACES and ties broken by key, so
that results don't depend on the order of addition or of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.text import WS, col, snippet
from ..storage import written
from ..types import data_type
from .index import B, K1, Lexical, bucket

#: Candidates of each list, results after re-ranking, weight of the vector list, constant of the fusion, decimal places of scores.
CANDIDATES, TOP, ALPHA, RRF, PLACES = 40, 15, 0.55, 60, 6


def top_k(scored: DataFrame, k: int, score: str = "score", descending: bool = True) -> DataFrame:
    """The k best of each query with rank from 0; ties by key. Each task keeps its own k best before the exchange (window group limit)."""
    order = F.desc(score) if descending else F.asc(score)
    w = Window.partitionBy("query_id").orderBy(order, "key")
    # the number itself is compared: only then is the limit taken over into each task
    return scored.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).withColumn("rank", F.col("__r") - 1).drop("__r")


def doc_key(chunk_id: Column | str, text: Column | str) -> Column:
    """Identity of a document: its id, else the digest of its text."""
    return F.coalesce(F.when(col(chunk_id) != "", col(chunk_id)), F.sha1(F.encode(col(text), "utf-8")))


def bm25(index: Lexical, queries: DataFrame, k: int = CANDIDATES, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """query_id, key, score, rank: the k best documents of each query by Okapi weights; repeated query terms count repeatedly.

    Exactly min(k, n) a query: documents without any term fill up with score 0, by key; negative scores come behind them. Query
    terms meet postings in an equi-join, so a broadcast or a shuffle is chosen by size.
    """
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(F.split(F.coalesce(text, F.lit("")), f"{WS}+")).alias("term"))
    terms = terms.where("term <> ''").groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    postings = index.postings
    if "bucket" in postings.columns:  # a stored index: only the folders of the queries' terms are read; at most BUCKETS numbers come to the driver
        wanted = [r[0] for r in terms.select(bucket("term")).distinct().collect()]
        postings = postings.where(F.col("bucket").isin(wanted)).drop("bucket")
    hits = postings.join(terms.join(index.terms, "term"), "term").join(index.lengths, "key").crossJoin(F.broadcast(index.corpus))  # corpus: one row
    tf = F.col("tf").cast("double")
    weight = F.col("qf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "key").agg(F.round(F.sum(weight), PLACES).alias("score"))
    scored = written(queries.sparkSession, scored, "bm25-scores")  # read again to fill up
    every = queries.select(F.col(query_id).alias("query_id")).distinct()
    return top_k(scored.where("score <> 0").unionByName(_fill(index, every, scored, k)), k)


def _fill(index: Lexical, every: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """Documents of score 0, the first k by key, for those queries alone whose positive matches don't fill their list.

    The first k + m keys hold k such documents if m documents have a score, so only the smallest keys are paired with a query, not all.
    """
    counts = scored.where("score <> 0").groupBy("query_id").agg(F.count("*").alias("m"), F.count_if(F.col("score") > 0).alias("p"))
    short = every.join(counts, "query_id", "left").where(F.coalesce("p", F.lit(0)) < k).select("query_id", F.coalesce("m", F.lit(0)).alias("m"))
    most = short.agg(F.max("m")).first()[0]
    if most is None:
        return scored.where("false")
    first = index.lengths.select("key").distinct().orderBy("key").limit(k + most)
    got = first.crossJoin(F.broadcast(short.select("query_id"))).join(scored.where("score <> 0").select("query_id", "key"), ["query_id", "key"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("key")
    return got.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "key", F.lit(0.0).alias("score"))


def l2(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays, in double precision."""
    d = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


class Nearest:
    """The k nearest of the vectors seen so far to each of some query vectors. Distances are cut by a matrix product and measured by differences."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.squares = (queries * queries).sum(1)
        self.best: list[list[tuple[float, object]]] = [[] for _ in queries]

    def add(self, keys: list, rows: np.ndarray) -> None:
        near = (rows * rows).sum(1)[:, None] - 2 * rows @ self.q.T + self.squares
        k = min(self.k, len(rows))
        limit = np.partition(near, k - 1, 0)[k - 1]
        for j, q in enumerate(self.q):
            # what the product rounds away is far below the slack
            at = np.flatnonzero(near[:, j] <= limit[j] + 1e-5 * (1 + abs(limit[j])))
            exact = np.round(np.sqrt(((rows[at] - q) ** 2).sum(1)), PLACES)
            self.best[j] = sorted([*self.best[j], *zip(exact.tolist(), (keys[i] for i in at))])[: self.k]


def vectors(index: DataFrame, queries: DataFrame, k: int = CANDIDATES, block: int = 1000) -> DataFrame:
    """query_id, key, score (distance), rank: the k nearest vectors of each query, exactly.

    index: key, embedding. queries: query_id, embedding. The queries go in blocks of at most `block` vectors, of which the driver
    holds one at a time, to every part of the index; a task keeps its k nearest of each query, and only these are sorted and merged.
    Null vectors take no part; of equal distances the smaller key comes first.
    """
    spark = index.sparkSession
    kind, key = dict(queries.dtypes)["query_id"], dict(index.dtypes)["key"]
    schema = f"query_id {kind}, key {key}, score double"
    names = to_arrow_schema(data_type(f"struct<query_id: {kind}, key: {key}, score: double>"))
    rows = index.where("embedding is not null and key is not null").select("key", "embedding")

    def near(ids: list, vs: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, np.array(vs, np.float64)))  # at most `block` vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = Nearest(sent.value[1], k)
            for b in batches:
                if len(b):
                    got.add(b.column(0).to_pylist(), np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(b), -1))
            out = [(i, key, s) for i, best in zip(sent.value[0], got.best) for s, key in best]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), names)], schema=names)

        return rows.mapInArrow(run, schema)

    asked = queries.where("query_id is not null and embedding is not null").dropDuplicates(["query_id"]).orderBy("query_id").toLocalIterator()
    parts: list[DataFrame] = []
    held: list[Row] = list(islice(asked, block))
    while held or not parts:
        more = list(islice(asked, block))
        got = near([r["query_id"] for r in held], [r["embedding"] for r in held]) if held else rows.limit(0).select(F.lit(None).cast(kind).alias("query_id"), "key", F.lit(0.0).alias("score"))
        parts.append(written(spark, got, "vectors-near") if more or parts else got)
        held = more
    return top_k(reduce(DataFrame.unionByName, parts), k, descending=False)


def fuse(vector: DataFrame, lexical: DataFrame, k: int = CANDIDATES, alpha: float = ALPHA, count_repeats: bool = False) -> DataFrame:
    """query_id, key, score, rank: weighted reciprocal-rank fusion of two ranked lists (query_id, key, rank from 0).

    Order: score, then first place seen (vector list, then lexical list). A key that stands twice in one list counts by its best
    rank, or by each with `count_repeats`.
    """
    if not count_repeats:
        vector, lexical = (x.groupBy("query_id", "key").agg(F.min("rank").alias("rank")) for x in (vector, lexical))
    share = lambda x, w, at: x.select("query_id", "key", F.lit(w).cast("double") / (F.col("rank") + F.lit(RRF))).toDF("query_id", "key", "s").join(
        x.select("query_id", "key", (F.col("rank") + F.lit(at)).alias("first")), ["query_id", "key"]
    )
    if count_repeats:
        parts = [x.groupBy("query_id", "key").agg(F.sum(F.lit(w) / (F.col("rank") + F.lit(RRF))).alias("s"), F.min(F.col("rank") + F.lit(at)).alias("first")) for x, w, at in ((vector, alpha, 0), (lexical, 1 - alpha, 1 << 20))]
    else:
        parts = [share(vector, alpha, 0), share(lexical, 1 - alpha, 1 << 20)]
    v, x = (p.toDF("query_id", "key", f"s{i}", f"f{i}") for i, p in enumerate(parts))
    both = v.join(x, ["query_id", "key"], "full")
    score = F.round(F.coalesce("s0", F.lit(0.0)) + F.coalesce("s1", F.lit(0.0)), 12)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "key")
    got = both.select("query_id", "key", score.alias("score"), F.coalesce("f0", "f1").alias("first"))
    return got.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).withColumn("rank", F.col("__r") - 1).drop("first", "__r")


def hybrid(index: Lexical, embeddings: DataFrame, queries: DataFrame, k: int = CANDIDATES, alpha: float = ALPHA) -> DataFrame:
    """Fused candidates of each query. queries: query_id, text, embedding. k is cut to the number of documents by itself."""
    k = max(1, k)
    return fuse(vectors(embeddings, queries, k), bm25(index, queries, k), k, alpha)


def overlap_score(query: Column | str, text: Column | str) -> Column:
    """Default scorer without a model: share of the query's distinct lower-cased words that the text has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    q = words(query)
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, words(text))) / F.size(q), PLACES)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, k: int = TOP, scorer: Callable[[list[str], list[str]], list[float]] | None = None) -> DataFrame:
    """The k best candidates by a scorer of (query, text) pairs; ties keep the fused order. candidates: query_id, key, rank, query, text.

    The scorer runs above the candidate cut, in Arrow batches; without one, word overlap on the JVM.
    """
    if scorer is None:
        scored = candidates.withColumn("rerank_score", overlap_score("query", "text"))
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(rerank_score=[float(x) for x in scorer(pdf["query"].tolist(), pdf["text"].tolist())])

        schema = ", ".join(f"`{c}` {t}" for c, t in candidates.dtypes) + ", rerank_score double"
        scored = candidates.mapInPandas(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).withColumn("place", F.col("__r") - 1).drop("__r")


def ranking_prompt_rows(candidates: DataFrame) -> DataFrame:
    """Numbered snippets for a listwise model: query_id, lines."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), snippet("text"))
    rows = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("s"))  # bounded by the candidate cut
    return rows.select("query_id", F.array_join("s.l", "\n\n").alias("lines"))


def complete_ranking(ranking: Column | str, n: Column | int, dedupe: bool = True) -> Column:
    """A model's ranking made a permutation of 0..n-1: numbers in range, in order (repeats dropped unless `dedupe` is off), then the missing ones."""
    n = F.lit(n) if isinstance(n, int) else n
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    valid = F.filter(F.coalesce(col(ranking), F.array().cast("array<int>")), lambda x: x.isNotNull() & (x >= 0) & (x < n))
    return F.concat(F.array_distinct(valid) if dedupe else valid, F.array_except(every, valid))


def apply_ranking(candidates: DataFrame, rankings: DataFrame, k: int = TOP, dedupe: bool = True) -> DataFrame:
    """Candidates in the order of a model's ranking (query_id, ranking): place and rerank_score = n - place; queries without one keep their order."""
    n = candidates.groupBy("query_id").agg(F.count("*").cast("int").alias("n")).join(rankings, "query_id", "left")
    order = n.select("query_id", F.posexplode(complete_ranking("ranking", F.col("n"), dedupe)).alias("place", "rank"), "n")
    got = candidates.join(order, ["query_id", "rank"]).where(F.col("place") < k)
    return got.withColumn("rerank_score", (F.col("n") - F.col("place")).cast("double")).drop("n")


def union_rounds(rounds: DataFrame) -> DataFrame:
    """Results of several rounds (query_id, round, place, key) as one list: each key where it was seen first, by round and place."""
    first = rounds.groupBy("query_id", "key").agg(F.min(F.struct("round", "place")).alias("f"))
    w = Window.partitionBy("query_id").orderBy("f.round", "f.place", "key")
    return first.withColumn("position", F.row_number().over(w)).select("query_id", "key", "position", F.col("f.round").alias("round"), F.col("f.place").alias("place"))
