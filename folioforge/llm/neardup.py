"""Problem 6: near-duplicate chunks (segment-popcount embedding, grid range-join under Manhattan distance, exact check)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_CLASSES, WORD, slices, text_chunks, texts_of, written
from .shingles import Signer

#: Words of a shingle, least words of a chunk, least share of common shingles.
WIDTH, LEAST_WORDS, SIMILARITY = 3, 40, 0.7
#: Segments of the embedding, BITS bits each and 21 to a long; bands and rows of the cells in which the range-join runs.
SEGMENTS, BITS, BANDS, ROWS = 63, 3, 20, 5
#: Rows of a cell that one task joins with the whole cell; of the classes one in so many tells which cells are larger.
LARGE, SAMPLED = 2000, 8
#: Members of a class of exact copies that are paired with each other; a larger class is linked through its least id.
ALL_PAIRS = 24


def embedded(chunks: DataFrame, width: int, least_words: int) -> DataFrame:
    """Each class of exact copies once: c (class), n (shingles), v0 to v2 (segment counts), cells.

    A fingerprint is the bit set of a chunk's shingle hashes; v0 to v2 hold how many of its bits lie in each of SEGMENTS segments,
    21 counts each. The Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints, that is the
    number of shingles in which the chunks differ; counts are kept modulo 8 and their distance is taken around that circle, which
    can only lower it.
    """
    rows = text_chunks(chunks).select("chunk_type", "body").withColumn("c", F.xxhash64("chunk_type", "body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(width, BANDS, ROWS, SEGMENTS)
        for b in (x.slice(i, j - i) for x in batches for i, j in slices(x.column(1).to_pylist())):
            at, s, starts = signer.sets(b.column(1).to_pylist(), least_words)
            if not at:
                continue
            take = pa.array(at)
            counts = (signer.counts(s, starts) % (1 << BITS)).astype(np.uint64).reshape(len(at), SEGMENTS // 21, 21)
            packed = (counts << (np.arange(21, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64).view(np.int64)
            kind = np.array([zlib.crc32((t or "").encode()) for t in b.column(0).take(take).to_pylist()], np.int64)
            keys = signer.keys(s, starts) ^ (kind << 20)[:, None]  # chunks of different types share no cell
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
            sizes = pa.array(np.diff([*starts, len(s)]).astype(np.int32))
            vs = [pa.array(np.ascontiguousarray(packed[:, k])) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(2).take(take), sizes, *vs, cells], ["c", "n", "v0", "v1", "v2", "cells"])

    return rows.mapInArrow(run, "c bigint, n int, v0 bigint, v1 bigint, v2 bigint, cells array<bigint>").dropDuplicates(["c"])


def manhattan(a: str, b: str) -> str:
    """Manhattan distance of two packed embeddings, in plain arithmetic on the JVM."""
    terms = []
    mask, circle = (1 << BITS) - 1, 1 << BITS
    for v in ("v0", "v1", "v2"):
        for k in range(0, 21 * BITS, BITS):
            # distance around the circle from one difference: (d + half) mod circle lies as far from half as d from 0
            d = f"(shiftrightunsigned({a}.{v}, {k}) - shiftrightunsigned({b}.{v}, {k}) + {circle // 2}) & {mask}"
            terms.append(f"abs(({d}) - {circle // 2})")
    return " + ".join(terms)


def _dealt(cells: DataFrame, emb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join within cells, with `part`: large cells are dealt over parts on one side and repeated for each part on the other.

    Which cells are large is told by the texts whose class is divisible by SAMPLED. Every pair meets once whatever that tells; only
    the size of the tasks depends on it.
    """
    some = emb.where(F.pmod("c", F.lit(SAMPLED)) == 0).select(F.explode("cells").alias("cell"))
    large = some.groupBy("cell").agg(F.ceil(F.count("*") * SAMPLED / F.lit(LARGE)).cast("int").alias("parts")).where("parts > 1")
    large = written(emb.sparkSession, large, "neardup-large")
    n = large.count()
    if not n:
        return cells.withColumn("part", F.lit(0)), cells.withColumn("part", F.lit(0))
    rows = cells.join(F.broadcast(large) if n <= BROADCAST_CLASSES else large, "cell", "left")
    dealt = rows.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")))
    return dealt.drop("parts"), rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def candidates(emb: DataFrame, similarity: float) -> DataFrame:
    """Pairs of classes that share a cell and pass both lower bounds: a, b (a < b).

    At similarity t two sets of n and m shingles differ in at most (1 - t) / (1 + t) * (n + m) of them, so pairs whose sizes or
    embeddings are farther apart than that can't reach it and are dropped inside the join. Both sides are one exchange unless a cell
    is large.
    """
    emb = written(emb.sparkSession, emb, "neardup-embedded")
    x, y = _dealt(emb.select("c", "n", "v0", "v1", "v2", F.explode("cells").alias("cell")), emb)
    share = (1 - similarity) / (1 + similarity)
    near = F.expr(
        f"x.cell = y.cell and x.part = y.part and x.c < y.c and least(x.n, y.n) >= {similarity!r}D * greatest(x.n, y.n) - 1e-9D "
        f"and {manhattan('x', 'y')} <= {share!r}D * (x.n + y.n) + 1e-9D"
    )
    return x.alias("x").join(y.alias("y"), near).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()


def _texts(chunks: DataFrame) -> DataFrame:
    """Class of exact copies (c, and d, a second hash that keeps texts apart whose first is the same), id, body."""
    return text_chunks(chunks).select(F.xxhash64("chunk_type", "body").alias("c"), F.xxhash64(F.lit(1), "chunk_type", "body").alias("d"), "id", "body")


def links(chunks: DataFrame, width: int = WIDTH, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Verified pairs of classes of exact copies: a, b (a < b; classes are numbers), ad, bd (their second hashes), similarity."""
    pairs = candidates(embedded(chunks, width, least_words), similarity)
    pairs = written(chunks.sparkSession, pairs, "neardup-candidates")
    texts = texts_of(chunks.sparkSession, _texts(chunks).select("c", "d", "body"), pairs, ("c", "d"))
    of = lambda k: texts.select(F.col("c").alias(k), F.col("d").alias(f"{k}d"), F.col("body").alias(f"t{k}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def shingles(t: str) -> set:
            w = WORD.findall(t.lower())
            return set(zip(*(w[k:] for k in range(width))))

        for pdf in batches:
            out = []
            for x, y, xd, yd, tx, ty in zip(pdf["a"], pdf["b"], pdf["ad"], pdf["bd"], pdf["ta"], pdf["tb"]):
                s, t = shingles(tx), shingles(ty)
                n = len(s & t)
                j = n / max(1, len(s) + len(t) - n)
                if j >= similarity:
                    out.append((x, y, xd, yd, j))
            yield pd.DataFrame(out, columns=["a", "b", "ad", "bd", "similarity"])

    return both.select("a", "b", "ad", "bd", "ta", "tb").mapInPandas(run, "a bigint, b bigint, ad bigint, bd bigint, similarity double")


def members(chunks: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(c, d, id) of each chunk that takes part: its class of exact copies. Words are counted here as runs of letters and digits."""
    words = F.size(F.regexp_extract_all(F.col("body"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return _texts(chunks).where(words >= least_words).select("c", "d", "id").distinct()


def found(chunks: DataFrame, width: int = WIDTH, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of near-duplicate chunks: id_a, id_b (id_a < id_b).

    Chunks without id, of fewer words or blank take no part; rows delivered again count once. Pairs between different texts are
    given for every member of both classes; exact copies are paired with one another up to ALL_PAIRS members of a class, and
    beyond that each with the least id of the class, so that no group is emitted as a square and no link is lost.
    """
    own = written(chunks.sparkSession, members(chunks, least_words), "neardup-members")
    ls = written(chunks.sparkSession, links(chunks, width, least_words, similarity), "neardup-links")
    heads = own.groupBy("c", "d").agg(F.min("id").alias("head"), F.count("*").alias("size"))
    # a class larger than ALL_PAIRS stands in the pairs between classes with its head only; its members are linked to the head
    big = heads.where(F.col("size") > ALL_PAIRS)
    ends = own.join(big.select("c", "d", "head"), ["c", "d"], "left").where(F.col("head").isNull() | (F.col("head") == F.col("id"))).select("c", "d", "id")
    between = ls.select("a", "ad", "b", "bd").join(ends.toDF("a", "ad", "x"), ["a", "ad"]).join(ends.toDF("b", "bd", "y"), ["b", "bd"]).select("x", "y")
    copies = heads.where(F.col("size") > 1)
    small = own.join(copies.where(F.col("size") <= ALL_PAIRS).select("c", "d"), ["c", "d"])
    within = small.toDF("c", "d", "x").join(small.toDF("c", "d", "y"), ["c", "d"]).where(F.col("x") < F.col("y")).select("x", "y")
    star = own.join(big.select("c", "d", "head"), ["c", "d"]).where(F.col("id") != F.col("head")).select(F.col("head").alias("x"), F.col("id").alias("y"))
    every = between.unionByName(within).unionByName(star)
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): (node, root), root being the least node. All on the cluster.

    Each node points to a lower one of its component. In a round the least grandparent among the neighbours of a node is handed to the
    node and to its parent, and the node is moved up to its own grandparent, so whole trees are hooked onto lower ones while they get
    flatter (simulated on chains in sorted and random order: 11 or 12 rounds for 1,000 nodes, 21 or 22 for 1,000,000). It ends when
    a round changes nothing; each round is written to the shared folder.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(spark, both, "components-edges")
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    label = written(spark, label, "components-0")
    changed, k = True, 0
    while changed:
        k += 1
        up = label.join(label.select(F.col("node").alias("root"), F.col("root").alias("top")), "root")
        up = written(spark, up.select("node", "root", "top"), f"components-up-{k}")
        near = both.join(up.select(F.col("node").alias("b"), "top"), "b").groupBy("a").agg(F.min("top").alias("m"))
        near = up.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("top", "m").alias("to"))
        hooks = near.groupBy(F.col("root").alias("node")).agg(F.min("to").alias("hook"))
        step = near.join(hooks, "node", "left").select("node", "root", F.least("root", "to", "hook").alias("new"))
        step = written(spark, step, f"components-{k}")
        changed = step.where(F.col("new") != F.col("root")).limit(1).count() > 0
        label = step.select("node", F.col("new").alias("root"))
    return label


def groups(chunks: DataFrame, width: int = WIDTH, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each chunk that has a near copy: id, group_id (the least id of its group), links (classes it is linked to), copies (exact copies)."""
    name = lambda c, d: F.concat_ws("-", F.hex(c), F.hex(d))
    ls = written(chunks.sparkSession, links(chunks, width, least_words, similarity).select(name("a", "ad").alias("a"), name("b", "bd").alias("b")), "neardup-links")
    own = written(chunks.sparkSession, members(chunks, least_words).select(name("c", "d").alias("c"), "id"), "neardup-members")
    degree = ls.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").cast("int").alias("links"))
    sizes = own.groupBy("c").agg((F.count("*") - 1).cast("int").alias("copies"))
    comp = components(ls).withColumnRenamed("node", "c")
    rows = own.join(sizes, "c").join(degree, "c", "left").join(comp, "c", "left").where(F.col("links").isNotNull() | (F.col("copies") > 0))
    rows = rows.select("id", F.coalesce("root", "c").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    least = rows.groupBy("root").agg(F.min("id").alias("group_id"))
    return rows.join(least, "root").select("id", "group_id", "links", "copies")
