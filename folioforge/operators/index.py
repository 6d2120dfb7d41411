"""Lexical and vector indexes as plain tables: postings, document lengths, term statistics, corpus statistics, vectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS, embed_text
from ..storage import written

#: Constants of the ranking function: saturation, length normalisation, floor of a negative weight as a share of the mean.
K1, B, EPSILON = 1.5, 0.75, 0.25


#: Folders of stored postings, and parts in which the postings of one folder are written.
BUCKETS, SPLIT = 64, 4


def bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Embedder:
    """Settings of an embedding model: dimensions and texts a request."""

    name: str
    dims: int
    batch: int


# Models by name.
EMBEDDERS = {e.name: e for e in (Embedder("local", 384, 64), Embedder("remote", 1536, 512), Embedder("precomputed", 64, 1024))}


def embedder(name: str, default: str = "local") -> Embedder:
    """Settings of a model; those of the default for an unknown name, under that name."""
    e = EMBEDDERS.get(name)
    return e or Embedder(name, EMBEDDERS[default].dims, EMBEDDERS[default].batch)


def index_path(base: str, corpus: str, model: str) -> str:
    """Folder of the index of one corpus for one model."""
    key = re.sub("[^a-z0-9]+", "_", model.lower()).strip("_")
    return f"{base.rstrip('/')}/index={corpus}/model={key}"


@dataclass
class Lexical:
    """Tables of a lexical index: postings(term, key, tf), lengths(key, dl), terms(term, df, idf), corpus(n, avgdl)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def write(self, path: str) -> Lexical:
        """Write the tables under `path`, the postings in BUCKETS folders by the hash of their term and sorted by term, so that a query
        reads only the folders, and of these the row groups, of its terms."""
        spark = self.postings.sparkSession
        rows = self.postings.drop("bucket").withColumn("bucket", bucket("term"))
        # a frequent term's postings may fill several tasks: documents are dealt over SPLIT parts of each bucket
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SPLIT)))
        dealt.sortWithinPartitions("bucket", "term", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        for name in ("lengths", "terms", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        return Lexical.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Lexical:
        lengths, terms, corpus = (spark.read.parquet(f"{path}/{n}") for n in ("lengths", "terms", "corpus"))
        schema = f"term string, key {dict(lengths.dtypes)['key']}, tf int, bucket int"  # given, as an empty index has no folders
        return Lexical(spark.read.schema(schema).parquet(f"{path}/postings"), lengths, terms, corpus)


def lexical(docs: DataFrame, key: str = "doc_id", text: str = "text", store: bool = True) -> Lexical:
    """Index of all documents by the tokens between white space, case kept. Null texts count as empty documents of length 0; repeated keys add up.

    The tables are written to the shared folder as they are made, so that each is computed once; `store=False` leaves them lazy.
    """
    keep = (lambda df, name: written(docs.sparkSession, df, f"index-{name}")) if store else (lambda df, name: df)
    d = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.split(F.coalesce(text, F.lit("")), f"{WS}+").alias("t"))
    d = d.select("key", F.filter("t", lambda x: x != "").alias("t"))
    lengths = d.groupBy("key").agg(F.sum(F.size("t")).cast("int").alias("dl"))
    lengths = keep(lengths, "lengths")
    postings = d.select("key", F.explode("t").alias("term")).groupBy("term", "key").agg(F.count("*").cast("int").alias("tf"))
    postings = keep(postings, "postings")
    corpus = keep(lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "corpus")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(corpus.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # one row
    return Lexical(postings, lengths, keep(terms, "terms"), corpus)


def embedded(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: Embedder, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, embedding) by a model called with batches of texts; blank texts are sent as a blank. Runs in Arrow batches, in any order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), model.batch):
                part = pdf.iloc[a : a + model.batch]
                yield pd.DataFrame({"key": part["key"].tolist(), "embedding": embed(part["text"].tolist())})

    rows = docs.select(F.col(key).alias("key"), embed_text(text).alias("text"))
    return rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, embedding array<float>")


def fingerprint(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row, `fingerprint`: a digest of the files' paths, sizes and lines. Files of any size are read in splits; only sums of hashes meet."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.xxhash64("value").cast("decimal(38,0)").alias("h"), F.xxhash64(F.lit(1), "value").cast("decimal(38,0)").alias("g"))
    files = lines.groupBy("path", "size").agg(F.sum("h").alias("h"), F.sum("g").alias("g"), F.count("*").alias("n"))
    each = [F.xxhash64(F.lit(k), "path", "size", F.col("h").cast("string"), F.col("g").cast("string"), "n").cast("decimal(38,0)") for k in range(2)]
    return files.agg(F.sha2(F.concat_ws(" ", F.count("*").cast("string"), *[F.coalesce(F.sum(x), F.lit(0)).cast("string") for x in each]), 256).alias("fingerprint"))


def stale(meta: DataFrame | None, current: str, model: str, rebuild: bool = False) -> bool:
    """Whether an index must be built again: none there, other files, other model, or asked for."""
    row = None if meta is None or rebuild else meta.select("chunk_fingerprint", "embedding_model").first()
    return row is None or row["chunk_fingerprint"] != current or row["embedding_model"] != model


def meta(spark: SparkSession, name: str, directory: str, paths: list[str], count: int, digest: str, model: str) -> DataFrame:
    row = (name, directory, paths, count, digest, model)
    return spark.createDataFrame([row], "index_name string, ingested_data_dir string, chunk_paths array<string>, chunk_count bigint, chunk_fingerprint string, embedding_model string")
