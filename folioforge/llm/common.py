"""Shared parts of the training-text operators: inputs, sorted group scans, shared storage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written

WORD = re.compile(r"[^\W_]+")
BLANK = r"(?U)\S"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_text(text: str = "text", content: str = "content") -> Column:
    """The text of a chunk: `text`, or `content` where text is null or white space only."""
    return F.when(F.col(text).rlike(BLANK), F.col(text)).otherwise(F.col(content))


def text_chunks(chunks: DataFrame) -> DataFrame:
    """Rows of text chunks of PDFs that have an id, with the effective text as `body`."""
    return chunks.where(
        F.col("id").isNotNull() & F.col("source_pdf").isNotNull() & F.col("chunk_type").isin("chapter_text", "text")
    ).withColumn("body", chunk_text())


#: Classes whose texts are picked by a broadcast (eight bytes each); more are picked by a shuffled join.
BROADCAST_CLASSES = 2_000_000


def texts_of(spark: SparkSession, texts: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("c",)) -> DataFrame:
    """One row of `texts` (c and a text) for each class that stands in `pairs` (a, b), written to the shared folder; `keys` tell classes whose hashes are equal.

    The classes are counted first: up to BROADCAST_CLASSES they are broadcast, so that only wanted texts are shuffled."""
    wanted = written(spark, pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "wanted")
    few = wanted.count() <= BROADCAST_CLASSES
    got = texts.join(F.broadcast(wanted) if few else wanted, "c", "left_semi").dropDuplicates(list(keys))
    return written(spark, got, "wanted-texts")


def scan_groups(
    df: DataFrame, keys: list[str], order: list[str], fn: Callable[[tuple, dict[str, list]], Iterator[tuple]], schema: str, most: int
) -> DataFrame:
    """Apply `fn(key, columns)` to each group of `keys`, its rows sorted by `order`, as one linear scan.

    One exchange on the keys, one sort, then an Arrow stream; only the group in hand is in memory. Callers split large groups by a
    key of their own; a group that still has more than `most` rows is handed over in pieces of so many.
    """
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out_names = [x.split()[0] for x in schema.split(", ")]
        held: dict[str, list] = {c: [] for c in names}
        at = None

        def flush(out: list) -> None:
            if at is not None:
                out.extend(fn(at, held))

        for pdf in batches:
            out: list = []
            cols = {c: pdf[c].tolist() for c in names}
            ks = list(zip(*(cols[k] for k in keys)))
            n, i = len(ks), 0
            while i < n:
                j = i + 1
                while j < n and ks[j] == ks[i]:
                    j += 1
                if ks[i] != at:
                    flush(out)
                    held, at = {c: [] for c in names}, ks[i]
                while i < j:
                    k = min(j, i + most - len(held[names[0]]))
                    for c in names:
                        held[c].extend(cols[c][i:k])
                    i = k
                    if i < j:
                        flush(out)
                        held = {c: [] for c in names}
            if out:
                yield pd.DataFrame(out, columns=out_names)
        out = []
        flush(out)
        if out:
            yield pd.DataFrame(out, columns=out_names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


#: Characters of text that a Python worker takes in hand at once.
SLICE_CHARS = 4_000_000


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of an Arrow batch of at most `chars` characters (or one text), so that long texts don't pile up in a worker."""
    a = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > chars:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(texts):
        yield a, len(texts)


def seq_block(id_col: str = "id", rows: int = 4096) -> Column:
    """Block number of a chunk within its source, from the running number at the end of its id.

    A source of any size falls into blocks of at most about `rows` chunks, so no group is unbounded."""
    return F.coalesce(F.expr(f"try_cast(regexp_extract({id_col}, '([0-9]{{1,9}})$', 1) as int)"), F.lit(0)) / F.lit(rows)


def hash64(words: list[str], seen: dict[str, int], salt: bytes = b"") -> np.ndarray:
    """Stable 64-bit hashes of words, cached in `seen` (cleared when it outgrows its bound)."""
    import xxhash

    if len(seen) > 2_000_000:
        seen.clear()
    get = seen.get
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = seen[w] = xxhash.xxh64_intdigest(salt + w.encode("utf-8", "surrogatepass"))
        out[i] = h
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
