"""Outputs of an external layout parser as blocks: nested or flat content lists, else Markdown."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import blocks
from ..schema import BLOCK, conform

#: Order of preference of the kinds of output.
KINDS = ("nested", "flat", "markdown")


def kind_of(path: str = "path", value: str = "value"):
    """Kind of an output by its name and content, or null."""
    is_json = F.lower(path).endswith(".json")
    flat = F.col(value).rlike(r"^\s*\[\s*(\]|\{)")
    return F.when(is_json & blocks.is_v2(value), KINDS[0]).when(is_json & flat, KINDS[1]).when(F.lower(path).rlike(r"\.(md|markdown)$"), KINDS[2])


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, value: each file as one text."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def from_flat(lists: DataFrame, key: str = "doc_key", text: str = "json") -> DataFrame:
    """Blocks of flat content lists (one JSON text a document). Malformed texts give none; members that are no object are left out, as are unknown fields; a single caption counts as a list of one."""
    fields = [f for f in BLOCK if f.name not in ("doc_key", "ord", "block_type")]
    is_list = {f.name for f in fields if f.dataType.simpleString() == "array<string>"}
    schema = "struct<type: string, " + ", ".join(f"{f.name}: {'string' if f.name in is_list else f.dataType.simpleString()}" for f in fields) + ">"
    rows = lists.select(F.col(key).alias("doc_key"), F.posexplode(F.from_json(text, "array<string>")).alias("ord", "item")).where(F.col("item").rlike(r"^\s*\{"))
    rows = rows.select("doc_key", "ord", F.from_json("item", schema).alias("b"))
    many = lambda c: F.when(c.rlike(r"^\s*\["), F.from_json(c, "array<string>")).when(c.isNotNull(), F.array(c))
    value = lambda n: many(F.col(f"b.{n}")) if n in is_list else F.col(f"b.{n}")
    return conform(rows.select("doc_key", "ord", F.col("b.type").alias("block_type"), *[value(f.name).alias(f.name) for f in fields]), BLOCK)


def load_blocks(outputs: DataFrame) -> DataFrame:
    """Blocks of each document from the best of its outputs (doc_key, path, value): nested list, flat list, Markdown; none gives no block."""
    rank = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    w = Window.partitionBy("doc_key").orderBy(rank, "path")
    best = outputs.withColumn("kind", kind_of()).where("kind is not null").withColumn("k", F.row_number().over(w)).where("k = 1")
    of = lambda k: best.where(F.col("kind") == k).select("doc_key", F.col("value").alias("json"))
    md = blocks.from_markdown(of("markdown"), text="json")
    return blocks.from_v2(of("nested")).unionByName(from_flat(of("flat"))).unionByName(conform(md, BLOCK))


def page_texts(texts: DataFrame, stem: str = "stem", value: str = "value") -> DataFrame:
    """Pages of the texts that a PDF reader gives, a form feed between pages: stem, page_idx (from 0), text. Files come from `read_texts`."""
    return texts.where(F.col(value).isNotNull()).select(F.col(stem).alias("stem"), F.posexplode(F.split(value, "\f", -1)).alias("page_idx", "text"))


def parse_range(s: str | None) -> tuple[int | None, int | None]:
    """A zero-based page range `a:b`, `a-b` or `a,b`; either side may be missing; blank: all pages."""
    if not s or not s.strip():
        return None, None
    m = re.fullmatch(r"\s*(\d*)\s*[:,-]\s*(\d*)\s*", s)
    if not m:
        raise ValueError(f"no page range: {s!r}")
    return tuple(int(x) if x else None for x in m.groups())


def run_parser(files: DataFrame, parse: Callable[[str], str | None]) -> DataFrame:
    """Run an external parser for each file (doc_key, path) on the executors: doc_key, path, value (its output), error.

    `parse` takes a path and gives the output's text; what it raises becomes the row's error and stops no other file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, p in zip(pdf["doc_key"], pdf["path"]):
                try:
                    out.append((k, p, parse(p), None))
                except Exception as e:
                    out.append((k, p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_key", "path", "value", "error"])

    return files.select("doc_key", "path").mapInPandas(run, "doc_key string, path string, value string, error string")
