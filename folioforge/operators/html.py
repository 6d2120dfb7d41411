"""Main content of web pages: elements from the parser, all decisions in the plan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.parsers import ELEMENT, page_elements
from ..types import data_type
from .prefix import running

#: Least characters of a block; highest share of linked text of a list entry and of other blocks.
LEAST_CHARS, LI_DENSITY, DENSITY = 5, 0.85, 0.50


def page_blocks(pages: DataFrame, key: str = "doc_key", html: str = "html", frame: str | None = None) -> DataFrame:
    """Elements of each page's container: doc_key, frame, ord, tag, text, text_len, link_len, in_table, in_li, pruned, styling, table_rows.

    Pages stream through Python in Arrow batches, each parsed once. A page that the parser can't read gives no element."""
    rows = pages.select(F.col(key).alias("doc_key"), (F.col(frame) if frame else F.lit(0)).cast("int").alias("frame"), F.col(html).alias("html"))
    kind = dict(rows.dtypes)["doc_key"]
    kinds = to_arrow_schema(data_type(f"struct<doc_key: {kind}, frame: int, {ELEMENT}>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(len(b)):
                try:
                    got = page_elements(b.column(2)[at].as_py())
                except (ValueError, AssertionError, RecursionError):
                    continue
                if got:
                    own = {"doc_key": b.column(0)[at].as_py(), "frame": b.column(1)[at].as_py()}
                    yield pa.RecordBatch.from_pylist([own | {k: list(v.items()) if isinstance(v, dict) else v for k, v in e.items()} for e in got], kinds)

    return rows.mapInArrow(run, f"doc_key {kind}, frame int, {ELEMENT}")


def main_blocks(found: DataFrame) -> DataFrame:
    """Blocks that are content: not pruned, long enough, not nested in a table or a list entry's paragraph, not mostly links; of equal texts
    of a page the first that passed (a table without rows hides later copies but is no block itself)."""
    density = F.col("link_len") / F.col("text_len")
    ok = (
        ~F.col("pruned")
        & (F.col("text_len") >= LEAST_CHARS)
        & ((F.col("tag") == "table") | ~F.col("in_table"))
        & ~((F.col("tag") == "p") & F.col("in_li"))
        & ((F.col("tag") == "table") | (density <= F.when(F.col("tag") == "li", F.lit(LI_DENSITY)).otherwise(F.lit(DENSITY))))
    )
    w = Window.partitionBy("doc_key", "frame", F.xxhash64("text"), "text").orderBy("ord")
    first = found.where(ok).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return first.where((F.col("tag") != "table") | (F.size("table_rows") > 0))


def chunks(pages: DataFrame, key: str = "doc_key", html: str = "html", frame: str | None = None) -> DataFrame:
    """One chunk for each content block: id, text, content, chunk_type (table, heading, text), html_tag, styling (of the style attribute), table_rows.

    Null, empty and containerless pages give none. Pages of several frames are joined in the order of the frame number.
    """
    b = main_blocks(page_blocks(pages, key, html, frame)).withColumn("o", F.col("frame").cast("long") * F.lit(1 << 24) + F.col("ord"))
    b = running(b, "doc_key", "o", sums={"n": F.lit(1)}, blocked=False)  # a page is one value of one row
    kind = F.when(F.col("tag") == "table", "table").when(F.col("tag").startswith("h"), "heading").otherwise("text")
    return b.select(
        F.format_string("%s:%05d", "doc_key", F.col("n").cast("int")).alias("id"), "doc_key", "text", F.col("text").alias("content"), kind.alias("chunk_type"),
        F.col("tag").alias("html_tag"), "styling", "table_rows", F.lit("html").alias("parser"), F.lit(True).alias("embed"),
    )
