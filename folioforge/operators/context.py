"""Source labels and size-bounded contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, col, strip

#: Characters of a context, and of brackets and line ends that each section is charged for beforehand.
MAX_CHARS, FRAME = 60_000, 8
# Style values that say nothing.
PLAIN_STYLES = ("", "none", "rgba(0, 0, 0, 0)")
_WS = "\t\n\x0b\f\r "


def source_label(name: Column | str, page_start: Column | str, page_end: Column | str) -> Column:
    """`file.pdf, page 3`; `pages a-b` where they differ; `page unknown` for null and 0. A null name is `source`."""
    a, b = (F.coalesce(col(x).cast("int"), F.lit(0)) for x in (page_start, page_end))
    pages = (
        F.when((a != 0) & (b != 0) & (a != b), F.concat(F.lit("pages "), a.cast("string"), F.lit("-"), b.cast("string")))
        .when(a != 0, F.concat(F.lit("page "), a.cast("string")))
        .otherwise(F.lit("page unknown"))
    )
    return F.concat(basename(F.coalesce(F.when(col(name) != "", col(name)), F.lit("source"))), F.lit(", "), pages)


def long_label(rank: Column | str, *parts: Column | str) -> Column:
    """`Source 1 | part | part`: null parts are left out."""
    return F.concat_ws(" | ", F.concat(F.lit("Source "), (col(rank) + 1).cast("string")), *[col(p).cast("string") for p in parts])


def style_note(tag: Column | str, styling: Column | str) -> Column:
    """` [HTML_TAG: p | CSS: color: red; …]`, or an empty string without a tag or any style that says something."""
    said = F.filter(F.map_entries(col(styling)), lambda e: e["value"].isNotNull() & ~e["value"].isin(*PLAIN_STYLES))
    css = F.array_join(F.transform(said, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    note = F.concat(F.lit(" [HTML_TAG: "), col(tag), F.lit(" | CSS: "), css, F.lit("]"))
    return F.when((F.coalesce(col(tag), F.lit("")) != "") & (F.coalesce(css, F.lit("")) != ""), note).otherwise(F.lit(""))


def pack(ranked: DataFrame, max_chars: int = MAX_CHARS, note: str | None = None, prefix: str = "Source S") -> DataFrame:
    """One context a query from ranked texts (query_id, place from 0, label, text): query_id, context, included, used_chars.

    Each section is `[Source Si: label]` and its text; a text that doesn't fit is cut, its end stripped and marked `...`; the first
    header that finds no room ends the context. Blank lines between sections aren't charged. Only results after the top-k cut are
    gathered, so an array is bounded. Null texts count as empty.
    """
    head = F.concat(F.lit(prefix), (F.col("place") + 1).cast("string"), F.lit(": "), F.coalesce("label", F.lit("")))
    extra = F.coalesce(F.col(note), F.lit("")) if note else F.lit("")
    rows = ranked.select("query_id", F.struct("place", F.concat(head, extra).alias("h"), strip(F.coalesce("text", F.lit(""))).alias("t")).alias("s"))
    rows = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    zero = F.struct(F.lit(0).alias("used"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        room = F.lit(max_chars) - acc["used"] - F.length(x["h"]) - FRAME
        text = F.when(F.length(x["t"]) > room, F.concat(F.rtrim(F.substring(x["t"], F.lit(1), room), F.lit(_WS)), F.lit("..."))).otherwise(x["t"])
        section = F.concat(F.lit("["), x["h"], F.lit("]\n"), text)
        more = F.struct((acc["used"] + F.length(section)).alias("used"), F.lit(False).alias("done"), F.concat(acc["out"], F.array(section)).alias("out"))
        stop = F.struct(acc["used"].alias("used"), F.lit(True).alias("done"), acc["out"].alias("out"))
        return F.when(acc["done"] | (room <= 0), stop).otherwise(more)

    rows = rows.select("query_id", F.aggregate("s", zero, step).alias("a"))
    return rows.select("query_id", F.array_join("a.out", "\n\n").alias("context"), F.size("a.out").alias("included"), F.col("a.used").alias("used_chars"))
