"""Inline citations `[S1]`: found, resolved to the cited passages, grouped by source and renumbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col, strip

# Fixed value: what stands between an answer and its block of sources.
MARKER = "\n\n---\n\n**Sources**\n"


def cited(answer: Column | str, sources: Column | int | None = None) -> Column:
    """Numbers cited in a text, each once, by first occurrence; only 1..sources if given. Longer than nine digits: no citation."""
    found = F.transform(F.regexp_extract_all(F.coalesce(col(answer), F.lit("")), F.lit(r"\[S([0-9]{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    if sources is None:
        return F.array_distinct(found)
    n = F.lit(sources) if isinstance(sources, int) else sources
    return F.array_distinct(F.filter(found, lambda x: x.between(1, n)))


def entries(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Passages that answers cite: answer_id, position (from 1), number, label, quote. answers: answer_id, query_id, answer. context: query_id, place, label, text."""
    nums = answers.select("answer_id", "query_id", F.posexplode(cited("answer")).alias("p", "number"))
    rows = context.select("query_id", (F.col("place") + 1).cast("int").alias("number"), "label", strip(F.coalesce("text", F.lit(""))).alias("quote"))
    got = nums.join(rows, ["query_id", "number"])
    w = Window.partitionBy("answer_id").orderBy("p")
    return got.select("answer_id", F.row_number().over(w).alias("position"), "number", "label", "quote")


def sources_block(found: DataFrame) -> DataFrame:
    """The verbatim block of each answer's sources: answer_id, block. Answers that cite nothing have no row."""
    entry = F.concat(F.lit("[S"), F.col("number").cast("string"), F.lit("] "), F.col("label"), F.lit("\n\n> "), F.col("quote"), F.lit("\n"))
    rows = found.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("position", entry.alias("e")))).alias("e"))  # bounded by the context
    return rows.select("answer_id", F.concat(F.lit(MARKER), F.lit("\n"), F.array_join("e.e", "\n")).alias("block"))


def split_block(content: Column | str) -> Column:
    """struct(visible, entries) of an answer with its block: entries are structs (number, label, quote)."""
    c = F.coalesce(col(content), F.lit(""))
    at = F.instr(c, MARKER)
    visible = F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)
    block = F.when(at > 0, F.substring(c, at + len(MARKER), F.length(c))).otherwise(F.lit(""))
    one = r"(?s)\[S([0-9]{1,9})\]\s+([^\n]+)\n\n>\s*(.*?)(?=\n\n\[S[0-9]+\]|\z)"
    whole = F.regexp_extract_all(block, F.lit(one), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, one, k)
    got = F.transform(whole, lambda x: F.struct(part(x, 1).cast("int").alias("number"), strip(part(x, 2)).alias("label"), strip(part(x, 3)).alias("quote")))
    return F.struct(visible.alias("visible"), got.alias("entries"))


def groups(found: DataFrame) -> DataFrame:
    """Sources numbered by first citation, one number for one label: answer_id, number, group_no, label, quote, position."""
    first = found.groupBy("answer_id", "label").agg(F.min("position").alias("first"))
    w = Window.partitionBy("answer_id").orderBy("first")
    numbered = first.select("answer_id", "label", F.row_number().over(w).alias("group_no"))
    return found.join(numbered, ["answer_id", "label"]).select("answer_id", "number", "group_no", "label", "quote", "position")


def renumber(answers: DataFrame, grouped: DataFrame) -> DataFrame:
    """answer_id, answer with `[S3]` replaced by its group's `[1]`; tags without a passage stay; adjacent markers get a blank between."""
    maps = grouped.groupBy("answer_id").agg(F.collect_list(F.struct("number", "group_no")).alias("m"))
    text = F.aggregate(
        F.coalesce("m", F.array().cast("array<struct<number:int,group_no:int>>")), F.coalesce("answer", F.lit("")),
        lambda acc, x: F.replace(acc, F.concat(F.lit("[S"), x["number"].cast("string"), F.lit("]")), F.concat(F.lit("["), x["group_no"].cast("string"), F.lit("]"))),
    )
    spaced = F.regexp_replace(text, r"\](?=\[[0-9]+\])", "] ")
    return answers.join(maps, "answer_id", "left").select("answer_id", F.rtrim(spaced, F.lit("\t\n\x0b\f\r ")).alias("answer"))
