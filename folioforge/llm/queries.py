"""Queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import body, bpe, lang, leak, lines, markup, neardup, split, truncation
from .common import table


def _chunks(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: fn(table(spark, d, "chunks"))


def _documents(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: fn(table(spark, d, "documents"))


def _leaks(fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: fn(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return body.page_lines(table(spark, d, "chunks")).where(~F.col("is_body")).select("id", "line_no").distinct()


def p1_body(spark: SparkSession, d: str) -> DataFrame:
    """Body lines of each page's chunks, in order: id, line_no, line."""
    return body.page_lines(table(spark, d, "chunks")).where("is_body").select("id", "line_no", "line").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_body": p1_body,
        "p2_found": _chunks(lang.found),
        "p2_documents": _chunks(lang.documents),
        "p2_segments": _chunks(lang.segments),
        "p3_found": _chunks(markup.found),
        "p3_clean": _chunks(markup.cleaned),
        "p4_found": _chunks(split.found),
        "p4_pieces": _chunks(split.pieces),
        "p5_found": _chunks(lines.found),
        "p5_clean": _chunks(lines.cleaned),
        "p5_templates": _chunks(lines.templates),
        "p6_found": _chunks(neardup.found),
        "p6_groups": _chunks(neardup.groups),
        "p7_ids": lambda spark, d: bpe.encode(table(spark, d, "documents")),
        "p8_found": _leaks(leak.found),
        "p8_leaks": _leaks(leak.leaks),
        "p8_report": _leaks(leak.report),
        "p9_found": _documents(truncation.found),
        "p9_shares": _documents(truncation.shares),
    }


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
