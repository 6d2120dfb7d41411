"""Tables: Markdown and HTML bodies to grids, grids to Markdown and to rows of keys and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.parsers import table_grid
from ..functions.text import col, normalize_space, strip

# Fixed value: the row under a Markdown header, of at least two columns.
SEPARATOR = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"
EMPTY_GRID = "array<array<string>>"


def normalize_rows(rows: Column | str) -> Column:
    """Cells normalised, rows without anything dropped, all rows padded to the widest."""
    clean = F.filter(F.transform(col(rows), lambda r: F.transform(r, lambda c: normalize_space(c))), lambda r: F.exists(r, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(clean, F.size)), F.lit(0))
    return F.transform(clean, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def markdown_rows(body: Column | str) -> Column:
    """Rows of a Markdown table: lines with a pipe, without separator rows, one outer pipe off each end. Escaped pipes split too."""
    lines = F.filter(F.transform(F.split(F.coalesce(col(body), F.lit("")), "\r\n|\n|\r"), strip), lambda s: s.contains("|") & ~s.rlike(SEPARATOR))
    return F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(F.regexp_replace(s, r"^\|", ""), r"\|$", ""), r"\|", -1), lambda c: normalize_space(c)))


def is_html(body: Column | str) -> Column:
    low = F.lower(col(body))
    return low.contains("<table") | low.contains("<tr")


def rows_of(body: Column | str) -> Column:
    """Grid of a table body, HTML or Markdown; empty for null and blank bodies. Only HTML bodies are sent to Python with their text."""
    body = F.coalesce(col(body), F.lit(""))
    return F.when(is_html(body), table_grid(F.when(is_html(body), body))).otherwise(normalize_rows(markdown_rows(body)))


def to_markdown(rows: Column | str) -> Column:
    """A normalised grid as a Markdown table with escaped pipes; an empty string for an empty grid."""
    rows = col(rows)
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))
    head = F.get(rows, 0)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda c: F.lit("---")), " | "), F.lit(" |"))
    rest = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(head), rule), rest), "\n")).otherwise(F.lit(""))


def key_values(header: Column | str, row: Column | str) -> Column:
    """A row as `header: value` lines (blank header: `Column`); as `Column i: value` without a header of its width."""
    header, row = col(header), col(row)
    named = F.zip_with(header, row, lambda h, v: F.concat(F.when(h == "", F.lit("Column")).otherwise(h), F.lit(": "), v))
    counted = F.transform(row, lambda v, i: F.concat(F.lit("Column "), (i + 1).cast("string"), F.lit(": "), v))
    return F.array_join(F.when((F.size(header) > 0) & (F.size(header) == F.size(row)), named).otherwise(counted), "\n")


def header_of(rows: Column | str) -> Column:
    """First row of a grid of at least two rows, else an empty array."""
    rows = col(rows)
    return F.when(F.size(rows) > 1, F.get(rows, 0)).otherwise(F.array().cast("array<string>"))


def data_of(rows: Column | str) -> Column:
    """All rows behind the header; the single row of a grid without one."""
    rows = col(rows)
    return F.when(F.size(rows) > 1, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1)))).otherwise(rows)


def to_csv(rows: Column | str, sep: str = ",", bom: bool = False) -> Column:
    """A grid as CSV text with quoted fields where needed and CRLF line ends."""
    special = f'["\\r\\n{sep}]'
    field = lambda c: F.when(c.rlike(special), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    text = F.array_join(F.transform(col(rows), lambda r: F.concat(F.array_join(F.transform(r, field), sep), F.lit("\r\n"))), "")
    return F.concat(F.lit("﻿"), text) if bom else text
