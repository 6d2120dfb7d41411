"""Schemas of layout blocks and chunks: one fixed union of all dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import struct

BLOCK = struct(
    "doc_key string, ord int, block_type string, page_idx int, bbox array<double>, text string, text_level int, list_items array<string>, "
    "table_body string, table_html string, table_type string, img_path string, table_caption array<string>, table_footnote array<string>, "
    "image_caption array<string>, image_footnote array<string>, code_body string, html string, content string, chart_content string, "
    "caption array<string>, chart_caption array<string>, footnote array<string>, chart_footnote array<string>"
)
REFERENCE = "struct<ref_type: string, path: string, file: string, page_start: int, page_end: int, table_number: int, row_index: int>"
METADATA = (
    "source_pdf string, source_pdf_path string, source_html string, source_html_path string, parser string, ingest_backend string, "
    "chunk_type string, chunk_id string, heading_path array<string>, chapter_title string, page_start int, page_end int, chunk_index int, "
    "table_number int, table_row_index int, table_csv_path string, table_markdown_path string, table_html_path string, table_image_path string, "
    "table_row_count int, table_col_count int, table_body_char_count int, table_text_char_count int, table_type string, image_path string, "
    "bbox array<double>, is_table boolean, content_available boolean, embed boolean, html_tag string, styling map<string,string>"
)
CHUNK = struct(f"id string, text string, content string, metadata struct<{METADATA}>")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema` in its order; columns that `df` lacks are null, columns it has beyond them are dropped."""
    have = {c.lower(): c for c in df.columns}
    return df.select([(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
