"""Chunks: chapters, tables, table rows and images from blocks; sliding windows; chunks of web pages; references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_pdf_text, col, strip, strip_html
from ..types import struct
from . import tables
from .blocks import captions, footnotes, normalized, table_body
from .headings import heading_level, heading_paths
from .prefix import running, spans_blocks

#: Rows (header included) or characters of its body from which a table becomes one chunk a row.
TABLE_ROWS, TABLE_CHARS = 25, 4000
#: Size and overlap of sliding windows, in characters, and the least size.
SIZE, OVERLAP, LEAST_SIZE = 1800, 250, 300
BREAKS = ("table", "chart", "image", "seal")
_FIELDS = (
    "ord int, chunk_type string, text string, heading_path array<string>, chapter_title string, page_start int, page_end int, table_number int, "
    "table_row_index int, table_row_count int, table_col_count int, table_body_char_count int, table_text_char_count int, table_type string, "
    "table_footnote_text string, image_path string, bbox array<double>, is_table boolean, embed boolean"
)
_TYPE = struct(_FIELDS)


def _chunk(**values: Column) -> Column:
    """A chunk as a struct; fields that aren't given are null."""
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _TYPE])


def laid_out(blocks: DataFrame, blocked: bool = True) -> DataFrame:
    """Normalised blocks with level (of headings), depth, heading_path, seg (running number of segments) and table_no (running number of tables)."""
    b = normalized(blocks).withColumn("level", heading_level("norm", "text_level"))
    head, kind = F.col("level").isNotNull(), F.col("block_type")
    b = b.withColumns({"is_break": ~head & kind.isin(*BREAKS), "is_table_block": ~head & kind.isin("table", "chart")})
    extra = {"seg": F.when(head | F.col("is_break"), 1).otherwise(0), "table_no": F.when(F.col("is_table_block"), 1).otherwise(0)}
    return heading_paths(b, "doc_key", "ord", "norm", "level", extra, blocked)


def _labelled(label: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(f"{label}: "), c))


def _segments(b: DataFrame) -> DataFrame:
    """One row a segment, which begins at each heading and at each table or image: its texts in order, its heading, and the table or image as `x`."""
    head, text = F.col("level").isNotNull(), ~F.col("is_break")
    rows = b.where(head | F.col("is_break") | (F.col("body_text") != ""))
    page = F.when(text & F.col("page").isNotNull(), F.col("ord"))
    first = F.struct(
        F.col("ord"), F.col("block_type").alias("kind"), F.col("page"), F.col("bbox"), F.col("table_type"), F.col("table_no"), table_body(b).alias("body"), strip(F.coalesce("img_path", F.lit(""))).alias("image"),
        captions("table").alias("caption"), footnotes("table").alias("footnote"), captions("image").alias("image_caption_text"), footnotes("image").alias("image_footnote_text"),
    )
    return rows.groupBy("doc_key", "seg").agg(
        F.array_sort(F.collect_list(F.when(text & ~head, F.struct("ord", "body_text")))).alias("texts"),
        F.max(F.when(head, F.col("norm"))).alias("own"),
        F.max("level").alias("level"),
        F.first("heading_path").alias("path"),
        F.first("depth").alias("depth"),
        F.min(F.when(text, F.col("ord"))).alias("text_ord"),
        F.min_by("page", page).alias("page_start"),
        F.max_by("page", page).alias("page_end"),
        F.first(F.when(F.col("is_break"), first), ignorenulls=True).alias("x"),
    )


def _pieces(rows_from: int, chars_from: int) -> Column:
    """Chunks of a segment in order: those of its table or image, then its chapter.

    A table is one chunk (caption, grid, footnote), or one a data row if it is large; tables with nothing on them give none. An image
    with a reference and a caption or footnote is a chunk. A segment is a chapter if it has text besides its title.
    """
    none = F.array().cast(T.ArrayType(_TYPE))
    x, grid, flat = F.col("x"), F.col("grid"), F.col("grid_text")
    step = F.try_element_at("path", F.lit(-1))
    base = dict(
        ord=x["ord"], heading_path=F.col("path"), page_start=x["page"], page_end=x["page"], table_number=x["table_no"], table_footnote_text=x["footnote"], table_type=x["table_type"],
        chapter_title=F.coalesce(step, "doc_key"), table_row_count=F.when(F.size(grid) > 0, F.size(grid)), table_col_count=F.array_max(F.transform(grid, F.size)), bbox=x["bbox"],
        table_body_char_count=F.length(x["body"]), table_text_char_count=F.length(flat), is_table=F.lit(True), embed=F.lit(True),
    )
    caption = _labelled("Caption", x["caption"])
    small = _chunk(chunk_type=F.lit("table"), text=F.concat_ws("\n\n", caption, F.when(flat != "", flat), _labelled("Footnote", x["footnote"])), **base)
    row = lambda r, i: _chunk(chunk_type=F.lit("table_row"), table_row_index=i + 1, text=F.concat_ws("\n", caption, tables.key_values(tables.header_of(grid), r)), **base)
    large = (F.size(grid) > 0) & ((F.size(grid) >= rows_from) | (F.length(x["body"]) >= chars_from))
    is_table = x["kind"].isin("table", "chart") & ((F.size(grid) > 0) | (flat != "") | tables.is_html(x["body"]))
    image = _chunk(
        ord=x["ord"], chunk_type=F.lit("image"), text=F.concat_ws("\n", _labelled("Caption", x["image_caption_text"]), _labelled("Footnote", x["image_footnote_text"])), bbox=x["bbox"],
        heading_path=F.col("path"), chapter_title=step, page_start=x["page"], page_end=x["page"], image_path=x["image"], is_table=F.lit(False), embed=F.lit(True),
    )
    title = F.coalesce("own", step, "doc_key")
    level = F.coalesce("level", F.least(F.greatest("depth", F.lit(1)), F.lit(6)))
    line = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title)
    chapter = _chunk(
        ord=F.col("text_ord"), chunk_type=F.lit("chapter_text"), text=F.concat_ws("\n\n", line, F.array_join("texts.body_text", "\n\n")), chapter_title=title,
        heading_path=F.when(F.size("path") > 0, F.col("path")).otherwise(F.array(title)), page_start=F.col("page_start"), page_end=F.col("page_end"), is_table=F.lit(False), embed=F.lit(True),
    )
    return F.concat(
        F.when(is_table & large, F.transform(tables.data_of(grid), row)).when(is_table, F.array(small)).otherwise(none),
        F.when(x["kind"].isin("image", "seal") & (x["image"] != ""), F.array(image)).otherwise(none),
        F.when(F.size("texts") > 0, F.array(chapter)).otherwise(none),
    )


def numbered(parts: DataFrame, key: str = "doc_key", blocked: bool = True) -> DataFrame:
    """Chunks with anything on them, numbered from 1 within their document by (ord, sub): id `key:00001`."""
    parts = parts.withColumn("text", strip("text")).where(F.col("text") != "")
    # a document's tables may spread one ord over many rows: number by an order that is unique
    parts = parts.withColumn("__o", F.col("ord").cast("long") * F.lit(1_000_000) + F.coalesce("sub", F.lit(0)))
    parts = running(parts, key, "__o", sums={"n": F.lit(1)}, blocked=blocked, block=65_536 * 1_000_000)
    return parts.withColumn("id", F.format_string("%s:%05d", F.col(key), F.col("n").cast("int"))).drop("__o", "n")


def from_blocks(blocks: DataFrame, table_rows: int = TABLE_ROWS, table_chars: int = TABLE_CHARS) -> DataFrame:
    """Chunks of documents from their layout blocks, with id, text, content, heading path, pages, table and image metadata and references.

    One exchange by document serves the windows and the segments, a second the numbering behind the table parser. Blocks without doc_key are left out; ord must be unique within a document (of repeated rows both are kept, in no fixed order);
    null pages and boxes stay null; an empty table gives no row. Extra columns are dropped.
    """
    blocked = spans_blocks(blocks, "ord")
    b = laid_out(blocks, blocked)
    s = _segments(b).withColumn("grid", tables.rows_of(F.when(F.col("x.kind").isin("table", "chart"), F.col("x.body"))))
    s = s.withColumn("grid_text", F.when(F.size("grid") > 0, tables.to_markdown("grid")).otherwise(strip_html("x.body")))
    parts = s.select("doc_key", F.posexplode(_pieces(table_rows, table_chars)).alias("sub", "p")).select("doc_key", "sub", "p.*")
    out = numbered(parts, blocked=blocked).withColumn("content", F.col("text"))
    return out.withColumn("refs", references(out))


def references(df: DataFrame) -> Column:
    """References of a chunk: its source, then its files in fixed order, then its table; empty ones are left out. Missing columns count as null."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    kinds = "struct<ref_type: string, path: string, file: string, page_start: int, page_end: int, table_number: int, row_index: int>"

    def ref(kind: str, present: Column, **kw: Column) -> Column:
        names = ("path", "file", "page_start", "page_end", "table_number", "row_index")
        s = F.struct(F.lit(kind).alias("ref_type"), *[kw.get(n, F.lit(None)).alias(n) for n in names]).cast(kinds)
        return F.when(present, s)

    file = lambda c: F.when(has(c) != "", has(c))
    source = ref("pdf", F.lit(True), path=has("source_pdf_path"), file=has("source_pdf"), page_start=has("page_start"), page_end=has("page_end"))
    files = [
        ref(k, file(c).isNotNull(), path=file(c).cast("string"))
        for c, k in (("table_csv_path", "table_csv"), ("table_markdown_path", "table_markdown"), ("table_html_path", "table_html"), ("table_image_path", "table_image"), ("image_path", "image"))
    ]
    table = ref("table", has("table_number").isNotNull(), table_number=has("table_number"), row_index=has("table_row_index"))
    return F.filter(F.array(source, *files, table), lambda x: x.isNotNull())


def windows(text: Column | str, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """A text cut into windows of `size` characters (at least LEAST_SIZE) that overlap; the first that reaches the end is the last. Array of structs (i, text); blank ones are left out."""
    size = max(LEAST_SIZE, size)
    step = size - min(max(0, overlap), size - 1)
    t = col(text)
    n = F.when(F.length(t) <= size, F.lit(1)).otherwise(F.ceil((F.length(t) - size) / F.lit(step)).cast("int") + 1)
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), strip(F.substring(t, i * step + 1, F.lit(size))).alias("text")))
    return F.filter(cut, lambda x: x["text"] != "")


def sliding(pages: DataFrame, stem: str = "stem", page: str = "page", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Window chunks of page texts: stem, page, chunk_index, id `stem-pN-cI`, text. Null and blank pages give none; repeated rows repeat."""
    clean = pages.select(F.col(stem).alias("stem"), F.col(page).cast("int").alias("page"), clean_pdf_text(text).alias("t")).where(F.col("t") != "")
    got = clean.select("stem", "page", F.explode(windows("t", size, overlap)).alias("w"))
    return got.select("stem", "page", F.col("w.i").alias("chunk_index"), F.format_string("%s-p%d-c%d", "stem", "page", "w.i").alias("id"), F.col("w.text").alias("text"))


def page_range(pages: DataFrame, start: int | None, end: int | None, page_idx: str = "page_idx") -> DataFrame:
    """Pages of a zero-based range [start, end); None leaves a side open."""
    p = F.col(page_idx)
    return pages.where((p >= (start or 0)) & (F.lit(True) if end is None else p < end))
