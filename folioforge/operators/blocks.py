"""Layout blocks: from Markdown and nested JSON, normalised types, texts, captions and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.parsers import nested_block
from ..functions.text import WS, col, first_nonblank, normalize_space, strip
from ..schema import BLOCK, conform

# Block types that give no text, new names of types, suffixes of image files.
SKIPPED = ("header", "footer", "page_header", "page_footer", "page_number", "page_aside_text", "aside_text")
RENAMED = {
    "title": "text", "paragraph": "text", "equation_interline": "equation", "page_header": "header", "page_footer": "footer",
    "page_number": "page_number", "page_aside_text": "aside_text", "algorithm": "code",
}
IMAGE_SUFFIX = r"(?i)[^/]\.(jpe?g|png|webp|bmp|gif|tiff?)$"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def legacy_type(block_type: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv])
    return F.coalesce(F.try_element_at(names, col(block_type)), col(block_type))


def human_page(page_idx: Column | str) -> Column:
    """Page number from 1 of a page index from 0; null for null and for what is no number."""
    return (col(page_idx).try_cast("int") + 1).cast("int")


def is_image_ref(ref: Column | str) -> Column:
    return F.coalesce(strip(ref).rlike(IMAGE_SUFFIX), F.lit(False))


def flat_list(items: Column | str) -> Column:
    """Texts of a list, white space collapsed, null and empty ones dropped; null gives an empty list."""
    got = F.filter(F.coalesce(col(items), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.transform(got, lambda x: normalize_space(x))


def gather(*lists: Column | str) -> Column:
    """Captions or footnotes from several columns, in that order, as one line."""
    return normalize_space(F.array_join(F.concat(*[flat_list(x) for x in lists]), " "))


def block_text(kind: Column, text: Column, items: Column, code: Column) -> Column:
    """Text of a block by its type: list entries as `- entry` lines, code stripped, all else normalised."""
    entries = F.filter(flat_list(items), lambda x: x != "")
    return (
        F.when(kind == "list", F.array_join(F.transform(entries, lambda x: F.concat(F.lit("- "), x)), "\n"))
        .when(kind == "code", strip(F.coalesce(code, F.lit(""))))
        .otherwise(normalize_space(text))
    )


# Columns that hold a table's body, in order of preference, and those that hold captions and footnotes besides a block's own kind.
BODIES = ("table_body", "table_html", "html", "content", "text", "chart_content")
CAPTIONS, FOOTNOTES = ("caption", "chart_caption", "image_caption"), ("footnote", "chart_footnote", "image_footnote")


def table_body(b: DataFrame) -> Column:
    return first_nonblank(*[c for c in BODIES if c in b.columns])


def captions(kind: str) -> Column:
    """Captions of a table or image block from all columns that may hold one, its own first, each column once."""
    return gather(*dict.fromkeys((f"{kind}_caption", *CAPTIONS)))


def footnotes(kind: str) -> Column:
    return gather(*dict.fromkeys((f"{kind}_footnote", *FOOTNOTES)))


def from_markdown(docs: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """Blocks of Markdown texts: headings with their level, runs of lines with a pipe as tables, other runs as paragraphs.

    doc_key, ord, block_type, text, text_level, table_body. Null and blank texts give no block; keys may repeat only with the same
    text. Runs are islands of lines of one kind: each row sees only the line before it.
    """
    lines = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_key"), F.posexplode(F.split(text, LINE_END, -1)).alias("n", "raw"))
    line = F.rtrim(F.col("raw"), F.lit("\t\n\x0b\f\r "))
    lines = lines.select("doc_key", "n", line.alias("line"))
    kind = F.when(F.col("line").rlike(rf"^#{{1,6}}{WS}+\S"), "heading").when(F.col("line") == "", "blank").when(F.col("line").contains("|"), "table").otherwise("text")
    lines = lines.withColumn("kind", kind)
    w = Window.partitionBy("doc_key").orderBy("n")
    starts = (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(w))
    lines = lines.withColumn("run", F.sum(F.when(starts, 1).otherwise(0)).over(w)).where(F.col("kind") != "blank")
    runs = lines.groupBy("doc_key", "run").agg(F.first("kind").alias("kind"), F.min("n").alias("ord"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    whole = strip(F.array_join("l.line", "\n"))
    head = F.regexp_extract(whole, rf"^(#{{1,6}}){WS}+(.+)$", 2)
    return runs.select(
        "doc_key",
        "ord",
        F.when(F.col("kind") == "table", "table").otherwise("text").alias("block_type"),
        F.when(F.col("kind") == "heading", head).when(F.col("kind") == "text", whole).alias("text"),
        F.when(F.col("kind") == "heading", F.length(F.regexp_extract(whole, "^(#{1,6})", 1))).cast("int").alias("text_level"),
        F.when(F.col("kind") == "table", whole).alias("table_body"),
    )


def is_v2(json_text: Column | str) -> Column:
    """Whether a content list is in the nested form: a non-empty list whose first item is an empty list or a list of objects."""
    return F.coalesce(col(json_text).rlike(r"^\s*\[\s*\[\s*(\]|\{)"), F.lit(False))


def from_v2(pages: DataFrame, key: str = "doc_key", text: str = "json") -> DataFrame:
    """Blocks of nested content lists (one JSON text a document: pages of blocks with a `content` of any shape), in the flat form.

    Malformed texts give no block; pages that are no list and items that are no object are left out by themselves. An item's content
    is read once, in Python, for all fields of its type.
    """
    rows = pages.select(F.col(key).alias("doc_key"), F.posexplode(F.from_json(text, "array<string>")).alias("page_idx", "page")).where(F.col("page").rlike(r"^\s*\["))
    rows = rows.select("doc_key", "page_idx", F.posexplode(F.from_json("page", "array<string>")).alias("k", "item")).where(F.col("item").rlike(r"^\s*\{"))
    rows = rows.withColumn("b", F.from_json("item", "struct<type: string, bbox: array<double>, content: string>"))
    kind = F.coalesce("b.type", F.lit(""))
    rows = rows.select("doc_key", "page_idx", "k", legacy_type(kind).alias("block_type"), F.col("b.bbox").alias("bbox"), nested_block(kind, F.col("b.content")).alias("f"))
    w = Window.partitionBy("doc_key").orderBy("page_idx", "k")
    return conform(rows.select("doc_key", "page_idx", "k", "block_type", "bbox", "f.*").withColumn("ord", F.row_number().over(w) - 1), BLOCK)


def normalized(blocks: DataFrame) -> DataFrame:
    """Blocks that give text, with page (from 1), norm (normalised text) and body_text (text by type); skipped types are gone. Missing columns are null."""
    b = conform(blocks, BLOCK).where(F.col("doc_key").isNotNull() & ~F.coalesce("block_type", F.lit("")).isin(*SKIPPED))
    b = b.withColumns({"block_type": strip(F.coalesce("block_type", F.lit(""))), "page": human_page("page_idx"), "norm": normalize_space("text")})
    return b.withColumn("body_text", block_text(F.col("block_type"), F.col("text"), F.col("list_items"), F.col("code_body")))
