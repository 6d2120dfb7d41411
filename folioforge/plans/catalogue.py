"""Queries over the driver's tables, one or more for each operator, with equivalent SQL where it can be said in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import blocks, chat, chunks, citations, context, headings, html, index, retrieve, tables
from ..sources import files, outputs, sinks
from .engine import Engine, post_process
from ..storage import keep, kept, shared_dir

#: Items of the benchmark and vectors whose number is divisible by this are the queries of the searches.
EVERY = 50


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _unique(df: DataFrame, *cols: str) -> DataFrame:
    """Rows delivered again under one id are equal in these columns."""
    return df.where("id is not null").select("id", *cols).distinct()


# --- text functions


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize_space("text").alias("norm"), T.clean_pdf_text("text").alias("clean"))


def strip_html(spark: SparkSession, d: str) -> DataFrame:
    return _unique(table(spark, d, "chunks"), "text").select("id", T.strip_html("text").alias("plain"))


def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.safe_filename("title").alias("name"), T.cache_key("source").alias("key"), T.basename("path").alias("base"))


def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id", T.snippet("text").alias("snippet"), F.length(T.embed_text("text")).alias("embed_chars"), T.bool_text(F.col("lang") == "en").alias("english"),
        T.safe_int(F.regexp_extract("source", "([0-9]+)$", 1), -1).alias("source_no"), F.sha1(F.encode("text", "utf-8")).alias("digest"),
    )


def split_paths(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select("doc_key", F.concat_ws(";", "markdown_path", "chunks_path", F.lit(" "), "images_dir").alias("p")).distinct()
    return m.select("doc_key", F.posexplode(T.split_paths("p")).alias("pos", "path"))


def key_values(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").select("source", T.key_value(F.concat(F.lit(" "), "channel", F.lit("="), "publisher")).alias("kv"))
    return s.select("source", F.col("kv.key").alias("key"), F.col("kv.value").alias("value"))


# --- sources


def load_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("id", files.effective_text().alias("text"), F.lit("corpus").alias("index_name"))
    return c.where("text <> ''").distinct()


def detect_backend(spark: SparkSession, d: str) -> DataFrame:
    return files.detect_backend(table(spark, d, "chunks").where("id is not null").withColumn("source", F.coalesce("source_pdf", "source_html")), ["source"])


def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select("doc_key", F.coalesce("source_pdf", "source_html").alias("f"), F.array("markdown_path", "content_list_path", "chunks_path").alias("ps")).distinct()
    rows = m.select("doc_key", F.regexp_replace("f", r"\.[a-z]+$", "").alias("stem"), F.col("doc_key").alias("safe"), F.explode("ps").alias("path")).where("path is not null")
    return files.best_candidates(rows.withColumn("size", F.length("path")))


def side_files(spark: SparkSession, d: str) -> DataFrame:
    c = _unique(table(spark, d, "chunks"), "chunk_type", "table_csv_path", "text").withColumnRenamed("table_csv_path", "table_markdown_path")
    side = c.where("table_markdown_path is not null").groupBy(F.col("table_markdown_path").alias("path")).agg(F.concat(F.lit("file of "), F.min("id")).alias("content"))
    return files.with_side_files(c, side).select("id", "chunk_type", "text")


def flat_styling(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("id is not null and styling is not null").select("id", "styling")
    return files.flat_styling(c).select("id", "css_color", "css_font", "css_background").distinct()


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("is_table and page_start between 2 and 9 and chunk_type = 'table'")
    return c.where("id is not null").select("id", "source_pdf", "page_start", "table_number").distinct()


def redelivered(spark: SparkSession, d: str) -> DataFrame:
    """Of rows delivered again the latest: one row an id."""
    c = table(spark, d, "chunks").where("id is not null")
    return c.groupBy("id").agg(F.max("ingested_at").alias("ingested_at"), F.count("*").alias("deliveries"))


# --- blocks, headings, chunks


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks")


def block_texts(spark: SparkSession, d: str) -> DataFrame:
    b = blocks.normalized(_blocks(spark, d))
    return b.select("doc_key", "ord", "block_type", F.col("page"), "body_text", blocks.gather("table_caption", "image_caption").alias("caption"), blocks.is_image_ref("img_path").alias("is_image"))


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("id is not null and chunk_type = 'chapter_text'").select(F.col("id").alias("doc_key"), F.when(F.col("text").rlike(r"\S"), F.col("text")).otherwise(F.col("content")).alias("text"))
    return blocks.from_markdown(c.where("text is not null").distinct())


def nested_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each text block and list of the table written in the nested form, and read back; `block_cases` has the other kinds, which the table's columns don't hold in that form."""
    b = _blocks(spark, d).where("block_type in ('text', 'list')").withColumn("k", F.concat_ws("#", "doc_key", F.col("ord").cast("string")))
    title = F.to_json(F.struct(F.lit("title").alias("type"), F.struct(F.array(F.struct(F.col("text").alias("content"))).alias("title_content"), F.col("text_level").alias("level")).alias("content")))
    para = F.to_json(F.struct(F.lit("paragraph").alias("type"), F.struct(F.col("text").alias("paragraph_content")).alias("content")))
    items = F.to_json(F.struct(F.lit("list").alias("type"), F.struct("list_items").alias("content")))
    one = F.when(F.col("block_type") == "list", items).when(F.col("text_level").isNotNull(), title).otherwise(para)
    got = blocks.from_v2(b.select(F.col("k").alias("doc_key"), F.concat(F.lit("[["), one, F.lit("]]")).alias("json")))
    none = F.array().cast("array<string>")
    return got.select("doc_key", "block_type", "page_idx", F.coalesce("text", F.lit("")).alias("text"), "text_level", F.array_join(F.coalesce("list_items", none), "|").alias("items"))


def looks_like_heading(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).where("text is not null").select("doc_key", "ord", T.normalize_space("text").alias("t"))
    return b.select("doc_key", "ord", headings.looks_like_heading("t").alias("is_heading"), headings.guess_level("t").alias("guessed"))


def heading_path(spark: SparkSession, d: str) -> DataFrame:
    b = chunks.laid_out(_blocks(spark, d), False)
    return b.select("doc_key", "ord", "level", "depth", F.array_join("heading_path", " / ").alias("path"))


def block_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunks.from_blocks(_blocks(spark, d))
    return c.select("id", "chunk_type", "text", F.array_join("heading_path", " / ").alias("path"), "chapter_title", "page_start", "page_end", "table_number", "table_row_index", "table_row_count", F.array_join("refs.ref_type", ",").alias("refs"))


def chapter_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunks.from_blocks(_blocks(spark, d)).where("chunk_type = 'chapter_text'")
    return c.select("doc_key", "ord", "text", F.array_join("heading_path", " / ").alias("path"), "chapter_title", "page_start", "page_end")


def image_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunks.from_blocks(_blocks(spark, d)).where("chunk_type = 'image'")
    return c.select("doc_key", "ord", "text", "page_start", "image_path")


def table_grids(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).where("table_body is not null").select("doc_key", "ord", tables.rows_of("table_body").alias("grid"))
    return b.select("doc_key", "ord", F.size("grid").alias("n_rows"), tables.to_markdown("grid").alias("markdown"))


def table_files(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).where("table_body is not null").withColumn("n", F.lit(1))
    g = b.select(
        F.concat("doc_key", F.lit("/"), F.col("ord").cast("string"), F.lit("_"), sinks.table_name("n", blocks.human_page("page_idx"))).alias("name"), tables.rows_of("table_body").alias("grid"),
        blocks.gather("table_caption").alias("caption"), blocks.gather("table_footnote").alias("footnote"), F.col("table_body").alias("body"),
    )
    return sinks.table_files(g)


def markdown_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as small Markdown tables, read back as key-value rows."""
    s = table(spark, d, "supplier").select("s_suppkey", F.format_string("| key | name |  |\n|---|:---:|---|\n| %d | %s | x |\n| a |\n", "s_suppkey", "s_name").alias("md"))
    g = s.select("s_suppkey", tables.normalize_rows(tables.markdown_rows("md")).alias("g"))
    g = g.select("s_suppkey", tables.header_of("g").alias("h"), F.posexplode(tables.data_of("g")).alias("pos", "row"))
    return g.select("s_suppkey", F.col("pos").alias("row_no"), tables.key_values("h", "row").alias("text"))


def chunk_sliding_window(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stem"), F.lit(1).alias("page"), "text")
    return chunks.sliding(docs)


def page_windows(spark: SparkSession, d: str) -> DataFrame:
    """Texts of pages 2 to 5 of each PDF's blocks, as window chunks of 600 characters."""
    b = _blocks(spark, d).where("text is not null and page_idx is not null")
    pages = chunks.page_range(b, 1, 5).select("doc_key", "page_idx", "ord", "text")
    pages = pages.withColumn("page", blocks.human_page("page_idx"))
    return chunks.sliding(pages.withColumn("stem", F.concat_ws("#", "doc_key", F.col("ord").cast("string"))), size=600, overlap=100)


def chunk_references(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("id is not null and source_pdf is not null")
    r = c.select("id", F.transform(chunks.references(c), lambda x: F.concat_ws(":", x["ref_type"], F.coalesce(x["path"], F.lit("")), F.coalesce(x["table_number"].cast("string"), F.lit("")))).alias("r"))
    return r.select("id", F.array_join("r", " ").alias("refs")).distinct()


def html_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents dressed as web pages with menus and footers, and their main content."""
    docs = table(spark, d, "documents").where("text is not null")
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    paragraphs = F.array_join(F.transform(F.split(esc, "\n"), lambda x: F.concat(F.lit("<p>"), x)), "\n")
    page = F.concat(F.lit("<html><body><nav><a href='/'>Home page of all</a></nav><main><h1>Document</h1>"), paragraphs, F.lit("<ul><li><a href='/x'>only a link here</a></ul><footer><p>Footer of the page</p></footer></main></body></html>"))
    return html.chunks(docs.select(F.col("doc_id").cast("string").alias("doc_key"), page.alias("html"))).select("id", "chunk_type", "html_tag", "text")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").withColumn("source", F.coalesce("source_pdf", "source_html"))
    return sinks.manifest(c, "source")


def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows against the chunks that are there."""
    m = table(spark, d, "manifest").select(F.coalesce("source_pdf", "source_html").alias("source"), F.col("chunk_count").cast("bigint").alias("said")).distinct()
    return m.join(manifest(spark, d).select("source", "chunk_count"), "source", "left").select("source", "said", F.coalesce("chunk_count", F.lit(0)).alias("found"), F.coalesce(F.col("said") == F.coalesce("chunk_count", F.lit(0)), F.lit(False)).alias("agrees"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return sinks.summary(manifest(spark, d))


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as JSON lines, and members read back from the lines."""
    got = sinks.as_json_lines(chunks.from_blocks(_blocks(spark, d)))
    get = lambda p, kind="string": F.get_json_object("value", f"$.{p}").cast(kind)
    refs = F.array_join(F.from_json(get("metadata.refs"), "array<struct<ref_type: string>>")["ref_type"], ",")
    return got.select(get("id").alias("id"), "doc_key", get("text").alias("text"), get("metadata.chunk_type").alias("chunk_type"), get("metadata.page_start", "int").alias("page_start"), get("metadata.table_number", "int").alias("table_number"), refs.alias("refs"))


# --- constructed inputs


def _filled(template: str, name: str) -> F.Column:
    """A template with the name of a row in place of `#`."""
    return F.replace(F.lit(template), F.lit("#"), F.col(name))


def entities(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    return s.select("source", T.normalize_space(F.concat("source", F.lit(" &eacute; &hellip;&nbsp;&#8217; &#x2014; &copy &amp;lt; R&D &unknown; &frac12;"))).alias("decoded"))


def html_cases(spark: SparkSession, d: str) -> DataFrame:
    """Pages with pruned parts, links, repeats, unclosed tags and a table."""
    page = (
        "<body><div>a longer text outside of the main part that is not looked at, with many more words than it</div><header>Site header</header><article role=article><h2>Title of #</h2><p>Title of #<p>Second\n part &amp; more of #"
        "<nav class='related-links'><p>Kept nav of #</p></nav><nav><p>Dropped nav of #</p></nav><aside><p>Aside of #</p></aside><ul><li><p>An entry of #</p> with words<li><a>only a link</a></ul>"
        "<p><a>0123456789\n\n\n0123456789</a></p><p><a>0123456\n\n\n\n789</a> 0123456789 ab cd</p><p>abcd<table><tr><td>#<th>head<tr><td>cell<td> <tr><td> </table><div class='table-of-contents'><p>Contents of #</p></div><footer>Foot of #</footer></article></body>"
    )
    got = html.chunks(table(spark, d, "sources").select(F.col("source").alias("doc_key"), _filled(page, "source").alias("html")))
    return got.select("id", "html_tag", "chunk_type", "text", F.array_join(F.transform("table_rows", lambda r: F.array_join(r, ",")), ";").alias("table_rows"))


def span_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables with cells over columns and rows, line breaks and empty rows under a span."""
    body = "<table><tr><th colspan='2'>key</th><th rowspan=2>n</th></tr><tr><td rowspan=3>#</td><td>b<br>c</td></tr><tr></tr><tr><td></td></tr></table>"
    g = table(spark, d, "nation").select("n_nationkey", tables.rows_of(_filled(body, "n_name")).alias("g"))
    return g.select("n_nationkey", tables.to_markdown("g").alias("markdown"), F.size("g").alias("n_rows"))


def block_cases(spark: SparkSession, d: str) -> DataFrame:
    """Nested content lists with blocks of every kind, contents of every shape, and stray pages and items."""
    js = (
        '[[{"type":"title","content":{"title_content":[{"content":"Head of #"}],"level":2}},"stray",{"type":"paragraph","content":{"paragraph_content":["One",{"type":"x","text":"two"}]}},'
        '{"type":"list","content":{"list_items":["a  b",{"content":"c"},""]}}],{"x":1},[{"type":"table","content":{"html":"<table></table>","image_source":{"path":"t.png"},"table_caption":["cap 1","cap 2"]}},7,'
        '{"type":"image","content":{"img_path":"i.png","caption":"Figure"}},{"type":"equation_interline","content":{"math_content":"x = 1"}},{"type":"algorithm","content":{"algorithm_content":"run it"}},'
        '{"type":"seal","content":{"path":"s.png"}},{"type":"other","content":{"k":["free",{"text":"text"}],"level":3}}]]'
    )
    got = blocks.from_v2(table(spark, d, "nation").select(F.col("n_name").alias("doc_key"), _filled(js, "n_name").alias("json")))
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|")
    text = lambda c: F.coalesce(c, F.lit(""))
    return got.select(
        "doc_key", "ord", "block_type", "page_idx", text("text").alias("text"), "text_level", joined("list_items").alias("items"), text("table_body").alias("body"), text("img_path").alias("img"),
        joined(F.coalesce("table_caption", "image_caption")).alias("cap"), text("code_body").alias("code"),
    )


def caption_keys(spark: SparkSession, d: str) -> DataFrame:
    """Flat content lists whose table has its body, captions and footnotes under older keys."""
    js = '[{"type":"table","page_idx":0,"content":"#","table_caption":["A #"],"caption":"B","chart_caption":["C"],"footnote":["F"],"chart_footnote":["G"]}, null, "stray"]'
    got = chunks.from_blocks(outputs.from_flat(table(spark, d, "nation").select(F.col("n_name").alias("doc_key"), _filled(js, "n_name").alias("json"))))
    return got.select("doc_key", "text")


def scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines, blank and broken lines among them, and read back by the scan."""
    c = table(spark, d, "chunks").where("id is not null").select("id", "text", "content", "chunk_type").distinct()
    line = F.to_json(F.struct("id", "text", "content", F.struct("chunk_type").alias("metadata")))
    lines = c.select(F.explode(F.array(line, F.lit(" "), F.concat(F.lit('{"id": "broken'), "id"))).alias("value"))
    path = keep(spark, f"{shared_dir(spark).rstrip('/')}/jsonl-{uuid.uuid4().hex}")
    lines.write.text(path)
    return files.scan_chunks(spark, [path], "corpus").select("id", "text", "metadata.chunk_type", "index_name").distinct()


def manifest_paths(spark: SparkSession, d: str) -> DataFrame:
    m = sinks.with_paths(manifest(spark, d).select("source", "chunk_count"), "/out", "source")
    return m.select("source", "chunk_count", "chunks_path", "markdown_path", "images_dir", "tables_dir")


def image_copies(spark: SparkSession, d: str) -> DataFrame:
    """Three images of one name a document, two of them with the same bytes."""
    s = table(spark, d, "sources").select(F.col("source").alias("doc_key"), F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("c")) for p, c in (("a/i.png", "1"), ("b/i.png", "2"), ("c/i.png", "1"), ("c/noext", "3"))])).alias("x"))
    return sinks.image_names(s.select("doc_key", "x.path", F.encode("x.c", "utf-8").alias("content")))


def rebased_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Image targets found whole, without their query, by their last part, by prefix, and not at all."""
    s = table(spark, d, "sources")
    md = F.concat(F.lit("![a](images/x.png) ![b](q/y.png?z) ![c](w.png#f) ![d](q/"), "source", F.lit(".png) [no image](w.png) ![e](images/x.png)"))
    names = F.create_map(F.lit("y.png"), F.lit("new.png"), F.lit("w.png"), F.lit("w2.png"), F.concat("source", F.lit(".png")), F.lit("own.png"))
    return s.select("source", sinks.rebase_images(md, names, "../").alias("markdown"))


def html_table_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of tables in the dialect of web pages."""
    n = table(spark, d, "nation").select(
        sinks.html_table_name(F.format_string("%s:%05d", "n_name", "n_nationkey")).alias("name"), F.array(F.array(F.lit("a|b"), F.lit("c;d")), F.array(F.col("n_name"))).alias("grid"),
        F.lit("").alias("caption"), F.lit("").alias("footnote"), F.lit(None).cast("string").alias("body"),
    )
    return sinks.table_files(n, html_dialect=True).select("name", "csv", "markdown")


def page_reader(spark: SparkSession, d: str) -> DataFrame:
    """Documents as texts with form feeds between their pages; pages 2 to 4 of each."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("stem"), F.replace("text", F.lit("\n\n"), F.lit("\f")).alias("value"))
    return chunks.page_range(outputs.page_texts(docs), 1, 4).select("stem", "page_idx", T.clean_pdf_text("text").alias("text"))


def message_texts(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose content is a list of strings and objects."""
    c = table(spark, d, "conversations").where("text is not null")
    parts = F.concat(F.lit("["), F.concat_ws(",", F.to_json(F.struct(F.col("text").alias("text"))), F.to_json(F.struct(F.col("text").alias("content"))), F.lit('{"other": 1}'), F.lit('""'), F.lit('"end"')), F.lit("]"))
    return c.select("conv_id", "turn", chat.content_text(parts).alias("text"))


def answer_chips(spark: SparkSession, d: str) -> DataFrame:
    """Answers with their block of sources, split again, renumbered and grouped."""
    a, ctx = _answers(spark, d)
    block = citations.sources_block(citations.entries(a, ctx))
    got = post_process(a.join(block, "answer_id").select("answer_id", F.concat("answer", "block").alias("content")))
    return got.select("answer_id", "content", F.size("sources").alias("sources"))


def question_loop(spark: SparkSession, d: str) -> DataFrame:
    """The question loop over all queries at once, with the default judge."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.coalesce("path", "source").alias("label"), "text")
    engine = Engine(spark, _index(spark, d), docs)
    q = _queries(spark, d).select(F.col("query_id").cast("int").alias("query_id"), F.col("text").alias("query"))
    return engine.gather_batch(q).select("query_id", "included", "used_chars", F.size("passages").alias("passages"))


# --- index and retrieval


def _queries(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").where((F.col("item_id") % EVERY == 0) & F.col("text").isNotNull())
    return b.select(F.col("item_id").alias("query_id"), "text")


_indexes: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, d: str) -> index.Lexical:
    """The index of the documents: built and stored once a session, then read from its folders."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _indexes or not kept(spark, _indexes[at]):
        path = keep(spark, f"{shared_dir(spark).rstrip('/')}/lexical-{uuid.uuid4().hex}")
        index.lexical(table(spark, d, "documents")).write(path)
        _indexes[at] = path
    return index.Lexical.read(spark, _indexes[at])


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.bm25(_index(spark, d), _queries(spark, d)).select("query_id", F.col("key").alias("doc_id"), "score", "rank")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    return e, e.where(F.col("key") % EVERY == 0).select(F.col("key").alias("query_id"), "embedding")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e, q = _vectors(spark, d)
    return retrieve.vectors(e, q).select("query_id", F.col("key").alias("vec_id"), "score", "rank")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    # the tables link no vector to a text: vec_id stands for doc_id, and vec_id = item_id mod 1000 for an item
    e, q = _vectors(spark, d)
    texts = _queries(spark, d).withColumn("v", F.col("query_id") % 1000)
    q = texts.join(q.withColumnRenamed("query_id", "v"), "v").select("query_id", "text", "embedding")
    return retrieve.hybrid(_index(spark, d), e, q)


def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query_id", F.col("key").alias("doc_id"), F.round("score", 9).alias("score"), "rank")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two lists of each source's documents, by length and by date, fused."""
    docs = table(spark, d, "documents").where("n_chars is not null and published_at is not null").select("doc_id", "source", "n_chars", "published_at").distinct()
    docs = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("key"), "n_chars", F.unix_micros(F.col("published_at").cast("timestamp")).alias("at"))
    by = lambda c: retrieve.top_k(docs, retrieve.CANDIDATES, c).select("query_id", "key", "rank")
    return retrieve.fuse(by("n_chars"), by("at")).select(F.col("query_id").alias("source"), F.col("key").alias("doc_id"), F.round("score", 9).alias("score"), "rank")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve.bm25(_index(spark, d), _queries(spark, d)).drop("score")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return found.join(docs, "key").join(_queries(spark, d).withColumnRenamed("text", "query"), "query_id")


def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.rerank(_candidates(spark, d)).select("query_id", F.col("key").alias("doc_id"), "rerank_score", "place")


def rerank_permutation(spark: SparkSession, d: str) -> DataFrame:
    c = retrieve.bm25(_index(spark, d), _queries(spark, d)).select("query_id", "key", "rank")
    said = _queries(spark, d).select("query_id", F.expr("array(3, 1, 3, 99, -1, cast(query_id % 7 as int))").alias("ranking"))
    return retrieve.apply_ranking(c, said).select("query_id", F.col("key").alias("doc_id"), "place", "rerank_score")


def union_distinct_iterations(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d)
    rounds = [q, q.withColumn("text", F.substring_index("text", " ", 8))]
    got = [retrieve.bm25(_index(spark, d), x, 10).select("query_id", F.lit(i).alias("round"), F.col("rank").alias("place"), "key") for i, x in enumerate(rounds)]
    return retrieve.union_rounds(got[0].unionByName(got[1])).select("query_id", F.col("key").alias("doc_id"), "position")


def document_identity(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("text is not null").select(retrieve.doc_key("id", "text").alias("key"))
    return c.groupBy("key").agg(F.count("*").alias("n"))


# --- context, citations, chat


def source_label(spark: SparkSession, d: str) -> DataFrame:
    c = _unique(table(spark, d, "chunks"), "source_pdf", "source_pdf_path", "page_start", "page_end")
    return c.select("id", context.source_label(F.coalesce("source_pdf", "source_pdf_path"), "page_start", "page_end").alias("label"))


def style_note(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("id is not null and styling is not null")
    return c.select("id", context.style_note("html_tag", "styling").alias("note")).distinct()


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    top = retrieve.bm25(_index(spark, d), _queries(spark, d), retrieve.TOP).select("query_id", "key", F.col("rank").alias("place"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.coalesce("path", "source").alias("label"), "text")
    return top.join(docs, "key").select("query_id", "place", "label", "text")


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    return context.pack(_ranked(spark, d))


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Answers of the conversations, and as their sources the passages that the first query retrieves."""
    a = table(spark, d, "conversations").where("msg_role = 'assistant' and text is not null")
    a = a.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"), F.lit(0).alias("query_id"), F.col("text").alias("answer")).distinct()
    q = _queries(spark, d)
    first = q.join(F.broadcast(q.agg(F.min("query_id").alias("query_id"))), "query_id")  # one row
    top = retrieve.bm25(_index(spark, d), first, retrieve.TOP).select("key", F.col("rank").alias("place"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.coalesce("path", "source", F.lit("")).alias("label"), "text")
    return a, top.join(docs, "key").select(F.lit(0).alias("query_id"), "place", "label", "text")


def cite_extract(spark: SparkSession, d: str) -> DataFrame:
    a, _ = _answers(spark, d)
    return a.select("answer_id", F.array_join(F.transform(citations.cited("answer", retrieve.TOP), lambda x: x.cast("string")), ",").alias("numbers"))


def cite_sources(spark: SparkSession, d: str) -> DataFrame:
    return citations.sources_block(citations.entries(*_answers(spark, d)))


def cite_renumber(spark: SparkSession, d: str) -> DataFrame:
    a, ctx = _answers(spark, d)
    g = citations.groups(citations.entries(a, ctx))
    return g.select("answer_id", "number", "group_no", "label")


def cite_rewrite(spark: SparkSession, d: str) -> DataFrame:
    a, ctx = _answers(spark, d)
    return citations.renumber(a, citations.groups(citations.entries(a, ctx)))


def last_user_message(spark: SparkSession, d: str) -> DataFrame:
    return chat.last_user_message(table(spark, d, "conversations"))


def validate_question(spark: SparkSession, d: str) -> DataFrame:
    return chat.last_user_message(table(spark, d, "conversations")).select("conv_id", chat.question_status("question").alias("status"))


def assistant_last(spark: SparkSession, d: str) -> DataFrame:
    return chat.ends_with_assistant(table(spark, d, "conversations"))


NAMES = (
    "normalize_text strip_html safe_filename text_helpers split_paths key_values load_chunks detect_backend best_candidate side_files flat_styling metadata_filter "
    "redelivered block_texts nested_blocks markdown_blocks looks_like_heading heading_path block_chunks chapter_chunks image_chunks table_grids table_files markdown_table_rows "
    "chunk_sliding_window page_windows chunk_references html_chunks manifest manifest_check run_summary json_lines term_statistics bm25_topk vector_topk "
    "hybrid_retrieve rrf_fusion rerank_overlap rerank_permutation union_distinct_iterations document_identity source_label style_note context_pack cite_extract "
    "cite_sources cite_renumber cite_rewrite last_user_message validate_question assistant_last entities html_cases span_tables block_cases caption_keys "
    "scan_jsonl manifest_paths image_copies rebased_markdown html_table_files page_reader message_texts answer_chips question_loop"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
