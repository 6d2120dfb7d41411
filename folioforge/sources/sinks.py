"""Sinks: chunk files, manifests, table files, summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from ..operators import tables

METADATA = "source_pdf source_pdf_path source_html chunk_type heading_path chapter_title page_start page_end table_number table_row_index is_table embed refs".split()


def as_json_lines(chunks: DataFrame) -> DataFrame:
    """doc_key, id, value: one JSON object a chunk, with id, text, content and metadata; null members are left out."""
    meta = F.struct(*[F.col(c) for c in METADATA if c in chunks.columns])
    return chunks.select("doc_key", "id", F.to_json(F.struct("id", "text", "content", meta.alias("metadata"))).alias("value"))


def write_chunks(chunks: DataFrame, path: str, jsonl: bool = False) -> None:
    """All chunks as Parquet, or as files of JSON lines, in order of document and id. A document's lines stand together; a large one may fill several files."""
    ranged = chunks.repartitionByRange("doc_key", "id").sortWithinPartitions("doc_key", "id")
    if jsonl:
        as_json_lines(ranged).select("value").write.mode("overwrite").text(path)
    else:
        ranged.write.mode("overwrite").parquet(path)


def write_documents(lines: DataFrame, base: str) -> DataFrame:
    """One JSON-lines file a document, `base/<doc_key>.jsonl`, written as a stream by the task that has the document: path, lines. lines: doc_key, id, value."""
    target = _target(lines.sparkSession, base)

    def run(batches):
        at = out = None
        n = 0
        for pdf in batches:
            done = []
            for k, v in zip(pdf["doc_key"], pdf["value"]):
                if k != at:
                    if out:
                        out.close()
                        done.append((f"{target}/{at}.jsonl", n))
                    at, n, out = k, 0, _opened(f"{target}/{k}.jsonl")
                out.write(v.encode() + b"\n")
                n += 1
            yield pd.DataFrame(done, columns=["path", "lines"])
        if out:
            out.close()
            yield pd.DataFrame([(f"{target}/{at}.jsonl", n)], columns=["path", "lines"])

    rows = lines.where("doc_key is not null").select("doc_key", "id", "value").repartition("doc_key").sortWithinPartitions("doc_key", "id")
    return rows.mapInPandas(run, "path string, lines bigint")


def _target(spark: SparkSession, path: str) -> str:
    """A path with its file system: the cluster's default where it names none."""
    if "://" in path or path.startswith("file:"):
        return path
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS")
    if default.startswith("file:"):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{path!r} names no file system that all executors share")
        return f"file://{path}"
    return default.rstrip("/") + path


def _opened(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(at)


def manifest(chunks: DataFrame, doc: str = "doc_key") -> DataFrame:
    """One row a document: chunk_count, table_count (distinct tables), image_count. Repeated rows of one id count once; null ids are no chunks."""
    per = chunks.where(F.col("id").isNotNull()).groupBy(doc, "id").agg(F.max("chunk_type").alias("t"), F.max("table_number").alias("n"))
    return per.groupBy(doc).agg(
        F.count("*").alias("chunk_count"),
        F.count_distinct(F.when(F.col("t").isin("table", "table_row"), F.col("n"))).alias("table_count"),
        F.count_if(F.col("t") == "image").alias("image_count"),
    )


def manifest_document(manifests: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """A manifest as JSON, one row: `value`, an object with the settings and the documents in order. For manifests of one run; the table itself is the form for large ones."""
    docs = manifests.agg(F.array_sort(F.collect_list(F.struct(*manifests.columns))).alias("documents"))
    return docs.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in (settings or {}).items()], "documents")).alias("value"))


def manifest_list(manifests: DataFrame) -> DataFrame:
    """A manifest as a bare JSON list, one row: `value`."""
    return manifests.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*manifests.columns)))).alias("value"))


def with_paths(manifests: DataFrame, base: str, doc: str = "doc_key", html_dialect: bool = False) -> DataFrame:
    """Manifest rows with where a document's outputs are: chunks_path, and in the PDF dialect markdown_path, images_dir and tables_dir."""
    at = lambda folder, end="": F.concat(F.lit(f"{base.rstrip('/')}/{folder}/"), F.col(doc), F.lit(end))
    out = manifests.withColumn("chunks_path", at("chunks", ".jsonl"))
    return out if html_dialect else out.withColumns({"markdown_path": at("markdown", ".md"), "images_dir": at("images"), "tables_dir": at("tables")})


def summary(manifests: DataFrame) -> DataFrame:
    """One row: documents, chunks, tables, images."""
    return manifests.agg(F.count("*").alias("documents"), *[F.coalesce(F.sum(f"{k}_count"), F.lit(0)).cast("bigint").alias(f"{k}s") for k in ("chunk", "table", "image")])


def table_name(number: Column | str, page: Column | str) -> Column:
    part = F.coalesce(F.format_string("_page_%03d", col(page)), F.lit(""))
    return F.concat(F.format_string("table_%04d", col(number)), F.when(col(page).isNull(), F.lit("")).otherwise(part))


def html_table_name(chunk_id: Column | str) -> Column:
    """Name of a table's files in the HTML dialect, by the id of its chunk."""
    return F.concat(F.lit("table_"), F.replace(col(chunk_id), F.lit(":"), F.lit("_")))


def table_files(grids: DataFrame, html_dialect: bool = False) -> DataFrame:
    """Side files of tables as rows: name, csv, markdown, html. grids: name, grid, caption, footnote, body.

    The PDF dialect has commas and a Markdown file with caption and footnote; the HTML dialect semicolons, a byte order mark, and the
    grid alone without escaped pipes. Empty grids give null files.
    """
    has = F.size("grid") > 0
    if html_dialect:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))
        head = F.get("grid", 0)
        pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.size(head) - F.size(r), F.lit(0))))
        rest = F.transform(F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0))), lambda r: line(pad(r)))
        md = F.array_join(F.concat(F.array(line(head), line(F.transform(head, lambda c: F.lit("---")))), rest), "\n")
        csv = tables.to_csv("grid", ";", bom=True)
    else:
        part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
        md = F.concat_ws("\n\n", part("Caption", "caption"), tables.to_markdown("grid"), part("Footnote", "footnote"))
        csv = tables.to_csv("grid")
    return grids.select("name", F.when(has, csv).alias("csv"), F.when(has, md).alias("markdown"), F.when(tables.is_html("body"), F.col("body")).alias("html"))


def write_files(files: DataFrame, path_col: str, content_col: str) -> DataFrame:
    """Write one file a row, of text or of bytes, through the cluster's file systems and give back (path, bytes); each task writes its own rows. Rows without content are left out."""
    spark = files.sparkSession
    base = _target(spark, "/").rstrip("/") if files.where(~F.col(path_col).contains("://")).limit(1).count() else ""

    def run(batches):
        for pdf in batches:
            out = []
            for p, c in zip(pdf["path"], pdf["content"]):
                if c is not None:
                    with _opened(p if "://" in p else base + p) as f:
                        f.write(c)
                    out.append((p, len(c)))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    return files.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content")).mapInPandas(run, "path string, bytes bigint")


def copied_images(files: DataFrame, base: str) -> DataFrame:
    """Images (doc_key, path, content) copied to `base/<doc_key>/<name>`, names made safe against collisions (`image_names`): path, bytes."""
    named = files.join(image_names(files), ["doc_key", "path"]).groupBy("doc_key", "name").agg(F.first("content").alias("content"))  # equal names hold equal bytes
    return write_files(named.withColumn("to", F.concat_ws("/", F.lit(base.rstrip("/")), "doc_key", "name")), "to", "content")


def rebase_images(markdown: Column | str, mapping: Column | str, prefix: str | None = None) -> Column:
    """Markdown with image targets replaced: by the whole target, the target without `#…` or `?…`, or its last part; else `images/` gets `prefix`; else unchanged."""
    md, m = col(markdown), col(mapping)
    targets = F.array_distinct(F.regexp_extract_all(md, F.lit(r"!\[[^\]\n]*\]\(([^()\s]+)\)"), F.lit(1)))

    def new(t: Column) -> Column:
        bare = F.regexp_replace(t, "[?#].*$", "")
        moved = F.when(bare.startswith("images/"), F.concat(F.lit(prefix), bare)) if prefix else F.lit(None)
        return F.coalesce(F.try_element_at(m, t), F.try_element_at(m, bare), F.try_element_at(m, F.element_at(F.split(bare, "/"), -1)), moved, t)

    return F.aggregate(targets, md, lambda acc, t: F.replace(acc, F.concat(F.lit("]("), t, F.lit(")")), F.concat(F.lit("]("), new(t), F.lit(")"))))


def image_names(files: DataFrame) -> DataFrame:
    """Names for images copied into one folder a document (doc_key, path, content): equal names with other bytes get `_2`, `_3`; equal bytes share one. doc_key, path, name."""
    from pyspark.sql.window import Window

    rows = files.select("doc_key", "path", F.element_at(F.split("path", "/"), -1).alias("base"), F.sha2("content", 256).alias("digest"))
    first = rows.groupBy("doc_key", "base", "digest").agg(F.min("path").alias("first"))
    k = F.row_number().over(Window.partitionBy("doc_key", "base").orderBy("first"))
    named = first.withColumn("k", k)
    stem, ext = F.regexp_extract("base", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("base", r"(\.[^.]*)$", 1)
    name = F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat(stem, F.lit("_"), F.col("k").cast("string"), ext))
    return rows.join(named.select("doc_key", "base", "digest", name.alias("name")), ["doc_key", "base", "digest"]).select("doc_key", "path", "name")
