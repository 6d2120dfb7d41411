"""Discovery of files and folders, and scans of chunk files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import col, strip
from ..schema import CHUNK

WHOLE = "all_chunks.jsonl"


def split_paths(paths: str | list[str] | None) -> list[str]:
    """A list as it is; a string split at `;` and `,`, and at `:` unless it belongs to a URI's scheme. Blank ones are dropped."""
    if isinstance(paths, (list, tuple)):
        return [p.strip() for p in paths if p and p.strip()]
    return [p.strip() for p in re.split(r"[;,]|:(?!//)", paths or "") if p.strip()]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(p))


def discover(spark: SparkSession, roots: str | list[str], suffix: str, recursive: bool = True) -> list[str]:
    """Files with a suffix under several roots, sorted, each once; a root may itself be such a file."""
    found: set[str] = set()
    todo = split_paths(roots)
    while todo:
        at = todo.pop()
        fs, p = _fs(spark, at)
        if not fs.exists(p):
            continue
        if not fs.getFileStatus(p).isDirectory():
            if at.lower().endswith(suffix):
                found.add(fs.resolvePath(p).toString())
            continue
        for path, is_dir in _listed(spark, at):
            if is_dir and recursive:
                todo.append(path)
            elif not is_dir and path.lower().endswith(suffix):
                found.add(path)
    return sorted(found)


def found_files(spark: SparkSession, roots: str | list[str], suffix: str, recursive: bool = True) -> DataFrame:
    """Files with a suffix under several roots, each once: path, length, modified. The cluster lists folders in parallel and keeps the paths; `discover` is for few files."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(split_paths(roots)).select("path", "length", F.col("modificationTime").alias("modified")).dropDuplicates(["path"])


def take_mode(paths: list[str], mode: str = "all") -> list[str]:
    """`one`: the first path; `all`: all of them."""
    if mode not in ("one", "all"):
        raise ValueError(f"mode must be 'one' or 'all', not {mode!r}")
    return paths[:1] if mode == "one" else paths


def has_chunks(spark: SparkSession, directory: str) -> bool:
    return any(not d and p.endswith(".jsonl") for p, d in _listed(spark, f"{directory.rstrip('/')}/chunks"))


def ingested_dirs(spark: SparkSession, roots: str | list[str]) -> list[str]:
    """Folders that hold chunk files: each root, then its children by name; each once."""
    out: list[str] = []
    for root in split_paths(roots):
        for d in (root, *(p for p, is_dir in _listed(spark, root) if is_dir)):
            if d not in out and has_chunks(spark, d):
                out.append(d)
    return out


def chunk_paths(spark: SparkSession, directory: str) -> list[str]:
    """The file of all chunks if it is there, else all chunk files by name; an error if there is none."""
    files = [p for p, d in _listed(spark, f"{directory.rstrip('/')}/chunks") if not d and p.endswith(".jsonl")]
    whole = [p for p in files if p.rsplit("/", 1)[-1] == WHOLE]
    if not files:
        raise FileNotFoundError(f"no chunk files under {directory}")
    return whole or files


def effective_text(text: Column | str = "text", content: Column | str = "content") -> Column:
    """`text`, or `content` where text is null or empty; stripped."""
    t = col(text)
    return strip(F.when(F.coalesce(t, F.lit("")) != "", t).otherwise(col(content)))


def scan_chunks(spark: SparkSession, paths: list[str], index_name: str, schema: T.StructType = CHUNK) -> DataFrame:
    """Chunks of JSONL files: id, chunk_id, text, metadata, chunk_file, index_name. Blank and malformed lines and chunks without text are left out; an error if none is left."""
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("chunk_file")).where(strip("value") != "")
    rows = raw.select("chunk_file", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("c")).where("c is not null")
    rows = rows.select("c.*", "chunk_file").withColumn("text", effective_text())
    rows = rows.where(F.coalesce("text", F.lit("")) != "").withColumns({"chunk_id": F.coalesce("id", "metadata.chunk_id"), "index_name": F.lit(index_name)})
    if rows.isEmpty():
        raise ValueError(f"no chunks with text in {paths}")
    return rows.select("id", "chunk_id", "text", "metadata", "chunk_file", "index_name")


def with_side_files(chunks: DataFrame, files: DataFrame, strip_text: bool = False) -> DataFrame:
    """Text of table chunks replaced by their Markdown side file where there is one. files: path, content. chunks have chunk_type and table_markdown_path."""
    side = files.select(F.col("path").alias("__path"), F.col("content").alias("__md")).dropDuplicates(["__path"])
    hit = (F.col("chunk_type") == "table") & F.col("__md").isNotNull()
    text = strip("__md") if strip_text else F.col("__md")
    return chunks.join(side, F.col("table_markdown_path") == F.col("__path"), "left").withColumn("text", F.when(hit, text).otherwise(F.col("text"))).drop("__path", "__md")


def flat_styling(chunks: DataFrame, styling: str = "styling") -> DataFrame:
    """Style values as columns: css_color, css_font, css_background, styling_raw (JSON)."""
    s = F.col(styling)
    get = lambda k: F.try_element_at(s, F.lit(k))
    return chunks.withColumns({"css_color": get("color"), "css_font": get("fontFamily"), "css_background": get("backgroundColor"), "styling_raw": F.to_json(s)})


def backend(parser: Column | str, ingest_backend: Column | str) -> Column:
    """Backend that wrote a chunk, by its own labels, or null."""
    b = F.lower(F.coalesce(col(ingest_backend), F.lit("")))
    return F.when(F.lower(col(parser)) == "mineru", F.lit("mineru")).when(b.contains("pypdf") | b.contains("simple"), F.lit("simple"))


def detect_backend(chunks: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Backend of each group of chunks: that of the first chunk by `order` that tells one, else `unknown`. One pass, partial aggregation."""
    b = backend("parser", "ingest_backend")
    return chunks.groupBy(*keys).agg(F.coalesce(F.min_by(b, F.when(b.isNotNull(), F.col(order))), F.lit("unknown")).alias("backend"))


def candidate_score(path: Column | str, stem: Column | str, safe: Column | str, v2_suffix: str = "_content_list_v2.json") -> Column:
    """How well an output file fits a document, by its name and path."""
    p, s = F.lower(col(path)), F.lower(col(stem))
    name = F.element_at(F.split(p, "/"), -1)
    plus = lambda cond, n: F.when(cond, n).otherwise(0)
    return plus(name.contains(s), 100) + plus(p.contains(s), 80) + plus(p.contains(F.lower(col(safe))), 40) + plus(name == F.concat(s, F.lit(".md")), 30) + plus(name.endswith(v2_suffix), 10)


def best_candidates(files: DataFrame, fallback: bool = True) -> DataFrame:
    """The best file of each document (doc_key, stem, safe, path, size): highest score, then size, then path; where none fits, the only one there is, if allowed."""
    scored = files.withColumn("score", candidate_score("path", "stem", "safe"))
    w = Window.partitionBy("doc_key").orderBy(F.desc("score"), F.desc("size"), "path")
    only = F.count("*").over(Window.partitionBy("doc_key"))
    best = scored.withColumns({"k": F.row_number().over(w), "n": only}).where("k = 1")
    return best.where((F.col("score") > 0) | (F.lit(fallback) & (F.col("n") == 1))).select("doc_key", "path", "score")


class Policy:
    """When to parse again: an output is used again unless `regenerate`; a failure leaves a marker, after which the simple way is taken without a further try."""

    def __init__(self, regenerate: bool = False, fallback: bool = True):
        self.regenerate, self.fallback = regenerate, fallback

    def decide(self, has_output: bool, has_marker: bool) -> str:
        """`reuse`, `parse`, `simple` or `fail`."""
        if has_output and not self.regenerate:
            return "reuse"
        if has_marker and not self.regenerate:
            return "simple" if self.fallback else "fail"
        return "parse"
