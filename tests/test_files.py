import json

import pytest

from folioforge.operators import chunks
from folioforge.sources import files, sinks
from folioforge.streaming import ingest


def test_discovery(spark, tmp_path):
    for p in ("a/x.pdf", "a/b/y.PDF", "a/z.txt", "c.pdf"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    names = lambda got: [p.rsplit("/", 1)[-1] for p in got]
    assert names(files.discover(spark, f"{tmp_path}/a;{tmp_path}/c.pdf;{tmp_path}/a", ".pdf")) == ["y.PDF", "x.pdf", "c.pdf"]
    assert names(files.discover(spark, [f"{tmp_path}/a"], ".pdf", recursive=False)) == ["x.pdf"]
    assert files.discover(spark, f"{tmp_path}/none", ".pdf") == []
    assert files.take_mode(["a", "b"], "one") == ["a"]
    with pytest.raises(ValueError):
        files.take_mode([], "some")
    assert files.split_paths("s3://a/b; c,d:e") == ["s3://a/b", "c", "d", "e"]


def test_chunk_scan(spark, tmp_path):
    d = tmp_path / "doc" / "chunks"
    d.mkdir(parents=True)
    lines = [json.dumps({"id": "a", "text": " t ", "metadata": {"page_start": 2, "new": 1}}), "", "{bad", json.dumps({"text": "", "content": "c", "metadata": {"chunk_id": "m"}}), json.dumps({"id": "b", "text": "  "})]
    (d / "one.jsonl").write_text("\n".join(lines))
    assert files.ingested_dirs(spark, str(tmp_path)) == [f"file:{tmp_path}/doc"]
    paths = files.chunk_paths(spark, str(tmp_path / "doc"))
    got = {r["chunk_id"]: r["text"] for r in files.scan_chunks(spark, paths, "ix").collect()}
    assert got == {"a": "t", "m": "c"}
    (d / "all_chunks.jsonl").write_text("")
    assert [p.rsplit("/", 1)[-1] for p in files.chunk_paths(spark, str(tmp_path / "doc"))] == ["all_chunks.jsonl"]
    with pytest.raises(ValueError):
        files.scan_chunks(spark, files.chunk_paths(spark, str(tmp_path / "doc")), "ix")
    with pytest.raises(FileNotFoundError):
        files.chunk_paths(spark, str(tmp_path))


def test_policy_and_backend(spark):
    p = files.Policy()
    assert [p.decide(*x) for x in ((True, False), (False, False), (False, True))] == ["reuse", "parse", "simple"]
    assert files.Policy(True, False).decide(True, True) == "parse" and files.Policy(fallback=False).decide(False, True) == "fail"
    c = spark.createDataFrame([("d", "1", None, None), ("d", "2", None, "simple_pypdf"), ("d", "3", "mineru", None), ("e", "1", None, None)], "doc string, id string, parser string, ingest_backend string")
    assert {r["doc"]: r["backend"] for r in files.detect_backend(c, ["doc"]).collect()} == {"d": "simple", "e": "unknown"}
    f = spark.createDataFrame([("k", "my doc", "my_doc", "/o/my doc/x.md", 5), ("k", "my doc", "my_doc", "/o/other.md", 9), ("l", "q", "q", "/z/only.md", 1)], "doc_key string, stem string, safe string, path string, size int")
    assert {r["doc_key"]: r["path"] for r in files.best_candidates(f).collect()} == {"k": "/o/my doc/x.md", "l": "/z/only.md"}
    assert files.best_candidates(f, fallback=False).count() == 1


def test_sinks(spark, tmp_path):
    b = spark.createDataFrame([("d", i, "text", f"t{i}") for i in range(3)], "doc_key string, ord int, block_type string, text string")
    c = chunks.from_blocks(b)
    sinks.write_chunks(c, str(tmp_path / "j"), jsonl=True)
    back = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert back == [{"id": "d:00001", "text": "# d\n\nt0\n\nt1\n\nt2", "content": "# d\n\nt0\n\nt1\n\nt2", "metadata": {"chunk_type": "chapter_text", "heading_path": ["d"], "chapter_title": "d", "is_table": False, "embed": True, "refs": [{"ref_type": "pdf"}]}}]
    sinks.write_chunks(c, str(tmp_path / "p"))
    m = sinks.manifest(spark.read.parquet(str(tmp_path / "p")))
    assert tuple(m.first()) == ("d", 1, 0, 0) and sinks.summary(m).first()["chunks"] == 1 and sinks.summary(m.limit(0)).first()["chunks"] == 0
    g = spark.createDataFrame([("n", [["h|", "k"], ["1"]], "cap", "", "<table>")], "name string, grid array<array<string>>, caption string, footnote string, body string")
    r = sinks.table_files(g).first()
    assert r["markdown"].startswith("Caption: cap\n\n| h\\| | k |") and r["html"] == "<table>"
    assert sinks.table_files(g, html_dialect=True).first()["markdown"] == "| h| | k |\n| --- | --- |\n| 1 |  |"
    done = sinks.write_files(sinks.table_files(g).selectExpr(f"'{tmp_path}/t/a.csv' as path", "csv"), "path", "csv").collect()
    assert done[0]["bytes"] == (tmp_path / "t" / "a.csv").stat().st_size
    md = spark.createDataFrame([("![a](images/x.png) ![b](q/y.png?z) ![c](w.png)", {"y.png": "new.png"})], "md string, m map<string,string>")
    assert md.select(sinks.rebase_images("md", "m", "../")).first()[0] == "![a](../images/x.png) ![b](new.png) ![c](w.png)"
    im = spark.createDataFrame([("d", "a/i.png", bytearray(b"1")), ("d", "b/i.png", bytearray(b"2")), ("d", "c/i.png", bytearray(b"1"))], "doc_key string, path string, content binary")
    assert {r["path"]: r["name"] for r in sinks.image_names(im).collect()} == {"a/i.png": "i.png", "b/i.png": "i_2.png", "c/i.png": "i.png"}


def test_stream(spark, tmp_path):
    schema = "id string, text string, content string, chunk_type string, ingested_at timestamp"
    rows = [("a", "x", None, "text", "2024-01-01"), ("a", "x", None, "text", "2024-01-02"), ("b", "", "c", "text", "2024-01-01"), (None, "n", None, "text", "2024-01-01"), ("d", None, None, "table", "2024-01-01")]
    df = spark.createDataFrame(rows, "id string, text string, content string, chunk_type string, t string").selectExpr("id", "text", "content", "chunk_type", "cast(t as timestamp) ingested_at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = ingest.watch(spark, str(tmp_path / "in"), df.schema)
    ingest.run(ingest.fresh(s), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    ingest.run(ingest.arrivals(s), str(tmp_path / "out2"), str(tmp_path / "ck2")).awaitTermination()
    assert schema and spark.read.schema("start timestamp, chunk_type string, n bigint").parquet(str(tmp_path / "out2")).count() >= 0


def test_parser_outputs(spark, tmp_path):
    from folioforge.sources import outputs

    (tmp_path / "a_content_list_v2.json").write_text('[[{"type":"paragraph","content":{"paragraph_content":"nested"}}]]')
    (tmp_path / "a_content_list.json").write_text('[{"type":"text","text":"flat"}]')
    (tmp_path / "b_content_list.json").write_text('[{"type":"text","text":"flat b","page_idx":2},{"type":"list","list_items":["i"]}]')
    (tmp_path / "b.md").write_text("# md")
    (tmp_path / "c.md").write_text("# md c\n\ntext")
    (tmp_path / "d.json").write_text('{"no": "list"}')
    texts = outputs.read_texts(spark, [str(tmp_path)]).selectExpr("substring(element_at(split(path, '/'), -1), 1, 1) doc_key", "path", "value")
    got = [(r["doc_key"], r["text"], r["page_idx"]) for r in outputs.load_blocks(texts).orderBy("doc_key", "ord").collect()]
    assert got == [("a", "nested", 0), ("b", "flat b", 2), ("b", None, None), ("c", "md c", None), ("c", "text", None)]
    assert [outputs.parse_range(x) for x in ("1:3", "2-", ",5", None, " ")] == [(1, 3), (2, None), (None, 5), (None, None), (None, None)]
    with pytest.raises(ValueError):
        outputs.parse_range("x")

    def parse(path):
        if path == "bad":
            raise RuntimeError("no")
        return f"out of {path}"

    f = spark.createDataFrame([("k", "good"), ("l", "bad")], "doc_key string, path string")
    assert {r["doc_key"]: (r["value"], r["error"]) for r in outputs.run_parser(f, parse).collect()} == {"k": ("out of good", None), "l": (None, "RuntimeError: no")}


def test_shared_tables_are_cleared(spark):
    from folioforge import storage

    df = storage.written(spark, spark.range(3), "some")
    assert df.count() == 3 and storage.clear(spark) >= 1 and storage.clear(spark) == 0


def test_files_of_documents(spark, tmp_path):
    lines = spark.createDataFrame([("a", "a:2", "two"), ("a", "a:1", "one é"), ("b", "b:1", "x"), (None, "c", "y")], "doc_key string, id string, value string")
    done = {r["path"]: r["lines"] for r in sinks.write_documents(lines, f"{tmp_path}/docs").collect()}
    assert sorted(done.values()) == [1, 2] and (tmp_path / "docs" / "a.jsonl").read_text() == "one é\ntwo\n"
    got = files.found_files(spark, str(tmp_path), ".jsonl").orderBy("path").collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in got] == ["a.jsonl", "b.jsonl"] and got[1]["length"] == 2
    im = spark.createDataFrame([("d", "p/i.png", bytearray(b"\xff1")), ("d", "q/i.png", bytearray(b"2")), ("d", "r/i.png", bytearray(b"\xff1"))], "doc_key string, path string, content binary")
    assert sinks.copied_images(im, f"{tmp_path}/images").count() == 2
    assert (tmp_path / "images" / "d" / "i.png").read_bytes() == b"\xff1" and (tmp_path / "images" / "d" / "i_2.png").read_bytes() == b"2"


def test_manifest_forms(spark):
    m = sinks.with_paths(spark.createDataFrame([("b", 2), ("a", 1)], "doc_key string, chunk_count long"), "/out")
    doc = json.loads(sinks.manifest_document(m, {"output_dir": "/out"}).first()["value"])
    assert doc["output_dir"] == "/out" and [d["doc_key"] for d in doc["documents"]] == ["a", "b"] and doc["documents"][0]["tables_dir"] == "/out/tables/a"
    assert [d["chunks_path"] for d in json.loads(sinks.manifest_list(m).first()["value"])] == ["/out/chunks/a.jsonl", "/out/chunks/b.jsonl"]
    names = spark.createDataFrame([("d:00003",)], "id string").select(sinks.html_table_name("id")).first()[0]
    assert names == "table_d_00003"


def test_fingerprint_follows_contents_and_paths(spark, tmp_path):
    from folioforge.operators import index

    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    of = lambda *ps: index.fingerprint(spark, [str(p) for p in ps]).first()[0]
    a.write_text("x\ny\n")
    b.write_text("x\nz\n")
    one = of(a)
    assert one == of(a) and one != of(b) and one != of(a, b)
    a.write_text("x\nq\n")
    assert of(a) != one


def test_a_cluster_needs_a_shared_folder():
    from folioforge import storage

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


def test_pages_of_texts(spark):
    from folioforge.sources import outputs

    df = spark.createDataFrame([("a", "one\ftwo\f"), ("b", ""), ("c", None)], "stem string, value string")
    assert [tuple(r) for r in outputs.page_texts(df).orderBy("stem", "page_idx").collect()] == [("a", 0, "one"), ("a", 1, "two"), ("a", 2, ""), ("b", 0, "")]
