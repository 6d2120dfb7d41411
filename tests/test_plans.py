"""What the plans must look like to hold at scale."""

import os
import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def _plan(spark, name):
    df = entry.queries()[name](spark, DATA)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode), df


def _exchanges(plan):
    return len(re.findall(r"^\(\d+\) Exchange\b", plan, re.M))


def test_chunks_from_blocks(spark):
    """One exchange for windows and segments, one behind the parser for the numbering; tables are parsed once."""
    plan, _ = _plan(spark, "block_chunks")
    assert _exchanges(plan) == 2 and len(re.findall(r"^\(\d+\) ArrowEvalPython", plan, re.M)) == 1


def test_counts_are_partial(spark):
    for name in ("detect_backend", "manifest", "last_user_message", "document_identity"):
        plan, _ = _plan(spark, name)
        assert "partial_" in plan, name


def test_columns_are_pruned_and_filters_pushed(spark):
    plan, _ = _plan(spark, "metadata_filter")
    schema = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert "text:" not in schema and "EqualTo(chunk_type,table)" in plan
    plan, _ = _plan(spark, "last_user_message")
    assert "EqualTo(msg_role,user)" in plan and "sent_at" not in plan


def test_top_k_is_cut_before_the_exchange(spark):
    plan, _ = _plan(spark, "vector_topk")
    assert len(re.findall(r"^\(\d+\) WindowGroupLimit", plan, re.M)) == 2


def test_no_cartesian_products(spark):
    for name in ("bm25_topk", "hybrid_retrieve", "context_pack", "cite_renumber", "manifest_check"):
        plan, _ = _plan(spark, name)
        assert "CartesianProduct" not in plan, name


def test_text_functions_stay_on_the_jvm(spark):
    for name in ("normalize_text", "safe_filename", "chunk_sliding_window", "heading_path", "markdown_blocks", "looks_like_heading", "context_pack", "cite_rewrite"):
        plan, _ = _plan(spark, name)
        assert "Python" not in plan and "MapIn" not in plan, name
