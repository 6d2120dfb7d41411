"""Chunk files as a stream: new files are read once, late re-deliveries of an id are dropped within a bounded time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import effective_text


def watch(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet chunk files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fresh(chunks: DataFrame, late: str = "7 days") -> DataFrame:
    """Chunks with an id and text, each id once within the watermark on ingested_at; state older than that is dropped."""
    c = chunks.where("id is not null").withColumn("text", effective_text()).where(F.coalesce("text", F.lit("")) != "")
    return c.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["id"])


def arrivals(chunks: DataFrame, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """Chunks by day of ingestion and type, as a watermarked windowed aggregate."""
    c = chunks.where("id is not null").withWatermark("ingested_at", late)
    got = c.groupBy(F.window("ingested_at", width), "chunk_type").agg(F.count("*").alias("n"))
    return got.select(F.col("window.start").alias("start"), "chunk_type", "n")


def run(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to Parquet, everything that is there now; exactly once by the checkpoint."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
