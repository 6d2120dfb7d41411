"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or the one set on the context. Where neither is set, a temporary one for a session on one machine; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="folioforge-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


_kept: dict[str, list[str]] = {}


def clear(spark: SparkSession) -> int:
    """Delete the tables that this application wrote to the shared folder; results read from them are gone. Gives their number."""
    paths = _kept.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def keep(spark: SparkSession, path: str) -> str:
    """Note a table written under a path of its own, for `clear`."""
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def kept(spark: SparkSession, path: str) -> bool:
    """Whether a table that this application wrote has not been cleared."""
    return path in _kept.get(spark.sparkContext.applicationId, [])


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives the loss of executors."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep(spark, path)
    return spark.read.schema(df.schema).parquet(path)
