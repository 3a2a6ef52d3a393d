"""Cutting lineage: a table that several steps read is written once to the folder that the cluster shares.

Lost executors then cost a re-read and never a recomputation.  A staged table goes when its operator releases it, and
otherwise when the driver's JVM ends, as a returned DataFrame may still read it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where none is set: a temporary folder in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_at_exit(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes with the driver."""
    path = f"{scratch_dir(spark)}/tessera/{re.sub(r'[^a-z0-9_]', '_', name)}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete staged tables that no later step and no returned DataFrame reads."""
    for t in tables:
        p, fs = _path(t.sparkSession, t.staged_at)
        fs.delete(p, True)
