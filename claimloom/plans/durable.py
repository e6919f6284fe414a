"""Cutting lineage in a way that outlives lost executors.

Intermediate tables go to the folder that the cluster names in
`spark.checkpoint.dir`, each job's in a folder of its application. Only where
that setting is absent on one machine (tests, a laptop) a folder under /tmp
takes its place; without it on a cluster nothing is written.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """This job's folder among those that all executors share."""
    context = spark.sparkContext
    found = context.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        found = "/tmp/checkpoints"
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(f"{found}/{context.applicationId}")
    return f"{found.rstrip('/')}/{context.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder now and return a scan of what was written.

    The scan is columnar, so later steps read just the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._claimloom_path = path
    return out


def drop(*stored: DataFrame) -> None:
    """Delete what `cut` has stored for these, which nothing may read any more: a loop's former round."""
    for df in stored:
        path = getattr(df, "_claimloom_path", None)
        if path:
            place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def sweep(spark: SparkSession) -> None:
    """Delete what this job, and no other, has written to the shared folder; call it when results are stored."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in (files.listStatus(root) if files.exists(root) else []):
        if re.match("(cut|stream|claims|generated)-", status.getPath().getName()):
            files.delete(status.getPath(), True)
