"""Tables written to the shared folder between the steps of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors can read.

    Only where the setting is absent and Spark runs in one process (tests) is a local folder taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-quill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quill-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)  # frees its buffers at once; the default's wait for a collection
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a table of stage_table that no later plan reads."""
    spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
