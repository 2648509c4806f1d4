"""Tables of a running computation, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def base(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session on one machine may do without the setting."""
    found = spark.conf.get(SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def keep(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends there."""
    path = f"{base(spark)}/cadenza-work-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_in = path
    return kept


def drop(kept: DataFrame) -> None:
    """Delete a table that ``keep`` gave and that nothing reads any more."""
    delete(kept.sparkSession, kept.kept_in)
