"""Tables that cut a lineage, in the folder shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FOLDER = "spark.checkpoint.dir"


def staging_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where that is unset, a folder of our own in local mode (tests), in which all share one disk; an error elsewhere."""
    named = spark.conf.get(FOLDER, None) or spark.sparkContext.getConf().get(FOLDER)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{FOLDER} must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set(FOLDER, named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df computed once; a lost executor loses nothing of it.

    The table stays in the shared folder until its owner clears it, as results that read it are lazy."""
    return staged_at(df, name)[0]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A staged table and its path, for removed()."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged_counted(df: DataFrame, name: str) -> tuple[DataFrame, str, int]:
    """A staged table, its path and its rows, counted while they are written."""
    seen = Observation()
    path = new_path(df.sparkSession, name)
    df.observe(seen, F.count("*").alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path, seen.get["n"]


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables that nothing reads any more, such as the earlier rounds of a loop."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
