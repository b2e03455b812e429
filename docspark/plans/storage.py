"""Tables that cut a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    Where it is unset, a session on one machine gets a temporary folder; a cluster must name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="docspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it back."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)  # tables of texts stay until the application ends
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs.

    Spark removes them once the driver's garbage collector finds their plans unused; asking for that between
    large steps keeps disks from holding every shuffle of a long job at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
