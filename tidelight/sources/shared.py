"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset a folder
    is chosen here: a temporary one for a local master, else one below the
    warehouse, which a cluster shares.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        found = "file://" + tempfile.mkdtemp(prefix="tidelight-")
        _forget_on_exit(spark, found)
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidelight"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _forget_on_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _forget_on_exit(spark, path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it.

    Written files survive the loss of any executor, unlike cached blocks.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote and nothing reads any more."""
    for path in df.inputFiles()[:1]:
        delete_path(df.sparkSession, path.rsplit("/", 1)[0])


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now; it does so when the driver's JVM collects their owners."""
    gc.collect()
    spark._jvm.System.gc()
