"""Tables that a plan writes for itself: in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session's own temporary folder.  On a
    cluster that would be a folder of one machine, so it is an error there."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="indicata-")
    return _local[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; it goes when the session ends."""
    folder = f"{shared_folder(spark)}/indicata-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what follows reads the same rows each time, and a lost
    executor costs no recomputation of what made them."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
