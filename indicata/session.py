"""Session helpers.

On a cluster the session is created by the platform; ``get_session`` only
fills settings that are still unset, so cluster-wide values win.
"""

from __future__ import annotations

import os

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Settings every job relies on: runtime re-planning (coalescing, skew-join
# splitting, broadcast conversion from measured sizes) and UTC timestamps so
# date parts agree with the SQL oracle.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "indicata",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """The session of the process, or a new one.  What was submitted (or is set
    on a session that runs) wins over the defaults here; the arguments win over both."""
    asked = {k: str(v) for k, v in (extra or {}).items()}
    if shuffle_partitions:
        asked["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    defaults = dict(_DEFAULTS)
    if master:
        # Replicate designs aggregate 81 weight columns at once; the JIT
        # must compile the resulting large generated methods.  On a cluster
        # the same flag belongs in spark.executor.extraJavaOptions.
        defaults |= {"spark.driver.memory": os.environ.get("INDICATA_DRIVER_MEMORY", "16g"),
                     "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods"}
    if SparkSession.getActiveSession() is None:
        # the JVM starts with what it needs to start; then the submitted settings can be read
        start = SparkConf(loadDefaults=False)
        for k in ("spark.driver.memory", "spark.driver.extraJavaOptions"):
            if k in defaults and k not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
                start.set(k, defaults[k])
        SparkContext._ensure_initialized(conf=start)
        submitted = SparkConf()
        asked = {k: v for k, v in defaults.items() if not submitted.contains(k)} | asked
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in asked.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
