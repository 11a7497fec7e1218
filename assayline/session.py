"""Session construction and the settings the library relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: The folders made for local sessions, by application.
_FOLDERS: dict[str, str] = {}

#: Settings that change results or plan quality.  Sizes are left to AQE.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: str | int = "*", app: str = "assayline", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("ASSAYLINE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**BASE_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` wins.  Only where it is unset and the master is local is a
    temporary folder made, one per application and removed at exit: on a cluster, other
    hosts could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(_FOLDERS[app])
        atexit.register(shutil.rmtree, _FOLDERS[app], ignore_errors=True)
    return _FOLDERS[app]
