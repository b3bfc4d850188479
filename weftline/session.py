"""Session settings and the shared scratch area."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Rows with many columns become one generated method. HotSpot never compiles methods of more than
#: 8,000 bytes and interprets them row by row; with this limit Spark runs such steps one by one,
#: in short methods, with the same results.
METHOD_LIMIT = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; all of them are safe on a cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(map=METHOD_LIMIT)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def limit_methods(spark: SparkSession) -> None:
    """Give a session of others the method limit, unless it has one."""
    for key, value in METHOD_LIMIT.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


_LOCAL_SCRATCH: list[str] = []


def _local_scratch() -> str:
    """One temporary folder of this process for local sessions; it goes when the process ends."""
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="weftline-"))
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[0], ignore_errors=True)
    return _LOCAL_SCRATCH[0]


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder the cluster shares between executors.

    The folder comes from ``spark.checkpoint.dir``; the session is not changed. Only a local
    session, where driver and executors are one machine, may do without the setting and then
    uses a temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        base = _local_scratch()
    return f"{base}/{purpose}-{uuid.uuid4().hex}"


def persist_state(df: DataFrame, purpose: str = "state") -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Cuts lineage without depending on any executor staying alive, and gives the optimiser
    the true size in bytes: joins against the result are broadcast only when that measured
    size is below ``spark.sql.autoBroadcastJoinThreshold`` and are shuffled otherwise. The
    table belongs to the application, whose file system removes it at the end: results that
    read it are lazy, so it can't go earlier.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
