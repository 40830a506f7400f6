"""Session helpers shared by every module."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "gleanery") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GLEANERY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a folder of its own (tests, benchmarks); a cluster is refused.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gleanery-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    # setCheckpointDir appends a random child; the setting itself is the stable root
    return sc.getConf().get("spark.checkpoint.dir") or named


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder for what a run keeps there; it is removed when the driver's process ends."""
    uri = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"

    def end() -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            remove(spark, uri)

    atexit.register(end)
    return uri


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by their keys for work whose cost doesn't show in bytes: a small file may be one task's."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def keep(df: DataFrame, kind: str) -> DataFrame:
    """Rows written to the shared folder once, for plans that read them more than once."""
    root = scratch(df.sparkSession, kind)
    df.write.parquet(root)
    return df.sparkSession.read.schema(df.schema).parquet(root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
