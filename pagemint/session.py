"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Rows of a batch that goes to a Python worker, where the session has Spark's own default: texts may be long.
ARROW_ROWS = "1000"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (a shared path, or shipped with --py-files), and
    keep their batches small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, "10000") in (None, "10000"):
        spark.conf.set(rows, ARROW_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HERE not in paths:
        env["PYTHONPATH"] = os.pathsep.join([HERE, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. Where the session names none, a local session
    gets one of its own (tests); a cluster must name one, since a local folder is another one on each machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagemint-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests, the bench and the command line."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagemint")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return importable(spark)
