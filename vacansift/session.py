"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vacansift")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        # Rule-heavy work on a table in one file uses all cores.
        .config("spark.sql.files.minPartitionNum", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Plans here have thousands of small expressions; recording the Python
        # call site of each would dominate the time to build them.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (``spark.checkpoint.dir``).

    Where a local session names none, as in tests, one is created. On a cluster every machine has disks of its own, so there a missing
    setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vacansift-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back: work done once, and a short lineage."""
    spark = rows.sparkSession
    folder = new_folder(spark, name)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def read_if_written(spark: SparkSession, schema: str, path: str) -> DataFrame | None:
    """A table of files, or None where nothing was ever written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
