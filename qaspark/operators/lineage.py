"""Written tables that end a lineage, and what Python workers need."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The application's folder in the shared folder of `spark.checkpoint.dir`, deleted when the driver ends.

    Where that is unset a machine-local folder is set, on a local master only: on a cluster it is an error.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="qaspark-"))
        path = context._jsc.sc().getCheckpointDir().get()
    path = f"{path.rstrip('/')}/qaspark-{context.applicationId}"
    if path not in _SWEPT:
        _SWEPT.add(path)
        location = context._jvm.org.apache.hadoop.fs.Path(path)
        location.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(location)
    return path


_SWEPT: set[str] = set()


def cut(rows: DataFrame) -> DataFrame:
    """`rows` written as a table in the shared folder and read back: computed once, read by columns."""
    spark = rows.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def ship(spark) -> None:
    """Let Python workers import this package when it is not installed (a cluster gets it by --py-files)."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    root = str(Path(__file__).resolve().parents[2])
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def spread(rows: DataFrame) -> DataFrame:
    """`rows` dealt to all cores where they come from fewer files than there are cores: a small file is often one
    row group, so one task. Tables of many files are left as they are, without a shuffle."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows
