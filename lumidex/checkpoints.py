"""Cutting the lineage of a table in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where that is unset, a session with a local master gets a temporary folder, removed at
    the end; on a cluster it is an error, as no folder of one machine is seen by the others.
    """
    sc = spark.sparkContext
    where = sc._jsc.sc().getCheckpointDir()
    if where.isDefined():
        return where.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()
