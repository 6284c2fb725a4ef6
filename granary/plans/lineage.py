"""Cutting lineage: rows written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Workers find this package where the driver did, from whatever folder it was started; elsewhere the path does nothing."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([x for x in have if x] + [root])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode (tests), where all share one disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return sc.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys over all shuffle partitions, however few their bytes: for what makes many rows of each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def keep(df: DataFrame) -> DataFrame:
    """The same rows, from files that outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def release(*kept: DataFrame | None) -> None:
    """Deletes the files of tables that keep() made and nothing reads any more; others are left alone."""
    for df in kept:
        path = getattr(df, "_kept", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(target, True)
