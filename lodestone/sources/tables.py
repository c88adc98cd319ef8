"""Parquet table access and the shared folder. Only Spark's readers and Hadoop's file systems touch paths."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Per application without spark.checkpoint.dir: the folder made for it.
_made: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, with pushdown and pruning left to Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else a temporary one for a local master only."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if (app := spark.sparkContext.applicationId) not in _made:
        _made[app] = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, _made[app], ignore_errors=True)
    return f"file://{_made[app]}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, in the shared one. It goes when the driver's JVM ends, or by clean()."""
    folder = f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"
    fs, p = file_system(spark, folder)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return folder


def clean(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Results that have not been read or written yet need them."""
    fs, p = file_system(spark, scratch_dir(spark))
    fs.delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the scratch folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
