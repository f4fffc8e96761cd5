"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode with none named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return qualified(spark, named.rstrip("/"))
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="lorekeep-")
    return _own_folders[app]


def qualified(spark: SparkSession, folder: str) -> str:
    """With the scheme of the store that Spark takes it for, so that others who read the store find the same folder."""
    store, path = file_system(spark, folder)
    full = store.makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lorekeep-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, folder: str):
    """The store that a folder is in, and the folder's path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def is_written(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written there to its end."""
    store, done = file_system(spark, f"{folder}/_SUCCESS")
    return store.exists(done)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and not lost with an executor."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan, dealt anew if it has fewer splits than there are cores, as a file of one row group has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
