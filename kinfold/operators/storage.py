"""Lineage cuts: a frame written as a table in the folder that the cluster shares, and read again."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from kinfold.errors import ConfigurationError

#: Folder of stored tables below the shared one.
PREFIX = "kinfold"
#: Whether Spark deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.lru_cache(maxsize=8)
def _own_folder(app_id: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="kinfold-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local temporary folder if the master is local (tests);
    on a cluster that is an error, as executors would not see each other's files."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{PREFIX}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again. The shuffle files of the write go when it has ended: nothing reads them after that."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again (their frames come from stored() as they are)."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/{PREFIX}/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
