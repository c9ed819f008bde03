"""Tables of a folder, and tables written to the shared folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a folder of this machine, but never on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridweave-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """df as a Parquet table that survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gridweave_path = path
    return out


def discarded(df: DataFrame) -> None:
    """Removes a table of materialised() that nothing reads any more."""
    path = getattr(df, "_gridweave_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, for sources that read and write files by themselves, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
