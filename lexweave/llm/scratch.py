"""Tables written to the shared folder of the cluster to cut lineage.

The folder is the session's ``spark.checkpoint.dir``.  Only a local-mode
session without that setting gets a folder of its own, one for the whole
application.  A written table survives lost executors: later stages reread
files, never executor memory.

Tables that later plans may still read stay until the driver ends, when Hadoop's
file system removes them; :func:`forget` removes one whose readers are done.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="lexweave-")
        path = _own[app]
    return path.rstrip("/")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, tag: str) -> str:
    """A path nobody else writes to; what is there goes when the driver ends."""
    path = f"{shared_folder(spark)}/lexweave/{uuid.uuid4().hex}/{tag}"
    files, where = _folder(spark, path)
    files.mkdirs(where.getParent())
    files.deleteOnExit(where.getParent())
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once; the returned frame reads what was written."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Remove the tables of staged frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            files, where = _folder(df.sparkSession, path)
            files.delete(where.getParent(), True)
