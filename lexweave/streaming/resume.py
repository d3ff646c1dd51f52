"""Appending translations as they arrive, each entry once.

A file source picks up new result files; every micro-batch drops ids that are
there already and appends the rest.  The checkpoint makes a restart go on where
it stopped, and the anti-join makes a replayed batch harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import TRANSLATION
from ..sources.sinks import append_new


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Translation lines of a folder, as a stream."""
    return spark.readStream.schema(TRANSLATION).option("maxFilesPerTrigger", files_per_batch).json(folder)


def append_stream(lines: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append new ids to ``path``; with ``once`` stop when all files are read."""

    def batch(df: DataFrame, _: int) -> None:
        rows = df.where("coalesce(entry_id, '') <> ''").withColumn("position", F.monotonically_increasing_id())
        append_new(df.sparkSession, rows, path)

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(lines: DataFrame) -> DataFrame:
    """Running count of translated entries by length class (complete mode)."""
    return lines.groupBy(F.when(F.length("ko") > 0, "translated").otherwise("empty").alias("state")).agg(F.count(F.lit(1)).alias("n"))
