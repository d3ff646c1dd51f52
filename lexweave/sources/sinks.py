"""Writers: Spark's commit protocol stands for temporary names and renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, null members left out; replaces what is there once all is written."""
    rewrite(df.sparkSession, df, path)


def write_index(df: DataFrame, path: str) -> None:
    """An index as zstd Parquet."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def headword_file(df: DataFrame) -> DataFrame:
    """Lines ``norm TAB iast`` sorted by norm (a range-partitioned sort)."""
    return df.orderBy("norm", "iast").select(F.concat_ws("\t", "norm", "iast").alias("value"))


def write_headwords(df: DataFrame, path: str) -> None:
    headword_file(df).write.mode("overwrite").text(path)


def score_list(df: DataFrame) -> DataFrame:
    """Ranked list with scores to three decimals."""
    return df.select("rank", "norm", F.round("score", 3).alias("score"))


def meta_json(columns: list[str]) -> Column:
    """A registry row as JSON in column order; null and empty members go, false
    and zero stay."""
    return F.to_json(F.struct(*[F.expr(f"nullif({c}, '')").alias(c) if kind == "string" else F.col(c) for c, kind in (x.split(":") for x in columns)]))


def chunk_of(position: Column, size: int = 100_000) -> Column:
    """1-based chunk of a 1-based position."""
    return (F.floor((position - 1) / size) + 1).cast("long")


def write_chunks(df: DataFrame, path: str, size: int = 100_000) -> None:
    """Requests in chunks of ``size``, in their order."""
    df.withColumn("chunk", chunk_of(F.col("position"), size)).write.mode("overwrite").partitionBy("chunk").json(path)


def append_new(spark: SparkSession, df: DataFrame, path: str, key: str = "entry_id") -> DataFrame:
    """Append rows whose key is not there yet, one for each key (the first by
    ``position``); returns what was appended."""
    first = Window.partitionBy(key).orderBy("position")
    fresh = df.withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        there = spark.read.schema(df.schema).json(path).select(key)
        fresh = fresh.join(there, key, "left_anti")
    fresh.write.mode("append").json(path)
    return fresh


def rewrite(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace a path by a frame that may read it: staged, then swapped.

    What was there is moved aside and removed last; a rewrite that stopped
    between the moves is undone by :func:`recover`, which readers and the next
    rewrite may call."""
    base = path.rstrip("/")
    recover(spark, path)
    df.write.mode("overwrite").json(f"{base}.staged")
    fs, at = _files(spark, path)
    if fs.exists(at(base)) and not fs.rename(at(base), at(f"{base}.previous")):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(at(f"{base}.staged"), at(base)):
        recover(spark, path)
        raise OSError(f"cannot replace {path}")
    fs.delete(at(f"{base}.previous"), True)


def recover(spark: SparkSession, path: str) -> None:
    """Bring back what an interrupted rewrite had moved aside."""
    base = path.rstrip("/")
    fs, at = _files(spark, path)
    if fs.exists(at(f"{base}.previous")):
        if fs.exists(at(base)):
            fs.delete(at(f"{base}.previous"), True)
        else:
            fs.rename(at(f"{base}.previous"), at(base))


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report table; for aggregates only, at most ``limit`` rows."""
    rows = df.limit(limit).collect()
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
