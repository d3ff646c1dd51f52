"""Readers: entry corpora, dictionary registry, lists, translations, indices."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DICT, ENTRY, TRANSLATION


def read_entries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSONL entries; blank and malformed lines are skipped."""
    df = spark.read.schema(ENTRY).option("mode", "DROPMALFORMED").json(path)
    return df if limit is None else df.limit(limit)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Per file, lines that are no JSON object (what the reader above drops)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line <> ''")
    parsed = F.try_parse_json("line")
    bad = parsed.isNull() | (F.schema_of_variant(parsed).startswith("OBJECT") == F.lit(False))
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("malformed"))


def read_dicts(spark: SparkSession, pattern: str, slugs: list[str] | None = None, strict: bool = False) -> DataFrame:
    """One registry row per ``meta.json``; ``strict`` fails on a malformed one."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    df = spark.read.schema(DICT).option("multiLine", True).option("mode", mode).json(pattern)
    return df.where(F.col("slug").isin(slugs)) if slugs else df


def by_priority(dicts: DataFrame) -> DataFrame:
    """Registry in (priority, slug) order, with that order as a column."""
    return dicts.orderBy("priority", "slug")


def rank_lines(lines: DataFrame) -> DataFrame:
    """(rank, norm) from numbered lines (line_no, value): blanks do not count.

    Ranks are made in two steps, so no task sorts the whole list."""
    kept = lines.select("line_no", F.trim("value").alias("norm")).where("norm <> ''")
    return dense_rank_by(kept, "line_no").select(F.col("position").alias("rank"), "norm")


def dense_rank_by(df: DataFrame, order: str, bucket: int = 65536) -> DataFrame:
    """Adds ``position`` 1.. by a numeric column: counted within ranges of its
    values, then offset by the ranges before."""
    from pyspark.sql import Window

    cut = df.withColumn("__range", F.floor(F.col(order) / bucket))
    sizes = cut.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__range").orderBy(order)
    return cut.withColumn("__row", F.row_number().over(own)).join(sizes, "__range").withColumn("position", F.col("__before") + F.col("__row")).drop("__range", "__row", "__before")


def read_sqlite(spark: SparkSession, paths: list[str], query: str, schema: str) -> DataFrame:
    """Rows of ``query`` over SQLite files, one task a file; text NULLs stay."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                    yield from pd.read_sql_query(query, con, chunksize=10_000)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return files.mapInPandas(scan, schema)


def raw_entries(rows: DataFrame, dict_ids: list[int], limit: int | None = None) -> DataFrame:
    """Raw entries of some dictionaries, nulls as empty, at most ``limit`` each
    by id."""
    from pyspark.sql import Window

    kept = rows.where(F.col("dict_id").isin(dict_ids)).fillna("")
    if limit is not None:
        kept = kept.withColumn("__row", F.row_number().over(Window.partitionBy("dict_id").orderBy("id"))).where(F.col("__row") <= limit).drop("__row")
    return kept


def resolve_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(slug, name, dict_id); a name that is not known keeps a null id."""
    return wanted.join(known.select("name", F.col("id").alias("dict_id")), "name", "left").select("slug", "name", "dict_id")


def read_translations(lines: DataFrame) -> DataFrame:
    """(entry_id, ko): blank ones are dropped, of a repeated id the last wins.

    ``lines`` has line_no and the translation's fields."""
    ok = lines.where("coalesce(entry_id, '') <> ''").withColumn("ko", F.trim("ko")).where("ko <> ''")
    return ok.groupBy("entry_id").agg(F.max_by("ko", "line_no").alias("ko"))


def translation_lines(spark: SparkSession, path: str) -> DataFrame:
    """Translation lines of a JSONL path with their order: file, then block of
    the file, then line (a block is one task's, where numbers increase)."""
    df = spark.read.schema(TRANSLATION).option("mode", "DROPMALFORMED").json(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return df.withColumn("line_no", place)


def headword_lines(value: Column) -> tuple[Column, Column]:
    """(norm, iast) of a ``norm TAB iast`` line, split at the first tab; both
    are null for blank lines and lines without a tab."""
    parts = F.split(value, "\t", 2)
    ok = (F.trim(value) != "") & (F.instr(value, "\t") > 0)
    return F.when(ok, parts[0]), F.when(ok, parts[1])


def page_cache(pages: DataFrame, langs: str, psm: int, dpi: int, columns: int) -> DataFrame:
    """Cached page texts that were read with exactly these settings."""
    return pages.where((F.col("langs") == langs) & (F.col("psm") == psm) & (F.col("dpi") == dpi) & (F.col("columns") == columns))


def load_status(states: DataFrame) -> DataFrame:
    """Overall status of (bundle, index, status): error, else all done, else
    decoding, else fetching, else pending."""
    has = lambda s: F.bool_or(F.col("status") == s)
    overall = (
        F.when(has("error"), "error")
        .when(F.bool_and(F.col("status") == "done"), "done")
        .when(has("decoding"), "decoding")
        .when(has("fetching"), "fetching")
        .otherwise("pending")
    )
    return states.groupBy("bundle").agg(overall.alias("status"))


def reverse_meta_defaults(meta: DataFrame) -> DataFrame:
    """Missing members of a reverse-meta record as empty ones."""
    return meta.select(
        F.coalesce("dicts", F.array().cast("array<string>")).alias("dicts"),
        F.coalesce("ids", F.create_map().cast("map<string,struct<iast:string,dict:int>>")).alias("ids"),
    )


def batch_status(jobs: DataFrame) -> DataFrame:
    """Jobs, requests and results by state."""
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.sum("requests").alias("requests"), F.sum("results").alias("results"))


def register(spark: SparkSession, bundle: dict[str, DataFrame], prefix: str = "") -> None:
    """Indices as temporary views; written ones are read with their filters pushed down."""
    for name, df in bundle.items():
        df.createOrReplaceTempView(prefix + name)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index that :func:`lexweave.sources.sinks.write_index` wrote."""
    return spark.read.parquet(path)
