"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that its
predecessor kept; its result is written and reread as the next one's ``docs``.
All stages but the last return the columns of ``documents``.

* toxicity: documents that the severity model holds for toxic go.
* language: documents that are far from every language's codeword, or about as
  near to two of them, go, and so do those without a letter.
* neardup: one document of each group of near-duplicates stays.
* decontaminate: documents that hold any benchmark window go.
* pack: what is left is tokenised and packed into sequences of 1024.

An empty table passes through every stage and packs to no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import decontam, langid, neardup, packing, scratch, toxicity
from lexweave.llm.queries import default_encoder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model).where(~toxicity.toxic()).select("row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identify(docs, langid.train(docs)).where(langid.accepted()).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a pipeline stage links at a similarity of 0.8 or more
    return neardup.deduplicate(docs, neardup.Settings(percent=80, bands=25, rows=5, bands_per_batch=5))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, default_encoder())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("neardup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: Fitted models, MinHash candidates and packing have no SQL form; the tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
