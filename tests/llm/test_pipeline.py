"""The pipeline's stages on planted rows, and the registered queries."""

from __future__ import annotations

import random

import pytest
from compare import assert_same

import corpus_pipeline
from lexweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(name, spark, sf_dir, duck):
    assert assert_same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE[name]) or name == "op5_license_scan"


def _corpus(spark, tmp_path):
    rng = random.Random(0)
    text = lambda n=80: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    docs, labels = [], []
    for k in range(300):
        t = text()
        if k % 5 == 0:
            t += (" vilest", " zorgling", " vilest zorgling vilest")[k // 5 % 3]
        docs.append((k, t, "en", "s", len(t)))
        if k % 2 == 0:
            labels.append((k, 1, 1 if k % 5 == 0 else 0))
    item = text(20)
    base = docs[1][1].split()
    near = base[:40] + ["changed"] + base[41:]
    planted = {
        1000: docs[1][1], 1001: " ".join(near), 1002: docs[2][1] + " vilest", 1003: "123 456 !", 1004: None,
        1005: docs[3][1] + " " + item, 1006: text() + " " + item[:60], 1007: text(3000),
        1008: text(2000) + " " + item + " " + text(2000), 1009: text(900) + " " + " ".join(item.split()[4:17]),
    }
    docs += [(k, t, "en", "s", len(t or "")) for k, t in planted.items()]
    where = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, docs


def test_planted_rows(spark, tmp_path):
    where, docs = _corpus(spark, tmp_path)
    now = spark.read.parquet(f"{where}/documents.parquet")
    ids, kept = {r[0] for r in docs}, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, now, where)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == now.columns and df.schema.simpleString() == now.schema.simpleString()
        df.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        left = {r["doc_id"] for r in now.select("doc_id").distinct().collect()}
        kept.append(ids - left)
        ids = left
    toxic = {k for k in range(0, 300, 5)} | {1002}
    assert kept[0] == toxic
    assert kept[1] == {1003, 1004}
    assert kept[2] == {1000, 1001}
    assert kept[3] == {1005, 1008, 1009}
    assert kept[4] == set() and {1006, 1007} <= ids
    run = {r["doc_id"] for r in corpus_pipeline.run(spark, where).select("doc_id").distinct().collect()}
    assert run == ids


def test_empty_documents(spark, tmp_path):
    where, _ = _corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{where}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, where).count() == 0
