"""Queries over whole texts, against loops in Python."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexweave.operators import quality
from lexweave.plans import catalog

TEXTS = {
    1: "short, one. two, three", 2: "far " * 600 + "one, two. three, four. five", 3: "x" * 2500 + ", a. b", 4: "no marks at all", 5: None, 6: "",
}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    def run(name, texts):
        path = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        return [tuple(r) for r in catalog.QUERIES[name](spark, path).collect()]

    return run


def test_senses_of_long_documents(rows):
    want = set()
    for doc, text in TEXTS.items():
        parts = re.split(r" (\d+)\. ", (text or "").replace(", ", " 1. ").replace(". ", " 2. "))
        if len(parts) >= 5:
            found = [(n, t.strip()) for n, t in zip(["1", *parts[1::2]], parts[::2]) if t.strip()]
            want |= {(doc, pos, n, t) for pos, (n, t) in enumerate(found)}
    got = rows("senses_of_documents", TEXTS)
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[0] for r in got} == {1, 2, 3}


def test_terms_and_words_far_into_a_text(rows):
    texts = {1: "a b, " + "x" * 400 + ", dharma; ab，karma。 '1', z", 2: "abcdefghijklmnop " * 30 + "aamala", 3: "", 4: None}
    terms = {r[0]: r[2] for r in rows("sanskrit_terms", texts)}
    assert terms == {1: "|".join(["a b", "x" * 400, "dharma", "ab", "karma. '1'"]), 2: "abcdefghijklmnop " * 30 + "aamala", 3: "", 4: None}
    heads = dict(rows("representative_synonyms", texts))

    def score(w):
        n, vowels = len(w), sum(c in "aāiīuūṛṝḷḹeo" for c in w)
        return round(-10.0 if n < 3 else -abs(n - 6) * 0.3 + (vowels / n - 0.3) * 5, 9)

    want = {}
    for doc, text in texts.items():
        words = [w for w in (text or "").split(" ") if re.fullmatch("[a-z]+", w)]
        if words:
            want[doc] = max(words, key=score)
    assert heads == want and heads[2] == "aamala"


def test_delimiters_and_signs_far_into_a_text(rows):
    far = "word " * 30
    texts = {1: far + "{x", 2: "{a<b", 3: "a\tb\nc", 4: "\ta\rb", 5: far + "\nend", 6: far + "Aa#", 7: far, 8: None, 9: " a<b{c "}

    def clean(head):
        head = head.strip(" ")
        for mark in "\n\t\r{<":
            head = head[: head.index(mark)] if head.find(mark) > 0 else head
        return head.strip()

    assert dict(rows("clean_headwords", texts)) == {k: None if t is None else clean(t) for k, t in texts.items()}
    got = {r[0]: r[1:] for r in rows("valid_forms", texts)}
    assert got[7] == (True, True, False) and got[6][:2] == (False, False) and got[6][2]
    assert got[1][:2] == (False, False) and got[5][:2] == (False, False)


CLASSES = {
    None: "other", "": "other", "12 !\n": "other", "éè, à": "other", "ß😀": "other", "É ê": "other", "法": "other", "法豈 é": "other", "Ａ": "other",
    "abc": "latin", "法 abc": "latin", "x豈": "latin", "É ê x": "latin", "e\u0301": "latin", "à la": "mixed", "ab\n\0ñ": "mixed", "法 é x": "mixed",
}


def test_content_classes_of_odd_texts(rows):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(CLASSES)))
    got = sorted(rows("content_classes", dict(enumerate(CLASSES))))
    assert got == sorted(Counter(CLASSES.values()).items()) == sorted(con.sql(catalog.ORACLE["content_classes"]).fetchall())
    for name in set(CLASSES.values()):
        texts = {doc: text for doc, text in enumerate(CLASSES) if CLASSES[text] == name}
        assert rows("content_classes", texts) == [(name, len(texts))]


def test_content_class_of_han(spark):
    texts = {"法": "cjk", "豈 1": "cjk", "法 abc": "mixed", "abc": "latin", "é": "other", "": "other", None: "other"}
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", quality.content_class(F.col("text"))).collect()
    assert {r[0]: r[1] for r in got} == texts
