"""Decontamination against a direct window search."""

from __future__ import annotations

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexweave.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, n_words string", "item_id long, text string, extra int"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expect(docs, items, width=13):
    windows = {}
    for i, text, _ in items:
        w = words(text)
        if i is None or text is None or not w:
            continue
        n = min(width, len(w))
        for k in range(len(w) - n + 1):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, text, _ in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items, **settings):
    got = decontam.inspect(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **settings)
    rows = got.select("row.doc_id", "n_words", "n_hit", "items", "spans").collect()
    for r in rows:
        assert sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_hit"]
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows), key=str)


def test_cases(spark):
    long = " ".join(f"w{k}" for k in range(30))
    items = [(1, long, 0), (2, "short item", 0), (3, None, 0), (None, "w1 w2", 0), (4, "...", 0), (10, "Short-Item", 0), (2, "the the", 0), (5, "É é", 0)]
    docs = [
        (1, long.upper(), "c"), (2, " ".join(f"w{k}" for k in range(12)), "c"), (3, "x " + " ".join(f"w{k}" for k in range(5, 18)) + " y", "c"), (4, None, "c"), (5, "", "c"),
        (6, "a short, item the the the", "c"), (6, "a short, item the the the", "c"), (None, "short item", "c"), (7, "short\x00item", "c"), (8, "é é É é", "c"), (9, "w1 w2 " * 3000, "c"),
    ]
    want = expect(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, part_bytes=40) == want
    assert run(spark, docs, items, part_bytes=40, group_bytes=120) == want  # several groups, merged
    assert run(spark, docs, items, broadcast_words=0) == want
    assert run(spark, docs, []) == expect(docs, [])
    assert run(spark, [], items) == []


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_few_words_many_windows(spark, seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(k, text(rng.randint(1, 9)), 0) for k in range(12)]
    docs = [(k, text(rng.randint(0, 120)), "c") for k in range(30)]
    assert run(spark, docs, items, width=5) == expect(docs, items, 5)


def test_kept_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "short item", "c"), (2, "clean text", "c"), (3, "short item " + "word " * 60, "c")], DOCS)
    items = spark.createDataFrame([(1, "short item", 0)], ITEMS)
    got = decontam.decontaminate(docs, items)
    assert got.columns == docs.columns and [r["doc_id"] for r in got.collect()] == [2]
    shares = decontam.inspect(docs, items).select("row.doc_id", decontam.contaminated()).collect()
    assert sorted(tuple(r) for r in shares) == [(1, True), (2, False), (3, False)]
