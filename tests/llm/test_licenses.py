"""Licence scan against a direct Dice loop."""

from __future__ import annotations

import re

from lexweave.llm import licenses

SCHEMA = "doc_id long, text string, license string, n int"


def grams(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.sub("[^a-z0-9]+", " ", folded).strip(" ").split(" ")
    return set(zip(words, words[1:]))


def expect(rows, templates=licenses.TEMPLATES, least=0.8):
    out = set()
    for doc, text, *_ in rows:
        if text is None:
            continue
        units = [(k, p) for k, p in enumerate(re.split(licenses.SENTENCE_END, text))] + [(-1, text)]
        for start, passage in units:
            own, best = grams(passage), None
            for name, body in templates:
                of = grams(body)
                if own and of:
                    dice = 2 * len(own & of) / (len(own) + len(of))
                    if dice >= least - 1e-12 and (best is None or (-dice, name) < best):
                        best = (-dice, name)
            if best:
                out.add((doc, start, passage, best[1], round(-best[0], 9)))
    return out


def run(spark, rows, templates=licenses.TEMPLATES, **settings):
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA), licenses.template_table(spark, templates), **settings).collect()
    return {(r["doc_id"], r["start"], r["passage"], r["license"], round(r["dice"], 9)) for r in got}


ROWS = [
    (1, "Text here.\nReleased under the MIT License.\nMore", "x", 1), (2, "Licensed under CC BY-NC 4.0. Then more text follows here", "x", 1),
    (3, "This work is licensed under the GNU General Public License, version 2", "x", 1), (4, None, "x", 1), (5, "", "x", 1), (6, "word", "x", 1),
    (7, "Released under MIT License", "x", 1), (8, "under the Apache License Version 2.0 we license", "x", 1), (None, "Licensed under the ISC License.", "x", 1),
    (9, licenses.TEMPLATES[-1][1].replace(", ", ",\n"), "x", 1), (10, "ab " * 5000, "x", 1), (11, "É. ẞ!  ?", "x", 1), (1, "Released under the MIT License.", "x", 1),
    (12, " ".join([licenses.TEMPLATES[-1][1]] * 40), "x", 1), (13, "LICENSED UNDER THE MIT LİCENSE; licensed under the mit license", "x", 1),
]


def test_cases(spark):
    assert run(spark, ROWS) == expect(ROWS)


def test_ties_repeats_and_other_thresholds(spark):
    templates = [("B", "alpha beta gamma delta"), ("A", "alpha beta gamma delta"), ("C", None), ("D", "x")]
    rows = [(1, "alpha beta gamma delta", "x", 1)] * 2 + [(2, "alpha beta gamma zeta", "x", 1)]
    for least in (0.8, 0.6):
        want = expect(rows, [t for t in templates if t[1]], least)
        assert run(spark, rows, templates, least=least) == want
        assert run(spark, rows, templates, least=least, broadcast_rows=0) == want
    assert {r[3] for r in run(spark, rows, templates)} == {"A"}


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, ROWS, [("X", "x")]) == set()


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], "", 1) for r in docs.collect()]
    assert run(spark, rows) == expect(rows)


def test_no_python_in_the_plan(spark):
    frame = licenses.scan(spark.createDataFrame(ROWS, SCHEMA), licenses.template_table(spark))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
