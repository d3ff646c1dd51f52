"""Language identification and toxicity: held-out accuracy, decoding, edge rows."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import langid, toxicity, wordhash
from lexweave.llm.queries import op9_language_id, op10_toxicity

DOCS = "doc_id long, text string, lang string, source string, score string"


# --- language -------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 20])
def test_codewords_are_apart(n):
    codes = langid.codewords(n)
    assert codes.shape[0] == n and set(np.unique(codes)) <= {-1.0, 1.0}
    assert len(np.unique(codes, axis=0)) == n
    if 3 <= n <= 7:
        assert min((codes[a] != codes[b]).sum() for a in range(n) for b in range(a)) == 2 ** (n - 2)


def test_held_out_accuracy(spark, sf_dir):
    rows = op9_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert len(held) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_predictions_of_edge_rows(spark):
    train = [(k, t, lang, "s", "c") for k, (t, lang) in enumerate([("the cat sat on the mat and ran", "en"), ("der hund und die katze sind schön", "de"), ("le chat et la souris où été", "fr")] * 12)]
    docs = spark.createDataFrame(train + [(100, None, "en", "s", "c"), (101, "", "en", "s", "c"), (102, "123 — …!", None, "s", "c"), (103, "été", None, "s", "c"), (None, "the mat", "xx", "s", "c"), (104, "法", None, None, None), (104, "法", None, None, None)], DOCS)
    model = langid.train(docs)
    assert model.languages == ["de", "en", "fr"]
    got = langid.identify(docs, model).selectExpr("row.doc_id", "lang_pred", "score as p").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(train) + 7
    assert [by[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and by[100]["p"] == 0
    assert by[103]["lang_pred"] == "fr" and by[None]["lang_pred"] == "en" and by[104]["lang_pred"] in model.languages
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.train(docs.limit(0)) is None and langid.identify(docs.limit(0), model).count() == 0


def test_one_language_and_long_texts():
    model = langid.fit(["en"] * 3, np.random.default_rng(0).random((3, 8192)).astype(np.float32))
    names, score, _, _ = langid.predict(model, pa.array(["abc", "abc " * 400_000, None]))
    assert names == ["en", "en", "und"] and score[0] == 1


def test_pieces_of_a_long_text_add_up():
    rng = np.random.default_rng(1)
    x = rng.random((8, 8192)).astype(np.float32)
    model = langid.fit(["a", "b"] * 4, x)
    text = "".join(rng.choice(list("abcdefg hij"), 1_300_000))
    whole = sum(np.bincount(c, minlength=8192) @ model.weights for _, c in langid.gram_codes(np.frombuffer(text.encode(), np.uint8), 8192)) / len(text)
    _, score, _, _ = langid.predict(model, pa.array([text]))
    value = whole + model.bias
    loss = np.logaddexp(0, -value * model.codes)
    d = (loss * model.trust).sum(axis=1) * model.codes.shape[1]
    p = np.exp(d.min() - d)
    assert abs(score[0] - p.max() / p.sum()) < 1e-6


def _direct(model, text):
    """Decoding of one text in plain Python: (language, score, distance)."""
    data = (text or "").encode()
    symbol = [b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else b - 101 if b >= 128 else 0 for b in data]
    features, bits = model.weights.shape
    value = [float(b) for b in model.bias]
    for order in (1, 2, 3):
        for k in range(len(symbol) - order + 1):
            code = 0
            for x in symbol[k : k + order]:
                code = (code * 157 + x) % 2**32
            slot = ((code + order) * 0x9E3779B1 % 2**32) >> (33 - features.bit_length())
            for b in range(bits):
                value[b] += float(model.weights[slot, b]) / len(data)
    far = [sum(t * math.log1p(math.exp(-v * c)) for v, c, t in zip(value, code, trust, strict=True)) for code, trust in zip(model.codes, model.trust, strict=True)]
    p = [math.exp(bits * (min(far) - d)) for d in far]
    return model.languages[far.index(min(far))], max(p) / sum(p), min(far)


def test_predictions_match_direct_decoding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model, ["doc_id"]).select("row.doc_id", "lang_pred", "score", "distance").collect()}
    asked = {r["doc_id"]: r["lang_pred"] for r in op9_language_id(spark, sf_dir).collect()}
    for r in docs.select("doc_id", "text").collect():
        own = got[r["doc_id"]]
        if own["lang_pred"] == "und":
            assert not any(map(str.isalpha, r["text"] or "")) and own["distance"] is None
            continue
        name, score, far = _direct(model, r["text"])
        assert own["lang_pred"] == name == asked[r["doc_id"]]
        assert abs(own["score"] - score) < 1e-3 and abs(own["distance"] - far) < 1e-3


def test_texts_of_no_language_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    noise = [(-1 - k, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600))) for k in range(40)]
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    both = docs.union(spark.createDataFrame(noise, "doc_id long, text string"))
    kept = {r[0] for r in langid.identify(both, model).where(langid.accepted()).select("row.doc_id").collect()}
    real = {r[0] for r in docs.collect()}
    assert len(kept & real) >= 0.99 * len(real) and sum(k < 0 for k in kept) <= 10
    # without a model nothing speaks against a text with letters
    kept = langid.identify(spark.createDataFrame([(1, "abc"), (2, "1"), (3, None)], "doc_id long, text string"), None).where(langid.accepted())
    assert [r[0] for r in kept.select("row.doc_id").collect()] == [1]


def _likelihood(x, grade, weight, w, theta, base=0.0):
    total = 0.0
    for row, g, own in zip(x, grade, weight, strict=True):
        s = float(row @ w) + base
        up = 1.0 if g == len(theta) else 1 / (1 + math.exp(s - theta[g]))
        down = 0.0 if g == 0 else 1 / (1 + math.exp(s - theta[g - 1]))
        total += own * math.log(max(up - down, 1e-12))
    return total / sum(weight)


def test_ordinal_fit_against_a_plain_search():
    """Coordinate search on the likelihood itself finds nothing better."""
    rng = np.random.default_rng(3)
    x = rng.poisson(0.7, size=(250, 2)).astype(float)
    latent = x @ np.array([1.2, 0.6]) + rng.logistic(size=250)
    grade, weight = np.searchsorted([0.5, 1.8, 3.0], latent), rng.uniform(0.5, 2, size=250)
    w, theta = toxicity.fit_ordinal(x, grade, weight, 4)
    best, at, step = _likelihood(x, grade, weight, np.zeros(2), [0.0, 1.0, 2.0]), [0.0, 0.0, 0.0, 1.0, 2.0], 0.5
    while step > 1e-3:
        moved = False
        for k in range(5):
            for d in (step, -step):
                new = list(at)
                new[k] += d
                if new[0] < 0 or new[1] < 0 or not new[2] < new[3] < new[4]:
                    continue
                if (value := _likelihood(x, grade, weight, np.array(new[:2]), new[2:])) > best:
                    best, at, moved = value, new, True
        step = step if moved else step / 2
    assert _likelihood(x, grade, weight, w, theta) >= best - 1e-4
    assert np.abs(np.array(at) - np.concatenate([w, theta])).max() < 0.1


def _direct_severity(model, text):
    """Grading of one text in plain Python, word by word."""
    known = dict(zip(model.vocabulary.tolist(), model.weights.tolist(), strict=True))
    count = {}
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))):
        for n in (0, *toxicity.LENGTHS):
            if n and len(word) <= n:
                continue
            piece = word[:n] if n else word
            h = sum((b + 1) * pow(wordhash._BASE, k, 2**64) for k, b in enumerate(piece)) + n * wordhash._STEP
            h = int(wordhash.mix(np.array([h % 2**64], dtype=np.uint64))[0])
            if h in known:
                count[h] = count.get(h, 0) + 1
    s = sum(known[h] * math.log1p(n) for h, n in count.items())
    above = [1 / (1 + math.exp(t - s)) for t in model.theta]
    edges = [1.0, *above, 0.0]
    return sum(above), max(range(len(edges) - 1), key=lambda k: edges[k] - edges[k + 1]), above[0]


def test_severity_matches_direct_grading(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in op10_toxicity(spark, sf_dir).collect():
        want, grade, p = _direct_severity(model, text[r["doc_id"]])
        assert abs(r["expected_severity"] - want) < 1e-9 and r["grade"] == grade and abs(r["p_toxic"] - p) < 1e-9


def test_severity_orders_held_out_texts(spark):
    """Texts that were not labelled rank by how many marks were put into them."""
    docs, labels = _labelled(spark, 600)
    rng = np.random.default_rng(8)
    fresh = []
    for k in range(200):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)]
        for _ in range(k % 8):
            words[rng.integers(40)] = rng.choice(["vilest", "zorgling", "zorgments", "zorged"])
        fresh.append((10_000 + k, " ".join(words), sum(w.startswith(("vilest", "zorg")) for w in words)))
    frame = spark.createDataFrame(docs, DOCS)
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    got = toxicity.severity(model, pa.array([t for _, t, _ in fresh]))[0]
    marks = np.array([n for *_, n in fresh])
    pairs = [(got[a] > got[b]) for a in range(200) for b in range(200) if marks[a] > marks[b]]
    assert np.mean(pairs) >= 0.9


# --- toxicity ----------------------------------------------------------------------
def test_ordinal_fit_recovers_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 2))
    cuts, w = np.array([-0.5, 1.0, 2.5]), np.array([1.5, 0.7])
    latent = x @ w + rng.logistic(size=6000)
    got, theta = toxicity.fit_ordinal(x, np.searchsorted(cuts, latent), np.ones(6000), 4)
    assert np.abs(got - w).max() < 0.15 and np.abs(theta - cuts).max() < 0.2


def test_labelled_documents(spark, sf_dir):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in op10_toxicity(spark, sf_dir).collect()]
    clean = [r["toxic"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and np.mean(clean) <= 0.05


def _labelled(spark, n=400):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    docs, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        text = [word() for _ in range(30)]
        if toxic:
            for _ in range(1 + k % 5):
                text[rng.integers(30)] = rng.choice(["vilest", "zorgling", "zorgments", "zorged"])
        docs.append((k, " ".join(text), "en", "s", "c"))
        labels.append((k, 1 if toxic else 0, 1))
    return docs, labels


def test_marked_words_and_stems(spark):
    docs, labels = _labelled(spark)
    extra = [(1000, "a clean text", "en", "s", "c"), (1001, "You VILEST one", "en", "s", "c"), (1002, "abc zorgish " + "word " * 5000, "en", "s", "c"), (1003, None, "en", "s", "c"), (1004, "", "en", "s", "c"), (None, "vilest", "en", "s", "c"), (1001, "You VILEST one", "en", "s", "c")]
    frame = spark.createDataFrame(docs + extra, DOCS)
    model = toxicity.train(frame, spark.createDataFrame(labels + [(None, 1, 1), (9999, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int"))
    assert (np.diff(model.theta) > 0).all() and (model.weights >= 0).all()
    rows = toxicity.grade(frame, model).select("row.doc_id", toxicity.toxic().alias("t"), "expected_severity", "grade").collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) + 7
    assert np.mean([by[k]["t"] == bool(toxic) for k, toxic, _ in labels]) >= 0.99
    assert [by[k]["t"] for k in (1000, 1001, 1002, 1003, 1004, None)] == [False, True, True, False, False, True]
    assert all(0 <= r["expected_severity"] <= 3 and 0 <= r["grade"] <= 3 for r in rows)
    many = toxicity.severity(model, pa.array(["vilest", "vilest " * 9]))[0]
    assert many[1] > many[0]


def test_no_labels(spark):
    docs, labels = _labelled(spark, 8)
    frame, schema = spark.createDataFrame(docs, DOCS), "doc_id long, toxic int, quality int"
    assert toxicity.train(frame, spark.createDataFrame([], schema)) is None
    assert toxicity.train(frame, spark.createDataFrame([(1, 0, 1)], schema)) is None
    assert {r["p_toxic"] for r in toxicity.grade(frame, None).collect()} == {0.0}
    assert toxicity.train(frame.limit(0), spark.createDataFrame(labels, schema)) is None
