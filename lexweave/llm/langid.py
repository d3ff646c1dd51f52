"""Language identification with error-correcting output codes (operator 9).

Each language has a codeword of +1/-1 bits.  One binary logistic classifier per
bit, over hashed byte 1- to 3-grams of the folded text, predicts that bit; a
text's bit value is linear in its n-gram frequencies.  Decoding is
loss-weighted: a language's distance is the mean logistic loss of the bits
against its codeword, weighted by how well each classifier reproduces that bit
for that language in rows kept out of the fit.  The nearest codeword wins;
``ambiguous`` marks texts whose second codeword is almost as near.

``known`` is the decision of a filter: a text is of a known language if it is
not ambiguous and its distance is at most ``limit``, which lies half-way between
the farthest row kept out of the fit and log 2, the loss of bits that are tossed
coins.  Text in no learned language (random letters, say) is about that far from
every codeword.

The classifiers are fitted on at most about ``per_language`` labelled rows of a
language (a hash threshold chosen from exact counts); everything else, and
every prediction, covers all rows and whole texts.

Up to seven languages take the exhaustive code; more take distinct rows of
pseudo-random bits.

Defined cases: a null text or one without a letter is ``und`` with score 0;
rows with null text, language or id are not learned from; without labelled rows
everything is ``und``, and texts with letters count as known, as nothing speaks
against them; repeated rows are judged each; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import judged
from .wordhash import release, slices, utf8

#: ``distance`` is null for texts without a letter.
PREDICTION = "lang_pred string, score double, ambiguous boolean, distance double, known boolean"

#: Letters are a-z (folded) and bytes of non-ASCII characters; all else is 0.
_SYMBOL = np.zeros(256, dtype=np.uint32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, 155)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (features, bits)
    bias: np.ndarray
    trust: np.ndarray  # (languages, bits), rows sum to 1
    limit: float  # distance beyond which a text is of no known language
    margin: float = 0.1


def codewords(n: int) -> np.ndarray:
    """Distinct rows of +1/-1 for n languages."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = np.arange(1, 2 ** (n - 1))
        rest = (columns[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.concatenate([np.ones((1, len(columns))), 1.0 - 2 * rest])
    bits, rng = 10 * int(np.ceil(np.log2(n))), np.random.default_rng(0)
    while True:
        codes = rng.choice([-1.0, 1.0], size=(n, bits))
        if len(np.unique(codes, axis=0)) == n and (np.abs(codes.sum(axis=0)) < n).all():
            return codes


def gram_codes(data: np.ndarray, features: int) -> Iterator[tuple[int, np.ndarray]]:
    """(order, hashed n-gram starting at each byte) for orders 1, 2, 3."""
    s = _SYMBOL[data]
    code = s.copy()
    shift = np.uint32(32 - int(features).bit_length() + 1)
    for order in (1, 2, 3):
        if order > 1:
            code = code[:-1] * np.uint32(157) + s[order - 1 :] if len(code) else code
        if len(code):
            yield order, (((code + np.uint32(order)) * np.uint32(0x9E3779B1)) >> shift).astype(np.int64)


def frequencies(data: np.ndarray, features: int) -> np.ndarray:
    """N-gram frequencies of one text, for fitting."""
    out = np.zeros(features, dtype=np.float32)
    for _, code in gram_codes(data, features):
        out += np.bincount(code, minlength=features).astype(np.float32) / np.float32(len(data))
    return out


def _features(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch["text"])
        for lo in range(0, batch.num_rows, 64):
            hi = min(lo + 64, batch.num_rows)
            rows = [frequencies(data[off[k] : off[k + 1]], features).tobytes() for k in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([batch["lang"].slice(lo, hi - lo), pa.array(rows, pa.binary())], names=["lang", "x"])
        del batch
        release()


def fit(langs: list[str], x: np.ndarray, steps: int = 150, decay: float = 1e-3) -> Model:
    """One logistic classifier per code bit, by accelerated gradient descent.
    ``x`` is scaled in place."""
    names = sorted(set(langs))
    codes = codewords(len(names))
    y = codes[np.searchsorted(names, langs)].astype(np.float32)
    # each language weighs the same, whatever its share of the sample
    share = np.bincount(np.searchsorted(names, langs), minlength=len(names))
    row = (1.0 / (len(names) * share[np.searchsorted(names, langs)])).astype(np.float32)[:, None]
    # every fifth row of a language with ten or more only tells how far bits can be trusted
    at = np.searchsorted(names, langs)
    place = np.array([(at[:k] == at[k]).sum() for k in range(len(at))])
    test = (place % 5 == 4) & (share[at] >= 10)
    row[test] = 0.0
    scale = 1.0 / np.sqrt(x.mean(axis=0) + 1e-5)
    z = x
    z *= scale  # in place: the sample is the largest thing here
    # largest curvature of the loss, by power iteration
    v = np.ones(z.shape[1], dtype=np.float32)
    for _ in range(12):
        v = z.T @ (row[:, 0] * (z @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    rate = 1.0 / (0.25 * (top + 1.0) + decay)
    w = np.zeros((z.shape[1], y.shape[1]), dtype=np.float32)
    b = np.zeros(y.shape[1], dtype=np.float32)
    pw, pb = w.copy(), b.copy()
    for t in range(1, steps + 1):
        m = np.float32((t - 1) / (t + 2))
        qw, qb = w + m * (w - pw), b + m * (b - pb)
        g = -y * row / (1.0 + np.exp(np.clip(y * (z @ qw + qb), -30, 30)))
        pw, pb = w, b
        w = qw - np.float32(rate) * (z.T @ g + np.float32(decay) * qw)
        b = qb - np.float32(rate) * g.sum(axis=0)
    value = z @ w + b
    right = (np.sign(value) == y).astype(np.float64)
    trust = np.stack([right[(at == k) & (test | (share[k] < 10))].mean(axis=0) for k in range(len(names))]) + 1e-6
    trust /= trust.sum(axis=1, keepdims=True)
    far = (np.logaddexp(0.0, -value * y) * trust[at]).sum(axis=1)
    reach = min(far[test].max() if test.any() else 0.0, np.log(2.0))
    return Model(names, codes, (w * scale[:, None]).astype(np.float32), b.astype(np.float64), trust, float(reach + np.log(2.0)) / 2)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    langs, rows = [], []
    for batch in batches:
        langs += batch["lang"].to_pylist()
        rows += [np.frombuffer(v.as_buffer(), dtype=np.float32) for v in batch["x"]]
    models = []
    if rows:
        order = sorted(range(len(rows)), key=lambda k: (langs[k], rows[k].tobytes()))
        models = [pickle.dumps(fit([langs[k] for k in order], np.stack([rows[k] for k in order])))]
        rows = []
    release()
    yield pa.RecordBatch.from_arrays([pa.array(models, pa.binary())], names=["model"])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = 400, features: int = 8192, most_rows: int = 3200) -> Model | None:
    """Fit on rows (text, lang) of ``docs`` whose key columns are not null: about
    ``per_language`` of each language, about ``most_rows`` in all."""
    import pickle

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    counts = known.groupBy("lang").count()
    key = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30))
    per_language = min(per_language, max(8, most_rows // max(1, counts.count())))
    cut = counts.select(F.col("lang").alias("__lang"), (F.lit(per_language << 30) / F.col("count")).alias("cut"))
    cuts = {r[0]: r[1] for r in cut.toLocalIterator()}  # one row per language
    if not cuts:
        return None
    table = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
    sample = known.where(key < F.element_at(table, F.col("lang"))).select("text", "lang")
    x = sample.mapInArrow(partial(_features, features=features), "lang string, x binary")
    got = x.repartition(1).mapInArrow(_fit, "model binary").collect()
    return pickle.loads(got[0][0]) if got else None


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, ambiguity and distance (NaN without a letter) of each text."""
    data, off = utf8(column)
    n, features, bits = len(column), len(model.weights), model.codes.shape[1]
    value = np.zeros((n, bits))
    letters = np.zeros(n, dtype=bool)
    for lo, hi in slices(off, 1 << 17):
        part, start = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        size = np.diff(start)
        full = np.flatnonzero(size)
        letters[lo + full] = np.add.reduceat(_ASCII_LETTER[part], start[:-1][full]) > 0 if len(full) else False
        if hi - lo == 1 and len(part) > 1 << 20:  # one very long text, piece by piece
            for a in range(0, len(part), 1 << 20):
                for order, code in gram_codes(part[a : a + (1 << 20) + 2], features):
                    count = np.bincount(code[: (1 << 20)], minlength=features)
                    value[lo] += count @ model.weights / len(part)
            continue
        # counts of 64 texts at a time, then one product with all bits' weights
        for top in range(0, hi - lo, 64):
            some = min(top + 64, hi - lo)
            own = part[start[top] : start[some]]
            text = np.repeat(np.arange(some - top), size[top:some])
            count = np.zeros((some - top) * features)
            for order, code in gram_codes(own, features):
                inside = text[: len(code)] == text[order - 1 :]  # an n-gram lies in one text
                count += np.bincount(text[: len(code)][inside] * features + code[inside], minlength=len(count))
            value[lo + top : lo + some] = (count.reshape(-1, features).astype(np.float32) @ model.weights) / np.maximum(size[top:some, None], 1)
    value += model.bias
    loss = np.logaddexp(0.0, -value[:, None, :] * model.codes[None, :, :])
    distance = (loss * model.trust[None, :, :]).sum(axis=2)
    p = np.exp(bits * (distance.min(axis=1, keepdims=True) - distance))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    score = p[np.arange(n), best] if n else np.zeros(0)
    second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(n)
    names = [model.languages[k] for k in best]
    ambiguous = (score - second) < model.margin
    least = distance[np.arange(n), best] if n else np.zeros(0)
    for k in np.flatnonzero(~letters).tolist():
        if not has_letter(column[k].as_py()):
            names[k], score[k], ambiguous[k], least[k] = "und", 0.0, False, np.nan
    return names, score, ambiguous, least


def _judge(texts: pa.Array, shared) -> list[pa.Array]:
    model = shared.value
    if model is None:
        n = len(texts)
        some = [has_letter(t) for t in texts.to_pylist()]
        far = pa.array([0.0 if x else None for x in some], pa.float64())
        return [pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, dtype=bool)), far, pa.array(some, pa.bool_())]
    names, score, ambiguous, distance = predict(model, texts)
    known = (distance <= model.limit) & ~ambiguous  # NaN is not
    return [pa.array(names, pa.string()), pa.array(score), pa.array(ambiguous), pa.array(distance, pa.float64(), from_pandas=True), pa.array(known)]


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the document, or its columns ``keep``) and those of ``PREDICTION``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return judged(docs, "text", lambda: partial(_judge, shared=shared), PREDICTION, keep)


def accepted() -> Column:
    """Near enough to one codeword, and clearly nearer than to the others."""
    return F.col("known")
