"""Toxicity severity by cumulative-link ordinal regression (operator 10).

The model is the proportional-odds model: P(grade <= k) = s(theta_k - w.x),
with one weight vector shared by all ordered thresholds.  ``x`` is sparse: the
logarithm of one plus the number of occurrences of each selected feature, a
feature being a word or the beginning of a word (so that inflected and
compounded forms of a marked stem count).  Expected severity is the sum over k
of P(grade > k).

Labels only say toxic or not, so training grades are derived: 0 is not toxic; a
toxic text is 1, 2 or 3 by how many of its words have features that the labels
mark as toxic (see ``GRADE_CUTS``).  Feature selection and fitting use at most about
``per_class`` labelled rows of each class (a hash threshold chosen from exact
counts), weighted back to the classes' true shares; of rows that look like
copies of each other only one is used, so that copies are not taken for
evidence.  Every prediction covers all rows and whole texts.

Words are runs of letters, digits and non-ASCII characters, A-Z folded, known
by 64-bit hashes.

Defined cases: a null or empty text has severity by the thresholds alone (no
word); labels that are null or name no document are not used; without toxic or
without other labelled rows nothing is toxic and severity is 0; repeated rows
are judged each; extra columns are kept.
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
from .wordhash import ALNUM_SEP, grams, mix, release, slices, subwords, utf8

SEVERITY = "expected_severity double, grade int, p_toxic double"

#: A toxic text with fewer than 2 marked words has grade 1, fewer than 6 grade 2.
GRADE_CUTS = (2, 6)

#: Byte lengths of word beginnings, besides whole words.
LENGTHS = (3, 4, 5, 6, 7, 8)


_SAMPLE = ["doc_id", "toxic", "chain", "count", "key"]


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    theta: np.ndarray  # ordered thresholds

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ids, vocabulary index) of ids that are features."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        table = np.zeros(1 << 16, dtype=bool)
        table[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(table[(ids & np.uint64(0xFFFF)).astype(np.int64)])
        slot = np.searchsorted(self.vocabulary, ids[at])
        slot[slot == len(self.vocabulary)] = 0
        same = self.vocabulary[slot] == ids[at]
        return at[same], slot[same]


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct words, as chains of features (the word, then its
    beginnings; 0 where it is too short) with counts, and three MinHashes of
    word triples."""
    for batch in batches:
        data, off = utf8(batch["text"])
        chain, count, key = [], [], []
        for k in range(batch.num_rows):
            part, edges = data[off[k] : off[k + 1]], np.array([0, off[k + 1] - off[k]])
            _, columns = subwords(part, edges, ALNUM_SEP, LENGTHS)
            own = columns[0][0]
            _, first, n = np.unique(own, return_index=True, return_counts=True)
            table = np.zeros((len(own), len(columns)), dtype=np.uint64)
            for j, (ids, at) in enumerate(columns):
                table[at, j] = ids
            chain.append(table[first].tobytes())
            count.append(n.astype(np.int32).tobytes())
            g = grams(own, min(3, max(len(own), 1)))
            key.append([int(mix(g ^ np.uint64(s)).min().view(np.int64)) for s in (1, 2, 3)] if len(g) else [0, 0, 0])
        columns = [pa.array(x, pa.binary()) for x in (chain, count)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], *columns, pa.array(key, pa.list_(pa.int64()))], names=_SAMPLE)
        del batch, chain, count, columns
        release()


def select(chain: np.ndarray, text: np.ndarray, toxic: np.ndarray, least_share: float, z: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(stems, others), at most ``most`` each: features that are significant, have
    class-balanced odds of 25 to 1 and are in enough toxic texts.  The stems are
    the most significant one of each word's chain, the longest of equals; a stem
    stands for all of its forms, seen or not.

    Lengths are worked through one by one, as their features have nothing in
    common."""
    value = np.full(chain.shape, -1.0, dtype=np.float32)
    ids, score = [], []
    na, nb = toxic.sum(), (~toxic).sum()
    for j in range(chain.shape[1]):
        have = np.flatnonzero(chain[:, j])
        own, slot = np.unique(chain[have, j], return_inverse=True)
        pair = np.unique(text[have] * len(own) + slot)
        label, term = toxic[pair // max(len(own), 1)], pair % max(len(own), 1)
        a = np.bincount(term[label], minlength=len(own)).astype(float)
        b = np.bincount(term[~label], minlength=len(own)).astype(float)
        pooled = (a + b) / (na + nb)
        above = (a / na - b / nb) / (np.sqrt(pooled * (1 - pooled) * (1 / na + 1 / nb)) + 1e-12)
        odds = ((a + 0.5) / (na + 1)) / ((b + 0.5) / (nb + 1))
        ok = (a >= max(5, least_share * na)) & (above >= z) & (odds >= 25)
        value[have, j] = np.where(ok, above, -1.0)[slot]
        ids.append(own[ok])
        score.append(above[ok])
    every, above = np.concatenate(ids), np.concatenate(score)
    # the word itself comes first, then ever longer beginnings: turn to long ones first
    order = [0, *range(chain.shape[1] - 1, 0, -1)]
    best = np.array(order)[value[:, order].argmax(axis=1)]
    rows = np.flatnonzero(value.max(axis=1) >= 0)
    stem = np.isin(every, np.unique(chain[rows, best[rows]]))
    first = lambda some: every[some][np.argsort(-above[some], kind="stable")[:most]]
    return first(stem), first(~stem)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -35, 35)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, levels: int, base: np.ndarray | float = 0.0, decay: float = 1e-5, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds of the proportional-odds model.

    ``base`` is added to every row's linear predictor.  Thresholds are kept in order by theta_0 and the logarithms of the gaps;
    Adam steps on the weighted mean negative log-likelihood.
    """
    n, d = x.shape
    weight = weight / weight.sum()
    p = np.concatenate([np.zeros(d), [2.0], np.zeros(levels - 2)])
    first, second = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, gaps = p[:d], np.exp(p[d + 1 :])
        theta = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        up = np.concatenate([theta, [np.inf]])[grade] - x @ w - base
        down = np.concatenate([[-np.inf], theta])[grade] - x @ w - base
        su, sd = np.where(np.isinf(up), 1.0, _sigmoid(up)), np.where(np.isinf(down), 0.0, _sigmoid(down))
        like = np.maximum(su - sd, 1e-12)
        gu, gd = weight * su * (1 - su) / like, weight * sd * (1 - sd) / like
        g_theta = np.array([gd[grade == k + 1].sum() - gu[grade == k].sum() for k in range(levels - 1)])
        g = np.concatenate([x.T @ (gu - gd) + decay * w, [g_theta.sum()], [g_theta[k:].sum() * gaps[k - 1] for k in range(1, levels - 1)]])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        p = p - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        p[:d] = np.maximum(p[:d], 0.0)  # a selected feature never speaks against severity
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])


def fit(
    toxic: np.ndarray,
    chain: list[np.ndarray],
    count: list[np.ndarray],
    share: float,
    least_share: float = 0.025,
    z: float = 6.0,
    most: int = 400,
) -> Model:
    """``share`` is the true share of toxic rows among the labelled ones."""
    text = np.repeat(np.arange(len(chain)), [len(c) for c in chain])
    every, n = np.concatenate(chain), np.concatenate(count)
    stems, others = select(every, text, toxic, least_share, z, most)
    order = np.argsort(both := np.concatenate([stems, others]))
    stem = (np.arange(len(both)) < len(stems))[order]
    model = Model(both[order], np.zeros(len(both)), np.zeros(0))
    x = np.zeros((len(chain), len(model.vocabulary)))
    seen = np.zeros(len(text), dtype=bool)
    for j in range(every.shape[1]):
        at, slot = model.found(every[:, j])
        np.add.at(x, (text[at], slot), n[at])
        seen[at] = True
    marked = np.bincount(text[seen], weights=n[seen], minlength=len(chain))
    grade = np.where(toxic, 1 + np.searchsorted(GRADE_CUTS, marked, side="right"), 0)
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (~toxic).mean())
    # stems take what they can explain; single words and longer beginnings then add to it
    x, levels = np.log1p(x), 2 + len(GRADE_CUTS)
    w = model.weights
    w[stem], model.theta = fit_ordinal(x[:, stem], grade, weight, levels)
    if (~stem).any():
        w[~stem], model.theta = fit_ordinal(x[:, ~stem], grade, weight, levels, base=x[:, stem] @ w[stem])
    return model


def _fit(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    import pickle

    rows = []
    for b in batches:  # chains and counts stay in Arrow's buffers
        rows += zip(b["doc_id"].to_pylist(), b["toxic"].to_pylist(), map(tuple, b["key"].to_pylist()), b["chain"], b["count"], strict=True)
    rows.sort(key=lambda r: r[:3])
    seen: set[tuple[int, int]] = set()
    used = []
    for r in rows:
        own = set(enumerate(r[2]))
        if not own & seen:
            used.append(r)
        seen |= own
    toxic = np.array([r[1] == 1 for r in used], dtype=bool)
    models = []
    if 0 < toxic.sum() < len(toxic):
        chain = [np.frombuffer(r[3].as_buffer(), dtype=np.uint64).reshape(-1, 1 + len(LENGTHS)) for r in used]
        count = [np.frombuffer(r[4].as_buffer(), dtype=np.int32) for r in used]
        models = [pickle.dumps(fit(toxic, chain, count, share))]
        del chain, count
    rows, used = [], []
    release()
    yield pa.RecordBatch.from_arrays([pa.array(models, pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, sample_bytes: int = 24 << 20) -> Model | None:
    """Fit on labelled documents (doc_id, toxic): about ``per_class`` of each
    class, fewer where texts are so long that they would pass ``sample_bytes``."""
    import pickle

    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    total = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}  # two rows
    if len(total) < 2:
        return None
    mean = docs.agg(F.avg(F.octet_length("text"))).first()[0] or 1
    per_class = min(per_class, max(50, int(sample_bytes / 2 / mean)))
    key = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 30))
    cut = F.when(F.col("toxic") == 1, F.lit((per_class << 30) / total[1])).otherwise(F.lit((per_class << 30) / total[0]))
    # about 2 * per_class rows
    chosen = F.broadcast(known.where(key < cut).groupBy("id").agg(F.max("toxic").alias("toxic")))
    sample = docs.select("doc_id", "text").where("text is not null").join(chosen, F.col("doc_id") == F.col("id")).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text")
    x = sample.mapInArrow(_samples, "doc_id long, toxic int, chain binary, count binary, key array<long>")
    got = x.repartition(1).mapInArrow(partial(_fit, share=total[1] / (total[0] + total[1])), "model binary").collect()
    return pickle.loads(got[0][0]) if got else None


def severity(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(expected severity, likeliest grade, P(grade > 0)) of each text."""
    data, off = utf8(column)
    score = np.zeros(len(column))
    size = len(model.vocabulary)
    if size:
        for lo, hi in slices(off):
            a = off[lo]
            pairs = [np.zeros(0, np.int64)]
            text, columns = subwords(data[a : off[hi]], off[lo : hi + 1] - a, ALNUM_SEP, LENGTHS)
            for ids, word in columns:
                at, slot = model.found(ids)
                pairs.append(text[word[at]] * size + slot)
            pair, n = np.unique(np.concatenate(pairs), return_counts=True)
            np.add.at(score, lo + pair // size, np.log1p(n) * model.weights[pair % size])
    above = _sigmoid(score[:, None] - model.theta[None, :])
    edges = np.concatenate([np.ones((len(column), 1)), above, np.zeros((len(column), 1))], axis=1)
    return above.sum(axis=1), (edges[:, :-1] - edges[:, 1:]).argmax(axis=1), above[:, 0]


def _judge(texts: pa.Array, shared) -> list[pa.Array]:
    if shared.value is None:
        n = len(texts)
        return [pa.array(np.zeros(n)), pa.array(np.zeros(n, dtype=np.int32)), pa.array(np.zeros(n))]
    expected, grade, p = severity(shared.value, texts)
    return [pa.array(expected), pa.array(grade.astype(np.int32)), pa.array(p)]


def grade(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the document, or its columns ``keep``) and those of ``SEVERITY``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return judged(docs, "text", lambda: partial(_judge, shared=shared), SEVERITY, keep)


def toxic(least: float = 0.4) -> Column:
    """Likely of grade 1 or more.  The threshold is under one half because grades
    share their weights: a single weak mark explains grade 1 only in part."""
    return F.col("p_toxic") >= least
