"""Graph search against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from lexweave.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, queries):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v):
            good[(i, tuple(np.float32(v).tolist()))] = np.array(np.float32(v), dtype=float)
    out = {}
    for (q, key), a in good.items():
        if not queries(q):
            continue
        scored = [(-float(a @ b / np.sqrt((a @ a) * (b @ b))), j) for (j, _), b in good.items() if j != q and len(b) == len(a)]
        out[q] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def run(spark, rows, k=5, **settings):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = ann.search(frame, frame.where("vec_id % 50 = 0"), k, ann.Settings(**settings)).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({j for j, _ in got.get(q, [])} & {j for j, _ in w}) / max(len(w), 1) for q, w in want.items()])


def test_random_vectors_over_shards(spark):
    rng = np.random.default_rng(0)
    rows = [(k, v, 0) for k, v in enumerate(rng.normal(size=(3000, 32)).astype(np.float32).tolist())]
    want = brute(rows, 5, lambda q: q % 50 == 0)
    got = run(spark, rows, shard_size=700)
    assert recall(got, want) >= 0.97
    for q, near in got.items():
        assert all(abs(s - dict(want[q]).get(j, s)) < 1e-12 for j, s in near)


def test_copies_ties_and_unusable_vectors(spark):
    base = [1.0, 2.0, 3.0]
    rows = [(k, base, 0) for k in range(60)] + [(100, [3.0, 2.0, 1.0], 0), (101, [2.0, 4.0, 6.0], 0), (0, base, 0)]
    rows += [(200, None, 0), (250, [0.0, 0.0, 0.0], 0), (300, [1.0, None, 2.0], 0), (350, [float("nan"), 1.0, 1.0], 0), (400, [float("inf"), 1.0, 1.0], 0), (None, base, 0), (450, [], 0)]
    rows += [(500, [1.0, 1.0], 0), (501, [1.0, 0.5], 0), (550, [1.0], 0)]
    got, want = run(spark, rows), brute(rows, 5, lambda q: q % 50 == 0)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items() if v}
    assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5]


def test_fewer_candidates_than_k_and_empty(spark):
    assert run(spark, []) == {}
    got = run(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)])
    assert [j for j, _ in got[0]] == [2, 1]
    assert run(spark, [(0, [1.0], 0)]) == {}


@pytest.mark.parametrize("shard_size", [8192, 700])
def test_tight_clusters_and_parallel_vectors(spark, shard_size):
    """A third practically equal, a third multiples of one vector, a third random:
    the found ones score as well as those of brute force."""
    rng = np.random.default_rng(4)
    n, d = 1500, 64
    center, line = rng.normal(size=d), rng.normal(size=d)
    x = np.concatenate([rng.normal(size=(n // 3, d)), center + 1e-7 * rng.normal(size=(n // 3, d)), line * rng.uniform(0.1, 9, size=(n // 3, 1))])
    x = x[rng.permutation(n)].astype(np.float32)
    rows = [(k, v, 0) for k, v in enumerate(x.tolist())]
    got, want = run(spark, rows, shard_size=shard_size), brute(rows, 5, lambda q: q % 50 == 0)
    assert got.keys() == want.keys()
    good = [[s >= w[-1][1] - 1e-14 for _, s in got[q]] for q, w in want.items()]
    # scores of multiples differ in their last bits only, as does brute force from itself
    assert all(len(g) == 5 for g in good) and np.mean(good) >= 0.99


def test_near_ties_extra_columns_and_many_entries(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    rows = [(k, (base * (1 + k % 3)).astype(np.float32).tolist(), 7) for k in range(40)] + [(100 + k, rng.normal(size=8).astype(np.float32).tolist(), 7) for k in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "embedding", "label as rank", "label as shard", "'x' as score", "'y' as kind")
    got = ann.search(frame, frame.where("vec_id % 50 = 0"), 5, ann.Settings(shard_size=64)).collect()
    want = brute(rows, 5, lambda q: q % 50 == 0)
    assert len(got) == sum(map(len, want.values()))
    assert all(r["score"] >= want[r["query_id"]][-1][1] - 1e-14 for r in got)
    cluster = np.concatenate([rng.normal(size=(400, 16)), base.repeat(2) + 1e-7 * rng.normal(size=(2000, 16))])
    g = ann.build(ann._unit(cluster))
    assert len(g.entry) == 1 and (g.edges[:, -1] >= 0).sum() <= 24  # hardly a bridge is needed


def test_tables_recall(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], 0) for r in frame.collect()]
    assert recall(run(spark, rows), brute(rows, 5, lambda q: q % 50 == 0)) >= 0.95


@pytest.mark.parametrize("n", [1, 2, 33, 500])
def test_every_node_can_be_reached(n):
    x = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2 :] = x[: n - n // 2] * 0.5 + x[n // 2 :] * 0.5 if n > 3 else x[n // 2 :]
    g = ann.build(ann._unit(x.astype(float)))
    ids, _ = ann.beam_search(g, g.x[:1], n)
    assert sorted(ids[0].tolist()) == list(range(n))
