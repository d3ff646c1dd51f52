"""Nearest neighbours in sharded robust-pruned graphs (operator 6).

Vectors are dealt over shards of about ``shard_size`` by hash.  Each shard is a
directed graph: greedy searches from the entry point propose neighbours of
every vector, relaxed distance pruning (a candidate goes when a chosen
neighbour is ``alpha`` times nearer to it than the vector is) keeps diverse
edges, and reverse edges are added and pruned alike.  Nodes that the entry does
not reach are chained to the nearest reached one by a bridge edge each.

Queries are beam-searched in every shard.  The whole beam is rescored in double
precision on the original vectors.  If even its last members score like the
``k``-th, the beam ends inside a cluster of practically equal directions; such a
query is then scored against every vector of the shard.

Distances are of unit vectors in double precision, from differences, so that
clusters much narrower than single precision are still graphs with edges.

Equal vectors share one graph node: at most ``k + 1`` of their ids, the
smallest, can be among anyone's ``k`` nearest (ties go to smaller ids, a query
skips only its own), so no more are kept; the limit is applied before the
shuffle, so a vector that a third of all rows repeat is no hot key.

All vectors are indexed; the index is a table with one row a node.  A search
task holds one shard at a time, read once, while queries stream past it.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without id, take no part; a row repeated in full counts
once; vectors are only compared with vectors of their own length; queries with
fewer candidates than ``k`` get all; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import forget, stage


@dataclass(frozen=True)
class Settings:
    shard_size: int = 8192
    degree: int = 32
    build_beam: int = 64
    alpha: float = 1.2
    beam: int = 256
    batch: int = 256
    tie: float = 1e-12  # scores that are no further apart may be in any order


@dataclass
class Graph:
    x: np.ndarray  # unit vectors, double precision
    edges: np.ndarray  # (n, degree + 1), -1 where there is none; the last is the bridge
    entry: np.ndarray  # the entry point


def beam_search(g: Graph, queries: np.ndarray, beam: int, expand: int = 4, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of each query's beam, nearest first; -1 pads.

    Every round expands the ``expand`` nearest unexpanded members of the beam.
    """
    q, n = len(queries), len(g.x)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True  # where a missing edge points
    ids = np.full((q, beam), n)
    dist = np.full((q, beam), np.inf)
    done = np.ones((q, beam), dtype=bool)
    fresh = np.broadcast_to(g.entry, (q, len(g.entry)))
    while True:
        fresh = np.where(fresh < 0, n, fresh)
        fresh = np.sort(fresh, axis=1)
        new = ~seen[rows, fresh]
        new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        seen[rows, fresh] = True
        r, c = np.nonzero(new)
        v = fresh[r, c]
        d = np.full(fresh.shape, np.inf)
        away = g.x[v]
        away -= queries[r]
        d[r, c] = np.einsum("ij,ij->i", away, away)
        ids = np.concatenate([ids, np.where(new, fresh, n)], axis=1)
        dist = np.concatenate([dist, d], axis=1)
        done = np.concatenate([done, ~new], axis=1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]
        rank = np.cumsum(~done, axis=1)
        pick = ~done & (rank <= expand)
        if not pick.any():
            return np.where(ids == n, -1, ids), dist
        done |= pick
        chosen = np.full((q, expand), -1)
        r, c = np.nonzero(pick)
        chosen[r, rank[r, c] - 1] = ids[r, c]
        fresh = np.where(chosen[:, :, None] >= 0, g.edges[np.maximum(chosen, 0)], -1).reshape(q, -1)


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse out-edges of each point from its candidates (-1 pads)."""
    b, c = cand.shape
    ok = (cand >= 0) & (cand != points[:, None])
    rows = np.arange(b)[:, None]
    cand = np.sort(np.where(ok, cand, len(x)), axis=1)
    ok = cand < len(x)
    ok[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    # seen from the point, so that nothing is lost when all are near
    v = x[np.minimum(cand, len(x) - 1)] - x[points][:, None, :]
    d = np.where(ok, np.einsum("bcd,bcd->bc", v, v), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d, v = cand[rows, order], d[rows, order], v[rows, order]
    ok = np.isfinite(d)
    own = np.einsum("bcd,bcd->bc", v, v)
    between = np.maximum(own[:, :, None] + own[:, None, :] - 2.0 * (v @ v.transpose(0, 2, 1)), 0.0)
    out = np.full((b, degree), -1)
    flat = np.arange(b)
    for k in range(degree):
        first = ok.argmax(axis=1)
        some = ok[flat, first]
        if not some.any():
            break
        out[some, k] = cand[some, first[some]]
        gone = alpha * between[flat, first] <= d
        ok &= ~(gone & some[:, None])
        ok[flat[some], first[some]] = False
    return out


def build(x: np.ndarray, s: Settings = Settings()) -> Graph:
    """The graph over unit vectors, built by batch insertion in two passes."""
    n = len(x)
    start = np.array([int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())])
    g = Graph(x, np.full((n, s.degree), -1), start)
    rng = np.random.default_rng(0)
    order = np.concatenate([start, rng.permutation(np.setdiff1d(np.arange(n), start))])
    at, size = 0, 1
    while at < n:
        points = order[at : at + size]
        found, _ = beam_search(g, x[points], s.build_beam)
        cand = np.concatenate([found, g.edges[points]], axis=1)
        if at < 4 * s.degree:  # the first ones see each other directly
            cand = np.concatenate([cand, np.broadcast_to(order[: at + len(points)], (len(points), at + len(points)))], axis=1)
        g.edges[points] = robust_prune(x, points, cand, s.degree, s.alpha)
        _reverse(g, points, s)
        at += len(points)
        size = min(s.batch, max(1, at))
    g.edges = np.concatenate([g.edges, np.full((n, 1), -1)], axis=1)
    _bridge(g, s)
    return g


def _reverse(g: Graph, points: np.ndarray, s: Settings) -> None:
    src = np.repeat(points, s.degree)
    dst = g.edges[points].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    if not len(dst):
        return
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    target, first, count = np.unique(dst, return_index=True, return_counts=True)
    extra = np.full((len(target), count.max()), -1)
    extra[np.repeat(np.arange(len(target)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
    have = (g.edges[target] >= 0).sum(axis=1)
    room = have + count <= s.degree
    for lo in range(0, len(target), s.batch):
        t, e, r = target[lo : lo + s.batch], extra[lo : lo + s.batch], room[lo : lo + s.batch]
        both = np.concatenate([g.edges[t], e], axis=1)
        if r.any():  # edges with room are packed to the left, without duplicates
            b = np.sort(np.where(both[r] < 0, len(g.x), both[r]), axis=1)
            b[:, 1:][b[:, 1:] == b[:, :-1]] = len(g.x)
            b = np.sort(b, axis=1)[:, : s.degree]
            g.edges[t[r]] = np.where(b == len(g.x), -1, b)
        if (~r).any():
            g.edges[t[~r]] = robust_prune(g.x, t[~r], both[~r], s.degree, s.alpha)


def _bridge(g: Graph, s: Settings) -> None:
    """Chain what the entry does not reach to the nearest reached node: each
    node has at most one bridge edge, so one round is enough."""
    reached = np.zeros(len(g.x) + 1, dtype=bool)
    reached[-1] = True
    todo = g.entry
    reached[todo] = True
    while len(todo):
        todo = np.unique(g.edges[todo])
        todo = todo[~reached[todo]]
        reached[todo] = True
    lost = np.flatnonzero(~reached[:-1])
    if not len(lost):
        return
    near, far = np.empty(len(lost), dtype=np.int64), np.empty(len(lost))
    for lo in range(0, len(lost), s.batch):
        ids, dist = beam_search(g, g.x[lost[lo : lo + s.batch]], s.build_beam)
        near[lo : lo + s.batch], far[lo : lo + s.batch] = ids[:, 0], dist[:, 0]
    order = np.lexsort((lost, far, near))
    node, near = lost[order], near[order]
    first = np.concatenate([[True], near[1:] != near[:-1]])
    g.edges[np.where(first, near, np.concatenate([[0], node[:-1]])), -1] = node


def _index(part: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """One shard's rows (ids, embedding) with their edges, numbered."""
    part = part.sort_values("least").reset_index(drop=True)
    v = np.stack(part["embedding"].to_numpy()).astype(np.float64)
    g = build(_unit(v), s)
    entry = np.arange(len(v)) == g.entry[0]
    return pd.DataFrame(
        {
            "dim": v.shape[1], "shard": part["shard"], "node": np.arange(len(v)), "entry": entry, "ids": part["ids"],
            "embedding": list(v), "edges": [row[row >= 0] for row in g.edges.astype(np.int32)],
        }
    )


def _unit(v: np.ndarray) -> np.ndarray:
    # scaled first, so that no square overflows or vanishes
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return np.ascontiguousarray(v / np.sqrt((v * v).sum(axis=1, keepdims=True)))


_INDEX = "dim int, shard long, node int, entry boolean, ids array<long>, embedding array<double>, edges array<int>"
_FOUND = "query_id long, query_row long, vec_id long, score double"


def _lists(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), np.diff(column.offsets.to_numpy())


class _Shard:
    """One shard, put together from its rows, and the queries asked of it."""

    def __init__(self, k: int, s: Settings):
        self.k, self.s, self.parts, self.graph = k, s, [], None

    def add(self, rows: pa.RecordBatch) -> None:
        ids, n_ids = _lists(rows["ids"], np.int64)
        vectors, n = _lists(rows["embedding"], np.float64)
        edges, n_edges = _lists(rows["edges"], np.int32)
        self.parts.append((rows["entry"].to_numpy(zero_copy_only=False), ids, n_ids, vectors.reshape(len(n), -1), edges, n_edges))

    def ready(self) -> None:
        if self.graph is None and self.parts:
            entry, self.ids, self.counts, self.v, edges, n_edges = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            self.parts = []
            self.length = np.sqrt((self.v * self.v).sum(axis=1))
            self.first = np.cumsum(self.counts) - self.counts
            table = np.full((len(self.v), self.s.degree + 1), -1)
            row = np.repeat(np.arange(len(self.v)), n_edges)
            table[row, np.arange(len(edges)) - np.repeat(np.cumsum(n_edges) - n_edges, n_edges)] = edges
            self.graph = Graph(_unit(self.v), table, np.flatnonzero(entry))

    def best(self, q: np.ndarray, own_id: int, nodes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
        """The ``k`` nearest ids and scores among some nodes, or all, and the last node's score."""
        if nodes is None:
            nodes = np.arange(len(self.v))
        score = (self.v[nodes] * q).sum(axis=1) / (self.length[nodes] * np.sqrt((q * q).sum()))
        count = self.counts[nodes]
        at = np.repeat(self.first[nodes], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        near, value = self.ids[at], np.repeat(score, count)
        other = near != own_id
        near, value = near[other], value[other]
        order = np.lexsort((near, -value))[: self.k]
        return near[order], value[order], float(score.min()) if len(score) else -np.inf

    def search(self, q_ids: np.ndarray, q_rows: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        out = []
        width = min(max(self.s.beam, 4 * self.k), len(self.v))
        for lo in range(0, len(q), self.s.batch):
            mine = q[lo : lo + self.s.batch]
            beam, _ = beam_search(self.graph, _unit(mine), width)
            for j, row in enumerate(beam):
                row = row[row >= 0]
                ids, score, last = self.best(mine[j], q_ids[lo + j], row)
                if len(row) < len(self.v) and (len(score) < self.k or last >= score[-1] - self.s.tie):
                    ids, score, _ = self.best(mine[j], q_ids[lo + j], None)
                out.append((np.full(len(ids), q_ids[lo + j]), np.full(len(ids), q_rows[lo + j]), ids, score))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "query_row", "vec_id", "score"])


def _search(batches: Iterator[pa.RecordBatch], k: int, s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (dim, shard, kind): a shard's nodes, then its queries."""
    now, shard = None, None
    for batch in batches:
        key = np.stack([batch[c].to_numpy() for c in ("dim", "shard", "kind")], axis=1)
        edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if lo == hi:
                continue
            part, own = batch.slice(lo, hi - lo), tuple(key[lo, :2].tolist())
            if own != now:
                now, shard = own, _Shard(k, s)
            if key[lo, 2] == 0:
                shard.add(part)
                continue
            shard.ready()
            if shard.graph is not None:
                vectors, n = _lists(part["embedding"], np.float64)
                yield shard.search(part["query_id"].to_numpy(), part["query_row"].to_numpy(), vectors.reshape(len(n), -1))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def index(vectors: DataFrame, k: int, s: Settings = Settings()) -> DataFrame:
    """One row per node; ``vectors`` has vec_id and embedding (doubles)."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    nodes = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("least"))
    nodes = stage(nodes.withColumn("dim", F.size("embedding")), "nodes")
    dealt = nodes.join(_shards(nodes, s), "dim").withColumn("shard", F.pmod(F.xxhash64("least"), F.col("n_shards")))
    made = stage(dealt.groupBy("dim", "shard").applyInPandas(lambda part: _index(part, s), _INDEX), "index")
    forget(nodes)
    return made


def _shards(nodes: DataFrame, s: Settings) -> DataFrame:
    """(dim, n_shards): one row for each vector length."""
    return nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / s.shard_size).alias("n_shards"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest of each query.

    Both frames have vec_id and embedding; a query skips rows with its own id.
    """
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    )
    nodes = index(clean(vectors), k, s)
    sizes = stage(nodes.groupBy("dim").agg(F.max("shard").alias("last"), F.countDistinct("shard").alias("n")), "shards")
    n_shards = sizes.agg(F.sum("n")).first()[0] or 1
    row = F.xxhash64("vec_id", "embedding").alias("query_row")
    asked = clean(queries).distinct().select(F.size("embedding").alias("dim"), F.col("vec_id").alias("query_id"), row, "embedding")
    asked = asked.join(sizes, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    asked = asked.select("dim", "shard", F.lit(1).alias("kind"), "query_id", "query_row", "embedding")
    rows = nodes.withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    streams = rows.repartition(n_shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = streams.mapInArrow(partial(_search, k=k, s=s), _FOUND)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
