"""MinHash near-duplicates with sequential Bayesian verification (operator 7).

1. One pass over whole texts gives every row its shingle-set size, a 128-bit
   key of the set (rows with equal sets form one class) and, once per class and
   batch, a MinHash signature.
2. Classes that share a signature band are candidates.  Every class is first
   compared with one representative, the least class that it shares a bucket
   with; a family of near copies is mostly connected by these, with work in
   proportion to its size.
3. What a bucket still holds of different components is compared in blocks: label exchange gathers classes into groups, groups are
   cut into blocks of bounded rows and shingles, and a bucket only states which
   pairs of *blocks* must be compared.  A large component has blocks of its own,
   which are never compared with each other.
4. Candidates (pairs sharing a band) are compared in batches of signature
   positions.  After each batch a pair is dropped when the posterior probability
   that its similarity reaches the threshold is below a bound, chosen so that a
   pair at the threshold is lost with probability ``miss`` at most over all
   batches.  Survivors are verified on their full sets; of a pair of blocks, best
   estimate first, unless they are already connected.
5. Components of the links are found with alternating star contraction.

Shingles are identified by 64-bit hashes.  Joins on buckets, representatives,
labels and components deal hot keys over salts; no task holds more than two
blocks, no driver holds anything that grows with the data.

Recall: a pair at the threshold is missed by the bands with probability 5e-5 and
by pruning with ``miss``; the larger the similarity, the less.  ``EXACT`` has one
position a band and no pruning, so that every pair with a realistic chance of a
link (all but 0.15 ** 64) is verified, at the price of many more candidates.

Defined cases: null, empty and blank texts have an empty set, link to nothing
and are their own component; a text of fewer words than a shingle has one
shingle; repeated rows, and rows that repeat a doc_id, are nodes of their own;
a null doc_id never becomes a component's id unless all its rows have none;
extra columns are ignored by :func:`components` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, stage
from .spread import spread_join
from .wordhash import SPACE_SEP, mix, release, shingle_sets, slices, utf8, words

_NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """A link needs ``100 * |A & B| >= percent * |A | B|``.

    21 bands of 6 positions miss a pair of similarity 0.85 with probability
    5e-5 and one of 0.8 with 1.8e-3.
    """

    width: int = 5
    percent: int = 85
    bands: int = 21
    rows: int = 6
    bands_per_batch: int = 7
    miss: float = 1e-4  # most probability that pruning loses a pair at the threshold; 0 prunes nothing
    block: int = 384  # classes in a block
    block_shingles: int = 1 << 20  # shingles in a block, 8 bytes each
    broadcast_ids: int = 262_144  # rows of one to four keys, 40 to 100 bytes each in a broadcast

    @property
    def positions(self) -> int:
        return self.bands * self.rows

    @property
    def batches(self) -> list[int]:
        """Positions seen after each batch."""
        step = self.bands_per_batch * self.rows
        return [min(k, self.positions) for k in range(step, self.positions + step, step)]


EXACT = Settings(bands=64, rows=1, bands_per_batch=64, miss=0.0)


@lru_cache(maxsize=4)
def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
    return (seed[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[k:] >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    mul, add = _family(k)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 1024):
        np.minimum(out, (x[lo : lo + 1024, None] * mul + add).min(axis=0), out=out)
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """A 128-bit key of a set: its size enters both sums."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(shingles))
        a = (mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + n) * np.uint64(0x9E3779B97F4A7C15)
        b = mix(shingles + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) ^ n
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    data, offsets = utf8(column)
    for lo, hi in slices(offsets):
        a, b = offsets[lo], offsets[hi]
        yield from shingle_sets(*words(data[a:b], offsets[lo : hi + 1] - a, SPACE_SEP), width)


def buckets(sig: np.ndarray, s: Settings) -> np.ndarray:
    """One 64-bit number for each band of a signature."""
    band = sig.reshape(s.bands, s.rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.arange(1, s.bands + 1, dtype=np.uint64)
        for j in range(s.rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + band[:, j])
    return out.view(np.int64)


def _profiles(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, keys, bands, seen = [], [], [], set()
        for shingles in _sets(batch["text"], s.width):
            key = set_key(shingles) if len(shingles) else None
            size.append(len(shingles))
            keys.append(key)
            bands.append(None if key is None or key in seen else buckets(signature(shingles, s.positions), s))
            seen.add(key)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "class", "bands"],
        )
        del batch, keys, bands
        release()


def profiles(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_profiles, s=s), "doc_id long, n_shingles long, class binary, bands array<long>")


def _set_rows(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, size, sigs, sets = [], [], [], []
        for shingles in _sets(batch["text"], s.width):
            if len(shingles):
                keys.append(set_key(shingles))
                size.append(len(shingles))
                sigs.append(signature(shingles, s.positions).tobytes())
                sets.append(shingles.tobytes())
        columns = [pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["class", "n_shingles", "signature", "shingles"])
        del batch, keys, sigs, sets, columns
        release()


@lru_cache(maxsize=32)
def least_matches(n: int, percent: int, miss: float) -> int:
    """Fewest equal positions of ``n`` at which the posterior probability of a
    similarity of at least percent/100 is ``miss`` or more.

    MinHash positions agree with probability equal to the similarity; with a
    uniform prior the posterior after m matches is Beta(m+1, n-m+1), and its
    upper tail beyond t is the chance of at most m successes in n+1 trials.
    """
    from math import comb

    t, tail = percent / 100, 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def lost(s: Settings, least: tuple[int, ...], similarity: float) -> float:
    """Probability that a pair of this similarity falls under a bound."""
    from math import comb

    alive, seen = np.ones(1), 0
    for to, m in zip(s.batches, least, strict=True):
        n = to - seen
        step = np.array([comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(n + 1)])
        alive, seen = np.convolve(alive, step), to
        alive[:m] = 0.0
    return float(1 - alive.sum())


@lru_cache(maxsize=8)
def pruning(s: Settings) -> tuple[int, ...]:
    """Fewest equal positions after each batch: the tightest posterior bound of
    which a pair at the threshold is lost with probability ``miss`` at most."""
    if s.miss <= 0:
        return (0,) * len(s.batches)
    bound = s.miss
    while True:
        least = tuple(least_matches(n, s.percent, bound) for n in s.batches)
        if lost(s, least, s.percent / 100) <= s.miss:
            return least
        bound /= 2


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _links(part: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """Verified links of one pair of blocks between components that are not
    connected yet, as a spanning forest."""
    part = part.sort_values(["side", "class"], kind="stable").drop_duplicates("class").reset_index(drop=True)
    sig = np.stack([np.frombuffer(x, dtype=np.uint32) for x in part["signature"]])
    sets = [np.frombuffer(x, dtype=np.uint64) for x in part["shingles"]]
    size = part["n_shingles"].to_numpy()
    root = part["root"].factorize()[0]
    side = part["side"].to_numpy()
    two = side.min() != side.max()
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    found = []
    for lo in range(0, len(left), 64):
        rows = left[lo : lo + 64]
        banded = np.zeros((len(rows), len(right)), dtype=bool)
        for b in range(s.bands):
            hit = np.ones_like(banded)
            for p in range(b * s.rows, (b + 1) * s.rows):
                hit &= sig[rows, p][:, None] == sig[right, p][None, :]
            banded |= hit
        if not two:
            banded &= right[None, :] > rows[:, None]
        banded &= root[rows][:, None] != root[right][None, :]
        # a size ratio under the threshold rules a link out, exactly
        small, large = np.minimum(size[rows][:, None], size[right][None, :]), np.maximum(size[rows][:, None], size[right][None, :])
        banded &= 100 * small >= s.percent * large
        i, j = np.nonzero(banded)
        i, j = rows[i], right[j]
        matches, seen = np.zeros(len(i), dtype=np.int64), 0
        for to, least in zip(s.batches, pruning(s), strict=True):
            matches += (sig[i, seen:to] == sig[j, seen:to]).sum(axis=1)
            live = matches >= least
            i, j, matches, seen = i[live], j[live], matches[live], to
        found.append(np.stack([i, j, matches]))
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0], -pairs[2]))]
    forest, a, b = _Forest(len(part)), [], []
    for i, j in pairs[:2].T.tolist():
        if forest.find(int(root[i])) == forest.find(int(root[j])):
            continue
        if linked(sets[i], sets[j], s):
            forest.join(int(root[i]), int(root[j]))
            a.append(part["root"][i])
            b.append(part["root"][j])
    return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})


def linked(a: np.ndarray, b: np.ndarray, s: Settings) -> bool:
    both = common(a, b)
    return 100 * both >= s.percent * (len(a) + len(b) - both)


def _star(part: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """Verified links of some classes with their one representative (``side`` 1)."""
    head, rest = part[part["side"] == 1].iloc[0], part[part["side"] == 0].drop_duplicates("class")
    mine = np.frombuffer(head["signature"], dtype=np.uint32)
    sig = np.stack([np.frombuffer(x, dtype=np.uint32) for x in rest["signature"]])
    at, matches, seen = np.arange(len(rest)), np.zeros(len(rest), dtype=np.int64), 0
    for to, least in zip(s.batches, pruning(s), strict=True):
        matches += (sig[at, seen:to] == mine[seen:to]).sum(axis=1)
        live = matches >= least
        at, matches, seen = at[live], matches[live], to
    own = np.frombuffer(head["shingles"], dtype=np.uint64)
    names, sets = rest["class"].tolist(), rest["shingles"].tolist()
    found = [names[k] for k in at.tolist() if linked(np.frombuffer(sets[k], dtype=np.uint64), own, s)]
    return pd.DataFrame({"a": pd.Series(found, dtype=object), "b": pd.Series([head["class"]] * len(found), dtype=object)})


def classes(rows: DataFrame) -> DataFrame:
    """One row per distinct set: its least id, rows, size and buckets."""
    return (
        rows.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("least"), F.count(F.lit(1)).alias("n_rows"), F.max("n_shingles").alias("n_shingles"), F.max("bands").alias("bands"))
    )


def _join(many: DataFrame, one: DataFrame, key: str, s: Settings, how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``one``, a written table, is broadcast while it has few rows; else hot keys of ``many`` are dealt over salts."""
    if one.count() <= s.broadcast_ids:
        return many.join(F.broadcast(one), key, how)
    return spread_join(many, one, key, how, counts, total)


def _members(nodes: DataFrame, s: Settings) -> DataFrame:
    """(bucket, class, n_shingles) rows of buckets with two or more classes."""
    banded = nodes.select("class", "n_shingles", F.explode("bands").alias("bucket"))
    # most buckets hold one class: count them by their numbers alone, and only
    # then bring in the classes of the others
    shared = stage(banded.groupBy("bucket").count().where("count > 1"), "shared")
    if shared.count() <= s.broadcast_ids:
        member = banded.join(F.broadcast(shared.select("bucket")), "bucket")
    else:
        member = spread_join(banded, shared.select("bucket"), "bucket", counts=shared, total=nodes.count() * s.bands)
    member = stage(member.select("bucket", "class", "n_shingles"), "members")
    forget(shared)
    return member


def _sets_of(docs: DataFrame, nodes: DataFrame, member: DataFrame, s: Settings) -> DataFrame:
    """(class, n_shingles, signature, shingles) of the members' classes, each
    once.  Texts are read again; ids select them, by a broadcast while these are few."""
    wanted = stage(member.select("class").distinct(), "wanted")
    ids = stage(_join(nodes.select("class", "least"), wanted, "class", s, "left_semi").select(F.col("least").alias("row_id")).distinct(), "wanted_ids")
    few = ids.count() <= s.broadcast_ids
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("row_id"), "text").join(F.broadcast(ids) if few else ids, "row_id", "left_semi")
    full = stage(texts.select("text").mapInArrow(partial(_set_rows, s=s), "class binary, n_shingles long, signature binary, shingles binary"), "sets")
    # an id may stand for several rows, and for classes that nobody wants
    if full.count() != wanted.count():
        once = full.groupBy("class").agg(*[F.first(c).alias(c) for c in full.columns[1:]])
        once = stage(_join(once, wanted, "class", s, "left_semi"), "sets")
        forget(full)
        full = once
    forget(wanted, ids)
    return full


def _dealt(rows: DataFrame, key: str, s: Settings) -> DataFrame:
    """Adds ``salt``: the rows of a key (class, n_shingles) in parts of bounded size."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.sum("n_shingles").alias("total"))
    parts = F.ceil(F.greatest(F.col("count") / s.block, F.col("total") / s.block_shingles))
    sizes = stage(sizes.withColumn("parts", parts).where("parts > 1"), "sizes")
    joined = _join(rows, sizes.select(key, "parts"), key, s, "left", sizes, rows.count())
    return joined.withColumn("salt", F.pmod(F.xxhash64("class"), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")


def _with_sets(wanted: DataFrame, full: DataFrame, s: Settings) -> DataFrame:
    """``wanted``, a written table of names that may repeat a class, with its sets.
    Few names are broadcast, so that sets stay where they are until the tasks
    that compare them; else both sides are shuffled, hot classes over salts."""
    if wanted.count() <= s.broadcast_ids:
        return full.join(F.broadcast(wanted), "class")
    return spread_join(wanted, full, "class")


def _star_links(member: DataFrame, full: DataFrame, s: Settings) -> DataFrame:
    """Verified links (a, b) of classes with the least class of their buckets, b < a."""
    one = F.struct("class", "n_shingles")
    ends = stage(member.groupBy("bucket").agg(F.min(one).alias("low"), F.count(F.lit(1)).alias("count")), "ends")
    met = _join(member, ends.select("bucket", "low"), "bucket", s, counts=ends, total=member.count())
    pairs = met.groupBy("class", "n_shingles").agg(F.min("low").alias("low")).where(F.col("class") != F.col("low.class"))
    a, b = F.col("n_shingles"), F.col("low.n_shingles")
    pairs = pairs.where(100 * F.least(a, b) >= s.percent * F.greatest(a, b)).select("class", "n_shingles", F.col("low.class").alias("rep"))
    pairs = stage(_dealt(stage(pairs, "stars"), "rep", s).select("class", "rep", "salt"), "dealt_stars")
    wanted = pairs.withColumn("side", F.lit(0)).union(pairs.select("rep", "rep", "salt").distinct().withColumn("side", F.lit(1)))
    wanted = stage(wanted, "star_rows")
    work = _with_sets(wanted, full.drop("n_shingles"), s)
    found = stage(work.groupBy("rep", "salt").applyInPandas(lambda part: _star(part, s), "a binary, b binary"), "star_links")
    forget(ends, pairs, wanted)
    return found


def _block_links(member: DataFrame, full: DataFrame, stars: DataFrame, s: Settings) -> DataFrame:
    """Verified links (a, b) between what buckets hold besides the stars: a
    class's ``root`` is its representative's representative."""
    second = stars.select(F.col("a").alias("b"), F.col("b").alias("upper"))
    root = stage(stars.join(second, "b", "left").select(F.col("a").alias("class"), F.coalesce("upper", "b").alias("root")), "star_roots")
    tagged = _join(member, root, "class", s, "left").withColumn("root", F.coalesce("root", "class"))
    tagged = stage(tagged, "tagged")
    ends = tagged.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("count"))
    ends = stage(ends.where("low <> high"), "open")
    left = _join(tagged, ends.select("bucket", "low"), "bucket", s, counts=ends, total=tagged.count())
    left = stage(left.select("bucket", "class", "n_shingles", "root", "low"), "open_members")
    forget(root, tagged)

    # two rounds of label exchange between stars and buckets
    label = stage(left.groupBy("root").agg(F.min("low").alias("label"), F.count(F.lit(1)).alias("count")), "labels")
    lower = _join(left.select("bucket", "root"), label.select("root", "label"), "root", s, counts=label, total=left.count())
    lower = stage(lower.groupBy("bucket").agg(F.min("label").alias("lower")), "lower")
    wide = _join(left.select("bucket", "class", "n_shingles", "root"), lower, "bucket", s, counts=ends, total=left.count())
    wide = stage(wide.groupBy("class", "n_shingles", "root").agg(F.min("lower").alias("lower")), "open_classes")
    label2 = stage(wide.groupBy("root").agg(F.min("lower").alias("label"), F.count(F.lit(1)).alias("count")), "labels")
    grouped = _join(wide.drop("lower"), label2, "root", s, counts=label2, total=wide.count())
    # a star of more than a block has blocks of its own
    large = F.when(F.col("count") > s.block, F.col("root"))
    kin = F.struct(large.isNotNull().alias("alone"), F.coalesce(large, "label").alias("name")).alias("kin")
    grouped = stage(grouped.select("class", "root", "n_shingles", large.alias("large"), kin), "grouped")
    block = F.xxhash64("kin.alone", "kin.name", "salt").alias("block")
    block = stage(_dealt(grouped, "kin", s).select("class", "root", "large", block), "blocks")

    touched = stage(_join(left.select("bucket", "class"), block, "class", s).select("bucket", "block", "large").distinct(), "touched")
    right = touched.select("bucket", F.col("block").alias("right"), F.col("large").alias("right_large"))
    pair = spread_join(touched, right, "bucket").where("block <= right and coalesce(large <> right_large, true)").select(F.col("block").alias("left"), "right")
    sides = stage(pair.distinct().select("left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block")), "sides")
    # names meet first, so that sets go to their names once and to the tasks once
    wanted = spread_join(sides, block.select("block", "class", "root"), "block").withColumn("side", (F.col("block") == F.col("right")).cast("int"))
    wanted = stage(wanted.select("left", "right", "side", "class", "root"), "block_rows")
    work = _with_sets(wanted, full, s)
    found = stage(work.groupBy("left", "right").applyInPandas(lambda part: _links(part, s), "a binary, b binary"), "block_links")
    forget(ends, left, label, lower, wide, label2, grouped, block, touched, sides, wanted)
    return found


def links(docs: DataFrame, nodes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Verified links (a, b) that connect what belongs together."""
    member = _members(nodes, s)
    full = _sets_of(docs, nodes, member, s)
    stars = _star_links(member, full, s)
    more = _block_links(member, full, stars, s)
    forget(member, full)
    return stars.union(more)


def connect(edges: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b), roots included; a root is
    its component's least node.  Alternating large-star and small-star steps
    make every component a star in O(log^2 n) rounds."""

    def directed(e: DataFrame) -> DataFrame:
        return stage(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def settled(e: DataFrame) -> bool:
        """Every node has one neighbour below it, which has none itself."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()

    e = directed(edges)
    while not settled(e):
        both = e.union(e.select("b", "a"))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("count")), "least")
        met = _join(both, least.select("a", "m"), "a", s, counts=least)
        large = directed(met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        forget(e, least)
        least = stage(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("count")), "least")
        near = _join(large, least.select("a", "m"), "a", s, counts=least)
        e = directed(near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))
        forget(large, least)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def components(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    rows = stage(profiles(docs, s), "profiles")
    nodes = stage(classes(rows), "classes")
    root = stage(connect(links(docs, nodes, s), s).withColumnRenamed("node", "class"), "roots")
    root = stage(_join(nodes.select("class", "least"), root, "class", s), "rooted")
    lowest = stage(root.groupBy("root").agg(F.min("least").alias("lowest"), F.count(F.lit(1)).alias("count")), "lowest")
    named = _join(root, lowest.select("root", "lowest"), "root", s, counts=lowest, total=root.count()).select("class", "lowest")
    # rows of other classes with one row are their own component
    own = nodes.where("n_rows > 1").select("class", "least", "n_rows").join(named, "class", "full_outer")
    own = own.select("class", F.coalesce("lowest", "least").alias("lowest"), F.coalesce("n_rows", F.lit(1)).alias("count"))
    own = stage(own, "named")
    n = own.count()
    thin = rows.select("doc_id", "n_shingles", "class")
    if n <= s.broadcast_ids:
        out = thin.join(F.broadcast(own.select("class", "lowest")), "class", "left")
    else:
        some = thin.where("class is not null")
        out = spread_join(some, own.select("class", "lowest"), "class", "left", counts=own, total=some.count())
        out = out.unionByName(thin.where("class is null").withColumn("lowest", F.lit(None).cast("long")))
    out = out.withColumn("component_id", F.when(F.col("lowest").isNull(), F.col("doc_id")).otherwise(F.expr(f"nullif(lowest, {_NO_ID})")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near-duplicates:
    that whose doc_id is the component's id, once if its rows repeat.

    Texts stay where they are: only ids are shuffled, and the ids that go are
    broadcast while they are few.
    """
    ids = components(docs, s).groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    ids = stage(ids, "decisions")
    gone, repeated = ids.where("not stays").select("__id"), ids.where("stays and n > 1").select("__id")

    def join(left: DataFrame, right: DataFrame, n: int, how: str) -> DataFrame:
        right = F.broadcast(right) if n <= s.broadcast_ids else right
        return left.join(right, left["doc_id"].eqNullSafe(right["__id"]), how)

    kept = join(docs, gone, gone.count(), "left_anti")
    n = repeated.count()
    if not n:
        return kept
    return join(kept, repeated, n, "left_anti").union(join(kept, repeated, n, "left_semi").dropDuplicates(["doc_id", "text"]))
