"""Benchmark decontamination by a prefix-filtered set join (operator 8).

Every item is cut into windows of ``width`` words (a shorter item is one
window).  A document holds a window only if it holds all of its words, so for
containment the necessary prefix of a window is its rarest word; rarity is
counted over the whole corpus, for the benchmark's words, in one pass.  Document
words are joined to the prefix words; each match fixes where the window would
have to start.  The positional and length bounds drop windows that would leave
the document, and the rest are verified word by word.

Texts are read once for the counts and once for the join, whole, in parallel
and without a shuffle.  Indices are built in tasks, one for each ``part_bytes``
of items, and broadcast by groups of ``group_bytes`` of item text, whose size is
summed first; an index takes about 20 bytes a word.  Every Python worker holds
the index of one group.  A benchmark of several groups costs one pass over the
texts for each; what the groups find in equal texts is then merged.

Words are identified by 64-bit hashes.

Defined cases: a null text has no words; items with null id or text take no
part; items that share an id count once; repeated documents are judged each;
an empty table or benchmark gives no hits; extra columns are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import judged
from .scratch import stage
from .wordhash import ALNUM_SEP, release, slices, utf8, words

HITS = "n_words long, n_hit long, items array<string>, spans array<struct<begin: long, end: long>>"


@dataclass
class Index:
    """Windows ordered by prefix word."""

    prefix: np.ndarray  # sorted distinct prefix words
    first: np.ndarray  # first window of each prefix word, and the total
    offset: np.ndarray  # of the prefix word in its window
    length: np.ndarray
    item: np.ndarray
    at: np.ndarray  # where the window begins among the items' words
    ids: np.ndarray  # the items' words, one item after the other
    width: int
    names: list[str]
    table: np.ndarray  # whether any prefix word has these low bits


def build(names: list[str], texts: list[str], vocabulary: np.ndarray, counts: np.ndarray, width: int) -> Index:
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    ids, bounds = words(data, offsets, ALNUM_SEP)
    size = np.diff(bounds)
    n = np.where(size > 0, np.maximum(size - width + 1, 1), 0)
    item = np.repeat(np.arange(len(size)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)
    length = np.minimum(size[item], width)
    slot = np.searchsorted(vocabulary, ids)
    count = counts[slot] if len(counts) else np.zeros(len(ids), np.int64)
    # the first of the rarest words of each window
    least, offset = np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), np.int64)
    for j in range(width):
        here = np.where(j < length, count[np.minimum(at + j, max(len(ids) - 1, 0))], np.iinfo(np.int64).max) if len(at) else least
        offset[here < least] = j
        least = np.minimum(least, here)
    anchor = ids[at + offset]
    order = np.argsort(anchor, kind="stable")
    prefix, first = np.unique(anchor[order], return_index=True)
    table = np.zeros(1 << 16, dtype=bool)
    table[(prefix & np.uint64(0xFFFF)).astype(np.int64)] = True
    small = lambda x: x[order].astype(np.int32)
    return Index(prefix, np.append(first, len(order)), small(offset), small(length), small(item), small(at), ids, width, names, table)


def matches(ids: np.ndarray, bounds: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every window that occurs in some texts' words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(index.prefix) or not len(ids):
        return none
    at = np.flatnonzero(index.table[(ids & np.uint64(0xFFFF)).astype(np.int64)])
    slot = np.searchsorted(index.prefix, ids[at])
    slot[slot == len(index.prefix)] = 0
    same = index.prefix[slot] == ids[at]
    at, slot = at[same], slot[same]
    starts, wins = [], []
    for lo in range(0, len(at), 20_000):
        p, s = at[lo : lo + 20_000], slot[lo : lo + 20_000]
        n = index.first[s + 1] - index.first[s]
        window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.first[s], n)
        start = np.repeat(p, n) - index.offset[window]
        text = np.repeat(np.searchsorted(bounds, p, side="right") - 1, n)
        ok = (start >= bounds[text]) & (start + index.length[window] <= bounds[text + 1])
        start, window = start[ok], window[ok]
        for j in range(index.width):
            inside = j < index.length[window]
            ok = ~inside | (ids[np.where(inside, start + j, 0)] == index.ids[np.where(inside, index.at[window] + j, 0)])
            start, window = start[ok], window[ok]
            if not len(start):
                break
        starts.append(start)
        wins.append(window)
    return (np.concatenate(starts), np.concatenate(wins)) if starts else none


def _judge(texts: pa.Array, parts) -> list[pa.Array]:
    data, offsets = utf8(texts)
    n_words: list[int] = []
    n_hit: list[int] = []
    items: list[list[str]] = []
    spans: list[list] = []
    for lo, hi in slices(offsets):
        a = offsets[lo]
        ids, bounds = words(data[a : offsets[hi]], offsets[lo : hi + 1] - a, ALNUM_SEP)
        change = np.zeros(len(ids) + 1, dtype=np.int64)
        found: dict[int, set[str]] = {}
        for index in parts.value:
            start, window = matches(ids, bounds, index)
            np.add.at(change, start, 1)
            np.add.at(change, start + index.length[window], -1)
            text = np.searchsorted(bounds, start, side="right") - 1
            if len(text):
                for t, k in np.unique(np.stack([text, index.item[window]]), axis=1).T.tolist():
                    found.setdefault(t, set()).add(index.names[k])
        hit = np.cumsum(change[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        n_words += np.diff(bounds).tolist()
        n_hit += (total[bounds[1:]] - total[bounds[:-1]]).tolist()
        for t in range(hi - lo):
            items.append(sorted(found.get(t, ())))
            if t not in found:
                spans.append([])
                continue
            own = np.concatenate([[0], hit[bounds[t] : bounds[t + 1]].astype(np.int8), [0]])
            turn = np.flatnonzero(np.diff(own))
            spans.append([{"begin": b, "end": e} for b, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)])
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)]


def _count(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Occurrences of the vocabulary's words, or of all words without one."""
    known = None if vocabulary is None else vocabulary.value
    total = None if known is None else np.zeros(len(known), dtype=np.int64)
    rows = lambda word, n: pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])
    for batch in batches:
        data, offsets = utf8(batch["text"])
        for lo, hi in slices(offsets):
            a = offsets[lo]
            ids, _ = words(data[a : offsets[hi]], offsets[lo : hi + 1] - a, ALNUM_SEP)
            if known is None:
                yield rows(*np.unique(ids, return_counts=True))
                continue
            slot = np.searchsorted(known, ids)
            slot[slot == len(known)] = 0
            total += np.bincount(slot[known[slot] == ids], minlength=len(known))
        del batch, data, offsets
        release()
    if known is not None:
        seen = np.flatnonzero(total)
        yield rows(known[seen], total[seen])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch["text"])
        ids, bounds = words(data, offsets, ALNUM_SEP)
        part = np.repeat(batch["part"].to_numpy(), np.diff(bounds))
        pair = np.unique(np.stack([part, ids.view(np.int64)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["part", "word"])


def rarity(docs: DataFrame, vocabulary: DataFrame, text_col: str = "text", broadcast_words: int = 1 << 20) -> DataFrame:
    """(word, n): how often each word of a vocabulary occurs in all documents.
    The vocabulary is sent to the tasks while it has at most ``broadcast_words``
    rows of 8 bytes."""
    shared = None
    if vocabulary.count() <= broadcast_words:
        known = np.sort(np.array([r[0] for r in vocabulary.collect()], dtype=np.int64).view(np.uint64))
        if not len(known):
            return vocabulary.withColumn("n", F.lit(0).cast("long"))
        shared = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(partial(_count, vocabulary=shared), "word long, n long")
    counts = rows.groupBy("word").agg(F.sum("n").alias("n"))
    return counts if shared is not None else counts.join(vocabulary, "word", "left_semi")


def indices(docs: DataFrame, items: DataFrame, width: int, text_col: str, part_bytes: int, broadcast_words: int) -> tuple[DataFrame, int]:
    """(table of (part, bytes, index), bytes of item text); indices are built in tasks."""
    items = items.dropDuplicates(["id", "text"])
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    n_parts = max(1, -(-size // part_bytes))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(n_parts)))
    own = stage(dealt.select("part", "text").mapInArrow(_item_words, "part long, word long").distinct(), "item_words")
    counts = rarity(docs, own.select("word").distinct(), text_col, broadcast_words)
    known = own.join(counts, "word", "left").select("part", "word", F.coalesce("n", F.lit(0)).alias("n"))

    def make(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"part": [], "bytes": [], "index": []})
        left = left.sort_values(["id", "text"])
        word = right["word"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(word)
        index = build(left["id"].tolist(), left["text"].tolist(), word[order], right["n"].to_numpy(dtype=np.int64)[order], width)
        size = sum(len(t.encode()) for t in left["text"])
        return pd.DataFrame({"part": [left["part"].iloc[0]], "bytes": [size], "index": [pickle.dumps(index)]})

    made = dealt.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(make, "part long, bytes long, index binary")
    return stage(made, "indices"), size


def _groups(table: DataFrame, group_bytes: int) -> list[list[int]]:
    """Parts (one row each) packed in order into groups of bounded size."""
    out, room = [], 0
    for part, size in table.select("part", "bytes").orderBy("part").toLocalIterator():
        if not out or size > room:
            out.append([])
            room = group_bytes
        out[-1].append(part)
        room -= size
    return out or [[]]


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several groups as disjoint ones, and the words they hold."""
    for batch in batches:
        hits, spans = [], []
        for row in batch["spans"].to_pylist():
            merged: list[dict] = []
            for x in sorted(row or [], key=lambda x: x["begin"]):
                if merged and x["begin"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], x["end"])
                else:
                    merged.append(dict(x))
            spans.append(merged)
            hits.append(sum(x["end"] - x["begin"] for x in merged))
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch["key_a"], batch["key_b"], pa.array(hits, pa.int64()), batch["items"], pa.array(spans, kind)], names=["key_a", "key_b", "n_hit", "items", "spans"]
        )


def inspect(
    docs: DataFrame,
    items: DataFrame,
    width: int = 13,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    part_bytes: int = 4 << 20,
    group_bytes: int = 32 << 20,
    broadcast_words: int = 1 << 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``row`` (the document, or its columns ``keep``) and those of ``HITS``: how many of its
    words lie in occurrences of windows, of which items, and where (in words)."""
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).dropna()
    table, _ = indices(docs, items, width, text_col, part_bytes, broadcast_words)
    groups = _groups(table, group_bytes)

    def shared(parts: list[int]):
        # at most group_bytes of item text
        blobs = table.where(F.col("part").isin(parts)).orderBy("part").select("index").collect() if parts else []
        return spark.sparkContext.broadcast([pickle.loads(r[0]) for r in blobs])

    if len(groups) == 1:
        own = shared(groups[0])
        return judged(docs, text_col, lambda: partial(_judge, parts=own), HITS, keep)
    key = [F.xxhash64("text").alias("key_a"), F.xxhash64("text", F.lit(1)).alias("key_b")]
    texts = docs.select(F.col(text_col).alias("text"))
    found = None
    for g in groups:
        own = shared(g)
        hits = judged(texts.select("text", *key), "text", lambda own=own: partial(_judge, parts=own), HITS, ["key_a", "key_b"])
        hits = stage(hits.where("n_hit > 0").select("row.key_a", "row.key_b", "items", "spans").distinct(), "hits")
        own.destroy()
        found = hits if found is None else found.union(hits)
    found = found.groupBy("key_a", "key_b").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")
    )
    merged = found.mapInArrow(_union, "key_a long, key_b long, n_hit long, items array<string>, spans array<struct<begin: long, end: long>>")
    none = spark.sparkContext.broadcast([])
    row = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(text_col).alias("text")).select("row", "text", *key)
    sized = judged(row, "text", lambda: partial(_judge, parts=none), HITS, ["row", "key_a", "key_b"]).select("row.*", "n_words")
    empty = lambda c: F.array().cast(merged.schema[c].dataType)
    return sized.join(merged, ["key_a", "key_b"], "left").select(
        "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", empty("items")).alias("items"), F.coalesce("spans", empty("spans")).alias("spans")
    )


def contaminated(least_hits: int = 1, share: int = 20):
    """Hit words reach ``least_hits`` and one in ``share`` of all words."""
    return (F.col("n_hit") >= least_hits) & (share * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents without any occurrence of a window, with their columns: a
    benchmark passage in a long document leaks as much as one in a short one, so
    its share of the words, which :func:`contaminated` reports, does not matter."""
    return inspect(docs, items, **settings).where("n_hit = 0").select("row.*")
