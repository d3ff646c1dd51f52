"""URL rules behind a blocked Bloom filter (operator 1).

A rule is a canonical URL prefix: a host, which stands for itself and all its
subdomains, and a path prefix.  A page's possible rules are the pairs of a host
suffix and a path prefix of one of the lengths that rules have.  They are probed
in a blocked Bloom filter of all rules: each key sets eight bits of one block of
256, so a probe reads one block.  Possible hits go to an exact hash join with
the rules, which removes false positives, and the longest rule wins.

The filter is a table of blocks joined by block number.  Filter and rules are
broadcast while their counted rows stay within ``broadcast_rows``; beyond that
both joins are shuffled and adaptive execution splits hot keys.

Everything is DataFrame functions.

Defined cases: a null url or one without ``://`` has empty host and path, and
no rule; pages without a rule get ``default``; rules with null parts are
ignored; a rule stated twice with different verdicts blocks; repeated pages are
each returned; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z folded."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block")


def _masks(key: Column) -> list[Column]:
    """For each of a block's four words, the key's two bits."""
    h = F.xxhash64(key, F.lit(1))
    out = []
    for w in range(4):
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 12 * w + 6 * b).bitwiseAND(F.lit(63)).cast("int")) for b in (0, 1)]
        out.append(bits[0].bitwiseOR(bits[1]).alias(f"m{w}"))
    return out


def bloom(keys: DataFrame, n_blocks: int) -> DataFrame:
    """One row per non-empty block: four words of 64 bits."""
    masks = keys.select(_block(F.col("key"), n_blocks), *_masks(F.col("key")))
    return masks.groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(4)])


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    bits_per_key: int = 16,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Columns id, url, host, path, rule and verdict of every page.

    ``rules`` has columns host, path and verdict (allow or block).
    """
    known = rules.dropna(subset=["host", "path", "verdict"])
    known = known.groupBy(F.concat("host", "path").alias("key")).agg(F.max("verdict").alias("verdict"), F.first("path").alias("path"))
    lengths = [r[0] for r in known.select(F.length("path")).distinct().sort(F.length("path")).toLocalIterator()]  # at most the longest path
    n_rules = known.count()
    small = F.broadcast if n_rules <= broadcast_rows else (lambda df: df)
    blocks = max(1, -(-n_rules * bits_per_key // 256))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))

    parts = rows.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    labels = F.split("host", "\\.")
    suffix = parts.select("id", "url", "path", labels.alias("labels"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("from"))
    suffix = suffix.select("id", "url", "path", F.array_join(F.slice("labels", F.col("from"), F.size("labels")), ".").alias("suffix"))
    prefix = suffix.withColumn("n", F.explode(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"))).where("length(path) >= n")
    possible = prefix.select("id", "url", F.concat("suffix", F.substring("path", F.lit(1), F.col("n"))).alias("key"))
    probe = possible.select("id", "url", "key", _block(F.col("key"), blocks), *_masks(F.col("key")))
    held = probe.join(small(bloom(known, blocks)), "block")
    for w in range(4):
        held = held.where(F.col(f"w{w}").bitwiseAND(F.col(f"m{w}")) == F.col(f"m{w}"))
    exact = held.select("id", "url", "key").join(small(known.select("key", "verdict")), "key")

    best = F.struct(F.length("key").alias("length"), F.col("key").alias("rule"), "verdict")
    hits = exact.select("id", "url", best.alias("best"), F.lit(0).cast("long").alias("copies"))
    all_rows = rows.select("id", "url", F.lit(None).cast(hits.schema["best"].dataType).alias("best"), F.lit(1).cast("long").alias("copies"))
    judged = all_rows.union(hits).groupBy("id", "url").agg(F.max("best").alias("best"), F.sum("copies").alias("copies"))
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
