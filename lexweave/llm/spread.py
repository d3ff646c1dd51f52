"""Joins whose keys may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may get, and how many keys may be dealt over
#: salts.  The larger the table, the more rows a key must have for that, so the
#: list of such keys, which is broadcast, never has more than MOST_HOT rows.
LEAST_ROWS = 1024
MOST_HOT = 20_000


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame | None:
    """(key, salts) of the keys with so many of ``total`` rows that they are
    dealt over salts: at most ``MOST_HOT`` rows.  ``counts`` has (key, count)."""
    unit = max(LEAST_ROWS, -(-total // MOST_HOT))
    if total <= unit:
        return None
    hot = counts.where(F.col(key).isNotNull() & (F.col("count") > unit)).select(key, F.ceil(F.col("count") / unit).alias("salts"))
    rows = hot.collect()
    return counts.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``many.join(one, key, how)`` for inner, left, left_semi and left_anti.

    Rows of ``many`` with a hot key are dealt over salts by a hash of the whole
    row; rows of ``one`` with that key are repeated for each salt.  ``many``
    should be a written table, as its rows are counted unless ``counts`` (key,
    count) and ``total`` are given.
    """
    total = many.count() if total is None else total
    hot = hot_keys(many.groupBy(key).count() if counts is None else counts, key, total)
    if hot is None:
        return many.join(one, key, how)
    hot = F.broadcast(hot)
    columns = [c for c in many.columns if c != key]
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    left = many.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*many.columns), salts)).select(key, "__salt", *columns)
    right = one.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    return left.join(right, [key, "__salt"], how).drop("__salt")
