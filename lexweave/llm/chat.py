"""Collapse of logged conversation snapshots, then chat rendering (operator 3).

A chat log often holds the same conversation several times, each log longer by
some turns.  A rolling hash of the first k turns, for every k, shows which whole
conversations are the beginning of longer ones: a conversation whose own hash
is a longer one's prefix hash is dropped by an anti-join.  Of equal
conversations the least conv_id stays.  The kept ones are rendered turn by turn.

The rolling hash of k turns is the sum, over two 64-bit hashes of (position,
role, text), so it can be summed in chunks of positions: no window holds more
than ``chunk`` rows, or ``chunk`` sums of chunks, and a conversation with a third
of all rows is spread over its chunks.

Turns are known by two 64-bit hashes of (role, text) until they are rendered:
texts are shuffled once, and those of turn numbers that several different rows
share once more, to order them.  That order is found in ranges of (conversation,
turn, role, text), so no task sorts all rows of one turn number.

Everything is DataFrame functions.

Defined cases: rows with null conv_id take no part; a null turn sorts before
all others; equal rows (conversation, turn, role, text) count once; several
rows of one turn are ordered by role, then text; a null role renders as
``unknown`` and a null text as empty, but both are told apart from those in
hashes; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage
from .spread import spread_join

_WIDE = "decimal(38,0)"
_KEY = ["conv_id", "known", "turn", "ha", "hb"]


def _before(rows: DataFrame, place: str, values: list[str], chunk: int, levels: int = 3) -> DataFrame:
    """Adds ``before_<value>``: the sum over rows of the same conversation with a
    smaller ``place``, which is unique there.  Windows hold ``chunk`` rows of one level."""
    if levels == 1:
        own = Window.partitionBy("conv_id").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(own), F.lit(0).cast(_WIDE)).cast(_WIDE) for v in values})
    up = f"{place}_up"
    rows = rows.withColumn(up, F.floor(F.col(place) / chunk))
    own = Window.partitionBy("conv_id", up).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"inner_{v}": F.coalesce(F.sum(v).over(own), F.lit(0).cast(_WIDE)) for v in values})
    sums = rows.groupBy("conv_id", up).agg(*[F.sum(v).cast(_WIDE).alias(v) for v in values])
    above = _before(sums, up, values, chunk, levels - 1).select("conv_id", up, *[f"before_{v}" for v in values])
    joined = rows.join(above, ["conv_id", up])
    return joined.withColumns({f"before_{v}": (F.col(f"inner_{v}") + F.col(f"before_{v}")).cast(_WIDE) for v in values}).drop(up, *[f"inner_{v}" for v in values])


def _hashed(turns: DataFrame) -> DataFrame:
    """Turns with ``known`` (whether they have a number) and two hashes of role and text."""
    content = [F.col("role").isNull(), F.col("text").isNull(), "role", "text"]
    return turns.where("conv_id is not null").select(
        "conv_id", F.col("turn").isNotNull().cast("int").alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.xxhash64(*content).alias("ha"), F.xxhash64(F.lit(3), *content).alias("hb"), "role", "text",
    )


def _ranks(several: DataFrame) -> DataFrame:
    """(key, rank) of rows of turn numbers that different rows share."""
    group = ["conv_id", "known", "turn"]
    order = [F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = several.repartitionByRange(*group, *order).withColumn("range", F.spark_partition_id())
    dealt = stage(dealt, "ranges")  # the number of a range must not change
    sizes = dealt.groupBy(*group, "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.select(*group, "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy(*group, "range").orderBy(*order)
    return dealt.withColumn("rank", F.row_number().over(own)).join(sizes, [*group, "range"]).select(*_KEY, (F.col("base") + F.col("rank")).alias("rank"))


def snapshots(turns: DataFrame, chunk: int = 256) -> DataFrame:
    """(conv_id, known, turn, ha, hb, position, n_turns, a, b): turns by their
    hashes, with their position and the two rolling hashes up to there."""
    hashed = _hashed(turns)
    rows = stage(hashed.select(*_KEY).distinct(), "turns")
    group = ["conv_id", "known", "turn"]
    counts = stage(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), "counts")
    # turn numbers that several rows share
    shared = stage(counts.where("n > 1").select(*group), "shared")
    if shared.count():
        several = hashed.join(shared, group, "left_semi").dropDuplicates(_KEY)
        rank = F.coalesce("rank", F.lit(1).cast("long"))
        rows = rows.join(_ranks(several), _KEY, "left").withColumn("rank", rank)
    else:
        rows = rows.withColumn("rank", F.lit(1).cast("long"))
    # turn numbers may be any; dense places would need a sort, so sums go by number
    place = counts.withColumn("place", F.when(F.col("known") == 1, F.col("turn")).otherwise(F.lit(-(1 << 62)))).withColumn("n", F.col("n").cast(_WIDE))
    place = _before(place, "place", ["n"], chunk)
    whole = counts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))
    place = stage(place.join(whole, "conv_id").select(*group, F.col("before_n").cast("long").alias("base"), "n_turns"), "places")
    placed = spread_join(rows.withColumn("place", F.struct(*group)), place.select(F.struct(*group).alias("place"), "base", "n_turns"), "place").drop("place")
    placed = placed.withColumn("position", F.col("base") + F.col("rank")).drop("base", "rank")
    known = ["position", "ha", "hb"]
    placed = placed.withColumns({"a": F.xxhash64(*known).cast(_WIDE), "b": F.xxhash64(F.lit(5), *known).cast(_WIDE)})
    placed = _before(stage(placed, "placed"), "position", ["a", "b"], chunk)
    return placed.select(*_KEY, "position", "n_turns", *[(F.col(h) + F.col(f"before_{h}")).cast(_WIDE).alias(h) for h in ("a", "b")])


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id of every conversation that is kept, and how many equal it."""
    inner = placed.where("position < n_turns").select("position", "a", "b").distinct()
    full = placed.where("position = n_turns").groupBy("position", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    return full.join(inner, ["position", "a", "b"], "left_anti").select("conv_id", "copies")


def rendered(role: Column, text: Column, start: str, end: str) -> Column:
    return F.concat(F.lit(start), role, F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(end), F.lit("\n"))


def collapse(
    turns: DataFrame,
    start: str = "<|im_start|>",
    end: str = "<|im_end|>",
    chunk: int = 256,
) -> DataFrame:
    """Rendered turns of the maximal conversations, one row per turn."""
    placed = stage(snapshots(turns, chunk), "snapshots")
    kept = stage(maximal(placed), "kept")
    named = spread_join(placed.select(*_KEY, "position", "n_turns"), kept, "conv_id")
    # each text once, to where its hashes are
    texts = _hashed(turns).groupBy(*_KEY).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    role = F.coalesce("role", F.lit("unknown"))
    return named.join(texts, _KEY).select(
        "conv_id", "position", "n_turns", "copies", role.alias("role"), rendered(role, F.col("text"), start, end).alias("rendered"), (role == "assistant").alias("bears_loss")
    )
