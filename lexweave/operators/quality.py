"""Data quality: validation, coverage, reconciliation, overlap, precision."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.script import is_valid_iast, is_valid_wylie
from ..schema import REQUIRED_DICT, REQUIRED_ENTRY


# --- entries ------------------------------------------------------------------
def entry_errors() -> Column:
    """Names of the schema rules an entry breaks."""
    rules = {f"missing {c}": F.coalesce(F.col(c), F.lit("")) == "" for c in REQUIRED_ENTRY}
    rules |= {
        "missing body.plain": F.col("body.plain").isNull(),
        "id form": ~F.coalesce(F.col("id").rlike("^[a-z0-9][a-z0-9-]*-\\d+$"), F.lit(False)),
        "tier range": ~F.col("tier").between(1, 3),
        "priority range": ~F.col("priority").between(1, 100),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))


def entry_warnings(exempt: Column | None = None, token: str = "^[a-z]{2,}$") -> Column:
    """Names of the soft rules an entry breaks; ``exempt`` rows skip the
    spelling check."""
    spelled = F.when(F.col("lang") == "bo", is_valid_wylie(F.col("headword_iast"))).when(F.col("lang").isin("skt", "pi"), is_valid_iast(F.col("headword_iast"))).otherwise(True)
    if exempt is not None:
        spelled = spelled | exempt
    rules = {
        "spelling": ~spelled,
        "empty body": F.trim(F.coalesce("body.plain", F.lit(""))) == "",
        "token": F.exists(F.coalesce("reverse.en", F.array().cast("array<string>")), lambda t: ~t.rlike(token)),
        "snippet length": (F.length("body.snippet_short") > 180) | (F.length("body.snippet_medium") > 500),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))


def verify(entries: DataFrame, exempt: Column | None = None) -> DataFrame:
    """(dict, entries, errors, warnings), worst first."""
    rows = entries.select("dict", entry_errors().alias("e"), entry_warnings(exempt).alias("w"))
    out = rows.groupBy("dict").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.size("e") > 0).alias("errors"), F.sum(F.size("w")).alias("warnings"))
    return out.orderBy((F.col("errors") * 100 + F.col("warnings")).desc(), "dict")


def warning_counts(entries: DataFrame, group: str, warnings: Column) -> DataFrame:
    """(group, category, n)."""
    return entries.select(group, F.explode(warnings).alias("category")).groupBy(group, "category").agg(F.count(F.lit(1)).alias("n"))


def first_samples(rows: DataFrame, group: str, order: str, n: int = 5) -> DataFrame:
    """The first n rows of each group."""
    place = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("place", F.row_number().over(place).cast("long")).where(F.col("place") <= n)


def duplicate_ids(entries: DataFrame) -> DataFrame:
    return entries.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# --- registry -----------------------------------------------------------------
def registry_errors(dicts: DataFrame) -> DataFrame:
    """(slug, problem): repeated or missing values, ranges, exclusion shape."""
    count = F.count(F.lit(1)).over(Window.partitionBy("slug"))
    tests = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"missing {c}")) for c in REQUIRED_DICT]
    tests += [
        F.when(F.col("n_slug") > 1, F.lit("slug repeated")),
        F.when(~F.col("priority").between(1, 100), F.lit("priority range")),
        F.when(~F.col("tier").between(1, 3), F.lit("tier range")),
        F.when(
            F.coalesce("exclude_from_search", F.lit(False)) & ((F.coalesce("used_by", F.lit("")) == "") == (F.coalesce("superseded_by", F.lit("")) == "")),
            F.lit("excluded without one reason"),
        ),
    ]
    rows = dicts.withColumn("n_slug", count)
    return rows.select("slug", F.explode(F.array_compact(F.array(*tests))).alias("problem")).distinct()


def reconcile(dicts: DataFrame, actual: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Declared against counted rows; ``deviates`` beyond the tolerance."""
    rows = dicts.join(actual, "slug", "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))
    off = F.abs(F.col("actual") - F.col("expected")) / F.expr("nullif(expected, 0)")
    return rows.select("slug", "expected", "actual", F.coalesce(off > tolerance, F.lit(False)).alias("deviates"))


def language_check(entries: DataFrame, dicts: DataFrame) -> DataFrame:
    """(slug, lang, seen, ok, mixed): languages of entries against the declared."""
    seen = entries.groupBy(F.col("dict").alias("slug")).agg(F.array_sort(F.collect_set("lang")).alias("seen"))
    return dicts.select("slug", "lang").join(seen, "slug", "left").select("slug", "lang", "seen", F.coalesce(F.array_contains("seen", F.col("lang")), F.lit(False)).alias("ok"), (F.size("seen") > 1).alias("mixed"))


def band(priority: Column, from_one: bool = False) -> Column:
    """Decade of a priority, from 0-9 or from 1-10."""
    return F.floor((priority - (1 if from_one else 0)) / 10)


# --- coverage -----------------------------------------------------------------
def coverage(rows: DataFrame, group: str, done: Column) -> DataFrame:
    """(group, total, done, ratio)."""
    total, have = F.count(F.lit(1)), F.count_if(done)
    return rows.groupBy(group).agg(total.alias("total"), have.alias("done"), (have / F.nullif(total, F.lit(0))).alias("ratio"))


def incomplete(covered: DataFrame, below: float = 0.95) -> DataFrame:
    """Groups that still need work."""
    return covered.where(F.col("ratio") < below)


def orphans(translations: DataFrame, entries: DataFrame) -> DataFrame:
    """Translations of entries that are not there."""
    return translations.join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_anti")


def long_tail(entries: DataFrame, top: DataFrame) -> DataFrame:
    """Keys, keys in the top list, entries and entries under those keys."""
    per_key = entries.groupBy(F.col("headword_norm").alias("norm")).agg(F.count(F.lit(1)).alias("n"))
    flagged = per_key.join(top.select("norm", F.lit(1).alias("hit")), "norm", "left")
    return flagged.agg(F.count(F.lit(1)).alias("keys"), F.count("hit").alias("top_keys"), F.sum("n").alias("entries"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("top_entries"))


def excluded_leaks(index: DataFrame, dicts: DataFrame) -> DataFrame:
    """Index rows of dictionaries that should not be searched."""
    hidden = dicts.where("exclude_from_search").select(F.col("slug").alias("dict"))
    return index.join(hidden, "dict", "left_semi").groupBy("dict").agg(F.count(F.lit(1)).alias("leaks"))


def content_class(text: Column, cjk: str = "[一-鿿豈-﫿]") -> Column:
    """cjk, mixed, latin or other; ``cjk`` says which characters make the first two."""
    han, latin = text.rlike(cjk), text.rlike("[A-Za-z]")
    return F.when(latin, F.when(han, "mixed").otherwise("latin")).when(han, "cjk").otherwise("other")


def graded(rows: DataFrame, source: Column, target: Column, leaks: Column) -> DataFrame:
    """A-D by share of target letters, leaked function words, length ratio and
    kept numbering."""
    size = F.nullif(F.length(target), F.lit(0))
    letters = F.length(F.regexp_replace(target, "(?U)[^\\p{L}]", "")) / size
    ratio = F.length(target) / F.nullif(F.length(source), F.lit(0))
    leak = leaks / size
    kept = F.regexp_count(target, F.lit("[0-9]+")) >= F.regexp_count(source, F.lit("[0-9]+"))
    rows = rows.withColumns({"letters": letters, "ratio": ratio, "leak": leak, "kept": kept})
    points = F.when(letters >= 0.7, 1).otherwise(0) + F.when(F.col("ratio").between(0.3, 3.0), 1).otherwise(0) + F.when(leak <= 0.01, 1).otherwise(0) + F.when(kept, 1).otherwise(0)
    return rows.withColumn("grade", F.when(points == 4, "A").when(points == 3, "B").when(points == 2, "C").otherwise("D"))


def grade_score(rows: DataFrame) -> DataFrame:
    """(n, score): (4A + 3B + 2C + 1D) / N."""
    value = F.element_at(F.create_map(*[F.lit(x) for p in (("A", 4), ("B", 3), ("C", 2), ("D", 1)) for x in p]), F.col("grade"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("score"))


def stratified(rows: DataFrame, group: str, order: Column, total: int) -> DataFrame:
    """About ``total`` rows, from each group in proportion, by a fixed order."""
    n = F.count(F.lit(1))
    sizes = rows.groupBy(group).agg(n.alias("__n"))
    share = sizes.withColumn("__take", F.greatest(F.lit(1), F.round(F.lit(total) * F.col("__n") / F.sum("__n").over(Window.partitionBy()))))
    place = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("__row", F.row_number().over(place)).join(share.select(group, "__take"), group).where("__row <= __take").drop("__row", "__take")


# --- overlap ------------------------------------------------------------------
def overlaps(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, both, jaccard) of named pairs of key sets.

    ``members`` has (name, key); only the keys of named sets are joined."""
    sets = members.distinct()
    sizes = sets.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    left = pairs.join(sets.withColumnRenamed("name", "a"), "a")
    both = left.join(sets.withColumnRenamed("name", "b"), ["b", "key"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    rows = pairs.join(sizes.select(F.col("name").alias("a"), F.col("n").alias("n_a")), "a", "left").join(sizes.select(F.col("name").alias("b"), F.col("n").alias("n_b")), "b", "left")
    rows = rows.join(both, ["a", "b"], "left").fillna(0, ["n_a", "n_b", "both"])
    union = F.nullif(F.col("n_a") + F.col("n_b") - F.col("both"), F.lit(0))
    return rows.select("a", "b", "n_a", "n_b", "both", F.coalesce(F.col("both") / union, F.lit(0.0)).alias("jaccard"))


def verdict(jaccard: Column, similarity: Column) -> Column:
    """Whether two dictionaries duplicate each other, by keys and bodies."""
    return F.when((jaccard >= 0.9) & (similarity >= 0.8), "STRICT_DUPLICATE").when(jaccard >= 0.5, "PARTIAL_DUPLICATE").otherwise("DIFFERENT")


def body_similarity(a: Column, b: Column, most: int = 2000) -> Column:
    """Matching-blocks ratio of the first ``most`` characters of two bodies."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p.strip()[:most], q.strip()[:most]).ratio() for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def format_rank(source_format: Column, known: list[str]) -> Column:
    """Place of a format in a preference list; unknown ones come last."""
    return reduce(lambda acc, kv: acc.when(source_format == kv[1], kv[0]), enumerate(known), F).otherwise(len(known))


#: Endings of source names in order of preference; other names are as good as the first.
FORMATS = ["dict", "gretil", "sandic", "apple"]


def canonical(a: Column, b: Column, count_a: Column, count_b: Column) -> Column:
    """Which of two duplicate sources stays: better format, more entries, lesser name."""
    rank = lambda name: reduce(lambda acc, kv: acc.when(F.endswith(name, F.lit(kv[1])), kv[0]), enumerate(FORMATS), F).otherwise(0)
    ra, rb = rank(a), rank(b)
    first = F.when(ra != rb, ra < rb).when(count_a != count_b, count_a > count_b).otherwise(a <= b)
    return F.when(first, a).otherwise(b)


def hash_sample(rows: DataFrame, key: str, n: int = 20) -> DataFrame:
    """n rows that any run picks alike."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


# --- distributions --------------------------------------------------------------
def histogram(rows: DataFrame, bucket: Column, kept: Column) -> DataFrame:
    """(bucket, total, kept, dropped)."""
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


def conf_bucket(conf: Column) -> Column:
    """Confidence in tens, everything under 50 together."""
    low = (F.floor(conf / 10) * 10).cast("string")
    return F.when(conf < 50, "<50").otherwise(F.concat(low, F.lit("-"), (F.floor(conf / 10) * 10 + 9).cast("string")))


def length_bucket(n: Column) -> Column:
    """Headword lengths: one by one up to 8, then 9-12 and 13+."""
    return F.when(n <= 8, n.cast("string")).when(n <= 12, "9-12").otherwise("13+")


def drop_reason(conf: Column, n: Column, least: float = 60, longest: int = 8) -> Column:
    """Why the OCR filter drops a row; null keeps it."""
    low, long = F.coalesce(conf, F.lit(100.0)) < least, n > longest
    return F.when(low & long, "low_conf+long_hw").when(low, "low_conf").when(long, "long_hw")


def upper_median(rows: DataFrame, group: str, x: str) -> DataFrame:
    """(group, upper_median): element n // 2 of the sorted values, from 0.

    Equal values are counted before they are ordered, and nothing is collected."""
    counts = rows.where(F.col(x).isNotNull()).groupBy(group, x).agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(group)
    upto = F.sum("__n").over(own.orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.select(group, x, upto.alias("__upto"), F.sum("__n").over(own).alias("__all"))
    return placed.where(F.col("__upto") > F.floor(F.col("__all") / 2)).groupBy(group).agg(F.min(x).alias("upper_median"))


def summary(rows: DataFrame, group: str, x: str) -> DataFrame:
    """Mean, interpolated median and p95, least and largest."""
    return rows.groupBy(group).agg(
        F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.percentile(x, 0.95).alias("p95"), F.min(x).alias("least"), F.max(x).alias("largest")
    )


def precision_at(hits: DataFrame, seeds: DataFrame, strict: int = 5, loose: int = 20) -> DataFrame:
    """(query, strict, loose): whether a retrieved spelling contains the expected
    one among the first hits."""
    rows = seeds.join(hits, "query", "left")
    match = F.coalesce(F.contains(F.lower("retrieved"), F.lower("expected")), F.lit(False))
    return rows.groupBy("query").agg(F.bool_or(match & (F.col("rank") <= strict)).alias("strict"), F.bool_or(match & (F.col("rank") <= loose)).alias("loose"))


def source_combinations(rows: DataFrame) -> DataFrame:
    """(combination, n) of multi-source rows."""
    many = rows.where(F.size("sources") > 1)
    return many.groupBy(F.array_join(F.array_sort("sources"), " + ").alias("combination")).agg(F.count(F.lit(1)).alias("n"))


def interval_lookup(points: DataFrame, spans: DataFrame, group: str, at: str, width: int = 1 << 16) -> DataFrame:
    """Points with the half-open span [start, stop) of their group that holds
    them, or the group's last span.

    Spans are listed under each ``width``-wide cell they touch, so the join is
    on equal cells."""
    cells = spans.where("stop > start").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    p = points.withColumn("cell", F.floor(F.col(at) / width)).withColumnRenamed(at, "__at")
    last = spans.groupBy(group).agg(F.max_by("page", "start").alias("last"))
    inside = (F.col("start") <= F.col("__at")) & (F.col("__at") < F.col("stop"))
    s = cells.select(F.col(group).alias("__group"), F.col("cell").alias("__cell"), "start", "stop", "page")
    hit = p.join(s, (p[group] == s["__group"]) & (p["cell"] == s["__cell"]) & inside, "left").drop("__group", "__cell", "cell")
    return hit.join(last, group, "left").withColumn("page", F.coalesce("page", "last")).withColumnRenamed("__at", at).drop("last", "start", "stop")
