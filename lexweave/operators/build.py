"""Lookup tables from entries: frequency, buckets, equivalents, reverse lists.

``entries`` rows carry ``priority`` (of the entry, else of its dictionary),
``dict`` and ``seq``; their order (priority, dict, seq) is what "first" means.
Row order is never relied on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EQUIVALENT_FIELDS

ORDER = ("priority", "dict", "seq")


def visible(dicts: DataFrame) -> DataFrame:
    """Dictionaries that are searched."""
    return dicts.where(~F.coalesce("exclude_from_search", F.lit(False)))


def with_dict(entries: DataFrame, dicts: DataFrame, *columns: str) -> DataFrame:
    """Entries of the given dictionaries with some of their columns.  The
    registry has one row per dictionary, so Spark may broadcast it by size."""
    side = dicts.select(F.col("slug").alias("dict"), *columns)
    return entries.join(side, "dict")


def with_priority(entries: DataFrame, dicts: DataFrame) -> DataFrame:
    """Entries with their own priority, else their dictionary's."""
    side = dicts.select(F.col("slug").alias("dict"), F.col("priority").alias("__priority"))
    return entries.join(side, "dict").withColumn("priority", F.coalesce("priority", "__priority")).drop("__priority")


def frequency(entries: DataFrame) -> DataFrame:
    """(norm, score): hundredths summed as integers, one weight per entry."""
    weight = F.greatest(F.lit(1), 100 - F.col("priority")).cast("long")
    return entries.where("headword_norm <> ''").groupBy(F.col("headword_norm").alias("norm")).agg(F.sum(weight).alias("centi")).select("norm", "centi")


def top_n(scores: DataFrame, n: int) -> DataFrame:
    """(rank, norm, score) of the n best; ties by norm."""
    best = scores.orderBy(F.col("centi").desc(), "norm").limit(n)
    order = Window.orderBy(F.col("centi").desc(), "norm")  # over n rows
    return best.select(F.row_number().over(order).cast("long").alias("rank"), "norm", (F.col("centi") / 100).alias("score"))


def first_by(value: str) -> Column:
    return F.min_by(value, F.struct(*ORDER))


def spellings(entries: DataFrame) -> DataFrame:
    """(norm, iast): the first spelling of each key, both non-empty."""
    return entries.where("headword_norm <> '' and headword_iast <> ''").groupBy(F.col("headword_norm").alias("norm")).agg(first_by("headword_iast").alias("iast"))


def bucket_rows(entries: DataFrame, top: DataFrame, translations: DataFrame, snippet: int = 350, ko: int = 2000) -> DataFrame:
    """Tier-0, one row for each entry of a top headword: its rank, first spelling
    and ``place`` by (priority, dict), ties in file order.

    ``top`` has (rank, norm): at most n rows, so the join's side is small by
    construction.  Rows stay long, so a headword may have any number of entries.
    """
    hits = entries.join(top.select(F.col("norm").alias("headword_norm"), "rank"), "headword_norm")
    first = hits.groupBy("headword_norm").agg(F.min_by(F.coalesce("headword_iast", "headword"), F.struct(*ORDER)).alias("iast"))  # n rows at most
    hits = hits.join(translations.withColumnRenamed("ko", "translated").withColumnRenamed("entry_id", "id"), "id", "left").drop("iast").join(first, "headword_norm")
    text = F.coalesce(F.expr("nullif(trim(ko), '')"), F.col("translated"), F.lit(""))
    rows = hits.select(
        "rank",
        F.col("headword_norm").alias("norm"),
        "iast",
        "priority",
        "dict",
        "seq",
        F.coalesce(F.expr("nullif(short_name, '')"), F.col("dict")).alias("short"),
        "tier",
        "id",
        "snippet_short",
        F.substring("snippet_medium", 1, snippet).alias("snippet_medium"),
        F.substring(text, 1, ko).alias("ko"),
        F.coalesce(F.expr("nullif(target_lang, '')"), F.expr("nullif(lang, '')"), F.lit("en")).alias("target_lang"),
    )
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("norm").orderBy(*ORDER)).cast("long"))


def clean_zh(zh: Column) -> Column:
    """zh only where it holds a CJK code point."""
    return F.when(zh.rlike("[　-〿㐀-䶿一-鿿豈-﫿]"), zh)


def equivalents(rows: DataFrame, check_zh: bool = True) -> DataFrame:
    """Cross-source rows folded by (skt, tib, zh).

    The winner of a key has the most characters over all nine fields, the
    earliest of equals; ``sources`` are the distinct slugs in order of first
    appearance.  Nothing is merged between rows.  ``rows`` has the nine fields,
    ``slug`` and ``ord``.
    """
    kept = rows.withColumns({c: F.expr(f"nullif({c}, '')") for c in EQUIVALENT_FIELDS})
    if check_zh:
        kept = kept.withColumn("zh", clean_zh(F.col("zh")))
    kept = kept.where("coalesce(skt_iast, tib_wylie, zh) is not null")
    score = sum((F.coalesce(F.length(c), F.lit(0)) for c in EQUIVALENT_FIELDS), F.lit(0))
    key = [
        F.lower(F.trim(F.coalesce("skt_iast", F.lit("")))).alias("k_skt"),
        F.lower(F.trim(F.coalesce("tib_wylie", F.lit("")))).alias("k_tib"),
        F.trim(F.coalesce("zh", F.lit(""))).alias("k_zh"),
    ]
    # sources: the first place of each slug, so at most one item per source
    places = kept.select(*key, "slug", "ord", F.struct(score.alias("score"), (-F.col("ord")).alias("less")).alias("info"), F.struct(*EQUIVALENT_FIELDS).alias("row"))
    per_slug = places.groupBy("k_skt", "k_tib", "k_zh", "slug").agg(F.min("ord").alias("ord"), F.max("info").alias("info"), F.max_by("row", "info").alias("row"))
    folded = per_slug.groupBy("k_skt", "k_tib", "k_zh").agg(
        F.max_by("row", "info").alias("row"),
        F.min("ord").alias("ord"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "slug"))), lambda x: x["slug"]).alias("sources"),
    )
    return folded.select(F.col("ord").alias("row_id"), "row.*", "sources")


def equivalent_keys(rows: DataFrame, norm: Column, distinct: bool = True) -> DataFrame:
    """(key, channel, row_id): a row under each of its one to three keys.

    ``norm`` turns column ``value`` into a key.  With ``distinct`` a row is
    under a key once, though two channels may agree on it.
    """
    channels = [("skt", "skt_iast"), ("tib", "tib_wylie"), ("zh", "zh")]
    long = rows.select("row_id", F.explode(F.array(*[F.struct(F.lit(a).alias("channel"), F.col(c).alias("value")) for a, c in channels])).alias("x")).select("row_id", "x.*")
    long = long.where("value is not null")
    key = F.when(F.col("channel") == "zh", F.trim("value")).otherwise(norm)
    keys = long.select(key.alias("key"), "channel", "row_id").where("key <> ''")
    return keys.groupBy("key", "row_id").agg(F.min("channel").alias("channel")).select("key", "channel", "row_id") if distinct else keys


def reverse_lists(tokens: DataFrame, k: int = 100, least: int = 3) -> DataFrame:
    """(token, rank, id) of each token's k best entries.

    ``tokens`` has (token, pos, priority, headword, id), ``pos`` from 0.  Order:
    salience max(0, 5 - pos) down, priority up, headword length up, id down.
    Tokens with fewer than ``least`` entries go.  The top-k limit runs before
    the shuffle, so a frequent token sends at most k rows from each task.
    """
    ranked = tokens.select(
        "token",
        F.greatest(F.lit(0), 5 - F.col("pos")).alias("salience"),
        "priority",
        F.length("headword").alias("hw_len"),
        "id",
    )
    order = Window.partitionBy("token").orderBy(F.col("salience").desc(), "priority", "hw_len", F.col("id").desc())
    best = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    size = F.count(F.lit(1)).over(Window.partitionBy("token"))
    return best.withColumn("size", size).where(F.col("size") >= least).select("token", F.col("rank").cast("long").alias("rank"), "id")


def reverse_meta(lists: DataFrame, entries: DataFrame, shown: int = 30) -> DataFrame:
    """(id, iast, dict) of the entries that any list shows."""
    ids = lists.where(F.col("rank") <= shown).select("id").distinct()
    iast = F.coalesce(F.expr("nullif(headword_iast, '')"), F.expr("nullif(headword, '')"), F.lit("?"))
    return entries.join(ids, "id", "left_semi").select("id", iast.alias("iast"), "dict")


def declensions(entries: DataFrame, top: DataFrame) -> DataFrame:
    """(norm, iast, body, dict): the first body per (norm, dict, iast)."""
    rows = entries.where("headword_norm <> '' and coalesce(plain, '') <> ''")
    rows = rows.join(top.select(F.col("norm").alias("headword_norm")), "headword_norm", "left_semi")
    return rows.groupBy(F.col("headword_norm").alias("norm"), F.col("headword_iast").alias("iast"), "dict").agg(first_by("plain").alias("body")).select("norm", "iast", "body", "dict")


def translation_candidates(entries: DataFrame, least: int = 10, cap: int = 4000) -> DataFrame:
    """(norm, id, text): per key the first entry with a long enough body, unless
    that one has a translation already, which settles the key."""
    rows = entries.where(F.length(F.trim("plain")) >= least)
    first = rows.groupBy(F.col("headword_norm").alias("norm")).agg(F.min_by(F.struct("id", "plain", "ko"), F.struct(*ORDER)).alias("first"))
    return first.where("coalesce(trim(first.ko), '') = ''").select("norm", "first.id", F.substring("first.plain", 1, cap).alias("text"))


def untranslated(entries: DataFrame, done: DataFrame, keys: DataFrame, least: int = 10, cap: int = 4000) -> DataFrame:
    """As above, for some keys; entries that are done do not settle theirs."""
    rows = entries.join(keys.select(F.col("norm").alias("headword_norm")), "headword_norm", "left_semi")
    return translation_candidates(rows.join(done.select(F.col("entry_id").alias("id")), "id", "left_anti"), least, cap)


def merged(rows: DataFrame) -> DataFrame:
    """Rows of merged dictionaries: of a (slug, norm) the one of the canonical
    source, then of the least id."""
    first = Window.partitionBy("slug", "norm").orderBy("src_rank", "raw_id")
    return rows.withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row")


def cost(rows: DataFrame, text: str, per_million: float, chars_per_token: float = 3.5) -> DataFrame:
    """Linear estimate: requests, characters, tokens, price."""
    chars = F.coalesce(F.sum(F.length(text)), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("requests"), chars.alias("chars"), (chars / chars_per_token).alias("tokens"), (chars / chars_per_token * per_million / 1e6).alias("price"))
