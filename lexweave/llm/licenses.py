"""Licence notices by Dice coefficient over word bigrams (operator 5).

Whole texts and each of their sentences are normalised (A-Z folded, runs of
anything but a-z and 0-9 become one space) and compared with normalised
templates: Dice = 2 |A & B| / (|A| + |B|) over distinct word bigrams.  A value
of at least t bounds the sizes, t/(2-t) <= |A|/|B| <= (2-t)/t, so templates are
listed under every size they can match and joined by size; only these pairs
are compared.

The same bound says how many of a template's bigrams a match may miss.  Of any
larger choice of its bigrams one must occur, so passages that hold the longer
word of none of the chosen bigrams are dropped unread, without loss.  A
whole text is dropped as soon as its beginning alone has too many bigrams.

A notice that is wrapped over lines or has several sentences is a run of
consecutive pieces of a longer text.  Runs of two pieces or more with at most
(2-t)/t times the template's bigrams (repeats counted) that begin and end with
pieces holding words of one of its bigrams are compared too.  Of overlapping
runs the best is reported, then the one of fewer pieces, then the first; none
over a sentence, or in a whole text of that size, that matches the same licence
by itself.

Everything is DataFrame functions; templates are counted and broadcast only
within ``broadcast_rows`` rows of that listing.  A text meets the templates of
which it holds enough bigrams by looking these up, or beyond that bound by a
join on bigrams; texts and templates are never crossed.

Defined cases: null, empty and one-word texts match nothing; of several
templates that match one passage the largest coefficient wins, then the least
name; repeated documents are reported once; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTENCE_END = "[\\n\\r]+|[.!?]+[ \\t]+"

#: Common one-sentence notices and short licence texts, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.",
    ),
]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def bigrams(words: Column) -> Column:
    """Distinct pairs of consecutive words of an array, as 64-bit hashes."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    first, second = F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n)
    return F.array_distinct(F.zip_with(first, second, lambda a, b: F.xxhash64(a, b)))


def necessary(known: DataFrame, least: float, most: int) -> list[str] | None:
    """Words of which a matching passage holds one; None if they are many.

    A match shares at least ``ceil(n * least / (2 - least))`` of a template's n
    bigrams, so it holds one of any n + 1 less that many, and that one's longer
    word.
    """
    held: set[str] = set()
    for r in known.select("words", "n_of").toLocalIterator():  # templates: a bounded table
        miss = r["n_of"] - math.ceil(r["n_of"] * least / (2 - least) - 1e-9)
        own = sorted({max(p, key=lambda w: (len(w), w)) + " " + " ".join(p) for p in zip(r["words"], r["words"][1:])}, key=lambda p: (-len(p.split()[0]), p))
        held.update(p.split()[0] for p in own[: miss + 1])
        if len(held) > most:
            return None
    # a word that contains another is covered by it
    return sorted(w for w in held if not any(v != w and v in w for v in held))


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(templates, "license string, body string")


def near_few(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with every template of which they hold at least ``low`` bigrams, for
    a bounded number of templates: their bigrams are looked up within the row."""
    of: dict[int, list[int]] = {}
    lows = []
    ranked = known.orderBy("license", "of").select("license", "of", "n_of", "low", "high").collect()  # within most_listed bigrams
    for t, r in enumerate(ranked):
        lows.append(r["low"])
        for h in r["of"]:
            of.setdefault(h, []).append(t)
    listed = F.array(*map(F.lit, sorted(of))).cast("array<bigint>")
    where = F.map_from_arrays(listed, F.array(*[F.array(*map(F.lit, of[h])) for h in sorted(of)]))
    own = bigrams(F.split(normalised(F.col("text")), " "))
    held = rows.select("doc_id", "text", F.explode(F.array(F.array_intersect(own, listed))).alias("own")).where("size(own) > 0")
    held = held.select("doc_id", "text", F.explode(F.array(F.flatten(F.transform("own", lambda h: F.element_at(where, h))))).alias("at"))
    enough = F.filter(F.array_distinct("at"), lambda t: F.size(F.filter("at", lambda u: u == t)) >= F.element_at(F.array(*map(F.lit, lows)), t + 1))
    numbered = rows.sparkSession.createDataFrame([(t, *r) for t, r in enumerate(ranked)], "t int, license string, of array<bigint>, n_of int, low int, high int")
    return held.select("doc_id", "text", F.explode(enough).alias("t")).join(F.broadcast(numbered), "t").drop("t")


def near_many(rows: DataFrame, known: DataFrame, few: bool) -> DataFrame:
    """The same for any number of templates: a join on bigrams without texts.
    ``few`` templates are broadcast."""
    keyed = rows.withColumn("key", F.struct("doc_id", F.sha2("text", 256)))
    own = bigrams(F.split(normalised(F.col("text")), " "))
    thin = keyed.select("key", F.explode(own).alias("pair"))
    listed = known.select("license", "of", "low", F.explode("of").alias("pair")).distinct()
    met = thin.join(F.broadcast(listed) if few else listed, "pair")
    # rows may repeat
    met = met.groupBy("key", "license", "of", "low").agg(F.count_distinct("pair").alias("n")).where("n >= low").drop("low", "n")
    texts = keyed.distinct()
    near = texts.join(met, texts["key"].eqNullSafe(met["key"])).select("doc_id", "text", "license", "of")
    return near.join(F.broadcast(known) if few else known, ["license", "of"])


def runs(near: DataFrame, least: float) -> DataFrame:
    """(doc_id, start, passage, license, dice) of runs of pieces.  ``near`` has
    texts with templates of which they hold enough bigrams (license, of, n_of,
    low, high); only these are cut in pieces."""
    pieces = F.transform(F.split("text", SENTENCE_END), lambda p: F.filter(F.split(normalised(p), " "), lambda w: w != ""))
    near = near.select("*", F.explode(F.array(pieces)).alias("pieces"))
    numbers = F.flatten(F.transform("pieces", lambda p, i: F.transform(p, lambda _: i)))
    near = near.select("*", F.explode(F.array(F.flatten("pieces"))).alias("words"), numbers.alias("piece")).drop("pieces")
    n = F.size("words") - 1
    hashes = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    near = near.select("*", F.explode(F.array(hashes)).alias("pairs")).drop("words")
    # positions of the template's bigrams, from 1
    hits = F.filter(F.sequence(F.lit(1), F.size("pairs")), lambda k: F.array_contains("of", F.element_at("pairs", k)))
    near = near.select("*", F.explode(F.array(hits)).alias("hits"))
    # a run's first hit has enough others within the largest size
    dense = F.filter("hits", lambda k, q: F.get("hits", q + F.col("low") - 1) - k < F.col("high"))
    near = near.select("*", F.explode(F.array_distinct(F.transform(dense, lambda k: F.element_at("piece", k)))).alias("start"))
    near = near.withColumn("first", F.array_position("piece", F.col("start")).cast("int"))
    inside = F.filter("hits", lambda k: (k >= F.col("first")) & (k < F.col("first") + F.col("high")))
    near = near.select("*", F.explode(F.array_distinct(F.transform(inside, lambda k: F.element_at("piece", k + 1)))).alias("stop"))
    near = near.withColumn("n_pairs", (F.size("piece") - F.array_position(F.reverse("piece"), F.col("stop")) + 1).cast("int") - F.col("first"))
    near = near.where(F.col("n_pairs").between(F.col("low"), F.col("high")))
    near = near.select("*", F.explode(F.array(F.array_distinct(F.slice("pairs", F.col("first"), F.col("n_pairs"))))).alias("own"))
    near = near.withColumn("dice", 2.0 * F.size(F.array_intersect("own", "of")) / (F.size("own") + F.col("n_of"))).where(F.col("dice") >= least - 1e-12)
    # 0 and 1: the whole text and single pieces, which are units of their own
    alone = (F.col("start") == F.element_at("piece", 1)) & (F.col("stop") == F.element_at("piece", -1))
    near = near.withColumn("kind", F.when(alone, 0).when(F.col("start") == F.col("stop"), 1).otherwise(2))
    best = near.groupBy("doc_id", "text", "kind", "start", "stop").agg(F.min(F.struct((-F.col("dice")).alias("less"), "license")).alias("best"))
    order = F.struct("kind", "best.less", (F.col("stop") - F.col("start")).alias("more"), "start", "stop", "best.license")
    listed = best.groupBy("doc_id", "text").agg(F.array_sort(F.collect_list(order)).alias("spans"))

    def taken(kept: Column, x: Column) -> Column:
        return F.exists(kept, lambda y: (y["start"] <= x["stop"]) & (y["stop"] >= x["start"]) & ((y["kind"] == 2) | (y["license"] == x["license"])))

    kept = F.aggregate("spans", F.slice("spans", 1, 0), lambda kept, x: F.when(taken(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    out = listed.select("doc_id", "text", F.explode(kept).alias("x")).where("x.kind = 2")
    passage = F.array_join(F.slice(F.split("text", SENTENCE_END), F.col("x.start") + 1, F.col("x.more") + 1), "\n")
    return out.select("doc_id", F.col("x.start").alias("start"), passage.alias("passage"), F.col("x.license").alias("license"), (-F.col("x.less")).alias("dice"))


def scan(
    docs: DataFrame,
    templates: DataFrame,
    least: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_rows: int = 200_000,
    most_tests: int = 60,
    most_listed: int = 4096,
) -> DataFrame:
    """(doc_id, unit, start, passage, license, dice) of every passage that
    matches; ``start`` numbers the sentences of a text from 0, and is -1 for
    the whole text.  A run has the number of its first piece, and its pieces
    joined by line feeds.  ``templates`` has columns license and body."""
    known = templates.dropna().select("license", F.split(normalised(F.col("body")), " ").alias("words")).distinct()
    known = known.select("license", "words", bigrams(F.col("words")).alias("of"))
    known = known.withColumn("n_of", F.size("of")).where("n_of > 0")
    low, high = F.ceil(F.col("n_of") * (least / (2 - least)) - 1e-9), F.floor(F.col("n_of") * ((2 - least) / least) + 1e-9)
    sized = known.withColumn("n", F.explode(F.sequence(F.greatest(low, F.lit(1).cast("long")), high))).withColumn("n", F.col("n").cast("int"))
    bound = sized.agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first()
    if not bound[2]:
        return docs.sparkSession.createDataFrame([], "doc_id long, unit string, start int, passage string, license string, dice double")
    sized = sized.select("license", "of", "n_of", "n")
    few = bound[2] <= broadcast_rows
    sized = F.broadcast(sized) if few else sized
    needed = necessary(known, least, most_tests) if few else None

    def may_match(folded: Column) -> Column:
        return F.lit(True) if needed is None else reduce(lambda x, y: x | y, [F.contains(folded, F.lit(w)) for w in needed])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    folded = F.transform(F.split("text", SENTENCE_END), lambda p: F.struct(p.alias("passage"), F.lower(p).alias("folded")))
    sentences = rows.select("doc_id", F.posexplode(folded).alias("start", "x"))
    # bytes bound the words: a passage with n+1 words has 2n+1 characters or more
    sentences = sentences.where((F.length("x.passage") > 2 * bound[0]) & may_match(F.col("x.folded"))).select("doc_id", "start", "x.passage")
    # a text's beginning, without the word that may be cut, has no more bigrams than the text
    head = F.split(normalised(F.substring("text", 1, 12 * (bound[1] + 8))), " ")
    begun = rows.select("doc_id", "text", F.explode(F.array(head)).alias("head"))
    begun = begun.select("doc_id", "text", F.explode(F.array(F.slice("head", F.lit(1), F.greatest(F.size("head") - 1, F.lit(0))))).alias("head"))
    whole = begun.where(F.size(bigrams(F.col("head"))) <= bound[1]).select("doc_id", F.lit(-1).alias("start"), F.col("text").alias("passage"))
    # explode(array(x)) keeps x from being computed again inside later filters
    words = sentences.union(whole).select("doc_id", "start", "passage", F.explode(F.array(F.split(normalised(F.col("passage")), " "))).alias("words"))
    own = words.select("doc_id", "start", "passage", F.explode(F.array(bigrams(F.col("words")))).alias("own"))
    own = own.withColumn("n", F.size("own")).where(F.col("n").between(bound[0], bound[1]))
    pairs = own.join(sized, "n")
    both = F.size(F.array_intersect("own", "of"))
    found = pairs.withColumn("dice", 2.0 * both / (F.col("n") + F.col("n_of"))).where(F.col("dice") >= least - 1e-12)
    best = found.groupBy("doc_id", "start", "passage").agg(F.min(F.struct((-F.col("dice")).alias("less"), "license")).alias("best"))
    single = best.select(
        "doc_id",
        F.when(F.col("start") < 0, "text").otherwise("sentence").alias("unit"),
        "start",
        "passage",
        F.col("best.license").alias("license"),
        (-F.col("best.less")).alias("dice"),
    )
    ranged = known.select("license", "of", "n_of", low.cast("int").alias("low"), high.cast("int").alias("high"))
    candidates = rows.where(may_match(F.lower("text")))
    listed = known.agg(F.sum("n_of")).first()[0] <= most_listed
    wrapped = runs(near_few(candidates, ranged) if few and listed else near_many(candidates, ranged, few), least)
    return single.union(wrapped.select("doc_id", F.lit("run").alias("unit"), "start", "passage", "license", "dice"))
