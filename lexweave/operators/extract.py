"""Raw rows to entries, and records from line streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gloss import en_tokens, ko_tokens
from ..functions.markup import strip_markup
from ..functions.script import detect_and_convert, has_hk_signature, let, normalize_headword, strip
from ..functions.snippets import senses, snippets


def clean_headword(raw: Column) -> Column:
    """Cut at the first newline, tab, return, ``{`` or ``<`` in turn, unless it
    stands at the very beginning; then strip."""
    head = raw
    for mark in ("\n", "\t", "\r", "{", "<"):
        at = F.instr(head, mark)
        head = F.when(at > 1, F.substring(head, F.lit(1), at - 1)).otherwise(head)
    return strip(head)


def numbered(rows: DataFrame, group: str, order: str, width: int = 65_536) -> DataFrame:
    """Adds ``seq`` 1.. within each group by a numeric column.

    Rows are counted within ranges of its values and offset by the ranges
    before, so that a group with a third of all rows is not one task's."""
    cut = rows.withColumn("__range", F.floor(F.col(order) / width))
    sizes = cut.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(group).alias("__group"), F.col("__range").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(group, "__range").orderBy(order))
    met = cut.withColumn("__row", own).join(sizes, F.col(group).eqNullSafe(F.col("__group")) & F.col("__range").eqNullSafe(F.col("__at")))
    return met.withColumn("seq", (F.col("__before") + F.col("__row")).cast("int")).drop("__range", "__row", "__group", "__at", "__before")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later expressions reuse.  A plain projection would be
    merged into them and computed again for each use; a generator is not."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def make_entries(rows: DataFrame, dicts: DataFrame) -> DataFrame:
    """Raw rows (slug, seq, raw_id, headword, body, body_ko) as entries.

    Rows without a headword go, but keep their number, so ids have gaps.
    """
    meta = dicts.select("slug", "lang", "tier", "priority", "license", "source_format", "sense_separator", "v1_name")
    r = rows.join(meta, "slug").withColumn("head", let(F.coalesce("headword", F.lit("")), clean_headword)).where("head <> ''")
    indic = F.col("lang").isin("skt", "pi")
    r = r.withColumn("iast", F.when(indic, let(F.col("head"), detect_and_convert)).otherwise(F.col("head")))
    r = r.withColumn("norm", F.when(F.col("lang") == "en", strip(F.lower("head"))).otherwise(normalize_headword(F.col("head"))))
    plain = strip_markup(F.col("body"), F.col("source_format") == "apple_dict")
    r = once(r, "plain", plain)
    r = once(r, "cut", snippets(F.col("plain"), F.col("sense_separator")))
    r = r.withColumn("senses", F.when(F.col("sense_separator").isNotNull(), senses(F.col("plain"), F.col("sense_separator"))))
    failed = indic & (F.coalesce("iast", F.lit("")) == "")
    flags = F.array_compact(
        F.array(
            F.when(failed, "iast-conversion-failed"),
            F.when(indic & has_hk_signature(F.col("iast")), "headword-script-mixed"),
            F.when(F.col("plain") == "", "body-empty"),
        )
    )
    filled = lambda a: F.when(F.size(a) > 0, a)
    return r.select(
        F.format_string("%s-%06d", "slug", "seq").alias("id"),
        F.col("slug").alias("dict"),
        F.col("head").alias("headword"),
        F.when(failed, F.col("head")).otherwise(F.col("iast")).alias("headword_iast"),
        F.col("norm").alias("headword_norm"),
        "lang",
        "tier",
        "priority",
        F.struct(
            F.nullif(F.col("body"), F.lit("")).alias("raw"),
            "plain",
            F.nullif(F.col("cut.short"), F.lit("")).alias("snippet_short"),
            F.nullif(F.col("cut.medium"), F.lit("")).alias("snippet_medium"),
            F.nullif(F.col("body_ko"), F.lit("")).alias("ko"),
            filled(F.col("senses")).alias("senses"),
        ).alias("body"),
        F.struct(filled(en_tokens(F.col("plain"))).alias("en"), filled(ko_tokens(F.coalesce("body_ko", F.lit("")))).alias("ko")).alias("reverse"),
        "license",
        F.struct(F.col("v1_name").alias("v1_dict_name"), F.col("raw_id").alias("v1_entry_id")).alias("source_meta"),
        filled(flags).alias("flags"),
        F.col("seq").cast("long").alias("seq"),
    )


def islands(lines: DataFrame, group: str, order: str, is_head: Column, keep: Column | None = None, resets: Column | None = None, width: int = 65_536) -> DataFrame:
    """Records from a line stream: a head line opens one, later lines join it.

    (group, record, line, is_head) of the lines of records.  ``keep`` drops
    lines that belong to none; a line that ``resets`` closes the open record
    without opening one (a head whose rest is not valid, say).  ``order`` is
    numeric; windows hold one of its ranges of ``width``.
    """
    resets = F.lit(False) if resets is None else resets
    opens = F.when(resets, F.lit(0)).when(is_head, F.lit(1))
    rows = lines.withColumns({"is_head": is_head & ~resets, "__turn": F.when(resets | is_head, F.lit(1)).otherwise(0), "__open": opens, "__range": F.floor(F.col(order) / width)})
    # within ranges of the order, then what the ranges before leave open
    so_far = Window.partitionBy(group, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("record", F.sum("__turn").over(so_far)).withColumn("__live", F.last("__open", ignorenulls=True).over(so_far))
    ends = rows.groupBy(group, "__range").agg(F.sum("__turn").alias("__n"), F.max_by("__open", F.when(F.col("__open").isNotNull(), F.col(order))).alias("__last"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        F.col(group).alias("__group"), F.col("__range").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__earlier"), F.last("__last", ignorenulls=True).over(before).alias("__left")
    )
    rows = rows.join(carry, F.col(group).eqNullSafe(F.col("__group")) & F.col("__range").eqNullSafe(F.col("__at")))
    rows = rows.withColumns({"record": F.col("record") + F.col("__earlier"), "__live": F.coalesce("__live", "__left")})
    rows = rows.where((F.col("__live") == 1) & (F.lit(True) if keep is None else (keep | F.col("is_head"))))
    return rows.drop("__turn", "__open", "__live", "__range", "__group", "__at", "__earlier", "__left")


def collected(records: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, record, head, lines) of island rows."""
    line = F.struct(F.col(order).alias("at"), F.col(text).alias("text"), "is_head")
    rows = records.groupBy(group, "record").agg(F.array_sort(F.collect_list(line)).alias("x"))
    return rows.select(group, "record", F.get("x", 0)["text"].alias("head"), F.transform(F.filter("x", lambda v: ~v["is_head"]), lambda v: v["text"]).alias("lines"))


def chapters(numbers: Column) -> Column:
    """Chapter of each verse number of an ordered array (nulls for verses without
    one): a new chapter begins when a number of at most 5 falls more than 10
    under the running maximum of 10 or more."""
    # the fold keeps where chapters begin, which are few, not a chapter for each verse
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"), F.array().cast("array<int>").alias("begun"))

    def step(s: Column, n: Column) -> Column:
        new = n.isNotNull() & (s["most"] >= 10) & (n <= 5) & (n < s["most"] - 10)
        most = F.when(new, n).otherwise(F.greatest(s["most"], n))
        return F.struct((s["at"] + 1).alias("at"), most.alias("most"), F.when(new, F.concat(s["begun"], F.array(s["at"]))).otherwise(s["begun"]).alias("begun"))

    begun = F.aggregate(F.transform(numbers, lambda n: n.cast("int")), zero, step, lambda s: s["begun"])
    return F.transform(numbers, lambda n, i: F.size(F.filter(begun, lambda b: b <= i)) + 1)


def verses(stream: Column) -> Column:
    """array<struct<number, text>>: the text before each ``॥N॥``, with its number;
    what follows the last marker is no verse."""
    marker = "॥\\s*([०-९]+)\\s*॥"
    numbers = F.regexp_extract_all(stream, F.lit(marker), 1)
    texts = F.split(stream, marker)
    pairs = F.zip_with(
        numbers,
        F.slice(texts, F.lit(1), F.size(numbers)),
        lambda n, t: F.struct(F.translate(n, "०१२३४५६७८९", "0123456789").cast("int").alias("number"), strip(t).alias("text")),
    )
    return F.filter(pairs, lambda v: v["text"] != "")


def representative_score(key: Column) -> Column:
    """How well a synonym stands for its group: near six letters, rich in vowels."""
    n = F.length(key)
    vowels = n - F.length(F.regexp_replace(key, "[aāiīuūṛṝḷḹeo]", ""))
    quoted = F.when(key.startswith("'") | key.endswith("'"), -2.0).otherwise(0.0)
    return F.when(n == 0, -100.0).when(n < 3, -10.0).otherwise(-F.abs(n - 6) * 0.3 + (vowels / n - 0.3) * 5 + quoted)


def representative(keys: Column) -> Column:
    """The best of an array of synonyms, the first of equals."""
    ranked = F.transform(keys, lambda k, i: F.struct(representative_score(k).alias("score"), (-i).alias("less"), k.alias("key")))
    return F.when(F.size(keys) > 0, F.array_max(ranked)["key"]).otherwise("")


_EQUIV = ["skt_iast", "skt_slp1", "tib_wylie", "zh", "ja", "de", "category", "note"]
_BOTH = ["ko", "en"]


def relocated(entries: DataFrame) -> DataFrame:
    """Equivalent fields from the root of ``body`` into ``body.equivalents``, never
    over a value there; ``ko`` and ``en`` also stay; other members of the root
    that name source details move to ``source_meta``."""
    body = entries.schema["body"].dataType.fieldNames()
    there = entries.schema["body"].dataType["equivalents"].dataType.fieldNames() if "equivalents" in body else []
    eq = []
    for c in [*there, *[x for x in _EQUIV + _BOTH if x not in there]]:
        own = F.nullif(F.col(f"body.equivalents.{c}"), F.lit("")) if c in there else None
        root = F.nullif(F.col(f"body.{c}"), F.lit("")) if c in body and c in _EQUIV + _BOTH else None
        eq.append(F.coalesce(*[x for x in (own, root) if x is not None] or [F.lit(None).cast("string")]).alias(c))
    kept = [F.col(f"body.{c}").alias(c) for c in body if c not in _EQUIV and c != "equivalents"]
    return entries.withColumn("body", F.struct(*kept, F.struct(*eq).alias("equivalents")))


def attach_examples(paragraphs: DataFrame, order: str) -> DataFrame:
    """Examples with the last main entry before them (kind, text, order)."""
    before = Window.partitionBy("doc").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    main = F.last(F.when(F.col("kind") == "main", F.col(order)), ignorenulls=True).over(before)
    return paragraphs.withColumn("main", main).where("kind = 'ex' and main is not null")
