"""Gloss tokens for reverse lookup, language tags, inflection grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import SPACE, strip

# --- fixed values -----------------------------------------------------------
STOPWORDS = """
the a an of to from with by in on at for as or and but is are was were be been being it its this that these those
which who whom what when where how why if then than so not no nor also too there here such any all some other another
one two three first second third very more most less least has have had do does did done
can could may might must shall should will would
m f n mfn mf nf mn pl sg du cf esp viz ib id etc cl cls comp fut impf prs pft aor
loc gen acc abl ins voc nom dat w wrt ep eq sc opp lit lex p pp adj adv prep conj interj pron ind partc nb ns
l ll v vs dh idem ditto see rv av tb sb mbh br ms skt bo tib sans sanskrit tibetan
engl english germ german fr french lat latin
""".split()
WEIGHT_NEAR, WEIGHT_MID, WEIGHT_FAR = 10, 7, 4  # tenths; up to 30, up to 100, beyond
NEAR, MID = 30, 100
MAX_TOKENS = 20
CASES = ["Nominative", "Vocative", "Accusative", "Instrumental", "Dative", "Ablative", "Genitive", "Locative"]
# ----------------------------------------------------------------------------


def _tokens_before(text: Column, limit: int) -> Column:
    """Lower-case letter runs that begin before ``limit``; one that is cut there
    is completed from the rest of the text."""
    head = F.substring(text, 1, limit)
    rest = F.regexp_extract(F.substring(text, limit + 1, 2**31 - 1 - limit), "^[a-zA-Z]*", 0)
    whole = F.when(head.rlike("[a-zA-Z]\\z"), F.concat(head, rest)).otherwise(head)
    return F.transform(F.regexp_extract_all(whole, F.lit("[a-zA-Z]{2,}"), 0), F.lower)


def en_tokens(text: Column, limit: int = MAX_TOKENS) -> Column:
    """Distinct English tokens by the weight of their first place, then name.

    A token's weight only depends on whether it begins in the first 30 or 100
    characters, so no offsets are needed: the tokens of the two beginnings are
    taken off the rest, and each band is sorted by name.
    """
    stop = F.array(*map(F.lit, STOPWORDS))
    near = F.array_except(_tokens_before(text, NEAR), stop)
    mid = F.array_except(F.array_except(_tokens_before(text, MID), stop), near)
    every = F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z]{2,}"), 0), F.lower)
    far = F.array_except(F.array_except(F.array_except(every, stop), near), mid)
    bands = F.concat(F.array_sort(near), F.array_sort(mid), F.array_sort(far))
    return F.coalesce(F.slice(bands, 1, limit), F.array().cast("array<string>"))


def _weight(position: Column) -> Column:
    return F.when(position < NEAR, WEIGHT_NEAR).when(position < MID, WEIGHT_MID).otherwise(WEIGHT_FAR)


def _place(text: Column, part: Column) -> Column:
    """Where ``part`` begins, as far as that matters for its weight."""
    at = F.instr(F.substring(text, F.lit(1), F.length(part) + MID), part) - 1
    return F.when(at < 0, MID).otherwise(at)


def ko_tokens(text: Column, limit: int = MAX_TOKENS) -> Column:
    """Distinct Hangul and Han runs by weight, then name.

    A run weighs by the first place of its characters anywhere in the text; both
    sides of a bracketed gloss such as 법(法) also by where the gloss begins.
    """
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit("[\uac00-\ud7af]+|[\u4e00-\u9fff]+"), 0))
    pattern = "([\uac00-\ud7af]+)\\s*\\(\\s*([\u4e00-\u9fff]+)\\s*\\)"
    glosses = F.regexp_extract_all(text, F.lit(pattern), 0)
    sides = F.flatten(
        F.transform(
            glosses,
            lambda g: F.array(
                *[F.struct((-_weight(_place(text, g))).alias("less"), F.regexp_extract(g, pattern, k).alias("token")) for k in (1, 2)]
            ),
        )
    )
    plain = F.transform(runs, lambda r: F.struct((-_weight(_place(text, r))).alias("less"), r.alias("token")))
    ranked = F.array_distinct(F.transform(F.array_sort(F.concat(sides, plain)), lambda x: x["token"]))
    return F.coalesce(F.slice(ranked, 1, limit), F.array().cast("array<string>"))


def entry_lang(dict_slug: Column, target_lang: Column) -> Column:
    """Language of a dictionary's headwords, from its slug and target."""
    return (
        F.when(target_lang.isin("bo", "pi"), target_lang)
        .when(dict_slug.startswith("tib-"), "bo")
        .when(dict_slug.contains("-pali") | dict_slug.contains("pali-"), "pi")
        .otherwise("sa")
    )


GRID = "struct<gender: string, cases: array<struct<name: string, forms: array<string>>>>"


def declension_grid(body: Column) -> Column:
    """Gender and eight rows of three forms; null when there is no number line.

    Missing forms are ``—``; more than three are dropped; without a header the
    gender is ``Unknown``.
    """
    numbers = "Singular\\s*Dual\\s*Plural"
    gender = F.regexp_extract(body, "\\[[^\\]]+\\]\\s*\\S+\\s*(Masculine|Feminine|Neuter)", 1)
    tail = F.regexp_extract(body, f"(?s){numbers}\\s*(.*)", 1)
    case = f"({'|'.join(CASES)})"
    names = F.regexp_extract_all(tail, F.lit(case), 1)
    # text before the first case name, if any, shifts the pairing as a part of its own
    parts = F.filter(F.split(F.regexp_replace(tail, case, "\u0001$1\u0001"), "\u0001"), lambda x: x != "")
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor(F.size(parts) / 2).cast("int"), F.lit(1)) - 1),
        lambda i: F.struct(F.get(parts, 2 * i).alias("name"), strip(F.get(parts, 2 * i + 1)).alias("blob")),
    )
    rows = F.transform(
        F.filter(pairs, lambda p: p["blob"].isNotNull()),
        lambda p: F.struct(
            p["name"].alias("name"),
            F.transform(
                F.sequence(F.lit(0), F.lit(2)),
                lambda k: F.coalesce(F.when((p["blob"] != "") | (k > 0), F.get(F.split(p["blob"], f"{SPACE}+"), k)).otherwise(""), F.lit("—")),
            ).alias("forms"),
        ),
    )
    grid = F.struct(F.when(gender == "", "Unknown").otherwise(gender).alias("gender"), rows.alias("cases"))
    return F.when(body.rlike(numbers) & (F.size(names) > 0) & (F.size(rows) > 0), grid)
