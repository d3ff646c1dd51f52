"""Snippets and senses of long definitions.

Senses under the standard markers are split by built-ins.  Cut points need match
offsets, and a dictionary's own separator may be any Python pattern, with or
without a group: these are pandas UDFs, which short texts (the bulk of a
dictionary) never reach.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import strip

# --- fixed values -----------------------------------------------------------
SHORT = (120, 180)  # target and limit, in characters
MEDIUM = (400, 500)
NUMBERED = r"\s(?:-\s?\d+|\d+\.)\s+"
SEMICOLON = r";\s+"
FULL_STOP = r"(?<!\b[a-zA-Z])(?<!\bcf)(?<!\besp)(?<!\bv)\.\s+(?=[A-Z])"
SENSE = r"(?:^|\s)(-?\d+[a-z]?)\.?\s+"
ABBREVIATIONS = "m f n mfn cf esp pl sg du v vs viz ib id cl comp fut impf loc gen acc abl ins voc a b c d e e.g".split()
# ----------------------------------------------------------------------------
_EDGE = " ;.-"
_SENSES = "array<struct<num: string, text: string>>"

#: A full stop after an abbreviation ends no sentence, in whatever case, nor does
#: one that follows it on a new line.
_GUARD = "".join(rf"(?<!\b(?i:{re.escape(a)}){end})" for a in ABBREVIATIONS for end in ("", r"\n"))
#: (pattern, whether a cut stands at its end or after its first character)
_CUTS = [(re.compile(SEMICOLON), True), (re.compile(NUMBERED), False), (re.compile(r"(?=\.)" + _GUARD + FULL_STOP), True)]


@lru_cache(maxsize=256)
def _pattern(separator: str | None) -> re.Pattern | None:
    """A dictionary's separator; one that is no pattern separates nothing."""
    try:
        return re.compile(separator) if separator else None
    except re.error:
        return None


def boundaries(text: str, separator: str | None = None) -> list[int]:
    """Sorted offsets at which a cut reads well; the end is always one."""
    own = _pattern(separator)
    rules = _CUTS if own is None else [*_CUTS, (own, True)]
    return sorted({len(text), *(m.end() if at_end else m.start() + 1 for rule, at_end in rules for m in rule.finditer(text))})


def cut(text: str, at: list[int], target: int, limit: int) -> str:
    """Text within the limit: up to the first boundary from the target on, or the
    last one before it; without any, up to a word's end, and marked as cut."""
    if len(text) <= limit:
        return text.strip()
    k = bisect_left(at, target)
    if k == len(at) or at[k] > limit:
        k -= 1
    if k >= 0:
        return text[: at[k]].rstrip(_EDGE).strip()
    body, space, _ = text[: limit - 1].rpartition(" ")
    # a lone space at the very beginning is no end of a word
    return (body.rstrip(_EDGE).strip() if space and body else text[: limit - 1].strip())[: limit - 1] + "…"


def pair(text: str, separator: str | None = None) -> tuple[str, str]:
    text = text.strip()
    at = boundaries(text, separator) if len(text) > SHORT[1] else []
    return cut(text, at, *SHORT), cut(text, at, *MEDIUM)


def split_senses(text: str, separator: str | None = None) -> list[tuple[str, str]]:
    """(number, text) of each sense; none unless there are two markers.

    Senses are the pieces between markers.  What comes before the first has
    number 1; a marker without a number is numbered by its place, so the first of
    them has number 1 as well.
    """
    pattern = _pattern(separator or SENSE)
    marks = list(pattern.finditer(text)) if pattern else []
    if len(marks) < 2:
        return []
    numbers = ["1", *((m[1] or "").lstrip("-").strip() if m.lastindex else str(k) for k, m in enumerate(marks, 1))]
    pieces = [text[a:b].strip() for a, b in zip([0, *(m.end() for m in marks)], [*(m.start() for m in marks), len(text)], strict=True)]
    return [(n, piece) for n, piece in zip(numbers, pieces, strict=True) if piece]


def snippets(text: Column, separator: Column | None = None) -> Column:
    """struct<short, medium>; a text within the short limit is both."""

    @F.pandas_udf("short string, medium string")
    def long_ones(texts: pd.Series, seps: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else pair(t, s) for t, s in zip(texts, seps, strict=True)]
        return pd.DataFrame(rows, columns=["short", "medium"])

    whole = strip(F.coalesce(text, F.lit("")))
    # no cut lies beyond the longer limit, and the built-in patterns only look at
    # what is near; a dictionary's own separator may look anywhere
    separator = F.lit(None).cast("string") if separator is None else separator
    near = F.when(separator.isNull(), F.substring(whole, 1, 4 * MEDIUM[1])).otherwise(whole)
    got = long_ones(F.when(F.length(whole) > SHORT[1], near), separator)
    return F.struct(F.coalesce(got["short"], whole).alias("short"), F.coalesce(got["medium"], whole).alias("medium"))


def standard_senses(text: Column) -> Column:
    """Senses under the standard markers, without Python."""
    marker = "(?U)" + SENSE
    numbers = F.transform(F.regexp_extract_all(text, F.lit(marker), 1), lambda n: F.regexp_replace(n, "^-+", ""))
    rows = F.zip_with(F.concat(F.array(F.lit("1")), numbers), F.split(text, marker, -1), lambda n, t: F.struct(n.alias("num"), strip(t).alias("text")))
    found = F.when(F.size(numbers) >= 2, F.filter(rows, lambda x: x["text"] != ""))
    return F.coalesce(found, F.array().cast(_SENSES))


def senses(text: Column, separator: Column | None = None) -> Column:
    """array<struct<num, text>>; only rows with a separator of their own meet Python."""
    if separator is None:
        return standard_senses(text)

    @F.pandas_udf(_SENSES)
    def split(texts: pd.Series, seps: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"num": a, "text": b} for a, b in split_senses(t, s)] for t, s in zip(texts, seps, strict=True)])

    own = separator.isNotNull() & (separator != "")
    return F.when(own, F.coalesce(split(F.when(own, text), separator), F.array().cast(_SENSES))).otherwise(standard_senses(text))
