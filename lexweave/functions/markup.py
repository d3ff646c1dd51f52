"""Markup to plain text."""

from __future__ import annotations


import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import SPACE, strip

#: The entities that the built-in form decodes; ``&amp;`` comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]


def clean_whitespace(s: Column) -> Column:
    """One blank for blanks, one newline for newlines, none before , ; . :"""
    # single blanks are left alone rather than replaced by themselves
    s = F.regexp_replace(s, "[\\t\u00a0][ \\t\u00a0]*| [ \\t\u00a0]+", " ")
    s = F.regexp_replace(s, "\\n{2,}", "\n")
    return strip(F.regexp_replace(s, f"{SPACE}+([,;.:])", "$1"))


def strip_tags(s: Column) -> Column:
    """Tags become blanks, the common entities are decoded (built-ins only)."""
    text = F.regexp_replace(F.coalesce(s, F.lit("")), "<[^>]+>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return clean_whitespace(text)


class _Text(HTMLParser):
    def __init__(self, spaced: bool):
        super().__init__(convert_charrefs=True)
        self.spaced, self.parts = spaced, []

    def handle_starttag(self, tag, attrs):
        if self.spaced and tag == "br":
            self.parts.append("\n")

    def handle_data(self, data):
        self.parts.append(data)


def plain_text(markup: str | None, spaced: bool = False) -> str:
    """Text of a fragment; ``spaced`` joins its pieces with blanks and keeps
    line breaks, as lenient sources want it."""
    if not markup:
        return ""
    if "<" in markup or "&" in markup:
        parser = _Text(spaced)
        parser.feed(markup)
        parser.close()
        markup = (" " if spaced else "").join(parser.parts)
    return unicodedata.normalize("NFC", markup)


def strip_markup(s: Column, spaced: Column | bool = False) -> Column:
    """Text of parsed markup.  Only rows with markup reach Python."""

    @F.pandas_udf("string")
    def parsed(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else plain_text(t, bool(k)) for t, k in zip(texts, kinds, strict=True)])

    s = F.coalesce(s, F.lit(""))
    marked = s.contains("<") | s.contains("&")
    return clean_whitespace(F.coalesce(parsed(F.when(marked, s), F.lit(spaced) if isinstance(spaced, bool) else spaced), s))
