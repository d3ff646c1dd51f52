"""Script detection, transliteration and search keys as built-in columns."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
#: Harvard-Kyoto, longest first: these replacements come before the letters.
HK_GROUPS = [("lRR", "ḹ"), ("lR", "ḷ"), ("RR", "ṝ"), ("Th", "ṭh"), ("Dh", "ḍh"), ("~n", "ñ")]
HK_LETTERS = ("AIURMHGJTDNzS", "āīūṛṃḥṅñṭḍṇśṣ")
SLP1_LETTERS = ("AIURLMHGJTDNSz~", "āīūṛḷṃḥṅñṭḍṇṣśñ")
HK_CAPITALS = "AIUTDNSGJRMH"
IAST_MARKED = "āīūṛṝḷḹṃḥṅñṭḍṇśṣ"
IAST_CAPITALS = "ĀĪŪṚṜḶḸṂṀḤṄÑṬḌṆŚṢ"

DEVA_VOWELS = "अ a आ ā इ i ई ī उ u ऊ ū ऋ ṛ ॠ ṝ ऌ ḷ ॡ ḹ ए e ऐ ai ओ o औ au".split()
DEVA_CONSONANTS = (
    "क k ख kh ग g घ gh ङ ṅ च c छ ch ज j झ jh ञ ñ ट ṭ ठ ṭh ड ḍ ढ ḍh ण ṇ "
    "त t थ th द d ध dh न n प p फ ph ब b भ bh म m य y र r ल l व v श ś ष ṣ स s ह h"
).split()
DEVA_SIGNS = "ा ā ि i ी ī ु u ू ū ृ ṛ ॄ ṝ ॢ ḷ ॣ ḹ े e ै ai ो o ौ au".split()
DEVA_OTHERS = "ं ṃ ः ḥ ँ m̐ ऽ ' । | ॥ || ॐ oṃ".split()
DEVA_VIRAMA, DEVA_NUKTA = "\u094d", "\u093c"

TIB_LETTERS = (
    "ཀ k ཁ kh ག g ང ng ཅ c ཆ ch ཇ j ཉ ny ཊ T ཋ Th ཌ D ཎ N ཏ t ཐ th ད d ན n པ p ཕ ph བ b མ m "
    "ཙ ts ཚ tsh ཛ dz ཝ w ཞ zh ཟ z འ ' ཡ y ར r ལ l ཤ sh ཥ Sh ས s ཧ h ཨ a ཪ r ཫ v ཬ y"
).split()
TIB_SUBJOINED = (
    "ྐ k ྑ kh ྒ g ྔ ng ྕ c ྖ ch ྗ j ྙ ny ྚ T ྛ Th ྜ D ྞ N ྟ t ྠ th ྡ d ྣ n ྤ p ྥ ph ྦ b ྨ m "
    "ྩ ts ྪ tsh ྫ dz ྭ w ྮ zh ྯ z ྰ ' ྱ y ྲ r ླ l ྴ sh ྵ Sh ྶ s ྷ h ྸ a ྺ v ྻ y ྼ r"
).split()
TIB_VOWELS = "ཱ A ི i ུ u ཷ rI ཹ lI ེ e ཻ ai ོ o ཽ au ཾ M ཿ H ྀ -i".split()
TIB_BREAKS = "་།༎༌"
# ----------------------------------------------------------------------------

#: Stands for a used virama while a text is converted (private use).
_DONE = "\ue000"

#: Any Unicode white space, as Python's strip() and \\s have it.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACES}]"


def _pairs(flat: list[str]) -> list[tuple[str, str]]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(s: Column) -> Column:
    """Cut Unicode white space at both ends."""
    return F.trim(s, F.lit(SPACES))


def hk_to_iast(s: Column) -> Column:
    for old, new in HK_GROUPS:
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.translate(s, *HK_LETTERS)


def slp1_to_iast(s: Column) -> Column:
    return F.translate(s, *SLP1_LETTERS)


def _mapped(s: Column, pairs: list[tuple[str, str]]) -> Column:
    one = [(a, b) for a, b in pairs if len(b) == 1]
    for a, b in pairs:
        if len(b) != 1:
            s = F.replace(s, F.lit(a), F.lit(b))
    return F.translate(s, "".join(a for a, _ in one), "".join(b for _, b in one))


def devanagari_to_iast(s: Column) -> Column:
    """A consonant without a following vowel sign or virama gets an ``a``.

    A sign is only taken as the consonant's vowel right after it; one that
    stands anywhere else (after a nukta, say) is passed through.
    """
    consonants, signs = "".join(DEVA_CONSONANTS[::2]), "".join(DEVA_SIGNS[::2])
    s = F.regexp_replace(s, f"([{consonants}])(?![{signs}{DEVA_VIRAMA}])", "$1a")
    s = F.regexp_replace(s, f"([{consonants}]){DEVA_VIRAMA}", f"$1{_DONE}")
    for sign, vowel in _pairs(DEVA_SIGNS):
        s = F.regexp_replace(s, f"(?<=[{consonants}]){sign}", vowel)
    s = _mapped(s, _pairs(DEVA_CONSONANTS) + _pairs(DEVA_VOWELS) + _pairs(DEVA_OTHERS))
    digits = "".join(chr(0x966 + k) for k in range(10))
    return F.translate(s, digits + DEVA_NUKTA + _DONE, "0123456789")


def tibetan_to_wylie(s: Column) -> Column:
    """Approximate Wylie, letter by letter; a syllable without a vowel sign that
    ends in a letter gets an ``a``; other Tibetan code points become ``?`` and
    their number."""
    vowels, tables = "".join(TIB_VOWELS[::2]), _pairs(TIB_LETTERS) + _pairs(TIB_SUBJOINED) + _pairs(TIB_VOWELS)

    def syllable(x: Column) -> Column:
        text = _mapped(x, tables)
        unknown = F.filter(F.split(text, ""), lambda c: c.rlike("[\u0f00-\u0fff]"))
        text = F.aggregate(unknown, text, lambda t, c: F.replace(t, c, F.concat(F.lit("?"), F.lpad(F.lower(F.hex(F.ascii(c).cast("long"))), 4, "0"))))
        bare = ~x.rlike(f"[{vowels}]") & text.rlike("(?U)[\\p{L}&&[^AIUEO]]$")
        return F.when(bare, F.concat(text, F.lit("a"))).otherwise(text)

    parts = F.filter(F.split(s, f"[{TIB_BREAKS}]"), lambda x: x != "")
    return strip(F.array_join(F.transform(parts, syllable), " "))


def has_devanagari(s: Column) -> Column:
    return s.rlike("[\u0900-\u097f]")


def has_tibetan(s: Column) -> Column:
    return s.rlike("[\u0f00-\u0fff]")


def has_han(s: Column) -> Column:
    return s.rlike("[\u4e00-\u9fff\uf900-\ufaff]")


def has_hangul(s: Column) -> Column:
    return s.rlike("[\uac00-\ud7af\u1100-\u11ff]")


def has_hk_signature(s: Column, ascii_only: bool = False) -> Column:
    """Looks like Harvard-Kyoto: a signature capital and a lower-case letter,
    but no IAST letter.  Queries only count a-z as lower case."""
    lower = "[a-z]" if ascii_only else "\\p{javaLowerCase}"
    return s.rlike(f"[{HK_CAPITALS}]") & s.rlike(lower) & ~s.rlike(f"[{IAST_MARKED}]")


def detect_and_convert(s: Column) -> Column:
    """To IAST, or Wylie for Tibetan script (build-side rules)."""
    return (
        F.when(has_devanagari(s), devanagari_to_iast(s))
        .when(has_tibetan(s), tibetan_to_wylie(s))
        .when(has_hk_signature(s), hk_to_iast(s))
        .otherwise(s)
    )


def detect_script(s: Column) -> Column:
    """Query-side script: Han before Hangul, no Tibetan arm."""
    return (
        F.when(s.isNull() | (s == ""), "empty")
        .when(has_devanagari(s), "devanagari")
        .when(has_han(s), "cjk")
        .when(has_hangul(s), "korean")
        .when(has_hk_signature(s, ascii_only=True), "hk")
        .otherwise("iast")
    )


def to_iast(s: Column, script: Column | None = None) -> Column:
    script = detect_script(s) if script is None else script
    return F.when(script == "devanagari", devanagari_to_iast(s)).when(script == "hk", hk_to_iast(s)).otherwise(F.coalesce(s, F.lit("")))


@cache
def _fold_table() -> tuple[str, str, str, list[tuple[str, str]]]:
    """(characters, their base, class of combining marks, characters with longer
    bases), made from the Unicode data of this Python; Hangul is left to
    :func:`_jamo`."""
    old, new, marks, longer = [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if not base:  # a combining mark, or made of such only
            if marks and marks[-1][1] == code - 1:
                marks[-1][1] = code
            else:
                marks.append([code, code])
            continue
        if base != c and len(base) == 1:
            old.append(c)
            new.append(base)
        elif base != c:
            longer.append((c, base))
    return "".join(old), "".join(new), "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in marks), longer


def _jamo(s: Column) -> Column:
    """Hangul syllables as conjoining jamo."""
    lead, vowel, tail = ([chr(a + k) for k in range(n)] for a, n in ((0x1100, 19), (0x1161, 21), (0x11A7, 28)))
    tail[0] = ""

    def one(c: Column) -> Column:
        code = F.ascii(c) - F.lit(0xAC00)
        pick = lambda table, k: F.element_at(F.array(*map(F.lit, table)), (k + 1).cast("int"))
        parts = F.concat(pick(lead, F.floor(code / 588)), pick(vowel, F.floor((code % 588) / 28)), pick(tail, code % 28))
        return F.when(c.rlike("[\uac00-\ud7a3]"), parts).otherwise(c)

    return F.array_join(F.transform(F.split(s, ""), one), "")


def strip_marks(s: Column) -> Column:
    """Canonical decomposition without combining marks."""
    old, new, marks, longer = _fold_table()
    folded = F.regexp_replace(F.translate(s, old, new), f"[{marks}]+", "")

    def rest(f: Column) -> Column:
        full = f
        for c, base in longer:
            full = F.replace(full, F.lit(c), F.lit(base))
        rare = f.rlike(f"[\uac00-\ud7a3{''.join(c for c, _ in longer)}]")
        return F.when(rare, let(full, _jamo)).otherwise(f)

    return F.when(s.rlike("^[\\x00-\\x7f]*$"), s).otherwise(let(folded, rest))


def normalize(s: Column) -> Column:
    """Accent-insensitive lower-case key."""
    return strip(F.lower(strip_marks(s)))


def normalize_headword(s: Column) -> Column:
    """Build-side search key: detect, convert, normalise."""
    return let(let(s, detect_and_convert), normalize)


def query_key(s: Column) -> Column:
    """Query-side search key."""
    return let(let(s, to_iast), normalize)


def is_valid_iast(s: Column) -> Column:
    letters = "a-zA-Z" + IAST_MARKED + "ṁ" + IAST_CAPITALS
    return F.coalesce(s.rlike(f"^[{letters} '\\-.,()/|]+\\z"), F.lit(False))


def is_valid_wylie(s: Column) -> Column:
    return F.coalesce(s.rlike("^[a-zA-Z0-9 '\\-.,()/|_+]+\\z"), F.lit(False))


def normalize_whitespace(s: Column) -> Column:
    # single blanks are left alone rather than replaced by themselves
    return strip(F.regexp_replace(s, f"[{SPACES.replace(' ', '')}]{SPACE}*| {SPACE}+", " "))


def umlauts_to_iast(s: Column) -> Column:
    """German umlauts of scanned IAST: ä ö ü for long vowels, ß as ss."""
    return F.replace(F.translate(s, "äöüÄÖÜ", "āōūĀŌŪ"), F.lit("ß"), F.lit("ss"))


def clean_ocr_iast(s: Column) -> Column:
    """Straight quotes and single spaces for scanned IAST."""
    return normalize_whitespace(F.translate(s, "‘’“”", "''\"\""))


def clean_iast(s: Column) -> Column:
    """Scanned headword without the punctuation at its end."""
    return F.regexp_replace(F.regexp_replace(strip(s), "[,.;:]+$", ""), f"{SPACE}+", " ")
