"""Line parsers for bilingual sources: field columns from one line of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import IAST_CAPITALS, IAST_MARKED, normalize, strip, tibetan_to_wylie

HAN = "㐀-䶿一-鿿豈-﫿"
HANGUL = "가-힯"
IAST_ANY = IAST_MARKED + "ṁ" + IAST_CAPITALS


def _count(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, f"[{letters}]", ""))


# --- line shapes ----------------------------------------------------------------
def is_wylie_headword(line: Column) -> Column:
    """A short lower-case Latin line that can only be a Tibetan headword."""
    s = strip(line)
    return s.rlike("^[a-z' ./;\\-]{1,100}\\z") & (s != "example")


def is_han_headword(line: Column) -> Column:
    """One to six Han characters and nothing else."""
    return strip(line).rlike(f"^[{HAN}]{{1,6}}\\z")


def is_sanskrit_continuation(line: Column) -> Column:
    """More than three Latin letters and no Han, Devanagari, Hangul or kana."""
    foreign = line.rlike("[一-鿿㐀-䶿ऀ-ॿ가-힯぀-ヿ]")
    return ~foreign & (_count(line, "A-Za-z" + IAST_MARKED + IAST_CAPITALS) > 3)


def is_english_continuation(line: Column) -> Column:
    """Plain English words, no diacritics."""
    return strip(line).rlike("^[a-zA-Z][a-zA-Z\\s\\-,;:.()/\\d]*\\z")


def is_japanese_continuation(line: Column) -> Column:
    """Three or more kana or kanji."""
    return _count(line, "぀-ゟ゠-ヿ一-鿿") > 2


def is_german_continuation(line: Column) -> Column:
    """Prose rather than a headword: long, of four words, or a citation."""
    s = strip(line)
    return (F.length(s) > 50) | s.rlike("^[FCM]\\s+SHT\\s+\\d|^[mn]\\.nom\\.sg\\.|^abs\\.|^vgl\\.") | (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) >= 3)


# --- fields of one line -----------------------------------------------------------
def tib_zh_skt(line: Column) -> Column:
    """struct<tib, zh, skt>: the Han run from the first to the last Han character
    divides the line; null without Han."""
    parts = f"^([^{HAN}]*)([{HAN}](?:.*[{HAN}])?)([^{HAN}]*)\\z"
    field = lambda k: strip(F.regexp_extract(line, parts, k))
    return F.when(line.rlike(f"[{HAN}]"), F.struct(field(1).alias("tib"), field(2).alias("zh"), field(3).alias("skt")))


def tib_zh(text: Column) -> Column:
    """struct<tib, zh>: everything from the first Han character on is Chinese."""
    field = lambda k: strip(F.regexp_extract(text, f"(?s)^([^{HAN}]*)(.*)\\z", k))
    return F.struct(field(1).alias("tib"), field(2).alias("zh"))


def marked_paragraph(text: Column) -> Column:
    """struct<kind, tibetan, sanskrit, english, korean> of a ``*`` (main) or ``-``
    (sub) paragraph ``Tibetan TAB gloss``; ``ex.`` paragraphs have kind ex; null
    for anything else."""
    s = strip(text)
    body = F.regexp_extract(s, "(?s)^[*\\-]\\s*(.+)", 1)
    tab = F.instr(body, "\t") > 0
    pair = F.when(tab, F.split(body, "\t", 2)).otherwise(F.split(body, "\\s{2,}", 2))
    gloss = strip(F.get(pair, 1))
    bracket = "\\[([^\\]]+)\\]"
    english = F.regexp_replace(F.regexp_replace(gloss, bracket, ""), f"[{HANGUL}]+", "")
    english = F.regexp_replace(F.regexp_replace(english, "[,;]+\\s*$", ""), "^[ ,;.]+|[ ,;.]+$", "")
    text_of = lambda kind, *cols: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), *[c.alias(n) for n, c in zip(("tibetan", "sanskrit", "english", "korean"), cols, strict=True)])
    none = F.lit(None).cast("string")
    entry = text_of(
        F.when(s.startswith("*"), "main").otherwise("sub"),
        strip(F.get(pair, 0)),
        strip(F.regexp_extract(gloss, bracket, 1)),
        english,
        F.array_join(F.regexp_extract_all(gloss, F.lit(f"[{HANGUL}]+"), 0), " "),
    )
    return F.when(s.rlike("^ex[. ]"), text_of("ex", none, none, none, none)).when((body != "") & (F.size(pair) > 1), entry)


def pinyin(line: Column) -> Column:
    """What stands in the brackets of a bracketed line, unless it holds Han."""
    value = strip(F.regexp_extract(strip(line), "^[(（]([^()（）]+)[)）]", 1))
    return F.when((value != "") & ~value.rlike(f"[{HAN}]"), value)


def quoted_english(line: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(strip(line), "^[“\"]([^”\"]+)[”\"]", 1)), F.lit(""))


def sanskrit_terms(blob: Column) -> Column:
    """Terms between commas and semicolons, cut at both ends; one-character and
    letterless pieces go."""
    flat = F.translate(blob, "，；。", ",;.")
    edge = "^[\\s\"“”‘’'.*　]+|[\\s.*\"　]+$"
    pieces = F.transform(F.split(strip(flat), "[;,]+"), lambda p: F.regexp_replace(p, edge, ""))
    return F.filter(pieces, lambda p: (F.length(p) >= 2) & p.rlike(f"[a-zA-Z{IAST_MARKED}]"))


def sanskrit_word(line: Column) -> Column:
    """The first word that looks Sanskrit: it has a marked letter, or five lower
    case letters or more."""
    words = F.regexp_extract_all(line, F.lit("(?U)[\\p{L}\\-]+"), 0)
    likely = F.filter(words, lambda w: w.rlike(f"[{IAST_ANY}]") | (w.rlike("^[\\p{Ll}\\-]{5,}\\z")))
    return F.get(likely, 0)


def citation_terms(line: Column) -> Column:
    """Sanskrit words after source references such as ``K.12.3.``: with a marked
    letter, or one lower-case word of four letters or more."""
    reference = "(?:K|O|Pk|D\\d?|R\\d?|Cdv?)\\.\\d+(?:\\.\\d+)?\\.([ -ɏḀ-ỿ a-zA-Z()\\-~,]+?)(?:[;,]|$)"
    words = F.transform(F.regexp_extract_all(strip(line), F.lit(reference), 1), lambda w: F.regexp_replace(strip(w), "[~\\-., ]+$", ""))
    return F.filter(words, lambda w: w.rlike(f"[{IAST_ANY}]") | w.rlike("^[a-z\\-~()]{4,}\\z"))


def four_languages(line: Column) -> Column:
    """struct<zh, tib, skt, en> of a numbered line: Han, then Tibetan up to the
    first word that looks Sanskrit, then English; null without Han."""
    s = F.regexp_replace(strip(line), "^[\\dabcdef]+\\s+", "")
    zh = F.regexp_extract(s, f"[{HAN}]+", 0)
    rest = strip(F.regexp_extract(s, f"^[^{HAN}]*[{HAN}]+(.*)\\z", 1))
    word = f"(?:(?=[\\p{{L}}\\-]*[{IAST_ANY}])[\\p{{L}}\\-]+|[\\p{{Ll}}\\-]{{5,}}(?![\\p{{L}}\\-]))"
    parts = f"(?U)^(.*?[^\\p{{L}}\\-])({word})(.*)\\z"
    tib, skt, en = (F.regexp_extract(rest, parts, k) for k in (1, 2, 3))
    tibetan = rest.rlike("[ༀ-࿿]|\\(cid:\\d+\\)")
    led = (skt != "") & (strip(tib).rlike("[ༀ-࿿]|\\(cid:\\d+\\)") | (F.length(tib) > 2)) & (strip(tib) != "")
    none = F.lit("")
    return F.when(
        zh != "",
        F.struct(
            zh.alias("zh"),
            F.when(led, strip(tib)).when(tibetan, rest).otherwise(none).alias("tib"),
            F.when(led, skt).otherwise(none).alias("skt"),
            F.when(led, strip(en)).when(tibetan, none).otherwise(rest).alias("en"),
        ),
    )


def kept(kind: str, **c: Column) -> Column:
    """Whether a parsed record of a source is worth an entry."""
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    count = lambda x, letters: _count(F.coalesce(x, F.lit("")), letters)
    rules = {
        "tagged": lambda: F.exists(c["tags"], lambda t: t.startswith("translation-")),
        "glossary": lambda: some(c["pinyin"]) | some(c["skt"]) | some(c["en"]),
        "four": lambda: some(c["zh"]) & (some(c["skt"]) | some(c["en"])),
        "tibetan": lambda: F.coalesce(c["tib"].rlike("[ༀ-࿿]"), F.lit(False)),
        "tib_zh": lambda: (count(c["tib"], "ༀ-࿿") >= 3) & (count(c["zh"], HAN) >= 2),
    }
    return rules[kind]()


# --- equivalents rows ---------------------------------------------------------------
def primary(lang: Column, skt: Column, tib: Column, zh: Column, skt_norm: Column, tib_norm: Column) -> Column:
    """struct<headword, iast, norm> by the source's main language; the headword is
    null when the row is empty."""
    some = lambda *cols: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])
    head = F.when(lang == "skt", some(skt, zh, tib)).when(lang == "bo", some(tib, skt, zh)).when(lang == "zh", some(zh, skt, tib)).otherwise(some(skt, tib, zh))
    iast = F.when(lang == "skt", F.coalesce(some(skt), head)).when(lang == "bo", F.coalesce(some(tib), head)).when(lang == "zh", some(skt, zh)).otherwise(head)
    norm = (
        F.when(lang == "skt", F.coalesce(some(skt_norm), normalize(head)))
        .when(lang == "bo", F.coalesce(some(tib_norm), normalize(head)))
        .when(lang == "zh", normalize(F.coalesce(some(skt_norm), some(zh), F.lit(""))))
        .otherwise(normalize(head))
    )
    return F.struct(head.alias("headword"), iast.alias("iast"), norm.alias("norm"))


def composed_plain(skt: Column, tib: Column, zh: Column, category: Column, conf: Column | None = None) -> Column:
    """``Skt: … · Tib: … · Zh: … · (category)``, and a note of low confidence."""
    part = lambda label, c: F.when(F.trim(c) != "", F.concat(F.lit(label), F.trim(c)))
    parts = [part("Skt: ", skt), part("Tib: ", tib), part("Zh: ", zh)]
    parts.append(F.when((F.trim(category) != "") & (F.trim(category) != "."), F.concat(F.lit("("), F.trim(category), F.lit(")"))))
    if conf is not None:
        parts.append(F.when(conf < 70, F.format_string("[OCR conf %.0f]", conf)))
    return F.concat_ws(" · ", *parts)


def moved_note(equivalents: Column, prefix: str, field: str, note: str) -> Column:
    """``note`` of the form prefix + value becomes ``field`` = value."""
    hit = equivalents["note"].startswith(prefix)
    value = strip(F.substring(equivalents["note"], F.lit(len(prefix) + 1), F.length(equivalents["note"])))
    return F.when(hit, equivalents.withField(field, value).withField("note", F.lit(note))).otherwise(equivalents)


def with_wylie(headword: Column, iast: Column, norm: Column, note: Column) -> Column:
    """struct<iast, norm, tib_wylie, note> with the headword's Wylie; notes that
    say it is missing are rewritten; without one the row stays, or falls back to
    the headword where nothing was there."""
    wylie = F.coalesce(tibetan_to_wylie(headword), F.lit(""))
    have = wylie != ""
    stale = note.contains("Tib unicode unconverted") | note.contains("root-letter not detected")
    spelled = F.when(have, wylie).when(F.coalesce(iast, F.lit("")) == "", headword).otherwise(iast)
    return F.struct(
        spelled.alias("iast"),
        F.when(have | (F.coalesce(iast, F.lit("")) == ""), normalize(spelled)).otherwise(norm).alias("norm"),
        F.when(have, wylie).alias("tib_wylie"),
        F.when(have & stale, "Wylie = letter by letter").otherwise(note).alias("note"),
    )


def source_label(slug: Column, labels: dict[str, str]) -> Column:
    """Short label of a source; the slug itself when it has none."""
    if not labels:
        return slug
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, slug), slug)
