"""Synonyms from verses of a Devanagari thesaurus: page cleaning, isolation of
the root verse, tokens, candidates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import SPACE, devanagari_to_iast, normalize, strip

# --- fixed values -----------------------------------------------------------
#: Particles, gender marks, numerals and book words that are no synonyms.
STOP = """
puṃ puṃsi puṃsoḥ puṃsau puṃsām puṃso strī striyāṃ striyām striyaḥ striyāḥ striyoḥ striyau
klī klīve klībe klīvayoḥ klībam klībaṃ napuṃsake napuṃsakaṃ napuṃsaka napuṃsakam
tulyam tulye tulyau tulya tulyāḥ samau samaṃ same samāḥ samā samaḥ
trayam traye traya trīṇi trayaḥ triṣu dvayam dvaya dvau dve dvayoḥ
catuṣkam catuṣka catur catvāri caturṣu pañcakam pañcaka pañca pañcasu saptakam saptaka saptau
ca tu vā atha api iti iva syāt syuḥ syu syād stāt sa saḥ sā so
yathā tathā evam eva yat tat na ha te tā tāḥ tau ta tasya tasmin tasmāt
asau ayaṃ iyaṃ amī ami eṣa eṣaḥ etat mā māt ho hi vai cet kim kasya
ādi ādayaḥ ādiḥ ādīnāṃ ādīnām atra tatra kvacit kṣaṇam yatra kutracit kutaḥ itihāse itihāsa
om śrī śrīḥ amba ambā patah pathah piṭhah pātṭhah varganu vargah vargaḥ varga
kāṇḍa kāṇḍaṃ kāṇḍam kāṇḍe kāṇḍāḥ kāṇḍāni ity tena yena kena
""".split()
FOOTNOTE = "^[\\s.\\d०-९]*[क-ह]\\.[\\s\\d०-९क-ह.,]*\\s*पाठः?|^[०-९\\d]+\\.\\s*[क-हa-zA-Z]\\s*[.,]"
LONE_NUMBER = "^[०-९0-9\\s.,/\\-]+$"
COMMENTARY = "(?:क्षी?\\s*र|[दटी]ी?\\s*का)[\\s°○ः०.\\-—]*"
PADA = (8, 70)  # mean characters of a quarter verse
LONGEST = 320
# ----------------------------------------------------------------------------


def devanagari_share(line: Column) -> Column:
    """Share of Devanagari among the characters that are no white space."""
    dense = F.regexp_replace(line, f"{SPACE}", "")
    return F.coalesce(F.length(F.regexp_replace(dense, "[^ऀ-ॿ]", "")) / F.nullif(F.length(dense), F.lit(0)), F.lit(0.0))


def clean_page(text: Column, headers: list[str] | None = None) -> Column:
    """Body lines of a page: without page numbers, mostly English lines, running
    heads (``headers`` are patterns) and variant readings."""

    def body(s: Column) -> Column:
        share = devanagari_share(s)
        drop = s.rlike(LONE_NUMBER) | (s.rlike("[A-Za-z]{4,}") & (share < 0.3)) | s.rlike(FOOTNOTE)
        drop = drop | (s.contains("पाठः") & (F.length(s) < 80) & (F.regexp_count(s, F.lit("\\.")) >= 2))
        for pattern in headers or []:
            drop = drop | (s.rlike(pattern) & (share < 0.7))
        return (s != "") & ~drop

    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), body), "\n")


def root_verse(chunk: Column) -> Column:
    """The last four, two or one danda-separated pieces of a chunk whose mean
    length is that of a quarter verse; else the end of the last piece."""
    bare = F.regexp_replace(chunk, "\\s*॥\\s*[०-९1-9]{1,3}\\s*॥\\s*$", "")
    tail = F.substring(bare, F.greatest(F.length(bare) - 1499, F.lit(1)), F.lit(1500))
    tail = F.element_at(F.split(tail, COMMENTARY), -1)
    parts = F.filter(F.transform(F.split(tail, "[।॥]"), strip), lambda s: s != "")
    # pieces of under four letters at the very end are page numbers and the like
    last = F.array_max(F.transform(parts, lambda s, i: F.when(F.length(s) >= 4, i + 1).otherwise(0)))
    parts = F.slice(parts, F.lit(1), F.greatest(F.coalesce(last, F.lit(0)), F.lit(0)))
    cut = lambda s: F.substring(s, F.greatest(F.length(s) - (LONGEST - 1), F.lit(1)), F.lit(LONGEST))
    choice = F.lit(None).cast("string")
    for n in (1, 2, 4):
        some = F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), F.lit(n))
        mean = F.aggregate(some, F.lit(0), lambda t, s: t + F.length(s)) / n
        choice = F.when((F.size(parts) >= n) & mean.between(*PADA), cut(F.array_join(some, " | "))).otherwise(choice)
    return F.when(F.size(parts) > 0, F.coalesce(choice, cut(F.element_at(parts, -1)))).otherwise("")


def tokens(text: Column) -> Column:
    """Devanagari words without brackets, quotations and punctuation."""
    text = F.regexp_replace(text, "\\([^()]{0,80}?\\)", " ")
    text = F.regexp_replace(text, "['‘`][^'‘’`]{1,80}['’`]", " ")
    text = F.regexp_replace(text, "[॥।`'’‘\".,;:\\-—|\\[\\]{}*+=<>@#$%&^~]+", " ")
    return F.regexp_extract_all(text, F.lit("[ऀ-ॿ]+"), 0)


def _key(word: str) -> str:
    """The search key of a fixed word."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).lower()


def is_candidate(iast: Column, stop: list[str] = STOP) -> Column:
    """Two letters or more, IAST only, a vowel, and no stop word."""
    keys = F.array(*[F.lit(k) for k in dict.fromkeys(map(_key, stop))])
    ok = (F.length(iast) >= 2) & iast.rlike("^[a-zāīūṛṝḷḹṃṁḥṅñṭḍṇśṣ'\\-]+\\z") & iast.rlike("[aāiīuūṛṝḷḹeo]")
    return ok & ~F.array_contains(keys, normalize(iast))


def synonyms(verse: Column, most: int = 30, stop: list[str] = STOP) -> Column:
    """Distinct search keys of a verse's candidates, in order."""
    iast = F.transform(tokens(verse), lambda t: F.regexp_replace(devanagari_to_iast(t), "^['.,\\-—|]+|['.,\\-—|]+$", ""))
    keys = F.transform(F.filter(iast, lambda w: is_candidate(w, stop)), normalize)
    return F.slice(F.array_distinct(keys), 1, most)
