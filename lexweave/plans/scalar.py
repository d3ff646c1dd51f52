"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gloss, markup, parsers, script, snippets, verse
from ..operators import extract, search
from . import standin
from .registry import collector, values

QUERIES, ORACLE, query = collector()

_HK = "translate(replace(replace(replace(replace(replace(replace({0}, 'lRR', 'ḹ'), 'lR', 'ḷ'), 'RR', 'ṝ'), 'Th', 'ṭh'), 'Dh', 'ḍh'), '~n', 'ñ'), 'AIURMHGJTDNzS', 'āīūṛṃḥṅñṭḍṇśṣ')"
_SLP = "translate({0}, 'AIURLMHGJTDNSz~', 'āīūṛḷṃḥṅñṭḍṇṣśñ')"
_STRIP = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
_IS_HK = "(regexp_matches({0}, '[AIUTDNSGJRMH]') AND regexp_matches({0}, '\\p{{Ll}}') AND NOT regexp_matches({0}, '[āīūṛṝḷḹṃḥṅñṭḍṇśṣ]'))"
_head = "regexp_extract(text, '[A-Za-zÀ-ÿ]+')"


# --- script ----------------------------------------------------------------------
@query(f"SELECT doc_id, {_HK.format('text')} AS iast FROM documents")
def hk_to_iast(spark, sf_dir):
    return standin.table(spark, sf_dir, "documents").select("doc_id", script.hk_to_iast(F.col("text")).alias("iast"))


@query(f"SELECT doc_id, {_SLP.format('text')} AS iast FROM documents")
def slp1_to_iast(spark, sf_dir):
    return standin.table(spark, sf_dir, "documents").select("doc_id", script.slp1_to_iast(F.col("text")).alias("iast"))


@query(f"SELECT doc_id, lower(strip_accents({_STRIP.format('text')})) AS norm FROM documents")
def script_normalize(spark, sf_dir):
    return standin.table(spark, sf_dir, "documents").select("doc_id", script.normalize(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, lower(strip_accents(CASE WHEN {_IS_HK.format('h')} THEN {_HK.format('h')} ELSE h END)) AS norm FROM (SELECT doc_id, {_head} AS h FROM documents)")
def normalize_headword(spark, sf_dir):
    head = F.regexp_extract("text", standin.WORD, 0)
    return standin.table(spark, sf_dir, "documents").select("doc_id", script.normalize_headword(head).alias("norm"))


WORDS = [
    (1, "धर्म", "dharma"), (2, "बोधिसत्त्व", "bodhisattva"), (3, "प्रज्ञापारमिता", "prajñāpāramitā"), (4, "संस्कृत", "saṃskṛta"),
    (5, "दुःख", "duḥkha"), (6, "", ""), (7, "ॐ।", "oṃ|"), (8, "अ१२", "a12"), (9, "क़ि", "kaि"), (10, "abc", "abc"),
]


@query(f"SELECT id::INT AS id, iast FROM {values(WORDS)} t(id, deva, iast)")
def devanagari_to_iast(spark, sf_dir):
    return spark.createDataFrame(WORDS, "id int, deva string, want string").select("id", script.devanagari_to_iast(F.col("deva")).alias("iast"))


TIBETAN = [(1, "བཀའ་བཐམ།", "bk' bthma"), (2, "བོད", "bod"), (3, "ཆོས་", "chos"), (4, "", ""), (5, "ཀ༠", "k?0f20")]


@query(f"SELECT id::INT AS id, wylie FROM {values([(k, w) for k, _, w in TIBETAN])} t(id, wylie)")
def tibetan_to_wylie(spark, sf_dir):
    return spark.createDataFrame(TIBETAN, "id int, tib string, x string").select("id", script.tibetan_to_wylie(F.col("tib")).alias("wylie"))


KINDS = [(1, "SAnti", "hk"), (2, "śānti", "iast"), (3, "般若", "cjk"), (4, "법", "korean"), (5, "법(法)", "cjk"), (6, "amaze", "iast"), (7, "byang chub", "iast"), (8, "धर्म", "devanagari"), (9, "", "empty")]


@query(f"SELECT id::INT AS id, script FROM {values(KINDS)} t(id, s, script)")
def detect_script(spark, sf_dir):
    return spark.createDataFrame(KINDS, "id int, s string, x string").select("id", script.detect_script(F.col("s")).alias("script"))


#: Latin letters as Devanagari, Hangul and Han ones, so that script detection meets all of them.
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_DEVA_LETTERS = "कखगघङचछजझञटठडढणतथदधनपफबभमय"
_HANGUL = "가나다라마바사아자차카타파하거너더러머버서어저처커터"
_HAN = "一丁七万丈三上下不与丑专且世丘丙业丛东丝丞两严丧个中"
_SCRIPTED = "CASE doc_id % 5 WHEN 0 THEN translate(text, '{0}', '{1}') WHEN 1 THEN translate(text, '{0}', '{2}') WHEN 2 THEN translate(text, '{0}', '{3}') ELSE text END".format(_LATIN, _DEVA_LETTERS, _HANGUL, _HAN)


@query(
    f"""SELECT doc_id, CASE WHEN coalesce(trim(t), '') = '' THEN 'empty' WHEN regexp_matches(t, '[ऀ-ॿ]') THEN 'devanagari' WHEN regexp_matches(t, '[一-鿿]') THEN 'cjk'
  WHEN regexp_matches(t, '[가-힣]') THEN 'korean' WHEN {_IS_HK.format("t")} THEN 'hk' ELSE 'iast' END AS script FROM (SELECT doc_id, {_SCRIPTED} AS t FROM documents)"""
)
def detect_script_of_documents(spark, sf_dir):
    return standin.table(spark, sf_dir, "documents").select("doc_id", script.detect_script(F.expr(_SCRIPTED)).alias("script"))


@query(
    f"""SELECT doc_id, coalesce(regexp_matches(h, '^[a-zA-ZāīūṛṝḷḹṃḥṅñṭḍṇśṣṁĀĪŪṚṜḶḸṂṀḤṄÑṬḌṆŚṢ ''\\-.,()/|]+$'), false) AS iast, coalesce(regexp_matches(h, '^[a-zA-Z0-9 ''\\-.,()/|_+]+$'), false) AS wylie,
  {_IS_HK.format("h")} AS hk FROM (SELECT doc_id, text AS h FROM documents)"""
)
def valid_forms(spark, sf_dir):
    h = F.col("text")
    return standin.table(spark, sf_dir, "documents").select("doc_id", script.is_valid_iast(h).alias("iast"), script.is_valid_wylie(h).alias("wylie"), script.has_hk_signature(h).alias("hk"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents")
def normalize_whitespace(spark, sf_dir):
    return standin.table(spark, sf_dir, "documents").select("doc_id", script.normalize_whitespace(F.col("text")).alias("flat"))


@query("SELECT doc_id, replace(translate(text, 'äöüÄÖÜ', 'āōūĀŌŪ'), 'ß', 'ss') AS iast FROM documents")
def umlauts_to_iast(spark, sf_dir):
    return standin.table(spark, sf_dir, "documents").select("doc_id", script.umlauts_to_iast(F.col("text")).alias("iast"))


# --- markup ---------------------------------------------------------------------
_tags = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _e, _c in markup.ENTITIES:
    _tags = f"replace({_tags}, '{_e.replace(chr(39), chr(39) * 2)}', '{_c.replace(chr(39), chr(39) * 2)}')"
_clean = f"regexp_replace(regexp_replace({_tags}, '[ \\t\u00a0]+', ' ', 'g'), '\\n{{2,}}', chr(10), 'g')"


@query(f"SELECT page_id, trim(regexp_replace({_clean}, '\\s+([,;.:])', '\\1', 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS plain FROM pages")
def strip_markup_pages(spark, sf_dir):
    return standin.table(spark, sf_dir, "pages").select("page_id", markup.strip_tags(F.col("html")).alias("plain"))


@query()
def parsed_markup_pages(spark, sf_dir):
    """Parser-based text; the parser has no SQL form."""
    return standin.table(spark, sf_dir, "pages").select("page_id", markup.strip_markup(F.col("html"), spaced=True).alias("plain"))


@query()
def snippets_of_documents(spark, sf_dir):
    """Cut points need look-behind and offsets, which the oracle lacks."""
    cut = snippets.snippets(F.col("text"))
    return standin.table(spark, sf_dir, "documents").withColumn("cut", cut).select("doc_id", "cut.short", "cut.medium")


_MARKS = "regexp_extract_all(body, ' (\\d+)\\. ', 1)"
_PARTS = "string_split_regex(body, ' \\d+\\. ')"


@query(
    f"""WITH b AS (SELECT doc_id, replace(replace(text, ', ', ' 1. '), '. ', ' 2. ') AS body FROM documents),
s AS (SELECT doc_id, {_MARKS} AS m, {_PARTS} AS p FROM b),
r AS (SELECT doc_id, i AS ord, CASE WHEN i = 1 THEN '1' ELSE m[i - 1] END AS num, trim(p[i], ' ' || chr(10)) AS text FROM s, range(1, len(p) + 1) AS g(i) WHERE len(m) >= 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1)::INT AS pos, num, text FROM r WHERE text <> ''"""
)
def senses_of_documents(spark, sf_dir):
    d = standin.table(spark, sf_dir, "documents")
    body = F.replace(F.replace("text", F.lit(", "), F.lit(" 1. ")), F.lit(". "), F.lit(" 2. "))
    found = d.withColumn("sep", F.lit(" (\\d+)\\. ")).select("doc_id", F.posexplode(snippets.senses(body, F.col("sep"))).alias("pos", "x"))
    return found.select("doc_id", "pos", "x.num", "x.text")


_CUT = "CASE WHEN instr(h, {0}) > 1 THEN substr(h, 1, instr(h, {0}) - 1) ELSE h END"
_cut_sql = "SELECT doc_id, trim(text) AS h FROM documents"
for _mark in ("chr(10)", "chr(9)", "chr(13)", "'{'", "'<'"):
    _cut_sql = f"SELECT doc_id, {_CUT.format(_mark)} AS h FROM ({_cut_sql})"


@query(f"SELECT doc_id, {_STRIP.format('h')} AS head FROM ({_cut_sql})")
def clean_headwords(spark, sf_dir):
    return standin.table(spark, sf_dir, "documents").select("doc_id", extract.clean_headword(F.trim("text")).alias("head"))


# --- tags, grids, parsers ------------------------------------------------------------
_KINDS = "CASE doc_id % 5 WHEN 0 THEN 'tib-' || source WHEN 1 THEN source || '-pali' WHEN 2 THEN 'pali-' || source ELSE source END"
_TARGETS = "CASE lang WHEN 'de' THEN 'bo' WHEN 'es' THEN 'pi' WHEN 'fr' THEN NULL ELSE lang END"


@query(
    f"""SELECT doc_id, CASE WHEN target IN ('bo', 'pi') THEN target WHEN starts_with(slug, 'tib-') THEN 'bo'
  WHEN contains(slug, '-pali') OR contains(slug, 'pali-') THEN 'pi' ELSE 'sa' END AS lang FROM (SELECT doc_id, {_KINDS} AS slug, {_TARGETS} AS target FROM documents)"""
)
def entry_languages_of_documents(spark, sf_dir):
    d = standin.table(spark, sf_dir, "documents").select("doc_id", F.expr(_KINDS).alias("slug"), F.expr(_TARGETS).alias("target"))
    return d.select("doc_id", gloss.entry_lang(F.col("slug"), F.col("target")).alias("lang"))


SLUGS = [(1, "tib-a", "en"), (2, "pali-english", "en"), (3, "apte", "en"), (4, "x", "bo"), (5, "x", "pi"), (6, "en-pali", None)]
_SLUG_LANGS = [(1, "bo"), (2, "pi"), (3, "sa"), (4, "bo"), (5, "pi"), (6, "pi")]


@query(f"SELECT id::INT AS id, lang FROM {values(_SLUG_LANGS)} t(id, lang)")
def entry_languages(spark, sf_dir):
    return spark.createDataFrame(SLUGS, "id int, slug string, target string").select("id", gloss.entry_lang(F.col("slug"), F.col("target")).alias("lang"))


_DEVA = "Declension table of [Mas.] deva Masculine\nSingular Dual Plural\nNominativedevaḥ devau devāḥ\nVocative deva devau devāḥ Accusative devam devau devān Instrumental devena"
GRIDS = [(1, _DEVA), (2, "Singular Dual Plural Nominative a b c d"), (3, "Nominative a b c"), (4, "Singular  Dual\nPlural nothing")]
_GRID_ROWS = [
    (1, "Masculine", 0, "Nominative", "devaḥ|devau|devāḥ"), (1, "Masculine", 1, "Vocative", "deva|devau|devāḥ"), (1, "Masculine", 2, "Accusative", "devam|devau|devān"),
    (1, "Masculine", 3, "Instrumental", "devena|—|—"), (2, "Unknown", 0, "Nominative", "a|b|c"),
]


@query(f"SELECT id::INT AS id, gender, pos::INT AS pos, name, forms FROM {values(_GRID_ROWS)} t(id, gender, pos, name, forms)")
def declension_grid(spark, sf_dir):
    g = spark.createDataFrame(GRIDS, "id int, body string").withColumn("g", gloss.declension_grid(F.col("body"))).where("g is not null")
    return g.select("id", "g.gender", F.posexplode("g.cases").alias("pos", "c")).select("id", "gender", "pos", "c.name", F.array_join("c.forms", "|").alias("forms"))


LINES = [(1, "chos 法 dharma"), (2, "sangs rgyas 佛 陀 buddha"), (3, "no han here"), (4, "法")]
_LINE_PARTS = [(1, "chos", "法", "dharma"), (2, "sangs rgyas", "佛 陀", "buddha"), (3, None, None, None), (4, "", "法", "")]


@query(f"SELECT id::INT AS id, tib, zh, skt FROM {values(_LINE_PARTS)} t(id, tib, zh, skt)")
def split_lines(spark, sf_dir):
    rows = spark.createDataFrame(LINES, "id int, line string").withColumn("x", parsers.tib_zh_skt(F.col("line")))
    return rows.select("id", "x.tib", "x.zh", "x.skt")


PARAGRAPHS = [(1, "* chos\tlaw [dharma], 법 duty;"), (2, "- sub  gloss here"), (3, "ex. an example"), (4, "plain"), (5, "* alone")]
_PARAGRAPH_PARTS = [(1, "main", "chos", "dharma", "law ,  duty", "법"), (2, "sub", "sub", "", "gloss here", ""), (3, "ex", None, None, None, None), (4, None, None, None, None, None), (5, None, None, None, None, None)]


@query(f"SELECT id::INT AS id, kind, tibetan, sanskrit, english, korean FROM {values(_PARAGRAPH_PARTS)} t(id, kind, tibetan, sanskrit, english, korean)")
def marked_paragraphs(spark, sf_dir):
    rows = spark.createDataFrame(PARAGRAPHS, "id int, p string").withColumn("x", parsers.marked_paragraph(F.col("p")))
    return rows.select("id", "x.kind", "x.tibetan", "x.sanskrit", "x.english", "x.korean")


_TERM = "list_filter(list_transform(string_split_regex(trim(text), '[;,]+'), lambda p: regexp_replace(p, '^[\\s\"“”‘’''.*　]+|[\\s.*\"　]+$', '', 'g')), lambda p: length(p) >= 2 AND regexp_matches(p, '[a-zA-Zāīūṛṝḷḹṃḥṅñṭḍṇśṣ]'))"


@query(f"SELECT doc_id, len({_TERM}) AS n, array_to_string({_TERM}, '|') AS terms FROM documents")
def sanskrit_terms(spark, sf_dir):
    d = extract.once(standin.table(spark, sf_dir, "documents"), "terms", parsers.sanskrit_terms(F.col("text")))
    return d.select("doc_id", F.size("terms").cast("long").alias("n"), F.array_join("terms", "|").alias("terms"))


@query(
    """SELECT p_partkey, coalesce(regexp_matches(trim(p_name), '^[a-z'' ./;\\-]{1,100}$') AND trim(p_name) <> 'example', false) AS wylie,
  regexp_matches(trim(p_name), '^[a-zA-Z][a-zA-Z\\s\\-,;:.()/\\d]*$') AS english, length(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) > 3 AS continues FROM part"""
)
def headword_shapes(spark, sf_dir):
    name = F.col("p_name")
    return standin.table(spark, sf_dir, "part").select(
        "p_partkey", parsers.is_wylie_headword(name).alias("wylie"), parsers.is_english_continuation(name).alias("english"), parsers.is_sanskrit_continuation(name).alias("continues")
    )


_some = "coalesce({})".format
_nul = "nullif(trim({}), '')".format


@query(
    f"""SELECT ord, {_some(", ".join(map(_nul, ("tib_wylie", "skt_iast", "zh"))))} AS headword,
  concat_ws(' · ', CASE WHEN trim(skt_iast) <> '' THEN 'Skt: ' || trim(skt_iast) END, CASE WHEN trim(tib_wylie) <> '' THEN 'Tib: ' || trim(tib_wylie) END,
    CASE WHEN trim(zh) <> '' THEN 'Zh: ' || trim(zh) END, CASE WHEN trim(category) NOT IN ('', '.') THEN '(' || trim(category) || ')' END, CASE WHEN ord % 100 < 70 THEN '[OCR conf ' || (ord % 100) || ']' END) AS plain
FROM (SELECT p_name AS skt_iast, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS tib_wylie, CASE WHEN p_size % 7 = 0 THEN p_type END AS zh, CASE WHEN p_size % 2 = 0 THEN p_type END AS category, p_partkey AS ord FROM part)"""
)
def equivalent_entries(spark, sf_dir):
    r = standin.equivalent_rows(spark, sf_dir)
    none = F.lit(None).cast("string")
    head = parsers.primary(F.lit("bo"), F.col("skt_iast"), F.col("tib_wylie"), F.col("zh"), none, none)
    plain = parsers.composed_plain(F.col("skt_iast"), F.col("tib_wylie"), F.col("zh"), F.col("category"), (F.col("ord") % 100).cast("double"))
    return r.select("ord", head["headword"].alias("headword"), plain.alias("plain"))


NOTES = [(1, "ja: 法", None), (2, "de: x", None), (3, "plain", "y")]


@query(f"SELECT id::INT AS id, ja, note FROM {values([(1, '法', 'moved'), (2, None, 'de: x'), (3, 'y', 'plain')])} t(id, ja, note)")
def moved_notes(spark, sf_dir):
    rows = spark.createDataFrame(NOTES, "id int, note string, ja string").withColumn("e", F.struct("ja", "note"))
    return rows.withColumn("e", parsers.moved_note(F.col("e"), "ja:", "ja", "moved")).select("id", "e.ja", "e.note")


FOUR = [(1, "12 佛 ཨ buddhāḥ the awakened"), (2, "法 law"), (3, "法 ཆོས"), (4, "no")]
_FOUR = [(1, "佛", "ཨ", "buddhāḥ", "the awakened"), (2, "法", "", "", "law"), (3, "法", "ཆོས", "", ""), (4, None, None, None, None)]


@query(f"SELECT id::INT AS id, zh, tib, skt, en FROM {values(_FOUR)} t(id, zh, tib, skt, en)")
def four_language_lines(spark, sf_dir):
    rows = spark.createDataFrame(FOUR, "id int, line string").withColumn("x", parsers.four_languages(F.col("line")))
    return rows.select("id", "x.zh", "x.tib", "x.skt", "x.en")


CITED = [(1, "K.12.3.dharmaparyāya~; O.5.sutra, Pk.1.ab;"), (2, "none")]


@query(f"SELECT id::INT AS id, terms FROM {values([(1, 'dharmaparyāya|sutra'), (2, '')])} t(id, terms)")
def citation_terms(spark, sf_dir):
    return spark.createDataFrame(CITED, "id int, line string").select("id", F.array_join(parsers.citation_terms(F.col("line")), "|").alias("terms"))


@query(
    r"""SELECT doc_id, length(h) > 50 OR regexp_matches(h, '^[FCM]\s+SHT\s+\d|^[mn]\.nom\.sg\.|^abs\.|^vgl\.') OR length(h) - length(replace(h, ' ', '')) >= 3 AS german,
  length(regexp_replace(h, '[^぀-ヿ一-鿿]', '', 'g')) > 2 AS japanese, regexp_matches(h, '^[㐀-䶿一-鿿豈-﫿]{1,6}$') AS han
FROM (SELECT doc_id, trim(string_split(text, chr(10))[1], ' ' || chr(13) || chr(9)) AS h FROM documents)"""
)
def continuation_shapes(spark, sf_dir):
    line = F.get(F.split("text", "\n"), 0)
    return standin.table(spark, sf_dir, "documents").select(
        "doc_id", parsers.is_german_continuation(line).alias("german"), parsers.is_japanese_continuation(line).alias("japanese"), parsers.is_han_headword(line).alias("han")
    )


PINYIN = [(1, "(fǎ huá)"), (2, "(法華經)"), (3, "“the lotus”")]


@query(f"SELECT id::INT AS id, pinyin, english FROM {values([(1, 'fǎ huá', None), (2, None, None), (3, None, 'the lotus')])} t(id, pinyin, english)")
def glossary_lines(spark, sf_dir):
    return spark.createDataFrame(PINYIN, "id int, line string").select("id", parsers.pinyin(F.col("line")).alias("pinyin"), parsers.quoted_english(F.col("line")).alias("english"))


PARSED = [(1, "ཆོསལ", "法律", "dharma", None, None), (2, "ཆོ", "法律", None, "law", None), (3, None, None, None, None, None), (4, "bod", "法", "", "", "fǎ")]
_KEPT = [(1, True, True, True, True), (2, False, True, True, True), (3, False, False, False, False), (4, False, False, False, True)]


@query(f"SELECT id::INT AS id, tib_zh, four, tibetan, glossary FROM {values([(k, *(x for x in r)) for k, *r in _KEPT])} t(id, tib_zh, four, tibetan, glossary)")
def record_filters(spark, sf_dir):
    c = {n: F.col(n) for n in ("tib", "zh", "skt", "en", "pinyin")}
    rows = spark.createDataFrame(PARSED, "id int, tib string, zh string, skt string, en string, pinyin string")
    return rows.select("id", *[parsers.kept(k, **c).alias(k) for k in ("tib_zh", "four", "tibetan", "glossary")])


BACKFILL = [(1, "བོད", "", "", "Tib unicode unconverted"), (2, "།", "", "", "n"), (3, "།", "x", "y", "n")]
_BACKFILLED = [(1, "bod", "bod", "bod", "Wylie = letter by letter"), (2, "།", "།", None, "n"), (3, "x", "y", None, "n")]


@query(f"SELECT id::INT AS id, iast, norm, tib_wylie, note FROM {values(_BACKFILLED)} t(id, iast, norm, tib_wylie, note)")
def wylie_backfill(spark, sf_dir):
    rows = spark.createDataFrame(BACKFILL, "id int, h string, i string, n string, note string")
    return rows.select("id", parsers.with_wylie(F.col("h"), F.col("i"), F.col("n"), F.col("note")).alias("x")).select("id", "x.*")


@query("SELECT DISTINCT source AS slug, CASE source WHEN 'src1' THEN 'One' WHEN 'src2' THEN 'Two' ELSE source END AS label FROM documents")
def source_labels(spark, sf_dir):
    d = standin.table(spark, sf_dir, "documents").select(F.col("source").alias("slug")).distinct()
    return d.select("slug", parsers.source_label(F.col("slug"), {"src1": "One", "src2": "Two"}).alias("label"))


INFLECTED = [("deva", "deva", "[Mas.] deva Masculine Singular Dual Plural Nominative devaḥ devau devāḥ", "h"), ("deva", "deva", "plain", "h")]


@query(f"SELECT qid::INT AS qid, gender, raw FROM {values([(1, 'Masculine', None), (1, None, 'plain')])} t(qid, gender, raw)")
def declension_lookup(spark, sf_dir):
    index = spark.createDataFrame(INFLECTED, "norm string, iast string, body string, dict string")
    asked = spark.createDataFrame([(1, "देव"), (2, "x"), (3, "")], "qid int, raw string")
    return search.declension_lookup(asked, index).select("qid", "grid.gender", "raw")


# --- folds ---------------------------------------------------------------------------
_NUMBERS = [1, None, 5, 12, 13, 2, 3, 14, 4, 30, 1]
_CHAPTERS = [1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 3]


@query(f"SELECT pos::INT AS pos, chapter::INT AS chapter FROM {values([(k, c) for k, c in enumerate([1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 3])])} t(pos, chapter)")
def verse_chapters(spark, sf_dir):
    rows = spark.createDataFrame([(_NUMBERS,)], "n array<int>")
    return rows.select(F.posexplode(extract.chapters(F.col("n"))).alias("pos", "chapter"))


STREAM = "मूल प्रथम ॥१॥ द्वितीय श्लोक ॥ २ ॥ ॥३॥ तृतीय ॥१०॥ शेष"
_VERSES = [(0, 1, "मूल प्रथम"), (1, 2, "द्वितीय श्लोक"), (2, 10, "तृतीय")]


@query(f"SELECT pos::INT AS pos, number::INT AS number, text FROM {values(_VERSES)} t(pos, number, text)")
def verse_split(spark, sf_dir):
    rows = spark.createDataFrame([(STREAM,)], "s string").select(F.posexplode(extract.verses(F.col("s"))).alias("pos", "v"))
    return rows.select("pos", "v.number", "v.text")


_SCORE = "CASE WHEN length(w) < 3 THEN -10.0 ELSE -abs(length(w) - 6) * 0.3 + ((length(w) - length(regexp_replace(w, '[aāiīuūṛṝḷḹeo]', '', 'g'))) / length(w)::DOUBLE - 0.3) * 5 END"


@query(
    f"""WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
u AS (SELECT doc_id, i, ws[i] AS w FROM w, range(1, len(ws) + 1) AS g(i) WHERE regexp_matches(ws[i], '^[a-z]+$'))
SELECT doc_id, arg_max(w, struct_pack(s := round({_SCORE}, 9), i := -i)) AS head FROM u GROUP BY 1"""
)
def representative_synonyms(spark, sf_dir):
    words = F.filter(F.split("text", " "), lambda w: w.rlike("^[a-z]+\\z"))
    rows = standin.table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where("size(w) > 0")
    ranked = F.transform("w", lambda k, i: F.struct(F.round(extract.representative_score(k), 9).alias("score"), (-i).alias("less"), k.alias("key")))
    return rows.select("doc_id", F.array_max(ranked)["key"].alias("head"))


PAGES = [(1, "देवदेव\n12\nPage English text\n१. क. पाठः\nअमर"), (2, "only english"), (3, "")]


@query(f"SELECT id::INT AS id, replace(body, '/', chr(10)) AS body FROM {values([(1, 'देवदेव/अमर'), (2, ''), (3, '')])} t(id, body)")
def cleaned_pages(spark, sf_dir):
    return spark.createDataFrame(PAGES, "id int, text string").select("id", verse.clean_page(F.col("text")).alias("body"))


CHUNKS = [(1, "टीका। अमरा निर्जरा देवाः। त्रिदशा विबुधाः सुराः ॥७॥"), (2, "")]
_ROOTS = [(1, "अमरा निर्जरा देवाः | त्रिदशा विबुधाः सुराः", "amara|nirjara|devah|tridasa|vibudhah|surah", "surah"), (2, "", "", "")]


@query(f"SELECT id::INT AS id, root, keys FROM {values([r[:3] for r in _ROOTS])} t(id, root, keys)")
def verse_synonyms(spark, sf_dir):
    rows = spark.createDataFrame(CHUNKS, "id int, chunk string").withColumn("root", verse.root_verse(F.col("chunk")))
    return rows.select("id", "root", F.array_join(verse.synonyms(F.col("root")), "|").alias("keys"))
