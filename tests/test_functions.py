"""Scalar functions on their exact cases."""

from __future__ import annotations

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import gloss, markup, parsers, script, snippets, verse


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", function(F.col("x")).alias("y"))
    return [r["y"] for r in rows.orderBy("i").collect()]


HK = {
    "A": "ā", "I": "ī", "U": "ū", "T": "ṭ", "D": "ḍ", "N": "ṇ", "z": "ś", "S": "ṣ", "R": "ṛ", "RR": "ṝ",
    "prajJApAramitA": "prajñāpāramitā", "ajJa": "ajña", "lR": "ḷ", "lRR": "ḹ", "TIkA": "ṭīkā", "klRRpta": "kḹpta",
    "kRRSNa": "kṝṣṇa", "zAnti": "śānti", "SAnti": "ṣānti",
}
CASES = [
    (script.hk_to_iast, HK),
    (script.slp1_to_iast, {"Darma": "ḍarma", "AtmA": "ātmā"}),
    (script.devanagari_to_iast, {"धर्म": "dharma", "बोधिसत्त्व": "bodhisattva", "प्रज्ञापारमिता": "prajñāpāramitā", "संस्कृत": "saṃskṛta", "दुःख": "duḥkha", "": "", "क्ि": "kि", "ऐऔ": "aiau"}),
    (script.detect_and_convert, {"amaze": "amaze", "prajJA": "prajñā", "prajñā": "prajñā"}),
    (script.normalize, {"ā": "a", "prajñā": "prajna", "DHARMA": "dharma", "  dharma  ": "dharma", "Byang Chub": "byang chub", "般若": "般若"}),
    (script.normalize_headword, {"धर्म": "dharma", "prajJApAramitA": "prajnaparamita", "Dharma": "dharma", "zAnti": "santi", "SAnti": "santi", "mDo bzang": "mdo bsang"}),
    (script.detect_script, {"SAnti": "hk", "śānti": "iast", "般若": "cjk", "법": "korean", "법(法)": "cjk", "amaze": "iast", "byang chub sems dpa": "iast", "": "empty"}),
    (script.has_hk_signature, {"prajJA": True, "AtmA": True, "ABALA": False, "A": False, "Ātmā": False, "dharma": False, "": False}),
    (script.is_valid_iast, {"dharma": True, "prajñā": True, "Śiva": True, "brahma-sūtra": True, "धर्म": False, "法": False, "": False}),
    (script.is_valid_wylie, {"bod": True, "byang chub sems dpa'": True, "po1": True, "धर्म": False}),
    (script.normalize_whitespace, {" a  b\n\tc ": "a b c"}),
    (markup.strip_markup, {"<i>m.</i> fire": "m. fire", "<i>a</i>   <i>b</i>": "a b", "hello <i>world</i> , foo": "hello world, foo", "": "", "a &amp; b": "a & b"}),
    (markup.strip_tags, {"<b>x</b>,y &lt;z&gt;": "x,y <z>"}),
    (gloss.en_tokens, {"": [], "fire; the god of fire; sacrificial fire": ["fire", "god", "sacrificial"]}),
    (gloss.ko_tokens, {"": [], "법(法); 규범, 조례 law": ["法", "규범", "법", "조례"]}),
    (parsers.is_wylie_headword, {"byang chub": True, "example": False, "Byang": False, "a, b": False}),
    (parsers.is_han_headword, {"般若": True, "般若般若般若般": False, "a": False}),
    (parsers.sanskrit_terms, {"akheda, niyati-pata； abc": ["akheda", "niyati-pata", "abc"], " , a": []}),
    (parsers.sanskrit_word, {"xx dharmā law": "dharmā", "ab": None}),
    (parsers.citation_terms, {"K.12.3.dharmaparyāya~; O.5.sutra, Pk.1.ab;": ["dharmaparyāya", "sutra"]}),
    (parsers.is_japanese_continuation, {"仏の教え": True, "ab 仏": False}),
    (parsers.is_german_continuation, {"a b c d": True, "abc": False, "vgl. x": True, "x" * 51: True}),
    (lambda c: F.to_json(parsers.four_languages(c)), {
        "12 佛 ཨ buddhāḥ the awakened": '{"zh":"佛","tib":"ཨ","skt":"buddhāḥ","en":"the awakened"}',
        "法 law": '{"zh":"法","tib":"","skt":"","en":"law"}', "法 ཆོས": '{"zh":"法","tib":"ཆོས","skt":"","en":""}', "no": None,
    }),
    (verse.tokens, {"अमर (१.२) 'x' देव।": ["अमर", "देव"]}),
    (verse.synonyms, {"अमराः देवाः च देवाः तु त्रि": ["amarah", "devah", "tri"]}),
    (verse.clean_page, {"देवदेव\n12\nPage English text\n१. क. पाठः\nअमर": "देवदेव\nअमर"}),
    (verse.root_verse, {"टीका। अमरा निर्जरा देवाः। त्रिदशा विबुधाः सुराः ॥७॥": "अमरा निर्जरा देवाः | त्रिदशा विबुधाः सुराः", "": "", "ab ॥": ""}),
    (parsers.pinyin, {"(fǎ huá)": "fǎ huá", "(法華經)": None}),
]


@pytest.mark.parametrize("function,cases", CASES, ids=[f"{k}-{f.__name__}" for k, (f, _) in enumerate(CASES)])
def test_exact(function, cases, spark):
    got = apply(spark, function, list(cases))
    assert dict(zip(cases, got, strict=True)) == cases


def test_null_stays_quiet(spark):
    for function in (script.hk_to_iast, script.normalize, script.normalize_headword, script.devanagari_to_iast):
        assert apply(spark, function, [None]) == [None]
    assert apply(spark, gloss.en_tokens, [None]) == [[]]
    assert apply(spark, markup.strip_markup, [None]) == [""]


def _fold(s):
    kept = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return kept.lower().strip()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0xFFFF, exclude_categories=["Cs", "Cn", "Co"]), max_size=12), min_size=200, max_size=200))
def test_normalize_like_unicode(spark, texts):
    # letters whose lower case is of another length follow Java's rules
    texts = [t for t in texts if not any(len(c.lower()) != 1 or c in "Σ" for c in t)]
    assert apply(spark, script.normalize, texts) == [_fold(t) for t in texts]


def test_hangul_becomes_jamo(spark):
    assert apply(spark, script.normalize, ["법", "가나"]) == [unicodedata.normalize("NFD", "법"), unicodedata.normalize("NFD", "가나")]


def _tokens(text):
    import re

    best = {}
    for m in re.finditer("[a-zA-Z]{2,}", text):
        w = 1.0 if m.start() < 30 else 0.7 if m.start() < 100 else 0.4
        t = m[0].lower()
        if t not in gloss.STOPWORDS:
            best[t] = max(best.get(t, 0), w)
    return sorted(best, key=lambda t: (-best[t], t))[:20]


def test_tokens_by_offsets(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", gloss.en_tokens(F.col("text")).alias("t")).collect()
    assert all(r["t"] == _tokens(r["text"]) for r in rows)


def test_snippet_bounds(spark):
    assert snippets.boundaries("") == [0]
    assert snippets.pair("fire") == ("fire", "fire")
    short, medium = snippets.pair("x" * 600)
    assert len(short) <= 180 and len(medium) <= 500 and short.endswith("…")
    text = "one thing; " * 80
    short, medium = snippets.pair(text)
    assert 110 <= len(short) <= 180 and 390 <= len(medium) <= 500 and not short.endswith(";")
    got = apply(spark, lambda c: snippets.snippets(c)["short"], ["fire", text, None, "x" * 600])
    assert got == ["fire", short, "", snippets.pair("x" * 600)[0]]


def test_abbreviations_are_no_boundary():
    text = "see cf. Apte for more. Then go on"
    assert [text[b:] for b in snippets.boundaries(text)[:-1]] == ["Then go on"]


def test_senses(spark):
    apte = r"\s-\s?(\d+)\s"
    text = "fire -2 the god -3 sacrificial -4 bile"
    assert snippets.split_senses(text, apte) == [("1", "fire"), ("2", "the god"), ("3", "sacrificial"), ("4", "bile")]
    assert snippets.split_senses("a; b; c", ";") == [("1", "a"), ("1", "b"), ("2", "c")]
    assert snippets.split_senses("flat text") == [] and snippets.split_senses("") == [] and snippets.split_senses("a", "(") == []
    rows = apply(spark, snippets.senses, ["x 1. a 2. b", "none", None])
    assert [[(s["num"], s["text"]) for s in r] for r in rows] == [[("1", "x"), ("1", "a"), ("2", "b")], [], []]


def test_stray_text_before_first_case_shifts_the_grid(spark):
    grid = apply(spark, gloss.declension_grid, ["Singular Dual Plural junk Nominative a b c"])[0]
    assert grid["cases"][0]["name"] == "junk "


def test_rest_of_languages(spark):
    rows = spark.createDataFrame([("tib-x", None), ("pali-english", "en"), ("apte", "en"), ("a", "bo")], "d string, t string")
    assert [r[0] for r in rows.select(gloss.entry_lang(F.col("d"), F.col("t"))).collect()] == ["bo", "pi", "sa", "bo"]


def test_wylie_backfill(spark):
    rows = spark.createDataFrame([("བོད", "", "", "Tib unicode unconverted"), ("།", "", "", "n"), ("།", "x", "y", "n")], "h string, i string, n string, note string")
    got = rows.select(parsers.with_wylie(F.col("h"), F.col("i"), F.col("n"), F.col("note")).alias("x")).select("x.*").collect()
    assert [(r["iast"], r["norm"], r["tib_wylie"]) for r in got] == [("bod", "bod", "bod"), ("།", "།", None), ("x", "y", None)]
    assert got[0]["note"] != "Tib unicode unconverted" and got[1]["note"] == "n"


def test_record_filters_and_labels(spark):
    one = spark.createDataFrame([("ཆོས", "法律", "", ["translation-san"])], "tib string, zh string, skt string, tags array<string>")
    c = F.col
    got = one.select(
        parsers.kept("tib_zh", tib=c("tib"), zh=c("zh")), parsers.kept("four", zh=c("zh"), skt=c("skt"), en=c("skt")), parsers.kept("tagged", tags=c("tags")),
        parsers.kept("tibetan", tib=c("tib")), parsers.kept("glossary", pinyin=c("skt"), skt=c("skt"), en=c("zh")), parsers.source_label(c("zh"), {"x": "X"}),
    ).collect()[0]
    assert list(got) == [True, False, True, True, True, "法律"]


def test_snippets_of_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", snippets.snippets(F.col("text")).alias("s")).collect()
    assert all((r["s"]["short"], r["s"]["medium"]) == snippets.pair(r["text"]) for r in rows)


def test_scanned_spellings_and_han_division(spark):
    assert apply(spark, script.clean_ocr_iast, [" ‘a’  “b” ", None]) == ["'a' \"b\"", None]
    assert apply(spark, script.clean_iast, [" dharma  kāya,.;", "a."]) == ["dharma kāya", "a"]
    got = apply(spark, parsers.tib_zh, ["chos 法 dharma", "bod", "法"])
    assert [(r["tib"], r["zh"]) for r in got] == [("chos", "法 dharma"), ("bod", ""), ("", "法")]


def test_representative_synonym(spark):
    from lexweave.operators import extract

    rows = spark.createDataFrame([(["ab", "amara", "'deva"],), ([],), (["sura", "suru"],)], "k array<string>")
    assert [r[0] for r in rows.select(extract.representative(rows["k"])).collect()] == ["amara", "", "sura"]


def test_standard_senses_match_the_scanner(spark):
    texts = ["a 1. b 2 c", "1 x 2. y -3 z", "-2 -3a. q", "none", "", "1 only", " 1.  2. \n3. end", "x 12b. y 3\u00a0z"]
    got = apply(spark, snippets.standard_senses, texts)
    assert [[(x["num"], x["text"]) for x in r] for r in got] == [snippets.split_senses(t) for t in texts]


def test_parsed_and_cut_tables(spark, sf_dir):
    """Queries without SQL, row by row in Python."""
    import difflib

    from lexweave.plans import catalog

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in catalog.QUERIES["parsed_markup_pages"](spark, sf_dir).collect():
        text = re.sub(r"[ \t\u00a0]+", " ", markup.plain_text(pages[r["page_id"]], True))
        text = re.sub(r"\s+([,;.:])", r"\1", re.sub(r"\n{2,}", "\n", text)).strip()
        assert r["plain"] == text
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in catalog.QUERIES["snippets_of_documents"](spark, sf_dir).collect():
        assert (r["short"], r["medium"]) == snippets.pair(docs[r["doc_id"]]["text"] or "")
    made = catalog.QUERIES["made_entries"](spark, sf_dir).collect()
    heads = {f"{d['source']}-{d['doc_id']:06d}": (m[0], d["text"]) for d in docs.values() if d["text"] and d["source"] and (m := re.search("[A-Za-zÀ-ÿ]+", d["text"]))}
    assert {r["id"]: r["headword"] for r in made} == {k: v[0] for k, v in heads.items()}
    first = {}
    for d in sorted(docs.values(), key=lambda d: d["doc_id"]):
        if d["text"] is not None and d["source"] in ("src0", "src1"):
            m = re.search("[A-Za-zÀ-ÿ]+", d["text"])
            first.setdefault((d["source"], m[0] if m else ""), d["text"])
    for r in catalog.QUERIES["body_similarity"](spark, sf_dir).collect():
        a, b = (next(t for (s, w), t in first.items() if s == src and _plain(w) == r["headword_norm"]) for src in ("src0", "src1"))
        assert abs(r["similarity"] - difflib.SequenceMatcher(None, a.strip()[:2000], b.strip()[:2000]).ratio()) < 1e-12


def _plain(word):
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).lower()
