"""Queries that build and probe lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.gloss import STOPWORDS, en_tokens, ko_tokens
from ..functions.script import normalize
from ..operators import build, search
from ..sources import sinks
from . import standin
from .registry import collector, values
from .standin import ENTRIES_SQL, EQUIV_SQL, FREQUENCY_SQL, with_sql

QUERIES, ORACLE, query = collector()
TOP = 1000

_stop = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _begin(n: int) -> str:
    head = f"substr(plain, 1, {n})"
    return f"CASE WHEN regexp_matches({head}, '[a-zA-Z]$') THEN {head} || regexp_extract(substr(plain, {n + 1}), '^[a-zA-Z]*') ELSE {head} END"


def _tok(text: str) -> str:
    return f"list_filter(list_distinct(list_transform(regexp_extract_all({text}, '[a-zA-Z]{{2,}}'), lambda t: lower(t))), lambda t: NOT list_contains({_stop}, t))"


TOKENS_SQL = f"""
tok1 AS (SELECT id, doc_id, priority, headword, {_tok(_begin(30))} AS a, {_tok(_begin(100))} AS b, {_tok("plain")} AS c FROM definitions),
tok2 AS (
  SELECT id, doc_id, priority, headword,
         (list_sort(a) || list_sort(list_filter(b, lambda t: NOT list_contains(a, t)))
          || list_sort(list_filter(c, lambda t: NOT list_contains(a, t) AND NOT list_contains(b, t))))[1:20] AS tokens
  FROM tok1),
tokens AS (SELECT id, doc_id, priority, headword, tokens[i] AS token, i - 1 AS pos FROM tok2, range(1, len(tokens) + 1) AS g(i))"""

REVERSE_SQL = """
ranked AS (
  SELECT token, id, row_number() OVER (PARTITION BY token ORDER BY greatest(0, 5 - pos) DESC, priority, length(headword), id DESC) AS rank
  FROM tokens),
lists AS (
  SELECT token, rank, id FROM (SELECT *, count(*) OVER (PARTITION BY token) AS size FROM ranked WHERE rank <= 100) WHERE size >= 3)"""


def _top(spark: SparkSession, sf_dir: str, n: int = TOP) -> DataFrame:
    return build.top_n(build.frequency(standin.definitions(spark, sf_dir)), n)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, priority, headword, token, pos) of the visible definitions."""
    e = standin.definitions(spark, sf_dir)
    return e.select("id", "priority", "headword", F.posexplode(en_tokens(F.col("plain"))).alias("pos", "token"))


def reverse_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.reverse_lists(tokens(spark, sf_dir))


# --- frequency and buckets ------------------------------------------------------
_ranked_sql = "SELECT row_number() OVER (ORDER BY centi DESC, norm) AS rank, norm, centi / 100.0::DOUBLE AS score FROM frequency ORDER BY centi DESC, norm LIMIT 1000"


@query(with_sql(ENTRIES_SQL, FREQUENCY_SQL) + _ranked_sql)
def frequency_topn(spark, sf_dir):
    return _top(spark, sf_dir)


@query(
    with_sql(ENTRIES_SQL)
    + """, f AS (SELECT lang, headword_norm AS norm, sum(greatest(1, 100 - priority))::BIGINT AS centi FROM definitions WHERE headword_norm <> '' GROUP BY ALL)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY centi DESC, norm) AS rank, norm, centi FROM f) WHERE rank <= 100"""
)
def frequency_by_language(spark, sf_dir):
    weight = F.greatest(F.lit(1), 100 - F.col("priority")).cast("long")
    f = standin.definitions(spark, sf_dir).where("headword_norm <> ''").groupBy("lang", F.col("headword_norm").alias("norm")).agg(F.sum(weight).alias("centi"))
    order = Window.partitionBy("lang").orderBy(F.col("centi").desc(), "norm")
    return f.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 100").select("lang", "rank", "norm", "centi")


_top_sql = f", top AS ({_ranked_sql})"
_bucket_sql = """, hits AS (
  SELECT t.rank, e.*, substr(coalesce(nullif(trim(tr.ko), ''), ''), 1, 2000) AS ko FROM definitions e JOIN top t ON e.headword_norm = t.norm LEFT JOIN translations tr ON tr.entry_id = e.id),
firsts AS (SELECT headword_norm AS norm, arg_min(headword, struct_pack(p := priority, d := dict, s := seq)) AS iast FROM hits GROUP BY 1)
"""
_bucket_rows = """SELECT h.rank, h.headword_norm AS norm, f.iast, row_number() OVER (PARTITION BY h.headword_norm ORDER BY h.priority, h.dict, h.seq) AS place,
  h.id, coalesce(h.short_name, h.dict) AS short, h.tier, substr(h.plain, 1, 350) AS snippet_medium, h.ko, coalesce(h.target_lang, h.lang, 'en') AS target_lang
FROM hits h JOIN firsts f ON h.headword_norm = f.norm"""


def _buckets(spark: SparkSession, sf_dir: str, n: int = TOP) -> DataFrame:
    e = standin.definitions(spark, sf_dir).withColumns(
        {"ko": F.lit(None).cast("string"), "snippet_short": F.substring("plain", 1, 120), "snippet_medium": F.col("plain")}
    )
    return build.bucket_rows(e, _top(spark, sf_dir, n), standin.translations(spark, sf_dir))


@query(with_sql(ENTRIES_SQL, FREQUENCY_SQL) + _top_sql + _bucket_sql + _bucket_rows)
def tier0_buckets(spark, sf_dir):
    return _buckets(spark, sf_dir).select("rank", "norm", "iast", "place", "id", "short", "tier", "snippet_medium", "ko", "target_lang")


@query(with_sql(ENTRIES_SQL, FREQUENCY_SQL) + _top_sql + _bucket_sql + "SELECT norm, iast FROM firsts WHERE norm = (SELECT min(headword_norm) FROM hits WHERE id = 'src2-000002')")
def bucket_of_entry(spark, sf_dir):
    return search.from_id(_buckets(spark, sf_dir), "src2-000002").select("norm", "iast")


_spell = with_sql(ENTRIES_SQL) + "SELECT headword_norm AS norm, arg_min(headword, struct_pack(p := priority, d := dict, s := seq)) AS iast FROM definitions WHERE headword_norm <> '' AND headword <> '' GROUP BY 1"


@query(_spell)
def headword_spellings(spark, sf_dir):
    return build.spellings(standin.definitions(spark, sf_dir))


@query(f"SELECT norm || chr(9) || iast AS value FROM ({_spell})")
def headword_file(spark, sf_dir):
    return sinks.headword_file(build.spellings(standin.definitions(spark, sf_dir)))


@query(f"SELECT norm, iast FROM ({_spell}) WHERE starts_with(norm, 'th') ORDER BY norm, iast LIMIT 20")
def headword_prefix(spark, sf_dir):
    return search.prefix_lookup(build.spellings(standin.definitions(spark, sf_dir)), "th")


# --- reverse lists ----------------------------------------------------------------
@query(with_sql(ENTRIES_SQL, TOKENS_SQL, REVERSE_SQL) + "SELECT token, rank, id FROM lists")
def reverse_topk(spark, sf_dir):
    return reverse_lists(spark, sf_dir)


@query(with_sql(ENTRIES_SQL, TOKENS_SQL) + "SELECT id, pos::INT AS pos, token FROM tokens")
def english_tokens(spark, sf_dir):
    return tokens(spark, sf_dir).select("id", "pos", "token")


@query(
    with_sql(ENTRIES_SQL, TOKENS_SQL, REVERSE_SQL)
    + "SELECT e.id, coalesce(nullif(headword, ''), '?') AS iast, e.dict FROM entries e WHERE e.id IN (SELECT id FROM lists WHERE rank <= 30)"
)
def reverse_meta(spark, sf_dir):
    return build.reverse_meta(reverse_lists(spark, sf_dir), standin.entries(spark, sf_dir))


@query(
    with_sql(ENTRIES_SQL, TOKENS_SQL, REVERSE_SQL)
    + """SELECT l.token, l.rank, l.id, coalesce(e.headword, '(미상)') AS iast, coalesce(e.dict, regexp_replace(l.id, '-\\d+$', '')) AS dict
FROM lists l LEFT JOIN (SELECT * FROM entries WHERE n % 2 = 0 AND headword <> '') e USING (id) WHERE l.rank <= 30"""
)
def reverse_resolved(spark, sf_dir):
    # reverse meta of every second source, so that hits without an entry are met as well
    meta = standin.entries(spark, sf_dir).where("n % 2 = 0 and headword <> ''").select("id", F.col("headword").alias("iast"), "dict")
    return search.resolve(reverse_lists(spark, sf_dir), meta)


# Korean definitions: the letters of the test texts as Hangul and Han ones
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_HANGUL = "가나다라마바사아자차카타파하거너더러머버서어저처커터"
_CAPITALS, _HAN = "ABCDEFGH", "一丁七万丈三上下"


def korean(text: str) -> str:
    return text.translate(str.maketrans(_LATIN + _CAPITALS, _HANGUL + _HAN))


def korean_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, priority, headword, token, pos) of the definitions in Korean letters."""
    e = standin.definitions(spark, sf_dir).withColumn("ko", F.translate("plain", _LATIN + _CAPITALS, _HANGUL + _HAN))
    return e.select("id", "priority", "headword", F.posexplode(ko_tokens(F.col("ko"))).alias("pos", "token"))


_ko_place = "coalesce(nullif(instr(substr(ko, 1, 100 + length(r)), r), 0) - 1, 100)"
KO_TOKENS_SQL = f"""
ko1 AS (SELECT id, priority, headword, translate(plain, '{_LATIN + _CAPITALS}', '{_HANGUL + _HAN}') AS ko FROM definitions),
ko2 AS (SELECT id, priority, headword, ko, unnest(list_distinct(regexp_extract_all(ko, '[가-힯]+|[一-鿿]+'))) AS r FROM ko1),
ko3 AS (SELECT id, priority, headword, r AS token, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN {_ko_place} < 30 THEN 0 WHEN {_ko_place} < 100 THEN 1 ELSE 2 END, r) - 1 AS pos FROM ko2),
ko_tokens AS (SELECT * FROM ko3 WHERE pos < 20),
ko_ranked AS (
  SELECT token, id, row_number() OVER (PARTITION BY token ORDER BY greatest(0, 5 - pos) DESC, priority, length(headword), id DESC) AS rank
  FROM ko_tokens),
ko_lists AS (
  SELECT token, rank, id FROM (SELECT *, count(*) OVER (PARTITION BY token) AS size FROM ko_ranked WHERE rank <= 100) WHERE size >= 3)"""


@query(with_sql(ENTRIES_SQL, KO_TOKENS_SQL) + "SELECT token, rank, id FROM ko_lists")
def reverse_topk_korean(spark, sf_dir):
    return build.reverse_lists(korean_definitions(spark, sf_dir))


@query(
    with_sql(ENTRIES_SQL)
    + "SELECT e.id, coalesce(CASE WHEN e.doc_id % 3 = 0 THEN e.doc_id % 100 END, d.priority) AS priority FROM entries e JOIN dicts d ON e.dict = d.slug WHERE NOT d.exclude_from_search"
)
def inline_priorities(spark, sf_dir):
    """An entry's own priority comes before its dictionary's."""
    e = standin.entries(spark, sf_dir).withColumn("priority", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 100))
    return build.with_priority(e, build.visible(standin.dicts(spark, sf_dir))).select("id", "priority")


KO_TEXTS = [(1, "법(法); 규범, 조례"), (2, "의무 duty 義務"), (3, "불교의 가르침(敎); 진리, 법"), (4, ""), (5, "해탈、 解脫·열반(涅槃)")]
_KO_TOKENS = [
    (1, 0, "法"), (1, 1, "규범"), (1, 2, "법"), (1, 3, "조례"),
    (2, 0, "義務"), (2, 1, "의무"),
    (3, 0, "敎"), (3, 1, "가르침"), (3, 2, "법"), (3, 3, "불교의"), (3, 4, "진리"),
    (5, 0, "涅槃"), (5, 1, "解脫"), (5, 2, "열반"), (5, 3, "해탈"),
]


@query(f"SELECT id::INT AS id, pos::INT AS pos, token FROM {values(_KO_TOKENS)} t(id, pos, token)")
def korean_tokens(spark, sf_dir):
    return spark.createDataFrame(KO_TEXTS, "id int, ko string").select("id", F.posexplode(ko_tokens(F.col("ko"))).alias("pos", "token"))


# --- equivalents -------------------------------------------------------------------
def _equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.equivalents(standin.equivalent_rows(spark, sf_dir), check_zh=False)


_KEYS_SQL = """
equiv_keys AS (
  SELECT k AS key, min(channel) AS channel, row_id FROM (
    SELECT row_id, 'skt' AS channel, lower(strip_accents(trim(skt_iast))) AS k FROM equiv_folded
    UNION ALL SELECT row_id, 'tib', lower(strip_accents(trim(tib_wylie))) FROM equiv_folded
    UNION ALL SELECT row_id, 'zh', trim(zh) FROM equiv_folded) WHERE k IS NOT NULL AND k <> '' GROUP BY k, row_id)"""


def _equiv_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.equivalent_keys(_equivalents(spark, sf_dir), normalize(F.col("value")))


@query(with_sql(EQUIV_SQL) + "SELECT * FROM equiv_folded")
def equiv_dedup(spark, sf_dir):
    return _equivalents(spark, sf_dir).select("row_id", "skt_iast", "tib_wylie", "zh", "category", "note", F.array_join("sources", "|").alias("sources"))


@query(with_sql(EQUIV_SQL, _KEYS_SQL) + "SELECT * FROM equiv_keys")
def equiv_keys(spark, sf_dir):
    return _equiv_keys(spark, sf_dir)


@query(with_sql(EQUIV_SQL) + "SELECT list_aggregate(list_sort(string_split(sources, '|')), 'string_agg', ' + ') AS combination, count(*) AS n FROM equiv_folded WHERE contains(sources, '|') GROUP BY 1")
def source_combinations(spark, sf_dir):
    from ..operators.quality import source_combinations as combos

    return combos(_equivalents(spark, sf_dir))


_asked_sql = "asked AS (SELECT DISTINCT p_partkey AS qid, p_name AS raw FROM part UNION ALL SELECT 1000000000 + p_partkey, p_brand FROM part)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = standin.table(spark, sf_dir, "part")
    names = p.select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("raw")).distinct()
    return names.union(p.select(F.col("p_partkey") + 1000000000, "p_brand"))


# a capital of the Harvard-Kyoto set next to a lower-case letter converts first
_hk_sql = "CASE WHEN regexp_matches(q, '[AIUTDNSGJRMH]') AND regexp_matches(q, '[a-z]') THEN translate(replace(replace(replace(replace(replace(replace(q, 'lRR', 'ḹ'), 'lR', 'ḷ'), 'RR', 'ṝ'), 'Th', 'ṭh'), 'Dh', 'ḍh'), '~n', 'ñ'), 'AIURMHGJTDNzS', 'āīūṛṃḥṅñṭḍṇśṣ') ELSE q END"
_keyed_sql = f"keyed AS (SELECT qid, q, lower(strip_accents({_hk_sql})) AS k1, lower(strip_accents(q)) AS k2 FROM (SELECT qid, trim(raw) AS q FROM asked) WHERE q <> '')"


@query(
    with_sql(EQUIV_SQL, _KEYS_SQL, _asked_sql, _keyed_sql)
    + "SELECT DISTINCT k.qid, e.row_id, f.skt_iast, f.sources FROM keyed k JOIN equiv_keys e ON e.key IN (k.k1, k.k2) JOIN equiv_folded f USING (row_id)"
)
def equiv_lookup(spark, sf_dir):
    keys = search.keyed(_asked(spark, sf_dir))
    hits = search.equivalents(keys, _equiv_keys(spark, sf_dir), _equivalents(spark, sf_dir))
    return hits.select("qid", "row_id", "skt_iast", F.array_join("sources", "|").alias("sources"))


@query(
    with_sql(EQUIV_SQL)
    + """, long AS (SELECT row_id, unnest([struct_pack(pos := 0, field := 'skt_iast', value := skt_iast), struct_pack(pos := 1, field := 'tib_wylie', value := tib_wylie),
  struct_pack(pos := 2, field := 'zh', value := zh), struct_pack(pos := 3, field := 'category', value := category), struct_pack(pos := 4, field := 'note', value := note)]) AS x FROM equiv_folded)
SELECT row_id, x.pos AS pos, x.field AS field, x.value AS value FROM long WHERE coalesce(trim(x.value), '') <> ''"""
)
def equiv_detail(spark, sf_dir):
    return search.detail(_equivalents(spark, sf_dir), ["skt_iast", "tib_wylie", "zh", "category", "note"])


@query(with_sql(EQUIV_SQL) + "SELECT row_id, skt_iast FROM equiv_folded ORDER BY row_id LIMIT 50 OFFSET 50")
def equiv_second_page(spark, sf_dir):
    return search.page(_equivalents(spark, sf_dir), ["row_id"], 50, 50).select("row_id", "skt_iast")


# --- ranking ---------------------------------------------------------------------------
_LANG = "CASE WHEN lang = 'de' THEN 1 WHEN lang = 'es' THEN 2 WHEN lang = 'fr' THEN 3 ELSE 0 END"
_balanced_sql = with_sql(ENTRIES_SQL) + f", r AS (SELECT headword_norm, id, {_LANG} AS lang_rank, row_number() OVER (PARTITION BY headword_norm, {_LANG} ORDER BY priority, dict, seq) AS place FROM definitions) "


def _lang():
    return F.when(F.col("lang") == "de", "bo").when(F.col("lang") == "es", "pi").when(F.col("lang") == "fr", "other").otherwise("sa")


def _balanced(spark, sf_dir):
    return search.balanced_top(standin.definitions(spark, sf_dir), _lang(), list(build.ORDER), ["headword_norm"], 3)


@query(_balanced_sql + "SELECT headword_norm, lang_rank, place, id FROM r WHERE place <= 3")
def lang_balanced_top(spark, sf_dir):
    return _balanced(spark, sf_dir).select("headword_norm", "lang_rank", "place", "id")


@query(_balanced_sql + "SELECT headword_norm, id FROM r WHERE place > 3")
def lang_balanced_rest(spark, sf_dir):
    return search.balanced_rest(standin.definitions(spark, sf_dir), _balanced(spark, sf_dir), ["headword_norm"]).select("headword_norm", "id")


@query(with_sql(ENTRIES_SQL) + "SELECT id, priority FROM definitions WHERE lang = 'fr' AND priority <= 40")
def priority_filter(spark, sf_dir):
    return standin.definitions(spark, sf_dir).where(search.allowed("fr", 40, F.col("lang"))).select("id", "priority")


# --- composite search --------------------------------------------------------------------
QUESTIONS = [(1, "the"), (2, "Of"), (3, "  and "), (4, "queue"), (5, ""), (6, "des"), (7, "th"), (8, "La"), (9, "12"), (10, "que"), (11, "커아마"), (12, "파마"), (13, "나가")]


def bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Search tables of the test corpus: French entries stand for the second tier."""
    e = standin.definitions(spark, sf_dir).withColumns({"ko": F.lit(None).cast("string"), "snippet_short": F.substring("plain", 1, 120), "snippet_medium": F.col("plain")})
    top, tr = _top(spark, sf_dir), standin.translations(spark, sf_dir)
    return {
        "tier0": build.bucket_rows(e.where("lang <> 'fr'"), top, tr),
        "tier0_bo": build.bucket_rows(e.where("lang = 'fr'"), top, tr),
        "equiv_keys": _equiv_keys(spark, sf_dir),
        "equiv_rows": _equivalents(spark, sf_dir),
        "reverse_en": reverse_lists(spark, sf_dir),
        "reverse_ko": build.reverse_lists(korean_definitions(spark, sf_dir)),
        "headwords": build.spellings(standin.definitions(spark, sf_dir)),
    }


_questions_sql = f"asked AS (SELECT * FROM {values(QUESTIONS)} t(qid, raw))"


@query(
    with_sql(ENTRIES_SQL, FREQUENCY_SQL, TOKENS_SQL, REVERSE_SQL, KO_TOKENS_SQL, EQUIV_SQL, _KEYS_SQL, _questions_sql, _keyed_sql)
    + _top_sql
    + f""", spell AS (SELECT headword_norm AS norm, arg_min(headword, struct_pack(p := priority, d := dict, s := seq)) AS iast FROM definitions WHERE headword_norm <> '' AND headword <> '' GROUP BY 1),
hits AS (SELECT k.qid, row_number() OVER (PARTITION BY k.qid ORDER BY e.lang = 'fr', e.priority, e.dict, e.seq) AS rank, e.id AS item
  FROM keyed k JOIN top t ON t.norm = k.k1 JOIN definitions e ON e.headword_norm = k.k1),
eq AS (SELECT DISTINCT k.qid, e.row_id FROM keyed k JOIN equiv_keys e ON e.key IN (k.k1, k.k2)),
part20 AS (SELECT * FROM (SELECT k.qid, row_number() OVER (PARTITION BY k.qid ORDER BY s.norm, s.iast) AS rank, s.norm AS item FROM keyed k JOIN spell s ON starts_with(s.norm, k.k1)) WHERE rank <= 20)
SELECT qid::INT AS qid, 'exact' AS channel, rank, item FROM hits
UNION ALL SELECT qid::INT, 'equivalents', row_number() OVER (PARTITION BY qid ORDER BY row_id), row_id::VARCHAR FROM eq
UNION ALL SELECT k.qid::INT, 'reverse_en', l.rank, l.id FROM keyed k JOIN lists l ON l.token = lower(k.q)
  WHERE regexp_matches(lower(k.q), '^[a-z''\\-]+$') AND NOT (regexp_matches(q, '[AIUTDNSGJRMH]') AND regexp_matches(q, '[a-z]'))
UNION ALL SELECT k.qid::INT, 'reverse_ko', l.rank, l.id FROM keyed k JOIN ko_lists l ON l.token = k.q WHERE regexp_matches(k.q, '[가-힣]')
UNION ALL SELECT qid::INT, 'partial', rank, item FROM part20"""
)
def search_union(spark, sf_dir):
    found = search.search(spark.createDataFrame(QUESTIONS, "qid int, raw string"), bundle(spark, sf_dir))
    item = F.coalesce(*[F.get_json_object("payload", f"$.{k}") for k in ("id", "row_id", "norm")])
    return found.select("qid", "channel", "rank", item.alias("item"))


SCRIPTS = [(1, "dharma"), (2, "chos"), (3, "法"), (4, "धर्म"), (5, "Dharma"), (6, "duty"), (7, "법"), (8, "dh"), (9, "   "), (10, "법(法)"), (11, "zAnti")]
_SCRIPT_KEYS = [
    (1, "iast", "dharma", "dharma"), (2, "iast", "chos", "chos"), (3, "cjk", "法", "法"), (4, "devanagari", "dharma", "धर्म".replace("्", "")),
    (5, "hk", "dharma", "dharma"), (6, "iast", "duty", "duty"), (7, "korean", "법", "법"), (8, "iast", "dh", "dh"), (9, "empty", None, None),
    (10, "cjk", "법(法)", "법(法)"), (11, "hk", "santi", "zanti"),
]


@query(f"SELECT qid::INT AS qid, script, iast_key, wylie_key FROM {values(_SCRIPT_KEYS)} t(qid, script, iast_key, wylie_key)")
def query_keys(spark, sf_dir):
    return search.keyed(spark.createDataFrame(SCRIPTS, "qid int, raw string")).select("qid", "script", "iast_key", "wylie_key")


# --- first qualifying, merging, inflection -------------------------------------------------
@query(
    with_sql(ENTRIES_SQL)
    + """, f AS (SELECT headword_norm AS norm, arg_min(struct_pack(id := d.id, plain := plain, ko := t.ko), struct_pack(p := priority, d := dict, s := seq)) AS x
  FROM definitions d LEFT JOIN translations t ON t.entry_id = d.id WHERE length(trim(plain)) >= 10 GROUP BY 1)
SELECT norm, x.id AS id, substr(x.plain, 1, 4000) AS text FROM f WHERE coalesce(trim(x.ko), '') = ''"""
)
def first_qualifying(spark, sf_dir):
    e = standin.definitions(spark, sf_dir).join(standin.translations(spark, sf_dir).withColumnRenamed("entry_id", "id"), "id", "left")
    return build.translation_candidates(e)


@query(
    with_sql(ENTRIES_SQL, FREQUENCY_SQL)
    + """, top AS (SELECT norm FROM frequency ORDER BY centi DESC, norm LIMIT 1000),
f AS (SELECT headword_norm AS norm, arg_min(struct_pack(id := id, plain := plain), struct_pack(p := priority, d := dict, s := seq)) AS x FROM definitions
  WHERE length(trim(plain)) >= 10 AND headword_norm IN (SELECT norm FROM top) AND id NOT IN (SELECT entry_id FROM translations) GROUP BY 1)
SELECT norm, x.id AS id, substr(x.plain, 1, 4000) AS text FROM f"""
)
def untranslated_candidates(spark, sf_dir):
    e = standin.definitions(spark, sf_dir).withColumn("ko", F.lit(None).cast("string"))
    return build.untranslated(e, standin.translations(spark, sf_dir), _top(spark, sf_dir))


@query(
    """SELECT slug, norm, raw_id, src_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY slug, norm ORDER BY src_rank, raw_id) AS rn FROM (
    SELECT o_orderpriority AS slug, o_custkey::VARCHAR AS norm, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS src_rank, o_orderkey AS raw_id FROM orders)) WHERE rn = 1"""
)
def merged_dedup(spark, sf_dir):
    o = standin.table(spark, sf_dir, "orders")
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = o.select(F.col("o_orderpriority").alias("slug"), F.col("o_custkey").cast("string").alias("norm"), rank.alias("src_rank"), F.col("o_orderkey").alias("raw_id"))
    return build.merged(rows)


@query(
    with_sql(ENTRIES_SQL, FREQUENCY_SQL)
    + """SELECT headword_norm AS norm, headword AS iast, dict, arg_min(plain, struct_pack(p := priority, d := dict, s := seq)) AS body FROM entries
WHERE headword_norm <> '' AND plain <> '' AND headword_norm IN (SELECT norm FROM frequency ORDER BY centi DESC, norm LIMIT 1000) GROUP BY ALL"""
)
def declension_index(spark, sf_dir):
    return build.declensions(standin.entries(spark, sf_dir), _top(spark, sf_dir)).select("norm", "iast", "dict", "body")
