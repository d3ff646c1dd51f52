"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, langid, licenses, neardup, packing, toxicity, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_encoder(path: str = "byte_bpe_50k") -> packing.Encoder:
    """The public tokenizer files of this machine; another place is a parameter."""
    import public_tokenizers

    return packing.Encoder(public_tokenizers.path(f"{path}.json"), public_tokenizers.path(f"{path}.tiktoken"), public_tokenizers.PATTERN)


#: The stated rules: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules).drop("url")


def op3_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.template_table(spark))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_encoder())


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.inspect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs), ["doc_id"])
    return found.select("row.doc_id", F.expr("coalesce(crc32(cast(row.doc_id as string)) % 3 = 1, false)").alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("row.doc_id", "expected_severity", "grade", "p_toxic", toxicity.toxic().alias("toxic"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op3_chat_snapshots": op3_chat_snapshots,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_license_scan": op5_license_scan,
    "op6_ann_graph": op6_ann_graph,
    "op2_packing": op2_packing,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_decontamination": op8_decontamination,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORM = "trim(regexp_replace(" + _FOLD + ", '[^a-z0-9]+', ' ', 'g'))"
_BIGRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"

ORACLE: dict[str, str] = {
    "op1_url_filter": f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in URL_RULES)}),
rest AS (
  SELECT page_id, row_number() OVER () AS rid,
         coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest
  FROM pages),
parts AS (
  SELECT page_id, rid, {_FOLD.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT p.rid, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS best
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.rid)
SELECT p.page_id, p.host, p.path, f.best.rule AS rule, coalesce(f.best.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f USING (rid)""",
    "op3_chat_snapshots": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM t),
w AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY position) AS turns FROM r GROUP BY conv_id),
k AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS copies FROM w GROUP BY turns),
heads AS (SELECT DISTINCT w.turns[1:i] AS turns FROM w, range(1, len(w.turns)) AS g(i)),
kept AS (SELECT k.conv_id, k.copies FROM k WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.turns = k.turns))
SELECT r.conv_id, r.position, r.n_turns, kept.copies, coalesce(r.role, 'unknown') AS role,
       '<|im_start|>' || coalesce(r.role, 'unknown') || chr(10) || coalesce(r.text, '') || '<|im_end|>' || chr(10) AS rendered,
       coalesce(r.role, 'unknown') = 'assistant' AS bears_loss
FROM r JOIN kept USING (conv_id)""",
    "op5_license_scan": f"""
WITH templates(license, body) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.TEMPLATES)}),
tw AS (SELECT license, string_split({_NORM.format("body")}, ' ') AS w FROM templates),
t AS (SELECT DISTINCT license, {_BIGRAMS.format("w")} AS b FROM tw),
pieces AS (
  SELECT doc_id, string_split_regex(text, '[\n\r]+|[.!?]+[ \t]+') AS s, text FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, i - 1 AS start, s[i] AS passage FROM pieces, range(1, len(s) + 1) AS g(i)
  UNION ALL SELECT doc_id, -1, text FROM pieces),
uw AS (SELECT *, string_split({_NORM.format("passage")}, ' ') AS w FROM units),
ub AS (SELECT doc_id, start, passage, {_BIGRAMS.format("w")} AS b FROM uw WHERE len(w) > 1),
scored AS (
  SELECT doc_id, start, passage, license,
         2.0 * len(list_intersect(ub.b, t.b)) / (len(ub.b) + len(t.b)) AS dice
  FROM ub, t)
SELECT doc_id, CASE WHEN start < 0 THEN 'text' ELSE 'sentence' END AS unit, start::INT AS start, passage,
       arg_min(license, struct_pack(less := -dice, license := license)) AS license, max(dice) AS dice
FROM scored WHERE dice >= 0.8 - 1e-12 GROUP BY doc_id, start, passage""",
    "op4_warc_round_trip": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS rid FROM pages),
d AS (
  SELECT *, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS keep FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to, NULL::VARCHAR AS problem
FROM b""",
    "op7_minhash_neardup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^ \\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM w, range(1, len(ws) - 3) AS g(i) WHERE len(ws) >= 5
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (
  SELECT DISTINCT a, a FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(r.low, d.doc_id), d.doc_id) AS component_id,
       coalesce(least(r.low, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1) r USING (doc_id)""",
    "op8_decontamination": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
t AS (
  SELECT item_id, regexp_extract_all({_FOLD.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
tw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS size, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
  FROM t, range(1, greatest(len(ws) - 12, 1) + 1) AS g(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM tw),
dw AS (
  SELECT doc_id, i AS start, size, array_to_string(ws[i:i + size - 1], ' ') AS win FROM d, sizes, range(1, len(ws) - size + 2) AS g(i)),
m AS (SELECT dw.doc_id, dw.start, dw.size, tw.item_id FROM dw JOIN tw USING (size, win)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + size)) AS pos FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
