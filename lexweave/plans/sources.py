"""Queries over readers, writers, numbering and record building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract
from ..sources import sinks, tables
from . import standin
from .registry import collector, values

QUERIES, ORACLE, query = collector()


# --- lists and lines -------------------------------------------------------------
@query("SELECT row_number() OVER (ORDER BY p_partkey) AS rank, trim(p_name) AS norm FROM part WHERE p_size % 4 <> 0")
def ranked_lines(spark, sf_dir):
    p = standin.table(spark, sf_dir, "part")
    return tables.rank_lines(p.select(F.col("p_partkey").alias("line_no"), F.when(F.col("p_size") % 4 == 0, "  ").otherwise(F.col("p_name")).alias("value")))


@query("SELECT c_mktsegment AS entry_id, arg_max('ko' || c_custkey, c_custkey) AS ko FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1")
def last_translations(spark, sf_dir):
    c = standin.table(spark, sf_dir, "customer")
    text = F.when(F.col("c_nationkey") % 3 == 0, " ").otherwise(F.concat(F.lit("ko"), F.col("c_custkey").cast("string")))
    return tables.read_translations(c.select(F.col("c_custkey").alias("line_no"), F.col("c_mktsegment").alias("entry_id"), text.alias("ko")))


HEADWORD_LINES = [(1, "dharma\tdharma"), (2, "a\tb\tc"), (3, ""), (4, "no tab"), (5, "\tx"), (6, "  ")]
_HEADWORDS = [(1, "dharma", "dharma"), (2, "a", "b\tc"), (5, "", "x")]


@query(f"SELECT id::INT AS id, norm, iast FROM {values(_HEADWORDS)} t(id, norm, iast)")
def headword_lines(spark, sf_dir):
    norm, iast = tables.headword_lines(F.col("value"))
    rows = spark.createDataFrame(HEADWORD_LINES, "id int, value string").select("id", norm.alias("norm"), iast.alias("iast"))
    return rows.where("norm is not null")


_LINE = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '  ' WHEN 2 THEN p_name || chr(9) || p_brand ELSE p_name || chr(9) || p_brand || chr(9) || p_type END"


@query(f"SELECT p_partkey, substr(v, 1, instr(v, chr(9)) - 1) AS norm, substr(v, instr(v, chr(9)) + 1) AS iast FROM (SELECT p_partkey, {_LINE} AS v FROM part) WHERE instr(v, chr(9)) > 0")
def headword_lines_of_parts(spark, sf_dir):
    norm, iast = tables.headword_lines(F.expr(_LINE))
    return standin.table(spark, sf_dir, "part").select("p_partkey", norm.alias("norm"), iast.alias("iast")).where("norm is not null")


_STATE = "CASE WHEN o_orderkey % 97 = 0 THEN 'error' WHEN o_orderkey % 5 = 0 THEN 'decoding' WHEN o_orderkey % 7 = 0 THEN 'fetching' WHEN o_orderkey % 11 = 0 THEN 'pending' ELSE 'done' END"


@query(
    f"""SELECT bundle, CASE WHEN bool_or(s = 'error') THEN 'error' WHEN bool_and(s = 'done') THEN 'done' WHEN bool_or(s = 'decoding') THEN 'decoding' WHEN bool_or(s = 'fetching') THEN 'fetching' ELSE 'pending' END AS status
FROM (SELECT o_custkey AS bundle, {_STATE} AS s FROM orders) GROUP BY 1"""
)
def load_status_of_orders(spark, sf_dir):
    o = standin.table(spark, sf_dir, "orders")
    return tables.load_status(o.select(F.col("o_custkey").alias("bundle"), F.col("o_orderkey").alias("idx"), F.expr(_STATE).alias("status")))


STATES = [(1, "a", "done"), (1, "b", "error"), (1, "c", "fetching"), (2, "a", "fetching"), (2, "b", "decoding"), (2, "c", "pending"), (3, "a", "done"), (3, "b", "done"), (4, "a", "pending"), (5, "a", "fetching"), (5, "b", "done")]


@query(f"SELECT bundle::INT AS bundle, status FROM {values([(1, 'error'), (2, 'decoding'), (3, 'done'), (4, 'pending'), (5, 'fetching')])} t(bundle, status)")
def load_status(spark, sf_dir):
    return tables.load_status(spark.createDataFrame(STATES, "bundle int, idx string, status string"))


@query("SELECT o_orderstatus AS status, count(*) AS jobs, sum(o_custkey)::BIGINT AS requests, sum(o_orderkey)::BIGINT AS results FROM orders GROUP BY 1")
def batch_states(spark, sf_dir):
    o = standin.table(spark, sf_dir, "orders")
    return tables.batch_status(o.select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("requests"), F.col("o_orderkey").alias("results")))


@query("SELECT id, dict_id, headword FROM (SELECT c_custkey AS id, c_nationkey AS dict_id, c_name AS headword, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer WHERE c_nationkey IN (1, 2, 3)) WHERE rn <= 10")
def raw_entries(spark, sf_dir):
    c = standin.table(spark, sf_dir, "customer")
    return tables.raw_entries(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("dict_id"), F.col("c_name").alias("headword")), [1, 2, 3], 10)


@query("SELECT s_name AS slug, n AS name, n_nationkey AS dict_id FROM (SELECT s_name, CASE WHEN s_suppkey % 10 = 0 THEN 'none' ELSE n_name END AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey) LEFT JOIN nation ON n_name = n")
def resolved_names(spark, sf_dir):
    n = standin.table(spark, sf_dir, "nation")
    s = standin.table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    wanted = s.select(F.col("s_name").alias("slug"), F.when(F.col("s_suppkey") % 10 == 0, "none").otherwise(F.col("n_name")).alias("name"))
    return tables.resolve_names(wanted, n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")))


# --- numbering and writing ----------------------------------------------------------
@query("SELECT o_orderkey, position, (position - 1) // 1000 + 1 AS chunk FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders)")
def chunk_assignment(spark, sf_dir):
    o = tables.dense_rank_by(standin.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return o.select("o_orderkey", "position", sinks.chunk_of(F.col("position"), 1000).alias("chunk"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS seq FROM documents")
def sequence_ids(spark, sf_dir):
    return extract.numbered(standin.table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@query("SELECT s_suppkey AS rank, s_name AS norm, round(s_acctbal / 3, 3) AS score FROM supplier")
def score_list(spark, sf_dir):
    s = standin.table(spark, sf_dir, "supplier")
    return sinks.score_list(s.select(F.col("s_suppkey").alias("rank"), F.col("s_name").alias("norm"), (F.col("s_acctbal") / 3).alias("score")))


@query(
    """SELECT p_partkey AS id, '{"slug":"' || p_brand || '"' || CASE WHEN p_size % 3 = 1 THEN ',"name":"' || p_name || '"' ELSE '' END
  || CASE WHEN p_size % 5 <> 0 THEN ',"tier":' || (p_size % 4) ELSE '' END || ',"hidden":' || (p_size % 2 = 0)::VARCHAR || '}' AS json FROM part"""
)
def meta_json_of_parts(spark, sf_dir):
    n = F.col("p_size")
    rows = standin.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("slug"), F.when(n % 3 == 1, F.col("p_name")).when(n % 3 == 2, "").alias("name"),
        F.when(n % 5 != 0, n % 4).alias("tier"), (n % 2 == 0).alias("hidden"),
    )
    return rows.select("id", sinks.meta_json(["slug:string", "name:string", "tier:int", "hidden:boolean"]).alias("json"))


META = [(1, "a", "", 0, False), (2, "b", "x", 5, True), (3, "c", None, None, None)]
_META_JSON = [(1, '{"slug":"a","tier":0,"hidden":false}'), (2, '{"slug":"b","name":"x","tier":5,"hidden":true}'), (3, '{"slug":"c"}')]


@query(f"SELECT id::INT AS id, json FROM {values(_META_JSON)} t(id, json)")
def meta_json(spark, sf_dir):
    rows = spark.createDataFrame(META, "id int, slug string, name string, tier int, hidden boolean")
    return rows.select("id", sinks.meta_json(["slug:string", "name:string", "tier:int", "hidden:boolean"]).alias("json"))


# --- records -------------------------------------------------------------------------
_islands = """WITH r AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS record FROM conversations)
SELECT conv_id, record::BIGINT AS record, arg_min(text, turn) AS head, count(*) - 1 AS n_lines FROM r WHERE record > 0 GROUP BY 1, 2"""


@query(_islands)
def island_parse(spark, sf_dir):
    c = standin.table(spark, sf_dir, "conversations")
    records = extract.islands(c, "conv_id", "turn", F.col("role") == "user")
    got = extract.collected(records, "conv_id", "turn", "text")
    return got.select("conv_id", "record", "head", F.size("lines").cast("long").alias("n_lines"))


@query(
    """WITH r AS (SELECT doc_id, i AS ord, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), range(1, len(l) + 1) AS g(i)),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Z][a-z]+ .*\\.$') THEN 1 WHEN length(line) < 12 THEN 0 END AS mark FROM r),
n AS (SELECT *, sum(CASE WHEN mark IS NOT NULL THEN 1 ELSE 0 END) OVER w AS record, last_value(mark IGNORE NULLS) OVER w AS live FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, record::BIGINT AS record, count(*) AS n FROM n WHERE live = 1 GROUP BY 1, 2"""
)
def resetting_islands(spark, sf_dir):
    return _records(standin.table(spark, sf_dir, "documents"))


def _records(d):
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    head = F.col("line").rlike("^[A-Z][a-z]+ .*\\.\\z")
    records = extract.islands(lines, "doc_id", "at", head, resets=~head & (F.length("line") < 12))
    return records.groupBy("doc_id", "record").agg(F.count(F.lit(1)).alias("n"))


@query()
def made_entries(spark, sf_dir):
    """Documents through the whole entry builder (parsers have no SQL form)."""
    d = standin.table(spark, sf_dir, "documents")
    rows = d.select(
        F.col("source").alias("slug"),
        F.col("doc_id").alias("seq"),
        F.col("doc_id").alias("raw_id"),
        F.regexp_extract("text", standin.WORD, 0).alias("headword"),
        F.col("text").alias("body"),
        F.lit("").alias("body_ko"),
    )
    n = F.substring("source", 4, 9).cast("int")
    dicts = d.select("source").distinct().select(
        F.col("source").alias("slug"), F.when(n % 2 == 0, "skt").otherwise("en").alias("lang"), (n % 3 + 1).alias("tier"), (n * 5 + 1).alias("priority"),
        F.lit("public-domain").alias("license"), F.when(n % 2 == 0, "xdxf").otherwise("apple_dict").alias("source_format"),
        F.when(n % 4 == 0, ";").alias("sense_separator"), F.col("source").alias("v1_name"),
    )
    e = extract.make_entries(rows, dicts)
    return e.select("id", "headword", "headword_norm", "body.snippet_short", F.array_join("reverse.en", " ").alias("tokens"), F.array_join("flags", ",").alias("flags"))
