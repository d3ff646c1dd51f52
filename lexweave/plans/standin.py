"""Dictionary-shaped views of the test tables, in Spark and in DuckDB.

Documents stand for entries (``source`` is the dictionary), parts for rows of
bilingual sources, labels for translations.  Each view has the same definition
twice: as DataFrame expressions and as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.script import normalize

WORD = "[A-Za-zÀ-ÿ]+"
N_EXCLUDED = (19, 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as entries."""
    d = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    n = F.substring("source", 4, 9).cast("int") + 1
    head = F.regexp_extract("text", WORD, 0)
    return d.select(
        F.format_string("%s-%06d", "source", "doc_id").alias("id"),
        F.col("source").alias("dict"),
        F.col("doc_id").alias("seq"),
        "doc_id",
        n.alias("n"),
        (n * 5).alias("priority"),
        head.alias("headword"),
        head.alias("headword_iast"),
        normalize(head).alias("headword_norm"),
        "lang",
        (F.lit(1) + n % 3).alias("tier"),
        F.col("text").alias("plain"),
    )


def dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry row per source."""
    d = table(spark, sf_dir, "documents").where("source is not null").select("source").distinct()
    n = F.substring("source", 4, 9).cast("int") + 1
    return d.select(
        F.col("source").alias("slug"),
        (n * 5).alias("priority"),
        n.isin(*N_EXCLUDED).alias("exclude_from_search"),
        F.when(n % 6 == 0, "equivalents").otherwise("definition").alias("role"),
        F.when(n % 2 == 0, F.concat(F.lit("S"), n.cast("string"))).alias("short_name"),
        F.when(n % 3 == 0, "bo").when(n % 3 == 1, "en").alias("target_lang"),
    )


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of visible definition dictionaries, with their names."""
    from ..operators.build import visible, with_dict

    shown = visible(dicts(spark, sf_dir)).where("role = 'definition'")
    return with_dict(entries(spark, sf_dir), shown, "short_name", "target_lang")


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, ko) from labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("ko"))
    return entries(spark, sf_dir).select("doc_id", F.col("id").alias("entry_id")).join(labels, "doc_id").groupBy("entry_id").agg(F.max("ko").alias("ko"))


def equivalent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of five bilingual sources."""
    p = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    return p.select(
        F.col("p_name").alias("skt_iast"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("tib_wylie"),
        F.when(F.col("p_size") % 7 == 0, F.col("p_type")).alias("zh"),
        *[none.alias(c) for c in ("ko", "en", "ja", "de")],
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("category"),
        F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("note"),
        F.concat(F.lit("s"), (F.col("p_size") % 5).cast("string")).alias("slug"),
        F.col("p_partkey").alias("ord"),
    )


ENTRIES_SQL = """
entries AS (
  SELECT printf('%s-%06d', source, doc_id) AS id, source AS dict, doc_id AS seq, doc_id,
         substr(source, 4)::INT + 1 AS n, (substr(source, 4)::INT + 1) * 5 AS priority,
         regexp_extract(text, '[A-Za-zÀ-ÿ]+') AS headword,
         lower(strip_accents(regexp_extract(text, '[A-Za-zÀ-ÿ]+'))) AS headword_norm,
         lang, 1 + (substr(source, 4)::INT + 1) % 3 AS tier, text AS plain
  FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
dicts AS (
  SELECT slug, n * 5 AS priority, n IN (19, 20) AS exclude_from_search,
         CASE WHEN n % 6 = 0 THEN 'equivalents' ELSE 'definition' END AS role,
         CASE WHEN n % 2 = 0 THEN 'S' || n END AS short_name,
         CASE WHEN n % 3 = 0 THEN 'bo' WHEN n % 3 = 1 THEN 'en' END AS target_lang
  FROM (SELECT DISTINCT source AS slug, substr(source, 4)::INT + 1 AS n FROM documents WHERE source IS NOT NULL)),
definitions AS (
  SELECT e.*, d.short_name, d.target_lang FROM entries e JOIN dicts d ON e.dict = d.slug
  WHERE NOT d.exclude_from_search AND d.role = 'definition'),
translations AS (
  SELECT e.id AS entry_id, max('q' || l.quality) AS ko FROM entries e JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL GROUP BY 1)"""

FREQUENCY_SQL = """
frequency AS (
  SELECT headword_norm AS norm, sum(greatest(1, 100 - priority))::BIGINT AS centi
  FROM definitions WHERE headword_norm <> '' GROUP BY 1)"""

EQUIV_SQL = """
equiv_rows AS (
  SELECT p_name AS skt_iast, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS tib_wylie,
         CASE WHEN p_size % 7 = 0 THEN p_type END AS zh,
         CASE WHEN p_size % 2 = 0 THEN p_type END AS category,
         CASE WHEN p_size % 5 = 0 THEN 'size ' || p_size END AS note,
         's' || (p_size % 5) AS slug, p_partkey AS ord
  FROM part),
equiv_scored AS (
  SELECT *, lower(trim(coalesce(skt_iast, ''))) AS k1, lower(trim(coalesce(tib_wylie, ''))) AS k2, trim(coalesce(zh, '')) AS k3,
         length(coalesce(skt_iast, '')) + length(coalesce(tib_wylie, '')) + length(coalesce(zh, ''))
         + length(coalesce(category, '')) + length(coalesce(note, '')) AS score
  FROM equiv_rows WHERE coalesce(skt_iast, tib_wylie, zh) IS NOT NULL),
equiv_folded AS (
  SELECT w.row_id, x.skt_iast, x.tib_wylie, x.zh, x.category, x.note, s.sources
  FROM (SELECT k1, k2, k3, min(ord) AS row_id, arg_max(ord, struct_pack(s := score, o := -ord)) AS best FROM equiv_scored GROUP BY ALL) w
  JOIN equiv_scored x ON x.ord = w.best
  JOIN (SELECT k1, k2, k3, string_agg(slug, '|' ORDER BY first) AS sources
        FROM (SELECT k1, k2, k3, slug, min(ord) AS first FROM equiv_scored GROUP BY ALL) GROUP BY ALL) s
    ON s.k1 = w.k1 AND s.k2 = w.k2 AND s.k3 = w.k3)"""


def with_sql(*views: str) -> str:
    return "WITH " + ",\n".join(v.strip() for v in views) + "\n"
