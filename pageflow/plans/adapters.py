"""Deterministic views of the shared tables, as SQL that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("lineitem", "part", "orders", "documents", "labels", "events", "pages", "embeddings", "conversations")

TOK = """SELECT CAST(l_orderkey AS BIGINT) AS page_id, CAST(ord AS BIGINT) AS ord,
  CASE ord % 5 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_brand WHEN 3 THEN concat('Page ', CAST(l_linenumber AS VARCHAR(9))) ELSE CAST(l_partkey AS VARCHAR(9)) END AS text,
  round(1 - l_discount * 8, 4) AS confidence,
  CAST(l_partkey * 7 % 900 AS INT) AS x0, CAST(l_suppkey * 13 % 1200 AS INT) AS y0,
  CAST(l_partkey * 7 % 900 + 20 + l_quantity * 3 AS INT) AS x1, CAST(l_suppkey * 13 % 1200 + 10 + l_linenumber * 5 AS INT) AS y1
FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS ord FROM lineitem l) x
JOIN part ON l_partkey = p_partkey"""
CARDS = """SELECT sha1(concat('doc|', CAST(doc_id AS VARCHAR(20)))) AS card_id, CAST(doc_id AS BIGINT) AS doc_id, source AS page_id, CAST(doc_id % 37 AS INT) AS token_index,
  concat('w', CAST(n_chars AS VARCHAR(12))) AS word, CASE WHEN doc_id % 11 = 0 THEN 'page_fallback' WHEN doc_id % 13 = 0 THEN 'unknown' ELSE 'bbox_crop' END AS method,
  CASE WHEN doc_id % 17 = 0 THEN 'rejected' WHEN n_chars % 3 = 0 THEN 'review' ELSE 'active' END AS status, n_chars % 3 = 0 AS needs_review,
  CASE WHEN doc_id % 19 = 0 THEN '../x.png' WHEN doc_id % 23 = 0 THEN '/abs/x.png' WHEN doc_id % 29 = 0 THEN '' ELSE concat('img/', CAST(doc_id % 50 AS VARCHAR(9)), '/c.png') END AS front_image_path
FROM documents"""
FB = """SELECT CAST(event_id AS BIGINT) AS ord, sha1(concat('doc|', CAST(user_id % 400 AS VARCHAR(20)))) AS card_id,
  CASE event_type WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'edit' ELSE event_type END AS action,
  CASE WHEN event_id % 5 = 0 THEN ' ' ELSE concat('e', CAST(event_id AS VARCHAR(20))) END AS edited_text,
  CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'below' WHEN 1 THEN 'above' WHEN 2 THEN 'left' ELSE 'right' END AS direction
FROM events"""
PX = "SELECT CAST(vec_id AS BIGINT) AS key, CAST(i AS BIGINT) AS i, CAST(greatest(0, least(255, floor(128 + 256 * CAST(v AS DOUBLE)))) AS BIGINT) AS value FROM "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The query over a folder's tables: just those it names are read, and no view is left."""
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in used})


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, TOK)
    return t.select("page_id", "ord", "text", "confidence", F.struct("x0", "y0", "x1", "y1").alias("box"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, CARDS).withColumn("source_ref", F.concat(F.lit("doc#"), "doc_id")).withColumn("reasons", F.array_compact(F.array(F.when(F.col("needs_review"), "LOW_CONFIDENCE"), F.when(F.col("method") == "page_fallback", "PAGE_FALLBACK"))))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, FB)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, PX + "(SELECT vec_id, p.pos AS i, p.col AS v FROM embeddings LATERAL VIEW posexplode(embedding) p AS pos, col)")


#: The same for the other engine.
PX_SQL = PX + "(SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings)"
