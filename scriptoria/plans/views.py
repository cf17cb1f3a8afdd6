"""The corpus model over the provided tables.

papers: documents with a title, a year and a venue. citations: order lines as edges
from orders to parts. authors: suppliers of an order. jobs: events as stage jobs.
Each function has a twin in SQL, a common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.session import table

PAPERS_SQL = "papers AS (SELECT doc_id, split_part(text, '.', 1) AS title, text AS abstract, 1990 + doc_id % 35 AS year, source AS venue, lang, n_chars FROM documents)"
CITATIONS_SQL = "citations AS (SELECT l_orderkey AS citing, l_partkey AS cited FROM lineitem)"
JOBS_SQL = """jobs AS (SELECT event_id AS job_id, user_id AS document_id, event_type AS stage, ts::TIMESTAMP AS created_at,
  CASE WHEN json_extract_string(props, '$.k')::INT % 10 = 0 THEN 'failed' ELSE 'completed' END AS status,
  floor(value * 1000)::BIGINT AS duration_ms, json_extract_string(props, '$.k')::INT AS k FROM events)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.col("text").alias("abstract"), (1990 + F.col("doc_id") % 35).alias("year"), F.col("source").alias("venue"), "lang", "n_chars")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k % 10 == 0, "failed").otherwise("completed")
    return e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"), F.col("ts").alias("created_at"), status.alias("status"), F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"), k.alias("k"))
