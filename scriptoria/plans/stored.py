"""Stored merges. Each run of a query builds its table anew in a folder of its own below the
checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptoria.plans.registry import query
from scriptoria.session import checkpoint_folder, table
from scriptoria.sources import stored


def _table(spark, schema: str, key: list[str]) -> stored.StoredTable:
    return stored.StoredTable(spark, f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}", schema, key, 8)


@query(
    "k2_stored_merge",
    "WITH l AS (SELECT l_partkey, max(l_returnflag) AS note FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT coalesce(p_partkey, l_partkey) AS id, CASE WHEN p_partkey IS NULL THEN 'found' WHEN p_partkey % 3 = 0 AND l_partkey IS NOT NULL THEN 'found' ELSE p_name END AS title, coalesce(note, p_brand) AS note, CASE WHEN p_partkey IS NOT NULL AND l_partkey IS NOT NULL THEN 2 ELSE 1 END AS attempts FROM (SELECT * FROM part WHERE p_size <= 25) p FULL JOIN l ON p_partkey = l_partkey",
)
def k2_stored(spark, d):
    """Pending downloads: a second batch keeps the richer of both and counts attempts; the
    same batch once more changes nothing."""
    pending = _table(spark, "id long, title string, note string, attempts int", ["id"])
    rule = stored.counted(stored.keep_richer("title", "note"), "attempts")
    first = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("note"), F.lit(1).alias("attempts"))
    pending.merge(first, rule, "first")
    line = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_returnflag").alias("note"), F.lit(1).alias("attempts"))
    known = first.select("id", F.lit(True).alias("known"))
    second = line.join(known, "id", "left").withColumn("title", F.when(F.col("known").isNull() | (F.col("id") % 3 == 0), "found").otherwise("")).drop("known")
    for _ in range(2):
        pending.merge(second, rule, "second")
    return pending.read()


@query(
    "k4_stored_pages",
    "SELECT source AS slug, max(doc_id) AS version, arg_max(substr(text, 1, 40), doc_id) AS body FROM documents WHERE text IS NOT NULL GROUP BY source",
)
def k4_stored(spark, d):
    """Pages by slug, the last writer wins: three batches by document id."""
    pages = _table(spark, "slug string, version long, body string", ["slug"])
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    cuts = [r[0] for r in docs.select(F.explode(F.percentile_approx("doc_id", F.array(F.lit(0.33), F.lit(0.66))))).collect()]
    for n, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = docs if low is None else docs.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        rows = part.groupBy(F.col("source").alias("slug")).agg(F.max_by(F.struct(F.col("doc_id").alias("version"), F.substring("text", 1, 40).alias("body")), "doc_id").alias("r")).select("slug", "r.version", "r.body")
        pages.merge(rows, stored.last_writer("version", "body"), f"batch-{n}")
    return pages.read()
