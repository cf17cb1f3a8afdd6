"""Search over written indexes, and title matching. An index of a table is written once for
each session and state of the table, below the checkpoint folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scriptoria.operators import ann, fulltext, matching
from scriptoria.plans.registry import query
from scriptoria.session import checkpoint_folder, table, version_of

_indexes: dict[tuple[str, str, str, str], object] = {}


def _index(spark: SparkSession, d: str, name: str, kind: str, write: Callable[[str], object]):
    source = f"{d}/{name}.parquet"
    key = (spark.sparkContext.applicationId, kind, source, version_of(spark, source))
    if key not in _indexes:
        _indexes[key] = write(f"{checkpoint_folder(spark)}/{kind}-{key[3]}")
    return _indexes[key]


def vector_index(spark: SparkSession, d: str) -> ann.Index:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return _index(spark, d, "embeddings", "vectors", lambda path: ann.write_index(e, path))


@query("r2_ann_search")
def r2_ann(spark, d):
    """The ten nearest of every fiftieth vector by the inverted-file index (recall 0.9 or more)."""
    asked = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).where("id % 50 = 0")
    return vector_index(spark, d).search(asked, 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("p6_ann_filtered")
def p6_ann(spark, d):
    """The same among vectors of two labels: the condition is tried on the codes' payload."""
    asked = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).where("id % 50 = 0")
    return vector_index(spark, d).search(asked, 10, where=F.col("label").isin(1, 2)).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_TOKEN_SQL = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_FIELDS = (("split_part(text, '.', 1)", 100), ("text", 40), ("source", 10))


@query(
    "r5_weighted_full_text",
    "WITH p AS (" + " UNION ALL ".join(f"SELECT doc_id, unnest({_TOKEN_SQL.format(c)}) AS t, {w} AS w FROM documents" for c, w in _FIELDS)
    + "), s AS (SELECT doc_id, sum(w) AS impact, count(DISTINCT t) AS n FROM p WHERE t IN ('the', 'of', 'and') GROUP BY doc_id) SELECT doc_id, impact / 100.0::DOUBLE AS score FROM s WHERE n = 3 ORDER BY s.impact DESC, doc_id LIMIT 50",
)
def r5(spark, d):
    fields = {"title": "A", "abstract": "B", "journal": "D"}
    rows = table(spark, d, "documents").select("doc_id", F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.col("text").alias("abstract"), F.col("source").alias("journal"))
    index = _index(spark, d, "documents", "fields", lambda path: fulltext.write_fields(rows, "doc_id", fields, path))
    return index.search("the of and", 50).select(F.col("id").alias("doc_id"), "score")


@query("f15_j9_title_match")
def f15(spark, d):
    """For every document whose id is divisible by 50: the classes of equal titles, among all
    documents, that are 0.85 or more like its own. `other` is a class's least document."""
    title = F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^.\n]*", 0))
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), title.alias("title"))
    return matching.title_search(t, F.col("id") % 50 == 0).select(F.col("id").alias("doc"), "other", "size", F.round("similarity", 4).alias("similarity"))
