"""Trees of spans and density clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptoria.operators import density, trees
from scriptoria.plans.registry import query
from scriptoria.plans.search import vector_index
from scriptoria.session import table


@query(
    "j16_span_tree",
    "WITH RECURSIVE t AS (SELECT p_partkey AS id, 0::BIGINT AS depth, p_partkey AS root FROM part WHERE p_partkey IN (1, 2) UNION ALL SELECT c.p_partkey, t.depth + 1, t.root FROM part c JOIN t ON c.p_partkey // 3 = t.id AND c.p_partkey > 2) SELECT id, root, depth FROM t",
)
def j16(spark, d):
    """Parts as spans whose parent is a third of their key; 1 and 2 have none."""
    p = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    return trees.rooted(p).select("id", "root", "depth")


@query("j16_event_chains", "SELECT event_id AS id, first_value(event_id) OVER w AS root, row_number() OVER w - 1 AS depth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def j16_chains(spark, d):
    """Each event's parent is the one before it of the same user: chains of hundreds."""
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return trees.rooted(table(spark, d, "events").select(F.col("event_id").alias("id"), before.alias("parent"))).select("id", "root", "depth")


@query("g16_topic_clusters")
def g16(spark, d):
    """Density clusters of the vectors on the graph of their fifteen nearest neighbours, which
    the inverted-file index finds; topic -1 is noise."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = vector_index(spark, d).search(e, 15).select(F.col("query_id").alias("id"), F.col("id").alias("other"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("distance"))
    return density.density_clusters(e.select("id"), near, min_size=5, min_points=3).select(F.col("id").alias("vec_id"), "topic")
