"""Evaluation queries; ranks and outcomes are derived from key columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.operators import evaluation as ops
from scriptoria.plans.registry import query
from scriptoria.session import table


@query(
    "e1_rank_metrics",
    "WITH r AS (SELECT l_returnflag AS arm, (l_orderkey * 7 + l_linenumber) % 14 AS k FROM lineitem) SELECT arm, count(*)::BIGINT AS n, round(avg(CASE WHEN k BETWEEN 1 AND 10 THEN 1.0 / k ELSE 0 END), 6) AS mrr10, round(avg((k = 1)::INT), 6) AS recall1, round(avg((k BETWEEN 1 AND 10)::INT), 6) AS recall10, round(avg(CASE WHEN k BETWEEN 1 AND 10 THEN 1.0 / log2(k + 1) ELSE 0 END), 6) AS ndcg10, round(100 * avg((k = 0)::INT), 6) AS not_found_pct FROM r GROUP BY arm",
)
def e1(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("arm"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 14).alias("k"))
    m = ops.rank_metrics(r, "k", ["arm"])
    return m.select("arm", "n", *[F.round(c, 6).alias(c) for c in ("mrr10", "recall1", "recall10", "ndcg10", "not_found_pct")])


_RANKS = "SELECT o_custkey AS q, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY {}) AS rank FROM orders"


@query(
    "e2_displacement",
    f"WITH a AS ({_RANKS.format('o_orderkey')}), b AS ({_RANKS.format('o_totalprice DESC, o_orderkey')}) SELECT a.q, round(avg(abs(a.rank - b.rank)), 6) AS move, NOT bool_or(a.rank = 1 AND b.rank = 1) AS top_changed FROM a JOIN b ON a.q = b.q AND a.id = b.id GROUP BY a.q",
)
def e2(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    ranks = lambda *order: o.select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)).alias("rank"))
    m = ops.displacement(ranks("o_orderkey"), ranks(F.desc("o_totalprice"), F.asc("o_orderkey")), ["q"])
    return m.select("q", F.round("move", 6).alias("move"), "top_changed")


@query(
    "e3_leg_overlap",
    "WITH a AS (SELECT o_custkey AS q, list(o_orderkey) FILTER (WHERE o_totalprice > 100000) AS x, list(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS y FROM orders GROUP BY 1) SELECT q, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0)::DOUBLE, 0), 6) AS overlap FROM (SELECT q, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a)",
)
def e3(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("q")).agg(F.collect_list(F.when(F.col("o_totalprice") > 100000, F.col("o_orderkey"))).alias("x"), F.collect_list(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey"))).alias("y"))
    return g.select("q", F.round(ops.set_overlap(F.col("x"), F.col("y")), 6).alias("overlap"))


@query("e4_bootstrap")
def e4(spark, d):
    return ops.bootstrap(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "c_acctbal", 200)


@query(
    "e5_mcnemar",
    "WITH p AS (SELECT o_orderkey % 5 < 3 AS a, o_orderkey % 7 < 4 AS b FROM orders), g AS (SELECT count(*) FILTER (WHERE NOT a AND b) AS b, count(*) FILTER (WHERE a AND NOT b) AS c FROM p) SELECT b::BIGINT AS b, c::BIGINT AS c, round((abs(b - c) - 1) ** 2 / (b + c), 6)::DOUBLE AS statistic, CASE WHEN c > b THEN 'A_better' WHEN b > c THEN 'B_better' ELSE 'tie' END AS direction FROM g",
)
def e5(spark, d):
    k = F.col("o_orderkey")
    return ops.mcnemar(table(spark, d, "orders").select((k % 5 < 3).alias("a_correct"), (k % 7 < 4).alias("b_correct"))).select("b", "c", F.round("statistic", 6).alias("statistic"), "direction")


_PAIRS = "SELECT l_orderkey AS output, l_linenumber % 3 AS sentence, l_linenumber AS source, (l_partkey % 100) / 100.0::DOUBLE AS score FROM lineitem"


@query("e7_faithfulness", f"WITH s AS (SELECT output, sentence, max(score) AS m FROM ({_PAIRS}) GROUP BY ALL) SELECT output, round(avg(m), 6) AS mean, min(m) AS least, round(100 * avg((m < 0.5)::INT), 6) AS below_pct FROM s GROUP BY output")
def e7(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("output"), (F.col("l_linenumber") % 3).alias("sentence"), ((F.col("l_partkey") % 100) / 100.0).alias("score"))
    return ops.faithfulness(p).select("output", F.round("mean", 6).alias("mean"), "least", F.round("below_pct", 6).alias("below_pct"))


@query(
    "e9_citation_alignment",
    "WITH p AS (SELECT l_orderkey AS sentence, 1 AS claimed, l_linenumber AS source, (l_partkey % 100) / 100.0::DOUBLE AS score FROM lineitem), b AS (SELECT sentence, coalesce(max(score) FILTER (WHERE source = claimed), 0) AS own, max(score) AS top, first(source ORDER BY score DESC, source) AS best FROM p GROUP BY sentence) SELECT sentence, 1 AS claimed, CASE WHEN own < 0.5 AND top - own >= 0.15 THEN best ELSE 1 END AS assigned, own < 0.5 AND top - own >= 0.15 AS moved FROM b",
)
def e9(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sentence"), F.lit(1).alias("claimed"), F.col("l_linenumber").alias("source"), ((F.col("l_partkey") % 100) / 100.0).alias("score"))
    return ops.alignment(p)


@query("e11_regression", "SELECT p_brand AS kind, round(regr_slope(p_retailprice, p_size), 5) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2 FROM part GROUP BY p_brand HAVING count(*) >= 3")
def e11(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("kind")).agg(F.count("*").alias("n"), *[f("p_retailprice", "p_size").alias(k) for k, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2))])
    return g.where("n >= 3").select("kind", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query(
    "e12_equal_lengths",
    "WITH w AS (SELECT doc_id, string_split(source || ' ' || lang || ' ' || repeat('x ', (doc_id % 9)::INT) || 'end', ' ') AS w FROM documents), m AS (SELECT floor(quantile_cont(len(w), 0.5))::BIGINT AS m FROM w) SELECT doc_id, array_to_string(w[1:m], ' ') AS clipped FROM w, m",
)
def e12(spark, d):
    text = F.concat_ws(" ", "source", "lang", F.concat(F.expr("repeat('x ', cast(doc_id % 9 as int))"), F.lit("end")))
    w = table(spark, d, "documents").select("doc_id", F.split(text, " ").alias("w"))
    m = w.agg(F.floor(F.percentile(F.size("w"), F.lit(0.5))).cast("int").alias("m"))
    return w.join(F.broadcast(m)).select("doc_id", F.array_join(F.slice("w", F.lit(1), F.col("m")), " ").alias("clipped"))


@query(
    "e13_win_rates",
    "WITH d AS (SELECT c_nationkey AS a, (c_nationkey * 7 + 3) % 25 AS b, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'tie' END AS o FROM customer), s AS (SELECT a AS player, (o = 'a')::INT AS w, (o = 'b')::INT AS l FROM d UNION ALL SELECT b, (o = 'b')::INT, (o = 'a')::INT FROM d) SELECT player, round(100.0 * sum(w) / nullif(sum(w) + sum(l), 0), 6) AS rate FROM s GROUP BY player",
)
def e13(spark, d):
    k = F.col("c_custkey") % 3
    duels = table(spark, d, "customer").select(F.col("c_nationkey").alias("a"), ((F.col("c_nationkey") * 7 + 3) % 25).alias("b"), F.when(k == 0, "a").when(k == 1, "b").otherwise("tie").alias("outcome"))
    return ops.win_rates(duels).select("player", F.round("rate", 6).alias("rate"))


@query(
    "e14_review_merge",
    "SELECT l_orderkey AS draft, round(quantile_cont(l_quantity, 0.5), 4) AS median, round(stddev_samp(l_quantity), 6) AS spread, max(l_quantity) - min(l_quantity) AS range, CASE WHEN quantile_cont(l_quantity, 0.5) >= 35 THEN 'accept' WHEN quantile_cont(l_quantity, 0.5) >= 20 THEN 'revise' ELSE 'reject' END AS decision FROM lineitem GROUP BY l_orderkey",
)
def e14(spark, d):
    q = F.col("l_quantity")
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("draft")).agg(F.percentile(q, F.lit(0.5)).alias("m"), F.round(F.stddev_samp(q), 6).alias("spread"), (F.max(q) - F.min(q)).alias("range"))
    return g.select("draft", F.round("m", 4).alias("median"), "spread", "range", F.when(F.col("m") >= 35, "accept").when(F.col("m") >= 20, "revise").otherwise("reject").alias("decision"))


@query(
    "e15_snapshot_diff",
    "WITH a AS (SELECT event_type AS metric, count(*) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, count(*) AS v FROM events WHERE event_id % 2 = 1 AND event_type <> 'view' GROUP BY 1) SELECT coalesce(a.metric, b.metric) AS metric, a.v::BIGINT AS before, b.v::BIGINT AS after, round(100.0 * (b.v - a.v) / a.v, 6)::DOUBLE AS change_pct FROM a FULL JOIN b ON a.metric = b.metric",
)
def e15(spark, d):
    e = table(spark, d, "events")
    side = lambda c, name: e.where(c).groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias(name))
    j = side("event_id % 2 = 0", "before").join(side("event_id % 2 = 1 AND event_type <> 'view'", "after"), "metric", "full")
    return j.withColumn("change_pct", F.round(F.try_divide(100.0 * (F.col("after") - F.col("before")), F.col("before")), 6))


@query("e16_convergence", "WITH r AS (SELECT l_orderkey, max(l_linenumber) AS rounds, max(l_discount) - min(l_discount) AS gain FROM lineitem GROUP BY l_orderkey) SELECT rounds, count(*)::BIGINT AS runs, round(avg(gain), 6) AS gain FROM r GROUP BY rounds")
def e16(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("rounds"), (F.max("l_discount") - F.min("l_discount")).alias("gain"))
    return r.groupBy("rounds").agg(F.count("*").alias("runs"), F.round(F.avg("gain"), 6).alias("gain"))


@query(
    "e17_refinement_gate",
    "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 3 THEN 'external_verification' END, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'constrained_scope' END, CASE WHEN p_partkey % 5 = 0 THEN 'structured_reasoning' END, CASE WHEN p_partkey % 3 <> 0 AND p_size * 10 < 120 THEN 'decision_space' END], lambda x: x IS NOT NULL), ',') AS failures FROM part",
)
def e17(spark, d):
    k = F.col("p_partkey")
    gate = ops.refinement_gate(F.when(k % 2 == 0, "Discussion").otherwise("methods"), F.when(k % 3 != 0, F.col("p_size") * 10), F.col("p_size"), k % 5 != 0)
    return table(spark, d, "part").select("p_partkey", F.array_join(gate, ",").alias("failures"))


@query("e18_corpus_sizes", "SELECT (SELECT count(*) FROM documents)::BIGINT AS documents, (SELECT count(*) FROM pages)::BIGINT AS pages, (SELECT count(*) FROM embeddings)::BIGINT AS vectors, (SELECT count(DISTINCT conv_id) FROM conversations)::BIGINT AS conversations")
def e18(spark, d):
    n = lambda t, c: table(spark, d, t).agg(c)
    one = n("documents", F.count("*").alias("documents")).join(n("pages", F.count("*").alias("pages")))
    return one.join(n("embeddings", F.count("*").alias("vectors"))).join(n("conversations", F.countDistinct("conv_id").alias("conversations")))
