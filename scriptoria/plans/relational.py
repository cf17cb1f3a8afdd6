"""Projections, filters, joins, aggregates, windows, sorts, sets and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.operators import relational as ops
from scriptoria.plans.registry import query
from scriptoria.plans.views import CITATIONS_SQL, JOBS_SQL, PAPERS_SQL, citations, jobs, papers
from scriptoria.session import table


@query("p1_optional_filters", f"WITH {PAPERS_SQL} SELECT doc_id, year, venue FROM papers WHERE year >= 2000 AND year <= 2010 AND lang = 'en' AND venue ILIKE '%SRC1%'")
def p1(spark: SparkSession, d: str) -> DataFrame:
    author = None
    conditions = [F.col("year") >= 2000, F.col("year") <= 2010, F.col("lang") == "en", F.col("venue").ilike("%SRC1%"), author]
    return papers(spark, d).where(ops.all_of(conditions)).select("doc_id", "year", "venue")


@query("p2_ilike", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%build%' OR c_name ILIKE '%00001%'")
def p2(spark, d):
    return table(spark, d, "customer").where(F.col("c_mktsegment").ilike("%build%") | F.col("c_name").ilike("%00001%")).select("c_custkey", "c_name", "c_mktsegment")


@query(
    "p3_exists_in_array",
    "WITH s AS (SELECT l_orderkey, list(l_suppkey) AS suppliers FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, len(suppliers)::BIGINT AS n FROM s WHERE len(list_filter(suppliers, lambda x: x % 50 = 7)) > 0",
)
def p3(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("suppliers"))
    return s.where(F.exists("suppliers", lambda x: x % 50 == 7)).select("l_orderkey", F.size("suppliers").cast("long").alias("n"))


@query("p4_any_of_array", "WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_custkey) SELECT o_custkey FROM s WHERE list_contains(p, '1-URGENT')")
def p4(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return s.where(F.array_contains("p", "1-URGENT")).select("o_custkey")


@query("p5_year_range", f"WITH {PAPERS_SQL} SELECT doc_id, year FROM papers WHERE year BETWEEN 1995 AND 1999")
def p5(spark, d):
    return papers(spark, d).where(F.col("year").between(1995, 1999)).select("doc_id", "year")


@query("p7_effectively_empty", "SELECT count(*) FILTER (WHERE lang IS NULL OR lang = '')::BIGINT AS no_lang, count(*) FILTER (WHERE source IS NULL OR source = '')::BIGINT AS no_source, count(*)::BIGINT AS n FROM documents")
def p7(spark, d):
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return table(spark, d, "documents").agg(F.count_if(empty("lang")).alias("no_lang"), F.count_if(empty("source")).alias("no_source"), F.count("*").alias("n"))


@query("p8_case_projection", f"WITH {JOBS_SQL} SELECT job_id, CASE WHEN status = 'failed' THEN 'bad' WHEN duration_ms > 50000 THEN 'slow' ELSE 'fine' END AS verdict FROM jobs")
def p8(spark, d):
    v = F.when(F.col("status") == "failed", "bad").when(F.col("duration_ms") > 50000, "slow").otherwise("fine")
    return jobs(spark, d).select("job_id", v.alias("verdict"))


@query("p9_coalesce_nullif", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status FROM orders")
def p9(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("open")).alias("status"))


@query("p10_greatest_least", "SELECT p_partkey, greatest(0, least(26, p_size - 10)) / 26.0 AS recency FROM part")
def p10(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.greatest(F.lit(0), F.least(F.lit(26), F.col("p_size") - 10)) / F.lit(26.0)).alias("recency"))


@query("p11_json_access", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.error') IS NOT NULL AS has_error FROM events")
def p11(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.error").isNotNull().alias("has_error"))


@query("p12_in_grouped_subquery", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) >= 40)")
def p12(spark, d):
    line = table(spark, d, "lineitem")
    frequent = line.groupBy("l_partkey").count().where("count >= 40")
    return line.join(frequent, "l_partkey", "left_semi").select("l_orderkey", "l_partkey")


@query("p13_prefix_id", "SELECT doc_id, source FROM documents WHERE starts_with(doc_id::VARCHAR, '12')")
def p13(spark, d):
    return table(spark, d, "documents").where(F.col("doc_id").cast("string").startswith("12")).select("doc_id", "source")


@query("p14_either_side", "SELECT s_suppkey, s_nationkey FROM supplier WHERE lower(s_name) IN ('supplier#000000001', 'supplier#000000002') OR s_nationkey = 3")
def p14(spark, d):
    return table(spark, d, "supplier").where(F.lower("s_name").isin("supplier#000000001", "supplier#000000002") | (F.col("s_nationkey") == 3)).select("s_suppkey", "s_nationkey")


@query(
    "p15_page_with_total",
    f"WITH {PAPERS_SQL}, t AS (SELECT count(*) AS total FROM papers) SELECT doc_id, year, total::BIGINT AS total, ceil(total / 25.0)::BIGINT AS n_pages FROM (SELECT doc_id, year FROM papers ORDER BY year DESC, doc_id LIMIT 25 OFFSET 50), t",
)
def p15(spark, d):
    p = papers(spark, d)
    total = p.agg(F.count("*").alias("total"))
    shown = ops.page(p, [F.desc("year"), F.asc("doc_id")], 3, 25)
    return shown.join(F.broadcast(total)).select("doc_id", "year", "total", F.ceil(F.col("total") / 25).alias("n_pages"))


@query("j1_inner_chain", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
def j1(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000")
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("j2_left_outer", "SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def j2(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query(
    "j3_left_on_aggregate",
    f"WITH {PAPERS_SQL}, {CITATIONS_SQL}, c AS (SELECT cited, count(*) AS n FROM citations GROUP BY cited) SELECT doc_id, coalesce(n, 0)::BIGINT AS n_cited FROM papers LEFT JOIN c ON doc_id = cited",
)
def j3(spark, d):
    counts = citations(spark, d).groupBy(F.col("cited").alias("doc_id")).agg(F.count("*").alias("n"))
    return papers(spark, d).join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_cited"))


@query("j4_anti", f"WITH {PAPERS_SQL} SELECT doc_id FROM papers WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = doc_id AND l_linenumber = 7 AND l_quantity < 5)")
def j4(spark, d):
    """Papers without a citation of a kind."""
    p, c = papers(spark, d), table(spark, d, "lineitem").where("l_linenumber = 7 AND l_quantity < 5").select(F.col("l_partkey").alias("cited"))
    return p.join(c, p.doc_id == c.cited, "left_anti").select("doc_id")


@query(
    "j5_semi",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 2) AND l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 2) AND l_shipdate < TIMESTAMP '1996-01-01'",
)
def j5(spark, d):
    line = table(spark, d, "lineitem")
    twice = lambda c: line.groupBy(c).count().where("count >= 2")
    recent = line.where("l_shipdate < TIMESTAMP '1996-01-01'")
    return recent.join(twice("l_suppkey"), "l_suppkey", "left_semi").join(twice("l_partkey"), "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("j6_lateral_unnest", "SELECT w, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY w")
def j6(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("j7_scalar_subquery", "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey)::BIGINT AS n_lines FROM supplier")
def j7(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "supplier").join(n, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query(
    "j8_calendar_spine",
    f"WITH {JOBS_SQL}, spine AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-12', INTERVAL 1 WEEK)) AS b), g AS (SELECT date_trunc('week', created_at) AS b, count(*) AS n FROM jobs GROUP BY 1) SELECT strftime(spine.b, '%Y-%m-%d') AS week, coalesce(n, 0)::BIGINT AS n_jobs FROM spine LEFT JOIN g ON spine.b = g.b",
)
def j8(spark, d):
    z = ops.zero_filled(jobs(spark, d), "created_at", "week", "2023-12-25", "2024-02-12", {"n_jobs": F.count("*")})
    return z.select(F.date_format("bucket", "yyyy-MM-dd").alias("week"), "n_jobs")


@query(
    "j10_normalised_key",
    "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON lower(trim(regexp_replace(c_name, '^[^#]*#', ''))) = lower(trim(regexp_replace(s_name, '^[^#]*#', '')))",
)
def j10(spark, d):
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, "^[^#]*#", "")))
    c = table(spark, d, "customer").select("c_custkey", key("c_name").alias("k"))
    s = table(spark, d, "supplier").select("s_suppkey", key("s_name").alias("k"))
    return c.join(s, "k").select("c_custkey", "s_suppkey")


@query("a1_count_by_group", "SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY lang, source")
def a1(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("a2_count_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey)::BIGINT AS orders, count(DISTINCT l_partkey)::BIGINT AS parts FROM lineitem GROUP BY l_returnflag")
def a2(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))


@query("a3_filtered_aggregate", f"WITH {JOBS_SQL} SELECT stage, count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed, max(duration_ms) FILTER (WHERE status = 'completed') AS longest FROM jobs GROUP BY stage")
def a3(spark, d):
    done = F.when(F.col("status") == "completed", F.col("duration_ms"))
    return jobs(spark, d).groupBy("stage").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.max(done).alias("longest"))


@query(
    "a4_percentiles",
    f"WITH {JOBS_SQL} SELECT stage, round(quantile_cont(duration_ms, 0.25), 3) AS p25, round(quantile_cont(duration_ms, 0.5), 3) AS p50, round(quantile_cont(duration_ms, 0.75), 3) AS p75, round(quantile_cont(duration_ms, 0.95) FILTER (WHERE status = 'completed'), 3) AS p95 FROM jobs GROUP BY stage",
)
def a4(spark, d):
    ok = F.when(F.col("status") == "completed", F.col("duration_ms"))
    p = lambda c, s: F.round(F.percentile(c, F.lit(s)), 3)
    return jobs(spark, d).groupBy("stage").agg(p("duration_ms", 0.25).alias("p25"), p("duration_ms", 0.5).alias("p50"), p("duration_ms", 0.75).alias("p75"), p(ok, 0.95).alias("p95"))


@query(
    "a5_sums",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS lo, max(l_tax) AS hi, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS deep FROM lineitem GROUP BY ALL",
)
def a5(spark, d):
    return (
        table(spark, d, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"), F.count_if(F.col("l_discount") > 0.05).alias("deep"))
    )


@query("a6_having", "SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def a6(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 12")


@query("a7_array_agg", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses, min(o_orderpriority) AS first_priority FROM orders GROUP BY o_custkey")
def a7(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.min("o_orderpriority").alias("first_priority"))


@query("a8_bool_or", f"WITH {JOBS_SQL} SELECT document_id, bool_or(status = 'failed') AS any_failed FROM jobs GROUP BY document_id")
def a8(spark, d):
    return jobs(spark, d).groupBy("document_id").agg(F.bool_or(F.col("status") == "failed").alias("any_failed"))


@query("a9_computed_buckets", f"WITH {PAPERS_SQL} SELECT 10 * (year // 10) AS decade, count(*)::BIGINT AS n FROM papers GROUP BY 1")
def a9(spark, d):
    return papers(spark, d).groupBy((10 * F.floor(F.col("year") / 10)).alias("decade")).agg(F.count("*").alias("n"))


@query(
    "a10_heatmap_with_other",
    f"WITH {JOBS_SQL}, top AS (SELECT k FROM jobs GROUP BY k ORDER BY count(*) DESC, k LIMIT 12) SELECT strftime(created_at, '%Y-%m-%d') AS day, CASE WHEN k IN (SELECT k FROM top) THEN k::VARCHAR ELSE '(other)' END AS operation, count(*)::BIGINT AS n FROM jobs GROUP BY ALL",
)
def a10(spark, d):
    j = jobs(spark, d)
    top = j.groupBy("k").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "k").limit(12).select("k", F.lit(True).alias("in_top"))
    named = j.join(F.broadcast(top), "k", "left").withColumn("operation", F.when(F.col("in_top"), F.col("k").cast("string")).otherwise("(other)"))
    return named.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "operation").agg(F.count("*").alias("n"))


@query(
    "a11_two_level",
    f"WITH {JOBS_SQL}, s AS (SELECT document_id, stage, sum(duration_ms) AS ms FROM jobs GROUP BY ALL) SELECT document_id, sum(ms)::BIGINT AS total_ms, string_agg(stage || '=' || ms::BIGINT, ';' ORDER BY stage) AS by_stage FROM s GROUP BY document_id ORDER BY total_ms DESC, document_id LIMIT 20",
)
def a11(spark, d):
    s = jobs(spark, d).groupBy("document_id", "stage").agg(F.sum("duration_ms").alias("ms"))
    pair = F.concat_ws("=", "stage", F.col("ms").cast("string"))
    g = s.groupBy("document_id").agg(F.sum("ms").alias("total_ms"), F.array_join(F.array_sort(F.collect_list(pair)), ";").alias("by_stage"))
    return g.orderBy(F.desc("total_ms"), "document_id").limit(20)


@query(
    "a12_coverage_shares",
    "SELECT source, lang, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source), 4) AS pct FROM documents GROUP BY source, lang",
)
def a12(spark, d):
    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("source")), 4))


@query(
    "a13_most_common_with_first",
    "SELECT l_suppkey, count(*)::BIGINT AS n, min_by(l_partkey, (l_orderkey * 10 + l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 50",
)
def a13(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min_by("l_partkey", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_partkey"))).alias("first_part"))
    return g.orderBy(F.desc("n"), "l_suppkey").limit(50)


@query(
    "a14_author_index",
    "WITH c AS (SELECT l_partkey AS k, count(*) AS cites FROM lineitem GROUP BY 1), a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT s_name, count(*)::BIGINT AS papers, sum(cites)::BIGINT AS cites_in FROM a JOIN supplier ON s_suppkey = l_suppkey JOIN c ON k = l_partkey GROUP BY s_name HAVING count(*) >= 2 ORDER BY cites_in DESC, papers DESC, s_name LIMIT 100",
)
def a14(spark, d):
    line = table(spark, d, "lineitem")
    cites = line.groupBy("l_partkey").agg(F.count("*").alias("cites"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    a = line.select("l_suppkey", "l_partkey").distinct().join(cites, "l_partkey").groupBy("l_suppkey").agg(F.count("*").alias("papers"), F.sum("cites").alias("cites_in"))
    a = a.join(names, "l_suppkey").groupBy("s_name").agg(F.sum("papers").alias("papers"), F.sum("cites_in").alias("cites_in"))
    return a.where("papers >= 2").orderBy(F.desc("cites_in"), F.desc("papers"), "s_name").limit(100)


@query("a15_venue_stats", f"WITH {PAPERS_SQL} SELECT venue, count(*)::BIGINT AS n, min(year) AS first_year, max(year) AS last_year, count(DISTINCT lang)::BIGINT AS langs FROM papers GROUP BY venue")
def a15(spark, d):
    return papers(spark, d).groupBy("venue").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("lang").alias("langs"))


@query(
    "a16_histogram",
    "WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT least(9, floor((c_acctbal - lo) / (hi - lo) * 10))::INT AS bin, count(*)::BIGINT AS n FROM customer, b GROUP BY 1",
)
def a16(spark, d):
    return ops.histogram(table(spark, d, "customer"), "c_acctbal", 10).select("bin", "n")


@query(
    "a17_iqr_alignment",
    "SELECT source, round(quantile_cont(n_chars, 0.25), 3) AS q1, round(quantile_cont(n_chars, 0.75), 3) AS q3, CASE WHEN quantile_cont(n_chars, 0.75) < 1000 THEN 'below' WHEN quantile_cont(n_chars, 0.25) > 4000 THEN 'above' ELSE 'overlap' END AS alignment FROM documents GROUP BY source",
)
def a17(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.percentile("n_chars", F.lit(0.25)).alias("q1"), F.percentile("n_chars", F.lit(0.75)).alias("q3"))
    label = F.when(F.col("q3") < 1000, "below").when(F.col("q1") > 4000, "above").otherwise("overlap")
    return g.select("source", F.round("q1", 3).alias("q1"), F.round("q3", 3).alias("q3"), label.alias("alignment"))


@query(
    "a18_index_percentiles",
    "WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, any_value(n)::BIGINT AS n, max(n_chars) FILTER (WHERE i = floor(n * 0.5)) AS p50, max(n_chars) FILTER (WHERE i = floor(n * 0.9)) AS p90, max(n_chars) FILTER (WHERE i = floor(n * 0.99)) AS p99 FROM r GROUP BY lang",
)
def a18(spark, d):
    return ops.index_percentile(table(spark, d, "documents"), ["lang"], "n_chars", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("a19_duplicate_surplus", "SELECT sum(c - 1)::BIGINT AS surplus, count(*)::BIGINT AS n_groups FROM (SELECT count(*) AS c FROM documents GROUP BY sha256(text) HAVING count(*) > 1)")
def a19(spark, d):
    g = table(spark, d, "documents").groupBy(F.sha2("text", 256)).agg(F.count("*").alias("c")).where("c > 1")
    return g.agg(F.sum(F.col("c") - 1).alias("surplus"), F.count("*").alias("n_groups"))


@query(
    "a20_funnel",
    f"WITH {JOBS_SQL}, o(stage, place) AS (VALUES ('signup', 0), ('view', 1), ('click', 2), ('checkout', 3)), c AS (SELECT stage, count(*) AS n FROM jobs GROUP BY stage) SELECT coalesce(o.stage, c.stage) AS stage, coalesce(place, 99) AS place, coalesce(n, 0)::BIGINT AS n FROM o FULL JOIN c ON o.stage = c.stage",
)
def a20(spark, d):
    order = spark.createDataFrame([("signup", 0), ("view", 1), ("click", 2), ("checkout", 3)], "stage string, place int")
    c = jobs(spark, d).groupBy("stage").agg(F.count("*").alias("n"))
    return order.join(c, "stage", "full").select("stage", F.coalesce("place", F.lit(99)).alias("place"), F.coalesce("n", F.lit(0)).alias("n"))


@query("w1_row_number", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w1(spark, d):
    return ops.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w2_distinct_on", "SELECT DISTINCT ON (source, lang) source, lang, doc_id FROM documents ORDER BY source, lang, n_chars DESC, doc_id")
def w2(spark, d):
    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.max(F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("m"))).alias("best"))
    return g.select("source", "lang", (-F.col("best.m")).alias("doc_id"))


@query(
    "w3_active_version",
    "SELECT doc_id % 50 AS section, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 50 ORDER BY (doc_id % 11 = 0) DESC, (n_chars >= 200) DESC, doc_id DESC) = 1",
)
def w3(spark, d):
    v = table(spark, d, "documents").withColumn("section", F.col("doc_id") % 50)
    return ops.latest(v, ["section"], [F.desc(F.col("doc_id") % 11 == 0), F.desc(F.col("n_chars") >= 200), F.desc("doc_id")]).select("section", "doc_id")


@query("w4_previous_version", "SELECT doc_id, n_chars - lag(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS delta FROM documents")
def w4(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.col("n_chars") - F.lag("n_chars").over(Window.partitionBy("source").orderBy("doc_id"))).alias("delta"))


@query(
    "w5_first_appearance_numbers",
    "WITH f AS (SELECT l_orderkey // 20 AS book, l_partkey, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY ALL) SELECT book, l_partkey, row_number() OVER (PARTITION BY book ORDER BY pos, l_partkey) AS number FROM f",
)
def w5(spark, d):
    pos = F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")
    f = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 20).alias("book"), "l_partkey").agg(pos)
    return f.select("book", "l_partkey", F.row_number().over(Window.partitionBy("book").orderBy("pos", "l_partkey")).cast("long").alias("number"))


@query("w7_next_version", "SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_version FROM orders GROUP BY o_custkey")
def w7(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_version"))


@query("t1_nulls_last", "SELECT doc_id, y FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS y FROM documents) ORDER BY y DESC NULLS LAST, doc_id LIMIT 100")
def t1(spark, d):
    y = F.when(F.col("doc_id") % 7 != 0, F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", y.alias("y")).orderBy(F.desc_nulls_last("y"), "doc_id").limit(100)


@query("t3_top_k", f"WITH {CITATIONS_SQL} SELECT cited, count(*)::BIGINT AS n FROM citations GROUP BY cited ORDER BY n DESC, cited LIMIT 5")
def t3(spark, d):
    return citations(spark, d).groupBy("cited").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cited").limit(5)


@query("d1_exact_hash", "SELECT sha256(text) AS h, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY 1")
def d1(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "d3_two_stage_dedup",
    "WITH a AS (SELECT * FROM (SELECT doc_id % 300 AS paper, doc_id, regexp_replace(lower(substr(text, 1, 24)), '[^a-z0-9]', '', 'g') AS t, n_chars FROM documents) QUALIFY row_number() OVER (PARTITION BY paper ORDER BY n_chars DESC, doc_id) = 1) SELECT doc_id, t FROM a QUALIFY row_number() OVER (PARTITION BY t ORDER BY n_chars DESC, doc_id) = 1",
)
def d3(spark, d):
    t = F.regexp_replace(F.lower(F.substring("text", 1, 24)), "[^a-z0-9]", "")
    rows = table(spark, d, "documents").select((F.col("doc_id") % 300).alias("paper"), "doc_id", t.alias("t"), "n_chars")
    order = [F.desc("n_chars"), F.asc("doc_id")]
    return ops.latest(ops.latest(rows, ["paper"], order), ["t"], order).select("doc_id", "t")


@query("d5_minus_known", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45)")
def d5(spark, d):
    known = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(known, "p_partkey", "left_anti").select("p_partkey")


@query(
    "d6_ordered_union",
    "WITH u AS (SELECT 0 AS pool, o_custkey AS id, o_orderkey AS place FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 1, o_custkey, o_orderkey FROM orders WHERE o_orderkey % 7 = 0) SELECT id, pool, place FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY pool, place) = 1",
)
def d6(spark, d):
    o = table(spark, d, "orders")
    pool = lambda n, m: o.where(F.col("o_orderkey") % m == 0).select(F.lit(n).alias("pool"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("place"))
    return ops.latest(pool(0, 5).unionByName(pool(1, 7)), ["id"], [F.col("pool"), F.col("place")]).select("id", "pool", "place")


@query(
    "d9_reconcile_versions",
    "SELECT doc_id % 400 AS work, first(doc_id ORDER BY (doc_id % 3 = 0), n_chars DESC, doc_id) AS canonical, count(*)::BIGINT AS versions FROM documents GROUP BY 1",
)
def d9(spark, d):
    g = table(spark, d, "documents").groupBy((F.col("doc_id") % 400).alias("work"))
    return g.agg(F.min_by("doc_id", F.struct(F.col("doc_id") % 3 == 0, -F.col("n_chars"), F.col("doc_id"))).alias("canonical"), F.count("*").alias("versions"))


@query("d10_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def d10(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query(
    "d11_set_changes",
    "WITH a AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderdate < TIMESTAMP '1995-01-01')) AS before, list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-01-01')) AS after FROM orders GROUP BY 1) SELECT k, array_to_string(list_sort(list_filter(coalesce(after, []), lambda x: NOT list_contains(coalesce(before, []), x))), ',') AS added, array_to_string(list_sort(list_filter(coalesce(before, []), lambda x: NOT list_contains(coalesce(after, []), x))), ',') AS removed FROM a",
)
def d11(spark, d):
    early = F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.when(early, F.col("o_orderpriority"))).alias("before"), F.collect_set(F.when(~early, F.col("o_orderpriority"))).alias("after"))
    joined = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ",")
    return a.select("k", joined("after", "before").alias("added"), joined("before", "after").alias("removed"))


@query(
    "d13_integrity_diff",
    "SELECT 'labels_only' AS side, count(*)::BIGINT AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'documents_only', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def d13(spark, d):
    a, b = table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").select("doc_id")
    n = lambda x, y, side: x.join(y, "doc_id", "left_anti").agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return n(a, b, "labels_only").unionByName(n(b, a, "documents_only"))


@query(
    "k2_upsert_keep_richer",
    "WITH o AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS status, 1 AS attempts FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE upper(c_name) END AS title, 'new' AS status, 1 AS attempts FROM customer WHERE c_custkey % 5 < 3) SELECT coalesce(o.id, n.id) AS id, coalesce(nullif(n.title, ''), o.title) AS title, coalesce(o.status, n.status) AS status, CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL THEN o.attempts + 1 ELSE coalesce(o.attempts, n.attempts) END AS attempts FROM o FULL JOIN n ON o.id = n.id",
)
def k2(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("status"), F.lit(1).alias("attempts"))
    new = c.where("id % 5 < 3").withColumns({"title": F.when(F.col("id") % 3 == 0, "").otherwise(F.upper("title")), "status": F.lit("new")})
    return ops.upsert(c.where("id % 2 = 0"), new, "id", keep_old=("status",), counter="attempts")


@query("k3_last_writer_wins", "SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def k3(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("k5_update_from", "SELECT l_orderkey, l_linenumber, coalesce(o_orderpriority, 'none') AS priority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'")
def k5(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return table(spark, d, "lineitem").join(o, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("o_orderpriority", F.lit("none")).alias("priority"))


@query("k7_delete_orphans", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def k7(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query(
    "t6_clamped_names",
    "WITH a AS (SELECT DISTINCT s_name AS name, l_partkey AS paper FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_name ILIKE '%0%'), n AS (SELECT l_partkey AS paper, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT name, count(*)::BIGINT AS papers, coalesce(sum(n), 0)::BIGINT AS cites FROM a LEFT JOIN n USING (paper) GROUP BY name HAVING count(*) >= 1 ORDER BY cites DESC, papers DESC, name LIMIT 500",
)
def t6(spark, d):
    """Suppliers as authors of the parts they sent; a limit of 100,000 is clamped to 500."""
    line = table(spark, d, "lineitem")
    a = line.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("name"), F.col("l_partkey").alias("paper"))
    return ops.name_index(a, line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("paper")), " 0 ", 100_000, 0)
