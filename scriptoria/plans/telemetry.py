"""Operational analytics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.operators import relational as rel
from scriptoria.operators import telemetry as ops
from scriptoria.plans.registry import query
from scriptoria.plans.views import JOBS_SQL, PAPERS_SQL, jobs, papers
from scriptoria.session import table

NOW = "2024-01-30 00:00:00"


@query(
    "m1_stage_timing",
    f"WITH {JOBS_SQL} SELECT stage, count(*)::BIGINT AS n, round(quantile_cont(duration_ms, 0.5), 3) AS p50, round(quantile_cont(duration_ms, 0.95), 3) AS p95, round(avg(duration_ms), 3) AS mean_ms FROM jobs WHERE status = 'completed' GROUP BY stage",
)
def m1(spark: SparkSession, d: str) -> DataFrame:
    return ops.stage_timing(jobs(spark, d))


@query("m2_failure_rate", f"WITH {JOBS_SQL} SELECT stage, count(*)::BIGINT AS n, count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed, round(100.0 * count(*) FILTER (WHERE status = 'failed') / count(*), 4) AS failed_pct FROM jobs GROUP BY stage")
def m2(spark, d):
    return ops.failure_rate(jobs(spark, d))


@query("m3_daily_throughput", f"WITH {JOBS_SQL} SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, count(DISTINCT document_id)::BIGINT AS documents, count(*)::BIGINT AS jobs FROM jobs GROUP BY 1")
def m3(spark, d):
    return ops.throughput(jobs(spark, d), "day").select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), "documents", "jobs")


@query(
    "m4_growth_windows",
    f"WITH {JOBS_SQL} SELECT count(*) FILTER (WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '{NOW}')::BIGINT AS h24, count(*) FILTER (WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 168 HOUR AND created_at <= TIMESTAMP '{NOW}')::BIGINT AS d7, count(*) FILTER (WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 720 HOUR AND created_at <= TIMESTAMP '{NOW}')::BIGINT AS d30 FROM jobs",
)
def m4(spark, d):
    return ops.recent_counts(jobs(spark, d), NOW, {"h24": 24, "d7": 168, "d30": 720})


@query(
    "m5_hourly_zero_filled",
    f"WITH {JOBS_SQL}, s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-28 00:00:00', TIMESTAMP '2024-01-29 23:00:00', INTERVAL 1 HOUR)) AS b), g AS (SELECT date_trunc('hour', created_at) AS b, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS f FROM jobs GROUP BY 1) SELECT strftime(s.b, '%Y-%m-%d %H') AS hour, coalesce(n, 0)::BIGINT AS n, coalesce(f, 0)::BIGINT AS failed FROM s LEFT JOIN g ON s.b = g.b",
)
def m5(spark, d):
    z = rel.zero_filled(jobs(spark, d), "created_at", "hour", "2024-01-28 00:00:00", "2024-01-29 23:00:00", {"n": F.count("*"), "failed": F.count_if(F.col("status") == "failed")})
    return z.select(F.date_format("bucket", "yyyy-MM-dd HH").alias("hour"), "n", "failed")


@query(
    "m6_week_over_week",
    f"""WITH {JOBS_SQL}, a AS (SELECT stage, duration_ms, date_diff('day', created_at::DATE, DATE '2024-01-30') AS age FROM jobs WHERE status = 'completed'),
g AS (SELECT stage, count(*) FILTER (WHERE age < 7) AS n_now, count(*) FILTER (WHERE age >= 7) AS n_before, quantile_cont(duration_ms, 0.95) FILTER (WHERE age < 7) AS a, quantile_cont(duration_ms, 0.95) FILTER (WHERE age >= 7) AS b FROM a WHERE age >= 0 AND age < 14 GROUP BY stage)
SELECT stage, n_now::BIGINT AS n_now, n_before::BIGINT AS n_before, round(a, 3) AS now_p95, round(b, 3) AS before_p95, CASE WHEN n_now < 5 OR n_before < 5 THEN 'few' WHEN (a - b) / b > 0.3 THEN 'slower' WHEN (a - b) / b < -0.3 THEN 'faster' ELSE 'steady' END AS label FROM g""",
)
def m6(spark, d):
    return ops.timing_deltas(jobs(spark, d), NOW)


@query("m7_slow_documents", f"WITH {JOBS_SQL} SELECT document_id, sum(duration_ms)::BIGINT AS total_ms, max_by(stage, duration_ms * 1000000 + job_id) AS slowest_stage FROM jobs GROUP BY document_id ORDER BY total_ms DESC, document_id LIMIT 15")
def m7(spark, d):
    g = jobs(spark, d).groupBy("document_id").agg(F.sum("duration_ms").alias("total_ms"), F.max_by("stage", F.col("duration_ms") * 1000000 + F.col("job_id")).alias("slowest_stage"))
    return g.orderBy(F.desc("total_ms"), "document_id").limit(15)


@query(
    "m8_failure_classes",
    f"WITH {JOBS_SQL} SELECT stage, substr(trim(regexp_replace('error  code ' || k, '\\s+', ' ', 'g')), 1, 60) AS signature, count(*)::BIGINT AS n, strftime(min(created_at), '%Y-%m-%d %H:%M') AS first_seen, strftime(max(created_at), '%Y-%m-%d %H:%M') AS last_seen FROM jobs WHERE status = 'failed' GROUP BY ALL",
)
def m8(spark, d):
    g = ops.failure_classes(jobs(spark, d), F.concat(F.lit("error  code "), F.col("k").cast("string")))
    return g.select("stage", "signature", "n", F.date_format("first_seen", "yyyy-MM-dd HH:mm").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd HH:mm").alias("last_seen"))


@query(
    "m9_rates_and_eta",
    f"WITH {JOBS_SQL}, g AS (SELECT count(*) FILTER (WHERE status = 'failed') AS waiting, count(*) FILTER (WHERE status = 'completed' AND created_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '{NOW}') AS done FROM jobs) SELECT waiting::BIGINT AS waiting, round(done / 24.0, 4) AS per_hour, CASE WHEN done = 0 THEN NULL ELSE round(waiting / (done / 24.0), 4) END AS eta_hours FROM g",
)
def m9(spark, d):
    j = jobs(spark, d)
    end = F.lit(NOW).cast("timestamp")
    done = F.count_if((F.col("status") == "completed") & (F.col("created_at") > end - F.expr("INTERVAL 24 HOURS")) & (F.col("created_at") <= end))
    g = j.agg(F.count_if(F.col("status") == "failed").alias("waiting"), (done / 24.0).alias("rate"))
    return g.select("waiting", F.round("rate", 4).alias("per_hour"), F.round(F.try_divide("waiting", "rate"), 4).alias("eta_hours"))


@query(
    "m10_enrichment_progress",
    f"WITH {PAPERS_SQL} SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE title <> '')::BIGINT AS with_title, count(*) FILTER (WHERE length(abstract) >= 100)::BIGINT AS with_abstract, count(*) FILTER (WHERE lang IS NOT NULL)::BIGINT AS with_lang, round(100.0 * count(*) FILTER (WHERE length(abstract) >= 100) / count(*), 3) AS abstract_pct FROM papers",
)
def m10(spark, d):
    long = F.length("abstract") >= 100
    return papers(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("title") != "").alias("with_title"), F.count_if(long).alias("with_abstract"), F.count("lang").alias("with_lang"), F.round(100.0 * F.count_if(long) / F.count("*"), 3).alias("abstract_pct"))


@query(
    "m11_section_coverage",
    "WITH s AS (SELECT DISTINCT doc_id % 100 AS doc, source, lang FROM documents), n AS (SELECT lang, count(DISTINCT doc) AS docs FROM s GROUP BY lang), t AS (SELECT count(DISTINCT doc) AS total FROM s) SELECT lang, docs::BIGINT AS docs, round(100.0 * docs / total, 4) AS pct FROM n, t",
)
def m11(spark, d):
    s = table(spark, d, "documents").select((F.col("doc_id") % 100).alias("doc"), "lang")
    n, t = s.groupBy("lang").agg(F.countDistinct("doc").alias("docs")), s.agg(F.countDistinct("doc").alias("total"))
    return n.join(F.broadcast(t)).select("lang", "docs", F.round(100.0 * F.col("docs") / F.col("total"), 4).alias("pct"))


@query("m12_usage_by_day", f"WITH {JOBS_SQL} SELECT strftime(created_at, '%Y-%m-%d') AS day, stage AS operation, count(*)::BIGINT AS calls, sum(k)::BIGINT AS tokens FROM jobs GROUP BY ALL")
def m12(spark, d):
    return jobs(spark, d).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), F.col("stage").alias("operation")).agg(F.count("*").alias("calls"), F.sum("k").alias("tokens"))


@query("m13_tokens_per_second", f"WITH {JOBS_SQL} SELECT document_id, sum(k)::BIGINT AS tokens, round(sum(k) / nullif(sum(duration_ms) / 1000.0, 0), 5) AS per_second FROM jobs GROUP BY document_id")
def m13(spark, d):
    return jobs(spark, d).groupBy("document_id").agg(F.sum("k").alias("tokens"), F.round(F.try_divide(F.sum("k"), F.sum("duration_ms") / 1000.0), 5).alias("per_second"))


@query("m14_span_stats", f"WITH {JOBS_SQL} SELECT stage AS name, count(*)::BIGINT AS n, round(quantile_cont(duration_ms, 0.5), 3) AS p50, round(quantile_cont(duration_ms, 0.95), 3) AS p95, max(duration_ms) AS max_ms, count(*) FILTER (WHERE status = 'failed')::BIGINT AS errors FROM jobs GROUP BY stage")
def m14(spark, d):
    p = lambda s: F.round(F.percentile("duration_ms", F.lit(s)), 3)
    return jobs(spark, d).groupBy(F.col("stage").alias("name")).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("duration_ms").alias("max_ms"), F.count_if(F.col("status") == "failed").alias("errors"))


@query(
    "m15_search_latency",
    f"WITH {JOBS_SQL}, r AS (SELECT stage, duration_ms, row_number() OVER (PARTITION BY stage ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY stage) AS n FROM jobs) SELECT stage, any_value(n)::BIGINT AS n, max(duration_ms) FILTER (WHERE i = floor(n * 0.5)) AS p50, max(duration_ms) FILTER (WHERE i = floor(n * 0.95)) AS p95 FROM r GROUP BY stage",
)
def m15(spark, d):
    return rel.index_percentile(jobs(spark, d), ["stage"], "duration_ms", {"p50": 0.5, "p95": 0.95})


@query(
    "m16_chapter_velocity",
    "WITH v AS (SELECT user_id % 12 AS chapter, user_id AS section, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT chapter, count(*)::BIGINT AS sections, round(sum(value), 4) AS words, strftime(max(ts), '%Y-%m-%d') AS last_edit FROM v GROUP BY chapter",
)
def m16(spark, d):
    v = rel.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return v.groupBy((F.col("user_id") % 12).alias("chapter")).agg(F.count("*").alias("sections"), F.round(F.sum("value"), 4).alias("words"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_edit"))


@query("m17_year_histogram", f"WITH {PAPERS_SQL} SELECT year, count(*)::BIGINT AS n FROM papers WHERE year >= 1995 GROUP BY year")
def m17(spark, d):
    return papers(spark, d).where("year >= 1995").groupBy("year").agg(F.count("*").alias("n"))


@query(
    "m18_quality_signals",
    "SELECT round(100.0 * count(*) FILTER (WHERE length(text) >= 100) / count(*), 4) AS abstract_pct, round(quantile_cont(n_chars, 0.5), 3) AS p50, round(quantile_cont(n_chars, 0.95), 3) AS p95 FROM documents",
)
def m18(spark, d):
    return table(spark, d, "documents").agg(F.round(100.0 * F.count_if(F.length("text") >= 100) / F.count("*"), 4).alias("abstract_pct"), F.round(F.percentile("n_chars", F.lit(0.5)), 3).alias("p50"), F.round(F.percentile("n_chars", F.lit(0.95)), 3).alias("p95"))


@query("m19_retraction_detail", "SELECT source, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source")
def m19(spark, d):
    bad = table(spark, d, "labels").where("toxic = 1")
    return table(spark, d, "documents").join(bad, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


_SNAPSHOT = f"WITH {JOBS_SQL}, s AS (SELECT 100.0 * count(*) FILTER (WHERE status = 'failed') / count(*) AS failed_pct, count(DISTINCT document_id) AS docs, quantile_cont(duration_ms, 0.95) AS p95 FROM jobs), a AS (SELECT 'failures' AS alert, 'warn' AS severity, 15 AS penalty FROM s WHERE failed_pct > 5 UNION ALL SELECT 'many_failures', 'error', 30 FROM s WHERE failed_pct > 20 UNION ALL SELECT 'few_documents', 'warn', 10 FROM s WHERE docs < 1000 UNION ALL SELECT 'slow', 'info', 5 FROM s WHERE p95 > 1000)"


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    s = jobs(spark, d).agg((100.0 * F.count_if(F.col("status") == "failed") / F.count("*")).alias("failed_pct"), F.countDistinct("document_id").alias("docs"), F.percentile("duration_ms", F.lit(0.95)).alias("p95"))
    rules = [("failures", "warn", F.col("failed_pct") > 5, 15), ("many_failures", "error", F.col("failed_pct") > 20, 30), ("few_documents", "warn", F.col("docs") < 1000, 10), ("slow", "info", F.col("p95") > 1000, 5)]
    return ops.alerts(s, rules)


@query("m20_alerts", _SNAPSHOT + " SELECT alert, severity, penalty FROM a")
def m20(spark, d):
    return _alerts(spark, d)


@query("m20_health_score", _SNAPSHOT + " SELECT greatest(0, 100 - coalesce(sum(penalty), 0))::BIGINT AS score FROM a")
def m20_score(spark, d):
    return ops.health_score(_alerts(spark, d))


@query(
    "m21_drift_audit",
    "SELECT label AS shard, count(*)::BIGINT AS points, count(*) FILTER (WHERE vec_id NOT IN (SELECT doc_id FROM documents))::BIGINT AS without_document FROM embeddings GROUP BY label",
)
def m21(spark, d):
    e, known = table(spark, d, "embeddings"), table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("known")).distinct()
    return e.join(known, "vec_id", "left").groupBy(F.col("label").alias("shard")).agg(F.count("*").alias("points"), F.count_if(F.col("known").isNull()).alias("without_document"))


@query("m22_feedback_pivot", "SELECT role AS op, count(*) FILTER (WHERE conv_id % 3 = 0)::BIGINT AS down, count(*) FILTER (WHERE conv_id % 3 = 1)::BIGINT AS neutral, count(*) FILTER (WHERE conv_id % 3 = 2)::BIGINT AS up FROM conversations GROUP BY role")
def m22(spark, d):
    c = table(spark, d, "conversations").select(F.col("role").alias("op"), (F.col("conv_id") % 3).alias("s"))
    p = c.groupBy("op").pivot("s", [0, 1, 2]).count()
    return p.select("op", *[F.coalesce(F.col(a), F.lit(0)).alias(b) for a, b in (("0", "down"), ("1", "neutral"), ("2", "up"))])


@query("m23_state_log", f"WITH {JOBS_SQL} SELECT document_id, max_by(stage, job_id) AS state, max_by(status, job_id) AS status, count(*)::BIGINT AS steps FROM jobs GROUP BY document_id")
def m23(spark, d):
    return jobs(spark, d).groupBy("document_id").agg(F.max_by("stage", "job_id").alias("state"), F.max_by("status", "job_id").alias("status"), F.count("*").alias("steps"))


@query(
    "m_stuck_jobs",
    f"WITH {JOBS_SQL}, n AS (SELECT document_id, max(created_at) AS seen, max_by(status, (epoch_us(created_at), job_id)) AS status FROM jobs GROUP BY document_id) SELECT document_id FROM n WHERE status <> 'completed' AND epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(seen))::BIGINT > 300",
)
def m_stuck(spark, d):
    return ops.stuck(jobs(spark, d), NOW)


@query(
    "f31_date_parts",
    "SELECT event_id, strftime(date_trunc('week', ts::TIMESTAMP), '%Y-%m-%d') AS week, strftime(ts, '%Y-%m') AS month, floor(epoch(ts))::BIGINT AS seconds FROM events",
)
def f31(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), F.date_format("ts", "yyyy-MM").alias("month"), F.unix_timestamp("ts").alias("seconds"))


@query(
    "w8_week_delta",
    f"""WITH {JOBS_SQL}, a AS (SELECT stage, duration_ms, date_diff('day', created_at::DATE, DATE '2024-01-30') AS age FROM jobs WHERE status = 'completed'),
g AS (SELECT stage, count(*) FILTER (WHERE age < 7) AS n_now, count(*) FILTER (WHERE age >= 7) AS n_before, quantile_cont(duration_ms, 0.95) FILTER (WHERE age < 7) AS a, quantile_cont(duration_ms, 0.95) FILTER (WHERE age >= 7) AS b FROM a WHERE age >= 0 AND age < 14 GROUP BY stage)
SELECT stage, CASE WHEN n_now >= 300 AND n_before >= 300 THEN round(a - b, 3) END AS delta, CASE WHEN n_now < 300 OR n_before < 300 THEN 'few' WHEN (a - b) / b > 0.3 THEN 'slower' WHEN (a - b) / b < -0.3 THEN 'faster' ELSE 'steady' END AS label FROM g""",
)
def w8_delta(spark, d):
    """The window's delta behind a gate of 300 samples on either side."""
    g = ops.timing_deltas(jobs(spark, d), NOW, min_samples=300)
    return g.select("stage", F.when(F.col("label") != "few", F.round(F.col("now_p95") - F.col("before_p95"), 3)).alias("delta"), "label")


@query(
    "w8_running_totals",
    f"WITH {JOBS_SQL}, g AS (SELECT stage, created_at::DATE AS day, count(*) AS n FROM jobs GROUP BY ALL) SELECT stage, day::VARCHAR AS day, sum(n) OVER (PARTITION BY stage ORDER BY day)::BIGINT AS total FROM g",
)
def w8(spark, d):
    g = jobs(spark, d).groupBy("stage", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return g.select("stage", F.col("day").cast("string").alias("day"), F.sum("n").over(Window.partitionBy("stage").orderBy("day")).alias("total"))
