"""Operational analytics over job rows (document_id, stage, status, duration_ms, created_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage_timing(jobs: DataFrame) -> DataFrame:
    p = lambda s: F.round(F.percentile("duration_ms", F.lit(s)), 3)
    return jobs.where("status = 'completed'").groupBy("stage").agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"))


def failure_rate(jobs: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    return jobs.groupBy("stage").agg(F.count("*").alias("n"), failed.alias("failed"), F.round(100.0 * failed / F.count("*"), 4).alias("failed_pct"))


def throughput(jobs: DataFrame, step: str) -> DataFrame:
    return jobs.groupBy(F.date_trunc(step, "created_at").alias("bucket")).agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("jobs"))


def recent_counts(jobs: DataFrame, now: str, hours: dict[str, int]) -> DataFrame:
    end = F.lit(now).cast("timestamp")
    return jobs.agg(*[F.count_if((F.col("created_at") > end - F.make_interval(hours=F.lit(h))) & (F.col("created_at") <= end)).alias(k) for k, h in hours.items()])


def timing_deltas(jobs: DataFrame, now: str, min_samples: int = 5) -> DataFrame:
    """p95 of the last seven days against the seven before, labelled at 30 %."""
    end = F.lit(now).cast("timestamp")
    age = F.datediff(end, F.col("created_at"))
    this, last = age < 7, (age >= 7) & (age < 14)
    value = lambda c: F.when(c, F.col("duration_ms"))
    g = jobs.where((F.col("status") == "completed") & (age >= 0) & (age < 14)).groupBy("stage")
    g = g.agg(F.count(value(this)).alias("n_now"), F.count(value(last)).alias("n_before"), F.percentile(value(this), F.lit(0.95)).alias("now_p95"), F.percentile(value(last), F.lit(0.95)).alias("before_p95"))
    change = F.try_divide(F.col("now_p95") - F.col("before_p95"), F.col("before_p95"))
    label = F.when((F.col("n_now") < min_samples) | (F.col("n_before") < min_samples), "few").when(change > 0.3, "slower").when(change < -0.3, "faster").otherwise("steady")
    return g.select("stage", "n_now", "n_before", F.round("now_p95", 3).alias("now_p95"), F.round("before_p95", 3).alias("before_p95"), label.alias("label"))


def error_signature(text: Column, size: int) -> Column:
    """White space collapsed, first `size` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, size)


def failure_classes(jobs: DataFrame, message: Column, size: int = 60) -> DataFrame:
    failed = jobs.where("status = 'failed'").withColumn("signature", error_signature(message, size))
    return failed.groupBy("stage", "signature").agg(F.count("*").alias("n"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def stuck(jobs: DataFrame, now: str, seconds: int = 300) -> DataFrame:
    """Documents whose newest job isn't completed and is older than `seconds`."""
    newest = jobs.groupBy("document_id").agg(F.max("created_at").alias("at"), F.max_by("status", F.struct("created_at", "job_id")).alias("status"))
    return newest.where((F.col("status") != "completed") & (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("at") > seconds)).select("document_id")


def alerts(snapshot: DataFrame, rules: list[tuple[str, str, Column, int]]) -> DataFrame:
    """One row per rule that holds: name, severity, penalty. snapshot has one row."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("alert"), F.lit(s).alias("severity"), F.lit(p).alias("penalty"))) for n, s, c, p in rules]))
    return snapshot.select(F.explode(found).alias("a")).select("a.*")


def health_score(alert_rows: DataFrame) -> DataFrame:
    """100 less the penalties, at least 0."""
    return alert_rows.agg(F.greatest(F.lit(0), 100 - F.coalesce(F.sum("penalty"), F.lit(0))).alias("score"))
