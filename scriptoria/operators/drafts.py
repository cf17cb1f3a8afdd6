"""Drafts, versions, visuals and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of visual kinds.
KIND_WEIGHTS = {"figure": 1.0, "chart": 1.0, "table": 0.8, "equation": 0.5, "code": 0.4}


def visual_importance(year: Column, caption_chars: Column, has_number: Column, kind: Column, ai_caption: Column) -> Column:
    """.30 recency + .25 caption length + .20 number + .15 kind + .10 own caption."""
    weight = F.lit(0.3)
    for k, v in KIND_WEIGHTS.items():
        weight = F.when(kind == k, v).otherwise(weight)
    recency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(year, F.lit(2000)) - 2000) / 26.0))
    return 0.30 * recency + 0.25 * F.least(F.lit(1.0), caption_chars / 400.0) + 0.20 * has_number.cast("int") + 0.15 * weight + 0.10 * ai_caption.cast("int")


def section_status(score: Column, words: Column, target: float = 0.75, thin: int = 200) -> Column:
    return F.when(words.isNull(), "pending").when(words < thin, "thin").when(score >= target, "converged").otherwise("in-progress")


def outline_score(sections: DataFrame) -> DataFrame:
    """(outline, score) from (outline, chapter, title): .3 chapters + .3 sections + .2
    unique titles + 2 * population deviation of sections per chapter."""
    per = sections.groupBy("outline", "chapter").agg(F.count("*").alias("n"))
    shape = per.groupBy("outline").agg(F.count("*").alias("chapters"), F.sum("n").alias("sections"), F.stddev_pop("n").alias("sd"))
    titles = sections.groupBy("outline").agg(F.countDistinct(F.lower("title")).alias("titles"))
    return shape.join(titles, "outline").select("outline", (0.3 * F.col("chapters") + 0.3 * F.col("sections") + 0.2 * F.col("titles") + 2 * F.col("sd")).alias("score"))


def bibliography_audit(markers: DataFrame, sources: DataFrame) -> DataFrame:
    """Per draft: markers without a source, sources without a marker, and keys given
    twice, from markers (draft, number) and sources (draft, number, key)."""
    m, s = markers.distinct(), sources
    broken = m.join(s, ["draft", "number"], "left_anti").groupBy("draft").agg(F.count("*").alias("broken"))
    orphan = s.join(m, ["draft", "number"], "left_anti").groupBy("draft").agg(F.count("*").alias("orphans"))
    twice = s.groupBy("draft", "key").agg(F.count("*").alias("c")).where("c > 1").groupBy("draft").agg(F.count("*").alias("duplicates"))
    drafts = m.select("draft").union(s.select("draft")).distinct()
    return drafts.join(broken, "draft", "left").join(orphan, "draft", "left").join(twice, "draft", "left").na.fill(0)


def timeline(*parts: DataFrame, at: str = "at") -> DataFrame:
    """Rows (kind, key, at) of several version tables in one order with a running number per key."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(at, "kind")))


def feedback_by_key(rows: DataFrame) -> DataFrame:
    """The last vote per work, keyed by DOI, else arXiv id, else title; rows (doi,
    arxiv_id, title, vote, at)."""
    filled = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    key = F.coalesce(F.concat(F.lit("doi:"), filled("doi")), F.concat(F.lit("arxiv:"), filled("arxiv_id")), F.concat(F.lit("title:"), filled("title")))
    return rows.withColumn("key", key).where("key IS NOT NULL").groupBy("key").agg(F.max_by("vote", "at").alias("vote"))
