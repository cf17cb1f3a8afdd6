"""Sinks: exports of catalogs, preference pairs, shortlists and bibliographies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The shortlist's columns in their order.
SHORTLIST_COLUMNS = [
    "rank",
    "decision",
    "drop_reason",
    "rrf_score",
    "doi",
    "arxiv_id",
    "title",
    "year",
    "venue",
    "doc_type",
    "co_citation",
    "bib_coupling",
    "pagerank",
    "influential_cites",
    "cited_by",
    "velocity",
    "bge_m3_cosine",
    "citation_context_cosine",
    "citation_context_n",
    "concept_overlap",
    "author_overlap",
    "venue_weight",
    "corpus_cites",
    "external_cites",
    "openalex_id",
]

# The columns of the list of pending downloads in their order.
PENDING_COLUMNS = [
    "doi",
    "title",
    "authors",
    "year",
    "source_method",
    "source_query",
    "relevance_score",
    "attempt_count",
    "last_attempt_at",
    "last_failure_reason",
    "status",
    "notes",
    "created_at",
]


def pending_rows(pending: DataFrame, status: str | None = "pending") -> DataFrame:
    """The pending list's columns in order, of one status (None: all); authors joined by
    semicolons, missing columns null."""
    kinds = dict(pending.dtypes)

    def column(c: str) -> Column:
        if c not in kinds:
            return F.lit(None).cast("string").alias(c)
        return F.array_join(c, "; ").alias(c) if kinds[c].startswith("array<string") else F.col(c)

    chosen = pending if status is None else pending.where(F.col("status") == status)
    return chosen.select(*[column(c) for c in PENDING_COLUMNS])


def write_pending(pending: DataFrame, path: str, kind: str = "csv", status: str | None = "pending") -> None:
    """The pending list as CSV with a header, or as JSON lines."""
    if kind == "csv":
        pending_rows(pending, status).write.mode("overwrite").csv(path, header=True)
    else:
        (pending if status is None else pending.where(F.col("status") == status)).write.mode("overwrite").json(path)


def bench_lines(results: DataFrame, at: str, tag: str, order: str) -> DataFrame:
    """(place, line): a run's results as JSON lines after a header with their number."""
    rows = results.withColumn("_n", F.row_number().over(Window.orderBy(order)))
    head = results.agg(F.count("*").alias("n_benchmarks")).select(F.lit(0).alias("place"), F.to_json(F.struct(F.lit("header").alias("_kind"), F.lit(at).alias("timestamp"), F.lit(tag).alias("tag"), "n_benchmarks")).alias("line"))
    return head.unionByName(rows.select(F.col("_n").alias("place"), F.to_json(F.struct(*results.columns)).alias("line")))


def write_bench(results: DataFrame, folder: str, at: str, tag: str, order: str) -> str:
    """A run's lines below folder/<at>, and folder/latest that names them; returns the run's
    place. One run's results are a report of bounded size, in one file."""
    spark, place = results.sparkSession, f"{folder}/{at}"
    lines = bench_lines(results, at, tag, order)
    lines.coalesce(1).sortWithinPartitions("place").select("line").write.mode("overwrite").text(place)
    spark.createDataFrame([(at, tag, place)], "timestamp string, tag string, file string").coalesce(1).write.mode("overwrite").json(f"{folder}/latest")
    return place


def write_run(tables: dict[str, DataFrame], folder: str, run: str) -> None:
    """All tables of one ingest run below folder/<table>/run=<run>. Every table is replaced
    whole for that run, so a run that failed half-way can be done again; readers see a run
    once folder/_runs names it."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/run={run}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").json(f"{folder}/_runs/{run}")


def write_catalog(papers: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header, or JSON lines; arrays become text joined by semicolons in CSV."""
    if kind == "csv":
        flat = [F.array_join(c, "; ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in papers.dtypes]
        papers.select(*flat).write.mode("overwrite").csv(path, header=True)
    else:
        papers.write.mode("overwrite").json(path)


def shortlist_rows(candidates: DataFrame) -> DataFrame:
    """The shortlist's columns in order; missing ones are empty, numbers have four digits."""
    kinds = dict(candidates.dtypes)

    def column(c: str) -> Column:
        if c not in kinds:
            return F.lit("").alias(c)
        text = F.format_string("%.4f", F.col(c).cast("double")) if kinds[c] in ("double", "float") else F.col(c).cast("string")
        return F.coalesce(F.regexp_replace(text, r"[\t\r\n]+", " "), F.lit("")).alias(c)

    return candidates.select(*[column(c) for c in SHORTLIST_COLUMNS])


def write_shortlist(candidates: DataFrame, path: str) -> None:
    shortlist_rows(candidates).write.mode("overwrite").csv(path, sep="\t", header=True)


def preference_pairs(rounds: DataFrame, min_score: float = 0.6, min_delta: float = 0.02) -> DataFrame:
    """(prompt, chosen, rejected, deltas) from rounds (run_id, iteration, prompt, before,
    after, score_before, score_after, verdict): a kept round prefers its result, a
    discarded one its origin; the chosen score and the gap must reach their gates."""
    keep = F.col("verdict") == "KEEP"
    d = rounds.select(
        "run_id",
        "iteration",
        "prompt",
        F.when(keep, F.col("after")).otherwise(F.col("before")).alias("chosen"),
        F.when(keep, F.col("before")).otherwise(F.col("after")).alias("rejected"),
        F.when(keep, F.col("score_after")).otherwise(F.col("score_before")).alias("score_chosen"),
        F.when(keep, F.col("score_before")).otherwise(F.col("score_after")).alias("score_rejected"),
        "verdict",
    ).withColumn("score_delta", F.col("score_chosen") - F.col("score_rejected"))
    return d.where((F.col("score_chosen") >= min_score) & (F.col("score_delta") >= min_delta) & (F.col("chosen") != F.col("rejected")))


def bibtex(key: Column, kind: Column, fields: dict[str, Column]) -> Column:
    """One entry; empty fields are left out and braces are escaped."""
    lines = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {k} = {{"), F.regexp_replace(v.cast("string"), r"([{}])", r"\\$1"), F.lit("}"))) for k, v in fields.items()]
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(F.array_compact(F.array(*lines)), ",\n"), F.lit("\n}"))
