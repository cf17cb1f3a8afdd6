"""Queries on wiki pages, ingest runs, point collections, layout trees and figure markers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.operators import ingest
from scriptoria.operators import wiki as ops
from scriptoria.plans.registry import query
from scriptoria.plans.views import CITATIONS_SQL, citations
from scriptoria.session import table
from scriptoria.sources import readers, sinks


@query(
    "k1_ingest_run",
    "SELECT doc_id, 'documents' AS part, 1::BIGINT AS n FROM documents UNION ALL SELECT doc_id, 'metadata', 1 FROM documents UNION ALL SELECT doc_id, 'sections', 2 + (trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '')::INT FROM documents UNION ALL SELECT doc_id, 'chunks', 2 FROM documents",
)
def k1(spark, d):
    """Rows of each table by document; a reference list is a section, but is not chunked."""
    md = F.concat("source", F.lit("\n# Methods\n"), "lang", F.lit("\n\n## References\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^#", " #"), F.lit("\n"))
    tables = ingest.run_tables(table(spark, d, "documents").select("doc_id", md.alias("text")), "doc_id", "text")
    parts = [t.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(name).alias("part"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _pages(spark, d):
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("slug"), F.lit("old").alias("title"), F.lit("concept").alias("kind"), F.array(F.lit("a")).alias("sources"), F.lit(7).alias("words"), F.lit(True).alias("needs_rewrite"))
    content = F.concat(F.lit(" one\ttwo\n"), "c_mktsegment", F.lit(" "))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("slug"), F.col("c_mktsegment").alias("title"), F.lit("paper").alias("kind"), content.alias("content"), F.when(F.col("c_custkey") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("c_nationkey").cast("string"))).alias("sources"))
    return old, new


@query(
    "k4_save_pages",
    """SELECT c_name AS slug, CASE WHEN n THEN c_mktsegment ELSE 'old' END AS title, CASE WHEN o THEN 'concept' ELSE 'paper' END AS kind, CASE WHEN NOT n THEN 'a' WHEN c_custkey % 9 > 0 THEN c_nationkey::VARCHAR END AS source, CASE WHEN n THEN 3 ELSE 7 END AS words, NOT n AS needs_rewrite
FROM (SELECT *, c_custkey % 2 = 0 AS o, c_custkey % 3 = 0 AS n FROM customer) WHERE o OR n""",
)
def k4(spark, d):
    p = ops.save_pages(*_pages(spark, d))
    return p.select("slug", "title", "kind", F.array_join("sources", ";").alias("source"), "words", "needs_rewrite")


@query(
    "k4_annotations",
    "SELECT c_name AS slug, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'old' END AS body FROM customer WHERE CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 9 > 0 ELSE c_custkey % 2 = 0 END",
)
def k4_annotations(spark, d):
    c = table(spark, d, "customer")
    at = F.lit("2024-01-01").cast("timestamp")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("slug"), F.lit("old").alias("body"), at.alias("updated_at"))
    body = F.when(F.col("c_custkey") % 9 > 0, F.concat(F.lit(" \n"), "c_mktsegment", F.lit("\t"))).when(F.col("c_custkey") % 2 == 0, F.lit(" "))
    return ops.annotate(old, c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("slug"), body.alias("body"), at.alias("updated_at"))).select("slug", "body")


@query(
    "k8_upsert_points",
    "SELECT md5(o_custkey || ':' || o_orderkey) AS point_id, o_orderkey AS chunk_index, substr(o_orderpriority, 1, 3) AS content_preview, CASE WHEN o_orderkey % 4 = 0 THEN 'second' ELSE 'first' END AS embedding_model FROM orders",
)
def k8(spark, d):
    chunks = table(spark, d, "orders").select(
        F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("place"), F.lit("methods").alias("section"), F.lit("Methods").alias("title"), F.col("o_orderpriority").alias("content"),
        F.array(F.col("o_totalprice").cast("float")).alias("dense"), F.create_map(F.lit("1"), F.lit(0.5)).alias("sparse"),
    )
    merged = ops.upsert_points(ops.points(chunks, "first", 3), ops.points(chunks.where("place % 4 = 0"), "second", 3))
    return merged.select("point_id", "payload.chunk_index", "payload.content_preview", "payload.embedding_model")


@query(
    "k13_pending_rows",
    "SELECT 'D' || p_partkey AS doi, p_name AS title, p_brand || '; ' || p_type AS authors, p_size AS year, NULL::VARCHAR AS source_method, NULL::VARCHAR AS source_query, p_retailprice AS relevance_score, NULL::VARCHAR AS attempt_count, NULL::VARCHAR AS last_attempt_at, NULL::VARCHAR AS last_failure_reason, 'pending' AS status, NULL::VARCHAR AS notes, NULL::VARCHAR AS created_at FROM part WHERE p_partkey % 3 > 0",
)
def k13(spark, d):
    p = table(spark, d, "part")
    status = F.when(F.col("p_partkey") % 3 > 0, "pending").otherwise("done")
    return sinks.pending_rows(p.select(F.concat(F.lit("D"), F.col("p_partkey").cast("string")).alias("doi"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("authors"), F.col("p_size").alias("year"), F.col("p_retailprice").alias("relevance_score"), status.alias("status"), F.lit("x").alias("other")))


@query(
    "k15_bench_lines",
    """SELECT 0 AS place, '{"_kind":"header","timestamp":"t1","tag":"nightly","n_benchmarks":' || count(*) || '}' AS line FROM nation
UNION ALL SELECT row_number() OVER (ORDER BY n_name)::INT, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' FROM nation""",
)
def k15(spark, d):
    return sinks.bench_lines(table(spark, d, "nation").select("n_name", "n_regionkey"), "t1", "nightly", "n_name")


@query(
    "s4_layout_tree",
    """SELECT doc_id, concat_ws(chr(10) || chr(10), '## ' || source || ' & more', nullif(trim(regexp_replace(regexp_replace(replace(coalesce(text, ''), '&', '+'), '<[^>]*>?', ' ', 'g'), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g')), ''), 'a | ' || lang || chr(10) || '1 | <2>', 'x = ' || doc_id) AS text FROM documents""",
)
def s4(spark, d):
    """A page with a heading, the text two groups deep, a table, a figure that goes with its
    caption, and an equation inside a block of unknown type."""
    j = lambda c: F.to_json(F.struct(c.alias("h")))
    quoted = lambda c: F.regexp_extract(j(c), r'(?s)^\{"h":(.*)\}$', 1)
    block = lambda kind, html: F.concat(F.lit('{"block_type":"' + kind + '","html":'), quoted(html), F.lit("}"))
    group = lambda kind, *c: F.concat(F.lit('{"block_type":"' + kind + '","children":['), F.concat_ws(",", *c), F.lit("]}"))
    plain = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("+")), "<[^>]*>?", " ")
    page = group(
        "Page",
        block("PageHeader", F.lit("header")), block("SectionHeader", F.concat(F.lit("<h2>"), "source", F.lit(" &amp;&nbsp;more</h2>"))),
        group("ListGroup", group("Deeper", block("ListItem", F.concat(F.lit("<li>"), plain, F.lit("</li>"))))),
        block("Table", F.concat(F.lit("<table><tr><th>a</th><td>"), "lang", F.lit("</td></tr>\n<tr><td></td></tr><TR class='x'><td>1</td><td>&lt;2&gt;</td></TR></table>"))),
        group("Figure", block("Caption", F.lit("gone"))), block("Text", F.lit(" <p> </p>")), group("Unknown", block("Equation", F.concat(F.lit("x = "), F.col("doc_id").cast("string")))),
    )
    tree = F.concat(F.lit('{"children":['), page, F.lit("]}"))
    return table(spark, d, "documents").select("doc_id", readers.tree_text(tree).alias("text"))


@query(
    "s16_page_links",
    """WITH e AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 100 AS b, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS alt FROM orders)
SELECT 'c' || b AS target, 'c' || a AS from_slug, CASE WHEN a % 2 = 0 THEN 'Title ' || a ELSE 'c' || a END AS from_title, alt FROM e WHERE a <> b""",
)
def s16(spark, d):
    """Customers as pages that link to pages by their orders, with and without words."""
    link = F.concat(F.lit("[[c"), (F.col("o_orderkey") % 100).cast("string"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("|"), "o_orderpriority")).otherwise(""), F.lit("]]"))
    k = F.col("o_custkey").cast("string")
    p = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(link), "\nand ").alias("text"))
    return ops.page_links(p.select(F.concat(F.lit("c"), k).alias("slug"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Title "), k)).alias("title"), "text"))


def _drafts(spark, d):
    """An order's lines as sentences with markers of parts, and every third part as a visual."""
    sentence = F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(" shows [Fig. "), (F.col("l_partkey") % 9).cast("string"), F.lit("] and more. "))
    line = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", sentence.alias("s")).alias("s"))
    t = line.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["s"]), "").alias("text"))
    o = table(spark, d, "orders").select("o_orderkey")
    drafts = o.join(t, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("draft"), "text")
    visuals = o.select(F.col("o_orderkey").alias("draft"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("n")).where("n % 3 <> draft % 3 OR draft % 2 = 0")
    return drafts, visuals.select("draft", F.when(F.col("n") == 4, "table").otherwise("chart").alias("kind"), F.concat(F.lit("Figure "), F.col("n").cast("string"), F.lit(".1")).alias("figure"), F.when(F.col("draft") % 5 == 0, 0.2).when(F.col("n") <= 1, 0.9).otherwise(0.5).alias("score"))


@query(
    "x10_figure_report",
    """WITH v AS (SELECT o_orderkey AS draft, n, CASE WHEN o_orderkey % 5 = 0 THEN 0.2 WHEN n <= 1 THEN 0.9 ELSE 0.5 END AS score FROM orders, range(9) r(n) WHERE n % 3 <> o_orderkey % 3 OR o_orderkey % 2 = 0),
m AS (SELECT l_orderkey AS draft, l_linenumber AS i, l_partkey AS p, (l_partkey % 9) AS n FROM lineitem),
h AS (SELECT draft, count(*) AS n, count(*) FILTER (WHERE bad) AS bad, string_agg('[Fig. ' || num || ']', ';' ORDER BY i, p) FILTER (WHERE bad) AS missing FROM (SELECT m.draft, m.i, m.p, m.n AS num, v.n IS NULL AS bad FROM m LEFT JOIN v ON v.draft = m.draft AND v.n = m.n AND v.n <> 4) GROUP BY draft),
b AS (SELECT draft, count(*) AS good FROM v WHERE score >= 0.8 GROUP BY draft)
SELECT o_orderkey AS draft, coalesce(h.n, 0)::BIGINT AS n_markers, coalesce(bad, 0)::BIGINT AS n_hallucinated, coalesce(missing, '') AS missing, CASE WHEN h.n IS NULL THEN 1.0 ELSE round((h.n - bad) / h.n, 3) END::DOUBLE AS resolved_ratio,
 CASE WHEN bad > 0 THEN 0 WHEN good IS NULL THEN 1 WHEN h.n IS NULL THEN 0.5 WHEN h.n > good * 1.5 AND h.n >= 3 THEN 0.7 ELSE 1 END::DOUBLE AS score
FROM orders LEFT JOIN h ON h.draft = o_orderkey LEFT JOIN b ON b.draft = o_orderkey""",
)
def x10(spark, d):
    r = ops.figure_report(*_drafts(spark, d))
    return r.select("draft", "n_markers", "n_hallucinated", F.array_join("hallucinated_markers", ";").alias("missing"), "resolved_ratio", F.col("score").cast("double").alias("score"))


@query(
    "g13_gap_candidates",
    """WITH f AS (SELECT DISTINCT l_suppkey AS gap, l_partkey AS p FROM lineitem WHERE l_linenumber <= 2), k AS (SELECT f.* FROM f WHERE p % 7 > 0)
SELECT 'D' || p AS doi, 'T' || min(gap) AS title, count(*)::INT AS n_gaps, string_agg(gap::VARCHAR, ',' ORDER BY gap) AS gaps FROM k GROUP BY p""",
)
def g13(spark, d):
    """Parts as works found for the open gaps of suppliers; the corpus has every seventh."""
    doi = lambda c, letter: F.concat(F.lit(letter), F.col(c).cast("string"))
    f = table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_suppkey").alias("gap_id"), F.col("l_suppkey").alias("place"), doi("l_partkey", "D").alias("doi"), doi("l_suppkey", "T").alias("title"), F.lit(2000).alias("year"), F.lit(0.5).alias("relevance"))
    corpus = table(spark, d, "part").where("p_partkey % 7 = 0").select(doi("p_partkey", "d").alias("doi"))
    return ops.gap_candidates(f, corpus).select("doi", "title", "n_gaps", F.array_join(F.transform("gap_ids", lambda g: g.cast("string")), ",").alias("gaps"))


@query("g13_inbound_candidates", f"WITH {CITATIONS_SQL} SELECT citing AS id, count(DISTINCT cited)::BIGINT AS n_seeds FROM citations WHERE cited % 5 = 0 AND cited IN (SELECT p_partkey FROM part) AND NOT (citing % 5 = 0 AND citing IN (SELECT p_partkey FROM part)) GROUP BY citing")
def g13_inbound(spark, d):
    return ops.inbound_candidates(citations(spark, d), table(spark, d, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("id")))
