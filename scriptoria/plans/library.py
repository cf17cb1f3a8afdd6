"""Sources, sinks and read models over drafts and visuals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptoria.operators import drafts as ops
from scriptoria.operators import relational as rel
from scriptoria.plans.registry import query
from scriptoria.session import table
from scriptoria.sources import readers, sinks


@query("s3_block_list", "SELECT doc_id, i::BIGINT AS section, CASE i WHEN 1 THEN 'Methods' END AS title, CASE i WHEN 0 THEN source ELSE lang || chr(10) || chr(10) || 'a' || chr(10) || 'b' END AS content FROM documents, (SELECT unnest([0, 1]) AS i)")
def s3(spark, d):
    block = lambda kind, **f: F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in f.items()])
    text = F.lit(None).cast("string")
    level, items = F.lit(None).cast("int"), F.lit(None).cast("array<string>")
    doc = F.to_json(
        F.array(
            block("text", text=F.col("source"), text_level=level, list_items=items),
            block("text", text=F.lit("Methods"), text_level=F.lit(1), list_items=items),
            block("text", text=F.col("lang"), text_level=level, list_items=items),
            block("list", text=text, text_level=level, list_items=F.array(F.lit("a"), F.lit("b"))),
        )
    )
    rows = table(spark, d, "documents").select("doc_id", doc.alias("json"))
    s = readers.block_sections(readers.blocks(rows, "json").drop("json"), "doc_id")
    return s.select("doc_id", F.col("section").cast("long").alias("section"), "title", "content")


@query("s13_log_replay", "SELECT user_id AS key, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def s13(spark, d):
    e = table(spark, d, "events")
    return readers.replay(e, F.col("user_id"), F.col("event_id"), F.when(F.col("event_type") != "error", F.col("value")))


@query("s15_leaderboard", "SELECT s_suppkey, m AS model, v AS score FROM (SELECT s_suppkey, 'a' AS m, (s_suppkey % 10 + 0.5)::DOUBLE AS v FROM supplier UNION ALL SELECT s_suppkey, 'b', 7.25::DOUBLE FROM supplier)")
def s15(spark, d):
    text = F.concat(F.lit("# Board\n| other | x |\n|---|---|\n| z | 1 |\n\ntext\n| Model | size | score |\n|---|---|---|\n| a | 7B | "), (F.col("s_suppkey") % 10).cast("string"), F.lit(".5 |\n| b | x | **7.25** |\n"))
    return readers.leaderboard(table(spark, d, "supplier").select("s_suppkey", text.alias("t")), "t", "s_suppkey")


@query("s18_sample")
def s18(spark, d):
    return readers.sampled(table(spark, d, "documents"), "doc_id", 50, 7).select("doc_id", "source")


@query("k11_preference_pairs", "SELECT l_orderkey AS run_id, l_linenumber AS iteration, CASE WHEN l_returnflag = 'R' THEN 'new' ELSE 'old' END AS chosen, round(CASE WHEN l_returnflag = 'R' THEN l_tax * 10 ELSE l_discount * 10 END, 4) AS score_chosen FROM lineitem WHERE (CASE WHEN l_returnflag = 'R' THEN l_tax * 10 ELSE l_discount * 10 END) >= 0.55 AND (CASE WHEN l_returnflag = 'R' THEN l_tax - l_discount ELSE l_discount - l_tax END) * 10 >= 0.05")
def k11(spark, d):
    line = table(spark, d, "lineitem")
    r = line.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("iteration"), F.lit("p").alias("prompt"), F.lit("old").alias("before"), F.lit("new").alias("after"),
        (F.col("l_discount") * 10).alias("score_before"), (F.col("l_tax") * 10).alias("score_after"), F.when(F.col("l_returnflag") == "R", "KEEP").otherwise("DISCARD").alias("verdict"),
    )
    return sinks.preference_pairs(r, 0.55, 0.05).select("run_id", "iteration", "chosen", F.round("score_chosen", 4).alias("score_chosen"))


@query("k12_shortlist_rows", "SELECT p_partkey::VARCHAR AS rank, p_name AS title, printf('%.4f', p_retailprice) AS rrf_score, '' AS doi FROM part")
def k12(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("rank"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("rrf_score"))
    return sinks.shortlist_rows(p).select("rank", "title", "rrf_score", "doi")


@query("k14_bibtex", "SELECT doc_id, '@article{d' || doc_id || ',' || chr(10) || '  title = {T\\{' || doc_id || '\\}},' || chr(10) || '  journal = {' || source || '}' || chr(10) || '}' AS entry FROM documents")
def k14(spark, d):
    k = F.col("doc_id").cast("string")
    e = sinks.bibtex(F.concat(F.lit("d"), k), F.lit("article"), {"title": F.concat(F.lit("T{"), k, F.lit("}")), "year": F.lit(None), "journal": F.col("source")})
    return table(spark, d, "documents").select("doc_id", e.alias("entry"))


@query(
    "x1_visual_importance",
    "SELECT p_partkey, round(0.30 * greatest(0.0, least(1.0, (1995 + p_size - 2000) / 26.0)) + 0.25 * least(1.0, length(p_name) * 20 / 400.0) + 0.20 * (p_partkey % 2 = 0)::INT + 0.15 * CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.3 END + 0.10 * (p_partkey % 5 = 0)::INT, 6)::DOUBLE AS score FROM part",
)
def x1(spark, d):
    k = F.col("p_partkey")
    s = ops.visual_importance(1995 + F.col("p_size"), F.length("p_name") * 20, k % 2 == 0, F.when(k % 3 == 0, "figure").when(k % 3 == 1, "table").otherwise("photo"), k % 5 == 0)
    return table(spark, d, "part").select("p_partkey", F.round(s, 6).alias("score"))


@query("x2_latest_with_demotion", "SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY (n_chars >= 50) DESC, doc_id % 9 DESC, doc_id DESC) = 1")
def x2(spark, d):
    return rel.latest(table(spark, d, "documents"), ["source", "lang"], [F.desc(F.col("n_chars") >= 50), F.desc(F.col("doc_id") % 9), F.desc("doc_id")]).select("source", "lang", "doc_id")


@query(
    "x3_scoreboard",
    "WITH o AS (SELECT DISTINCT source, l.lang FROM documents, (SELECT DISTINCT lang FROM documents UNION SELECT 'it') l), g AS (SELECT source, lang, max(n_chars) AS words, avg(doc_id % 10) / 10 AS score FROM documents GROUP BY ALL) SELECT o.source, o.lang, CASE WHEN words IS NULL THEN 'pending' WHEN words < 200 THEN 'thin' WHEN score >= 0.45 THEN 'converged' ELSE 'in-progress' END AS status FROM o LEFT JOIN g ON o.source = g.source AND o.lang = g.lang",
)
def x3(spark, d):
    docs = table(spark, d, "documents")
    langs = docs.select("lang").distinct().union(spark.createDataFrame([("it",)], "lang string"))
    outline = docs.select("source").distinct().join(F.broadcast(langs))  # chapters times sections of one book
    g = docs.groupBy("source", "lang").agg(F.max("n_chars").alias("words"), (F.avg(F.col("doc_id") % 10) / 10).alias("score"))
    return outline.join(g, ["source", "lang"], "left").select("source", "lang", ops.section_status(F.col("score"), F.col("words"), 0.45).alias("status"))


@query("x4_dashboard_heatmap", "SELECT source, count(*) FILTER (WHERE lang = 'de')::BIGINT AS de, count(*) FILTER (WHERE lang = 'en')::BIGINT AS en, count(*) FILTER (WHERE lang = 'es')::BIGINT AS es, count(*) FILTER (WHERE lang = 'fr')::BIGINT AS fr FROM documents GROUP BY source")
def x4(spark, d):
    return table(spark, d, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query(
    "x6_outline_tournament",
    "WITH s AS (SELECT o_custkey % 10 AS outline, o_orderpriority AS chapter, o_orderstatus || o_custkey AS title FROM orders), p AS (SELECT outline, chapter, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT outline, count(DISTINCT lower(title)) AS t FROM s GROUP BY outline) SELECT p.outline, round(0.3 * count(*) + 0.3 * sum(n) + 0.2 * any_value(t) + 2 * stddev_pop(n), 4)::DOUBLE AS score FROM p JOIN t USING (outline) GROUP BY p.outline",
)
def x6(spark, d):
    s = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("outline"), F.col("o_orderpriority").alias("chapter"), F.concat("o_orderstatus", F.col("o_custkey").cast("string")).alias("title"))
    return ops.outline_score(s).select("outline", F.round("score", 4).alias("score"))


@query(
    "x7_bibliography_audit",
    "WITH m AS (SELECT DISTINCT l_orderkey % 97 AS draft, l_linenumber AS number FROM lineitem WHERE l_returnflag <> 'N'), s AS (SELECT o_orderkey % 97 AS draft, (o_orderkey // 97 % 9 + 1)::INT AS number, o_custkey % 40 AS key FROM orders), d AS (SELECT draft FROM m UNION SELECT draft FROM s) SELECT draft, (SELECT count(*) FROM m WHERE m.draft = d.draft AND NOT EXISTS (SELECT 1 FROM s WHERE s.draft = m.draft AND s.number = m.number))::BIGINT AS broken, (SELECT count(*) FROM s WHERE s.draft = d.draft AND NOT EXISTS (SELECT 1 FROM m WHERE s.draft = m.draft AND s.number = m.number))::BIGINT AS orphans, (SELECT count(*) FROM (SELECT key FROM s WHERE s.draft = d.draft GROUP BY key HAVING count(*) > 1))::BIGINT AS duplicates FROM d",
)
def x7(spark, d):
    m = table(spark, d, "lineitem").where("l_returnflag <> 'N'").select((F.col("l_orderkey") % 97).alias("draft"), F.col("l_linenumber").alias("number"))
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select((k % 97).alias("draft"), (F.floor(k / 97) % 9 + 1).cast("int").alias("number"), (F.col("o_custkey") % 40).alias("key"))
    return ops.bibliography_audit(m, s)


@query("x8_latest_bundle", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS bundle FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_custkey")
def x8(spark, d):
    o = table(spark, d, "orders").where("o_orderdate < TIMESTAMP '1996-01-01'")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("bundle"))


@query("x9_timeline", "WITH u AS (SELECT 'order' AS kind, o_custkey AS key, o_orderkey AS place FROM orders UNION ALL SELECT 'customer', c_custkey, 0 FROM customer) SELECT kind, key, place, row_number() OVER (PARTITION BY key ORDER BY place, kind) AS n FROM u")
def x9(spark, d):
    o = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("place"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.lit(0).cast("long").alias("place"))
    return ops.timeline(o, c, at="place").withColumn("n", F.col("n").cast("long"))


@query("x13_length_levels", "SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'fair' ELSE 'long' END AS level, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def x13(spark, d):
    level = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "fair").otherwise("long")
    return table(spark, d, "documents").groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("x15_draft_search", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'apache license')")
def x15(spark, d):
    return table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("apache license"))).select("doc_id", "source")


@query(
    "x16_author_references",
    "WITH w AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 7), r AS (SELECT l_partkey AS ref, count(*) AS mentions, count(*) FILTER (WHERE l_suppkey = 7) AS own FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM w) GROUP BY l_partkey) SELECT ref, mentions::BIGINT AS mentions, own::BIGINT AS own FROM r ORDER BY mentions DESC, ref LIMIT 100",
)
def x16(spark, d):
    line = table(spark, d, "lineitem")
    works = line.where("l_suppkey = 7").select("l_orderkey").distinct()
    r = line.join(works, "l_orderkey", "left_semi").groupBy(F.col("l_partkey").alias("ref")).agg(F.count("*").alias("mentions"), F.count_if(F.col("l_suppkey") == 7).alias("own"))
    return r.orderBy(F.desc("mentions"), "ref").limit(100)


@query(
    "x19_feedback_by_key",
    "WITH f AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'doi:10.1/' || user_id WHEN user_id % 3 = 1 THEN 'arxiv:' || user_id ELSE 'title:t' || user_id END AS key, (event_id % 3 - 1)::INT AS vote FROM events) SELECT key, max_by(vote, event_id) AS vote FROM f GROUP BY key",
)
def x19(spark, d):
    u = F.col("user_id")
    f = table(spark, d, "events").select(F.when(u % 3 == 0, F.concat(F.lit(" 10.1/"), u.cast("string"))).alias("doi"), F.when(u % 3 == 1, u.cast("string")).otherwise("").alias("arxiv_id"), F.concat(F.lit("T"), u.cast("string")).alias("title"), (F.col("event_id") % 3 - 1).cast("int").alias("vote"), F.col("event_id").alias("at"))
    return ops.feedback_by_key(f)


@query("x20_watch_changes", "WITH h AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, count(*) FILTER (WHERE event_type <> before)::BIGINT AS changes FROM h GROUP BY user_id")
def x20(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("user_id", "event_type", before.alias("before")).groupBy("user_id").agg(F.count_if(F.col("event_type") != F.col("before")).alias("changes"))
