"""Queries on blocks, references, service records, versions, merges, exports and pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import text as tx
from scriptoria.operators import evaluation, ingest, relational, retrieval, vectors, versions
from scriptoria.plans.registry import query
from scriptoria.plans.retrieval import _SQL_COS, _mean_sql
from scriptoria.session import table

_LINES_SQL = "l AS (SELECT doc_id, i - 1 AS place, t[i] AS text FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL)))"


def _lines(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "text"))


@query(
    "f3_block_sections",
    f"""WITH {_LINES_SQL}, b AS (SELECT doc_id, place, text, place % 5 = 3 AS head FROM l WHERE trim(text) <> '' UNION ALL SELECT doc_id, -1, '2. Introduction:', true FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY place) AS sec FROM b),
g AS (SELECT doc_id, sec, max(CASE WHEN head THEN trim(text) END) AS title, string_agg(trim(text), chr(10) || chr(10) ORDER BY place) FILTER (WHERE NOT head) AS content FROM s GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INT AS section, coalesce(title, '') AS title, CASE WHEN title = '2. Introduction:' THEN 'introduction' ELSE 'unknown' END AS kind, content FROM g WHERE content IS NOT NULL""",
)
def f3(spark, d):
    """Lines as blocks: every fifth is a heading by its level, "Introduction" one by its words."""
    lines = _lines(spark, d).select("doc_id", "place", F.lit("text").alias("type"), F.when(F.col("place") % 5 == 3, 1).otherwise(0).alias("level"), "text")
    methods = table(spark, d, "documents").where("text IS NOT NULL AND doc_id % 3 = 0").select("doc_id", F.lit(-1).alias("place"), F.lit("text").alias("type"), F.lit(0).alias("level"), F.lit("2. Introduction:").alias("text"))
    return ingest.sections_of(lines.unionByName(methods), "doc_id")


@query("f10_file_dois", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '10.1234/x' || p_partkey END AS doi FROM part")
def f10(spark, d):
    k = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("a/10.1234_x"), k, F.lit(".pdf"))).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("10.1234%2Fx"), k)).otherwise("paper.pdf")
    return table(spark, d, "part").select("p_partkey", ingest.file_doi(path).alias("doi"))


@query(
    "f12_reference_entries",
    "SELECT doc_id, i::INT AS place, CASE i WHEN 0 THEN '10.1234/a' || doc_id WHEN 1 THEN NULL ELSE '10.5/x' END AS doi, CASE i WHEN 0 THEN 2001 ELSE 1999 END AS year, CASE i WHEN 0 THEN 'A title that is long enough ' || doc_id ELSE source || ' in bold' END AS title FROM documents, (SELECT unnest(range(2)) AS i) WHERE text IS NOT NULL",
)
def f12(spark, d):
    k = F.col("doc_id").cast("string")
    list_ = F.concat(F.lit("\n## References\n[1] Smith, J. (2001). A title that is long enough "), k, F.lit(". Journal. doi:10.1234/a"), k, F.lit("\n[2] Doe, A. **"), F.col("source"), F.lit(" in bold**, some place, 1999\n[3] short\n\n# Appendix\n[4] Not, A. (2002). A reference that comes too late. X"))
    e = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(ingest.reference_entries(F.concat("text", list_))).alias("place", "e"))
    return e.select("doc_id", "place", ingest.parsed_entry(F.col("e")).alias("p")).select("doc_id", "place", "p.doi", "p.year", "p.title")


@query("f13_reference_decode", "SELECT l_orderkey, count(DISTINCT l_partkey)::INT AS n, min('W' || l_partkey) AS least FROM lineitem GROUP BY l_orderkey")
def f13(spark, d):
    """Work records with their references as JSON, decoded again."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("W"), F.col("l_partkey").cast("string"))).alias("referenced_works"))
    r = g.select("l_orderkey", ingest.references_of(F.to_json(F.struct("referenced_works"))).alias("r"))
    return r.select("l_orderkey", F.size("r").alias("n"), F.array_min("r").alias("least"))


@query("f18_title_cascade", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 IN (1, 2) THEN p_name || ' ' || p_type ELSE 'Paper on ' || p_name END AS title FROM part")
def f18(spark, d):
    k = F.col("p_partkey") % 4
    embedded = F.when(k == 0, F.concat(F.lit(" "), "p_name")).when(k == 1, F.concat("p_name", F.lit(".pdf"))).when(k == 2, F.lit("Untitled 3"))
    landed = F.when(k.isin(1, 2), F.concat_ws(" ", "p_name", "p_type")).when(k == 0, F.lit("never reached")).otherwise("12345")
    return table(spark, d, "part").select("p_partkey", ingest.cascade([embedded, landed, F.concat(F.lit("Paper on "), "p_name")], ingest.garbage_title).alias("title"))


@query(
    "f20_enrichment",
    "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority))[1] AS first_concept, least(count(*), 30)::INT AS n_concepts, least(count(DISTINCT o_orderstatus), 25)::INT AS n_rors, count(DISTINCT o_orderpriority)::INT AS n_funders, count(*)::BIGINT AS cited_by FROM orders GROUP BY o_custkey",
)
def f20(spark, d):
    """A work record per customer built from its orders, flattened again."""
    concept = F.struct(F.col("o_orderpriority").alias("display_name"), F.lit(1).alias("level"), F.lit(0.5).alias("score"))
    grant = F.struct(F.col("o_orderpriority").alias("funder"), F.concat(F.lit("F "), "o_orderpriority").alias("funder_display_name"), F.lit("a").alias("award_id"))
    author = F.struct(F.lit("first").alias("author_position"), F.array(F.struct(F.col("o_orderstatus").alias("ror"), F.lit("x").alias("display_name"))).alias("institutions"))
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(concept)).alias("concepts"), F.collect_list(grant).alias("grants"), F.collect_list(author).alias("authorships"), F.count("*").alias("cited_by_count"))
    e = g.select("o_custkey", ingest.enrichment(F.to_json(F.struct("concepts", "grants", "authorships", "cited_by_count"))).alias("e"))
    return e.select("o_custkey", F.get("e.concepts", F.lit(0))["display_name"].alias("first_concept"), F.size("e.concepts").alias("n_concepts"), F.size("e.rors").alias("n_rors"), F.size("e.funders").alias("n_funders"), F.col("e.cited_by").alias("cited_by"))


@query("f23_clauses")
def f23(spark, d):
    """Independent clauses of every sentence; SQL has no look-ahead."""
    s = table(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("place", "s"))
    return s.select("doc_id", "place", F.size(ingest.clauses(F.col("s"))).alias("n"))


@query("f23_plan_points")
def f23_plans(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(ingest.plan_points(F.col("text"))).alias("n"))


@query(
    "f26_mentions",
    f"""WITH {_LINES_SQL}, p AS (SELECT doc_id, place, 'see Fig. ' || place % 4 || ': ' || text AS text FROM l), q AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM p)
SELECT doc_id AS doc, (place % 4)::INT AS visual, place::INT AS place, substr(text, 1, 600) AS text, CASE WHEN length(before) > 600 THEN substr(before, length(before) - 599) ELSE before END AS before FROM q WHERE place % 4 > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, place % 4 ORDER BY place) <= 8""",
)
def f26(spark, d):
    n = F.col("place") % 4
    p = _lines(spark, d).select(F.col("doc_id").alias("doc"), "place", F.concat(F.lit("see Fig. "), n.cast("string"), F.lit(": "), "text").alias("text"))
    v = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("visual")).select("doc", "visual", F.when(F.col("visual") == 2, "chart").otherwise("figure").alias("kind"), F.col("visual").alias("number"))
    return ingest.mentions(p, v)


@query("g29_json_block", "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN json_extract_string(props, '$.k') END AS k FROM events")
def g29(spark, d):
    answer = F.when(F.col("event_id") % 5 == 0, "no object here").otherwise(F.concat(F.lit("Sure:\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\nDone.")))
    return table(spark, d, "events").select("event_id", F.get_json_object(ingest.json_block(answer), "$.k").alias("k"))


_STOPS = " ".join(f"WHEN '{code}' THEN [{', '.join(repr(w) for w in words)}]" for code, words in tx.LANGUAGE_WORDS.items())


@query(
    "r6_language_terms",
    f"WITH x AS (SELECT doc_id, lang, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS t, CASE lang {_STOPS} ELSE [{', '.join(repr(w) for w in tx.LANGUAGE_WORDS['en'])}] END AS stop FROM documents) SELECT doc_id, CASE lang WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' ELSE 'english' END AS config, len(list_filter(t, lambda w: NOT list_contains(stop, w)))::INT AS terms FROM x",
)
def r6(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.language_config(F.col("lang")).alias("config"), F.size(tx.language_terms(F.col("text"), F.col("lang"))).alias("terms"))


@query("r15_accepted_expansions", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' ' || c_mktsegment ELSE c_name END AS query FROM customer")
def r15(spark, d):
    """The expander is injected; here one that answers well, too short or too long."""
    k = F.col("c_custkey") % 3
    expanded = F.when(k == 0, F.concat_ws(" ", "c_name", "c_mktsegment")).when(k == 1, F.lit("x")).otherwise(F.repeat(F.col("c_name"), 60))
    return table(spark, d, "customer").select("c_custkey", retrieval.accepted_expansion(F.col("c_name"), expanded).alias("query"))


@query("r18_vector_rerank", f"WITH c AS (SELECT vec_id FROM embeddings WHERE label IN (0, 1) ORDER BY vec_id LIMIT 100) SELECT b.vec_id AS id, round({_SQL_COS}, 6) AS score FROM embeddings a, embeddings b JOIN c ON b.vec_id = c.vec_id WHERE a.vec_id = 3 ORDER BY {_SQL_COS} DESC, id LIMIT 10")
def r18(spark, d):
    """The candidates of another leg, ranked again by the cosine of their vectors."""
    e = table(spark, d, "embeddings")
    c = e.where("label IN (0, 1)").orderBy("vec_id").limit(100).select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("vec_id = 3").select(F.col("embedding").alias("q"))
    return c.join(F.broadcast(q)).select("id", vectors.cosine(F.col("embedding"), F.col("q")).alias("s")).orderBy(F.desc("s"), "id").limit(10).select("id", F.round("s", 6).alias("score"))


@query("r19_context_build", "WITH r AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id DESC) AS place FROM embeddings WHERE label = 1) SELECT place, id, coalesce(text, '') AS content FROM r LEFT JOIN documents ON doc_id = id")
def r19(spark, d):
    """Full content for ranked results, in their order; what has no row keeps its place."""
    r = retrieval.ranked(table(spark, d, "embeddings").where("label = 1").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("score")))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return r.join(docs, "id", "left").select(F.col("rank").cast("long").alias("place"), "id", F.coalesce("text", F.lit("")).alias("content"))


@query(
    "r24_visual_search",
    f"WITH d AS (SELECT b.vec_id AS id, row_number() OVER (ORDER BY {_SQL_COS} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id = 5 AND b.label IN (2, 3) QUALIFY r <= 30), s AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id % 17 DESC, vec_id) AS r FROM embeddings WHERE label IN (2, 3) QUALIFY r <= 30) SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM (SELECT * FROM d UNION ALL SELECT * FROM s) GROUP BY id",
)
def r24(spark, d):
    """Dense and sparse legs over visuals of two kinds, fused."""
    e = table(spark, d, "embeddings").where("label IN (2, 3)")
    q = table(spark, d, "embeddings").where("vec_id = 5").select(F.col("embedding").alias("q"))
    dense = e.join(F.broadcast(q)).select(F.lit("dense").alias("leg"), F.col("vec_id").alias("id"), vectors.cosine(F.col("embedding"), F.col("q")).alias("score"))
    sparse = e.select(F.lit("sparse").alias("leg"), F.col("vec_id").alias("id"), (F.col("vec_id") % 17).cast("double").alias("score"))
    return retrieval.fused_legs(dense.union(sparse), {"dense": 1.0, "sparse": 1.0}, 30).select("id", F.round("score", 8).alias("score"))


_CONTEXT = "'Shipped as ' || l_linestatus || ' with a quantity of ' || l_quantity::INT"
_CONTEXTS_SQL = f"x AS (SELECT l_partkey AS id, l_returnflag <> 'R' AS later, l_orderkey * 10 + l_linenumber AS edge, {_CONTEXT} AS c FROM lineitem), o AS (SELECT id, c, later, edge FROM x QUALIFY row_number() OVER (PARTITION BY id, lower(c) ORDER BY later, edge, c) = 1), ctx AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY later, edge, c)::INT AS place, c AS context FROM o QUALIFY place <= 20)"


def _contexts(spark, d):
    c = F.concat(F.lit(" Shipped as "), "l_linestatus", F.lit(" with a quantity of "), F.col("l_quantity").cast("int").cast("string"), F.lit(" "))
    return ingest.contexts(table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge"), (F.col("l_returnflag") == "R").alias("influential"), F.array(c, F.lit("too short")).alias("contexts")))


@query("d8_citation_contexts", f"WITH {_CONTEXTS_SQL} SELECT id, place, context FROM ctx")
def d8(spark, d):
    return _contexts(spark, d)


@query(
    "r28_context_cosine",
    f"WITH {_CONTEXTS_SQL}, a AS (SELECT {_mean_sql('label = 1')} AS c), n AS (SELECT id, count(*)::BIGINT AS n FROM ctx GROUP BY id) SELECT n.id, n, coalesce(round(list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(c, c)), 6), 0) AS cosine FROM n CROSS JOIN a LEFT JOIN embeddings ON vec_id = id",
)
def r28(spark, d):
    """How many contexts a work has, and their vector's cosine with an anchor; 0 without one."""
    e = table(spark, d, "embeddings")
    n = _contexts(spark, d).groupBy("id").agg(F.count("*").alias("n"))
    anchor = vectors.centroid(e.where("label = 1"), "embedding")
    v = n.join(e.select(F.col("vec_id").alias("id"), "embedding"), "id", "left").join(F.broadcast(anchor))
    return v.select("id", "n", F.coalesce(F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 6), F.lit(0.0)).alias("cosine"))


@query("d4_near_duplicates")
def d4(spark, d):
    """Greedy removal of near copies within a label, longest first; SQL has no greedy pass."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("bucket"), F.col("embedding").alias("vector"), (F.col("vec_id") % 97).alias("size"))
    return versions.near_duplicate_chunks(e, 0.3)


@query(
    "d7_pools",
    "WITH u AS (SELECT 0 AS pool, c_nationkey AS k, min(c_name) AS name FROM customer WHERE c_custkey % 7 = 0 GROUP BY 2 UNION ALL SELECT 1, s_nationkey, min(s_name) FROM supplier GROUP BY 2 UNION ALL SELECT 2, n_nationkey, n_name FROM nation) SELECT k, name, pool FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY pool) = 1",
)
def d7(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 7 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_name").alias("name"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("name"))
    return versions.pooled([c, s, table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))], "k")


@query(
    "k6_json_merge",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '7' ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 2 = 0 THEN event_type END AS t FROM events",
)
def k6(spark, d):
    update = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.lit(7).alias("k"), F.col("event_type").alias("t"))))
    m = table(spark, d, "events").select("event_id", versions.merged_json(F.col("props"), update).alias("j"))
    return m.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.t").alias("t"))


@query(
    "k10_training_rows",
    r"SELECT split_part(text, '.', 1) AS title, 1990 + doc_id % 35 AS year, source AS section, '10.1/' || doc_id AS doi, text AS content FROM documents WHERE len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) >= 50",
)
def k10(spark, d):
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("source").alias("section"), F.col("text").alias("content"), tx.word_count(F.col("text")).alias("tokens"))
    papers = docs.select(F.col("doc_id").alias("document_id"), F.split_part("text", F.lit("."), F.lit(1)).alias("title"), (1990 + F.col("doc_id") % 35).alias("year"), F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"))
    return ingest.training_rows(chunks, papers)


@query("k16_assembled_books", "SELECT c_mktsegment AS book, string_agg('## ' || c_name || chr(10) || chr(10) || floor(c_acctbal)::INT, chr(10) || chr(10) ORDER BY c_custkey) AS markdown FROM customer GROUP BY 1")
def k16(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("book"), F.col("c_custkey").alias("place"), F.col("c_name").alias("title"), F.floor("c_acctbal").cast("int").cast("string").alias("content"))
    return ingest.assembled(c)


@query(
    "w6_version_refs",
    """WITH dr AS (SELECT md5(o_orderkey::VARCHAR) AS id, o_custkey % 10 AS chapter, o_orderpriority AS section, o_orderkey AS version, o_orderstatus = 'P' AS act FROM orders),
named AS (SELECT (o_orderkey % 12) || ':' || o_orderpriority || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ':latest' ELSE ':v' || o_orderkey END AS ref, (o_orderkey % 12)::INT AS chapter, o_orderpriority AS section, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey END AS v FROM orders WHERE o_orderkey < 60),
hit AS (SELECT ref, id, row_number() OVER (PARTITION BY ref ORDER BY act DESC, version DESC, id) AS r FROM named JOIN dr USING (chapter, section) WHERE v IS NULL OR version = v),
pre AS (SELECT substr(md5(o_orderkey::VARCHAR), 1, 9) AS ref FROM orders WHERE o_orderkey BETWEEN 100 AND 140 UNION ALL SELECT substr(md5('s' || c_custkey::VARCHAR), 1, 8) FROM customer WHERE c_custkey < 20),
pd AS (SELECT ref, count(*) AS n, min(id) AS id FROM pre JOIN dr ON starts_with(id, ref) GROUP BY ref),
ps AS (SELECT ref, count(*) AS n, min(id) AS id FROM pre JOIN (SELECT md5('s' || c_custkey::VARCHAR) AS id FROM customer) ON starts_with(id, ref) WHERE ref NOT IN (SELECT ref FROM pd) GROUP BY ref)
SELECT ref, 'draft' AS kind, id FROM hit WHERE r = 1 UNION ALL SELECT ref, 'draft', id FROM pd WHERE n = 1 UNION ALL SELECT ref, 'snapshot', id FROM ps WHERE n = 1""",
)
def w6(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    md5 = lambda x: F.md5(x.cast("binary"))
    k = F.col("o_orderkey")
    drafts = o.select(md5(k.cast("string")).alias("id"), (F.col("o_custkey") % 10).cast("int").alias("chapter"), F.col("o_orderpriority").alias("section"), k.alias("version"), (F.col("o_orderstatus") == "P").alias("is_active"), F.repeat(F.lit("x"), 60).alias("content"))
    snapshots = c.select(md5(F.concat(F.lit("s"), F.col("c_custkey").cast("string"))).alias("id"))
    ending = F.when(k % 3 == 0, "").when(k % 3 == 1, ":latest").otherwise(F.concat(F.lit(":v"), k.cast("string")))
    named = o.where("o_orderkey < 60").select(F.concat((k % 12).cast("string"), F.lit(":"), "o_orderpriority", ending).alias("ref"))
    prefixes = o.where("o_orderkey BETWEEN 100 AND 140").select(F.substring(md5(k.cast("string")), 1, 9).alias("ref")).union(c.where("c_custkey < 20").select(F.substring(md5(F.concat(F.lit("s"), F.col("c_custkey").cast("string"))), 1, 8)))
    return versions.resolved(named.union(prefixes).distinct(), drafts, snapshots)


@query(
    "w9_corpus_drift",
    "WITH p AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), r AS (SELECT label, i, sum(n) OVER w AS n, sum(s) OVER w / sum(n) OVER w AS m FROM p WINDOW w AS (PARTITION BY i ORDER BY label)), c AS (SELECT label, any_value(n)::BIGINT AS n, list(m ORDER BY i) AS c FROM r GROUP BY label), b AS (SELECT *, lag(c) OVER (ORDER BY label) AS b FROM c) SELECT label, n, round(list_dot_product(c, b) / sqrt(list_dot_product(c, c) * list_dot_product(b, b)), 5) AS drift_cosine, round(1 - round(list_dot_product(c, b) / sqrt(list_dot_product(c, c) * list_dot_product(b, b)), 5), 5) AS drift_delta FROM b",
)
def w9(spark, d):
    return versions.centroid_drift(table(spark, d, "embeddings"), "label", "embedding")


@query(
    "x12_provenance",
    "WITH e AS (SELECT user_id AS doc, ts, event_type AS s, json_extract_string(props, '$.k')::INT % 3 AS r FROM events), n AS (SELECT *, lead(s) OVER w AS ns, lead(r) OVER w AS nr, row_number() OVER (PARTITION BY doc ORDER BY ts DESC) AS back FROM e WINDOW w AS (PARTITION BY doc ORDER BY ts)), h AS (SELECT doc, list(s ORDER BY ts) FILTER (WHERE back > 1 AND (s <> ns OR r <> nr)) AS h FROM n GROUP BY doc) SELECT n.doc, s AS source, r AS round, array_to_string(h[greatest(1, len(h) - 9):], ',') AS history FROM n JOIN h ON n.doc = h.doc WHERE back = 1",
)
def x12(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("ts").alias("at"), F.col("event_type").alias("source"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("round"), F.lit(None).cast("string").alias("subtopic"))
    p = versions.provenance(e.limit(0), e)
    return p.select("doc", "source", "round", F.array_join("history", ",").alias("history"))


@query(
    "x5_version_diff",
    r"""WITH x AS (SELECT item_id, lag(text) OVER (ORDER BY item_id) AS a, text AS b FROM benchmark), w AS (SELECT item_id, unnest(regexp_extract_all(a, '[^ \t\n\x0B\f\r]+')) AS w, -1 AS n FROM x WHERE a IS NOT NULL UNION ALL SELECT item_id, unnest(regexp_extract_all(b, '[^ \t\n\x0B\f\r]+')), 1 FROM x WHERE a IS NOT NULL)
SELECT item_id, sum(greatest(n, 0))::INT AS words_added, sum(greatest(-n, 0))::INT AS words_removed FROM (SELECT item_id, w, sum(n) AS n FROM w GROUP BY ALL) GROUP BY item_id""",
)
def x5(spark, d):
    """Each version against the one before; the items stand for versions of one draft."""
    from pyspark.sql import Window

    x = table(spark, d, "benchmark").withColumn("a", F.lag("text").over(Window.orderBy("item_id"))).where("a IS NOT NULL")
    return x.select("item_id", tx.prose_diff(F.col("a"), F.col("text")).alias("p")).select("item_id", "p.words_added", "p.words_removed")


@query("x14_open_gaps", "SELECT o_orderpriority AS kind, count(*)::BIGINT AS gaps, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS open, min(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS first_open FROM orders GROUP BY 1")
def x14(spark, d):
    is_open = F.col("o_orderstatus") == "O"
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("gaps"), F.count_if(is_open).alias("open"), F.min(F.when(is_open, F.col("o_orderkey"))).alias("first_open"))


@query(
    "e8_citation_quality",
    "WITH c AS (SELECT l_suppkey AS output, l_orderkey AS sentence, max(l_quantity / 50) OVER (PARTITION BY l_suppkey, l_orderkey) AS tog, l_discount * 10 AS alone, CASE WHEN l_linenumber > 1 THEN l_tax * 10 END AS rest FROM lineitem), s AS (SELECT output, sentence, bool_or(tog >= 0.5) AS holds, count(*) AS n, count(*) FILTER (WHERE NOT (alone < 0.5 AND coalesce(rest >= 0.5, false))) AS used FROM c GROUP BY ALL) SELECT output, round(100 * avg(holds::INT), 1) AS recall, round(100.0::DOUBLE * sum(CASE WHEN holds THEN used ELSE 0 END) / sum(n), 1) AS precision, count(*)::BIGINT AS sentences, sum(n)::BIGINT AS citations FROM s GROUP BY output",
)
def e8(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey", "l_orderkey")
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("output"), F.col("l_orderkey").alias("sentence"), F.monotonically_increasing_id().alias("source"), F.max(F.col("l_quantity") / 50).over(w).alias("together"), (F.col("l_discount") * 10).alias("alone"), F.when(F.col("l_linenumber") > 1, F.col("l_tax") * 10).alias("rest"))
    return evaluation.citation_quality(c)


@query("e10_hits", "SELECT p_type AS kind, count(*)::BIGINT AS n, round(100 * avg(coalesce(p_size % 9 <= 1 AND p_size % 9 > 0, false)::INT), 2) AS p1, round(100 * avg(coalesce(p_size % 9 <= 3 AND p_size % 9 > 0, false)::INT), 2) AS r3 FROM part GROUP BY 1")
def e10(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("kind"), F.when(F.col("p_size") % 9 > 0, F.col("p_size") % 9).alias("rank"))
    return evaluation.hits_at(p, ["kind"])


@query("s6_scroll", "SELECT vec_id, label FROM embeddings WHERE vec_id > 40 ORDER BY vec_id LIMIT 100")
def s6(spark, d):
    """A page of the vector table after a cursor."""
    return relational.scroll(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 40, 100)


@query("s7_retrieve", "SELECT vec_id, label, embedding[1]::DOUBLE AS x FROM embeddings WHERE vec_id IN (SELECT p_size FROM part)")
def s7(spark, d):
    ids = table(spark, d, "part").select(F.col("p_size").cast("long").alias("vec_id"))
    return table(spark, d, "embeddings").join(ids, "vec_id", "left_semi").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"))


@query("s17_aliases", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'budget' WHEN p_type = 'PROMO' THEN 'budget' ELSE lower(p_type) END AS name FROM part")
def s17(spark, d):
    """A table of aliases (canonical name, variants), flattened and looked up."""
    aliases = spark.sql("SELECT 'budget' AS canonical, array('Economy', 'PROMO ') AS variants")
    return relational.with_aliases(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", aliases).select("p_partkey", "name")


@query("j11_anchor_edges", "WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey < 3), e AS (SELECT l_orderkey AS x, l_partkey AS y FROM lineitem), b AS (SELECT x AS anchor, y AS id FROM e WHERE x IN (SELECT id FROM a) UNION ALL SELECT y, x FROM e WHERE y IN (SELECT id FROM a)) SELECT id, count(DISTINCT anchor)::BIGINT AS anchors FROM b GROUP BY id")
def j11(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    a = l.where("l_orderkey < 3").select(F.col("l_partkey").alias("anchor")).distinct()
    e = l.select(F.inline(F.array(F.struct(F.col("l_orderkey").alias("anchor"), F.col("l_partkey").alias("id")), F.struct(F.col("l_partkey").alias("anchor"), F.col("l_orderkey").alias("id")))))
    return e.join(a, "anchor", "left_semi").groupBy("id").agg(F.countDistinct("anchor").alias("anchors"))


@query(
    "j12_version_pairs",
    "WITH a AS (SELECT l_orderkey AS k, l_linenumber AS s, max(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL), b AS (SELECT l_orderkey AS k, l_linenumber AS s, max(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL) SELECT coalesce(a.k, b.k) AS k, coalesce(a.s, b.s) AS s, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.k = b.k AND a.s = b.s",
)
def j12(spark, d):
    v = lambda flag, name: table(spark, d, "lineitem").where(F.col("l_returnflag") != flag).groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("s")).agg(F.max("l_quantity").alias(name))
    j = v("N", "a").join(v("A", "b"), ["k", "s"], "full")
    return j.select("k", "s", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("change"))


@query(
    "j14_sentence_sources",
    "WITH s AS (SELECT item_id, unnest(list_filter(string_split(text, '.'), lambda x: trim(x) <> '')) AS s FROM benchmark), src AS (SELECT item_id, item_id // 10 AS g, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS t FROM benchmark), x AS (SELECT s.item_id, s, src.item_id AS source, list_distinct(list_filter(regexp_split_to_array(lower(s), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS a, t FROM s JOIN src ON s.item_id // 10 = g) SELECT item_id, s AS sentence, round(max(len(list_intersect(a, t)) / len(a)::DOUBLE), 6) AS best FROM x WHERE len(a) > 0 GROUP BY ALL",
)
def j14(spark, d):
    """Every sentence against the sources of its own draft (ten items each), with a scorer
    of shared words; sources meet sentences by draft, never all with all."""
    b = table(spark, d, "benchmark").withColumn("draft", F.floor(F.col("item_id") / 10))
    terms = lambda c: F.array_distinct(retrieval.tokens(F.col(c)))
    s = b.select("draft", "item_id", F.explode(F.filter(F.split("text", r"\."), lambda x: F.trim(x) != "")).alias("sentence")).withColumn("a", terms("sentence")).where(F.size("a") > 0)
    x = s.join(b.select("draft", terms("text").alias("t")), "draft")
    return x.groupBy("item_id", "sentence").agg(F.round(F.max(F.size(F.array_intersect("a", "t")) / F.size("a")), 6).alias("best"))
