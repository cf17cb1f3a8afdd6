"""Text-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import text as tx
from scriptoria.plans.registry import query
from scriptoria.session import table

_HEADINGS = ("1. Experimental Results", "Experimental setup", "Results and Discussion", "2.3 Related Work!", "Summary", "Data availability", "Nothing known", "Review of proxies", "Discussion")
_SECTIONS = ("results", "methods", "results", "related_work", "conclusion", "appendix", "unknown", "related_work", "discussion")


def _pick(values: tuple[str, ...], n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


@query("f1_section_types", "SELECT doc_id, CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SECTIONS)) + " END AS section FROM documents")
def f1(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.section_type(_pick(_HEADINGS, F.col("doc_id"))).alias("section"))


@query(
    "f2_markdown_sections",
    "SELECT doc_id, i::BIGINT AS i, CASE i WHEN 0 THEN 'Abstract' WHEN 1 THEN 'Methods' ELSE 'Results' END AS title, CASE i WHEN 0 THEN source WHEN 1 THEN lang ELSE doc_id::VARCHAR END AS content FROM documents, (SELECT unnest(range(3)) AS i)",
)
def f2(spark, d):
    md = F.concat("source", F.lit("\n# Methods\n"), "lang", F.lit("\n\n#### Results \n"), F.col("doc_id").cast("string"), F.lit("\n"))
    s = table(spark, d, "documents").select("doc_id", F.posexplode(tx.markdown_sections(md)).alias("i", "s"))
    return s.select("doc_id", F.col("i").cast("long").alias("i"), "s.title", "s.content")


@query("f4_chunks")
def f4(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(tx.chunks("text", F.lit("methods"))).alias("chunk", "content"))
    return c.select("doc_id", "chunk", F.length("content").alias("n_chars"), tx.token_count(F.col("content")).alias("tokens"))


@query("f5_token_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::BIGINT AS tokens FROM documents")
def f5(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_count(F.col("text")).cast("long").alias("tokens"))


@query("f6_staleness", "SELECT doc_id, doc_id % 5 < 3 AS stale FROM documents")
def f6(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.coalesce(F.col("doc_id") % 5, F.lit(0)) < 3).alias("stale"))


@query("f7_html_tables", "SELECT p_partkey, p_brand || ' | ' || p_size || chr(10) || 'a & b | x' AS t FROM part")
def f7(spark, d):
    html = F.concat(F.lit("<table><TR class='a'><td>"), "p_brand", F.lit("</td><th>"), F.col("p_size").cast("string"), F.lit("</th></TR><tr><td></td></tr><tr><td>a &amp; b</td><td> <b>x</b> </td></tr></table>"))
    return table(spark, d, "part").select("p_partkey", tx.table_to_text(html).alias("t"))


@query("f8_tables_and_equations", "SELECT doc_id, doc_id % 3 = 0 AS has_table, doc_id % 2 = 0 AS has_equation FROM documents")
def f8(spark, d):
    k = F.col("doc_id")
    t = F.concat(F.lit("x\n"), F.when(k % 3 == 0, "|a|b|\n |c|d|\n").otherwise("|a|b|\ntext\n"), F.when(k % 4 == 0, "$$x$$").when(k % 2 == 0, "$a+b=cccccccc$").otherwise("$5 and $6"))
    return table(spark, d, "documents").select("doc_id", tx.has_table(t).alias("has_table"), tx.has_equation(t).alias("has_equation"))


@query("f9_identifiers", "SELECT doc_id, '10.1234/ab' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN '2101.' || lpad(doc_id::VARCHAR, 5, '0') END AS arxiv FROM documents")
def f9(spark, d):
    k = F.col("doc_id").cast("string")
    t = F.concat(F.lit("see https://doi.org/10.1234/ab"), k, F.lit(". "), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("arXiv:2101."), F.lpad(k, 5, "0"), F.lit("v2"))).otherwise("none"))
    return table(spark, d, "documents").select("doc_id", tx.doi(t).alias("doi"), tx.arxiv_id(t).alias("arxiv"))


@query("f11_clean_space", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS clean, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))::BIGINT AS words FROM documents")
def f11(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.clean_space(t).alias("clean"), tx.word_count(t).cast("long").alias("words"))


@query("f14_inverted_abstract", "SELECT p_partkey, p_brand || ' ' || p_type || ' ' || p_brand AS t FROM part WHERE p_brand <> p_type")
def f14(spark, d):
    m = F.create_map(F.col("p_type"), F.array(F.lit(1)), F.col("p_brand"), F.array(F.lit(0), F.lit(2)))
    return table(spark, d, "part").where("p_brand <> p_type").select("p_partkey", tx.inverted_abstract(m).alias("t"))


@query(
    "j9_accepted_tiers",
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 AS t, l_returnflag = 'A' AS au, CASE l_linestatus WHEN 'O' THEN l_linenumber > 2 END AS y, l_discount * 10 AS ab FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN t >= 0.85 THEN 1 WHEN au AND t >= 0.75 AND coalesce(y, true) THEN 2 WHEN ab >= 0.85 THEN 3 WHEN t >= 0.65 AND ab >= 0.65 THEN 4 END AS tier FROM x",
)
def j9(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    year = F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") > 2)
    return l.select("l_orderkey", "l_linenumber", tx.accepted_tier(F.col("l_quantity") / 50.0, F.col("l_returnflag") == "A", year, F.col("l_discount") * 10).alias("tier"))


@query(
    "f16_title_jaccard",
    "WITH x AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9_]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9_]+'), lambda x: x <> '')) AS b FROM part), j AS (SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS s FROM x) SELECT p_partkey, round(s, 6) AS s, CASE WHEN s >= 0.8 THEN 'verified' WHEN s >= 0.5 THEN 'partial' ELSE 'mismatch' END AS verdict FROM j",
)
def f16(spark, d):
    p = table(spark, d, "part")
    s = tx.jaccard(F.col("p_type"), F.col("p_name"))
    return p.select("p_partkey", F.round(s, 6).alias("s"), tx.verdict(s).alias("verdict"))


@query("f17_surname_keys", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'whittaker,j' WHEN 1 THEN 'whittaker,j' WHEN 2 THEN 'garcia,' END AS k FROM supplier")
def f17(spark, d):
    names = ("James K. Whittaker", "Whittaker, J. K.", "García", "et al.")
    return table(spark, d, "supplier").select("s_suppkey", tx.surname_key(_pick(names, F.col("s_suppkey"))).alias("k"))


@query("f19_language_vote")
def f19(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", tx.language_vote(F.col("text")).alias("detected"))


@query("f21_sentences", "SELECT doc_id, sum(len(regexp_extract_all(text, '[.!?][ \\t\\n\\x0B\\f\\r]+[^ \\t\\n\\x0B\\f\\r]')) + 1)::BIGINT AS n FROM documents WHERE length(text) > 0 GROUP BY doc_id")
def f21(spark, d):
    return table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n"))


@query("f22_style_fingerprint")
def f22(spark, d):
    s = table(spark, d, "documents").select("source", "doc_id", F.explode(tx.sentences(F.col("text"))).alias("s")).withColumn("w", tx.word_count(F.col("s")))
    g = s.groupBy("source", "doc_id").agg(F.percentile("w", F.lit(0.5)).alias("m"), F.count("*").alias("n"), F.avg(tx.any_of(F.col("s"), ("may", "might", "could", "perhaps")).cast("int")).alias("hedged"))
    return g.groupBy("source").agg(F.round(F.percentile("m", F.lit(0.5)), 3).alias("median_sentence"), F.round(F.percentile("n", F.lit(0.5)), 3).alias("median_sentences"), F.round(F.avg("hedged"), 6).alias("hedging_rate"))


@query("f24_marker_remap", "SELECT doc_id, 'a [' || (doc_id % 3 + 10) || '] b [99] c [' || (doc_id % 3 + 11) || ']' AS t, (doc_id % 3 + 1) || ',99,' || (doc_id % 3 + 2) AS m FROM documents")
def f24(spark, d):
    k = F.col("doc_id") % 3
    t = F.concat(F.lit("a ["), (k + 1).cast("string"), F.lit("] b [99] c ["), (k + 2).cast("string"), F.lit("]"))
    numbers = F.create_map(*[F.lit(x) for i in range(1, 5) for x in (i, i + 9)])
    return table(spark, d, "documents").select("doc_id", tx.remapped(t, numbers).alias("t"), F.array_join(tx.markers(t).cast("array<string>"), ",").alias("m"))


#: A revision of a text: one word replaced everywhere, one dropped, and a paragraph with a marker added.
_REVISED_SQL = "regexp_replace(regexp_replace(text, '\\bthe\\b', 'this', 'g'), '\\bof\\b', '', 'g') || chr(10) || chr(10) || '[2] this is new'"


@query(
    "f25_prose_diff",
    rf"""WITH x AS (SELECT doc_id, text AS a, {_REVISED_SQL} AS b FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(regexp_extract_all(a, '[^ \t\n\x0B\f\r]+')) AS w, -1 AS n FROM x UNION ALL SELECT doc_id, unnest(regexp_extract_all(b, '[^ \t\n\x0B\f\r]+')), 1 FROM x),
g AS (SELECT doc_id, sum(greatest(n, 0))::INT AS added, sum(greatest(-n, 0))::INT AS removed FROM (SELECT doc_id, w, sum(n) AS n FROM w GROUP BY ALL) GROUP BY doc_id),
p AS (SELECT doc_id, len(list_filter(regexp_split_to_array(a, '\n[ \t\n\x0B\f\r]*\n'), lambda t: trim(t) <> '')) AS pa, len(list_filter(regexp_split_to_array(b, '\n[ \t\n\x0B\f\r]*\n'), lambda t: trim(t) <> '')) AS pb, list_contains(regexp_extract_all(a, '\[(\d+)\]', 1), '2') AS had FROM x)
SELECT doc_id, added AS words_added, removed AS words_removed, greatest(pb - pa, 0)::INT AS paragraphs_added, greatest(pa - pb, 0)::INT AS paragraphs_removed, (NOT had)::INT AS citations_added, 0 AS citations_removed FROM g JOIN p USING (doc_id)""",
)
def f25(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    revised = F.concat(F.regexp_replace(F.regexp_replace("text", r"\bthe\b", "this"), r"\bof\b", ""), F.lit("\n\n[2] this is new"))
    return t.select("doc_id", tx.prose_diff(F.col("text"), revised).alias("p")).select("doc_id", "p.*")


@query("f27_length_score", r"SELECT doc_id, round(least(1.0, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) / 500.0), 6)::DOUBLE AS s FROM documents")
def f27(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(tx.length_score(F.col("text"), F.lit(500.0)), 6).alias("s"))


@query("f28_slugs", "SELECT c_custkey, lower(replace(c_name, '#', '')) || '-a-b' AS s FROM customer")
def f28(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.slug(F.concat(F.lit("--"), "c_name", F.lit(" _A!  B_"))).alias("s"))


@query("f29_apa", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Whittaker, J.K.' WHEN 1 THEN 'Doe, J., & Plato' ELSE 'Curie, M., et al.' END AS a FROM supplier")
def f29(spark, d):
    lists = (("James K. Whittaker",), ("Doe, Jane", "Plato"), ("Marie Curie", "B B", "C C", "D D"))
    k = F.col("s_suppkey") % 3
    names = F.when(k == 0, F.array(*map(F.lit, lists[0]))).when(k == 1, F.array(*map(F.lit, lists[1]))).otherwise(F.array(*map(F.lit, lists[2])))
    return table(spark, d, "supplier").select("s_suppkey", tx.apa_authors(names).alias("a"))


@query("f32_arrays", "SELECT l_orderkey, count(*)::BIGINT AS n, list_contains(list(l_linenumber), 4) AS has_four FROM lineitem GROUP BY l_orderkey")
def f32(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("l"))
    return g.select("l_orderkey", F.size("l").cast("long").alias("n"), F.array_contains("l", 4).alias("has_four"))


@query("f33_strings", "SELECT p_partkey, split_part(p_type, ' ', 2) AS second, len(string_split(p_name, ' '))::BIGINT AS words, upper(substr(trim(p_brand), 1, 3)) || '-' || length(p_type) AS code FROM part")
def f33(spark, d):
    return table(spark, d, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(2)).alias("second"), F.size(F.split("p_name", " ")).cast("long").alias("words"), F.concat(F.upper(F.substring(F.trim("p_brand"), 1, 3)), F.lit("-"), F.length("p_type").cast("string")).alias("code"))


@query("f34_math", "SELECT p_partkey, round(log2(1 + p_size), 6) AS l, round(2 ** (-p_size / 30.0), 6)::DOUBLE AS decay, round(sqrt(p_retailprice), 6) AS r FROM part")
def f34(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(F.log2(1 + F.col("p_size")), 6).alias("l"), F.round(F.pow(F.lit(2.0), -F.col("p_size") / 30.0), 6).alias("decay"), F.round(F.sqrt("p_retailprice"), 6).alias("r"))


@query("d2_title_key", "SELECT substr(trim(regexp_replace(regexp_replace(lower(c_name || '!  ' || c_mktsegment), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 140) AS k, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def d2(spark, d):
    return table(spark, d, "customer").groupBy(tx.title_key(F.concat("c_name", F.lit("!  "), "c_mktsegment")).alias("k")).agg(F.count("*").alias("n"))
