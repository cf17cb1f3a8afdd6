"""Graph, clustering and knowledge-graph queries.

The citation graph is the whole citation view; triples come from `part`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import text as tx
from scriptoria.operators import graph as ops
from scriptoria.plans.registry import query
from scriptoria.plans.views import CITATIONS_SQL, citations
from scriptoria.session import table

EDGES_SQL = "e AS MATERIALIZED (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem)"


def _nodes_and_edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = citations(spark, d).toDF("src", "dst")
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), e


def _rank_sql(rounds: int, standard: bool) -> str:
    share = "(SELECT coalesce(sum(rank), 0) FROM {r} WHERE d) / (SELECT n FROM s)" if standard else "CASE WHEN {r}.d THEN (SELECT sum(rank) FROM {r}) / (SELECT n FROM s) ELSE 0 END"
    ctes = [
        EDGES_SQL,
        "k AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst)",
        "g AS MATERIALIZED (SELECT src, count(*) AS n FROM k GROUP BY src)",
        "w AS MATERIALIZED (SELECT src, dst, count(*) / any_value(g.n) AS w FROM k JOIN g USING (src) GROUP BY ALL)",
        "v AS MATERIALIZED (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e))",
        "s AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v)",
        "r0 AS MATERIALIZED (SELECT id, id NOT IN (SELECT src FROM g) AS d, 1.0 / (SELECT n FROM s) AS rank FROM v)",
    ]
    for i in range(rounds):
        r = f"r{i}"
        ctes.append(f"r{i + 1} AS MATERIALIZED (SELECT {r}.id, {r}.d, 0.85 * (coalesce(got, 0) + {share.format(r=r)}) + 0.15 / (SELECT n FROM s) AS rank FROM {r} LEFT JOIN (SELECT dst, sum(w * rank) AS got FROM w JOIN {r} ON src = id GROUP BY dst) ON dst = {r}.id)")
    return "WITH " + ", ".join(ctes) + f" SELECT id, round(rank, 10) AS rank FROM r{rounds}"


@query("g1_page_rank", _rank_sql(30, False))
def g1(spark, d):
    return ops.page_rank(None, _nodes_and_edges(spark, d)[1]).select("id", F.round("rank", 10).alias("rank"))


@query("g1_page_rank_standard", _rank_sql(30, True))
def g1_standard(spark, d):
    return ops.page_rank(None, _nodes_and_edges(spark, d)[1], standard=True).select("id", F.round("rank", 10).alias("rank"))


@query(
    "g2_coupling",
    "WITH r AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS ref FROM lineitem), s AS (SELECT DISTINCT ref FROM r WHERE id < 50), m AS (SELECT count(*) AS m FROM s) SELECT id, round(count(*) FILTER (WHERE ref IN (SELECT ref FROM s)) / sqrt(count(*)::DOUBLE * any_value(m)), 6) AS coupling FROM r, m GROUP BY id",
)
def g2(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("ref"))
    return ops.coupling(r, r.where("id < 50").select("ref")).select("id", F.round("coupling", 6).alias("coupling"))


@query("g3_cocitation", f"WITH {CITATIONS_SQL}, c AS (SELECT DISTINCT citing FROM citations WHERE cited = 1) SELECT cited AS id, count(DISTINCT citing)::BIGINT AS n FROM citations WHERE citing IN (SELECT citing FROM c) AND cited <> 1 GROUP BY cited")
def g3(spark, d):
    return ops.cocitation(citations(spark, d), F.lit(1))


@query(
    "g4_citation_velocity",
    "WITH y AS (SELECT l_partkey AS id, year(l_shipdate) AS year, count(*) AS n FROM lineitem GROUP BY ALL) SELECT id, round(avg(n), 6) AS velocity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY year DESC) AS r FROM y) WHERE r <= 3 GROUP BY id",
)
def g4(spark, d):
    y = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    g = y.groupBy("id").agg(F.collect_list(F.struct("year", "n")).alias("counts"))
    return g.select("id", F.round(ops.citation_velocity(F.col("counts")), 6).alias("velocity"))


@query("g5_velocity_score", "SELECT p_partkey AS id, CASE WHEN p_size > 10 THEN round((p_size - 10) / CASE WHEN 1980 + p_partkey % 60 > 2027 THEN 1.0 ELSE greatest(2026 - (1980 + p_partkey % 60) + 1, 0.25) END, 6) ELSE 0.0 END AS score FROM part")
def g5(spark, d):
    s = ops.velocity_score(F.col("p_size") - 10, 1980 + F.col("p_partkey") % 60, 2026)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(s, 6).alias("score"))


@query("g6_one_timer_filter", "SELECT l_partkey AS id, count(*) <= 25 AND count(DISTINCT l_suppkey) < 22 AS one_timer FROM lineitem GROUP BY l_partkey")
def g6(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(((F.count("*") <= 25) & (F.countDistinct("l_suppkey") < 22)).alias("one_timer"))


@query(
    "g7_author_overlap",
    "WITH a AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey < 5000 GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2) SELECT l_orderkey AS id, count(DISTINCT l_suppkey)::BIGINT AS known FROM lineitem WHERE l_orderkey >= 5000 AND l_suppkey IN (SELECT l_suppkey FROM a) GROUP BY l_orderkey",
)
def g7(spark, d):
    line = table(spark, d, "lineitem")
    known = line.where("l_orderkey < 5000").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("n")).where("n >= 2")
    return line.where("l_orderkey >= 5000").join(known, "l_suppkey", "left_semi").groupBy(F.col("l_orderkey").alias("id")).agg(F.countDistinct("l_suppkey").alias("known"))


@query("g8_influential", "SELECT l_partkey AS id, count(*) FILTER (WHERE l_returnflag = 'R' OR l_linestatus = 'F')::BIGINT AS influential FROM lineitem GROUP BY l_partkey")
def g8(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count_if((F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "F")).alias("influential"))


#: Types of works by key, dropped and kept ones.
_KINDS = ("Editorial", "article", "erratum", "proceedings-article", "Correction", "paratext", "letter", "retraction", "peer-review", "book", "grant", "proceedings-article")


@query(
    "g9_hard_filters",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'retracted' WHEN p_partkey % 7 = 0 AND p_partkey % 5 <> 0 THEN 'predatory_venue' WHEN p_partkey % 13 = 0 THEN 'predatory_venue' WHEN p_partkey % 12 IN (0, 2, 4, 6, 8, 10) THEN 'doc_type:' || list_value('editorial', 'erratum', 'correction', 'letter', 'peer-review', 'grant')[(p_partkey % 12) // 2 + 1] WHEN p_partkey % 12 IN (3, 11) AND p_size < 4 THEN 'doc_type:short_proceedings' END AS reason FROM part",
)
def g9(spark, d):
    k = F.col("p_partkey")
    fixed = F.concat(F.lit("Journal of OMICS International"), F.when(k % 5 == 0, " Society").otherwise(""))
    venue = F.when(k % 13 == 0, "Blocked Letters").when(k % 7 == 0, fixed).otherwise("Fine Journal")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 12 + 1).cast("int"))
    return table(spark, d, "part").select(k.alias("id"), ops.drop_reason(k % 11 == 0, venue, kind, F.col("p_size"), allowed=("society",), blocked=("blocked",)).alias("reason"))


@query(
    "g10_stop_rule",
    "WITH m AS (SELECT l_linenumber AS round, quantile_cont(l_quantity / l_linenumber, 0.5) AS m, 1.0 / l_linenumber AS novelty FROM lineitem GROUP BY l_linenumber), f AS (SELECT m AS f FROM m WHERE round = (SELECT min(round) FROM m)) SELECT round, novelty < 0.3 OR m < 0.7 * f AS stop, CASE WHEN novelty < 0.3 THEN 'novelty' WHEN m < 0.7 * f THEN 'median_drop' ELSE '' END AS reason FROM m, f",
)
def g10(spark, d):
    n = F.col("l_linenumber")
    return ops.stop_reason(table(spark, d, "lineitem").select(n.alias("round"), (F.col("l_quantity") / n).alias("score"), (1.0 / n).alias("novelty")))


@query(
    "g14_citation_metrics",
    f"WITH {CITATIONS_SQL} SELECT count(*)::BIGINT AS edges, count(*) FILTER (WHERE cited IN (SELECT o_orderkey FROM orders))::BIGINT AS internal, count(*) FILTER (WHERE citing = cited)::BIGINT AS self_edges, count(DISTINCT cited)::BIGINT AS cited_works FROM citations",
)
def g14(spark, d):
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("cited"), F.lit(True).alias("known"))
    c = citations(spark, d).join(known, "cited", "left")
    return c.agg(F.count("*").alias("edges"), F.count("known").alias("internal"), F.count_if(F.col("citing") == F.col("cited")).alias("self_edges"), F.countDistinct("cited").alias("cited_works"))


@query(
    "g15_self_citation",
    "WITH o AS (SELECT l_orderkey, list_sort(list(DISTINCT chr(97 + (l_suppkey % 26)::INT) || chr(97 + (l_suppkey % 7)::INT))) AS k FROM lineitem GROUP BY 1) SELECT l_orderkey AS id, len(list_intersect(k, ['ab', 'cd', 'ed', 'gb'])) > 0 AS verdict FROM o",
)
def g15(spark, d):
    letter = lambda n: F.char((F.lit(97) + F.col("l_suppkey") % n).cast("int"))
    name = F.concat(F.lit("Given "), letter(26), letter(7))
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(name).alias("names"))
    cited = F.array(*[F.lit(f"{n}, George") for n in ("Ab", "Cd", "Ed", "Gb")])
    return o.select("id", tx.self_cite(F.col("names"), cited)["verdict"].alias("verdict"))


@query("g18_level_stats", "SELECT label AS node_level, count(*)::BIGINT AS nodes, count(DISTINCT vec_id // 10)::BIGINT AS groups FROM embeddings GROUP BY label")
def g18(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("node_level")).agg(F.count("*").alias("nodes"), F.countDistinct(F.floor(F.col("vec_id") / 10)).alias("groups"))


_TERMS_SQL = "t AS (SELECT p_brand AS cluster, p_partkey AS doc, unnest(string_split(p_type || ' ' || p_name, ' ')) AS term FROM part)"
_KEY_SQL = f"""{_TERMS_SQL}, tf AS (SELECT cluster, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), n AS (SELECT count(DISTINCT cluster) AS n FROM tf),
w AS (SELECT cluster, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term), n), s AS (SELECT cluster, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY cluster)), 6) AS weight FROM w)"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("doc"), F.explode(F.split(F.concat_ws(" ", "p_type", "p_name"), " ")).alias("term"))


@query("g19_cluster_keywords", f"WITH {_KEY_SQL} SELECT cluster, sum(weight) AS total, count(*)::BIGINT AS n FROM (SELECT cluster, weight FROM s QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY weight DESC) <= 10) GROUP BY cluster".replace("sum(weight) AS total", "round(sum(weight), 4) AS total"))
def g19(spark, d):
    k = ops.ctfidf(_terms(spark, d))
    return k.groupBy("cluster").agg(F.round(F.sum(F.round("weight", 6)), 4).alias("total"), F.count("*").alias("n"))


@query(
    "g20_npmi_coherence",
    "WITH k AS (SELECT DISTINCT p_brand AS cluster, unnest(string_split(p_name, ' ')) AS term FROM part), i AS (SELECT DISTINCT p_partkey AS doc, unnest(string_split(p_name || ' ' || p_type, ' ')) AS term FROM part), n AS (SELECT count(DISTINCT doc)::DOUBLE AS n FROM i), c AS (SELECT term, count(*) AS c FROM i GROUP BY term), m AS (SELECT x.term AS a, y.term AS b, count(*) AS nboth FROM i x JOIN i y ON x.doc = y.doc AND x.term < y.term GROUP BY ALL), p AS (SELECT x.cluster, x.term AS a, y.term AS b FROM k x JOIN k y ON x.cluster = y.cluster AND x.term < y.term) SELECT cluster, round(avg(CASE WHEN nboth >= n THEN 1.0 ELSE ln((nboth / n) / ((ca.c / n) * (cb.c / n))) / -ln(nboth / n) END), 6) AS npmi, count(*)::BIGINT AS pairs FROM p JOIN m USING (a, b) JOIN c ca ON ca.term = a JOIN c cb ON cb.term = b, n GROUP BY cluster",
)
def g20(spark, d):
    p = table(spark, d, "part")
    words = p.select(F.col("p_brand").alias("cluster"), F.explode(F.split("p_name", " ")).alias("term")).distinct()
    inc = p.select(F.col("p_partkey").alias("doc"), F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("term"))
    return ops.npmi(words, inc).select("cluster", F.round("npmi", 6).alias("npmi"), "pairs")


@query("g23_timeline", "SELECT 10 * (year(o_orderdate) // 10) AS decade, o_orderpriority AS cluster, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def g23(spark, d):
    return table(spark, d, "orders").groupBy((10 * F.floor(F.year("o_orderdate") / 10)).alias("decade"), F.col("o_orderpriority").alias("cluster")).agg(F.count("*").alias("n"))


@query(
    "g24_gap_radar",
    "WITH a AS (SELECT source AS axis, max(length(text)) AS longest FROM documents GROUP BY source), g AS (SELECT source AS axis, count(*) AS gaps FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY source) SELECT axis, round(greatest(0, (longest > 200)::INT - 0.4 * coalesce(gaps, 0)), 4)::DOUBLE AS score FROM a LEFT JOIN g USING (axis)",
)
def g24(spark, d):
    docs = table(spark, d, "documents")
    a = docs.groupBy(F.col("source").alias("axis")).agg(F.max(F.length("text")).alias("longest"))
    g = docs.join(table(spark, d, "labels").where("quality = 0"), "doc_id").groupBy(F.col("source").alias("axis")).agg(F.count("*").alias("gaps"))
    score = F.greatest(F.lit(0.0), (F.col("longest") > 200).cast("double") - 0.4 * F.coalesce("gaps", F.lit(0)))
    return a.join(g, "axis", "left").select("axis", F.round(score, 4).alias("score"))


@query("g25_consensus", "SELECT o_custkey AS claim, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS support, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS contradict FROM orders GROUP BY o_custkey")
def g25(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("claim")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("support"), F.count_if(F.col("o_orderstatus") == "O").alias("contradict"))


_PREDICATES = ("leads to", "Inconsistent With", "uses_method", "is near", "Component  of")
_CANONICAL = ("forces", "contradicts", "uses_method", "is near", "part_of")
_TRIPLES_SQL = "tr AS (SELECT p_brand AS subject, CASE p_size % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CANONICAL)) + " END AS predicate, lower(split_part(p_type, ' ', 3)) AS object, p_partkey AS source FROM part)"


def _triples(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _PREDICATES)), (F.col("p_size") % 5 + 1).cast("int"))
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("subject"), ops.canonical_relation(raw).alias("predicate"), ops.canonical_entity(F.concat(F.lit("  "), F.split_part("p_type", F.lit(" "), F.lit(3)), F.lit(" -."))).alias("object"), F.col("p_partkey").alias("source"))


@query("g26_g27_canonical_triples", f"WITH {_TRIPLES_SQL} SELECT subject, predicate, object, source FROM tr")
def g26(spark, d):
    return _triples(spark, d)


@query("g28_kg_browse", f"WITH {_TRIPLES_SQL} SELECT predicate, count(*)::BIGINT AS n, count(DISTINCT subject)::BIGINT AS subjects, count(DISTINCT object)::BIGINT AS objects FROM tr WHERE subject ILIKE '%#1%' OR object ILIKE '%e%' GROUP BY predicate")
def g28(spark, d):
    t = _triples(spark, d).where(F.col("subject").ilike("%#1%") | F.col("object").ilike("%e%"))
    return t.groupBy("predicate").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"))


@query("j15_k_hop")
def j15(spark, d):
    start = table(spark, d, "part").agg(F.min("p_brand")).first()[0]
    return ops.k_hop(_triples(spark, d).select("subject", "predicate", "object").distinct(), start)


@query("g30_backlinks", "SELECT 'p' || target AS page, count(DISTINCT page)::BIGINT AS n FROM (SELECT doc_id AS page, (doc_id * 7) % 50 AS target FROM documents UNION ALL SELECT doc_id, (doc_id * 3) % 50 FROM documents) WHERE page <> target GROUP BY target")
def g30(spark, d):
    link = lambda m: F.concat(F.lit("[[p"), (F.col("doc_id") * m % 50).cast("string"), F.lit("]]" if m == 7 else "|see]]"))
    pages = table(spark, d, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("page"), F.concat(F.lit("See "), link(7), F.lit(" and "), link(3)).alias("body"))
    links = pages.select("page", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)))).alias("target"))
    return links.where("page <> target").groupBy(F.col("target").alias("page")).agg(F.countDistinct("page").alias("n"))


@query(
    "g31_lint",
    "SELECT 'missing_summary' AS kind, 'warn' AS severity, count(*)::BIGINT AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 5) UNION ALL SELECT 'stale', 'info', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'broken_link', 'error', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3) UNION ALL SELECT 'orphan', 'warn', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)",
)
def g31(spark, d):
    o, line, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    n = lambda df, kind, severity: df.agg(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.count("*").alias("n"))
    missing = o.join(line.where("l_linenumber >= 5").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    broken = line.join(p.where("p_size > 3").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")
    orphan = p.join(line.where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
    return n(missing, "missing_summary", "warn").unionByName(n(o.where("o_orderstatus = 'P'"), "stale", "info")).unionByName(n(broken, "broken_link", "error")).unionByName(n(orphan, "orphan", "warn"))


@query("g17_mixture_levels")
def g17(spark, d):
    """Gaussian mixtures on four principal axes; the component count of least BIC."""
    import math

    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    x = PCA(k=4, inputCol="v", outputCol="features").fit(e).transform(e).select("vec_id", "features").cache()
    n, found = x.count(), []
    for k in (2, 4, 6):
        m = GaussianMixture(k=k, seed=7, maxIter=15).fit(x)
        found.append((-2 * m.summary.logLikelihood + (k - 1 + k * (4 + 10)) * math.log(n), k, m))
    best = min(found, key=lambda f: f[:2])
    return best[2].transform(x).select("vec_id", F.col("prediction").alias("node"), F.lit(best[1]).alias("components"))


@query("g22_topic_map")
def g22(spark, d):
    """Two principal axes, each scaled to -1 to 1."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    p = PCA(k=2, inputCol="v", outputCol="p").fit(e).transform(e).select("vec_id", vector_to_array("p").alias("p")).select("vec_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    b = p.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    scale = lambda c: F.coalesce(F.try_divide(2 * (F.col(c) - F.col(f"lo{c}")), F.col(f"hi{c}") - F.col(f"lo{c}")) - 1, F.lit(0.0)).alias(c)
    return p.join(F.broadcast(b)).select("vec_id", scale("x"), scale("y"))
