"""Retrieval queries. The query vector is that of vec_id 0; texts are `documents`."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.operators import retrieval as ops
from scriptoria.operators import vectors as vec
from scriptoria.plans.registry import query
from scriptoria.plans.views import citations
from scriptoria.session import checkpoint_folder, table, version_of

DIMENSIONS = 64
_SQL_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


_vectors: dict[tuple, list[list[float]]] = {}


def _query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return _query_vectors(spark, d, [vec_id])[0]


def _query_vectors(spark: SparkSession, d: str, vec_ids: list[int]) -> list[list[float]]:
    """The vectors of these ids, all in one read. A query's vector comes from outside in
    use, so what was read once for a state of the table is kept."""
    source = f"{d}/embeddings.parquet"
    key = (spark.sparkContext.applicationId, source, version_of(spark, source), *vec_ids)
    if key in _vectors:
        return _vectors[key]
    rows = table(spark, d, "embeddings").where(F.col("vec_id").isin(*vec_ids)).select("vec_id", "embedding").collect()
    found = {r.vec_id: [float(x) for x in r.embedding] for r in rows}
    _vectors[key] = [found.get(i, [0.0] * DIMENSIONS) for i in vec_ids]
    return _vectors[key]


_indexes: dict[tuple[str, str, str], ops.Postings] = {}


def _postings(spark: SparkSession, d: str, wanted: list[str]) -> DataFrame:
    """Postings of these tokens from the inverted index of `documents`, which is written
    once for each session and state of the table."""
    source = f"{d}/documents.parquet"
    key = (spark.sparkContext.applicationId, source, version_of(spark, source))
    if key not in _indexes:
        path = f"{checkpoint_folder(spark)}/postings-{key[2]}"
        _indexes[key] = ops.write_postings(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", path)
    return _indexes[key].of(wanted)


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vec.knn(e, "id", "embedding", _query_vector(spark, d), k)


DENSE_SQL = f"dense AS (SELECT b.vec_id AS id, {_SQL_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY score DESC, id LIMIT 50)"


@query("r2_dense_knn", f"WITH {DENSE_SQL} SELECT id, round(score, 6) AS score FROM dense")
def r2(spark, d):
    return _dense(spark, d, 50).select("id", F.round("score", 6).alias("score"))


@query("p6_filtered_knn", f"SELECT b.vec_id AS id, round({_SQL_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.label IN (1, 2) ORDER BY {_SQL_COS} DESC, id LIMIT 20")
def p6(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return vec.knn(e, "id", "embedding", _query_vector(spark, d), 20, F.col("label").isin(1, 2)).select("id", F.round("score", 6).alias("score"))


SPARSE_QUERY = {"the": 0.5, "of": 0.25, "que": 1.0, "der": 1.5}
_VALUES = ", ".join(f"('{t}', {w})" for t, w in SPARSE_QUERY.items())
TOKENS_SQL = "tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM documents)"
SPARSE_SQL = f"{TOKENS_SQL}, q(t, w) AS (VALUES {_VALUES}), sparse AS (SELECT doc_id AS id, sum(n * w)::DOUBLE AS score FROM (SELECT doc_id, t, count(*) AS n FROM tok WHERE t IN (SELECT t FROM q) GROUP BY ALL) JOIN q USING (t) GROUP BY doc_id)"


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    return vec.sparse_dot(_postings(spark, d, sorted(SPARSE_QUERY)), SPARSE_QUERY)


@query("r3_sparse_search", f"WITH {SPARSE_SQL} SELECT id, round(score, 4) AS score FROM sparse ORDER BY sparse.score DESC, id LIMIT 50")
def r3(spark, d):
    return _sparse(spark, d).orderBy(F.desc("score"), "id").limit(50).select("id", F.round("score", 4).alias("score"))


@query("r4_full_text")
def r4(spark, d):
    return ops.indexed_full_text(_postings(spark, d, ["the", "of", "and"]), "the of and", 50)


FUSED_SQL = f"""{DENSE_SQL}, {SPARSE_SQL}, s50 AS (SELECT id, score FROM sparse ORDER BY score DESC, id LIMIT 50),
d AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM dense), s AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s50),
fused AS (SELECT id, sum(w)::DOUBLE AS score FROM (SELECT id, 1.0::DOUBLE / (60 + r) AS w FROM d UNION ALL SELECT id, 0.5::DOUBLE / (60 + r) FROM s) GROUP BY id)"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    sparse = _sparse(spark, d).select(F.lit("sparse").alias("leg"), "id", "score")
    dense = _dense(spark, d, 50).select(F.lit("dense").alias("leg"), "id", "score")
    return ops.fused_legs(dense.union(sparse), {"dense": 1.0, "sparse": 0.5})


@query("r7_weighted_fusion", f"WITH {FUSED_SQL} SELECT id, round(score, 8) AS score FROM fused")
def r7(spark, d):
    return _fused(spark, d).select("id", F.round("score", 8).alias("score"))


@query(
    "r8_nine_signal_fusion",
    "WITH s AS (SELECT p_partkey AS id, p_size, p_retailprice, length(p_name) AS l FROM part), r AS ("
    + " UNION ALL ".join(f"SELECT id, row_number() OVER (ORDER BY (id * {m} + p_size * {n}) % 9973 DESC, id) AS r FROM s" for m, n in ((3, 1), (5, 2), (7, 3), (11, 5), (13, 7), (17, 11), (19, 13), (23, 17), (29, 19)))
    + ") SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM r GROUP BY id",
)
def r8(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    signals = F.array(*[(F.col("id") * m + F.col("p_size") * n) % 9973 for m, n in ((3, 1), (5, 2), (7, 3), (11, 5), (13, 7), (17, 11), (19, 13), (23, 17), (29, 19))])
    return ops.fuse([ops.signal_ranks(p.select("id", F.posexplode(signals).alias("signal", "score")))]).select("id", F.round("score", 8).alias("score"))


@query(
    "r9_hydrate",
    f"WITH {FUSED_SQL} SELECT f.id, source, substr(text, 1, 80) AS preview FROM fused f JOIN documents ON doc_id = f.id WHERE source <> 'src5'",
)
def r9(spark, d):
    docs = table(spark, d, "documents").where("source <> 'src5'").select(F.col("doc_id").alias("id"), "source", F.substring("text", 1, 80).alias("preview"))
    return docs.join(F.broadcast(_fused(spark, d).select("id")), "id")


CITED_SQL = "cited AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1)"


@query("r10_citation_boost", f"WITH {FUSED_SQL}, {CITED_SQL} SELECT f.id, round(score * (1 + 0.1 * log2(1 + coalesce(n, 0))), 8) AS score FROM fused f LEFT JOIN cited c ON f.id = c.id")
def r10(spark, d):
    fused = ops.held(_fused(spark, d))
    n = ops.counts_of(fused, citations(spark, d).select(F.col("cited").alias("id")))
    return ops.count_boost(fused, n, 0.1).select("id", F.round("score", 8).alias("score"))


@query(
    "r11_useful_boost",
    f"WITH {FUSED_SQL}, u AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT f.id, round(score * (1 + 0.15 * log2(1 + coalesce(n, 0))), 8) AS score FROM fused f LEFT JOIN u ON f.id = u.id",
)
def r11(spark, d):
    n = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg(F.countDistinct("l_orderkey").alias("n"))
    return ops.count_boost(_fused(spark, d), n, 0.15).select("id", F.round("score", 8).alias("score"))


@query(
    "r12_paper_type_weight",
    f"WITH {FUSED_SQL} SELECT id, round(score * CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.8 END, 8) AS score FROM fused",
)
def r12(spark, d):
    kind = F.when(F.col("id") % 4 == 0, "thesis").when(F.col("id") % 4 == 1, "policy").when(F.col("id") % 4 == 2, "opinion")
    return ops.type_weight(_fused(spark, d).withColumn("kind", kind), "kind").select("id", F.round("score", 8).alias("score"))


@query(
    "r13_cocitation_boost",
    f"WITH {FUSED_SQL}, e AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem), top AS (SELECT id AS anchor FROM fused ORDER BY score DESC, id LIMIT 20), b AS (SELECT anchor, cited AS id FROM e JOIN top ON citing = anchor UNION ALL SELECT anchor, citing FROM e JOIN top ON cited = anchor), n AS (SELECT id, count(DISTINCT anchor) AS n FROM b WHERE anchor <> id GROUP BY id HAVING count(DISTINCT anchor) >= 2) SELECT f.id, round(score * (1 + 0.1 * log2(1 + coalesce(n, 0))), 8) AS score FROM fused f LEFT JOIN n ON f.id = n.id",
)
def r13(spark, d):
    return ops.cocitation_boost(ops.held(_fused(spark, d)), citations(spark, d), 0.1).select("id", F.round("score", 8).alias("score"))


@query("r14_hybrid_search")
def r14(spark, d):
    """The flagship: three legs, fusion, hydration, two boosts, top 50."""
    docs = table(spark, d, "documents")
    postings = _postings(spark, d, sorted({*SPARSE_QUERY, "the", "of", "and"}))
    dense = _dense(spark, d, 50).select(F.lit("dense").alias("leg"), "id", "score")
    legs = dense.union(ops.text_legs(postings, SPARSE_QUERY, "the of and"))
    fused = ops.held(ops.fused_legs(legs, {"dense": 1.0, "sparse": 1.0, "lexical": 0.5}))
    edges = citations(spark, d)
    boosted = ops.held(ops.count_boost(fused, ops.counts_of(fused, edges.select(F.col("cited").alias("id"))), 0.1))
    boosted = ops.cocitation_boost(boosted, edges, 0.1)
    # the list is at most a few hundred ids: as a literal they prune the scan that reads texts
    own = [r.id for r in fused.select("id").collect()]
    shown = docs.where(F.col("doc_id").isin(*own) if own else F.lit(False)).select(F.col("doc_id").alias("id"), "source", "lang", F.substring("text", 1, 120).alias("preview"))
    return shown.join(F.broadcast(boosted), "id").select("id", F.round("score", 8).alias("score"), "source", "lang", "preview").orderBy(F.desc("score"), "id").limit(50)


@query("r16_rerank", f"WITH {FUSED_SQL} SELECT f.id, round((n_chars % 97) / 97.0, 6) AS score FROM fused f JOIN documents ON doc_id = f.id ORDER BY round((n_chars % 97) / 97.0, 6) DESC, f.id LIMIT 10")
def r16(spark, d):
    """The scorer is injected; here one that any engine can compute."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.round((F.col("n_chars") % 97) / 97.0, 6).alias("score"))
    return docs.join(_fused(spark, d).select("id"), "id").orderBy(F.desc("score"), "id").limit(10)


@query(
    "r17_late_interaction",
    "WITH g AS (SELECT vec_id // 4 AS doc, embedding FROM embeddings), q AS (SELECT vec_id AS qi, embedding AS qe FROM embeddings WHERE vec_id < 3), m AS (SELECT doc, qi, max(list_dot_product(embedding::DOUBLE[], qe::DOUBLE[])) AS s FROM g, q GROUP BY ALL) SELECT doc, round(sum(s), 6) AS score FROM m GROUP BY doc",
)
def r17(spark, d):
    e = table(spark, d, "embeddings")
    g = e.groupBy(F.floor(F.col("vec_id") / 4).alias("doc")).agg(F.collect_list("embedding").alias("vectors"))
    return g.select("doc", F.round(vec.max_sim(_query_vectors(spark, d, [0, 1, 2]), F.col("vectors")), 6).alias("score"))


@query(
    "r20_context_packing",
    f"WITH {FUSED_SQL}, r AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 10) DESC, doc_id) AS number, sum(length(text)) OVER (ORDER BY round(score, 10) DESC, doc_id) AS used FROM documents JOIN fused ON id = doc_id) SELECT number, doc_id FROM r WHERE used <= 24000",
)
def r20(spark, d):
    results = table(spark, d, "documents").join(F.broadcast(_fused(spark, d)), F.col("doc_id") == F.col("id"))
    return ops.pack_context(results, [F.desc(F.round("score", 10)), F.asc("doc_id")], "text").select(F.col("number").cast("long").alias("number"), "doc_id")


@query("r21_similar_papers", f"SELECT b.vec_id AS id, round({_SQL_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7 ORDER BY {_SQL_COS} DESC, id LIMIT 10")
def r21(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vec.knn(e, "id", "embedding", _query_vector(spark, d, 7), 10, F.col("id") != 7).select("id", F.round("score", 6).alias("score"))


@query(
    "r21_knn_join",
    f"SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SQL_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id < 10 AND a.vec_id <> b.vec_id QUALIFY rank <= 5",
)
def r21_join(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vec.knn_join(e.where("id < 10"), e, 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(
    "r21_knn_join_all",
    f"SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SQL_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 5",
)
def r21_join_all(spark, d):
    """The search join over every fiftieth row, so the queries grow with the table."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vec.knn_join(e.where("id % 50 = 0"), e, 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(
    "r22_ego_radial",
    f"WITH {DENSE_SQL}, t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r, count(*) OVER () AS n FROM dense) SELECT id, round((0.25 + 0.65 * (1 - score)) * cos(2 * pi() * (r - 1) / n), 5) AS x, round((0.25 + 0.65 * (1 - score)) * sin(2 * pi() * (r - 1) / n), 5) AS y FROM t",
)
def r22(spark, d):
    e = _dense(spark, d, 50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return ops.ego_radial(e).select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(
    "r25_visual_ranker",
    "SELECT p_partkey AS id, round(0.40 * (p_size / 50.0) + 0.35 * ((p_partkey % 10) / 10.0) + 0.20 * (p_partkey % 3 = 0)::INT + 0.05 * CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 5 IN (0, 1, 2))::INT ELSE 0.5 END, 6) AS score FROM part",
)
def r25(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("chart", "table", "figure", "equation", "code"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    section = F.when(F.col("p_partkey") % 2 == 0, "results").otherwise("unmapped")
    s = ops.visual_score(F.col("p_size") / 50.0, (F.col("p_partkey") % 10) / 10.0, F.col("p_partkey") % 3 == 0, kind, section)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(s, 6).alias("score"))


@query(
    "a21_centroid",
    "SELECT label, i::INT AS i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL",
)
def a21(spark, d):
    c = vec.centroid(table(spark, d, "embeddings"), "embedding", ["label"])
    return c.select("label", F.posexplode("centroid").alias("i", "m")).select("label", "i", F.round("m", 6).alias("mean"))


@functools.cache
def _mean_sql(where: str) -> str:
    return f"(SELECT list(m ORDER BY i) FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE {where}) GROUP BY i))"


@query("r26_relevance_to_anchor", f"WITH a AS (SELECT {_mean_sql('label = 1')} AS c) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(c, c)), 6) AS score FROM embeddings, a")
def r26(spark, d):
    e = table(spark, d, "embeddings")
    c = vec.centroid(e.where("label = 1"), "embedding")
    return e.join(F.broadcast(c)).select("vec_id", F.round(vec.cosine(F.col("embedding"), F.col("centroid")), 6).alias("score"))


@query(
    "r27_feedback_anchor",
    f"WITH x AS (SELECT {_mean_sql('label = 0')} AS b, {_mean_sql('label = 1')} AS p, {_mean_sql('label = 2')} AS n) SELECT i::INT AS i, round(b[i + 1] + 0.25 * p[i + 1] - 0.25 * n[i + 1], 6) AS x FROM (SELECT b, p, n, unnest(range(len(b))) AS i FROM x)",
)
def r27(spark, d):
    e = table(spark, d, "embeddings")
    c = lambda label, name: vec.centroid(e.where(F.col("label") == label), "embedding").select(F.col("centroid").alias(name))
    one = c(0, "b").join(c(1, "p"), how="left").join(c(2, "n"), how="left")
    return one.select(F.posexplode(vec.biased(F.col("b"), F.col("p"), F.col("n"))).alias("i", "x")).select("i", F.round("x", 6).alias("x"))


@query(
    "r29_subtopic_coverage",
    "WITH q AS (SELECT vec_id AS topic, embedding AS qe FROM embeddings WHERE vec_id < 8), s AS (SELECT topic, label, max(list_dot_product(embedding::DOUBLE[], qe::DOUBLE[])) AS m FROM embeddings, q WHERE vec_id >= 8 GROUP BY ALL) SELECT topic, count(*) FILTER (WHERE m >= 0.15)::BIGINT AS above, count(*) FILTER (WHERE m >= 0.15) >= 3 AS covered FROM s GROUP BY topic",
)
def r29(spark, d):
    e = table(spark, d, "embeddings").where("vec_id >= 8")
    q = spark.createDataFrame(list(enumerate(_query_vectors(spark, d, list(range(8))))), "topic long, q array<double>")
    s = e.join(F.broadcast(q)).groupBy("topic", "label").agg(F.max(vec.dot(F.col("embedding"), F.col("q"))).alias("m"))
    g = s.groupBy("topic").agg(F.count_if(F.col("m") >= 0.15).alias("above"))
    return g.select("topic", "above", (F.col("above") >= 3).alias("covered"))


@query(
    "r31_lesson_retrieval",
    "SELECT c_custkey AS id, round((c_custkey % 10) / 10.0 * 2 ** (-(c_custkey % 90) / 30.0) * (CASE WHEN c_custkey % 4 = 0 THEN 0.5 ELSE (c_custkey % 100) / 100.0 END + 0.1) * CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 ELSE 0.7 END, 8) AS score FROM customer ORDER BY score DESC, id LIMIT 50",
)
def r31(spark, d):
    k = F.col("c_custkey")
    scope = F.when(k % 3 == 0, "own").when(k % 3 == 1, "global").otherwise("other")
    s = ops.lesson_score((k % 10) / 10.0, (k % 90).cast("double"), F.when(k % 4 != 0, (k % 100) / 100.0), scope)
    return table(spark, d, "customer").select(k.alias("id"), F.round(s, 8).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query("t5_mmr")
def t5(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("score"), F.split("p_type", " ").alias("concepts"))
    return ops.mmr(p, 10)


@query("r1_sanitise")
def r1(spark, d):
    """SQL has no look-behind; the branches are tested on literal fixtures."""
    c = table(spark, d, "conversations").select("conv_id", "turn", ops.sanitised(F.col("text")).alias("s"))
    return c.select("conv_id", "turn", "s.method", "s.clean")
