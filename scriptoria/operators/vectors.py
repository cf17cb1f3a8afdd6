"""Dense, sparse and multi-vector arithmetic as JVM-side column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def literal_vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def knn(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k rows nearest to the query by cosine, ties by id: filter, score, top-k heap."""
    q = math.sqrt(sum(x * x for x in query)) or 1.0
    rows = vectors if where is None else vectors.where(where)
    v = F.col(vector_col)
    scored = rows.select(id_col, F.coalesce(F.try_divide(dot(v, literal_vector(query)), norm(v) * q), F.lit(0.0)).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int = 2000) -> DataFrame:
    """The k nearest vectors (id, vector) of each row of queries (id, vector), without the
    query's own id: (query_id, id, score, rank), ties by id. Ids are bigints; null ids are
    left out, vectors that are null, of another length or without a norm score 0.

    Every query meets every vector. The queries are broadcast in blocks of about
    `block_rows`, each one scan over the vectors; a task keeps the k best of its own rows
    for a query, so no row is made for a pair and a query moves at most k rows from a task."""
    cast = lambda df: df.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).where("id is not null")
    q, v = cast(queries), cast(vectors)
    n_blocks = max(1, -(-q.count() // block_rows))
    blocks = [_nearest(v, q.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block), k) for block in range(n_blocks)]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return reduce(DataFrame.unionByName, blocks).withColumn("rank", rank).where(F.col("rank") <= k)


def _nearest(vectors: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) of the k nearest rows of each task."""
    rows = block.orderBy("id").collect()
    shared = vectors.sparkSession.sparkContext.broadcast([(r.id, np.array(r.vector or [], dtype=np.float64)) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(i, x, math.sqrt((x * x).sum())) for i, x in shared.value]
        best = [(np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in queries]
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            matrices: dict[int, tuple] = {}
            for n, (query_id, x, size) in enumerate(queries):
                if len(x) not in matrices:
                    at = np.flatnonzero(lengths == len(x))
                    m = flat[starts[at, None] + np.arange(len(x))] if len(x) else np.zeros((len(at), 0))
                    matrices[len(x)] = at, m, np.sqrt((m * m).sum(axis=1))
                at, m, norms = matrices[len(x)]
                score = np.zeros(len(ids))
                # a sum for each row alone, so equal vectors have equal scores
                score[at] = np.nan_to_num(np.divide((m * x).sum(axis=1), norms * size, out=np.zeros(len(at)), where=norms * size > 0))
                held_scores, held_ids = best[n]
                keep = ids != query_id
                if keep.sum() > k:
                    keep &= score >= np.partition(score[keep], -k)[-k]
                s, i = np.concatenate([held_scores, score[keep]]), np.concatenate([held_ids, ids[keep]])
                order = np.lexsort((i, -s))[:k]
                best[n] = s[order], i[order]
        counts = [len(i) for _, i in best]
        columns = [np.repeat(np.array([i for i, _, _ in queries], dtype=np.int64), counts), np.concatenate([np.zeros(0, dtype=np.int64), *[i for _, i in best]]), np.concatenate([np.zeros(0), *[s for s, _ in best]])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "score"])

    return vectors.mapInArrow(run, "query_id long, id long, score double")


def sparse_dot(postings: DataFrame, query: dict[str, float]) -> DataFrame:
    """(id, score) from postings (id, token, weight): a join on the query's tokens."""
    q = postings.sparkSession.createDataFrame(sorted(query.items()), "token string, q double")
    return postings.join(F.broadcast(q), "token").groupBy("id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))


def max_sim(query: list[list[float]], doc: Column) -> Column:
    """Late interaction: for each query vector the best document vector, summed."""
    best = [_best(row, doc) for row in query]
    total = F.lit(0.0)
    for b in best:
        total = total + b
    return total


def _best(row: list[float], doc: Column) -> Column:
    q = literal_vector(row)
    return F.array_max(F.transform(doc, lambda v: dot(v, q)))


def centroid(vectors: DataFrame, vector_col: str, keys: list[str] | None = None) -> DataFrame:
    """Mean vector (of each group): partial sums per dimension, never whole vectors."""
    keys = keys or []
    parts = vectors.select(*keys, F.posexplode(vector_col).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return parts.groupBy(*keys).agg(ordered.alias("centroid"))


def biased(base: Column, positive: Column, negative: Column, weight: float = 0.25) -> Column:
    """base + weight * positive - weight * negative; a null side counts as zero."""
    add = lambda a, b, w: F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + w * y))
    return add(add(base, positive, weight), negative, -weight)
