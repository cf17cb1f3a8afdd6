"""Approximate nearest neighbours: an inverted-file index as Parquet, int8 codes, exact rescoring.

write_index normalises the vectors, fits centroids on a bounded sample and writes two
tables partitioned by list (a vector's nearest centroid):

    codes    list, id, code (int8 components), payload columns
    vectors  list, id, vector (unit float64 components)

A code's step is the 0.99 quantile of the absolute components over 127; what lies beyond is
clipped. How many lists a query must probe is measured while the index is written: TRIED
rows of the sample are searched exactly over all rows, and the index keeps the least number
of probes that reaches the recall asked for. A search scores the codes of each query's
`probes` best lists and rescores the best oversample * k of them with their vectors. Only
folders of probed lists are read.

Queries of near lists form chunks and rows of neighbouring lists form blocks. Each chunk meets
each block that holds a list of its queries in one task, so a query moves once for a block,
not once for a list, and a task keeps its best rows over all lists of the block.

Ids are bigints. Vectors that are null, empty, not finite, without a norm or of another
length than most of the sample are not indexed, and no query can find them; such queries
find nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.operators.vectors import knn_join, norm
from scriptoria.session import cut_lineage

#: The sample that centroids are fitted on, the most lists, and the rows and queries that a task
#: meets at once.
SAMPLE, LISTS, BLOCK, CHUNK = 65_536, 4096, 32_768, 16_384
#: Rows of the sample that are scored against all centroids at once.
PORTION = 1024
#: Queries that the number of probes is measured with.
TRIED = 256


def unit(vectors: DataFrame) -> DataFrame:
    """vectors (id, vector, ...) with unit vectors; those that have none are left out."""
    v = F.col("vector").cast("array<double>")
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = vectors.withColumns({"id": F.col("id").cast("long"), "vector": v}).where(F.col("id").isNotNull() & usable)
    d = d.withColumn("_n", norm(F.col("vector"))).where("_n > 0")
    return d.withColumn("vector", F.transform("vector", lambda x: x / F.col("_n"))).drop("_n")


def fit_centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k unit centroids by Lloyd's rounds on cosine; an empty list takes the row that its own
    centroid serves worst."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own, best = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for i in range(0, len(x), PORTION):  # never the scores of all rows at once
            score = x[i : i + PORTION] @ c.T
            own[i : i + PORTION] = score.argmax(axis=1)
            best[i : i + PORTION] = score.max(axis=1)
        worst = np.argsort(best, kind="stable")
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        sums[empty] = x[worst[: len(empty)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


@dataclass(frozen=True)
class Index:
    """A written index: its tables, centroids, rows by list, the codes' step and the probes
    that its recall needs."""

    codes: DataFrame
    vectors: DataFrame
    centroids: np.ndarray = field(repr=False)
    sizes: np.ndarray = field(repr=False)
    step: float
    probes: int

    def search(self, queries: DataFrame, k: int, probes: int | None = None, oversample: int = 4, where: Column | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k best of the probed lists for each row of
        queries (id, vector) by cosine, ties by id, without the query's own id. `where` is a
        condition over the payload; as it thins out the lists, twice the probes are made."""
        probes = probes or self.probes * (1 if where is None else 2)
        asked = cut_lineage(self._visits(unit(queries.select("id", "vector")), probes))
        # at most LISTS numbers, to deal out chunks by
        n = {r.first: r.n for r in asked.groupBy(F.col("lists")[0].alias("first")).agg(F.count("*").alias("n")).collect()}
        asked = asked.withColumn("chunk", _dealt(F.col("lists")[0], F.col("query_id"), np.array([n.get(i, 0) for i in range(len(self.sizes))]), CHUNK))
        probed = cut_lineage(asked.select("chunk", F.explode("lists").alias("l")).distinct())
        # at most LISTS numbers, so that only their folders are read
        own = [r.l for r in probed.select("l").distinct().collect()]
        here = F.col("list").isin(*own) if own else F.lit(False)
        codes, held = self.codes.where(here), self.vectors.where(here)
        codes = codes if where is None else codes.where(where)
        block = _dealt(F.col("list"), F.col("id"), self.sizes, BLOCK)
        rows = codes.select("list", "id", "code", block.alias("block")).join(probed, F.col("list") == F.col("l")).select("chunk", "block", "list", "id", "code")
        ends = np.cumsum(self.sizes)
        blocks = lambda i: F.get(F.array(*[F.lit(int(x)) for x in i]), F.col("l"))
        spans = F.explode(F.sequence(blocks((ends - self.sizes) // BLOCK), blocks(np.maximum(ends - self.sizes, ends - 1) // BLOCK)))
        met = probed.withColumn("block", spans).select("chunk", "block").distinct()
        near = asked.join(met, "chunk").groupBy("chunk", "block").cogroup(rows.groupBy("chunk", "block")).applyInArrow(_coded(k * oversample, self.step, len(self.sizes)), "chunk int, block int, query_id long, id long, code_score double")
        rank = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        best = near.withColumn("r", rank(F.desc("code_score"), "id")).where(F.col("r") <= k * oversample)
        best = best.groupBy("query_id", "chunk", "block").agg(F.collect_list("id").alias("ids")).join(asked.select("query_id", "vector"), "query_id")
        full = held.select("list", "id", "vector", block.alias("block")).join(probed, F.col("list") == F.col("l")).select("chunk", "block", "id", "vector")
        scored = best.groupBy("chunk", "block").cogroup(full.groupBy("chunk", "block")).applyInArrow(_rescored, "query_id long, id long, score double")
        return scored.withColumn("rank", rank(F.desc("score"), "id")).where(F.col("rank") <= k)

    def _visits(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, vector, lists): the lists nearest to each query, nearest first; a query's
        id once."""
        shared = queries.sparkSession.sparkContext.broadcast(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for batch in batches:
                fits = np.flatnonzero(batch.column(1).value_lengths().to_numpy(zero_copy_only=False) == c.shape[1])
                part = batch.take(pa.array(fits))
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
                lists = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
                ends = np.arange(len(x) + 1, dtype=np.int32) * lists.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.ravel().astype(np.int32)))], names=["query_id", "vector", "lists"])

        return queries.dropDuplicates(["id"]).mapInArrow(run, "query_id long, vector array<double>, lists array<int>")


def _dealt(of: Column, key: Column, sizes: np.ndarray, most: int) -> Column:
    """Which run of about `most` rows a row lies in, of rows in the order of their lists
    (of), given the rows of each list; within a list rows are dealt out by their key."""
    begin = F.get(F.array(*[F.lit(int(x)) for x in np.cumsum(sizes) - sizes]), of)
    size = F.get(F.array(*[F.lit(int(max(1, x))) for x in sizes]), of)
    return F.floor((begin + F.pmod(F.xxhash64(key), size)) / most).cast("int")


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _coded(k: int, step: float, n_lists: int):
    """A task: the k best codes of a block among each query's lists."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(rows) and len(queries):
            ids = rows.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, of = ids[order], rows.column("list").to_numpy()[order]
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.int8).reshape(len(ids), -1)[order].astype(np.float32)
            asked, vectors, lists = queries.column("query_id").to_numpy(), _matrix(queries.column("vector")).astype(np.float32), _matrix(queries.column("lists"))
            # queries of near lists together, so that they share the rows they skip
            near = np.lexsort((asked, lists[:, 0]))
            asked, vectors, lists = asked[near], vectors[near], lists[near]
            for low in range(0, len(asked), 128):
                part = lists[low : low + 128]
                probed = np.zeros((len(part), n_lists), dtype=bool)
                np.put_along_axis(probed, part, True, axis=1)
                at = np.flatnonzero(probed.any(axis=0)[of])
                score = (vectors[low : low + 128] @ codes[at].T) * np.float32(step)
                score[~probed[:, of[at]] | (asked[low : low + 128, None] == ids[at])] = -np.inf
                best = score > -np.inf
                if len(at) > k:
                    best &= score >= np.partition(score, len(at) - k, axis=1)[:, len(at) - k, None]
                q, r = np.nonzero(best)
                value = score[q, r]
                order = np.lexsort((r, -value, q))  # by id where codes are equal
                q, r, value = q[order], r[order], value[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k
                out.append((asked[low + q[first]], ids[at[r[first]]], value[first].astype(np.float64)))
        found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
        group = [np.full(len(found[0]), queries.column(c)[0].as_py() if len(queries) else 0, dtype=np.int32) for c in ("chunk", "block")]
        return pa.table([pa.array(c) for c in (*group, *found)], names=["chunk", "block", "query_id", "id", "code_score"])

    return run


def _rescored(best: pa.Table, rows: pa.Table) -> pa.Table:
    """A task: the scores of a block's best codes by their vectors."""
    asked, ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    if len(best) and len(rows):
        known = rows.column("id").to_numpy()
        order = np.argsort(known, kind="stable")
        known, vectors, queries = known[order], _matrix(rows.column("vector"))[order], _matrix(best.column("vector"))
        found = best.column("ids").combine_chunks()
        ids = found.flatten().to_numpy()
        q = np.repeat(np.arange(len(best)), found.value_lengths().to_numpy())
        asked, scores = best.column("query_id").to_numpy()[q], np.zeros(len(ids))
        row = np.searchsorted(known, ids)
        for low in range(0, len(ids), 8192):
            here = slice(low, low + 8192)
            scores[here] = (queries[q[here]] * vectors[row[here]]).sum(axis=1)
    return pa.table([pa.array(asked), pa.array(ids), pa.array(scores)], names=["query_id", "id", "score"])


def probes_for(rows: DataFrame, queries: list[tuple[int, list[float]]], centroids: np.ndarray, recall: float, k: int) -> int:
    """The least number of probes that finds `recall` of the exact k nearest of the queries
    among rows (id, list, vector)."""
    if not queries:
        return 1
    asked = rows.sparkSession.createDataFrame(queries, "id long, vector array<double>")
    found = knn_join(asked, rows.select("id", "vector"), k).join(rows.select("id", "list"), "id").select("query_id", "list").collect()
    if not found:
        return 1
    order = np.argsort(-(np.array([v for _, v in queries]) @ centroids.T), axis=1, kind="stable")
    place = {i: {int(c): n for n, c in enumerate(row)} for (i, _), row in zip(queries, order, strict=True)}
    needed = np.sort([place[r.query_id][r.list] for r in found])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def _sample(d: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most SAMPLE of the n rows (id, vector), by their ids' hashes, of the
    length that most of them have; without rows no ids and one zero vector. Tasks send rows
    of low hashes alone, as Arrow columns."""
    span = 1 << 30
    drawn = d.select("id", "vector", F.xxhash64("id").alias("h")).where(F.pmod("h", F.lit(span)) <= int(span * min(1.0, 1.1 * SAMPLE / max(1, n))))
    rows = drawn.limit(2 * SAMPLE).toArrow()
    ids, h = rows.column("id").to_numpy(), rows.column("h").to_numpy()
    vectors = rows.column("vector").combine_chunks()
    order = np.lexsort((ids, h))[:SAMPLE]
    lengths = vectors.value_lengths().to_numpy()[order]
    size = Counter(lengths.tolist()).most_common(1)[0][0] if len(order) else 1
    order = order[lengths == size]
    if not len(order):
        return np.zeros(0, dtype=np.int64), np.zeros((1, 1))
    return ids[order], vectors.take(pa.array(order)).flatten().to_numpy().reshape(-1, size)


def write_index(vectors: DataFrame, path: str, lists: int | None = None, list_rows: int = 5_000_000, recall: float = 0.95, recall_at: int = 10) -> Index:
    """Indexes vectors (id, vector, payload columns) below path. lists: by default four
    times the root of the rows, at most LISTS; a list of over list_rows rows is written by
    several tasks."""
    spark, payload = vectors.sparkSession, [c for c in vectors.columns if c not in ("id", "vector")]
    d = cut_lineage(unit(vectors))
    n = d.count()
    ids, x = _sample(d, n)
    size = x.shape[1]
    d = d.where(F.size("vector") == size)
    k = max(1, min(lists or round(4 * n**0.5), LISTS, len(x) // 8 or 1))
    centroids = fit_centroids(x, k)
    quantile = d.select(F.explode("vector").alias("x")).select(F.percentile_approx(F.abs("x"), 0.99, 10_000).alias("q")).first().q
    step = (quantile or 1.0) / 127
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("vector")
            m = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            own = (m @ shared.value.T).argmax(axis=1).astype(np.int32)
            codes = np.clip(np.rint(m / step), -127, 127).astype(np.int8)
            columns = [pa.array(own), pa.array([c.tobytes() for c in codes], type=pa.binary()), *batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "code", *batch.schema.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    coded = cut_lineage(d.mapInArrow(run, f"list int, code binary, {kinds}"))
    dealt = coded.repartition("list", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-coded.count() // (k * list_rows))))))
    dealt.select("list", "id", "code", *payload).sortWithinPartitions("list", "id").write.mode("overwrite").partitionBy("list").parquet(f"{path}/codes")
    dealt.select("list", "id", "vector").sortWithinPartitions("list", "id").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    counts = {r.list: r.n for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}
    probes = probes_for(coded, list(zip(ids[:TRIED].tolist(), x[:TRIED].tolist(), strict=False)), centroids, recall, recall_at)
    meta = [(i, centroids[i].tolist(), counts.get(i, 0), float(step), probes) for i in range(k)]
    spark.createDataFrame(meta, "list int, centroid array<double>, n long, step double, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that write_index wrote. Its list table has at most LISTS rows."""
    rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()

    def read(name: str, first: str) -> DataFrame:
        found = spark.read.option("mergeSchema", "false")
        try:
            return found.parquet(f"{path}/{name}")
        except Exception as e:  # an index of no rows has no file to tell the schema
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return spark.createDataFrame([], f"id long, {first}, list int")

    return Index(read("codes", "code binary"), read("vectors", "vector array<double>"), np.array([r.centroid for r in rows], dtype=np.float64), np.array([r.n for r in rows], dtype=np.int64), rows[0].step, rows[0].probes)
