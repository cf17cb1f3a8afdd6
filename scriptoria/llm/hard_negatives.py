"""Hard-negative mining over k-means inverted lists with exact bounds.

1. Rows are cleaned and scaled to integers. Centroids are fitted on a bounded sample (at
   most SAMPLE rows, those of least key hash); every row is then put into the inverted
   list of its nearest centroid, and each list's radius and length are stored.
2. For an anchor a and a list with centroid c and radius r, Cauchy-Schwarz bounds every
   score in the list: <a, c> - |a| r <= score <= <a, c> + |a| r. Lists whose bounds lie
   outside the window asked for are skipped, the others visited by falling upper bound.
3. Visits go in two waves. The first takes the lists of the highest bounds; its k best
   scores give a kth score. The second takes every further list whose upper bound isn't
   strictly below it, so what is not visited can't hold a better row, nor an equal one.
4. The first search of an anchor finds its positives (same label, no window), the second
   its negatives (other labels, one window for each positive).

A visit is a row (list, anchor); it meets the list's rows in a cogrouped task of at most
BLOCK rows and about CHUNK anchors, so lists or vectors that a third of all rows share are
dealt over many tasks. Only the centroid table (at most LISTS rows) is broadcast.

Scores are exact: components are integers and squared norms are below 2 ** 53, so that a
float64 product of two rows has no rounding.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, and
rows whose scaled squared norm reaches 2 ** 53, take no part; of rows that repeat an id the
least by label and vector counts; an inner product runs over the components that both
vectors have, and an empty vector scores 0; equal scores are ordered by id; an anchor
without positives gives no row, nor a positive without negatives in its window; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.session import cut_lineage

LISTS, SAMPLE, BLOCK, CHUNK = 4096, 65_536, 4096, 4096
EXACT = float(1 << 53)
HIT = "anchor_id long, slot int, id long, score long"
ANCHOR = "anchor_id long, label long, home int, vec binary, slots array<int>, lows array<long>, highs array<long>"


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vector) of the rows that take part, vectors as whole doubles."""
    d = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite)
    d = d.select("id", "label", F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")).alias("v"))
    d = d.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < EXACT)
    return d.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", F.col("r.v").alias("vector"))


def fit(sample: list[list[float]], k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of the sample's vectors of the most frequent length; Lloyd's rounds from
    rows spread evenly over the sample."""
    size = Counter(map(len, sample)).most_common(1)[0][0]
    rows = [v for v in sample if len(v) == size]
    x = np.array(rows, dtype=np.float64).reshape(len(rows), size)
    c = np.unique(x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        own = nearest(x, c)[0]
        counts = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and an upper bound of the distance to it. Rows and
    centroids of different length count as filled up with zeros."""
    m = min(x.shape[1], c.shape[1])
    square, norms = (x * x).sum(axis=1), (c * c).sum(axis=1)
    own, least = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for low in range(0, len(x), 8192):
        at = slice(low, low + 8192)
        far = square[at, None] + norms[None, :] - 2 * (x[at, :m] @ c[:, :m].T)
        own[at] = far.argmin(axis=1)
        least[at] = far[np.arange(len(far)), own[at]]
    return own, np.sqrt(np.maximum(least, 0)) + 1e-6 * (np.sqrt(square) + np.sqrt(norms[own]) + 1)


def by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, flat[starts[at, None] + np.arange(n)].reshape(len(at), n)


def inverted_lists(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, label, list, dist, vec): each row in the list of its nearest centroid, vec its
    components as 32-bit integers."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, dist, vec = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows), [b""] * batch.num_rows
            for at, x in by_length(batch.column(2)):
                own[at], dist[at] = nearest(x, shared.value)
                for i, row in zip(at.tolist(), x.astype("<i4"), strict=True):
                    vec[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array(dist), pa.array(vec, type=pa.binary())], names=["id", "label", "list", "dist", "vec"])

    return vectors.select("id", "label", "vector").mapInArrow(run, "id long, label long, list int, dist double, vec binary")


class Bounds:
    """The centroid table: what any score of an anchor with a list's rows can be."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray, lengths: np.ndarray) -> None:
        self.centroids, self.radii, self.lengths = centroids, radii, lengths
        self.norms = np.sqrt((centroids * centroids).sum(axis=1))

    def of(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, size = min(len(a), self.centroids.shape[1]), float(np.sqrt((a * a).sum()))
        middle = self.centroids[:, :m] @ a[:m]
        reach = size * self.radii + 1e-6 * (1 + size * (self.norms + self.radii))
        low, high = middle - reach, middle + reach
        high[self.lengths == 0] = -np.inf
        return low, high

    def visits(self, a: np.ndarray, lows: list[int], highs: list[int], kth: list[int | None], first: int) -> tuple[list[int], list[int]]:
        """The lists to visit in the first wave and in the second. A window's first lists
        are those of the highest bounds that its limits allow; the second wave takes the
        others whose bound isn't strictly below the window's kth score."""
        least, most = self.of(a)
        one, two = np.zeros(len(most), dtype=bool), np.zeros(len(most), dtype=bool)
        for low, high, k in zip(lows, highs, kth, strict=True):
            inside = (most >= low) & (least <= high)
            open_ = np.flatnonzero(inside)
            order = open_[np.argsort(-most[open_], kind="stable")]
            one[order[:first]] = True
            two |= inside & (most >= (low if k is None else max(low, k)))
        return np.flatnonzero(one).tolist(), np.flatnonzero(two & ~one).tolist()


def _visits(anchors: DataFrame, bounds: Bounds, wave: int, first: int) -> DataFrame:
    """(list, anchor...) rows of a wave; kth is the kth score by window, null if unknown."""
    shared = anchors.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.visits(np.frombuffer(v, dtype="<i4").astype(np.float64), lo, hi, k, first)[wave] for v, lo, hi, k in zip(*(batch.column(c).to_pylist() for c in ("vec", "lows", "highs", "kth")), strict=True)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            lists = pa.array(np.array([c for x in found for c in x], dtype=np.int32))
            for low in range(0, len(at), 4096):
                part = batch.take(at.slice(low, 4096))
                yield pa.RecordBatch.from_arrays([lists.slice(low, 4096), *part.columns], names=["list", *part.schema.names])

    return anchors.mapInArrow(run, f"list int, {ANCHOR}, kth array<long>")


def _meet(same: bool, k: int):
    """A task: the k best rows of a block for each window of each visiting anchor."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        order = np.argsort(ids, kind="stable")  # then equal scores come by id
        ids, labels = ids[order], labels[order]
        vectors = [np.frombuffer(v, dtype="<i4") for v in rows.column("vec").to_pylist()]
        vectors = [vectors[i] for i in order.tolist()]
        sizes = np.array([len(v) for v in vectors])
        groups = [(at := np.flatnonzero(sizes == n), np.array([vectors[i] for i in at.tolist()], dtype=np.float64).reshape(len(at), n)) for n in np.unique(sizes).tolist()]
        for a_id, a_label, vec, slots, lows, highs, kth in zip(*(anchors.column(c).to_pylist() for c in ("anchor_id", "label", "vec", "slots", "lows", "highs", "kth")), strict=True):
            a = np.frombuffer(vec, dtype="<i4").astype(np.float64)
            score = np.zeros(len(ids))
            for at, x in groups:
                m = min(len(a), x.shape[1])
                score[at] = x[:, :m] @ a[:m]
            fits = (labels == a_label) & (ids != a_id) if same else labels != a_label
            where = np.flatnonzero(fits & (score <= max(highs)) & (score >= min(lows)))
            best = where[np.argsort(-score[where], kind="stable")]
            fallen = -score[best]
            for slot, low, high, least in zip(slots, lows, highs, kth, strict=True):
                start = int(np.searchsorted(fallen, -high, side="left"))
                for j in best[start : start + k].tolist():
                    if score[j] < low or least is not None and score[j] < least:
                        break
                    out.append((a_id, slot, int(ids[j]), int(score[j])))
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(columns[0], type=pa.int64()), pa.array(columns[1], type=pa.int32()), pa.array(columns[2], type=pa.int64()), pa.array(columns[3], type=pa.int64())], names=["anchor_id", "slot", "id", "score"])

    return run


def _wave(anchors: DataFrame, lists: DataFrame, bounds: Bounds, same: bool, k: int, wave: int, first: int, chunks: int, salt: int) -> DataFrame:
    """Hits of one wave: each list's rows in blocks meet the anchors that visit it."""
    blocks = F.array(*[F.lit(int(x)) for x in np.maximum(1, -(-bounds.lengths // BLOCK))])
    n_blocks = F.get(blocks, F.col("list"))
    chunk = F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("anchor_id"), F.lit(salt))), F.lit(chunks)).cast("int")
    visits = _visits(anchors, bounds, wave, first).withColumn("chunk", chunk).withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    visited = visits.where("block = 0").groupBy("list", "chunk").agg(F.count("*").alias("n")).select("list", "chunk")
    rows = lists.select("id", "label", "vec", "list", F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("block")).join(visited, "list")
    rows = rows.select("id", "label", "vec", *[F.col(c).alias(f"of_{c}") for c in ("list", "block", "chunk")])
    return visits.groupBy("list", "block", "chunk").cogroup(rows.groupBy("of_list", "of_block", "of_chunk")).applyInArrow(_meet(same, k), HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def search(anchors: DataFrame, lists: DataFrame, bounds: Bounds, same: bool, k: int, first: int = 3) -> DataFrame:
    """(anchor_id, slot, id, score, rank): the k best rows of each window of each anchor
    among rows of its label (same; without itself) or of other labels. anchors (ANCHOR) is
    a table that can be read again."""
    homes = anchors.groupBy("home").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    chunks, salt = max(1, -(-homes[0] // CHUNK)), max(1, -(-homes[1] // CHUNK))
    unknown = anchors.withColumn("kth", F.transform("slots", lambda _: F.lit(None).cast("long")))
    near = cut_lineage(_best(_wave(unknown, lists, bounds, same, k, 0, first, chunks, salt), k))
    full = near.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("by"))
    named = anchors.join(full, "anchor_id", "left").withColumn("kth", F.transform("slots", lambda s: F.try_element_at("by", s))).drop("by")
    columns = [c.split()[0] for c in ANCHOR.split(", ")]
    far = _wave(named.select(*columns, "kth"), lists, bounds, same, k, 1, first, chunks, salt)
    return cut_lineage(_best(near.drop("rank").unionByName(far), k))


def hard_negatives(rows: DataFrame, anchor, label=None, scale: int = 256, low: int = 80, k_pos: int = 5, k_neg: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor is a condition over `id`; label an expression over `id` and `label` that takes
    the label's place. A negative's score is at least `low` hundredths of the positive's
    and at most the positive's."""
    vectors = usable(rows, id_col, vector_col, label_col, scale)
    vectors = cut_lineage(vectors if label is None else vectors.withColumn("label", label))
    n = vectors.count()
    sample = [r.vector for r in vectors.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, 64 * LISTS)).select("vector").collect()] or [[]]
    centroids = fit(sample, max(1, min(LISTS, round(n**0.5), len(sample) // 8)))
    lists = cut_lineage(inverted_lists(vectors, centroids))
    radii, lengths = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=np.int64)
    for r in lists.groupBy("list").agg(F.max("dist").alias("r"), F.count("*").alias("n")).collect():
        radii[r.list], lengths[r.list] = r.r, r.n
    bounds = Bounds(centroids, radii, lengths)

    chosen = lists.where(anchor).select(F.col("id").alias("anchor_id"), "label", F.col("list").alias("home"), "vec")
    far = F.lit(1 << 62)
    every = cut_lineage(chosen.withColumns({"slots": F.array(F.lit(0)), "lows": F.array(-far), "highs": F.array(far)}))
    positives = search(every, lists, bounds, True, k_pos).select("anchor_id", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = positives.where("positive_score >= 0").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))
    slots, highs = F.transform("p", lambda x: x["slot"]), F.transform("p", lambda x: x["positive_score"])
    lows = F.expr(f"transform(p, x -> ({int(low)} * x.positive_score + 99) div 100)")
    asked = every.drop("slots", "lows", "highs").join(windows, "anchor_id").select("anchor_id", "label", "home", "vec", slots.alias("slots"), lows.alias("lows"), highs.alias("highs"))
    negatives = search(cut_lineage(asked), lists, bounds, False, k_neg)
    found = negatives.join(positives, ["anchor_id", "slot"])
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle_select() -> str:
    """The contract's mining in SQL: every anchor against every row."""
    return """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5"""
