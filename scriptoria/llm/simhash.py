"""SimHash near-dedup by the generalised pigeonhole principle.

1. One pass fingerprints every document: bit b is set if more than half of the XXH64
   values of its shingles have it. Equal fingerprints are one class from here on.
2. The 64 bits are grouped into m parts so that correlated bits share a part
   (correlations over all fingerprints, summed as a 64 x 64 matrix).
3. A fingerprint gets a threshold t_i >= -1 for each part, the t_i + 1 summing to
   radius + 1. If two fingerprints differed in more than t_i bits in every part, they would
   differ in at least radius + 1 bits: so whoever lies within the radius differs in at most
   t_i bits in some part. Thresholds are chosen for each fingerprint by dynamic
   programming: the cost of a part at a threshold is the number of values probed and the
   number of candidates estimated from a bounded sample of fingerprints.
4. Each fingerprint is a member of one bucket (part, value) in each part, and probes the
   buckets of all values within its thresholds. Buckets of few members are joined, with
   the distance as the join's condition; in longer ones members and probes are dealt into
   cells of bounded size, and a cell returns a spanning forest of its links. So dense
   groups give about as many rows as they have fingerprints, never all their pairs.
5. Links are contracted to components (see near_dedup.components).

The principle misses no pair, and every candidate is verified on the whole 64 bits: the
components are exact at any size. m follows the number of classes, as a bucket of b bits
holds 2 ** -b of them: 4 parts cost 20 probes, 3 parts about 45, 2 parts about 560.

A bucket that keeps n members although thresholds avoid it costs n * n / 2 distances,
spread over cells; only a group whose fingerprints are dense in most parts does.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other;
fewer than n words are one shingle; repeated rows and equal fingerprints share a component;
a null key never names a component unless no other key is in it; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.near_dedup import components
from scriptoria.session import cut_lineage

SEED = 42
CHUNK_WORDS = 1 << 16


def fingerprint(text: str | None, n: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text's shingles of n words, repeats included.

    Words are counted in chunks, so the working set of a very long text is bounded by the
    text itself."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z, and white space 9 to 13 and 32
    if not words:
        return 0
    m = max(1, len(words) - n + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    ends = ends[min(n, len(words)) - 1 :]
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for low in range(0, m, CHUNK_WORDS):
        at = slice(low, min(m, low + CHUNK_WORDS))
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=False)], dtype="<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * set_bits > m).tolist())


def fingerprints(docs: DataFrame, n: int, key_col: str, text_col: str) -> DataFrame:
    """(key, fp): fp is the fingerprint's 64 bits as Spark's signed long."""
    schema = T.StructType([T.StructField("key", docs.schema[key_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), n) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["key", "fp"])

    return docs.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def correlations(classes: DataFrame) -> np.ndarray:
    """The 64 x 64 matrix of the bits' absolute correlations over all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 65), dtype=np.float64)
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total[:, :64] += bits.T @ bits
            total[:, 64] += len(bits)
        cell = np.arange(64 * 65)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel())], names=["cell", "n"])

    rows = classes.select("fp").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(64 * 65)
    for r in rows:
        total[r.cell] = r.n
    total = total.reshape(64, 65)
    rows_n = max(1.0, total[0, 64])
    mean = total[:, :64].diagonal() / rows_n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    found = np.abs(total[:, :64] / rows_n - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(found, 0)
    return found


def grouped_bits(related: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m parts of nearly equal size: a part starts with the most related
    pair left and takes the bit most related to it, until it is full."""
    left, parts = list(range(64)), []
    for size in (64 // m + (i < 64 % m) for i in range(m)):
        part: list[int] = []
        while len(part) < size:
            score = related[np.ix_(left, part)].sum(axis=1) if part else related[np.ix_(left, left)].max(axis=1)
            part.append(left.pop(int(score.argmax())))
        parts.append(sorted(part))
    return parts


def budgets(costs: np.ndarray, radius: int) -> np.ndarray:
    """For each row of costs (rows, parts, radius + 2), where entry j is a part's cost at
    threshold j - 1, the thresholds of least total cost with sum of (t + 1) = radius + 1."""
    rows, m, steps = costs.shape
    best = np.full((rows, steps), np.inf)
    best[:, 0] = 0
    taken = np.zeros((m, rows, steps), dtype=np.int8)
    for i in range(m):
        options = np.full((steps, rows, steps), np.inf)  # by what part i takes, and the sum so far
        for j in range(steps):
            options[j, :, j:] = best[:, : steps - j] + costs[:, i, j, None]
        taken[i] = options.argmin(axis=0)
        best = options.min(axis=0)
    out, rest = np.zeros((rows, m), dtype=np.int64), np.full(rows, radius + 1)
    for i in range(m - 1, -1, -1):
        out[:, i] = taken[i, np.arange(rows), rest]
        rest = rest - out[:, i]
    return out - 1


def ball(size: int, t: int) -> int:
    """Values within t bits of a value of `size` bits."""
    return sum(math.comb(size, k) for k in range(t + 1))


def parts_for(classes: int, radius: int) -> int:
    """How many parts cost least for so many classes, if their bits were even: a probe is a
    row to shuffle, a candidate one comparison, taken as a tenth of a row."""

    def cost(m: int) -> float:
        size, (each, more) = 64 // m, divmod(radius + 1, m)
        probes = [ball(size, each - 1 + (i < more)) if each + (i < more) else 0 for i in range(m)]
        return sum(probes) * (1 + 0.1 * classes / 2**size)

    return min(range(2, 5), key=cost)


def _flips(part: list[int], t: int) -> np.ndarray:
    """Masks that flip at most t bits of a part."""
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(part, k)], dtype=np.uint64)


def probes(classes: DataFrame, parts: list[list[int]], sample: np.ndarray, n_classes: int, radius: int) -> DataFrame:
    """(part, value, fp) of the buckets that each fingerprint probes."""
    masks = [np.uint64(sum(1 << b for b in p)) for p in parts]
    scale = n_classes / max(1, len(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips: dict[tuple[int, int], np.ndarray] = {}
        held = [sample & mask for mask in masks]
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                fp = batch.column(0).slice(low, 2048).to_numpy().view(np.uint64)
                costs = np.zeros((len(fp), len(parts), radius + 2))
                for i, part in enumerate(parts):
                    far = np.bitwise_count((fp & masks[i])[:, None] ^ held[i][None, :])
                    for t in range(radius + 1):
                        even = n_classes * ball(len(part), t) / 2 ** len(part)  # what the sample can't see
                        costs[:, i, t + 1] = ball(len(part), t) + 0.1 * ((far <= t).sum(axis=1) * scale + even)
                chosen = budgets(costs, radius)
                for i, part in enumerate(parts):
                    for t in np.unique(chosen[:, i]).tolist():
                        if t < 0:
                            continue
                        if (i, t) not in flips:
                            flips[i, t] = _flips(part, t)
                        own = fp[chosen[:, i] == t]
                        value = ((own & masks[i])[:, None] ^ flips[i, t][None, :]).ravel()
                        columns = [pa.array(np.full(len(value), i, dtype=np.int32)), pa.array(value.view(np.int64)), pa.array(np.repeat(own, len(flips[i, t])).view(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, names=["part", "value", "fp"])

    return classes.select("fp").mapInArrow(run, "part int, value long, fp long")


def _cell_links(batch_a: np.ndarray, batch_b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between probes a and members b of one cell."""
    nodes, where = np.unique(np.concatenate([batch_a, batch_b]), return_inverse=True)
    a, b = where[: len(batch_a)], where[len(batch_a) :]
    parent = np.arange(len(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    edges, of_b = [], np.arange(len(nodes))[b]
    for i, x in zip(a.tolist(), batch_a, strict=True):
        near = of_b[np.bitwise_count(batch_b ^ x) <= radius]
        if not len(near):
            continue
        r = root(i)
        # most members of a dense group have this root already: one look each, no walk
        for j in near[parent[near] != r].tolist():
            q = root(j)
            if q != r:
                parent[q] = r
                edges.append((i, j))
            parent[j] = r
    return [(int(nodes[i]), int(nodes[j])) for i, j in edges]


def links(classes: DataFrame, radius: int, sample_rows: int = 1024, short: int = 64, block: int = 2048) -> DataFrame:
    """(u, v) links among the distinct fingerprints of classes (fp), in signed longs: every
    link of a short bucket, a spanning forest of each cell of a long one."""
    n_classes = classes.count()
    parts = grouped_bits(correlations(classes), parts_for(n_classes, radius))
    rows = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()
    sample = np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64)
    as_long = lambda p: (v := sum(1 << b for b in p)) - (1 << 64 if v >> 63 else 0)
    values = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(as_long(p))).alias("value")) for i, p in enumerate(parts)])
    members = classes.select(F.explode(values).alias("b"), "fp").select("b.part", "b.value", F.col("fp").alias("v"))
    probed = cut_lineage(probes(classes, parts, sample, n_classes, radius).withColumnRenamed("fp", "u"))

    long = members.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > short)
    long = cut_lineage(long)
    near = (F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    buckets = ["part", "value"]
    # each link is found from either end's probes, so the greater fingerprint's are enough
    few = members.join(long, buckets, "left_anti").alias("m")
    same = (F.col("m.part") == F.col("p.part")) & (F.col("m.value") == F.col("p.value"))
    found = probed.alias("p").join(few, same & near).select("u", "v")

    # cells: blocks of a long bucket's members against blocks of its probes
    probing = probed.join(long.select(*buckets), buckets).groupBy(*buckets).agg(F.count("*").alias("np"))
    sized = probing.join(long, buckets).select(*buckets, F.ceil(F.col("n") / block).cast("int").alias("m_blocks"), F.ceil(F.col("np") / block).cast("int").alias("p_blocks"))
    sized = cut_lineage(sized)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cell = F.xxhash64("part", "value", "m", "p").alias("cell")
    dealt = lambda x, c: F.pmod(F.xxhash64(x), F.col(c)).cast("int")
    side_p = probed.join(sized, buckets).select(*buckets, "u", dealt("u", "p_blocks").alias("p"), every("m_blocks").alias("m")).select(cell, F.col("u").alias("fp"), F.lit(True).alias("probe"))
    side_m = members.join(sized, buckets).select(*buckets, "v", dealt("v", "m_blocks").alias("m"), every("p_blocks").alias("p")).select(cell, F.col("v").alias("fp"), F.lit(False).alias("probe"))

    def within(table: pa.Table) -> pa.Table:
        fp, probe = table.column("fp").to_numpy().view(np.uint64), table.column("probe").to_numpy(zero_copy_only=False).astype(bool)
        pairs = np.array(_cell_links(fp[probe], fp[~probe], radius), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    dense = side_p.unionByName(side_m).groupBy("cell").applyInArrow(within, "u long, v long")
    return found.unionByName(dense).distinct()


def near_duplicates(docs: DataFrame, n: int = 4, radius: int = 4, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits) and component_id, the least
    key reachable over links of at most `radius` differing bits."""
    marked = cut_lineage(fingerprints(docs, n, key_col, text_col))
    classes = cut_lineage(marked.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(links(classes, radius).toDF("a", "b"))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = cut_lineage(named.join(least, "root").select("fp", "component"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select(F.col("key").alias(key_col), hexed.alias("fingerprint"), F.col("component").alias("component_id"))
