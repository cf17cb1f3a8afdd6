"""MinHash near-dedup with bottom-k sketches from one hash function.

1. One pass gives each document the size of its shingle set, the set's digest and its
   sketch: the k smallest shingle hashes. Documents of equal sets form a class at once.
2. Inverted lists of the `list_k` smallest values of each class generate overlaps. A
   list of at most `short` classes yields its pairs of compatible sizes.
3. The union sketch (k smallest of both sketches) estimates each pair's similarity;
   pairs far below the threshold (five standard errors) go.
4. Classes whose values lie mostly in longer lists are compared within these lists: the
   list is dealt into cells by set size and by blocks of at most `block` classes, every
   pair of blocks meets in one task, and the shingle sets' intersections are counted by
   a matrix product. A cell returns a spanning forest of its links, so a group of
   thousands of near copies gives few rows, and no task holds an unbounded list.
5. Every pair that is left is verified on the full sets (exact Jaccard).
6. Links are contracted to components by alternating large-star and small-star steps.

Nothing is capped: a list of any length takes way 2 or way 4. Two linked classes stay
apart only if they share none of the values by which they could meet: for sets of equal
size at the threshold itself below 1e-5; where one text is the other with a fifth added,
0.2 ** meet, 6.4e-5. Near copies have many ways to meet.

Defined cases: null, empty and blank texts have no shingles and link with nothing; with
fewer than n words the whole sequence is one shingle; equal texts, repeated rows and
repeated keys with other texts are linked by their sets alone; a null key never names a
component; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.common import enter, give_back
from scriptoria.session import cut_lineage

CACHE_ENTRIES = 100_000
#: Shingles of sets that a task keeps while it confirms pairs: 8 MB beside the longest text.
VALUES_HELD = 1 << 20
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93))


class Words(dict):
    """Word (A to Z lower-cased) -> the 8 bytes of its hash."""

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = xxhash.xxh64_digest(word)
        return found


_words = Words()


def begin() -> None:
    """A task of this operator begins."""
    enter("near_dedup", _words.clear)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of n words."""
    if len(_words) > CACHE_ENTRIES:
        _words.clear()
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z, and white space 9 to 13 and 32
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.frombuffer(b"".join(map(_words.__getitem__, words)), dtype="<u8")
    m = max(1, len(h) - n + 1)
    x = h[:m] * A
    for k in range(1, min(n, len(h))):
        x = (x ^ (x >> np.uint64(29))) * B + h[k : k + m]
    x = (x ^ (x >> np.uint64(31))) * C
    return np.unique(x ^ (x >> np.uint64(32)))


def _signed(x: np.ndarray) -> np.ndarray:
    """Order-preserving move of unsigned hashes into Spark's signed long."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def sketches(docs: DataFrame, n: int, k: int, key_col: str, text_col: str) -> DataFrame:
    """key, text_hash, n_shingles, digest of the set (null if empty) and sketch."""
    schema = T.StructType(
        [
            T.StructField("key", docs.schema[key_col].dataType),
            T.StructField("text_hash", T.LongType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("sketch", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            sizes, digests, found = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), n)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                found.append(_signed(s[:k]))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, type=pa.int64()), pa.array(digests, type=pa.binary()), pa.array(found, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.select(F.col(f"`{key_col}`").alias("key"), F.xxhash64(f"`{text_col}`").alias("text_hash"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def _compatible(small: Column, large: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes can reach the similarity num / den."""
    return den * small >= num * large


def _short_list_pairs(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of compatible sizes from lists of bounded length."""
    lists = postings.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("n_shingles", "cid"))).alias("l"))

    def partners(x: Column, i: Column) -> Column:
        later = F.filter(F.slice("l", i + 2, F.size("l")), lambda y: _compatible(x["n_shingles"], y["n_shingles"], num, den))
        return F.transform(later, lambda y: F.struct(F.least(x["cid"], y["cid"]).alias("a"), F.greatest(x["cid"], y["cid"]).alias("b")))

    return lists.select(F.explode(F.flatten(F.transform("l", partners))).alias("p")).select("p.a", "p.b").distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs whose union sketch says at least `least`."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("sketch").alias(f"s{x}"))
    d = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    d = d.select("a", "b", union.alias("u"), F.array_intersect("sa", "sb").alias("both"))
    return d.where(F.size(F.array_intersect("u", "both")) >= least * F.size("u")).select("a", "b")


def _spanning(sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of 64-bit values, so of exact links."""
    m = len(sets)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = counts[column] > 1
    row, column = row[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((m, m), dtype=np.float32)
    width = 1024
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[row[a:b], column[a:b] - low] = 1
        both += x @ x.T
    linked = np.zeros((m, m), dtype=bool)
    for low in range(0, m, 128):  # by rows, so that only truth values fill a whole square
        rows = slice(low, low + 128)
        linked[rows] = den * both[rows] >= num * (sizes[rows, None] + sizes[None, :] - both[rows])
    np.fill_diagonal(linked, False)
    seen, edges = np.zeros(m, dtype=bool), []
    for start in range(m):
        if seen[start]:
            continue
        seen[start] = True
        front = np.array([start])
        while len(front):
            new = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            if len(new):
                edges += zip(front[linked[front][:, new].argmax(axis=0)].tolist(), new.tolist(), strict=True)
                seen[new] = True
            front = new
    return edges


def _long_list_links(postings: DataFrame, texts: DataFrame, n: int, num: int, den: int, block: int) -> DataFrame:
    """Links within long lists: pairs (a, b) that span each cell's links."""
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(den / num)))
    # a partner of compatible size lies in the same bucket of sizes or the next one: a
    # cell holds the members of its bucket ("own") and those of the one below ("low")
    members = postings.select("value", "cid", size.cast("int").alias("size"))
    counts = members.groupBy("value", "size").agg(F.count("*").alias("c"))
    near = counts.select("value", (F.col("size") + 1).alias("size"), F.col("c").alias("below")).join(counts, ["value", "size"], "right")
    near = near.join(counts.select("value", (F.col("size") - 1).alias("size"), F.col("c").alias("above")), ["value", "size"], "left").na.fill(0, ["below", "above"])
    d = members.join(near.where("c + below + above > 1"), ["value", "size"])
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    mine = F.pmod(F.xxhash64("cid"), blocks("c")).cast("int")
    # own with own: each pair of blocks; own with low: each own block with each low block
    pair = lambda i: F.concat_ws(":", F.lit("own"), F.least(mine, i), F.greatest(mine, i))
    every = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    none = F.array().cast("array<struct<size:int,part:string>>")
    cell = lambda s, part: F.struct(s.cast("int").alias("size"), part.alias("part"))
    same = F.when(F.col("c") > 1, F.transform(every("c"), lambda i: cell(F.col("size"), pair(i)))).otherwise(none)
    down = F.when(F.col("below") > 0, F.transform(every("below"), lambda i: cell(F.col("size"), F.concat_ws(":", F.lit("low"), mine, i)))).otherwise(none)
    up = F.when(F.col("above") > 0, F.transform(every("above"), lambda i: cell(F.col("size") + 1, F.concat_ws(":", F.lit("low"), i, mine)))).otherwise(none)
    cells = d.select("value", "cid", F.explode(F.concat(same, down, up)).alias("at"))
    cells = cells.select("cid", F.xxhash64("value", "at.size", "at.part").alias("cell"))
    sets_schema = "cid long, n long, items binary"

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            sets = [shingle_set(t.as_py(), n) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([s.tobytes() for s in sets], type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "n", "items"])

    sets = texts.select("cid", "text").mapInArrow(shingled, sets_schema)
    filled = cells.join(sets, "cid")

    def within(table: pa.Table) -> pa.Table:
        begin()
        cids = table.column("cid").to_pylist()
        found = [(cids[i], cids[j]) for i, j in _spanning([np.frombuffer(x, dtype="<u8") for x in table.column("items").to_pylist()], np.array(table.column("n").to_pylist(), dtype=np.float64), num, den)]
        if len(cids) >= 256:
            give_back()
        return pa.table({"a": pa.array([min(p) for p in found], type=pa.int64()), "b": pa.array([max(p) for p in found], type=pa.int64())})

    return filled.groupBy("cell").applyInArrow(within, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs whose full sets have a Jaccard similarity of num / den or more."""
    side = lambda x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"t{x}"))
    d = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            held = 0

            def full(cid: int, text: pa.Scalar, known=known) -> np.ndarray:
                nonlocal held
                if cid not in known:
                    if held > VALUES_HELD:
                        known.clear()
                        held = 0
                    known[cid] = shingle_set(text.as_py(), n)
                    held += len(known[cid])
                return known[cid]

            keep = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = full(a, ta), full(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return d.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): alternating large-star and small-star.

    Each step is an aggregate with map-side combine and joins that may split hot keys;
    every round is checkpointed and rounds grow with the logarithm of a chain's length."""
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # large star: a node's greater neighbours take its least neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours take the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        edges = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut_lineage(edges)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


#: Bits of the bitmap that keeps most unneeded texts out of a shuffle: 8 MB in all.
BITMAP = 1 << 26


def _texts(docs: DataFrame, wanted: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(cid, text) of the wanted (cid, key, text_hash). A bitmap of the wanted hashes, of
    fixed size and so safe to broadcast, drops most other texts before the join."""
    place = F.pmod(F.xxhash64("key", "text_hash"), F.lit(BITMAP))
    bucket, bit = F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(32767)
    bitmaps = wanted.groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias("bits"))
    d = docs.select(F.col(f"`{key_col}`").alias("key"), F.xxhash64(f"`{text_col}`").alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    byte = F.conv(F.hex(F.substr("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    d = d.withColumn("bucket", bucket).join(F.broadcast(bitmaps), "bucket").where(F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0)
    same = wanted["key"].eqNullSafe(d["key"]) & (wanted["text_hash"] == d["text_hash"])
    return d.join(wanted, same).groupBy("cid").agg(F.first("text").alias("text"))


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key_col: str = "doc_id", text_col: str = "text", k: int = 64, list_k: int = 32, short: int = 32, meet: int = 6, block: int = 1024) -> DataFrame:
    """One row per input row: key, text_hash (xxhash64 of the text), n_shingles,
    component_id (the least key reachable over links of similarity num / den or more)
    and kept (the key is that least key)."""
    sketched = cut_lineage(sketches(docs, n, k, key_col, text_col))
    classes = sketched.where("digest is not null").groupBy("digest").agg(F.min("key").alias("least"), F.min_by(F.struct("key", "text_hash", "n_shingles", "sketch"), F.struct("key", "text_hash")).alias("r"))
    classes = cut_lineage(classes.select(F.monotonically_increasing_id().alias("cid"), "digest", "least", "r.key", "r.text_hash", "r.n_shingles", "r.sketch"))

    postings = classes.select("cid", "n_shingles", F.explode(F.slice("sketch", 1, list_k)).alias("value"))
    lengths = postings.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    postings = cut_lineage(postings.join(lengths, "value"))
    # a class goes to the long lists' way too if 3 in 10 of its values lie in them
    share = postings.where(F.col("c") > short).groupBy("cid").agg(F.count("*").alias("in_long"), F.first("n_shingles").alias("n"))
    crowded = share.where(10 * F.col("in_long") >= 3 * F.least("n", F.lit(list_k))).select("cid")
    # and meets the others in the first `meet` of them
    turn = F.row_number().over(Window.partitionBy("cid").orderBy("value"))
    long = postings.where(F.col("c") > short).withColumn("turn", turn).where(F.col("turn") <= meet).join(crowded, "cid", "left_semi")

    t = num / den
    pairs = _short_list_pairs(postings.where(F.col("c") <= short), num, den)
    pairs = cut_lineage(_estimated(pairs, classes, k, t - 5 * (t * (1 - t) / k) ** 0.5))

    wanted = crowded.union(pairs.select(F.explode(F.array("a", "b")))).distinct()
    texts = cut_lineage(_texts(docs, classes.join(wanted, "cid", "left_semi").select("cid", "key", "text_hash"), key_col, text_col))
    spanning = _long_list_links(long, texts.join(crowded, "cid", "left_semi"), n, num, den, block)
    pairs = cut_lineage(pairs.union(spanning).distinct())
    roots = components(_verified(pairs, texts, n, num, den))

    named = classes.join(roots, classes["cid"] == roots["node"], "left").select("digest", "least", F.coalesce("root", "cid").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component"))
    named = cut_lineage(named.join(ids, "root").select("digest", "component"))
    d = sketched.select("key", "text_hash", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component", "key")
    return d.select(F.col("key").alias(key_col), "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, component.isNull()).alias("kept"))
