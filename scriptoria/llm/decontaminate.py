"""Benchmark decontamination: rare word-pair seeds join documents to items, then Smith-Waterman.

Items are normalised to words (lower case, letters and digits only). A document holds an
item if their Smith-Waterman score (match 2, mismatch -1, gap -1) reaches `min_score` of
the item's perfect score, which edited and paraphrased copies of most of a passage do.

The search gives what aligning every document with every item would give. Let an item
have m words and T = 2 m min_score. An alignment of M matches that loses X reaches T only
if X <= 2 M - T. Its M - 1 steps from one match to the next lose X in all, so at most X / 2
of them lose two or more and at least T / 2 - 1 lose one or nothing. Such a step goes on
by one or two words on either side. So with the ordered pairs of words one or two apart as
seeds, at least need = T / 2 - 1 places of the item start a pair that the document has
too, and they meet it at as many places in a run of M + X <= 3 m - T words. Where need is no
more than 0 (items of one or two words at 0.5), each common word is a seed.

1. One pass counts how often the items' pairs occur in all documents.
2. An item's need - hits most frequent places are left out: of any match, at least `hits`
   places are left, in a run of 3 m - T words. The pairs of the other, rarest places are its
   seeds. `hits` is as much as HITS, less where the item has fewer places to meet or where
   the seeds would be met more than GROWTH times as often as with one; any choice is exact.
3. A second pass gives the places where a document has a seed; a join on the seed's hash
   names the items. A document that has `hits` places of an item in two neighbouring cells
   of 3 m - T words or more goes on, as the words of these cells and around them.
4. Pairs of document and item that have `need` places in a run are aligned.

Either pass reads the texts once, whatever the size of the benchmark. Both look a pair up
in a bitmap of at most 2 ** BITS bits (all that is broadcast) before anything leaves
the task, and so does the third, which takes the texts that go on; items are never
collected. A false hit of the bitmap ends in the join.

Defined cases: null and empty texts match nothing; items of equal text are matched each;
short items follow the same rule, so at 0.5 an item of one or two words is held by each
document with one of them; a null key is a key of its own, of documents as of items;
repeated document rows count as one document (the same key) in the result; a very long text
goes on as the words around its seeds; other columns, whatever their names, are not read;
empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.common import enter
from scriptoria.session import cut_lineage

#: The bitmap of pairs: 16 MB.
BITS = 27
#: Places are told by runs of so many words.
RUN = 128
#: Seeds that a document and an item must share, and how many times as often as the seeds
#: that one alone takes they may be met. They decide costs, never results.
HITS, GROWTH = 3, 16
#: Items of one document that are handled together.
ITEMS_AT_ONCE = 256
MATCH, MISMATCH, GAP = 2, 1, 1
#: What isn't in a word: all but letters, digits and the white space that parts words.
_DROPPED = re.compile(r"[^\w \t\n\r\x0b\x0c]|_")
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value for each character."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * A
    x = (x ^ (x >> np.uint64(29))) * B
    return x ^ (x >> np.uint64(32))


#: What a character below 256 is: 0 parts words, 1 belongs to one, 2 is left out; and its value.
_KIND = np.array([0 if chr(c) in " \t\n\r\v\f" else 1 if chr(c).isalnum() else 2 for c in range(256)], dtype=np.uint8)
_VALUE = _mixed(np.arange(256))
#: Characters that are hashed in one array; bounds the memory beside a text's own.
AT_ONCE = 1 << 16


def _hash_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first character) of each run of characters between white space; 0 for one
    without letters or digits. A word's hash is a polynomial of its characters' values,
    mixed. Codes are bytes, or numbers of 32 bits where what isn't in a word is below 256."""
    wide = codes.dtype != np.uint8
    kind = np.where(codes < 256, _KIND.take(codes, mode="clip"), np.uint8(1)) if wide else _KIND.take(codes)
    inside = kind > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    starts = np.flatnonzero(start)
    found = np.zeros(len(starts), dtype=np.uint64)
    kept = np.flatnonzero(kind == 1)
    if len(kept):
        word = np.cumsum(start, dtype=np.int32).take(kept)
        new = np.flatnonzero(np.diff(word, prepend=np.int32(0)))
        lengths = np.diff(np.append(new, len(kept)))
        place = np.arange(len(kept), dtype=np.int32) - np.repeat(new.astype(np.int32), lengths)
        powers = np.full(int(lengths.max()), A, dtype=np.uint64)
        powers[0] = 1
        own = codes.take(kept)
        total = np.add.reduceat((_mixed(own) if wide else _VALUE.take(own)) * np.multiply.accumulate(powers).take(place), new)
        total = (total ^ (total >> np.uint64(32))) * B
        found[word[new] - 1] = np.maximum(total ^ (total >> np.uint64(29)), np.uint64(1))
    return found, starts


def _part(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run between white space of encoded texts."""
    ends = np.cumsum([len(t) // width + 1 for t in texts], dtype=np.int64)
    line = "\n".encode("latin-1" if width == 1 else "utf-32-le")
    codes = np.frombuffer(line.join(texts), dtype=np.uint8 if width == 1 else np.uint32)
    spaces = np.flatnonzero(_KIND.take(codes, mode="clip") == 0) if len(codes) > AT_ONCE else codes[:0]
    hashes, starts, low = [], [], 0
    while low < len(codes):
        high = len(codes)
        if high - low > AT_ONCE:  # cut behind the last space, or behind a word of that length
            k = np.searchsorted(spaces, low + AT_ONCE)
            k = k - 1 if k and spaces[k - 1] > low else k
            high = int(spaces[k]) + 1 if k < len(spaces) else high
        h, at = _hash_codes(codes[low:high])
        hashes.append(h)
        starts.append(at + low)
        low = high
    h, at = np.concatenate([*hashes, np.zeros(0, dtype=np.uint64)]), np.concatenate([*starts, np.zeros(0, dtype=np.int64)])
    return h, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, np.concatenate([[0], ends]))))


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of all words that have letters or digits, in order. Hashes are of
    lower-case letters and digits alone."""
    narrow, wide, of_narrow, of_wide = [], [], [], []
    for i, t in enumerate(texts):
        low = (t or "").lower()
        try:
            narrow.append(low.encode("latin-1"))
            of_narrow.append(i)
        except UnicodeEncodeError:
            wide.append(_DROPPED.sub("\1", low).encode("utf-32-le", "replace"))
            of_wide.append(i)
    h, row = _part(narrow, 1)
    row = np.array(of_narrow, dtype=np.int64)[row]
    if wide:
        more, own = _part(wide, 4)
        h, row = np.concatenate([h, more]), np.concatenate([row, np.array(of_wide, dtype=np.int64)[own]])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    place = np.arange(len(h)) - np.searchsorted(row, row)
    kept = np.flatnonzero(h)
    return h[kept], row[kept], place[kept]


def word_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words that have letters or digits, and their places."""
    h, _, place = hashed([text])
    return h, place


def pairs(h: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of the ordered pairs of words so far apart; of the words themselves for 0."""
    x = h * A if apart == 0 else h[:-apart] * A
    x = (x ^ (x >> np.uint64(29))) * B + (np.uint64(0) if apart == 0 else h[apart:])
    return x ^ (x >> np.uint64(32))


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local score of a in b and the first end of it in a and b (exclusive)."""
    best, at = 0, (0, 0)
    column = GAP * np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for i, w in enumerate(a):
        new = np.maximum(row - GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == w, MATCH, -MISMATCH))
        row = np.maximum.accumulate(new + column) - column
        j = int(row.argmax())
        if row[j] > best:
            best, at = int(row[j]), (i + 1, j)
    return best, *at


def limits(m: int, min_score: float) -> tuple[int, int, int, bool]:
    """For an item of m words: the least score, how many places must start a common pair, in
    a run of how many words, and whether single words are the seeds."""
    least = max(1, math.ceil(min_score * MATCH * m - 1e-9))
    places = (least + 1) // 2 - 1
    return least, max(places, 1), max(3 * m - least, 1), places <= 0


def item_words(items: DataFrame, min_score: float) -> DataFrame:
    """(iid, words, least, need, span, single) of each distinct item with words; words are
    their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontaminate")
        for batch in batches:
            out = []
            for iid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, _ = word_hashes(text.as_py())
                if len(h):
                    out.append((iid, h.tobytes(), *limits(len(h), min_score)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["iid", "words", "least", "need", "span", "single"])

    return items.select("iid", "t").mapInArrow(run, "iid long, words binary, least long, need long, span long, single boolean")


def item_places(items: DataFrame) -> DataFrame:
    """(iid, need, single, place, hash): the pairs that start at each place of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontaminate")
        for batch in batches:
            for iid, words, need, single in zip(*(batch.column(c).to_pylist() for c in ("iid", "words", "need", "single")), strict=True):
                h = np.frombuffer(words, dtype="<u8")
                found = [pairs(h, k) for k in ((0,) if single else (1, 2))]
                n = sum(map(len, found))
                columns = [np.full(n, iid), np.full(n, need), np.full(n, single), np.concatenate([np.arange(len(x)) for x in found]), np.concatenate(found).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["iid", "need", "single", "place", "hash"])

    return items.mapInArrow(run, "iid long, need long, single boolean, place long, hash long")


def bits_for(hashes: int, most: int) -> int:
    """Bits of a bitmap that marks few others, small enough for a processor's cache."""
    return min(most, max(6, (64 * hashes).bit_length()))


class Bitmap:
    """Which hashes may be wanted: those whose last bits and whose middle bits are marked."""

    def __init__(self, hashes: DataFrame, most: int = BITS) -> None:
        bits = bits_for(hashes.count(), most)
        self.mask, width = np.uint64((1 << bits) - 1), min(15, bits)
        hashes = hashes.select(F.explode(F.array("hash", F.shiftrightunsigned("hash", 32))).alias("hash"))
        place = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
        bucket, bit = F.shiftright(place, width).cast("int"), place.bitwiseAND(F.lit((1 << width) - 1))
        marks = np.zeros(max(1, (1 << bits) // 8), dtype=np.uint8)
        for r in hashes.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("marked")).collect():
            marked = np.frombuffer(bytes(r.marked), dtype=np.uint8)[: (1 << width) // 8]
            marks[(r.bucket << width) // 8 :][: len(marked)] = marked
        self.marks = np.unpackbits(marks, bitorder="little").view(bool) if bits <= 24 else marks

    def marked(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & self.mask).view(np.int64)
        if self.marks.dtype == bool:
            return np.flatnonzero(self.marks.take(at))
        return np.flatnonzero(self.marks.take(at >> 3) >> (at & 7).astype(np.uint8) & 1)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be wanted."""
        at = self.marked(hashes)
        return at[self.marked(hashes[at] >> np.uint64(32))]


def batch_hits(texts: pa.Array, wanted: Bitmap, apart: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of the wanted pairs of a batch of texts, all texts in one array."""
    h, row, _ = hashed(texts.to_pylist())
    first = np.searchsorted(row, np.arange(len(texts)))
    rows, places, hashes = [], [], []
    for k in apart:
        g = pairs(h, k) if len(h) > k else h[:0]
        at = wanted.hits(g)
        at = at[row[at] == row[at + k]]  # no pair goes on into the next text
        rows.append(row[at])
        places.append(at - first[row[at]])
        hashes.append(g[at])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)


def portions(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about AT_ONCE bytes of the column `text`."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + AT_ONCE)))
            yield batch.slice(low, high - low)
            low = high


def frequencies(docs: DataFrame, wanted: Bitmap, apart: tuple[int, ...]) -> DataFrame:
    """(hash, n): how often the wanted pairs, and a few others, occur in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontaminate")
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([*held, np.zeros(0, dtype=np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["hash", "n"])

        for batch in portions(batches, 0):
            held.append(batch_hits(batch.column(0), shared.value, apart)[2])
            size += len(held[-1])
            if size > 1 << 20:
                yield counted()
                held, size = [], 0
        yield counted()

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def seed_hits(docs: DataFrame, wanted: Bitmap, apart: tuple[int, ...]) -> DataFrame:
    """(key, text_hash, hash, run): the seeds of each document by runs of RUN words."""
    schema = T.StructType([T.StructField("key", docs.schema["key"].dataType), *[T.StructField(c, T.LongType()) for c in ("text_hash", "hash", "run")]])
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontaminate")
        for batch in portions(batches, 2):
            row, place, hashes = batch_hits(batch.column(2), shared.value, apart)
            runs = place // RUN
            order = np.lexsort((hashes, runs, row))  # several places of a pair in a run are one
            row, runs, hashes = row[order], runs[order], hashes[order]
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), dtype=bool), (row[1:] != row[:-1]) | (runs[1:] != runs[:-1]) | (hashes[1:] != hashes[:-1])]))
            at = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes[new].view(np.int64)), pa.array(runs[new].astype(np.int64))], names=["key", "text_hash", "hash", "run"])

    return docs.select("key", "text_hash", "text").mapInArrow(run, schema)


def likely_texts(docs: DataFrame, wanted: Bitmap) -> DataFrame:
    """The documents whose text's hash may be wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontaminate")
        for batch in batches:
            yield batch.take(pa.array(shared.value.hits(batch.column(1).to_numpy().view(np.uint64))))

    return docs.select("key", "text_hash", "text").mapInArrow(run, docs.select("key", "text_hash", "text").schema)


def near_words(docs: DataFrame) -> DataFrame:
    """(key, iid, words, places): the words around the hits of each item of a document, from
    rows with its text and items (iid, span, wide, cells); hits are in a cell or the next."""
    schema = T.StructType([T.StructField("key", docs.schema["key"].dataType), T.StructField("iid", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("places", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontaminate")
        for batch in batches:
            for row, (text, items) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                h, places = word_hashes(text.as_py())
                out = []
                for item in items:
                    mask = np.zeros(len(h) + 1, dtype=np.int64)
                    for c in item["cells"]:
                        mask[max(0, c * item["wide"] * RUN - item["span"])] += 1
                        mask[min(len(h), (c + 2) * item["wide"] * RUN + item["span"] + 2)] -= 1
                    near = np.flatnonzero(np.cumsum(mask[:-1]) > 0)
                    gaps = np.flatnonzero(np.diff(near) > 1) + 1  # a word 0 stands for what is left out
                    out.append((item["iid"], np.insert(h[near], gaps, 0).tobytes(), np.insert(places[near], gaps, -1).astype("<i4").tobytes()))
                columns = list(zip(*out, strict=True))
                keys = batch.column(0).take(pa.array([row] * len(out)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(columns[0], type=pa.int64()), pa.array(columns[1], type=pa.binary()), pa.array(columns[2], type=pa.binary())], names=["key", "iid", "words", "places"])

    return docs.select("key", "text", "items").mapInArrow(run, schema)


def item_pairs(item: np.ndarray, single: bool) -> np.ndarray:
    return np.unique(np.concatenate([pairs(item, k) for k in ((0,) if single else (1, 2))]))


def dense(h: np.ndarray, own: np.ndarray, need: int, span: int, single: bool) -> np.ndarray:
    """The words of h near `need` places, in a run of span words, that start one of the
    item's pairs `own`."""
    starts = np.zeros(len(h), dtype=bool)
    for k in (0,) if single else (1, 2):
        g = pairs(h, k) if len(h) > k else h[:0]
        if len(own):
            starts[: len(g)] |= own.take(np.searchsorted(own, g), mode="clip") == g
    at = np.flatnonzero(starts)
    first, last = at[: max(0, len(at) - need + 1)], at[need - 1 :]
    inside = last - first < span
    if not inside.any():
        return at[:0]
    mask = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(mask, np.maximum(first[inside] - span, 0), 1)
    np.add.at(mask, np.minimum(last[inside] + span + 1, len(h)), -1)
    return np.flatnonzero(np.cumsum(mask[:-1]) > 0)


def aligned(near: DataFrame, key: T.DataType) -> DataFrame:
    """(key, iid, score, first_word, last_word) of the near words that reach the least score."""
    schema = T.StructType([T.StructField("key", key), T.StructField("iid", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontaminate")
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            if len(known) > 10_000:
                known.clear()
            columns = (batch.column(c).to_pylist() for c in ("iid", "words", "places", "item", "least", "need", "span", "single"))
            for row, (iid, words, places, item, least, need, span, single) in enumerate(zip(*columns, strict=True)):
                h, at, a = np.frombuffer(words, dtype="<u8"), np.frombuffer(places, dtype="<i4"), np.frombuffer(item, dtype="<u8")
                if iid not in known:
                    known[iid] = item_pairs(a, single)
                close = dense(h, known[iid], need, span, single)
                if not len(close):
                    continue
                # where the runs break stand so many words that match nothing that no alignment goes on
                breaks = np.repeat(np.flatnonzero((np.diff(close) > 1) | (h[close][1:] == 0)) + 1, MATCH * len(a))
                b, at = np.insert(h[close], breaks, 0), np.insert(at[close], breaks, -1)
                best, i, j = smith_waterman(a, b)
                if best >= least:
                    _, _, back = smith_waterman(a[:i][::-1], b[:j][::-1])
                    for x, y in zip(out, (row, iid, best / (MATCH * len(a)), int(at[j - back]), int(at[j - 1])), strict=True):
                        x.append(y)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
            rows, *rest = (pa.array(x, type=k) for x, k in zip(out, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *rest], names=[f.name for f in schema.fields])

    return near.select("key", "iid", "words", "places", "item", "least", "need", "span", "single").mapInArrow(run, schema)


def matches(docs: DataFrame, items: DataFrame, key_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = 0.5, bits: int = BITS) -> DataFrame:
    """One row per document key and item it holds: score (1 for a whole exact copy) and
    the first and last of the document's words in the alignment."""
    text = F.col(f"`{text_col}`")
    d = docs.select(F.col(f"`{key_col}`").alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text")).where("text IS NOT NULL")
    named = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("t")).where("t IS NOT NULL").distinct()
    named = cut_lineage(named.withColumn("iid", F.xxhash64("item_id", "t")))
    known = cut_lineage(item_words(named, min_score))
    places = cut_lineage(item_places(known))
    apart = (0, 1, 2) if places.where("single").limit(1).count() else (1, 2)

    often = frequencies(d, Bitmap(places, bits), apart)
    weight = places.join(often, "hash", "left").groupBy("iid", "place", "need").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    falling, item = Window.partitionBy("iid").orderBy(F.desc("n"), "place"), Window.partitionBy("iid")
    ranked = weight.select("*", F.row_number().over(falling).alias("turn"), F.sum("n").over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("met"))
    ranked = ranked.withColumn("most", GROWTH * F.max(F.when(F.col("turn") == F.col("need"), F.col("met"))).over(item))
    ranked = ranked.where((F.col("turn") >= F.col("need")) | (F.col("turn") > F.col("need") - HITS) & (F.col("met") <= F.col("most")))
    rare = ranked.select("iid", "place", (F.col("need") - F.min("turn").over(item) + 1).alias("hits"))
    wide = F.ceil(F.col("span") / RUN).alias("wide")
    seeds = cut_lineage(places.join(rare, ["iid", "place"]).join(known.select("iid", "span", wide), "iid").select("hash", "iid", "place", "hits", "span", "wide").distinct())

    # the same seed of the same text counts once; a frequent seed's join is split as skewed
    found = seed_hits(d, Bitmap(seeds.select("hash").distinct(), bits), apart).join(seeds, "hash").withColumn("cell", F.floor(F.col("run") / F.col("wide")))
    found = found.withColumn("cell", F.explode(F.array(F.col("cell") - 1, "cell"))).groupBy("key", "text_hash", "iid", "hits", "span", "wide", "cell").agg(F.count_distinct("place").alias("n")).where("n >= hits")
    found = found.groupBy("key", "text_hash", "iid", "span", "wide").agg(F.collect_list("cell").alias("cells"))
    found = found.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("key", "text_hash").orderBy("iid")) - 1) / ITEMS_AT_ONCE))
    found = cut_lineage(found.groupBy("key", "text_hash", "part").agg(F.collect_list(F.struct("iid", "span", "wide", "cells")).alias("items")))
    of = found.select(F.col("key").alias("k"), F.col("text_hash").alias("h"), "items")
    likely = likely_texts(d, Bitmap(found.select(F.col("text_hash").alias("hash")).distinct(), bits))
    once = likely.join(of.select("k", "h").distinct(), likely["key"].eqNullSafe(F.col("k")) & (likely["text_hash"] == F.col("h")), "left_semi").dropDuplicates(["key", "text_hash"])
    texts = once.join(of, once["key"].eqNullSafe(F.col("k")) & (once["text_hash"] == F.col("h")))

    near = near_words(texts).join(known.select(F.col("iid"), F.col("words").alias("item"), "least", "need", "span", "single"), "iid")
    hits = aligned(near, d.schema["key"].dataType).join(named.select("iid", "item_id"), "iid")
    best = hits.groupBy("key", "item_id").agg(F.max(F.struct("score", "first_word", "last_word")).alias("b"))
    return best.select(F.col("key").alias(key_col), "item_id", "b.score", "b.first_word", "b.last_word")
