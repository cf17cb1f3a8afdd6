"""Packing: an order-preserving dynamic program chooses the window cuts.

Each task turns its documents, in their order, into one token stream and cuts it into
windows of at most `max_len` ids. A cut may lie at a document's end, after a sentence's
end, or, inside long sentences, on a grid; f(j) = min over i of f(i) + padding(i, j) +
penalty(j), where padding is max_len minus the window's length. As padding is linear in
the window's ends, f(j) = penalty(j) + max_len - b(j) + min(f(i) + b(i)) over the i
within max_len of b(j): a sliding minimum, kept in a monotone queue, so the program is
linear in the number of cuts. Streams are solved in blocks of about `block` ids; a
block's last window is carried into the next block, so blocks cost no padding and
memory is bounded by the block and the longest document.

A window whose length is a power of two needs no padding. So in a stream's last max_len
ids every place is a cut and windows of such lengths cost `short_penalty` in place of
their padding: the rest of a stream may end in a few unpadded windows. Elsewhere they are
not considered, as they would only chop the stream into more sequences.

There is no shuffle: a task's only waste is its end, and a lost task is redone
from its input split alone.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each;
a null key is carried through; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.common import enter

# Fixed value: the pre-tokenizer's pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks longer than this go to the reference tokenizer, whose merging stays n log n.
LONG_CHUNK = 400
CACHE_ENTRIES = 100_000


class Irregular(Exception):
    """White space that may join neighbouring chunks."""


def _letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    No pre-token crosses the place before a single space between two characters that
    aren't white space. So a text is split at spaces and each chunk's ids are looked up;
    texts with other white space at a chunk's end, and long chunks, are encoded by the
    reference tokenizer."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        letters, model = _letters(), json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in model.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.entries, self.chunks = entries, self._cache()

    def _cache(self):
        encode = self.encode_chunk

        class Cache(dict):
            def __missing__(self, chunk: str) -> bytes:
                if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    raise Irregular
                found = self[chunk] = encode(" " + chunk)
                return found

        return Cache()

    def encode_chunk(self, text: str) -> bytes:
        if len(text) > LONG_CHUNK:
            return self.reference(text)
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def reference(self, text: str) -> bytes:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if len(self.chunks) > self.entries:
            self.chunks.clear()
        first, *rest = text.split(" ")
        if not first or first[0].isspace() or first[-1].isspace():
            return self.reference(text)
        try:
            return self.encode_chunk(first) + b"".join(map(self.chunks.__getitem__, rest))
        except Irregular:
            return self.reference(text)

    def sentence_ends(self, vocabulary: int) -> np.ndarray:
        """For each id whether its text ends a sentence or line."""
        ends = np.zeros(vocabulary, dtype=bool)
        for i in range(self.fast.n_vocab):
            ends[i] = self.fast.decode_single_token_bytes(i).endswith((b".", b"!", b"?", b"\n"))
        return ends


_tokenizers: dict[str, tuple[ByteBpe, np.ndarray]] = {}


def tokenizer(path: str, entries: int = CACHE_ENTRIES) -> tuple[ByteBpe, np.ndarray]:
    enter("packing", _tokenizers.clear)
    if path not in _tokenizers:
        t = ByteBpe(path)
        _tokenizers[path] = t, t.sentence_ends(1 << 16)
    _tokenizers[path][0].entries = entries
    return _tokenizers[path]


def cut_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, grid: int, sentence_penalty: float, hard_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts from 0 to the stream's end, ascending, with their penalties."""
    natural = np.union1d(doc_ends, sentence_ends)
    gaps = np.diff(natural, prepend=0)
    wide = np.flatnonzero(gaps > grid)
    n = (gaps[wide] - 1) // grid
    steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
    hard = np.repeat(natural[wide] - gaps[wide], n) + steps * grid
    places = np.concatenate([[0], natural, hard])
    penalty = np.concatenate([[0.0], np.where(np.isin(natural, doc_ends), 0.0, sentence_penalty), np.full(len(hard), hard_penalty)])
    order = np.argsort(places, kind="stable")
    return places[order], penalty[order]


def best_cuts(places: list[int], penalty: list[float], max_len: int, short_from: int | None = None, short_penalty: float = 0.0) -> list[int]:
    """The cuts of least padding plus penalty; neighbouring places are at most max_len apart.
    Windows that begin at short_from or later and have a power of two of ids cost
    short_penalty in place of their padding."""
    cost, back, queue = [0.0] * len(places), [0] * len(places), deque([0])
    value = [0.0] * len(places)  # cost + place
    late: dict[int, int] = {}  # place -> index, from short_from on
    if short_from is not None and places[0] >= short_from:
        late[places[0]] = 0
    for j in range(1, len(places)):
        b = places[j]
        while b - places[queue[0]] > max_len:
            queue.popleft()
        i = queue[0]
        back[j] = i
        value[j] = v = penalty[j] + max_len + value[i]  # cost[j] + b
        if late:
            n = 1
            while n < max_len:
                i = late.get(b - n)
                if i is not None and cost[i] + penalty[j] + short_penalty + b < v:
                    back[j] = i
                    value[j] = v = cost[i] + penalty[j] + short_penalty + b
                n *= 2
        cost[j] = v - b
        if short_from is not None and b >= short_from:
            late[b] = j
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [places[-1]], len(places) - 1
    while j:
        j = back[j]
        cuts.append(places[j])
    return cuts[::-1]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    key_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = 1024,
    end_id: int = 0,
    sentence_penalty: float = 4.0,
    hard_penalty: float = 8.0,
    short_penalty: float = 8.0,
    grid: int = 16,
    block: int = 1 << 19,
    with_ids: bool = True,
    cache_entries: int = CACHE_ENTRIES,
) -> DataFrame:
    """Pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with
    with_ids, the ids themselves. A worker keeps the ids of cache_entries chunks."""
    key_type = docs.schema[key_col].dataType
    fields = [T.StructField(key_col, key_type)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, ends_sentence = tokenizer(tokenizer_path, cache_entries)
        next_id = TaskContext.get().partitionId() << 40
        # the documents of the stream: key, ids, ids of the document before them, its length
        stream: list[tuple[object, bytes, int, int]] = []
        held, key_kind = 0, None

        def solve(last: bool) -> pa.RecordBatch:
            nonlocal stream, held, next_id
            raw = b"".join(s[1] for s in stream)
            ids = np.frombuffer(raw, dtype="<u4")
            sizes = np.array([len(s[1]) // 4 for s in stream])
            doc_ends = np.cumsum(sizes)
            sentences = np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1
            places, penalty = cut_places(doc_ends, sentences, min(grid, max_len), sentence_penalty, hard_penalty)
            short_from = None
            if last:
                short_from = max(0, len(ids) - max_len)
                new = np.setdiff1d(np.arange(short_from + 1, len(ids)), places)
                order = np.argsort(np.concatenate([places, new]), kind="stable")
                places, penalty = np.concatenate([places, new])[order], np.concatenate([penalty, np.full(len(new), hard_penalty)])[order]
            cuts = np.array(best_cuts(places.tolist(), penalty.tolist(), max_len, short_from, short_penalty))
            if not last:
                cuts = cuts[:-1]
            stop = int(cuts[-1])
            edges = np.union1d(cuts, doc_ends[doc_ends <= stop])
            starts, lengths = edges[:-1], np.diff(edges)
            of = np.searchsorted(doc_ends, starts, side="right")
            sequence = np.searchsorted(cuts, starts, side="right") - 1
            before = np.array([s[2] for s in stream]) - (doc_ends - sizes)
            view = memoryview(raw)
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in pairwise(edges.tolist())]
            total = np.array([s[3] for s in stream])
            columns = [pa.array([stream[k][0] for k in of.tolist()], type=key_kind)]
            columns += [pa.array(x, type=pa.int64()) for x in (starts + before[of], lengths, crc, total[of], sequence + next_id, starts - cuts[sequence])]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edges - edges[0], type=pa.int32()), pa.array(ids[:stop].astype(np.int32))))
            next_id += len(cuts) - 1
            rest = []
            for s, e, n in zip(stream, doc_ends.tolist(), sizes.tolist(), strict=True):
                if e > stop:
                    gone = max(0, stop - (e - n))
                    rest.append((s[0], s[1][4 * gone :], s[2] + gone, s[3]))
            stream, held = rest, len(ids) - stop
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

        for batch in batches:
            key_kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = bpe.encode(text.as_py() or "") + end
                stream.append((key, raw, 0, len(raw) // 4))
                held += len(raw) // 4
                if held >= block:
                    yield solve(False)
        if stream:
            yield solve(True)

    return docs.select(F.col(f"`{key_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
