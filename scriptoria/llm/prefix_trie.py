"""Prefix trie of conversations by an LCP-aware external mergesort.

1. A turn becomes a 20-byte element (16 bytes of the SHA-256 of role and text, 4 bytes of
   the text's length), so a conversation is a key of elements whose byte order is that of
   a path; ties between equal keys are ordered by conversation id.
2. Runs: each task sorts its records in pieces of bounded size and stores with each
   record the number of elements it shares with the one before (its LCP).
3. The sorted runs are dealt into ranges of about equal size. A range's task merges its
   slices of the runs with a loser tree: of two heads the one with the greater LCP to the
   last winner is the lesser, and only heads of equal LCP are compared, from that element
   on, so no shared turn is compared again.
4. The merged stream with its LCPs drives a stack of the open path: a record closes the
   nodes deeper than its LCP, which are finished then and handed to their parents.
5. Only nodes on a range's first or last path can go on in another range. These paths,
   two a range, are records again, with partial sums for each of their nodes; they go
   through the same steps in far fewer ranges, until one range is left. Ties are ordered
   by id and ranges cut between ids too, so a path that a third of all conversations
   follow lies in many ranges.

A task holds one range of bounded size and the open path. The decimal ids of those that
end at a node are hashed as one stream, so where a node lies in many ranges their id
lists, in order, pass through one task piece by piece; nothing is held but the hash.

Defined cases: null role and text are empty; rows of one conversation with equal turn are
ordered by role, then by the SHA-256 of role and text, and a repeated row counts as a turn
each time; rows without a conversation id belong to none and are left out; an empty table
has no node; an empty text has length 0; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.session import cut_lineage

ELEMENT = 20
RUN_BYTES, RANGE_BYTES, RANGE_RECORDS = 16 << 20, 32 << 20, 4096
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
ROOT_DIGEST = bytes(16)
#: Sums that a record carries for each node of its path, from the root down, as 64-bit
#: integers: members, the least of them, finished children, leaves, saved tokens.
N_SUMS = 5
RECORD = "key binary, own long, sums binary"
RUN = RECORD + ", run long, place long, lcp int"
#: Ids in a piece of a node's list.
PIECE = 1024
NODE = "conv_id long, depth long, parent_conv_id long, parent_digest binary, digest binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
OUT = f"kind int, {NODE}, ends string, {RECORD}"


def turn_element(role: Column, text: Column) -> Column:
    """20 bytes that stand for a turn: equal turns have equal bytes."""
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.unhex(F.sha2(F.encode(said, "utf-8"), 256)), 1, 16), F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))


def keys(turns: DataFrame, head: Column, base: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_head: int = 5) -> DataFrame:
    """(own, key): each conversation rebuilt as the first `head` turns of conversation
    `base` and its own turns after its first `head`. head and base are expressions over
    the conversation's id `own`; head is at most most_head."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    element = turn_element(role, text)
    d = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(F.col(f"`{conv_col}`").cast("long").alias("own"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), element.alias("e"))
    # null turns sort first in an array of structs
    path = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "e"))), lambda x: x["e"])
    d = cut_lineage(d.groupBy("own").agg(path.alias("path"))).withColumns({"head": head, "base": base})
    heads = d.where(F.col("own") == F.col("base")).select(F.col("base").alias("of"), F.slice("path", 1, most_head).alias("first"))
    joined = d.join(heads, F.col("base") == F.col("of"), "left")
    none = F.array().cast("array<binary>")
    rest = F.when(F.size("path") > F.col("head"), F.expr("slice(path, head + 1, greatest(size(path) - head, 0))")).otherwise(none)
    rebuilt = F.concat(F.coalesce(F.expr("slice(first, 1, head)"), none), rest)
    return joined.select("own", F.unhex(F.array_join(F.transform(rebuilt, F.hex), "")).alias("key"))


def shared(a: bytes, b: bytes, low: int = 0) -> int:
    """How many elements a and b share, if they share the first `low`."""
    at, end = low * ELEMENT, min(len(a), len(b))
    step = ELEMENT
    while at < end and a[at : at + step] == b[at : at + step]:
        at, step = at + step, step * 2
    if at >= end:
        return end // ELEMENT
    while step > ELEMENT:  # the first difference lies in the last step
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return min(at, end) // ELEMENT


class LoserTree:
    """Merges sorted runs of (key, own, lcp, record), giving each record with its LCP to
    the record before it in the merged order."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.streams = [iter(r) for r in runs]
        self.heads = [next(s, None) for s in self.streams]
        self.lcp = [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size if node - self.size < len(self.heads) else -1
        winner, self.losers[node] = self._match(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's LCP is then that to the winner."""
        if a < 0 or self.heads[a] is None:
            return b, a
        if b < 0 or self.heads[b] is None:
            return a, b
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        (x, x_own), (y, y_own) = self.heads[a][:2], self.heads[b][:2]
        n = shared(x, y, self.lcp[a])
        tail = slice(n * ELEMENT, (n + 1) * ELEMENT)
        if (x[tail], x_own) <= (y[tail], y_own):
            self.lcp[b] = n
            return a, b
        self.lcp[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            i = self.winner
            yield self.lcp[i], self.heads[i]
            self.heads[i] = next(self.streams[i], None)
            self.lcp[i] = self.heads[i][2] if self.heads[i] is not None else 0
            node = (self.size + i) // 2
            while node:
                i, self.losers[node] = self._match(i, self.losers[node])
                node //= 2
            self.winner = i


class Node:
    """An open node: its sums so far, its finished children and the ids that end here.

    The sums hold what lies below finished children and what ends here; a child that
    isn't finished in this range adds nothing yet."""

    __slots__ = ("n", "least", "kids", "leaves", "saved", "length", "done", "ends")

    def __init__(self, length: int) -> None:
        self.n = self.least = self.kids = self.leaves = self.saved = 0
        self.length, self.done, self.ends = length, [], []

    def add(self, n: int, least: int, kids: int, leaves: int, saved: int) -> None:
        if n:  # without members there is nothing else
            self.least = least if not self.n else min(self.least, least)
            self.n, self.kids, self.leaves, self.saved = self.n + n, self.kids + kids, self.leaves + leaves, self.saved + saved

    def sums(self) -> tuple:
        return self.n, self.least, self.kids, self.leaves, self.saved


class Path:
    """The stack of the open path over a sorted stream of records.

    whole: the stream is everything, so every node is finished. Else nodes on its first
    and last path become records again. hashed: ids end in this stream (the first round)."""

    def __init__(self, whole: bool, hashed: bool) -> None:
        self.whole, self.hashed = whole, hashed
        self.stack: list[Node] = []
        self.key, self.own, self.digests = b"", 0, (b"", [ROOT_DIGEST])
        self.first: tuple[bytes, int] | None = None
        self.edges: dict[bool, dict[int, tuple]] = {False: {}, True: {}}
        self.rows: list[tuple] = []

    def digest(self, key: bytes, depth: int) -> bytes:
        """Names the node at this depth of the path; the chain of the last key is kept."""
        if self.digests[0] != key:
            found = [ROOT_DIGEST]
            for i in range(0, len(key), ELEMENT):
                found.append(hashlib.blake2b(found[-1] + key[i : i + ELEMENT], digest_size=16).digest())
            self.digests = (key, found)
        return self.digests[1][depth]

    def add(self, lcp: int, key: bytes, own: int, sums: bytes | None) -> None:
        if self.first is None:
            self.first = (key, own)
            self.stack.append(Node(0))
        else:
            self.close(lcp, False)
        for i in range(len(self.stack) - 1, len(key) // ELEMENT):
            self.stack.append(Node(int.from_bytes(key[i * ELEMENT + 16 : (i + 1) * ELEMENT], "big")))
        self.key, self.own = key, own
        if sums is None:
            self.stack[-1].add(1, own, 0, 0, 0)
            self.stack[-1].ends.append(own)
        else:
            for node, x in zip(self.stack, np.frombuffer(sums, dtype="<i8").reshape(-1, N_SUMS).tolist(), strict=True):
                node.add(*x)

    def close(self, depth: int, last: bool) -> None:
        """Finishes the open nodes deeper than `depth`."""
        if len(self.stack) - 1 <= depth:
            return
        on = shared(self.first[0], self.key)
        while len(self.stack) - 1 > depth:
            d, node = len(self.stack) - 1, self.stack.pop()
            if not self.whole and (last or d <= on):
                self.edges[last][d] = node.sums()
                self.hand_on(node, d)
            else:
                self.finish(node, d)

    def finish(self, node: Node, d: int) -> None:
        saved, leaves = node.saved + (node.n - 1) * node.length, node.leaves if node.kids else 1
        self.rows += [(0, *r[:2], node.least, None, *r[2:]) for r in node.done]
        row = (node.least, d, None if self.hashed else self.digest(self.key, d), node.n, node.kids, leaves, saved, hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if self.hashed else None)
        if d == 0:
            self.rows.append((0, *row[:2], None, None, *row[2:]))
        else:
            self.stack[-1].done.append(row)
            self.stack[-1].add(node.n, node.least, 1, leaves, saved)

    def hand_on(self, node: Node, d: int) -> None:
        """The finished children of a node that isn't, and the ids that end at it."""
        if node.done or node.ends:
            name = self.digest(self.key, d)
            self.rows += [(0, *r[:2], None, name, *r[2:]) for r in node.done]
            for i in range(0, len(node.ends), PIECE):
                part = node.ends[i : i + PIECE]
                self.rows.append((2, part[0], None, None, None, name, *[None] * 5, ",".join(map(str, part))))

    def end(self) -> list[tuple[bytes, int, bytes]]:
        """Closes the path and gives the records (key, own, sums) for the next round."""
        if self.first is None:
            return []
        self.close(-1, True)
        out, none = [], (0,) * N_SUMS
        for (key, own), sums in ((self.first, self.edges[False]), ((self.key, self.own), self.edges[True])):
            if sums:
                out.append((key, own, np.array([sums.get(d, none) for d in range(len(key) // ELEMENT + 1)], dtype="<i8").tobytes()))
        return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_RECORD_FIELDS = [pa.field("key", pa.binary()), pa.field("own", pa.int64()), pa.field("sums", pa.binary())]
_RUN_SCHEMA = pa.schema([*_RECORD_FIELDS, pa.field("run", pa.int64()), pa.field("place", pa.int64()), pa.field("lcp", pa.int32())])
_OUT_SCHEMA = pa.schema(
    [pa.field("kind", pa.int32()), *[pa.field(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id")], pa.field("parent_digest", pa.binary()), pa.field("digest", pa.binary())]
    + [pa.field(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [pa.field("ends_sha256", pa.string()), pa.field("ends", pa.string()), *_RECORD_FIELDS]
)


def _records(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(key, own, sums) of the record columns of a batch."""
    yield from zip(*(batch.column(name).to_pylist() for name in ("key", "own", "sums")), strict=True)


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in sorted runs of about RUN_BYTES, each with its LCP to the one before."""
    held: list[tuple] = []
    count, size, of = 0, 0, TaskContext.get().partitionId() << 32

    def run() -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda r: r[:2])
        rows = []
        for place, (key, own, sums) in enumerate(held):
            lcp = shared(held[place - 1][0], key) if place else 0
            rows.append((key, own, sums, of + count, place, lcp))
        for i in range(0, len(rows), 1024):
            yield _batch(rows[i : i + 1024], _RUN_SCHEMA)

    for batch in batches:
        for r in _records(batch):
            held.append(r)
            size += len(r[0]) + 64
            if size >= RUN_BYTES:
                yield from run()
                held, count, size = [], count + 1, 0
    yield from run()


def _merged(whole: bool, hashed: bool):
    """The task of a range: merges the slices of the runs and finishes nodes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, list[tuple]] = {}
        for batch in batches:
            runs, places, lcps = (batch.column(c).to_pylist() for c in ("run", "place", "lcp"))
            for r, run, place, lcp in zip(_records(batch), runs, places, lcps, strict=True):
                slices.setdefault(run, []).append((place, lcp, r))
        ordered = [[(key, own, lcp, sums) for _, lcp, (key, own, sums) in sorted(s, key=lambda x: x[0])] for s in slices.values()]
        slices.clear()
        path = Path(whole, hashed)
        for lcp, (key, own, _, sums) in LoserTree(ordered):
            path.add(lcp, key, own, sums)
            if len(path.rows) >= 4096:
                yield _batch([(*r, *[None] * (len(_OUT_SCHEMA) - len(r))) for r in path.rows], _OUT_SCHEMA)
                path.rows = []
        last = [(1, *[None] * 11, *r) for r in path.end()]
        rows = [(*r, *[None] * (len(_OUT_SCHEMA) - len(r))) for r in path.rows] + last
        for i in range(0, len(rows), 4096):
            yield _batch(rows[i : i + 4096], _OUT_SCHEMA)

    return task


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, sha): the hash of each node's pieces of ids, which come in order."""
    name, state, out = None, None, []
    for batch in batches:
        for digest, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest != name:
                if state is not None:
                    out.append((name, state.hexdigest()))
                name, state = digest, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if state is not None:
        out.append((name, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], type=pa.binary()), pa.array([x[1] for x in out], type=pa.string())], names=["digest", "sha"])


def _round(records: DataFrame, hashed: bool) -> tuple[DataFrame, bool]:
    """One sort and merge of records: the OUT rows, and whether every node is finished."""
    runs = cut_lineage(records.mapInArrow(sorted_runs, RUN))
    n, size = runs.agg(F.count("*"), F.coalesce(F.sum(F.length("key") + 64), F.lit(0))).first()
    ranges = max(-(-size // RANGE_BYTES), min(-(-n // RANGE_RECORDS), 4 * records.sparkSession.sparkContext.defaultParallelism))
    ranges = max(1, min(ranges, n // 8))  # each round has far fewer records, whatever their size
    dealt = runs.repartition(1) if ranges == 1 else runs.repartitionByRange(ranges, "key", "own")
    return cut_lineage(dealt.mapInArrow(_merged(ranges == 1, hashed), OUT)), ranges == 1


def trie(paths: DataFrame) -> DataFrame:
    """One row per node of the trie of paths (own, key): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rounds, whole, records = [], False, paths.select("key", "own", F.lit(None).cast("binary").alias("sums"))
    while not whole:
        out, whole = _round(records, not rounds)
        rounds.append(out)
        records = out.where("kind = 1").select("key", "own", "sums")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    nodes = rounds[0].where("kind = 0")
    if len(rounds) == 1:
        return nodes.select(*columns)
    # nodes on the edges of ranges were finished later: their ids, and who their children are
    late = reduce(DataFrame.unionByName, [r.where("kind = 0") for r in rounds[1:]])
    pieces = rounds[0].where("kind = 2").select("digest", F.col("conv_id").alias("first"), "ends")
    shas = pieces.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ends").mapInArrow(_hashed, "digest binary, sha string")
    names = late.select(F.col("digest").alias("parent_digest"), F.col("conv_id").alias("of"))
    every = nodes.unionByName(late.drop("ends_sha256").join(shas, "digest", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_HASH))).select(*nodes.columns))
    known = every.where("parent_digest IS NULL").select(*columns)
    found = every.where("parent_digest IS NOT NULL").join(names, "parent_digest").withColumn("parent_conv_id", F.col("of"))
    return known.unionByName(found.select(*columns))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), each rebuilt by the contract's
    rule: the first h turns of conversation c - c % 100, then its own after its first h,
    with h = crc32(c) % 6."""
    head = (F.crc32(F.col("own").cast("string").cast("binary")) % 6).cast("int")
    return trie(keys(turns, head, F.col("own") - F.col("own") % 100))


def oracle_select() -> str:
    """The contract's trie in SQL, a node being the joined hashes of its path."""
    return """WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS len, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS e FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, e, len, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, e) AS n FROM t),
ids AS (SELECT c, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: [ascii(substr(c::VARCHAR, i::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT ids.c, n, e, len FROM ids JOIN o ON o.c = ids.c - ids.c % 100 AND n <= h UNION ALL SELECT ids.c, n, e, len FROM ids JOIN o ON o.c = ids.c AND n > h),
p AS (SELECT c, row_number() OVER w AS d, len, string_agg(e, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY c ORDER BY n ROWS UNBOUNDED PRECEDING) UNION ALL SELECT c, 0, 0, '' FROM ids),
l AS (SELECT c, max(d) AS depth FROM p GROUP BY c),
nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n, any_value(len) AS len, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = depth), '')) AS ends FROM p JOIN l USING (c) GROUP BY path, d),
k AS (SELECT left(path, greatest(length(path) - 64, 0)) AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
f AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN k USING (path)),
s AS (SELECT a.path, sum((b.n_children = 0)::INT)::BIGINT AS n_leaves, sum((b.n - 1) * b.len)::BIGINT AS saved_tokens FROM f a JOIN f b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved_tokens, f.ends AS ends_sha256
FROM f JOIN s USING (path) LEFT JOIN f u ON f.d > 0 AND u.path = left(f.path, length(f.path) - 64)"""
