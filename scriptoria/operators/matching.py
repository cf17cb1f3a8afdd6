"""Title matching as a search join: exact candidates by gram counts, then the full similarity.

The similarity of two titles is the greatest of four matching ratios 2 M / (|x| + |y|),
M being the characters that sequence matching pairs: of the normal titles; of the sorted
token sets; and of the common tokens with either token set.

Candidates of a threshold t lose no match:

- Sequences. M matched characters leave |x| - M and |y| - M unmatched. An unmatched character
  of x spoils at most q of its q-grams, a gap in y at most q - 1. So x and y have at least
  c = (2 q - 1) M - (q - 1) (|x| + |y| + 1) q-grams in common, with M >= t (|x| + |y|) / 2, and
  their lengths differ by a factor of t / (2 - t) at most. q is 3 for queries of 20 characters
  or more, 2 from 5 on, else 1. No more characters match than the two have in common.
- Common tokens against a token set. The common tokens must hold t / (2 - t) of the set's
  characters.

A chunk of queries meets a part of the titles in one task, which counts common grams and
characters by the chunk's own index. So titles move once for every CHUNK queries and queries
once for every PART titles; no row is made for a candidate. Candidates are tried by their
common subsequence (an upper bound of M, in whole machine words) before sequences are matched.
"""

from __future__ import annotations

import difflib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.session import cut_lineage

ALPHABET = " abcdefghijklmnopqrstuvwxyz0123456789"
_CODE = np.zeros(128, dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: Queries and titles that one task compares.
CHUNK, PART = 8192, 4096
#: Lengths for which a string's grams of a size can be asked for.
SIZES = {1: (1, 6), 2: (3, 27), 3: (14, 1 << 30)}


def normal_title(title: Column) -> Column:
    """Lower case; every run of other characters than a to z and 0 to 9 is one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def ratio(x: str, y: str) -> float:
    return difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0


def title_similarity(x: str, y: str) -> float:
    """Of two normal titles, in 0 to 1; 0 for an empty one."""
    s, t = set(x.split()), set(y.split())
    both, s, t = (" ".join(sorted(w)) for w in (s & t, s, t))
    return max(ratio(x, y), ratio(both, s), ratio(both, t), ratio(s, t))


def size_of(length: int) -> int:
    """The size of the grams that a query of this length is looked up by."""
    return 3 if length >= 20 else 2 if length >= 5 else 1


def common_grams(x: float, y: float, q: int, t: float) -> int:
    """How many q-grams strings of these lengths share at least at ratio t."""
    return math.ceil((2 * q - 1) * t * (x + y) / 2 - (q - 1) * (x + y + 1) - 1e-9)


def grams(text: str, q: int) -> np.ndarray:
    """Codes of the text's q-grams, sizes apart."""
    code = _CODE[np.frombuffer(text.encode(), dtype=np.uint8)]
    n = len(code) - q + 1
    found = np.full(max(0, n), q, dtype=np.int64)
    for k in range(q):
        found = found * 64 + code[k : k + max(0, n)]
    return found


def subsequence(x: str, y: str) -> int:
    """Length of the longest common subsequence, a column of y for each bit."""
    places: dict[str, int] = {}
    for i, c in enumerate(y):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(y)) - 1
    left = every
    for c in x:
        met = left & places.get(c, 0)
        left = (left + met | left - met) & every
    return len(y) - left.bit_count()


def chars(texts: list[str]) -> np.ndarray:
    """How often each letter of the alphabet occurs in each text."""
    return np.array([np.bincount(_CODE[np.frombuffer(x.encode(), dtype=np.uint8)], minlength=len(ALPHABET)) for x in texts], dtype=np.int32).reshape(-1, len(ALPHABET))


def numbered(text: str, sizes: list[int]) -> np.ndarray:
    """The text's grams of these sizes; equal ones are told apart by their number, so that
    common ones are counted as often as they occur."""
    found = np.sort(np.concatenate([grams(text, q) for q in sizes])) if sizes else np.zeros(0, dtype=np.int64)
    return found << 20 | (np.arange(len(found)) - np.searchsorted(found, found))


class Asked:
    """A chunk of queries: which of them hold a gram or a token, by sorted keys."""

    def __init__(self, norms: list[str], t: float) -> None:
        self.t, self.near = t, t / (2 - t) - 1e-9
        self.kinds = [norms, [token_set(x) for x in norms]]
        self.lengths = [np.array([len(x) for x in k]) for k in self.kinds]
        self.sizes = [np.where(n >= 20, 3, np.where(n >= 5, 2, 1)) for n in self.lengths]
        self.chars = [chars(k) for k in self.kinds]
        self.grams = [self.index([numbered(x, [size_of(len(x))]) for x in k]) for k in self.kinds]
        self.tokens: dict[str, list[int]] = {}
        for i, x in enumerate(self.kinds[1]):
            for w in x.split():
                self.tokens.setdefault(w, []).append(i)
        self.held = {w: np.array(i) for w, i in self.tokens.items()}

    @staticmethod
    def index(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, of = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        return keys, np.append(first, len(order)), of[order]

    def by_grams(self, kind: int, text: str) -> np.ndarray:
        """Queries whose string of this kind can reach ratio t with the text."""
        n, t = len(text), self.t
        keys, first, of = self.grams[kind]
        mine = numbered(text, [q for q, (low, high) in SIZES.items() if low <= n <= high])
        at = np.searchsorted(keys, mine)
        at = at[at < len(keys)][keys[at[at < len(keys)]] == mine[at < len(keys)]]
        met = [of[first[i] : first[i + 1]] for i in at.tolist()]
        shared = np.bincount(np.concatenate(met), minlength=len(self.kinds[0])) if met else np.zeros(len(self.kinds[0]), dtype=np.int64)
        x, q = self.lengths[kind], self.sizes[kind]
        need = (2 * q - 1) * t * (x + n) / 2 - (q - 1) * (x + n + 1) - 1e-6
        found = np.flatnonzero((shared >= need) & (x >= self.near * n) & (n >= self.near * x))
        if len(found):
            same = np.minimum(self.chars[kind][found], chars([text])).sum(axis=1)
            found = found[2 * same >= t * (x[found] + n) - 1e-9]
        return found

    def by_tokens(self, text: str) -> np.ndarray:
        """Queries whose common tokens with the text's can hold t / (2 - t) of either set."""
        both = np.zeros(len(self.kinds[0]))
        for w in text.split():
            if w in self.held:
                both[self.held[w]] += len(w) + 1
        return np.flatnonzero((both > 0) & (both - 1 >= self.near * np.minimum(self.lengths[1], len(text))))

    def candidates(self, norm: str) -> np.ndarray:
        tokens = token_set(norm)
        return np.unique(np.concatenate([self.by_grams(0, norm), self.by_grams(1, tokens), self.by_tokens(tokens)]))


def token_set(norm: str) -> str:
    return " ".join(sorted(set(norm.split())))


def similar(x: str, y: str, t: float) -> float:
    """The similarity of two normal titles if it is t or more, else something less."""
    s, u = set(x.split()), set(y.split())
    both, s, u = (" ".join(sorted(w)) for w in (s & u, s, u))
    best = 0.0
    for v, w in ((x, y), (both, s), (both, u), (s, u)):
        n = len(v) + len(w)
        if v == w:
            best = max(best, 1.0 if v else 0.0)
        elif v and w and 2 * min(len(v), len(w)) >= t * n - 1e-9 and 2 * subsequence(v, w) >= t * n - 1e-9:
            best = max(best, ratio(v, w))
    return best


def _matched(t: float):
    """A task: the pairs of a chunk of queries and a part of the titles of similarity t or more."""

    def run(queries: pa.Table, titles: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if len(queries) and len(titles):
            ids, norms = queries.column("a").to_pylist(), queries.column("norm").to_pylist()
            asked = Asked(norms, t)
            for b, y in zip(titles.column("b").to_pylist(), titles.column("norm").to_pylist(), strict=True):
                for i in asked.candidates(y).tolist():
                    s = similar(norms[i], y, t)
                    if s >= t:
                        found.append((ids[i], b, s))
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.table([pa.array(c, type=k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

    return run


def title_search(titles: DataFrame, asked: Column, t: float = 0.85) -> DataFrame:
    """(id, other, size, similarity): for each row of titles (id, title) that fulfils the
    condition `asked`, every class of titles of similarity t or more (t above 2 / 3). A class
    holds the titles of one normal form, `other` is its least id and `size` its rows; a row's
    own class is among them. Titles without a letter a to z or digit match nothing."""
    if not 2 / 3 < t <= 1:
        raise ValueError("a threshold of 2 / 3 or less has no gram bound")
    rows = titles.select("id", normal_title(F.col("title")).alias("norm")).where("norm <> '' AND id IS NOT NULL")
    rows = cut_lineage(rows.withColumn("asked", F.coalesce(asked, F.lit(False))))
    classes = rows.groupBy("norm").agg(F.min("id").alias("other"), F.count("*").alias("size"), F.max("asked").alias("asked"))
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()))
    n, m = (max(1, -(-d.count() // most)) for d, most in ((classes.where("asked"), CHUNK), (classes, PART)))
    dealt = lambda k: F.pmod(F.xxhash64("cid"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    queries = classes.where("asked").select(F.col("cid").alias("a"), "norm", dealt(n).alias("chunk")).withColumn("part", every(m))
    others = classes.select(F.col("cid").alias("b"), "norm", dealt(m).alias("part")).withColumn("chunk", every(n))
    found = queries.groupBy("chunk", "part").cogroup(others.groupBy("chunk", "part")).applyInArrow(_matched(t), "a long, b long, similarity double")
    named = found.join(classes.select(F.col("cid").alias("b"), "other", "size"), "b")
    of = rows.where("asked").join(classes.select("norm", F.col("cid").alias("a")), "norm").select("id", "a")
    return named.join(of, "a").select("id", "other", "size", "similarity")
