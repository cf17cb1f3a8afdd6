"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed from
left to right into the longest phrases that occur in a language's text; a phrase ends
where the automaton has no transition. The language whose phrases, weighted by log2 of
its text's length, are fewest per character wins. The automata's transitions lie in one
dense table, and thousands of text segments walk through it in step, one gather per
character, language and segment.

Texts are lower-cased; every run of characters that aren't letters is one space. Every
letter of the training text has its own symbol, whatever their number: the transitions of
the 61 most frequent lie in the dense table, those of the others in a sorted list of
(state, letter). A letter that no training text has is a phrase by itself everywhere.

A text's segments of SEGMENT characters are walked side by side, each as if a phrase
began there; then each is walked again from the state in which the segment before ended,
until both walks are in the same state, and its count is put right. That is repeated while
a segment's end changes, so the phrases are those of one walk over the whole text.

Training text per language is a bounded sample, chosen by hash (per_label documents of at
most chars characters, cut to train_chars in all, of the max_labels most frequent labels).

Defined cases: a null text or one without letters is `und` with score 0; ties go to the
language with more training text, then to the lesser name; rows with a null label or
text don't train; of rows that repeat a key only those with the label train; without any
training rows everything is `und`; repeated rows are predicted each; other input columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.common import enter
from scriptoria.llm.samples import labelled_sample

SEGMENT = 512
SPACE, OTHER, PAD, FIRST = 0, 1, 2, 3
DENSE = 64  # symbols of the dense table
FLAG = 1 << 30


class Alphabet:
    """Code point -> symbol for all letters of the training text, the most frequent first."""

    def __init__(self, texts: list[str]):
        counts: dict[str, int] = {}
        for t in texts:
            for ch in t.lower():
                if ch.isalpha():
                    counts[ch] = counts.get(ch, 0) + 1
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        table = np.fromiter((OTHER if chr(i).isalpha() else SPACE for i in range(0x110000)), dtype=np.int32, count=0x110000)
        for k, ch in enumerate(letters):
            table[ord(ch)] = FIRST + k
        self.table, self.size = table, max(DENSE, FIRST + len(letters))

    def symbols(self, text: str) -> np.ndarray:
        """The text's symbols with runs of SPACE as one, without leading or closing SPACE."""
        s = self.table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")]
        keep = s != SPACE
        keep[1:] |= s[:-1] != SPACE
        if len(keep):
            keep[0] = s[0] != SPACE
        s = s[keep]
        return s[:-1] if len(s) and s[-1] == SPACE else s


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton; state 0 is the root."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[now] = copy
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
        last = now
    return follow


class Parser:
    """Automata of all languages in one flat table of row offsets. A value with FLAG begins
    a phrase with this symbol and stands in the state after it; at the root (between phrases)
    every symbol does, and a symbol that the language lacks leads back there."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts, key=lambda n: (-len(texts[n]), n))
        self.alphabet = Alphabet(list(texts.values()))
        self.rare = self.alphabet.size - DENSE
        offset, tables, self.roots, self.weights, keys, targets, self.starts = 0, [], [], [], [], [], []
        for n in self.names:
            symbols = self.alphabet.symbols(texts[n])
            follow = suffix_automaton(symbols.tolist())
            first = {c: to * DENSE + offset for c, to in follow[0].items()}
            row = np.array([first.get(c, offset) for c in range(DENSE)], dtype=np.int64) + FLAG
            table = np.tile(row, (len(follow), 1))
            for s, f in enumerate(follow[1:], 1):
                for c, to in f.items():
                    if c < DENSE:
                        table[s, c] = to * DENSE + offset
                    else:
                        keys.append((s + offset // DENSE) * self.rare + c - DENSE)
                        targets.append(to * DENSE + offset)
            table[:, PAD] = np.arange(len(follow)) * DENSE + offset
            tables.append(table.astype(np.int32).ravel())
            self.roots.append(offset)
            self.starts.append(np.array([first.get(c + DENSE, offset) for c in range(self.rare)], dtype=np.int32) + np.int32(FLAG))
            self.weights.append(math.log2(max(2, len(symbols))))
            offset += len(follow) * DENSE
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.targets = np.array(keys, dtype=np.int64)[order], np.array(targets, dtype=np.int32)[order]
        self.table = np.concatenate(tables) if tables else np.zeros(0, dtype=np.int32)

    def _step(self, k: int, state: np.ndarray, symbol: np.ndarray, rare: bool) -> np.ndarray:
        """Where language k's states go with these symbols; with FLAG where a phrase begins."""
        if not rare:
            return self.table.take(state + symbol)
        at = np.flatnonzero(symbol >= DENSE)
        to = self.table.take(state + np.where(symbol < DENSE, symbol, OTHER))
        c = symbol[at].astype(np.int64) - DENSE
        key = (state[at] // DENSE).astype(np.int64) * self.rare + c
        low = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        found = self.keys[low] == key if len(self.keys) else np.zeros(len(at), dtype=bool)
        to[at] = np.where(found, self.targets[low] if len(self.keys) else 0, self.starts[k][c])
        return to

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): phrases of each text's symbols in each language."""
        counts = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        parts = np.array([-(-len(t) // SEGMENT) for t in texts], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), parts)
        if not len(owner):
            return counts
        n = len(owner)
        block = np.full((n, SEGMENT), PAD, dtype=np.int32)
        sizes = np.full(n, SEGMENT, dtype=np.int64)
        row = 0
        for t, p in zip(texts, parts.tolist(), strict=True):
            block[row : row + p].reshape(-1)[: len(t)] = t
            if p:
                sizes[row + p - 1] = len(t) - SEGMENT * (p - 1)
            row += p
        later = np.append(False, owner[1:] == owner[:-1])  # segments that go on from the one before
        order = np.argsort(-sizes, kind="stable")
        columns = np.ascontiguousarray(block[order].T)
        rare = (columns >= DENSE).any(axis=1)
        alive = np.searchsorted(-sizes[order], -np.arange(SEGMENT), side="left")  # segments longer than the step
        for k, root in enumerate(self.roots):
            state = np.full(n, root, dtype=np.int32)
            begun = np.zeros(n, dtype=np.int32)
            for step in range(int(sizes.max())):
                m = alive[step]
                to = self._step(k, state[:m], columns[step, :m], rare[step])
                begun[:m] += to >> 30
                np.bitwise_and(to, FLAG - 1, out=state[:m])
            alone = np.empty(n, dtype=np.int32)
            alone[order] = state
            found = np.empty(n, dtype=np.int64)
            found[order] = begun
            ends, more = alone.copy(), np.zeros(n, dtype=np.int64)
            todo = np.flatnonzero(later)
            while len(todo):
                ends_now, more_now = self._again(k, root, block, sizes, todo, ends[todo - 1], alone[todo])
                changed = ends_now != ends[todo]
                ends[todo], more[todo] = ends_now, more_now
                todo = todo[changed] + 1
                todo = todo[todo < n]
                todo = todo[later[todo]]
            np.add.at(counts[:, k], owner, found + more)
        return counts

    def _again(self, k: int, root: int, block: np.ndarray, sizes: np.ndarray, rows: np.ndarray, begin: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End states of these segments begun in these states, and how many phrases more
        begin in them than when begun at the root, of which the end states are `alone`."""
        ends, more = alone.copy(), np.zeros(len(rows), dtype=np.int64)
        live = np.flatnonzero(begin != root)
        true, other, step = begin[live], np.full(len(live), root, dtype=np.int32), 0
        while len(live):
            symbol = block[rows[live], step]
            rare = bool((symbol >= DENSE).any())
            true, other = self._step(k, true, symbol, rare), self._step(k, other, symbol, rare)
            more[live] += (true >> 30) - (other >> 30)
            true, other = true & (FLAG - 1), other & (FLAG - 1)
            step += 1
            apart = true != other
            over = apart & (sizes[rows[live]] <= step)
            ends[live[over]] = true[over]
            on = apart & ~over
            live, true, other = live[on], true[on], other[on]
        return ends, more

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        symbols = [self.alphabet.symbols(t) if t else np.zeros(0, dtype=np.int32) for t in texts]
        bits = self.phrases(symbols) * np.array(self.weights)
        names, scores = [], []
        for s, b in zip(symbols, bits, strict=True):
            if not len(s) or not self.names:
                names.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmin(b))
            names.append(self.names[best])
            scores.append(float(1.0 / np.exp(-(b - b[best]) / math.sqrt(len(s))).sum()))
        return names, scores


def train(rows: DataFrame, key_col: str, text_col: str, lang_col: str, per_label: int = 64, chars: int = 2_000, train_chars: int = 24_000, max_labels: int = 256) -> dict[str, str]:
    """Language -> training text, from a bounded sample of rows."""
    texts: dict[str, str] = {}
    label = F.col(f"`{lang_col}`")
    for lang, text in labelled_sample(rows, rows, F.col(f"`{key_col}`"), label, F.col(f"`{text_col}`"), per_label, chars, max_labels, label):
        if len(texts.get(lang, "")) < train_chars:
            texts[lang] = (texts.get(lang, "") + "\n" + text)[:train_chars]
    return {k: v for k, v in texts.items() if any(ch.isalpha() for ch in v)}


_parsers: dict[int, Parser] = {}


def parser_of(texts: dict[str, str]) -> Parser:
    """Built once in each worker process, and again after another operator's tasks there."""
    enter("language_id", _parsers.clear)
    key = hash(tuple(sorted(texts.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(texts)
    return _parsers[key]


#: Characters walked at once (a text counts as a segment at least); bounds a worker's memory beside the longest text.
AT_ONCE = 1 << 21


def identify(docs: DataFrame, model: dict[str, str], key_cols: list[str], text_col: str = "text") -> DataFrame:
    """Key columns, lang_pred and score of every row; the text may be a key column."""
    schema = T.StructType([docs.schema[k] for k in key_cols] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    n = len(key_cols)
    at = key_cols.index(text_col) if text_col in key_cols else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(model)
        for batch in batches:
            names, scores, part, size = [], [], [], 0
            for text in batch.column(at):
                part.append(text.as_py())
                size += max(SEGMENT, len(part[-1] or ""))
                if size >= AT_ONCE:
                    a, b = parser.predict(part)
                    names, scores, part, size = names + a, scores + b, [], 0
            a, b = parser.predict(part)
            columns = [*batch.columns[:n], pa.array(names + a, type=pa.string()), pa.array(scores + b, type=pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.select(*[F.col(f"`{k}`") for k in [*key_cols, text_col][: max(n, at + 1)]]).mapInArrow(run, schema)
