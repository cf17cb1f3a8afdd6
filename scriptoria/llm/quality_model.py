"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

A word's token is the word itself, lower-cased, where it is frequent in the training
sample, else its shape (runs of letters, digits and each other character). Features
are hashed token unigrams, bigrams and trigrams; an n-gram also says which neighbouring
words are equal. A document's vector holds the n-grams' counts at Euclidean length 1.

Training uses a bounded sample (per_label rows a label, chars characters a row), the
labels balanced by it; scores read whole texts.

Defined cases: a null or empty text has the bias as its only feature; without training
rows every score is 0.5; rows with a null label or text don't train; of several labels
of one document the least counts; repeated rows are scored each; other columns of the
input are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.samples import labelled_sample

BITS = 18
CACHE_ENTRIES = 400_000
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_RUNS = ((re.compile(r"[^\W\d_]*[^\W\d_A-ZÀ-Þ][^\W\d_]*"), "a"), (re.compile(r"[A-ZÀ-Þ]{2,}"), "AA"), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1+"), r"\1\1"))


def shape(word: str) -> str:
    """Letters with a small one: a; capitals: AA; digits: 0; repeated signs: two."""
    for pattern, to in _RUNS:
        word = pattern.sub(to, word)
    return word[:12]


class Features:
    """Hashed n-gram indices and values of texts."""

    def __init__(self, frequent: frozenset[str]):
        self.frequent = frequent
        outer = self

        class Words(dict):
            def __missing__(self, word: bytes) -> bytes:
                text = word.decode("utf-8", "replace")
                token = text.lower() if text.lower() in outer.frequent else "\0" + shape(text)
                found = self[word] = xxhash.xxh64_digest(token)[::-1] + xxhash.xxh64_digest(word)[::-1]
                return found

        self.words = Words()

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        words = (text or "").encode("utf-8", "replace").split()
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        pairs = np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype="<u8").reshape(-1, 2)
        t, raw = pairs[:, 0], pairs[:, 1]
        grams = [t * M1]
        if len(t) > 1:
            same = (raw[1:] == raw[:-1]).astype(np.uint64)
            two = (t[:-1] ^ (t[:-1] >> np.uint64(29))) * M2 + t[1:] * M3 + same * M1
            grams.append(two * M1)
            if len(t) > 2:
                grams.append(((two[:-1] ^ (two[:-1] >> np.uint64(31))) * M2 + two[1:]) * M3)
        index, found = np.unique((np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        value = found.astype(np.float64)
        return index, value / math.sqrt(float(value @ value))


def train(labels: DataFrame, docs: DataFrame, key: Column, label: Column, text: Column, per_label: int = 2_000, chars: int = 8_000, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.001) -> dict:
    """The model of label 1 against label 0: frequent words, weights and bias."""
    sample = labelled_sample(labels, docs, key, label.cast("int"), text, per_label, chars)
    documents = Counter(w for _, t in sample for w in set(t.lower().split()))
    frequent = frozenset(w for w, n in documents.items() if n >= max(5, 0.02 * len(sample)))
    features = Features(frequent)
    data = [(y, *features.of(t)) for y, t in sample if y in (0, 1)]
    n, z = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rng = np.random.default_rng(7)
    bias = np.array([1 << BITS])

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    per = Counter(y for y, _, _ in data)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            y, i, x = data[k]
            i, x = np.concatenate([i, bias]), np.concatenate([x, [1.0]])
            w = weights(i)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
            g = (p - y) * x * (len(data) / (2 * per[y]))
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    return {"frequent": frequent, "weights": w[:-1].astype(np.float32), "bias": float(w[-1])}


_features: dict[frozenset, Features] = {}


def score(docs: DataFrame, model: dict, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """Key columns, score (of label 1) and predicted of every row. The model is broadcast:
    1 MB of weights and the frequent words of a bounded sample."""
    schema = T.StructType([docs.schema[k] for k in key_cols] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared, n = docs.sparkSession.sparkContext.broadcast(model), len(key_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m["frequent"] not in _features:
            _features.clear()
            _features[m["frequent"]] = Features(m["frequent"])
        features, w, bias = _features[m["frequent"]], m["weights"], m["bias"]
        for batch in batches:
            scores = []
            for text in batch.column(n):
                i, x = features.of(text.as_py())
                scores.append(1 / (1 + math.exp(-max(-35.0, min(35.0, float(w[i] @ x) + bias)))))
            columns = [*batch.columns[:n], pa.array(scores, type=pa.float64()), pa.array([int(s >= 0.5) for s in scores], type=pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.select(*[F.col(f"`{k}`") for k in key_cols], F.col(f"`{text_col}`")).mapInArrow(run, schema)
