"""The quality classifier against a plain FTRL and plain dot products, and its odd cases."""

import math
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from scriptoria.llm import quality_model as q
from scriptoria.llm.samples import labelled_sample

MASK = (1 << 64) - 1
M1, M2, M3 = (int(m) for m in (q.M1, q.M2, q.M3))


def plain_vector(text, frequent):
    """{feature: value} by whole numbers, one n-gram at a time."""
    words = (text or "").split()
    token = lambda w: xxhash.xxh64_intdigest(w.lower() if w.lower() in frequent else "\0" + q.shape(w))
    t = [token(w) for w in words]
    pair = lambda k: ((t[k] ^ t[k] >> 29) * M2 + t[k + 1] * M3 + (words[k] == words[k + 1]) * M1) & MASK
    two = [pair(k) for k in range(len(t) - 1)]
    grams = [x * M1 & MASK for x in t] + [x * M1 & MASK for x in two] + [((two[k] ^ two[k] >> 31) * M2 + two[k + 1]) * M3 & MASK for k in range(len(two) - 1)]
    counts = Counter(g >> 64 - q.BITS for g in grams)
    size = math.sqrt(sum(n * n for n in counts.values()))
    return {i: n / size for i, n in counts.items()}


def plain_model(sample, epochs=3, alpha=0.5, beta=1.0, l1=0.0005, l2=0.001):
    """Weights by feature, the bias at None: one coordinate after the other."""
    documents = Counter(w for _, t in sample for w in set(t.lower().split()))
    frequent = {w for w, n in documents.items() if n >= max(5, 0.02 * len(sample))}
    data = [(y, plain_vector(t, frequent) | {None: 1.0}) for y, t in sample]
    per, n, z = Counter(y for y, _ in data), Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            y, x = data[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v * len(data) / (2 * per[y])
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return frequent, {i: weight(i) for i in z}


def fixture(spark):
    rng = random.Random(3)
    words = "the of and a reader finds clear sentences about rivers 12 ICE cores x9 ## !! buy now".split()
    rows = []
    for i in range(80):
        good = i % 2
        pool = words[:12] if good else words[4:]
        rows.append((i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) + ("." if good else "!!!"), good))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_training_and_scores_equal_a_plain_version(spark):
    df = fixture(spark)
    model = q.train(df, df, F.col("doc_id"), F.col("quality"), F.col("text"))
    frequent, weights = plain_model(labelled_sample(df, df, F.col("doc_id"), F.col("quality"), F.col("text"), 2_000, 8_000))
    assert model["frequent"] == frequent and len(frequent) > 5
    assert all(abs(model["weights"][i] - w) < 1e-5 for i, w in weights.items() if i is not None) and abs(model["bias"] - weights[None]) < 1e-5
    assert np.count_nonzero(model["weights"]) == sum(w != 0 for i, w in weights.items() if i is not None)
    long_text = "the reader finds ## " * 40_000
    odd = [(100, None), (101, ""), (102, "one"), (103, "ICE ICE  ice"), (104, long_text), (103, "ICE ICE  ice"), (None, "of rivers")]
    asked = df.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumns({"score": F.lit("clash"), "predicted": F.lit("clash")})
    got = q.score(asked.select("doc_id", "text", "score"), model, ["doc_id"]).collect()
    text = {r.doc_id: r.text for r in asked.collect()}
    assert len(got) == 87
    for r in got:
        x = plain_vector(text[r.doc_id], frequent)
        want = 1 / (1 + math.exp(-(sum(weights.get(i, 0.0) * v for i, v in x.items()) + weights[None])))
        assert abs(r.score - want) < 1e-5 and r.predicted == int(r.score >= 0.5)
    assert q.score(asked.limit(0), model, ["doc_id"]).count() == 0
