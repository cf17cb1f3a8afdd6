"""Hard negatives, SimHash near-dedup and the prefix trie against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptoria.llm import hard_negatives, prefix_trie, simhash
from scriptoria.llm.queries import QUERIES
from scriptoria.session import table

SMALL = "/root/testdata/sf0.001"


def plain_negatives(rows):
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(x))) for x in v]
        if sum(x * x for x in q) >= 2**53:
            continue
        seen[i] = min(seen.get(i, ((label + 1) % 10 if i % 7 == 0 else label, q)), ((label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    for a in (i for i in seen if i % 100 == 0):
        scored = sorted((-sum(x * y for x, y in zip(seen[a][1], q, strict=False)), i, label == seen[a][0]) for i, (label, q) in seen.items() if i != a)
        for p, pos, _ in [s for s in scored if s[2]][:5]:
            window = [s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, pos, r, i, -p, -s) for r, (s, i, _) in enumerate(window, 1)]
    return sorted(out)


def mined(df):
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("id") % 100 == 0, moved).collect()))


def test_hard_negatives_equal_a_plain_version(spark):
    df = table(spark, SMALL, "embeddings")
    assert mined(df) == plain_negatives([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


def test_hard_negatives_cases(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.randrange(3)) for i in range(600)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(400)]  # a vector that many rows share: ties
    rows += [rows[100], (100, [9.0, 0.0, 0.0, 0.0], 2), (1500, [1.0, 2.0], 1), (1600, [], 1), (1700, [1.0] * 7, 0)]
    rows += [(None, [1.0], 1), (2000, None, 1), (2100, [1.0, None], 1), (2200, [float("nan")], 1), (2300, [float("inf")], 1), (2400, [1.0], None), (2500, [1e30], 1), (-300, [1.0, 1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit("clash"), "list": F.lit(1), "score": F.lit(0)})
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "CHUNK", 4)
    got = mined(df)
    assert got and got == plain_negatives(rows)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id = 100")) == []


def test_bounds_hold_and_skip(spark):
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([rng.normal(c, 0.05, (200, 8)) for c in rng.normal(0, 1, (12, 8))]))
    c = hard_negatives.fit(x.tolist(), 12)
    own, far = hard_negatives.nearest(x, c)
    bounds = hard_negatives.Bounds(c, np.array([far[own == i].max() for i in range(len(c))]), np.bincount(own, minlength=len(c)))
    visited = 0
    for a in x[::50]:
        low, high = bounds.of(a)
        assert ((x @ a >= low[own]) & (x @ a <= high[own])).all()
        kth = int(np.sort(x @ a)[-5])
        one, two = bounds.visits(a, [-(1 << 62)], [1 << 62], [kth], 1)
        assert set(own[x @ a >= kth]) <= {*one, *two}
        visited += len(one) + len(two)
    assert visited < len(x[::50]) * len(c) / 2


def plain_fingerprint(text, n=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in lowered).split(" ") if w]
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(prints, radius):
    values = sorted(set(prints.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[find(a)] = find(b)
    least = {}
    for k, v in prints.items():
        least[find(v)] = min(k, least.get(find(v), k))
    return {k: least[find(v)] for k, v in prints.items()}


def test_fingerprints_equal_a_plain_version(spark):
    for t in (None, "", " \n", "One", "a B c d e", "x y z\tÄ w\x0bq é É", "the cat sat on the mat " * 40, "\ud800 broken".encode("utf-8", "replace").decode()):
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert spark.sql("SELECT xxhash64('a b c d') AS h").first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c d", simhash.SEED)


def test_simhash_query_equals_brute_force(spark):
    got = QUERIES["op12_simhash"](spark, SMALL).collect()
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == {k: plain_fingerprint(t) for k, t in docs.items()}
    assert all(len(r.fingerprint) == 16 for r in got)
    assert {r.doc_id: r.component_id for r in got} == plain_components({r.doc_id: int(r.fingerprint, 16) for r in got}, 4)


@pytest.mark.parametrize("short", [1, 64])
def test_simhash_links_miss_nothing(spark, short):
    rng = random.Random(short)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:12]:  # near copies, chains of them, and one dense group
        for _ in range(6):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            values.append(v)
    values += [values[0] ^ 1 << a ^ 1 << b for a in range(16) for b in range(a)] + [0, (1 << 64) - 1, 0b11111]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = simhash.links(df.repartition(3), 4, sample_rows=32, short=short, block=16).collect()
    assert all((r.u % 2**64 ^ r.v % 2**64).bit_count() <= 4 for r in found)
    assert len(found) < 60 * len(signed)
    parent = {v: v for v in signed}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in found:
        parent[find(r.u)] = find(r.v)
    want = plain_components({v: v % 2**64 for v in signed}, 4)
    groups = {}
    for v in signed:
        groups.setdefault(find(v), []).append(v)
    assert {v: min(g) for g in groups.values() for v in g} == want


def test_thresholds_are_the_cheapest_split():
    rng = np.random.default_rng(2)
    costs = rng.random((50, 3, 6)).cumsum(axis=2)
    chosen = simhash.budgets(costs, 4)
    assert ((chosen + 1).sum(axis=1) == 5).all() and (chosen >= -1).all()
    for c, t in zip(costs, chosen, strict=True):
        every = [c[0, i] + c[1, j] + c[2, 5 - i - j] for i in range(6) for j in range(6 - i)]
        assert np.isclose(c[np.arange(3), t + 1].sum(), min(every))


def test_simhash_cases(spark):
    long_text = "word " * 70_000 + "end"
    rows = [(1, None), (2, ""), (3, "  "), (None, "same text here now"), (7, "same text here now"), (7, "same text here now"), (9, "SAME text\there now"), (11, long_text), (4, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("clash"), "fp": F.lit(0), "least": F.lit(0)})
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert [r.fingerprint for r in got if r.doc_id in (1, 2, 3)] == ["0" * 16] * 3
    assert {r.component_id for r in got if r.doc_id in (None, 7, 9)} == {7}
    assert int(next(r.fingerprint for r in got if r.doc_id == 11), 16) == plain_fingerprint(long_text)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert [r.component_id for r in simhash.near_duplicates(spark.createDataFrame([(None, "x")], "doc_id long, text string")).collect()] == [None]


def plain_trie(rows):
    said = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", said(role or "", text or ""), text or ""))
    convs = {c: [(x[2], x[4]) for x in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    nodes, kids = {}, {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes.setdefault(built[c][:d], []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids.get(p, []))
        ends = ",".join(str(c) for c in nodes[p] if len(built[c]) == len(p))
        out.append((nodes[p][0], len(p), nodes[p[:-1]][0] if p else None, len(nodes[p]), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built_trie(df):
    return sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=str)


@pytest.mark.parametrize("records", [4096, 8])
def test_trie_equals_a_plain_version(spark, monkeypatch, records):
    monkeypatch.setattr(prefix_trie, "RANGE_RECORDS", records)  # 8: many ranges and rounds
    df = table(spark, SMALL, "conversations")
    assert built_trie(df) == plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("records", [4096, 8])
def test_trie_cases(spark, monkeypatch, records):
    monkeypatch.setattr(prefix_trie, "RANGE_RECORDS", records)
    rng = random.Random(records)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "hi", "ok", "Ä€"])) for c in range(0, 130) for t in range(rng.randrange(7))]
    rows += [(1000 + c, t, "user", "one conversation") for c in range(150) for t in range(2)]  # many whole copies
    rows += [(5, 0, "user", "again"), (5, 0, "user", "again"), (6, None, "user", "first"), (6, None, "a", "tie"), (None, 0, "user", "nobody"), (-250, 1, "user", "minus"), (-200, 0, "x", "base")]
    rows += [(3000, t, "user", f"turn {t}") for t in range(300)] + [(3001, t, "user", f"turn {t}") for t in range(301)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"own": F.lit("clash"), "key": F.lit(1), "e": F.lit(2)})
    assert built_trie(df) == plain_trie(rows)
    assert built_trie(df.limit(0)) == []


def test_loser_tree_merges_with_true_lcps():
    rng = random.Random(4)
    element = [bytes([i]) * prefix_trie.ELEMENT for i in range(3)]
    for k in (1, 2, 3, 7):
        runs, every = [], []
        for r in range(k):
            run = sorted((b"".join(rng.choice(element) for _ in range(rng.randrange(6))), 100 * i + r) for i in range(rng.randrange(9)))
            every += run
            runs.append([(*x, prefix_trie.shared(run[i - 1][0], x[0]) if i else 0, None) for i, x in enumerate(run)])
        got = [(lcp, x[:2]) for lcp, x in prefix_trie.LoserTree(runs)]
        assert [x for _, x in got] == sorted(every)
        assert all(lcp == prefix_trie.shared(a[0], b[0]) for (_, a), (lcp, b) in zip(got, got[1:], strict=False))
