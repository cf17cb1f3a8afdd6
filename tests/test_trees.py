"""Trees by parent ids, spanning forests and density clusters against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.operators import density, trees


def test_rooted_takes_any_depth_and_finds_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(10_000)]  # a chain of 10,000
    rows += [(20_000, 20_001), (20_001, 20_002), (20_002, 20_000), (20_003, 20_000), (30_000, 30_000), (40_000, 99_999), (None, 1), (40_001, 40_000), (40_002, 40_000)]
    got = {r.id: tuple(r)[1:] for r in trees.rooted(spark.createDataFrame(rows, "id long, parent long")).collect()}
    want = {i: (0, i, False) for i in range(10_000)} | {i: (None, None, True) for i in (20_000, 20_001, 20_002, 20_003, 30_000)}
    assert got == want | {40_000: (40_000, 0, False), 40_001: (40_000, 1, False), 40_002: (40_000, 1, False)}
    assert trees.rooted(spark.createDataFrame([], "id long, parent long")).count() == 0


def plain_forest(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    kept = []
    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in edges}):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b, w))
    return sorted(kept), {n: find(n) for n in nodes}


@pytest.mark.parametrize("few", [10**6, 20])
def test_spanning_forest_equals_a_plain_one(spark, monkeypatch, few):
    monkeypatch.setattr(trees, "FEW", few)
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120), float(rng.randrange(6))) for _ in range(200)] + [(200, 201, 1.0), (3, 3, 0.0)]
    nodes = [*range(120), 200, 201, 300]
    forest, comps = trees.spanning_forest(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long, w double"))
    kept, want = plain_forest(nodes, [e for e in edges if e[0] != e[1]])
    assert sorted(map(tuple, forest.collect())) == kept
    groups = {}
    for r in comps.collect():
        groups.setdefault(r.comp, set()).add(r.node)
    assert sorted(map(min, groups.values())) == sorted(set(want.values())) and all(len({want[n] for n in g}) == 1 for g in groups.values())


def plain_clusters(ids, neighbours, min_size, min_points):
    """The condensed tree from the top: cut the heaviest edge, keep what is large enough."""
    near = {}
    for i, o, d in neighbours:
        if i != o:
            near.setdefault(i, []).append((d, o))
    core = {i: sorted(n)[:min_points][-1][0] for i, n in near.items()}
    weight = {}
    for i, o, d in neighbours:
        if i != o:
            k, w = (min(i, o), max(i, o)), max(d, core[i], core.get(o, 0.0))
            weight[k] = min(w, weight.get(k, w))
    kept, comp = plain_forest(ids, [(a, b, w) for (a, b), w in weight.items()])
    topic, tops = dict.fromkeys(ids, -1), []

    def split(points, edges, begun):
        """(stability, chosen clusters) of a cluster of these points."""
        total, points, edges = 0.0, set(points), sorted(edges, key=lambda e: (e[2], e[0], e[1]))
        whole = frozenset(points)
        size = len(points)
        while edges:
            a, b, w = edges.pop()
            at = 1 / w if w else density.DENSEST
            side, todo = {a}, [a]
            links = {}
            for x, y, _ in edges:
                links.setdefault(x, []).append(y)
                links.setdefault(y, []).append(x)
            while todo:
                for y in links.get(todo.pop(), []):
                    if y not in side:
                        side.add(y)
                        todo.append(y)
            halves = [side, points - side]
            if all(len(h) >= min_size for h in halves):
                total += at * len(points)
                lower = [split(h, [e for e in edges if e[0] in h], at) for h in halves]
                return total - size * begun, whole, lower
            if all(len(h) < min_size for h in halves):
                return total + at * len(points) - size * begun, whole, []
            small, points = sorted(halves, key=len)
            total += at * len(small)
            edges = [e for e in edges if e[0] in points]
        raise AssertionError("a cluster ends with an edge")

    def choose(node, may):
        own, whole, lower = node
        below = [choose(c, True) for c in lower]
        value = sum(v for v, _ in below)
        return (own, [whole]) if may and own >= value else (value, [c for _, cs in below for c in cs])

    for c in set(comp.values()):
        members = {n for n in ids if comp[n] == c}
        if len(members) >= min_size:
            tops.append(split(members, [e for e in kept if e[0] in members], 0.0))
    for t in tops:
        for cluster in choose(t, len(tops) > 1)[1]:
            for n in cluster:
                topic[n] = min(cluster)
    return topic


@pytest.mark.parametrize(("seed", "portion"), [(1, 10**6), (3, 90)])
def test_density_clusters_equal_a_plain_version(spark, monkeypatch, seed, portion):
    monkeypatch.setattr(density, "PORTION", portion)
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in zip(rng.uniform(-6, 6, (5, 2)), (0.3, 0.5, 0.2, 1.0, 0.4), (60, 40, 25, 60, 15), strict=True)] + [rng.uniform(-9, 9, (50, 2))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    rows = [(i, int(o), float(d[i, o])) for i in range(len(x)) for o in np.argsort(d[i], kind="stable")[:9] if o != i]
    points = spark.createDataFrame([(i,) for i in range(len(x))] + [(999,), (None,)], "id long")
    got = {r.id: r.topic for r in density.density_clusters(points, spark.createDataFrame(rows, "id long, other long, distance double"), 10, 5).collect()}
    want = plain_clusters([*range(len(x)), 999], rows, 10, 5)
    # a leaf's points that fell before its end belong to it too: compare as sets of members
    assert got == want
    assert got[999] == -1 and len(set(got.values())) > 3 and -1 in set(got.values())


def test_density_clusters_of_nothing_and_of_copies(spark):
    none = spark.createDataFrame([], "id long, other long, distance double")
    assert density.density_clusters(spark.createDataFrame([], "id long"), none).count() == 0
    copies = spark.createDataFrame([(i, o, 0.0) for i in range(30) for o in range(i, min(30, i + 6))] + [(100 + i, 101 + i, 1.0) for i in range(12)], "id long, other long, distance double")
    got = density.density_clusters(copies.select("id").union(copies.select("other")).distinct(), copies, 10, 5).where(F.col("topic") >= 0).groupBy("topic").count().collect()
    assert {r.topic: r["count"] for r in got} == {0: 30, 100: 13}
