"""Density clustering: mutual reachability, a minimum spanning forest, a condensed tree.

From a graph of nearest neighbours (id, other, distance):

1. A point's core distance is that to its `min_points`-th neighbour (the farthest known one
   where it has fewer); an edge weighs the greatest of its length and its ends' core distances.
2. Boruvka's rounds leave the minimum spanning forest.
3. The forest's edges merge components by rising weight d, at density 1 / d. A component
   of min_size points is a cluster; a smaller one that joins a cluster has left it at that
   density; where two clusters meet, both end and their parent begins. So each cluster
   has a stability: the sum over its points of the density at which they leave it, less the
   density at which it begins.
4. A cluster is chosen if its stability is that of its chosen descendants or more (the
   excess of mass). Points of no chosen cluster are noise, topic -1.

Edges are merged in portions of at most PORTION of rising weight; within a portion every
connected part is a group of its own, so no task holds more than a portion. Between
portions only components (one row each) go on. The condensed tree of a part, one row a
cluster, is weighed in one task.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.operators.trees import spanning_forest
from scriptoria.session import cut_lineage

#: Edges that a task merges at most.
PORTION = 1_000_000
#: The density of points at no distance.
DENSEST = 1e12

_COMP = (("comp", pa.int64()), ("size", pa.int64()), ("cluster", pa.string()), ("left_at", pa.float64()))
#: kind 0: a component's state (comp, size, cluster, left_at); 1: comp goes over to `into`;
#: 2: cluster has ended with `size` points, its parent `other` has begun at density `at`; 3: the
#: points of component comp belong to cluster.
_OUT = (("kind", pa.int32()), ("comp", pa.int64()), ("into", pa.int64()), ("size", pa.int64()), ("cluster", pa.string()), ("other", pa.string()), ("left_at", pa.float64()), ("at", pa.float64()))
_OUT_DDL = "kind int, comp long, into long, size long, cluster string, other string, left_at double, at double"


def mutual_reachability(neighbours: DataFrame, min_points: int) -> DataFrame:
    """(a, b, w) of neighbour rows (id, other, distance)."""
    n = neighbours.where("id <> other")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    core = cut_lineage(n.withColumn("r", rank).where(F.col("r") <= min_points).groupBy("id").agg(F.max("distance").alias("core")))
    both = n.join(core, "id").join(core.select(F.col("id").alias("other"), F.col("core").alias("core_other")), "other", "left")
    return both.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.greatest("distance", "core", F.coalesce("core_other", F.lit(0.0))).alias("w"))


class Merging:
    """Components as edges of rising weight merge them. A cluster is named by the edge that
    it begins with."""

    def __init__(self, min_size: int) -> None:
        self.min_size = min_size
        self.parent: dict[int, int] = {}
        self.state: dict[int, tuple[int, str | None, float]] = {}  # size, cluster, sum of the densities left at
        self.inside: dict[int, list[int]] = {}  # of a component without cluster, so fewer than min_size
        self.rows: list[tuple] = []

    def add(self, comp: int, size: int, cluster: str | None, left_at: float) -> None:
        self.parent[comp], self.state[comp] = comp, (size, cluster, left_at)
        if cluster is None:
            self.inside[comp] = [comp]

    def root(self, c: int) -> int:
        while self.parent[c] != c:
            self.parent[c] = self.parent[self.parent[c]]
            c = self.parent[c]
        return c

    def merge(self, a: int, b: int, w: float, name: str) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        if a == b:
            return
        at = 1 / w if w > 1 / DENSEST else DENSEST
        (m, x, sx), (n, y, sy) = self.state[a], self.state.pop(b)
        size, loose = m + n, self.inside.pop(a, []) + self.inside.pop(b, [])
        if x is not None and y is not None:  # both end, their parent begins
            self.rows += [(2, None, None, k, c, name, s, at) for c, k, s in ((x, m, sx), (y, n, sy))]
            cluster, left, loose = name, size * at, []
        elif x is not None or y is not None:
            cluster, left = (x, sx + n * at) if x is not None else (y, sy + m * at)
        elif size >= self.min_size:
            cluster, left = name, size * at
        else:
            cluster, left, self.inside[a] = None, 0.0, loose
        if cluster is not None:
            self.rows += [(3, c, None, None, cluster, None, None, at) for c in loose]
        self.state[a], self.parent[b] = (size, cluster, left), a


def _merged(min_size: int):
    """A task: the edges of one connected part merge its components."""

    def run(comps: pa.Table, edges: pa.Table) -> pa.Table:
        m = Merging(min_size)
        for row in zip(*(comps.column(n).to_pylist() for n, _ in _COMP), strict=True):
            m.add(*row)
        for w, a, b, ca, cb in sorted(zip(*(edges.column(n).to_pylist() for n in ("w", "a", "b", "ca", "cb")), strict=True)):
            m.merge(ca, cb, w, f"{a}-{b}")
        rows = m.rows + [(0, c, None, size, cluster, None, left, None) for c, (size, cluster, left) in m.state.items()] + [(1, c, m.root(c), *[None] * 5) for c in list(m.parent)]
        return pa.table([pa.array(c, type=k) for c, (_, k) in zip(zip(*rows, strict=True), _OUT, strict=True)], names=[n for n, _ in _OUT])

    return run


def condensed(points: DataFrame, forest: DataFrame, comps: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """The condensed tree of a spanning forest: clusters (part, cluster, parent, size,
    stability) and the innermost cluster (node, cluster) of each point that is in one."""
    state = points.select(F.col("node").alias("comp"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("cluster"), F.lit(0.0).alias("left_at"))
    at = cut_lineage(points.select("node", F.col("node").alias("comp")))
    parts = max(1, -(-forest.count() // PORTION))
    cuts = sorted(set(forest.approxQuantile("w", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    ended, inner = [], []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        e = forest if low is None else forest.where(F.col("w") > low)
        e = e if high is None else e.where(F.col("w") <= high)
        for end in ("a", "b"):
            e = e.join(at.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}")), end)
        e = cut_lineage(e)
        if cuts:
            ends = e.select(F.col("ca").alias("node")).union(e.select("cb"))
            groups = spanning_forest(ends, e.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w"))[1]
        else:  # whole trees
            groups = comps
        groups = groups.select(F.col("node").alias("member"), F.col("comp").alias("part"))
        mine = state.join(groups, state["comp"] == groups["member"]).select("part", "comp", "size", "cluster", "left_at")
        theirs = e.join(groups, e["ca"] == groups["member"]).select(F.col("part").alias("of"), "a", "b", "ca", "cb", "w")
        out = cut_lineage(mine.groupBy("part").cogroup(theirs.groupBy("of")).applyInArrow(_merged(min_size), _OUT_DDL))
        # events name components as they were before this portion
        inner.append(at.join(out.where("kind = 3").select("comp", "cluster"), "comp").select("node", "cluster"))
        ended.append(out.where("kind = 2").select("cluster", F.col("other").alias("parent"), "size", "left_at", "at"))
        rest = state.join(groups, state["comp"] == groups["member"], "left_anti")
        state = cut_lineage(rest.unionByName(out.where("kind = 0").select("comp", "size", "cluster", "left_at")))
        at = cut_lineage(at.join(out.where("kind = 1").select("comp", "into"), "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")))
    tops = state.where("cluster IS NOT NULL").select("cluster", F.lit(None).cast("string").alias("parent"), "size", "left_at", F.lit(0.0).alias("at"))
    every = reduce(DataFrame.unionByName, ended, tops).withColumn("begun", F.substring_index("cluster", "-", 1).cast("long"))
    every = every.join(comps.select(F.col("node").alias("begun"), F.col("comp").alias("part")), "begun")
    stability = F.col("left_at") - F.col("size") * F.col("at")
    return cut_lineage(every.select("part", "cluster", "parent", "size", stability.alias("stability"))), cut_lineage(reduce(DataFrame.unionByName, inner))


def _chosen(tops: bool):
    """A task: for each cluster of a part the chosen cluster that it lies in, if any."""

    def run(table: pa.Table) -> pa.Table:
        names, parents, stability = (table.column(c).to_pylist() for c in ("cluster", "parent", "stability"))
        up, own = dict(zip(names, parents, strict=True)), dict(zip(names, stability, strict=True))
        below: dict[str | None, list[str]] = {}
        for c, p in up.items():
            below.setdefault(p, []).append(c)
        order = list(below.get(None, []))
        for c in order:  # grows: parents before children
            order += below.get(c, [])
        best, whole = {}, {}
        for c in reversed(order):
            lower = sum(best[k] for k in below.get(c, []))
            whole[c] = own[c] >= lower and (tops or up[c] is not None)
            best[c] = own[c] if whole[c] else lower
        of: dict[str, str | None] = {}
        for c in order:
            above = of.get(up[c]) if up[c] is not None else None
            of[c] = above if above is not None else c if whole[c] else None
        return pa.table([pa.array(order, type=pa.string()), pa.array([of[c] for c in order], type=pa.string())], names=["cluster", "chosen"])

    return run


def density_clusters(points: DataFrame, neighbours: DataFrame, min_size: int = 10, min_points: int = 5) -> DataFrame:
    """(id, topic) of points (id) with their neighbours (id, other, distance): topic is the
    least id of the cluster, -1 for noise. Where the graph hangs together, the cluster of all
    points isn't a choice. Points without neighbours are noise; null ids are left out."""
    nodes = cut_lineage(points.where("id IS NOT NULL").select(F.col("id").alias("node")).distinct())
    forest, comps = spanning_forest(nodes, mutual_reachability(neighbours, min_points))
    clusters, inner = condensed(nodes, forest, comps, min_size)
    several = clusters.where("parent IS NULL").limit(2).count() > 1
    chosen = clusters.groupBy("part").applyInArrow(_chosen(several), "cluster string, chosen string").where("chosen IS NOT NULL")
    members = cut_lineage(inner.join(chosen, "cluster").select("node", "chosen"))
    named = members.join(members.groupBy("chosen").agg(F.min("node").alias("topic")), "chosen").select("node", "topic")
    return nodes.join(named, "node", "left").select(F.col("node").alias("id"), F.coalesce("topic", F.lit(-1)).alias("topic"))
