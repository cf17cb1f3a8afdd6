"""Trees by parent ids and spanning forests, in rounds that grow with the logarithm of a path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.session import cut_lineage

#: Edges between components that one task takes at once.
FEW = 1_000_000


def rooted(rows: DataFrame) -> DataFrame:
    """(id, root, depth, cycle) of rows (id, parent) by pointer doubling: in each round every
    row that isn't done looks as far up as the row it points at already does. Any depth is
    reached in the logarithm of it; each round is one checkpointed join.

    A row whose parent is null or not among the rows is a root. Rows on a cycle, or below
    one, have cycle true and no root. Ids are distinct; rows with a null id are left out."""
    own = rows.where("id IS NOT NULL").select("id", "parent")
    known = own.select(F.col("id").alias("known"))
    d = own.join(known, own["parent"] == known["known"], "left")
    state = cut_lineage(d.select("id", F.col("known").alias("up"), F.when(F.col("known").isNull(), F.col("id")).alias("root"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("dist")))
    left, reach = state.where("up IS NOT NULL").count(), 1
    n = left + 1
    while left and reach < 2 * n:
        far = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("root").alias("found"), F.col("dist").alias("more"))
        moved = state.where("up IS NOT NULL").join(far, "up")
        moved = moved.select("id", F.col("next").alias("up"), F.col("found").alias("root"), (F.col("dist") + F.col("more")).alias("dist"))
        state = cut_lineage(state.where("up IS NULL").unionByName(moved))
        left, reach = state.where("up IS NOT NULL").count(), 2 * reach
    done = F.col("up").isNull()
    return state.select("id", F.when(done, F.col("root")).alias("root"), F.when(done, F.col("dist")).alias("depth"), (~done).alias("cycle"))


def _last_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind 0) the edges that still join components, by rising weight; (kind 1) where each
    component goes (a to b)."""
    rows = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("w", "a", "b", "ca", "cb")), strict=True))
    to: dict[int, int] = {}

    def root(c: int) -> int:
        to.setdefault(c, c)
        while to[c] != c:
            to[c] = to[to[c]]
            c = to[c]
        return c

    out = []
    for w, a, b, ca, cb in rows:
        x, y = sorted((root(ca), root(cb)))
        if x != y:
            to[y] = x
            out.append((0, a, b, w))
    out += [(1, c, root(c), None) for c in list(to)]
    columns = list(zip(*out, strict=True)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["kind", "a", "b", "w"])


def spanning_forest(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest of edges (a, b, w) and the component (node, comp) of every
    node, by Boruvka's rounds: each component takes its least edge to another one, ordered
    by (w, a, b), and they merge. Rounds grow with the logarithm of the nodes; when at most
    FEW edges are left, one task takes them. Ids are bigints."""
    e = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    e = cut_lineage(e.withColumns({"ca": F.col("a"), "cb": F.col("b")}))
    comps = nodes.select("node", F.col("node").alias("comp")).distinct()
    kept = e.select("a", "b", "w").limit(0)
    while e.count() > FEW:
        by = F.struct("w", "a", "b")
        both = e.select(F.col("ca").alias("id"), F.col("cb").alias("other"), by.alias("e")).unionByName(e.select(F.col("cb").alias("id"), F.col("ca").alias("other"), by.alias("e")))
        least = cut_lineage(both.groupBy("id").agg(F.min(F.struct("e", "other")).alias("m")).select("id", "m.e", "m.other"))
        kept = cut_lineage(kept.unionByName(least.select("e.a", "e.b", "e.w").distinct()))
        # two components that chose one edge point at each other: the lesser is the root
        back = least.select(F.col("id").alias("other"), F.col("other").alias("id"))
        mutual = least.join(back, ["id", "other"], "left_semi").where("id < other").select(F.col("id").alias("top"))
        parents = least.join(mutual, least["id"] == mutual["top"], "left").select("id", F.when(F.col("top").isNull(), F.col("other")).alias("parent"))
        to = cut_lineage(rooted(parents).select("id", "root"))
        comps = cut_lineage(comps.join(to, comps["comp"] == to["id"], "left").select("node", F.coalesce("root", "comp").alias("comp")))
        for side in ("ca", "cb"):
            t = to.select(F.col("id").alias(side), F.col("root").alias(f"r_{side}"))
            e = e.join(t, side, "left").withColumn(side, F.coalesce(f"r_{side}", side)).drop(f"r_{side}")
        e = cut_lineage(e.where("ca <> cb"))
    rest = cut_lineage(e.repartition(1).mapInArrow(_last_edges, "kind int, a long, b long, w double"))
    to = rest.where("kind = 1").select(F.col("a").alias("id"), F.col("b").alias("root"))
    comps = comps.join(to, comps["comp"] == to["id"], "left").select("node", F.coalesce("root", "comp").alias("comp"))
    return kept.unionByName(rest.where("kind = 0").select("a", "b", "w")), cut_lineage(comps)
