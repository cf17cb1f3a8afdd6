"""Versions of drafts, provenance, merges of JSON columns, union of pools, near-duplicate chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.operators.vectors import cosine
from scriptoria.session import cut_lineage


def resolved(refs: DataFrame, drafts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(ref, kind, id) of version references: "chapter:section:vN", "chapter:section:latest",
    "chapter:section", or an id or prefix of six characters or more, looked for in drafts
    (id, chapter, section, version, is_active, content) and then in snapshots (id). The
    latest is the active one, then one with 50 characters, then the highest version; a
    prefix of several rows resolves to nothing."""
    part = lambda k: F.get(F.split("ref", ":"), F.lit(k))
    named = refs.where(F.contains("ref", F.lit(":"))).select("ref", part(0).try_cast("int").alias("chapter"), part(1).alias("section"), F.coalesce(part(2), F.lit("latest")).alias("v"), F.size(F.split("ref", ":")).alias("n")).where("n <= 3")
    number = F.regexp_replace("v", "^v+", "").try_cast("int")
    last = F.col("v").isin("latest", "active", "")
    hit = named.join(drafts, ["chapter", "section"]).where(last | (F.col("version") == number))
    order = [F.desc(F.coalesce("is_active", F.lit(False))), F.coalesce(F.length("content") < 50, F.lit(True)).cast("int"), F.desc("version"), F.asc("id")]
    by_name = hit.withColumn("_r", F.row_number().over(Window.partitionBy("ref").orderBy(*order))).where("_r = 1").select("ref", F.lit("draft").alias("kind"), "id")
    short = refs.where(~F.contains("ref", F.lit(":")) & (F.length("ref") >= 6)).select("ref", F.substring("ref", 1, 6).alias("head"))

    def by_prefix(rows: DataFrame, kind: str) -> DataFrame:
        # an equi-join on the first six characters, then the rest of the prefix
        met = short.join(rows.select("id", F.substring("id", 1, 6).alias("head")), "head").where(F.startswith("id", "ref"))
        return met.groupBy("ref").agg(F.count("*").alias("n"), F.min("id").alias("id")).select("ref", "n", F.lit(kind).alias("kind"), "id")

    in_drafts = by_prefix(drafts, "draft")
    in_snapshots = by_prefix(snapshots, "snapshot").join(in_drafts, "ref", "left_anti")
    return by_name.unionByName(in_drafts.unionByName(in_snapshots).where("n = 1").drop("n"))


def centroid_drift(vectors: DataFrame, order_col: str, vector_col: str) -> DataFrame:
    """(order, n, drift_cosine, drift_delta): each step's centroid of all vectors up to it
    against the one before; null for the first."""
    parts = vectors.select(order_col, F.posexplode(vector_col).alias("i", "x")).groupBy(order_col, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("i").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)  # a row for each step
    running = parts.select(order_col, "i", F.sum("n").over(w).alias("n"), (F.sum("s").over(w) / F.sum("n").over(w)).alias("m"))
    c = running.groupBy(order_col).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    before = F.lag("c").over(Window.orderBy(order_col))
    d = c.withColumn("drift_cosine", F.when(before.isNotNull(), F.round(cosine(F.col("c"), before), 5)))
    return d.select(order_col, "n", "drift_cosine", F.round(1 - F.col("drift_cosine"), 5).alias("drift_delta"))


def provenance(existing: DataFrame, records: DataFrame, keep: int = 10) -> DataFrame:
    """(doc, source, round, subtopic, history) after records (doc, at, source, round,
    subtopic) come in order on existing rows of the same form: a record that differs from
    the one before archives it; of the archive the last `keep` stay, as a history is for display."""
    r = existing.select("doc", F.lit(None).cast("timestamp").alias("at"), "source", "round", "subtopic").unionByName(records.select("doc", "at", "source", "round", "subtopic"))
    w = Window.partitionBy("doc").orderBy(F.asc_nulls_first("at"))
    same = lambda: F.struct("source", "round", "subtopic")
    d = r.withColumn("_next", F.lead(same()).over(w)).withColumn("_last", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc_nulls_last("at"))) == 1)
    archived = F.when(F.col("_next").isNotNull() & ~same().eqNullSafe(F.col("_next")), F.struct(F.coalesce("at", F.lit("1970-01-01").cast("timestamp")).alias("at"), "source", "round", "subtopic"))
    g = d.groupBy("doc").agg(F.max(F.when(F.col("_last"), same())).alias("now"), F.array_sort(F.collect_list(archived)).alias("h"))
    history = F.transform(F.slice("h", F.greatest(F.lit(1), F.size("h") - keep + 1), F.lit(keep)), lambda x: x["source"])
    return g.select("doc", "now.source", "now.round", "now.subtopic", history.alias("history"))


def merged_json(base: Column, update: Column) -> Column:
    """Top-level merge of two JSON objects, the update's values winning; keys in order."""
    kind = "map<string,string>"
    a, b = (F.coalesce(F.from_json(c, kind), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) for c in (base, update))
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, b)))))


def pooled(pools: list[DataFrame], key: str) -> DataFrame:
    """Union of pools by precedence: of rows with one key the first pool's stays."""
    u = None
    for k, p in enumerate(pools):
        p = p.withColumn("_pool", F.lit(k))
        u = p if u is None else u.unionByName(p)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_pool"))
    return u.withColumn("_r", first).where("_r = 1").drop("_r").withColumnRenamed("_pool", "pool")


def near_duplicate_chunks(chunks: DataFrame, threshold: float = 0.92, wave: int = 2048) -> DataFrame:
    """Ids to delete of chunks (id, bucket, vector, size): within a bucket, longest first
    (ties by id), a chunk goes if its cosine with one that stays reaches the threshold.

    Each round takes the first `wave` remaining chunks of every bucket, settles them among
    themselves in one task, and drops what is near to those that stay from the rest of the
    bucket, where they arrive as one packed matrix a bucket. So a task holds at most a wave
    of a bucket, no pairs are made, and the result is that of the greedy pass over the whole
    bucket. Vectors without a norm, or of another length than the bucket's first, stay."""
    rest = cut_lineage(chunks.select("id", "bucket", F.col("vector").cast("array<double>").alias("vector"), "size"))
    kinds = dict(rest.dtypes)
    gone = None

    def unit(rows) -> np.ndarray:
        width = max((len(v) for v in rows if v is not None), default=0)
        m = np.array([v if v is not None and len(v) == width else np.zeros(width) for v in rows], dtype=np.float64).reshape(len(rows), width)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "id"], ascending=[False, True])
        m = unit(rows["vector"].tolist())
        near = m @ m.T >= threshold - 1e-12
        stays = np.ones(len(rows), dtype=bool)
        for i in range(len(rows)):
            if stays[i]:
                stays[i + 1 :] &= ~near[i, i + 1 :]
        return pd.DataFrame({"id": rows["id"], "bucket": rows["bucket"], "stays": stays})

    def far(batches):
        import pyarrow as pa

        for batch in batches:
            d = pa.Table.from_batches([batch]).to_pandas()
            keep = np.ones(len(d), dtype=bool)
            for i, (v, packed) in enumerate(zip(d["vector"], d["packed"], strict=True)):
                x = unit([v])[0]
                m = np.frombuffer(packed, dtype=np.float64)
                if len(x) and len(m) and len(m) % len(x) == 0:
                    keep[i] = not (m.reshape(-1, len(x)) @ x >= threshold - 1e-12).any()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keep)], names=["id", "far"])

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "packed": [unit(rows["vector"].tolist()).tobytes()]})

    while not rest.isEmpty():
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("size"), "id"))
        numbered = cut_lineage(rest.withColumn("_place", place))
        first = numbered.where(F.col("_place") <= wave).drop("_place")
        settled = cut_lineage(first.groupBy("bucket").applyInPandas(settle, f"id {kinds['id']}, bucket {kinds['bucket']}, stays boolean"))
        lost = settled.where("NOT stays").select("id")
        rest = numbered.where(F.col("_place") > wave).drop("_place")
        kept = first.join(settled.where("stays").select("id"), "id", "left_semi")
        matrices = kept.groupBy("bucket").applyInPandas(packed, f"bucket {kinds['bucket']}, packed binary")
        near = rest.join(matrices, "bucket").select("id", "vector", "packed").mapInArrow(far, f"id {kinds['id']}, far boolean").where("NOT far").select("id")
        lost = cut_lineage(lost.union(near))
        gone = lost if gone is None else gone.union(lost)
        rest = cut_lineage(rest.join(lost, "id", "left_anti"))
    return gone if gone is not None else rest.select("id")


def promoted(lessons: DataFrame, known: DataFrame, threshold: float = 0.85, min_books: int = 2) -> DataFrame:
    """(text, members, books) of lessons (id, book, text, vector, importance, at) to share: in
    order of importance and time a lesson joins the first bucket whose first member is near
    enough. Buckets of min_books books that are near to none of known (vector) give their
    most important, then longest text. The pass is sequential by nature and runs over the
    candidates of one library, which are few by their importance gate."""

    def buckets(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["importance", "id"], ascending=[False, True])
        m = np.array(rows["vector"].tolist(), dtype=np.float64)
        m = m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
        reps: list[int] = []
        of = []
        for i in range(len(m)):
            near = [k for k, r in enumerate(reps) if float(m[r] @ m[i]) >= threshold]
            if not near:
                reps.append(i)
            of.append(near[0] if near else len(reps) - 1)
        rows = rows.assign(bucket=of, chars=rows["text"].str.len())
        best = rows.sort_values(["importance", "chars", "id"], ascending=[False, False, True]).groupby("bucket").first()
        count = rows.groupby("bucket").agg(members=("id", "size"), books=("book", "nunique"))
        return pd.DataFrame({"library": rows["library"].iloc[0], "text": best["text"], "members": count["members"], "books": count["books"], "vector": [m[reps[k]].tolist() for k in best.index]})

    b = lessons.groupBy("library").applyInPandas(buckets, "library long, text string, members long, books long, vector array<double>").where(F.col("books") >= min_books)
    near = F.exists("known", lambda v: cosine(F.col("vector"), v) >= threshold)
    g = known.groupBy("library").agg(F.collect_list(F.col("vector").cast("array<double>")).alias("known"))
    return b.join(g, "library", "left").where(F.col("known").isNull() | ~near).select("library", "text", "members", "books")
