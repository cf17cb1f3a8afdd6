"""Hybrid retrieval: query clean-up, lexical leg, rank fusion, boosts, context packing.

Ranked lists are DataFrames (id, rank) with rank from 1; they hold at most the k rows
of a leg, so fusion and boosts work on small inputs whatever the corpus' size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions.text import bound
from scriptoria.session import cut_lineage

# Signs of a pasted prompt in a query.
PROMPT_HINTS = ("you are a", "your task is", "your role is", "<|system|>", "### instruction", "### system", "<system>", "assistant:", "human:")
# Weights of paper types.
PAPER_TYPE_WEIGHTS = {"peer_reviewed": 1.0, "preprint": 1.0, "thesis": 1.0, "book_chapter": 1.0, "editorial": 0.7, "policy": 0.7, "unknown": 0.8, "opinion": 0.4}
# Kinds of visuals that suit a section.
SECTION_KINDS = {
    "introduction": ("figure",),
    "methods": ("figure",),
    "results": ("chart", "table", "figure"),
    "discussion": ("chart", "figure"),
    "conclusion": ("chart", "figure"),
    "related_work": ("figure",),
    "appendix": ("chart", "table", "figure", "equation", "code"),
}


def sanitised(query: Column, short: int = 400, longest: int = 500) -> Column:
    """struct(clean, method): short queries pass; else the last question, the last two
    sentences, or the tail."""
    q = F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\s+|\s+$", ""))
    prompt = reduce(lambda a, b: a | b, [F.contains(F.lower(q), F.lit(h)) for h in PROMPT_HINTS])
    question = F.trim(F.regexp_extract(q, r"(?s)([^.!?\n]*\?)[^?]*$", 1))
    sentences = F.split(q, r"(?<=[.!?])\s+")
    tail = F.trim(F.array_join(F.slice(sentences, F.greatest(F.lit(1), F.size(sentences) - 1), F.lit(2)), " "))
    result = lambda c, m: F.struct(c.alias("clean"), F.lit(m).alias("method"))
    return (
        F.when((F.length(q) <= short) & ~prompt, result(q, "passthrough"))
        .when((F.length(question) >= 5) & (F.length(question) <= longest), result(question, "question_extraction"))
        .when((F.length(tail) > 0) & (F.length(tail) <= longest), result(tail, "tail_sentence"))
        .otherwise(result(F.trim(F.substring(q, -longest, longest)), "tail_truncate"))
    )


def tokens(text: Column) -> Column:
    """Lower-case letter-and-digit tokens."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def cover_densities(docs: np.ndarray, terms: np.ndarray, places: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(docs with all terms, their cover density) from one row for each place: the doc, the
    term (0 to n_terms - 1) and the place. Every minimal span that holds all terms adds
    0.1 * (1 / (1 + the other words inside it)). All docs are folded at once: `first` is
    where the latest places of all terms begin, and a span is new where it moves on."""
    order = np.lexsort((places, docs))
    docs, terms, places = docs[order], terms[order], places[order]
    k = np.arange(len(docs))
    begin = np.searchsorted(docs, docs, side="left")
    first = k.copy()
    for t in range(n_terms):
        first = np.minimum(first, np.maximum.accumulate(np.where(terms == t, k, -1)))
    whole = first >= begin
    before = np.concatenate([[-1], first[:-1]])
    new = np.flatnonzero(whole & (first > np.where(before >= begin, before, -1)))
    other = places[new] - places[first[new]] - (new - first[new])
    found, at = np.unique(docs[new], return_inverse=True)
    return found, np.bincount(at, weights=0.1 / (1 + np.maximum(0, other)), minlength=len(found))


def cover_density(positions: list[list[int]]) -> float:
    """Cover density of one text: positions holds each query term's places."""
    terms = np.repeat(np.arange(len(positions)), [len(p) for p in positions])
    places = np.array([x for p in positions for x in p], dtype=np.int64)
    score = cover_densities(np.zeros(len(terms), dtype=np.int64), terms, places, len(positions))[1]
    return float(score[0]) if len(score) else 0.0


def query_terms(query: str) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def full_text(docs: DataFrame, id_col: str, text_col: str, query: str, k: int, where: Column | None = None) -> DataFrame:
    """Lexical leg without an index: rows that hold all query terms, ranked by cover
    density, then id."""
    terms = query_terms(query)
    rows = docs if where is None else docs.where(where)
    # a text without a term's letters can't have the term: cheap, and before the split
    rows = rows.where(reduce(lambda a, b: a & b, [F.contains(F.lower(F.col(text_col)), F.lit(t)) for t in terms], F.lit(True)))

    def places(t: Column) -> Column:
        of = lambda term: F.filter(F.transform(t, lambda x, i: F.when(x == term, i)), lambda x: x.isNotNull())
        return F.array(*[of(term) for term in terms])

    found = rows.select(F.col(id_col).alias("id"), F.lit(None).cast("double").alias("sparse"), bound(tokens(F.col(text_col)), places).alias("p"))
    return _scored(found, len(terms)).orderBy(F.desc("score"), "id").limit(k).select("id", "score")


def _scored(rows: DataFrame, terms: int) -> DataFrame:
    """(leg, id, score) from rows (id, sparse, p): the sparse score where there is one, and
    the cover density of p, the places of each term, where it has all terms."""
    flat = rows.select("id", "sparse", F.transform("p", lambda x: F.size(x)).alias("sizes"), F.flatten("p").alias("places"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sparse = batch.column(0), batch.column(1)
            sizes = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, terms) if terms else np.zeros((len(ids), 0), dtype=np.int64)
            owner = np.repeat(np.arange(len(ids) * terms), sizes.ravel())
            found, score = cover_densities(owner // max(1, terms), owner % max(1, terms), batch.column(3).flatten().to_numpy(zero_copy_only=False), terms)
            has = pc.is_valid(sparse)
            names = pa.array(["sparse"] * pc.sum(has).as_py() + ["lexical"] * len(found), type=pa.string()) if len(ids) else pa.array([], type=pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.concat_arrays([ids.filter(has), ids.take(pa.array(found))]), pa.concat_arrays([sparse.filter(has), pa.array(score)])], names=["leg", "id", "score"])

    return flat.mapInArrow(run, f"leg string, id {kind}, score double")


def write_postings(docs: DataFrame, id_col: str, text_col: str, path: str, bucket_docs: int = 100_000, salt_docs: int = 10_000_000) -> Postings:
    """An inverted index as Parquet: (bucket, token, id, weight, places), places being the
    token's places in the text. One pass tokenises every text and groups its tokens, so
    the one shuffle moves postings. Buckets of tokens are folders, so a query reads those of its tokens
    alone, and within them the row groups that can hold them; a frequent token's bucket is
    written by several tasks."""
    n = docs.count()
    buckets, salts = max(8, n // bucket_docs), max(1, n // salt_docs)
    id_kind = dict(docs.dtypes)[id_col]

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            words = lists.flatten().dictionary_encode()
            codes = words.indices.to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(ids)), lengths)
            place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            order = np.lexsort((place, codes, owner))
            owner, codes, place = owner[order], codes[order], place[order]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])])) if len(codes) else np.zeros(0, dtype=np.int64)
            ends = np.append(new, len(codes))
            columns = [words.dictionary.take(pa.array(codes[new])), ids.take(pa.array(owner[new])), pa.array(np.diff(ends).astype(np.float64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "id", "weight", "places"])

    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("tokens"))
    p = t.mapInArrow(grouped, f"token string, id {id_kind}, weight double, places array<int>")
    p = p.withColumn("bucket", _bucket(F.col("token"), buckets)).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(salts)))
    p.sortWithinPartitions("bucket", "token", "id").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return Postings(docs.sparkSession.read.schema(p.schema).parquet(path), buckets)


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Postings:
    """An index that write_postings wrote, with its number of buckets."""

    rows: DataFrame
    buckets: int

    def of(self, wanted: list[str]) -> DataFrame:
        """(token, id, weight, places) of the wanted tokens."""
        own = sorted({zlib.crc32(t.encode()) % self.buckets for t in wanted})
        return self.rows.where(F.col("bucket").isin(*own) & F.col("token").isin(*wanted)).select("token", "id", "weight", "places")


def text_legs(postings: DataFrame, sparse: dict[str, float], query: str) -> DataFrame:
    """(leg, id, score) of the sparse leg ("sparse") and the lexical leg ("lexical", cover
    density of texts that hold all query terms) from one grouping of their postings."""
    terms = query_terms(query)
    weights = F.create_map(*[x for t, w in sorted(sparse.items()) for x in (F.lit(t), F.lit(float(w)))]) if sparse else F.lit(None).cast("map<string,double>")
    none = F.array().cast("array<int>")
    g = postings.groupBy("id").agg(
        F.sum(F.col("weight") * F.try_element_at(weights, F.col("token"))).alias("sparse"),
        *[F.coalesce(F.first(F.when(F.col("token") == t, F.col("places")), ignorenulls=True), none).alias(f"p{k}") for k, t in enumerate(terms)],
    )
    return _scored(g.select("id", "sparse", F.array(*[f"p{k}" for k in range(len(terms))]).alias("p")), len(terms))


def indexed_full_text(postings: DataFrame, query: str, k: int) -> DataFrame:
    """Lexical leg over an index: ids that hold all query terms by cover density, then id."""
    return text_legs(postings, {}, query).where("leg = 'lexical'").orderBy(F.desc("score"), "id").limit(k).select("id", "score")


def fused_legs(scores: DataFrame, weights: dict[str, float], k: int = 50, constant: int = 60) -> DataFrame:
    """(id, score): reciprocal rank fusion of the k best of each leg of (leg, id, score).
    Spark keeps k rows of a leg in each task before the one shuffle."""
    rank = F.row_number().over(Window.partitionBy("leg").orderBy(F.desc("score"), "id"))
    best = scores.withColumn("rank", rank).where(F.col("rank") <= k)
    weight = F.create_map(*[x for leg, w in weights.items() for x in (F.lit(leg), F.lit(float(w)))])
    return best.groupBy("id").agg(F.sum(F.element_at(weight, F.col("leg")) / (constant + F.col("rank"))).alias("score"))


def held(results: DataFrame) -> DataFrame:
    """A fused list as a local table. Such a list has at most the number of legs times the
    legs' k rows, whatever the corpus' size, and is used by several boosts."""
    return results.sparkSession.createDataFrame(results.collect(), results.schema)


def ranked(scores: DataFrame, id_col: str = "id", score_col: str = "score") -> DataFrame:
    """(id, rank) of a leg's top rows: an already limited list, so one task sorts it."""
    return scores.select(F.col(id_col).alias("id"), F.row_number().over(Window.orderBy(F.desc(score_col), id_col)).alias("rank"))


def globally_ranked(scores: DataFrame, id_col: str = "id", score_col: str = "score") -> DataFrame:
    """(id, rank) of a list of any length; see signal_ranks."""
    return signal_ranks(scores.select(F.lit(0).alias("signal"), F.col(id_col).alias("id"), F.col(score_col).alias("score"))).select("id", "rank")


def signal_ranks(scores: DataFrame) -> DataFrame:
    """(signal, id, rank) of all lists (signal, id, score) at once, each of any length:
    range-partitioned by rank, numbered within the ranges, and shifted by the counts of the
    ranges before. The checkpoint fixes the ranges for both uses."""
    order = [F.asc("signal"), F.desc("score"), F.asc("id")]
    d = scores.select("signal", "id", "score").repartitionByRange(*order)
    d = cut_lineage(d.withColumn("_range", F.spark_partition_id()))
    before = F.sum("n").over(Window.partitionBy("signal").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each signal and range
    shift = d.groupBy("signal", "_range").agg(F.count("*").alias("n")).select("signal", "_range", F.coalesce(before, F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("signal", "_range").orderBy(F.desc("score"), "id"))
    return d.withColumn("_inside", inside).join(F.broadcast(shift), ["signal", "_range"]).select("signal", "id", (F.col("_inside") + F.col("shift")).alias("rank"))


def fuse(legs: list[DataFrame], weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over the legs."""
    weights = weights or [1.0] * len(legs)
    parts = [leg.select("id", (F.lit(float(w)) / (k + F.col("rank"))).alias("s")) for leg, w in zip(legs, weights, strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("s").alias("score"))


def count_boost(candidates: DataFrame, counts: DataFrame, factor: float) -> DataFrame:
    """score * (1 + factor * log2(1 + n)) with counts (id, n)."""
    return candidates.join(counts, "id", "left").withColumn("score", F.col("score") * (1 + factor * F.log2(1 + F.coalesce("n", F.lit(0))))).drop("n")


def counts_of(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """(id, n): how many rows of events (id) each candidate has. The candidates, a leg's or
    a fused list's at most few hundred rows, go to the events, so that only their rows are
    counted and moved."""
    return events.select("id").join(F.broadcast(candidates.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))


def type_weight(candidates: DataFrame, type_col: str) -> DataFrame:
    weights = F.create_map(*[x for k, v in PAPER_TYPE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    kind = F.coalesce(F.col(type_col), F.lit("unknown"))
    return candidates.withColumn("score", F.col("score") * F.coalesce(F.element_at(weights, kind), F.lit(PAPER_TYPE_WEIGHTS["unknown"])))


def cocitation_boost(candidates: DataFrame, edges: DataFrame, factor: float, anchors: int = 20) -> DataFrame:
    """Boost by the number of top candidates that cite or are cited by a candidate; it
    acts from two anchors on. edges: (citing, cited). The anchors are at most `anchors`."""
    top = candidates.orderBy(F.desc("score"), "id").limit(anchors).select(F.col("id").alias("anchor"))
    ways = F.array(F.struct(F.col("citing").alias("anchor"), F.col("cited").alias("id")), F.struct(F.col("cited").alias("anchor"), F.col("citing").alias("id")))
    met = edges.select(F.inline(ways)).where("anchor <> id").join(F.broadcast(top), "anchor").join(F.broadcast(candidates.select("id")), "id", "left_semi")
    n = met.groupBy("id").agg(F.countDistinct("anchor").alias("n")).where("n >= 2")
    return count_boost(candidates, n, factor)


def pack_context(results: DataFrame, order: list[Column], text_col: str, limit: int = 24_000) -> DataFrame:
    """Numbered results up to the first that overflows `limit` characters."""
    w = Window.orderBy(*order)
    d = results.withColumns({"number": F.row_number().over(w), "_used": F.sum(F.length(text_col)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return d.where(F.col("_used") <= limit).drop("_used")


def visual_score(caption: Column, mention: Column, same_paper: Column, kind: Column, section: Column) -> Column:
    """.40 caption + .35 mention + .20 same paper + .05 section prior (.5 if unknown)."""
    prior = F.lit(0.5)
    for s, kinds in SECTION_KINDS.items():
        prior = F.when(F.lower(section) == s, F.when(F.lower(kind).isin(*kinds), 1.0).otherwise(0.0)).otherwise(prior)
    return 0.40 * caption + 0.35 * mention + 0.20 * same_paper.cast("double") + 0.05 * prior


def lesson_score(importance: Column, age_days: Column, cosine: Column, scope: Column) -> Column:
    """importance * 2^(-age/30) * (cosine + .1), .85 for global and .7 for other books;
    without a vector the cosine is .5."""
    weight = F.when(scope == "global", 0.85).when(scope == "other", 0.7).otherwise(1.0)
    return importance * F.pow(F.lit(2.0), -age_days / 30.0) * (F.coalesce(cosine, F.lit(0.5)) + 0.1) * weight


def ego_radial(neighbours: DataFrame) -> DataFrame:
    """Polar places of ranked neighbours (id, score, rank): radius .25 + .65 (1 - score)."""
    n = neighbours.agg(F.count("*").alias("n"))
    d = neighbours.join(F.broadcast(n))
    angle, r = 2 * F.pi() * (F.col("rank") - 1) / F.col("n"), 0.25 + 0.65 * (1 - F.col("score"))
    return d.select("id", "score", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))


def mmr(candidates: DataFrame, top_k: int, trade: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance within each `group` of (group, id, score,
    concepts): Jaccard of concept sets against the chosen ones, 0 <= trade <= 1. The choice
    is sequential by nature and is made among all candidates. Only those that can't be
    chosen are left out before: of one concept set, which is near alike to the chosen ones,
    all but the top_k best; and those that even with nothing like them chosen come behind
    the top_k best scores with their like chosen."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True])
        left = [[r.id, r.score, set(r.concepts), 0.0] for r in rows.itertuples()]
        chosen: list = []
        while left and len(chosen) < top_k:
            best = left.pop(max(range(len(left)), key=lambda i: (trade * left[i][1] - (1 - trade) * left[i][3], -i)))
            chosen.append(best[0])
            for x in left:
                both = len(x[2] | best[2])
                x[3] = max(x[3], len(x[2] & best[2]) / both if both else 0.0)
        group = rows["group"].iloc[0]
        return pd.DataFrame({"group": [group] * len(chosen), "id": chosen, "place": range(1, len(chosen) + 1)})

    kinds = dict(candidates.dtypes)
    order = (F.desc("score"), F.asc("id"))
    rows = candidates.select("group", "id", "score", "concepts", F.array_sort(F.array_distinct("concepts")).alias("_set"))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("group", "_set").orderBy(*order))).where(F.col("_place") <= top_k)
    top = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("group").orderBy(*order))).where(F.col("_rank") <= top_k)
    # the score at rank top_k; none in smaller groups, which are kept whole
    least = top.where(F.col("_rank") == top_k).select(F.col("group").alias("_group"), F.col("score").alias("_least"))
    able = F.coalesce(trade * F.col("score") + (1 - trade) >= trade * F.col("_least") - 1e-9, F.lit(True))
    kept = rows.join(least, F.col("group").eqNullSafe(F.col("_group")), "left").where(able).select("group", "id", "score", "concepts")
    return kept.groupBy("group").applyInPandas(choose, f"group {kinds['group']}, id {kinds['id']}, place int")


def accepted_expansion(query: Column, expanded: Column, longest: int = 500) -> Column:
    """An expander's answer if it is longer than the query and not too long, else the query."""
    e = F.trim(expanded)
    return F.when((F.length(e) > F.length(query)) & (F.length(e) <= longest), e).otherwise(query)
