"""Evaluation and statistics over rank tables, paired outcomes and scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rank_metrics(ranks: DataFrame, rank_col: str, keys: list[str] | None = None) -> DataFrame:
    """MRR@10, Recall@1, Recall@10, NDCG@10 (one relevant item; rank 0: not found)."""
    r = F.col(rank_col)
    within = lambda k: (r >= 1) & (r <= k)
    mean = lambda c: F.avg(c.cast("double"))
    return ranks.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"),
        F.avg(F.when(within(10), 1.0 / r).otherwise(0.0)).alias("mrr10"),
        mean(within(1)).alias("recall1"),
        mean(within(10)).alias("recall10"),
        F.avg(F.when(within(10), 1.0 / F.log2(r + 1.0)).otherwise(0.0)).alias("ndcg10"),
        (100 * mean(r == 0)).alias("not_found_pct"),
    )


def displacement(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute rank move of shared ids and whether the first place changed, per
    key; both tables have keys, id and rank."""
    j = before.join(after.withColumnRenamed("rank", "rank_after"), [*keys, "id"])
    return j.groupBy(*keys).agg(F.avg(F.abs(F.col("rank") - F.col("rank_after"))).alias("move"), (~F.coalesce(F.bool_or((F.col("rank") == 1) & (F.col("rank_after") == 1)), F.lit(False))).alias("top_changed"))


def set_overlap(a: Column, b: Column) -> Column:
    """Jaccard of two arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap(values: DataFrame, value: str, resamples: int = 1000, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of the mean by Poisson resampling: each row's weight in a
    resample is a Poisson(1) draw from a hash of row id and resample. A task adds up all
    resamples of its own rows, so only `resamples` sums leave it; rows are never repeated.
    Rows without a value don't count."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = _mixed(np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        weight, total = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            h, x = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for low in range(0, len(h), 512):
                draw = (_mixed(h[low : low + 512, None] ^ turn[None, :]) >> np.uint64(11)) / float(1 << 53)
                w = np.searchsorted(steps, draw, side="right").astype(np.float64)
                weight += w.sum(axis=0)
                total += x[low : low + 512] @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples, dtype=np.int32)), pa.array(weight), pa.array(total)], names=["r", "w", "t"])

    rows = values.select(F.xxhash64("id").alias("h"), F.col(value).cast("double").alias("x")).where("x is not null")
    means = rows.mapInArrow(run, "r int, w double, t double").groupBy("r").agg(F.try_divide(F.sum("t"), F.sum("w")).alias("m"))
    low = (1 - confidence) / 2
    ci = means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(1 - low)).alias("high"))
    return values.agg(F.avg(value).alias("mean")).join(F.broadcast(ci))


@F.pandas_udf(T.DoubleType())
def _tail(statistic: pd.Series) -> pd.Series:
    return statistic.map(lambda s: math.erfc(math.sqrt(max(s, 0.0) / 2)))


def mcnemar(pairs: DataFrame, corrected: bool = True) -> DataFrame:
    """b (only B right), c (only A right), the statistic, p and the direction."""
    a, b = F.col("a_correct"), F.col("b_correct")
    d = pairs.agg(F.count_if(~a & b).alias("b"), F.count_if(a & ~b).alias("c"))
    gap = F.abs(F.col("b") - F.col("c")) - (1 if corrected else 0)
    d = d.withColumn("statistic", F.coalesce(F.try_divide(gap * gap, F.col("b") + F.col("c")), F.lit(0.0)))
    direction = F.when(F.col("c") > F.col("b"), "A_better").when(F.col("b") > F.col("c"), "B_better").otherwise("tie")
    return d.select("b", "c", "statistic", F.when(F.col("b") + F.col("c") == 0, 1.0).otherwise(_tail("statistic")).alias("p"), direction.alias("direction"))


def alignment(pairs: DataFrame, low: float = 0.5, margin: float = 0.15) -> DataFrame:
    """(sentence, claimed, source, score) -> where the claimed source scores below low and
    another one at least margin more, the marker moves to the best source."""
    best = pairs.groupBy("sentence", "claimed").agg(F.max(F.when(F.col("source") == F.col("claimed"), F.col("score"))).alias("own"), F.max_by("source", F.struct("score", -F.col("source"))).alias("best"), F.max("score").alias("top"))
    move = (F.coalesce("own", F.lit(0.0)) < low) & (F.col("top") - F.coalesce("own", F.lit(0.0)) >= margin)
    return best.select("sentence", "claimed", F.when(move, F.col("best")).otherwise(F.col("claimed")).alias("assigned"), move.alias("moved"))


def faithfulness(pairs: DataFrame) -> DataFrame:
    """Per output: mean, least and share below .5 of each sentence's best source score."""
    s = pairs.groupBy("output", "sentence").agg(F.max("score").alias("m"))
    return s.groupBy("output").agg(F.avg("m").alias("mean"), F.min("m").alias("least"), (100 * F.avg((F.col("m") < 0.5).cast("int"))).alias("below_pct"))


def win_rates(duels: DataFrame) -> DataFrame:
    """100 * wins / (wins + losses) per player from (a, b, outcome 'a', 'b' or 'tie')."""
    side = lambda me, won: duels.select(F.col(me).alias("player"), (F.col("outcome") == won).cast("int").alias("w"), (~F.col("outcome").isin("tie", won)).cast("int").alias("l"))
    g = side("a", "a").unionByName(side("b", "b")).groupBy("player").agg(F.sum("w").alias("w"), F.sum("l").alias("l"))
    return g.select("player", F.try_divide(100.0 * F.col("w"), F.col("w") + F.col("l")).alias("rate"))


def refinement_gate(section: Column, target: Column, hits: Column, outlined: Column, unbounded: tuple[str, ...] = ("discussion", "conclusion", "introduction", "related_work")) -> Column:
    """Names of the conditions that fail; empty: refine."""
    return F.array_compact(
        F.array(
            F.when(hits < 3, "external_verification"),
            F.when(target.isNull() & F.lower(F.coalesce(section, F.lit(""))).isin(*unbounded), "constrained_scope"),
            F.when(~outlined, "structured_reasoning"),
            F.when(target < 120, "decision_space"),
        )
    )


def citation_quality(cites: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per output: recall (share of cited sentences that their sources together entail) and
    precision (share of citations in such sentences that are not irrelevant: alone they
    don't entail and without them the others still do), in per cent. cites: (output,
    sentence, source, together, alone, rest), probabilities of a model; rest is null where
    no other source is cited."""
    c = cites.select("output", "sentence", (F.col("together") >= threshold).alias("holds"), ((F.col("alone") < threshold) & F.coalesce(F.col("rest") >= threshold, F.lit(False))).alias("irrelevant"))
    s = c.groupBy("output", "sentence").agg(F.bool_or("holds").alias("holds"), F.count("*").alias("n"), F.count_if(~F.col("irrelevant")).alias("used"))
    return s.groupBy("output").agg(
        F.round(100 * F.avg(F.col("holds").cast("int")), 1).alias("recall"),
        F.round(100.0 * F.sum(F.when(F.col("holds"), F.col("used")).otherwise(0)) / F.sum("n"), 1).alias("precision"),
        F.count("*").alias("sentences"),
        F.sum("n").alias("citations"),
    )


def compare_paired(pairs: DataFrame, resamples: int = 2000) -> DataFrame:
    """One row: both arms' success rates with their intervals and the paired test, from
    (id, a_correct, b_correct)."""

    def arm(x: str) -> DataFrame:
        b = bootstrap(pairs.select("id", F.col(f"{x}_correct").cast("double").alias("x")), "x", resamples)
        return b.select(*[F.col(c).alias(f"{x}_{c}") for c in ("mean", "low", "high")])

    return arm("a").join(F.broadcast(arm("b"))).join(F.broadcast(mcnemar(pairs)))


def hits_at(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """P@1 and R@3 in per cent of (rank of the right item; null: not found)."""
    within = lambda k: F.round(100 * F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), 2)
    return ranks.groupBy(*keys).agg(F.count("*").alias("n"), within(1).alias("p1"), within(3).alias("r3"))
