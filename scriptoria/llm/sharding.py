"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Each record scores every shard as -weight / ln(u), u in (0, 1) from one 64-bit hash of
key and shard, and goes to the highest score. A new shard can only win records for
itself, so growth moves no record between old shards.

Slots number a shard's records without gaps. They come from counts per (shard, bucket),
a running sum over that bounded table, and a row number inside each bucket, so no task
holds a shard. A bucket is a hash of the record's place in the input, so a key that
holds a third of all rows is spread too. The narrow rows are checkpointed once: places
stay as they are when an executor is lost, and the texts are read once.

Defined cases: a null key counts as one key of its own; a null text has size 1 and the
CRC of no bytes; repeated rows share their shard and have slots of their own; an empty
table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.session import cut_lineage


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The index of the shard with the highest score; ties go to the lower index."""
    name = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))

    def score(j: int, weight: float) -> Column:
        # 52 bits of the hash, centred in their cells: never 0 or 1
        u = (F.shiftrightunsigned(F.xxhash64(name, F.lit(j)), 12).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.lit(float(weight)) / F.log(u)).alias("s"), F.lit(-j).alias("j"))

    return (-F.array_max(F.array(*[score(j, w) for j, w in enumerate(weights)]))["j"]).cast("int")


def shard(docs: DataFrame, weights: list[float], new_weight: float | None = None, key_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 1_000_000) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    grown_shard is the shard after one of weight new_weight is added; null without it."""
    key = F.col(f"`{key_col}`")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    grown = rendezvous(F.col("key"), [*weights, new_weight]) if new_weight is not None else F.lit(None).cast("int")
    rows = docs.select(key.alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
    rows = cut_lineage(rows.withColumns({"shard": rendezvous(F.col("key"), weights), "grown_shard": grown}))
    # a shard's slots are dealt by buckets of about bucket_rows rows, each one sort
    buckets = max(16, -(-rows.count() // (bucket_rows * len(weights))))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # a row for each shard and bucket: one for a million rows of input
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("place")) - 1
    numbered = rows.withColumn("inside", inside).join(F.broadcast(offsets), ["shard", "bucket"])
    return numbered.select(F.col("key").alias(key_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("inside")).cast("long").alias("slot"), "grown_shard")
