"""Bounded, deterministic samples of labelled rows, and the hold-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.session import cut_lineage

def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(labelled: DataFrame, docs: DataFrame, key: Column, label: Column, text: Column, per_label: int, chars: int, max_labels: int = 256, doc_label: Column | None = None) -> list[tuple]:
    """At most per_label (label, text start of at most chars) per label, by label and key hash.

    Of each label the least key hash in each of per_label hash buckets is picked; the picks,
    at most max_labels * per_label rows, are broadcast to fetch their texts, so no text is
    sorted or shuffled to choose. Labels beyond the max_labels most frequent (ties: the
    lesser) are left out. `labelled` has key and label, `docs` key and text; they may be the
    same table, and where docs has the label too (doc_label) only its rows with that label
    give a text. Rows without label or text don't count; of several texts of a key and label
    the least is taken."""
    hashed = labelled.select(label.alias("label"), F.xxhash64(key).alias("h")).where("label is not null")
    buckets = cut_lineage(hashed.groupBy("label", F.pmod("h", F.lit(per_label)).alias("bucket")).agg(F.min("h").alias("h"), F.count("*").alias("n")))
    known = buckets.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(max_labels)
    picks = buckets.join(F.broadcast(known.select("label")), "label").select("label", "h")
    texts = docs.select(F.xxhash64(key).alias("h"), F.substring(text, 1, chars).alias("text"), *([] if doc_label is None else [doc_label.alias("own")])).where("text is not null")
    found = texts.join(F.broadcast(picks), ["h"] if doc_label is None else (texts["h"] == picks["h"]) & (texts["own"] == picks["label"]))
    found = found.groupBy("label", picks["h"] if doc_label is not None else F.col("h")).agg(F.min("text").alias("text"))
    return [tuple(r)[::2] for r in sorted(found.select("label", "h", "text").collect())]
