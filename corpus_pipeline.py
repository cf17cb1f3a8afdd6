"""A training-data pipeline over `documents`, each stage one of the llm operators.

Stages take and return documents (the last one returns packed pieces). run() joins
them with a checkpoint after each stage; other drivers may write Parquet instead.

Defined cases: a row is named by its key and its text, so rows with a null key are judged
each by its own text, and of rows that repeat key and text near-dedup leaves one; a group
of near duplicates is led by its least key, rows without a key coming last; null and empty
texts are rejected by the quality rules; a label is only read where it isn't null; a very
long text goes through whole; extra columns pass unchanged, whatever their names; an empty
table gives no pieces, and without labelled rows no language is known, so nothing passes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import decontaminate, language_id, near_dedup, packing, quality_rules
from scriptoria.llm.samples import fold
from scriptoria.session import cut_lineage, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return docs.where(quality_rules.judgement(F.col("text"), lang=F.col("lang"))["kept"])


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., so that no operator's column can clash, and the new
    name of each old one."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def row_key(key: Column, text: Column) -> Column:
    """A name for a row that is never null: its key, null ones last, and its text's hash."""
    return F.struct(key.isNull().alias("no_key"), F.coalesce(key, F.lit(0)).alias("key"), F.xxhash64(text).alias("text_hash"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a score of one half or more."""
    d, names = renamed(docs)
    key, text, lang = (names[c] for c in ("doc_id", "text", "lang"))
    model = language_id.train(d.where(fold(F.col(key), 4) != 2), key, text, lang)
    known = language_id.identify(d, model, d.columns, text)
    return known.where("lang_pred <> 'und' AND score >= 0.5").select(*d.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word
    shingles; of rows that repeat key and text, one stays."""
    d, names = renamed(docs)
    d = d.withColumn("row", row_key(F.col(names["doc_id"]), F.col(names["text"])))
    found = near_dedup.near_duplicates(d, n=5, num=80, den=100, key_col="row", text_col=names["text"])
    gone = found.where("NOT kept").select("row").distinct()
    return d.join(gone, "row", "left_anti").dropDuplicates(["row"]).select(*names.values()).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    d, names = renamed(docs)
    d = d.withColumn("row", row_key(F.col(names["doc_id"]), F.col(names["text"])))
    found = decontaminate.matches(d, table(spark, sf_dir, "benchmark").select("item_id", "text"), key_col="row", text_col=names["text"])
    return d.join(found.select("row").distinct(), "row", "left_anti").select(*names.values()).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", drop_low_quality),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: Language ID, near-dedup, alignment and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
