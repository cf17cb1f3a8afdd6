"""Relational building blocks: optional filters, pagination, latest-row picks, spines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(conditions: list[Column | None]) -> Column:
    """Conjunction of the filters that are given (None: not given)."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered result; Spark keeps only its first number * size rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key group in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = (), counter: str | None = None) -> DataFrame:
    """New rows over old ones by key: an empty or null new value keeps the old one,
    keep_old columns never change once there, counter grows by one on conflict."""
    o, n = old.alias("o"), new.alias("n")

    def value(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == counter:
            return F.when(a.isNotNull() & F.col(f"n.{key}").isNotNull(), a + 1).otherwise(F.coalesce(a, b))
        if c in keep_old:
            return F.coalesce(a, b)
        if dict(new.dtypes)[c] == "string":
            b = F.nullif(b, F.lit(""))
        return F.coalesce(b, a)

    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*[value(c).alias(c) for c in old.columns])


def zero_filled(facts: DataFrame, time: str, step: str, start: str, stop: str, measures: dict[str, Column]) -> DataFrame:
    """Measures by calendar step from start to stop, with zeros where there are no facts."""
    spark = facts.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp"), F.expr(f"INTERVAL 1 {step}"))).alias("bucket"))
    grouped = facts.groupBy(F.date_trunc(step, time).alias("bucket")).agg(*[c.alias(k) for k, c in measures.items()])
    return spine.join(grouped, "bucket", "left").select("bucket", *[F.coalesce(k, F.lit(0)).alias(k) for k in measures])


def index_percentile(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The element at int(n * share) of each group's sorted values (not interpolated)."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(w.orderBy(value)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    picks = [F.max(F.when(F.col("_i") == F.least(F.floor(F.col("_n") * s), F.col("_n") - 1), F.col(value))).alias(k) for k, s in shares.items()]
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), *picks)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between the least and greatest value; the last bin is closed and
    equal values make a single bin."""
    b = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    d = df.where(F.col(value).isNotNull()).join(F.broadcast(b))
    i = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    return d.groupBy(i.cast("int").alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))


def scroll(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The page of `size` rows that follows the key `after` (None: the first page)."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(size)


def with_aliases(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """df with `name`, the canonical form of a column's value: aliases (canonical, variants)
    and the values are compared trimmed and in lower case; unknown values stand for
    themselves. A variant of two canonical names means the lesser one."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    flat = aliases.select(norm(F.col("canonical")).alias("_to"), F.explode(F.concat(F.array("canonical"), F.coalesce("variants", F.array()))).alias("v"))
    flat = flat.groupBy(norm(F.col("v")).alias("_from")).agg(F.min("_to").alias("_to"))
    return df.withColumn("_from", norm(F.col(column))).join(flat, "_from", "left").withColumn("name", F.coalesce("_to", "_from")).drop("_from", "_to")


def name_index(authors: DataFrame, cited: DataFrame, like: str | None = None, limit: int | None = 50, least: int | None = 1, most: int = 500) -> DataFrame:
    """(name, papers, cites): authors (name, paper) by the citations (paper) of their papers,
    then papers, then name. A limit that is missing, 0 or out of range is clamped to 50, 1 or
    `most`, `least` papers to 1; `like` is a part of the name in any case, blank for all."""
    rows = min(most, max(1, int(limit or 50)))
    a = authors.where(F.trim("name") != "").select("name", "paper").distinct()
    if like and like.strip():
        a = a.where(F.contains(F.lower("name"), F.lit(like.strip().lower())))
    n = cited.groupBy("paper").agg(F.count("*").alias("n"))
    g = a.join(n, "paper", "left").groupBy("name").agg(F.count("*").alias("papers"), F.coalesce(F.sum("n"), F.lit(0)).alias("cites"))
    return g.where(F.col("papers") >= max(1, int(least or 1))).orderBy(F.desc("cites"), F.desc("papers"), "name").limit(rows)
