"""Weighted full text over several fields: impact postings with block maxima, top k with an early end.

A text field has one of the weights A to D. A token's impact in a row is the sum over fields
of weight times count, in hundredths and so exact. write_fields orders rows into blocks by
their characters, longest first (long rows have the great impacts), and writes

    postings   bucket of the token / token, block, id, impact
    maxima     bucket of the token / token, block, greatest impact, rows

A search reads the maxima of its tokens. No row of a block can score more than the sum of
the block's maxima, so blocks are read by falling bound until k rows are certain: first the
best blocks, then those whose bound isn't strictly below the kth score.

Rows that hold all query tokens match, whatever the field; null fields are empty; a query
without tokens matches nothing; rows with a null id aren't indexed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# The weights of fields, in hundredths.
FIELD_WEIGHTS = {"A": 100, "B": 40, "C": 20, "D": 10}
#: The most blocks of an index, so the most maxima of a token that a search looks at.
BLOCKS = 2048


def spaced_tokens(text: Column) -> Column:
    """Lower-case letter-and-digit tokens, parted by spaces."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")


def terms_of(query: str | None) -> list[str]:
    """The distinct tokens of a query, in order."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", (query or "").lower())))


def _bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode()) % buckets


@dataclass(frozen=True)
class FieldIndex:
    """An index that write_fields wrote, with its number of buckets."""

    postings: DataFrame
    maxima: DataFrame
    buckets: int

    def of(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        own = sorted({_bucket(t, self.buckets) for t in terms})
        return rows.where(F.col("bucket").isin(*own) & F.col("token").isin(*terms))

    def bounds(self, terms: list[str]) -> list[tuple[int, int, int]]:
        """(block, bound, rows at most) of the blocks that can hold all terms, best first;
        at most BLOCKS rows."""
        m = self.of(self.maxima, terms).groupBy("block").agg(F.count("*").alias("terms"), F.sum("most").alias("bound"), F.min("n").alias("n"))
        return [(r.block, r.bound, r.n) for r in m.where(F.col("terms") == len(terms)).orderBy(F.desc("bound"), "block").collect()]

    def scored(self, terms: list[str], blocks: list[int]) -> DataFrame:
        """(id, impact) of the rows of these blocks that hold all terms."""
        rows = self.of(self.postings, terms).where(F.col("block").isin(*blocks) if blocks else F.lit(False))
        return rows.groupBy("id").agg(F.sum("impact").alias("impact"), F.count("*").alias("terms")).where(F.col("terms") == len(terms)).select("id", "impact")

    def plan(self, terms: list[str], k: int) -> list[int]:
        """The blocks that a search for k rows has to read."""
        bounds = self.bounds(terms) if terms else []
        first, rows = 0, 0
        while first < len(bounds) and rows < 2 * k:
            rows += bounds[first][2]
            first += 1
        if first == len(bounds):
            return [b for b, *_ in bounds]
        best = [r.impact for r in self.scored(terms, [b for b, *_ in bounds[:first]]).orderBy(F.desc("impact")).limit(k).select("impact").collect()]
        least = best[k - 1] if len(best) >= k else 0
        return [b for i, (b, bound, _) in enumerate(bounds) if i < first or bound >= least]

    def search(self, query: str | None, k: int) -> DataFrame:
        """(id, score) of the k best rows, ties by id."""
        terms = terms_of(query)
        found = self.scored(terms or [""], self.plan(terms, k))
        return found.orderBy(F.desc("impact"), "id").limit(k).select("id", (F.col("impact") / 100).alias("score"))


def write_fields(rows: DataFrame, id_col: str, fields: dict[str, str], path: str, bucket_rows: int = 100_000, block_rows: int = 256) -> FieldIndex:
    """Indexes the fields (column: weight A to D) of rows below path. The postings of
    a batch of rows leave Python in the index's order, so that the sort after the one
    shuffle of postings merges runs. Several tasks write a bucket: each gets about the
    postings of bucket_rows / 20 rows, and a part of a frequent token's."""
    kind = dict(rows.dtypes)[id_col]
    kept = rows.where(F.col(id_col).isNotNull())
    length = sum((F.length(F.coalesce(F.col(c), F.lit(""))).cast("long") for c in fields), F.lit(0))
    n = kept.count()
    blocks = max(1, min(BLOCKS // 2, n // block_rows))
    found = kept.select(length.alias("length")).approxQuantile("length", [i / blocks for i in range(1, blocks)], 0.5 / blocks) if n and blocks > 1 else []
    cuts = np.array(sorted(set(found)))
    buckets = max(8, n // bucket_rows)
    salts = max(-(-20 * n // (buckets * bucket_rows)), n // (100 * bucket_rows), 1)
    weights = np.array([FIELD_WEIGHTS[w] for w in fields.values()], dtype=np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # how many cuts lie above a row's length: block 0 holds the longest rows
            block = len(cuts) - np.searchsorted(cuts, batch.column(1).to_numpy(), side="right")
            parts = [pc.split_pattern(column, " ") for column in batch.columns[2:]]
            sizes = np.concatenate([pc.list_value_length(x).to_numpy() for x in parts])
            field, row = np.divmod(np.repeat(np.arange(len(sizes)), sizes), batch.num_rows)
            found = pa.concat_arrays([x.flatten() for x in parts]).dictionary_encode()
            tokens, code = found.dictionary, found.indices.to_numpy()
            real = pc.not_equal(tokens, "").to_numpy(zero_copy_only=False)[code]
            field, row, code = field[real], row[real], code[real]
            words = pa.table({"bucket": pa.array([_bucket(w, buckets) for w in tokens.to_pylist()], type=pa.int32()), "token": tokens})
            by_rank = pc.sort_indices(words, [("bucket", "ascending"), ("token", "ascending")]).to_numpy()
            rank = np.empty(len(tokens), dtype=np.int64)
            rank[by_rank] = np.arange(len(tokens))
            # one number for a token, block and row; its occurrences' weights are summed
            place = (rank[code] * (len(cuts) + 1) + block[row]) * batch.num_rows + row
            order = np.argsort(place)
            place = place[order]
            first = np.flatnonzero(np.diff(place, prepend=-1))
            impact = np.add.reduceat(weights[field[order]], first) if len(first) else np.zeros(0, dtype=np.int64)
            of, row = np.divmod(place[first], batch.num_rows)
            of, at = np.divmod(of, len(cuts) + 1)
            own = words.take(pa.array(by_rank[of])).combine_chunks()
            columns = [own["bucket"], own["token"], pa.array(at, type=pa.int32()), batch.column(0).take(pa.array(row)), pa.array(impact)]
            yield from pa.table(columns, names=["bucket", "token", "block", "id", "impact"]).to_batches(max_chunksize=1 << 16)

    d = kept.select(F.col(id_col).alias("id"), length.alias("length"), *[spaced_tokens(F.col(c)).alias(f"field{i}") for i, c in enumerate(fields)])
    p = d.mapInArrow(counted, f"bucket int, token string, block int, id {kind}, impact long")
    dealt = p.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(salts)))
    dealt.sortWithinPartitions("bucket", "token", "block", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    postings = rows.sparkSession.read.schema(p.schema).parquet(f"{path}/postings")
    part = F.pmod(F.xxhash64("token"), F.lit(salts)).alias("part")
    m = postings.select("bucket", part, "token", "block", "impact").repartition("bucket", "part").groupBy("bucket", "part", "token", "block").agg(F.max("impact").alias("most"), F.count("*").alias("n"))
    m.drop("part").sortWithinPartitions("bucket", "token", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/maxima")
    return open_fields(rows.sparkSession, path, buckets, kind)


def open_fields(spark: SparkSession, path: str, buckets: int, id_kind: str) -> FieldIndex:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return FieldIndex(read("postings", f"token string, block int, id {id_kind}, impact long, bucket int"), read("maxima", "token string, block int, most long, n long, bucket int"), buckets)
