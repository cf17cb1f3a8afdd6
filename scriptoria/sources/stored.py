"""A stored table with MERGE: copy on write of the touched buckets, published by one manifest.

    PATH/data/BATCH-RANDOM/bucket=N/part-*    rows whose key hashes to bucket N
    PATH/manifests/00000007.json              the folder of each bucket, the batches applied

The manifest with the highest number is the table. A merge reads the buckets that its batch
touches, writes them anew into a folder of their own, and then publishes a manifest that
names the new folders beside the old ones of all other buckets, by renaming a finished
file. A job that dies before leaves folders that no manifest names; the table stays as it
was, and `vacuum` clears them. A batch whose name is in the manifest is not applied again.

Defined cases: of rows of a batch with one key the greatest by its other columns, in order,
counts; rows with a null in the key never match and are inserted each; missing columns of a
batch are null; a batch without rows changes nothing but is noted as applied; two writers
can't publish one number: the second gets an error and may merge again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Combine = Callable[[str, str], dict[str, Column]]


@dataclass(frozen=True)
class Manifest:
    version: int
    folders: dict[str, str]
    applied: list[str] = field(default_factory=list)


class StoredTable:
    """Rows of `schema` (DDL) by `key`, in `buckets` hash buckets; the number is fixed once
    the table has a manifest, and bounds what a merge collects."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 256) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema)

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def manifest(self) -> Manifest:
        fs, folder = self._fs(), self._at("manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not names:
            return Manifest(0, {})
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{names[-1]}").collect())
        return Manifest(**json.loads(text))

    def _publish(self, m: Manifest) -> None:
        fs, name = self._fs(), f"{m.version:08d}.json"
        if fs.exists(self._at("manifests", name)):
            raise RuntimeError(f"another writer has published version {m.version}")
        draft = self._at("manifests", f".{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": m.version, "folders": m.folders, "applied": m.applied}).encode()))
        out.close()
        if not fs.rename(draft, self._at("manifests", name)):
            raise RuntimeError(f"version {m.version} could not be published")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.key]), F.lit(self.buckets)).cast("string")

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.manifest().folders)

    def lookup(self, **key: object) -> DataFrame:
        """The rows of one key: one bucket is read."""
        own = self.spark.range(1).select(*[F.lit(key[k]).cast(self.schema[k].dataType).alias(k) for k in self.key]).select(self._bucket()).first()[0]
        found = self._rows({b: f for b, f in self.manifest().folders.items() if b == own})
        for k, v in key.items():
            found = found.where(F.col(f"`{k}`") == F.lit(v))
        return found

    def prepared(self, batch: DataFrame, combine: Combine, name: str) -> Manifest | None:
        """Writes the touched buckets anew and gives the manifest that would publish them;
        None if the batch has been applied before."""
        now = self.manifest()
        if name in now.applied:
            return None
        names = self.schema.fieldNames()
        columns = [F.col(f"`{c}`").cast(self.schema[c].dataType).alias(c) if c in batch.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in names]
        rest = [c for c in names if c not in self.key]
        given = batch.select(*columns)
        keyed = given.dropna(subset=self.key)
        once = keyed.groupBy(*self.key).agg(F.max(F.struct(*rest)).alias("r")).select(*self.key, "r.*")
        new = once.unionByName(given.join(keyed.select(*self.key).distinct(), self.key, "left_anti")).select(*[F.col(f"`{c}`").alias(f"new_{c}") for c in names])
        touched = {r[0] for r in given.select(self._bucket()).distinct().collect()}
        if not touched:
            return Manifest(now.version + 1, now.folders, [*now.applied, name])
        old = self._rows({b: f for b, f in now.folders.items() if b in touched}).select(*[F.col(f"`{c}`").alias(f"old_{c}") for c in names], F.lit(True).alias("was"))
        same = [F.col(f"old_{k}") == F.col(f"new_{k}") for k in self.key]
        met = old.join(new.withColumn("is", F.lit(True)), same, "full_outer")
        merged = combine("old_", "new_")

        def value(c: str) -> Column:
            both = merged.get(c, F.col(f"old_{c}"))
            return F.when(F.col("is").isNull(), F.col(f"old_{c}")).when(F.col("was").isNull(), F.col(f"new_{c}")).otherwise(both).alias(c)

        folder = f"{name}-{uuid.uuid4().hex[:12]}"
        out = met.select(*[value(c) for c in names]).withColumn("bucket", self._bucket())
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        return Manifest(now.version + 1, now.folders | dict.fromkeys(touched, folder), [*now.applied, name])

    def merge(self, batch: DataFrame, combine: Combine, name: str) -> bool:
        """INSERT ... ON CONFLICT (key) DO UPDATE: unmatched rows are inserted, of matched ones
        combine(old prefix, new prefix) gives the columns that change. False if a batch of
        this name had been applied."""
        m = self.prepared(batch, combine, name)
        if m is not None:
            self._publish(m)
        return m is not None

    def vacuum(self) -> list[str]:
        """Deletes the folders that the present manifest doesn't name: call it when no merge
        and no reader of an older state is at work."""
        fs, data, used = self._fs(), self._at("data"), set(self.manifest().folders.values())
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in used] if fs.exists(data) else []
        for p in gone:
            fs.delete(p, True)
        return sorted(p.getName() for p in gone)


def keep_richer(*columns: str) -> Combine:
    """A column's new value where it is filled, else the old one."""
    return lambda old, new: {c: F.coalesce(F.nullif(F.col(f"{new}{c}").cast("string"), F.lit("")), F.col(f"{old}{c}")) for c in columns}


def last_writer(*columns: str) -> Combine:
    return lambda old, new: {c: F.col(f"{new}{c}") for c in columns}


def counted(combine: Combine, counter: str) -> Combine:
    """combine, and a counter that goes up by one."""
    return lambda old, new: combine(old, new) | {counter: F.coalesce(F.col(f"{old}{counter}"), F.lit(0)) + 1}
