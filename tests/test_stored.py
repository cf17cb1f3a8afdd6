"""Stored merges: what a crash, a repeated batch and odd rows leave."""

import pytest
from pyspark.sql import functions as F

from scriptoria.sources import stored

RULE = stored.counted(stored.keep_richer("title"), "n")


def rows(t):
    return sorted(((r.id, r.title, r.n) for r in t.read().collect()), key=str)


@pytest.fixture
def kept(spark, tmp_path):
    t = stored.StoredTable(spark, str(tmp_path / "t"), "id long, title string, n int", ["id"], 4)
    assert t.merge(spark.createDataFrame([(i, f"t{i}", 1) for i in range(20)], "id long, title string, n int"), RULE, "a")
    return t


def test_merge_inserts_updates_and_runs_once(spark, kept):
    batch = spark.createDataFrame([(3, "better", 1), (4, "", 1), (5, None, 1), (99, "new", 1)], "id long, title string, n int")
    assert kept.merge(batch, RULE, "b") and not kept.merge(batch, RULE, "b")
    want = {i: (f"t{i}", 1) for i in range(20)} | {3: ("better", 2), 4: ("t4", 2), 5: ("t5", 2), 99: ("new", 1)}
    assert {i: (t, n) for i, t, n in rows(kept)} == want and kept.manifest().version == 2
    assert [tuple(r) for r in kept.lookup(id=3).collect()] == [(3, "better", 2)] and kept.lookup(id=1000).count() == 0


def test_only_touched_buckets_are_written(spark, kept):
    before = kept.manifest().folders
    kept.merge(spark.createDataFrame([(3, "x", 1)], "id long, title string, n int"), RULE, "one")
    after = kept.manifest().folders
    assert sum(before[b] != after[b] for b in before) == 1


def test_a_crash_before_publishing_leaves_the_old_state(spark, kept, monkeypatch):
    before = rows(kept)
    batch = spark.createDataFrame([(3, "lost", 1)], "id long, title string, n int")

    def dies(self, manifest):
        raise RuntimeError("the driver died")

    with monkeypatch.context() as m:
        m.setattr(stored.StoredTable, "_publish", dies)
        with pytest.raises(RuntimeError, match="died"):
            kept.merge(batch, RULE, "c")
    assert rows(kept) == before and kept.manifest().version == 1
    assert len(kept.vacuum()) == 1 and rows(kept) == before
    assert kept.merge(batch, RULE, "c") and (3, "lost", 2) in rows(kept)


def test_a_second_writer_gets_an_error(spark, kept):
    batch = lambda t: spark.createDataFrame([(3, t, 1)], "id long, title string, n int")
    slow = kept.prepared(batch("slow"), RULE, "slow")
    kept.merge(batch("fast"), RULE, "fast")
    with pytest.raises(RuntimeError, match="another writer"):
        kept._publish(slow)
    assert (3, "fast", 2) in rows(kept)


def test_odd_rows(spark, tmp_path):
    t = stored.StoredTable(spark, str(tmp_path / "odd"), "id long, title string, n int", ["id"], 4)
    assert rows(t) == [] and t.vacuum() == []
    odd = [(None, "a", 1), (None, "a", 1), (7, "x", 1), (7, "y", 1), (8, None, None)]
    t.merge(spark.createDataFrame(odd, "id long, title string, n int").withColumn("extra", F.lit(1)), RULE, "odd")
    t.merge(spark.createDataFrame([(None, "a", 1)], "id long, title string, n int"), RULE, "again")
    assert rows(t) == sorted([(None, "a", 1)] * 3 + [(7, "y", 1), (8, None, None)], key=str)
    assert t.merge(spark.createDataFrame([], "id long"), RULE, "empty") and t.manifest().applied[-1] == "empty"
    assert t.merge(spark.createDataFrame([(8,)], "id long"), RULE, "fewer columns") and (8, None, 1) in rows(t)
