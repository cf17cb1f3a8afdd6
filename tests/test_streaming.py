"""Streaming forms over a file stream."""

from pyspark.sql import functions as F

from scriptoria.sources.cursor import CursorSource
from scriptoria.streaming import state, windows


def run(spark, tmp_path, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return spark.table(name).collect()


def test_windows(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", 1), ("2024-01-01 00:30:00", "a", 2), ("2024-01-01 01:10:00", "b", 3), ("2024-01-01 05:00:00", "a", 4)]
    df = spark.createDataFrame(rows, "t string, stage string, v int").select(F.to_timestamp("t").alias("t"), "stage", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = run(spark, tmp_path, windows.stage_counts(stream(), "t", "stage", F.col("v") > 1), "counts")
    assert sorted((str(r.start), r.stage, r.n, r.failed) for r in counts) == [("2024-01-01 00:00:00", "a", 2, 1), ("2024-01-01 01:00:00", "b", 1, 1)]
    cooled = run(spark, tmp_path, windows.cooled_down(stream(), "t", "stage"), "cooled")
    assert sorted(r.v for r in cooled) == [1, 3]
    totals = run(spark, tmp_path, windows.rate(stream(), "t", "v"), "totals", "complete")
    assert sum(r.total for r in totals) == 3 * 10
    active = run(spark, tmp_path, windows.sessions(stream(), "t", "stage", "40 minutes"), "active")
    assert ("a", 2) in {(r.stage, r.n) for r in active}


def test_append_new(spark, tmp_path):
    batch = spark.createDataFrame([("h1", "a"), ("h1", "b"), ("h2", "c")], "file_hash string, path string")
    windows.append_new(batch, str(tmp_path / "known"))
    windows.append_new(batch, str(tmp_path / "known"))
    assert spark.read.parquet(str(tmp_path / "known")).count() == 2


def resumed(spark, tmp_path, df, name, mode="append"):
    """What one more start of the query adds, with the checkpoint of the starts before."""
    start = len(list((tmp_path / f"{name}-out").glob("*"))) if (tmp_path / f"{name}-out").exists() else 0

    def keep(batch, n):
        batch.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"{name}-out" / f"{n:05d}"))

    q = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return [r for p in sorted((tmp_path / f"{name}-out").glob("*"))[start:] for r in spark.read.parquet(str(p)).collect()]


def written(spark, path, n, rows):
    df = spark.createDataFrame(rows, "t string, k string, v double").select(F.to_timestamp("t").alias("t"), "k", "v")
    df.coalesce(1).write.mode("append").parquet(str(path))
    return df.schema


def streamed(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_last_events_ring_survives_a_restart_and_takes_late_rows(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    schema = written(spark, tmp_path / "in", 0, [(at(m), "a", float(m)) for m in range(5)] + [(at(1), "b", None)])
    first = resumed(spark, tmp_path, state.last_events(streamed(spark, tmp_path / "in", schema), "k", "t", "v", 3), "ring", "update")
    assert {(r.key, r.n, r.p50) for r in first} == {("a", 3, 3.0), ("b", 1, None)}
    written(spark, tmp_path / "in", 1, [(at(3), "a", 30.0), ("2023-01-01 00:00:00", "a", 99.0)])  # late, and too late
    again = resumed(spark, tmp_path, state.last_events(streamed(spark, tmp_path / "in", schema), "k", "t", "v", 3), "ring", "update")
    assert [(r.key, r.n, r.p50, str(r.newest)) for r in again if r.key == "a"][-1] == ("a", 3, 4.0, "2024-01-01 00:04:00")


def test_stuck_queues_are_reported_once_and_after_a_restart(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    queue = lambda: state.stuck_queues(streamed(spark, tmp_path / "in", schema), "k", "t", "v")
    schema = written(spark, tmp_path / "in", 0, [(at(0), "halted", 2.0), (at(1), "halted", -1.0), (at(0), "empty", 1.0), (at(1), "empty", -1.0), (at(2), "busy", 1.0)])
    resumed(spark, tmp_path, queue(), "stuck")
    written(spark, tmp_path / "in", 1, [(at(9), "busy", 1.0)])
    written(spark, tmp_path / "in", 2, [(at(10), "busy", -1.0)])
    got = resumed(spark, tmp_path, queue(), "stuck")
    assert [(r.key, r.pending, str(r.last)) for r in got] == [("halted", 1, "2024-01-01 00:01:00")]
    written(spark, tmp_path / "in", 3, [(at(30), "halted", 1.0)])
    written(spark, tmp_path / "in", 4, [(at(50), "other", 0.0)])
    got = resumed(spark, tmp_path, queue(), "stuck")
    assert {(r.key, r.pending) for r in got} == {("halted", 2), ("busy", 1)}


def test_cursor_source_loses_and_doubles_nothing(spark, tmp_path):
    total, broken = 23, tmp_path / "broken"

    class Service(CursorSource):
        columns = "id long, title string"

        @staticmethod
        def fetch(cursor, total=total, broken=str(broken)):
            import os

            low = 0 if cursor == "*" else int(cursor.split("-")[1])
            if low == 12 and not os.path.exists(broken):
                open(broken, "w").close()
                raise OSError("the service is down")
            rows = [(i, f"work {i}") for i in range(low, min(total, low + 4))]
            return rows, f"c-{low + 4}" if low + 4 < total else None

    spark.dataSource.register(Service)
    out, failed = str(tmp_path / "out"), 0
    for _ in range(2):
        q = spark.readStream.format("cursor").option("pages", 2).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        except Exception as e:
            assert "the service is down" in str(e)
            failed += 1
        finally:
            q.stop()
    assert failed == 1
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(total))
