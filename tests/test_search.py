"""The vector index, the fielded text index and the title join against plain versions."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.operators import ann, fulltext, matching, vectors
from scriptoria.plans import registry, search
from scriptoria.session import table

SMALL = "/root/testdata/sf0.001"


def partition_filters(df):
    """What each file scan of the plan prunes folders by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [f for f in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if f]


def recall(found, exact):
    want = {}
    for r in exact:
        want.setdefault(r.query_id, set()).add(r.id)
    return sum(r.id in want[r.query_id] for r in found) / sum(map(len, want.values()))


@pytest.mark.parametrize("d", [SMALL, "/root/testdata/sf0.1"])
def test_ann_queries_reach_their_recall(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    asked = e.where("id % 50 = 0")
    got = registry.queries()["r2_ann_search"](spark, d).collect()
    assert recall(got, vectors.knn_join(asked, e, 10).collect()) >= 0.9
    assert all(r.query_id != r.id for r in got) and Counter(r.query_id for r in got) == {r.id: 10 for r in asked.collect()}
    filtered = registry.queries()["p6_ann_filtered"](spark, d).collect()
    few = e.where("label in (1, 2)")
    assert recall(filtered, vectors.knn_join(asked, few, 10).collect()) >= 0.9
    assert {r.id for r in filtered} <= {r.id for r in few.collect()}


def test_ann_reads_probed_lists_only(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.concatenate([c + 0.4 * rng.normal(size=(60, 16)) for c in rng.normal(size=(30, 16))])
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(5000 + i, x[7].tolist(), 0) for i in range(40)]
    rows += [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 16, 0), (9004, [1.0, 2.0], 0), (9005, [float("nan")] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    index = ann.write_index(df, str(tmp_path / "ix"), lists=40)
    assert index.probes <= 6  # clustered vectors need few
    asked = df.where("id % 50 = 0 OR id IN (9001, 9003, 9004)")
    got = index.search(asked, 5).collect()
    exact = vectors.knn_join(df.where("id % 50 = 0 AND id < 9000"), df.where("id < 9000"), 5).collect()
    assert recall(got, exact) >= 0.9 and {r.query_id for r in got} == {r.query_id for r in exact}
    assert not {r.id for r in got} & {None, 9001, 9002, 9003, 9004, 9005}
    again = ann.open_index(spark, str(tmp_path / "ix"))
    assert sorted(again.search(asked, 5).collect()) == sorted(got)
    filters = partition_filters(again.search(df.where("id = 0"), 5, probes=1))
    assert len(filters) == 2 and all("list#" in f for f in filters)  # of codes and vectors
    empty = ann.write_index(df.limit(0), str(tmp_path / "none"))
    assert empty.search(asked, 5).count() == 0 and index.search(asked.limit(0), 5).count() == 0


def plain_fields(rows, weights, query, k):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    terms, out = set(words(query)), []
    for i, *fields in rows:
        total = Counter()
        for w, f in zip(weights, fields, strict=True):
            for t in words(f):
                total[t] += w
        if i is not None and terms and terms <= set(total):
            out.append((-sum(total[t] for t in terms), i))
    return [(i, -s / 100) for s, i in sorted(out)[:k]]


def test_fielded_search_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = ["ice", "core", "sun", "sea", "level", "The", "of", "Élan"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(3), text(rng.choice((5, 20, 200))), None if i % 7 else "sea journal") for i in range(900)]
    rows += [(2000 + i, "same row", "ice core", "x") for i in range(300)] + [(3000, None, None, None), (None, "ice core", "ice", "x"), (3001, "", "", "")]
    df = spark.createDataFrame(rows, "id long, title string, body string, venue string")
    index = fulltext.write_fields(df, "id", {"title": "A", "body": "B", "venue": "D"}, str(tmp_path / "ix"), block_rows=16)
    for q, k in (("ice core", 10), ("élan", 25), ("the of sea level", 7), ("same", 12), ("same row", 500), ("nothing here", 5), ("", 5), (None, 5), ("journal journal", 3)):
        assert [tuple(r) for r in index.search(q, k).collect()] == plain_fields(rows, (100, 40, 10), q, k), q
    every = index.bounds(["ice", "core"])
    read = index.plan(["ice", "core"], 10)
    assert len(read) < len(every) / 2  # the others can't hold a better row
    assert "bucket#" in partition_filters(index.scored(["ice"], read))[0]
    none = fulltext.write_fields(df.limit(0), "id", {"title": "A", "body": "B", "venue": "D"}, str(tmp_path / "none"))
    assert none.search("ice", 5).count() == 0


def test_fielded_index_is_written_by_several_tasks_and_keeps_its_results(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["ice", "Core", "sea-level", "\u00a0x_y", "", "1\u00bd"]) for _ in range(rng.randrange(40))), rng.choice([None, "", " ice ", "x"])) for i in range(2_000)]
    df = spark.createDataFrame(rows, "id long, body string, venue string").repartition(3)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = fulltext.write_fields(df, "id", {"body": "B", "venue": "D"}, str(tmp_path / "ix"), bucket_rows=1_000, block_rows=1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert max(len(list(p.glob("*.parquet"))) for p in (tmp_path / "ix" / "postings").glob("bucket=*")) > 1
    assert index.postings.groupBy("token", "id").count().where("count > 1").count() == 0
    for q, k in (("ice", 30), ("core sea", 9), ("x y", 2_000), ("ice level x", 50)):
        assert [tuple(r) for r in index.search(q, k).collect()] == plain_fields(rows, (40, 10), q, k), q


def plain_matches(rows, asked, t):
    norm = {i: re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip() for i, x in rows if i is not None}
    classes = {}
    for i, n in norm.items():
        classes.setdefault(n, []).append(i)
    return sorted((i, min(ids), len(ids), round(s, 9)) for i in norm if asked(i) and norm[i] for n, ids in classes.items() if n and (s := matching.title_similarity(norm[i], n)) >= t)


@pytest.mark.parametrize("t", [0.7, 0.85])
def test_title_search_equals_brute_force(spark, t):
    rng = random.Random(9)
    words = ["a", "of", "ice", "cores", "climate", "climatic", "sun", "solar", "variability", "holocene", "10be", "record"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(250)]
    for i in range(250):  # edited copies: letters changed, words moved, subtitles
        w = list(rows[i][1])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice("abcde ")
        parts = "".join(w).split()
        if rng.random() < 0.3:
            rng.shuffle(parts)
        rows.append((1000 + i, " ".join(parts) + (": a review" if rng.random() < 0.2 else "")))
    rows += [(3000, None), (3010, ""), (3020, "!!"), (3030, "A"), (3040, "ab"), (3050, "abc d"), (3060, "abcd"), (3070, "ABC-D"), (3080, "x" * 300), (3090, "x" * 290), (3100, rows[0][1]), (3100, rows[0][1])]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "id long, title string").withColumn("norm", F.lit("clash"))
    got = sorted((r.id, r.other, r["size"], round(r.similarity, 9)) for r in matching.title_search(df, F.col("id") % 10 == 0, t).collect())
    assert got == plain_matches(rows, lambda i: i % 10 == 0, t) and len(got) > 100
    assert matching.title_search(df.limit(0), F.col("id") % 10 == 0, t).count() == 0


def test_title_query_equals_brute_force(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    rows = [(r.doc_id, re.match(r"[^.\n]*", r.text or "")[0]) for r in docs]
    got = sorted((r.doc, r.other, r["size"], r.similarity) for r in search.f15(spark, SMALL).collect())
    assert got == [(i, o, n, round(s, 4)) for i, o, n, s in plain_matches(rows, lambda i: i % 50 == 0, 0.85)]


def test_common_subsequence_bounds_the_ratio():
    rng = random.Random(2)
    for _ in range(300):
        x, y = ("".join(rng.choice("ab c") for _ in range(rng.randrange(30))) for _ in range(2))
        assert matching.ratio(x, y) * (len(x) + len(y)) <= 2 * matching.subsequence(x, y) + 1e-9


def test_centroids_are_fitted_without_the_scores_of_all_rows():
    x = np.random.default_rng(1).normal(size=(16_384, 8))
    tracemalloc.start()
    ann.fit_centroids(x, 1024, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_384 * 1024 * 8 / 2


def test_a_query_moves_once_for_a_block_whatever_its_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "CHUNK", 70)
    x = np.random.default_rng(5).normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    index = ann.write_index(df, str(tmp_path / "ix"), lists=20)
    assert index._visits(df.select("id", "vector"), 20).count() == 400
    found = [(r.query_id, r.id, r.rank) for r in index.search(df, 5, probes=20).collect()]
    assert sorted(found) == sorted((r.query_id, r.id, r.rank) for r in vectors.knn_join(df, df, 5).collect())


def test_title_search_moves_titles_not_grams(spark, monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", 20, raising=False)
    monkeypatch.setattr(matching, "PART", 50, raising=False)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(("ice", "core", "cores", "sea", "level", "record")) for _ in range(rng.randrange(1, 7)))) for i in range(300)]
    found = matching.title_search(spark.createDataFrame(rows, "id long, title string"), F.col("id") % 3 == 0, 0.85)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "gram" not in plan and "token" not in plan  # no row for a gram or a candidate
    got = sorted((r.id, r.other, r["size"], round(r.similarity, 9)) for r in found.collect())
    assert got == plain_matches(rows, lambda i: i % 3 == 0, 0.85)
