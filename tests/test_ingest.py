"""Blocks, references, versions, pools, near-duplicate chunks and evaluation on fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.functions import text as tx
from scriptoria.operators import evaluation, ingest, relational, retrieval, versions
from scriptoria.plans import registry

SMALL = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n else 0.0


@pytest.mark.parametrize("wave", [2048, 7])
def test_near_duplicate_chunks_are_those_of_the_greedy_pass(spark, wave):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        base = rng.normal(size=8) if i % 4 == 0 else np.array(rows[-1][2]) + rng.normal(size=8) * 0.12
        rows.append((i, "hot" if i % 3 else f"b{i % 5}", [float(x) for x in base], int(rng.integers(0, 20))))
    rows += [(900, "hot", [0.0] * 8, 3), (901, "hot", None, 3), (902, None, rows[0][2], 9), (903, None, rows[0][2], 9)]
    want, kept = set(), {}
    for i, b, v, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if v is not None and any(cosine(v, k) >= 0.92 for k in kept.get(b, [])):
            want.add(i)
        else:
            kept.setdefault(b, []).append(v if v is not None else [0.0] * 8)
    df = spark.createDataFrame(rows, "id long, bucket string, vector array<double>, size int")
    got = {r.id for r in versions.near_duplicate_chunks(df.where("bucket IS NOT NULL"), 0.92, wave).collect()}
    assert got == {i for i in want if i < 902} and len(got) > 30
    assert versions.near_duplicate_chunks(df.limit(0)).count() == 0


def test_promoted_lessons(spark):
    rows = [(1, 1, 10, "short", [1.0, 0.0], 0.9), (1, 2, 11, "a longer text", [0.99, 0.05], 0.9), (1, 3, 10, "alone", [0.0, 1.0], 0.8), (1, 4, 12, "known", [-1.0, 0.0], 0.7), (1, 5, 13, "known too", [-1.0, 0.01], 0.7)]
    lessons = spark.createDataFrame(rows, "library long, id long, book long, text string, vector array<double>, importance double")
    known = spark.createDataFrame([(1, [-1.0, 0.0])], "library long, vector array<double>")
    assert [tuple(r) for r in versions.promoted(lessons, known).collect()] == [(1, "a longer text", 2, 2)]


@pytest.mark.parametrize(
    ("sentence", "clauses"),
    [
        ("", []),
        ("One two three.", ["One two three."]),
        ("The ice has melted in the north; the sea has risen by one metre", ["The ice has melted in the north", "the sea has risen by one metre"]),
        ("The ice has melted fast, and rain has fallen in the south", ["The ice has melted fast", "rain has fallen in the south"]),
        ("We took red, and blue; green", ["We took red, and blue; green"]),
        ("ice is gone; sea is up;", ["ice is gone", "sea is up;"]),
        ("The  sun is weak — the ice  grows now", ["The  sun is weak", "the ice  grows now"]),
        ("One two three, but Rome was lost", ["One two three", "Rome was lost"]),
        ("One two three, but rain will fall", ["One two three, but rain will fall"]),
        ("One two three, and rain will fall", ["One two three", "rain will fall"]),
        ("a b c; d e f; g h i; j k l; m n o", ["a b c", "d e f", "g h i", "j k l"]),
        ("a b c; d e; f g h", ["a b c; d e; f g h"]),
        ("a b; c", ["a b; c"]),
        (None, []),
    ],
)
def test_clauses(spark, sentence, clauses):
    assert one(spark, ingest.clauses(F.lit(sentence))) == clauses


def test_plan_points(spark):
    assert one(spark, ingest.plan_points(F.lit("- first point is long enough\n- second point is long enough\n- x"))) == ["first point is long enough", "second point is long enough"]
    assert one(spark, ingest.plan_points(F.lit("A sentence that is long. Another one that is long."))) == ["A sentence that is long.", "Another one that is long."]
    assert one(spark, ingest.plan_points(F.lit("too short"))) == []
    assert ingest.plan_list("What comes before\n* one point of the plan\n  goes on here\n\n• the other point of it") == ["What comes before", "one point of the plan\n  goes on here", "the other point of it"]
    assert ingest.plan_list("it covers the ice cores; the tree rings of Norway | and the corals of Fiji") == ["it covers the ice cores", "the tree rings of Norway", "and the corals of Fiji"]
    assert ingest.plan_list("one two e.g. three four five. and no capital") == ["one two e.g. three four five. and no capital"]
    assert ingest.plan_list(None) == [] and ingest.plan_list("- etc.\n- i.e.\n- too short") == ["- etc.\n- i.e.\n- too short"]


def test_file_dois(spark):
    for path, doi in (("a/10.1234_x5.pdf", "10.1234/x5"), ("10.1234-x5.PDF", "10.1234/x5"), ("10.1234%2Fx5", "10.1234/x5"), ("10.12345_j.q_1-2.pdf", "10.12345/j.q_1-2"), ("paper.pdf", None), (None, None), ("10.1234.pdf", None)):
        assert one(spark, ingest.file_doi(F.lit(path).cast("string"))) == doi, path


def test_numbered_references_end_at_the_next_heading(spark):
    text = "# Intro\n## Works  Cited\n[1] Smith, J. (2001). A title that is long\nenough and goes on. J.\n2. Doe, A. (2002). Another title that is long enough. K.\n[3] short\n### Notes\n[4] Not, A. (2003). A reference that comes too late. L."
    assert one(spark, ingest.reference_entries(F.lit(text))) == ["[1] Smith, J. (2001). A title that is long\nenough and goes on. J.", "2. Doe, A. (2002). Another title that is long enough. K."]


def test_references_without_numbers_and_without_a_list(spark):
    text = "Body.\n# Bibliography\n\nSmith, J. (1999). A sufficiently long title here. J. X\n\nhttps://doi.org/10.1000/abc some words that follow"
    entries = one(spark, ingest.reference_entries(F.lit(text)))
    assert len(entries) == 2
    first, second = (one(spark, ingest.parsed_entry(F.lit(e))) for e in entries)
    assert (first.year, first.title) == (1999, "A sufficiently long title here") and second.doi == "10.1000/abc"
    assert one(spark, ingest.reference_entries(F.lit("no list"))) == [] and one(spark, ingest.reference_entries(F.lit(None).cast("string"))) == []
    assert one(spark, ingest.parsed_entry(F.lit("nothing to find in here at all"))) is None


def test_json_block(spark):
    assert one(spark, ingest.json_block(F.lit('Well: {"a": [1, 2,], } ok'))) == '{"a": [1, 2]}'
    assert one(spark, ingest.json_block(F.lit("none"))) is None


def test_terms_by_language(spark):
    assert sorted(one(spark, tx.language_terms(F.lit("Der Hund und the cat"), F.lit("de")))) == ["cat", "hund", "the"]
    assert sorted(one(spark, tx.language_terms(F.lit("Der Hund und the cat"), F.lit(None).cast("string")))) == ["cat", "der", "hund", "und"]
    assert one(spark, tx.language_config(F.lit("Dutch"))) == "dutch"


def test_paired_comparison(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.random() < 0.8, rng.random() < 0.6) for i in range(300)], "id long, a_correct boolean, b_correct boolean")
    r = evaluation.compare_paired(df, 500).first()
    assert r.a_low < r.a_mean < r.a_high and r.b_low < r.b_mean < r.b_high and r.direction == "A_better" and r.p < 0.05


def test_expansions_scroll_and_aliases(spark):
    assert one(spark, retrieval.accepted_expansion(F.lit("q"), F.lit("x" * 501))) == "q"
    df = spark.createDataFrame([(i, f" V{i % 3}") for i in range(10)], "k int, v string")
    assert [r.k for r in relational.scroll(df, "k", 3, 2).collect()] == [4, 5] and [r.k for r in relational.scroll(df, "k", None, 1).collect()] == [0]
    aliases = spark.createDataFrame([("One", ["v1", "V2"]), ("Two", None)], "canonical string, variants array<string>")
    assert {r.v: r.name for r in relational.with_aliases(df, "v", aliases).collect()} == {" V0": "v0", " V1": "one", " V2": "one"}


def test_context_rows_and_mentions_are_limited(spark):
    edges = spark.createDataFrame([(1, e, e == 5, [f"a context of some length {e % 3}"]) for e in range(9)], "id long, edge long, influential boolean, contexts array<string>")
    got = [r.context for r in ingest.contexts(edges, most=2).orderBy("place").collect()]
    assert got == ["a context of some length 2", "a context of some length 0"]
    p = spark.createDataFrame([(1, i, f"Tables 2 and Fig. 3.1, Eq 4 in {i}") for i in range(12)], "doc long, place int, text string")
    v = spark.createDataFrame([(1, 7, "table", 2), (1, 8, "figure", 3), (1, 9, "equation", 4)], "doc long, visual long, kind string, number int")
    found = ingest.mentions(p, v).groupBy("visual").count().collect()
    assert {r.visual: r["count"] for r in found} == {7: 8, 9: 8}


def test_near_duplicates_query_matches_the_greedy_pass(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    kept, want = {}, set()
    for r in sorted(rows, key=lambda r: (-(r.vec_id % 97), r.vec_id)):
        if any(cosine(r.embedding, v) >= 0.3 for v in kept.get(r.label, [])):
            want.add(r.vec_id)
        else:
            kept.setdefault(r.label, []).append(r.embedding)
    assert {r.id for r in registry.queries()["d4_near_duplicates"](spark, SMALL).collect()} == want


def test_contexts_of_one_edge_number_are_ordered_by_their_text(spark):
    rows = [(i, 7, False, [f"a context of some length {c}"]) for i in range(40) for c in "dbca"]
    df = spark.createDataFrame(rows, "id long, edge long, influential boolean, contexts array<string>").repartition(4)
    got = ingest.contexts(df, most=3).collect()
    assert sorted((r.id, r.place, r.context[-1]) for r in got) == [(i, p, c) for i in range(40) for p, c in enumerate("abc", 1)]
