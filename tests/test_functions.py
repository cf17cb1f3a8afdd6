"""Text, retrieval, graph, evaluation and draft functions on literal fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scriptoria.functions import text as tx
from scriptoria.operators import drafts, evaluation, graph, relational, retrieval, vectors
from scriptoria.plans import registry
from scriptoria.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("query", "method", "clean"),
    [
        ("short one", "passthrough", "short one"),
        (None, "passthrough", ""),
        ("You are a helper. What is rain? ok", "question_extraction", "What is rain?"),
        ("word " * 90 + "end. Why so? bye", "question_extraction", "Why so?"),
        ("Long start. " * 40 + "Almost last one. Last one.", "tail_sentence", "Almost last one. Last one."),
        ("x" * 600, "tail_truncate", "x" * 500),
    ],
)
def test_sanitised(spark, query, method, clean):
    got = one(spark, retrieval.sanitised(F.lit(query).cast("string")))
    assert (got.method, got.clean) == (method, clean)


def test_fusion_and_boosts(spark):
    leg = lambda ids: spark.createDataFrame([(x, k + 1) for k, x in enumerate(ids)], "id string, rank int")
    s = {r.id: r.score for r in retrieval.fuse([leg("ab"), leg("bc")]).collect()}
    assert s["b"] == pytest.approx(1 / 62 + 1 / 61) and max(s, key=s.get) == "b"
    counts = spark.createDataFrame([("5", 5), ("10", 10), ("50", 50)], "id string, n int")
    boosted = retrieval.count_boost(spark.createDataFrame([(str(n), 1.0) for n in (0, 5, 10, 50)], "id string, score double"), counts, 0.1)
    assert {r.id: round(r.score, 2) for r in boosted.collect()} == {"0": 1.0, "5": 1.26, "10": 1.35, "50": 1.57}


def test_mmr_promotes_the_distinct_one(spark):
    c = spark.createDataFrame([("g", "a", 1.0, ["x", "y"]), ("g", "b", 0.95, ["x", "y"]), ("g", "c", 0.7, ["z"])], "group string, id string, score double, concepts array<string>")
    assert [r.id for r in retrieval.mmr(c, 3).orderBy("place").collect()] == ["a", "c", "b"]


def test_mmr_chooses_among_all_candidates(spark):
    rng = random.Random(6)
    rows = [("hot", i, 1.0, ["x", "y"]) for i in range(250)] + [("hot", 999, 0.9, ["z"])]
    rows += [("mixed", i, rng.random() ** 3, rng.sample("abcdefg", rng.randint(0, 4))) for i in range(600)] + [("few", i, i / 3, ["a"]) for i in range(3)]
    want = set()
    for g in ("hot", "mixed", "few"):
        left, chosen = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])), []
        while left and len(chosen) < 8:
            near = lambda c: max((len({*c} & {*o[3]}) / len({*c} | {*o[3]}) if {*c} | {*o[3]} else 0.0 for o in chosen), default=0.0)
            chosen.append(max(left, key=lambda r: 0.7 * r[2] - 0.3 * near(r[3])))
            left.remove(chosen[-1])
        want |= {(g, r[1], n + 1) for n, r in enumerate(chosen)}
    got = retrieval.mmr(spark.createDataFrame(rows, "group string, id long, score double, concepts array<string>"), 8)
    assert {tuple(r) for r in got.collect()} == want and ("hot", 999, 2) in want



def test_cover_density():
    assert retrieval.cover_density([[0], [1]]) == pytest.approx(0.1)
    assert retrieval.cover_density([[0], [3]]) == pytest.approx(0.1 / 3)
    assert retrieval.cover_density([[0], []]) == 0.0


def test_headings_and_sections(spark):
    t = lambda h: one(spark, tx.section_type(F.lit(h)))
    assert [t("1. Experimental Results"), t("Experimental setup"), t("Results and Discussion"), t("???")] == ["results", "methods", "results", "unknown"]
    s = one(spark, tx.markdown_sections(F.lit("pre\n# A\nx\n\n#### B\ny\n##### no\n")))
    assert [(x.title, x.content) for x in s] == [("Abstract", "pre"), ("A", "x"), ("B", "y\n##### no")]


def test_chunks():
    text = " ".join(f"Sentence number {i} has some words." for i in range(300))
    parts = tx.chunk_text(text, "methods")
    assert len(parts) > 2 and all(len(p.split()) <= 512 for p in parts)
    assert parts[1].split(". ")[0] in parts[0]
    assert tx.chunk_text("a b. " * 400, "references") == [] and tx.chunk_text(None, "results") == []
    assert tx.chunk_text("word " * 900, "unknown") == [("word " * 900).strip()]


def test_markup(spark):
    assert one(spark, tx.table_to_text(F.lit("<table><tr><td>a</td><th>b</th></tr><tr><td>c</td><td>d</td></tr></table>"))) == "a | b\nc | d"
    assert one(spark, tx.has_equation(F.lit("$$x$$"))) and one(spark, tx.has_equation(F.lit("$a+b=cccccccc$"))) and not one(spark, tx.has_equation(F.lit("$5")))
    assert one(spark, tx.has_table(F.lit("|a|\n |b|"))) and not one(spark, tx.has_table(F.lit("|a|\nb")))


def test_names(spark):
    k = lambda n: one(spark, tx.surname_key(F.lit(n).cast("string")))
    assert [k("James K. Whittaker"), k("Whittaker, J. K."), k("Whittaker"), k(""), k("et al."), k(None)] == ["whittaker,j", "whittaker,j", "whittaker,", None, None, None]
    v = lambda a, b: one(spark, tx.self_cite(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>"))).verdict
    assert [v(["A Doe"], ["Doe, Anna"]), v(["A Doe"], ["B Roe"]), v([], ["B Roe"])] == [True, False, None]


def test_markers_swap_without_chaining(spark):
    m = F.create_map(F.lit(1), F.lit(2), F.lit(2), F.lit(1))
    assert one(spark, tx.remapped(F.lit("[1] and [2] and [7]"), m)) == "[2] and [1] and [7]"


def test_relations(spark):
    r = lambda x: one(spark, graph.canonical_relation(F.lit(x)))
    assert [r("leads to"), r("Inconsistent With"), r("part_of"), r("co-occurs  with"), r("unknown thing")] == ["forces", "contradicts", "part_of", "correlates_with", "unknown thing"]
    assert one(spark, graph.canonical_entity(F.lit(" CO₂  level -. "))) == "co2 level"


def test_page_rank_modes(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 3), (3, 3), (9, 1)], "src long, dst long")
    total = lambda standard: sum(r["rank"] for r in graph.page_rank(nodes, edges, rounds=8, standard=standard).collect())
    assert total(True) == pytest.approx(1.0) and total(False) < 0.99
    assert graph.page_rank(nodes.limit(0), edges).count() == 0


def test_statistics(spark):
    pairs = spark.createDataFrame([(False, True)] * 10 + [(True, False)] * 2 + [(True, True)], "a_correct boolean, b_correct boolean")
    m = evaluation.mcnemar(pairs).first()
    assert m.statistic == pytest.approx(49 / 12) and m.direction == "B_better" and m.p == pytest.approx(math.erfc(math.sqrt(49 / 24)))
    e = evaluation.rank_metrics(spark.createDataFrame([(1,), (3,), (0,), (11,)], "r int"), "r").first()
    assert (e.mrr10, e.recall10) == (pytest.approx(1 / 3), 0.5)
    b = evaluation.bootstrap(spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x")), "x", 200).first()
    assert b.low < b["mean"] < b.high and b.high - b.low < 1.5


def test_percentiles(spark):
    d = spark.range(1, 11).select(F.lit(1).alias("k"), "id")
    assert d.agg(F.percentile("id", F.lit(0.95))).first()[0] == pytest.approx(9.55)
    assert relational.index_percentile(d, ["k"], "id", {"p": 0.95}).first().p == 10


def test_zero_fill_and_histogram(spark):
    f = spark.createDataFrame([("2024-01-03",), ("2024-01-17",)], "t string").select(F.to_timestamp("t").alias("t"))
    z = relational.zero_filled(f, "t", "week", "2024-01-01", "2024-01-22", {"n": F.count("*")}).orderBy("bucket").collect()
    assert [r.n for r in z] == [1, 0, 1, 0]
    h = relational.histogram(spark.createDataFrame([(5.0,), (5.0,)], "x double"), "x", 4).collect()
    assert [(r.bin, r.n) for r in h] == [(0, 2)]


def test_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])], "id long, v array<double>")
    assert [(r.id, round(r.score, 3)) for r in vectors.knn(d, "id", "v", [1.0, 0.0], 3).collect()] == [(1, 1.0), (2, 0.6), (3, 0.0)]
    assert vectors.centroid(d, "v").first().centroid == [pytest.approx(1.6 / 3), pytest.approx(0.8 / 3)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, t in (("a.txt", "x"), ("b.txt", "x"), ("c.md", "y")):
        (tmp_path / "in" / n).write_text(t)
    found = readers.files(spark, str(tmp_path / "in"), "*.txt")
    assert found.count() == 2 and readers.new_files(found, found.limit(0)).count() == 1 and readers.new_files(found, found).count() == 0
    sinks.write_shortlist(spark.createDataFrame([(1, "a\tb", 0.5)], "rank int, title string, rrf_score double"), str(tmp_path / "s"))
    back = readers.shortlist(spark, str(tmp_path / "s"))
    assert back.columns == sinks.SHORTLIST_COLUMNS and back.first().title == "a b" and back.first().rrf_score == "0.5000"
    sinks.write_catalog(spark.createDataFrame([(1, ["p", "q"])], "id int, tags array<string>"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().tags == "p; q"


def test_paged_source(spark):
    class Numbers(readers.PagedSource):
        columns = "n int"

        @staticmethod
        def fetch(page):
            return iter([(page * 2,), (page * 2 + 1,)])

        @classmethod
        def name(cls):
            return "numbers"

    spark.dataSource.register(Numbers)
    assert sorted(r.n for r in spark.read.format("numbers").option("pages", "3").load().collect()) == [0, 1, 2, 3, 4, 5]


def test_feedback_and_timeline(spark):
    f = spark.createDataFrame([(" 10.1/A", "", "t", 1, 1), ("10.1/a", None, "u", -1, 2), (None, "", " ", 1, 3)], "doi string, arxiv_id string, title string, vote int, at int")
    assert [(r.key, r.vote) for r in drafts.feedback_by_key(f).collect()] == [("doi:10.1/a", -1)]


def test_upsert_keeps_the_richer_value(spark):
    old = spark.createDataFrame([(1, "t", "done", 1)], "id int, title string, status string, n int")
    new = spark.createDataFrame([(1, "", "new", 1), (2, "u", "new", 1)], "id int, title string, status string, n int")
    got = {r.id: tuple(r) for r in relational.upsert(old, new, "id", ("status",), "n").collect()}
    assert got == {1: (1, "t", "done", 2), 2: (2, "u", "new", 1)}


def test_knn_join_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.0, 0.0, 0.5, 2.0)) for _ in range(3)]) for i in range(300)] + [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0]), (None, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, vector array<float>").repartition(5)
    size = lambda x: math.sqrt(sum(y * y for y in x))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (size(a) * size(b)) if a and b and len(a) == len(b) and size(a) * size(b) else 0.0
    want = set()
    for i, a in rows[:304:10] + rows[300:303]:
        nearest = sorted((-round(cos(a, b), 9), j) for j, b in rows if j is not None and j != i)[:7]
        want |= {(i, j, -s, n + 1) for n, (s, j) in enumerate(nearest)}
    q = v.where("id % 10 = 0 or id >= 300")
    for block_rows in (4, 2000):
        got = vectors.knn_join(q, v, 7, block_rows).collect()
        assert {(r.query_id, r.rank) for r in got} == {(x[0], x[3]) for x in want}
        assert {(r.query_id, r.rank, round(r.score, 9) + 0.0) for r in got} == {(x[0], x[3], x[2] + 0.0) for x in want}
    assert vectors.knn_join(q.limit(0), v, 7).count() == 0 and vectors.knn_join(q, v.limit(0), 7).count() == 0


def test_search_join_takes_every_fiftieth_row(spark):
    d = "/root/testdata/sf0.001"
    want = {r.vec_id for r in spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    assert {r.query_id for r in registry.queries()["r21_knn_join_all"](spark, d).collect()} == want


def test_index_and_scan_agree(spark, tmp_path):
    """Postings give the lexical leg of a scan; sparse scores are the weighted counts."""
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("the of and cat dog Haus über".split()) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, ""), (902, "the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = retrieval.write_postings(docs, "doc_id", "text", str(tmp_path / "postings"), bucket_docs=20, salt_docs=100)
    found = index.of(["the", "of", "and", "cat"])
    want = [tuple(r) for r in retrieval.full_text(docs, "doc_id", "text", "The of, and", 40).collect()]
    got = [tuple(r) for r in retrieval.indexed_full_text(found, "the of and", 40).collect()]
    assert len(got) == 40 and [x[0] for x in got] == [x[0] for x in want] and [x[1] for x in got] == pytest.approx([x[1] for x in want])
    legs = retrieval.text_legs(found, {"cat": 2.0, "the": 0.5}, "of").collect()
    sparse = {r.id: r.score for r in legs if r.leg == "sparse"}
    count = lambda t, w: t.lower().split().count(w)
    assert sparse == {i: 2.0 * count(t, "cat") + 0.5 * count(t, "the") for i, t in rows if t and (count(t, "cat") or count(t, "the"))}
    assert retrieval.write_postings(docs.limit(0), "doc_id", "text", str(tmp_path / "none")).of(["the"]).count() == 0


def test_bootstrap_interval_against_resampling(spark):
    import numpy as np

    x = np.random.default_rng(4).exponential(size=400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None)], "id long, x double")
    b = evaluation.bootstrap(df, "x", 2000).first()
    means = np.random.default_rng(5).choice(x, size=(2000, 400)).mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    assert b["mean"] == pytest.approx(x.mean()) and abs(b.low - low) < 0.02 and abs(b.high - high) < 0.02
    assert b == evaluation.bootstrap(df.repartition(7), "x", 2000).first() or abs(b.low - evaluation.bootstrap(df.repartition(7), "x", 2000).first().low) < 1e-9


def test_prose_diff_of_long_texts_and_nulls(spark):
    words = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, words, words + " w1 w1 new"), (2, None, "a a"), (3, "a a", None), (4, "", "")], "k int, a string, b string")
    got = {r.k: (r.p.words_added, r.p.words_removed) for r in df.select("k", tx.prose_diff(F.col("a"), F.col("b")).alias("p")).collect()}
    assert got == {1: (3, 0), 2: (2, 0), 3: (0, 2), 4: (0, 0)}


def test_page_rank_equals_a_plain_version(spark):
    rows = [(i, (7 * i + k) % 23) for i in range(60) for k in range(i % 4)] + [(70, 70), (5, 6), (5, 6), (99, 3)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    ids = sorted({x for r in rows for x in r})
    known = [(a, b) for a, b in rows if a != b]
    for standard in (False, True):
        rank = {i: 1 / len(ids) for i in ids}
        for _ in range(12):
            total = sum(v for i, v in rank.items() if not standard or all(a != i for a, _ in known))
            got = {i: sum(rank[a] / sum(x == a for x, _ in known) for a, b in known if b == i) for i in ids}
            free = {i: standard or all(a != i for a, _ in known) for i in ids}
            rank = {i: 0.85 * (got[i] + (total / len(ids) if free[i] else 0)) + 0.15 / len(ids) for i in ids}
        found = graph.page_rank(None, edges, rounds=12, standard=standard)
        assert {r.id: r["rank"] for r in found.collect()} == pytest.approx(rank, rel=1e-12)
