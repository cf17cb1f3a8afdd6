"""Wiki pages, layout trees, figure markers, ingest runs and exports on fixtures."""

import json
import re

import pytest
from pyspark.sql import functions as F

from scriptoria.operators import ingest
from scriptoria.operators import wiki as ops
from scriptoria.sources import readers, sinks


def test_layout_tree_of_any_depth(spark):
    deep = {"block_type": "Text", "html": "<p>deep</p>"}
    for i in range(150):
        deep = {"block_type": "Group" if i % 2 else "Page", "children": [deep]}
    tree = {"children": [{"block_type": "SectionHeader", "html": "<b>A</b>"}, deep, {"block_type": "Table", "html": "no rows"}, {"block_type": "Figure", "children": [deep]}, {"block_type": "Odd"}, 3]}
    rows = [(1, json.dumps(tree)), (2, None), (3, ""), (4, "{}"), (5, "[1]"), (6, "{broken"), (7, '{"children": [{"block_type": "Text"}]}')]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id long, t string").select("id", readers.tree_text(F.col("t")).alias("t")).collect()}
    assert got == {1: "## A\n\ndeep\n\nno rows", 2: "", 3: "", 4: "", 5: "", 6: "", 7: ""}


def test_markdown_pages_and_their_links(spark, tmp_path):
    for kind, slug, text in [("papers", "a+b", "---\ntitle: The A\ntype: paper\n---\n\nSee [[c]], [[c]], [[c|words]], [[a+b]] and [[d|x|y]]"), ("concepts", "c", "plain [[a+b]] [[]] [x]"), ("other", "z", "[[c]]")]:
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / f"{slug}.md").write_text(text)
    (tmp_path / "papers" / "skip.txt").write_text("[[c]]")
    pages = readers.markdown_pages(spark, str(tmp_path))
    assert {(r.slug, r.kind, r.title) for r in pages.collect()} == {("a+b", "papers", "The A"), ("c", "concepts", None)}
    got = sorted(tuple(r) for r in ops.page_links(pages).collect())
    assert got == [("a+b", "c", "c", ""), ("c", "a+b", "The A", ""), ("c", "a+b", "The A", "words"), ("d", "a+b", "The A", "x|y")]
    assert readers.markdown_pages(spark, str(tmp_path / "nothing")).count() == 0


def test_saved_pages_carry_front_matter(spark):
    row = spark.range(1).select(ops.page_markdown(F.lit("T"), F.lit("paper"), F.lit(None).cast("array<string>"), F.lit("2024-05-06").cast("date"), F.lit("body")).alias("m")).first()
    assert row.m == "---\ntitle: T\ntype: paper\nsources: 0 papers\nlast_updated: 2024-05-06\n---\n\nbody"


def test_annotations_are_trimmed_cut_and_deleted(spark):
    schema = "slug string, body string, updated_at int"
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("c", "z", 1)], schema)
    new = spark.createDataFrame([("a", " \n", 2), ("b", None, 2), ("d", " " + "é" * 30_000, 2)], schema)
    assert {tuple(r) for r in ops.annotate(old, new).collect()} == {("c", "z", 1), ("d", "é" * 20_000, 2)}


def plain_sentence(text, marker):
    """The sentence around a marker's first appearance, by plain string search."""
    i = text.find(marker)
    start = max(text.rfind(b, 0, i) for b in (". ", "? ", "! ", "\n"))
    start = start + 2 if start >= 0 else max(0, i - 120)
    ends = [e for e in (text.find(b, i + len(marker)) for b in (". ", "? ", "! ", "\n")) if e >= 0]
    return text[start : min(ends) + 1 if ends else min(len(text), i + 120)].strip()


def test_figure_markers_and_their_sentences(spark):
    texts = ["One. Two [Fig. 2] is it! Three [table 3 b].", "x" * 200 + "[EQ4]" + "y" * 200, "[ Figure. 12 ]", "A\n bc [Fig 1]? d [Fig 1] e", "none [Figs 3] [Tab]", "", None, "z. " * 50 + "é [Equation 7]\nq"]
    got = sorted(tuple(r) for r in ops.figure_markers(spark.createDataFrame(list(enumerate(texts)), "draft long, text string")).collect())
    want = []
    for d, t in enumerate(texts):
        for place, m in enumerate(re.finditer(r"\[\s*(fig|tab|eq)[a-z]*\s*\.?\s*(\d+)(?:\s*[a-z])?\s*\]", t or "", re.I)):
            if "Figs" not in m.group(0):
                want.append((d, place, m.group(0), {"fig": "figure", "tab": "table", "eq": "equation"}[m.group(1).lower()], int(m.group(2)), plain_sentence(t, m.group(0))))
    assert got == want


def test_figure_report_scores(spark):
    drafts = spark.createDataFrame([(0, "a"), (1, "[Fig. 1] [Fig. 2]"), (2, None), (3, "[Fig. 1] [Tab. 1] [Eq. 1]"), (4, "[Fig. 1]"), (5, "[Fig. 9]")], "draft long, text string")
    visuals = spark.createDataFrame(
        [(1, "chart", "Figure 1", 0.9), (1, "image", "Fig. 2a", 0.9), (2, "table", "III", 0.8), (3, "figure", "1", 0.8), (3, "table", "1", 0.1), (3, "equation", "1", 0.1), (4, "figure", "1", 0.9), (4, None, None, None)],
        "draft long, kind string, figure string, score double",
    )
    entailed = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.5), (4, 0, 0.0)], "draft long, place int, score double")
    got = {r.draft: (r.n_markers, r.n_hallucinated, r.n_low_entailment, r.resolved_ratio, round(r.score, 6)) for r in ops.figure_report(drafts, visuals, entailed).collect()}
    assert got == {0: (0, 0, 0, 1.0, 1.0), 1: (2, 0, 1, 1.0, 0.79), 2: (0, 0, 0, 1.0, 0.5), 3: (3, 0, 0, 1.0, 0.7), 4: (1, 0, 1, 1.0, 0.7), 5: (1, 1, 0, 0.0, 0.0)}


def test_gap_candidates_of_no_gaps(spark):
    found = spark.createDataFrame([], "gap_id string, place int, doi string, title string, year int, relevance double")
    assert ops.gap_candidates(found, spark.createDataFrame([(None,)], "doi string")).count() == 0


def test_a_run_is_written_whole_and_can_be_done_again(spark, tmp_path):
    texts = spark.createDataFrame([(1, "# A title\nbody doi:10.1234/abc\n# References\n[1] x"), (2, None), (3, "")], "id long, text string")
    tables = ingest.run_tables(texts, "id", "text")
    for _ in range(2):
        sinks.write_run(tables, str(tmp_path), "r1")
    read = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in tables}
    assert {n: d.count() for n, d in read.items()} == {"documents": 3, "metadata": 3, "sections": 2, "chunks": 1}
    assert read["metadata"].where("id = 1").first().asDict() == {"id": 1, "title": "A title", "doi": "10.1234/abc", "arxiv_id": None, "run": "r1"}
    assert [r.run for r in spark.read.json(f"{tmp_path}/_runs/*").collect()] == ["r1"]


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_pending_list(spark, tmp_path, kind):
    rows = spark.createDataFrame([("d1", ["A", "B"], "pending"), ("d2", None, "done")], "doi string, authors array<string>, status string")
    sinks.write_pending(rows, str(tmp_path / "p"), kind)
    got = (spark.read.csv(str(tmp_path / "p"), header=True) if kind == "csv" else spark.read.json(str(tmp_path / "p"))).collect()
    assert [(r.doi, r.authors) for r in got] == [("d1", "A; B" if kind == "csv" else ["A", "B"])]
    assert sinks.pending_rows(rows, None).count() == 2


def test_bench_run_and_its_latest(spark, tmp_path):
    results = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "name string, value double")
    place = sinks.write_bench(results, str(tmp_path), "t1", "x", "name")
    lines = [json.loads(r.value) for r in spark.read.text(place).collect()]
    assert lines[0] == {"_kind": "header", "timestamp": "t1", "tag": "x", "n_benchmarks": 2}
    assert [x["name"] for x in lines[1:]] == ["a", "b"]
    assert spark.read.json(f"{tmp_path}/latest").first().file == place
