"""Each pipeline stage against a plain version on the smallest tables."""

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptoria.llm import decontaminate, language_id, near_dedup, packing, quality_rules
from test_models import brute_components

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SMALL)
        rows = [r.asDict() for r in found.collect()]
        out.append((name, [r.asDict() for r in docs.collect()], rows, found.columns, docs.columns))
        if name != "packing":
            docs = spark.createDataFrame(rows, docs.schema) if rows else docs.limit(0)
    return {name: rest for name, *rest in out}


def test_all_but_the_last_return_documents(stages):
    assert list(stages) == ["quality_rules", "language_id", "near_dedup", "decontaminate", "packing"]
    assert all(columns == given for name, (_, _, columns, given) in stages.items() if name != "packing")


def test_quality_stage(stages):
    before, after, *_ = stages["quality_rules"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.oracle_select()}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in after} == kept and len(after) < len(before)


def test_near_dedup_stage(stages):
    before, after, *_ = stages["near_dedup"]
    roots, _ = brute_components({r["doc_id"]: r["text"] for r in before}, 5, 80, 100)
    assert {r["doc_id"] for r in after} == {k for k, v in roots.items() if k == v} and len(after) < len(before)


def test_decontamination_stage(spark, stages):
    before, after, *_ = stages["decontaminate"]
    items = [decontaminate.word_hashes(r.text)[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").where("text IS NOT NULL").collect()]

    def holds(text):
        h = decontaminate.word_hashes(text)[0]
        return any(decontaminate.smith_waterman(i, h)[0] >= len(i) for i in items if len(i))

    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not holds(r["text"])}


def test_language_and_packing_stages(stages):
    before, after, *_ = stages["language_id"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and len(after) >= 0.95 * len(before)
    docs, pieces, *_ = stages["packing"]
    total = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    length = {}
    for p in pieces:
        length[p["doc_id"]] = length.get(p["doc_id"], 0) + p["length"]
    assert set(total) == {r["doc_id"] for r in docs} and length == total


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").where(F.lit(False)).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_null_keys_and_repeats(spark):
    stage = dict(corpus_pipeline.STAGES)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("text IS NOT NULL").first().text
    clean = " ".join(f"a{i} sentence{i % 7} of{i % 11} its own" for i in range(60))
    copy, long_text = clean + " and one more", "very long text " * 40_000
    rows = [(1, clean), (2, copy), (None, clean), (1, clean), (None, "quite another text with words of its own"), (None, "quite another text with words of its own"), (3, None), (4, ""), (5, item), (None, item), (5, long_text)]
    names = ("score", "lang_pred", "_hash", "key", "row", "text_hash", "c0", "component_id")
    df = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string").withColumns({n: F.lit(f"keep {n}") for n in names})
    for name in ("quality_rules", "language_id", "near_dedup", "decontaminate"):
        got = stage[name](spark, df, SMALL)
        assert got.columns == df.columns
        assert all(r[n] == f"keep {n}" for r in got.collect() for n in names)
    left = sorted(((r.doc_id, r.text) for r in stage["near_dedup"](spark, df, SMALL).collect()), key=str)
    assert left == sorted({(1, clean), (None, rows[4][1]), (3, None), (4, ""), (5, item), (5, long_text)}, key=str)
    left = sorted(((r.doc_id, r.text) for r in stage["decontaminate"](spark, df, SMALL).collect()), key=str)
    assert left == sorted([r for r in rows if r[1] != item], key=str)


def test_a_worker_keeps_the_state_of_one_operator():
    """Spark uses its Python workers again: what the stages leave there would add up."""
    path, model = public_tokenizers.path("byte_bpe_50k.json"), {"a": "some words of text", "b": "other ones"}
    packing.tokenizer(path)
    language_id.parser_of(model)
    assert language_id._parsers and not packing._tokenizers
    near_dedup.begin()
    near_dedup.shingle_set("some words of text", 3)
    assert near_dedup._words and not language_id._parsers
    packing.tokenizer(path)
    assert packing._tokenizers and not near_dedup._words
