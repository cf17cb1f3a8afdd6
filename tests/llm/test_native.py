"""Sharding, chat formatting, quality rules and URL filters."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scriptoria.llm import chat_format, quality_rules, sharding, url_filters

HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|x|>", "<\\\\|", "a<|", "", "tail\n", "<|im_start|>user\nhi<|im_end|>\n", "ü€𐍈"]


def brute_rules(text):
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, lines = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), lines, len(covered)


RULE_TEXTS = [None, "", "   \n ", "one", "a b c d e a b c d e", "a a a a a a a", "x y z w v u\nx y z w v u\n\nx", "ab#* |\u00a0c\n" * 3, "the of and " * 400, "p q r s t " * 2 + "end"]


def test_quality_measures_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(RULE_TEXTS)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    for i, t in enumerate(RULE_TEXTS):
        n, chars, symbols, lines, repeats = brute_rules(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), t
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)


def test_quality_rules_on_an_empty_table_and_in_a_filter(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.quality_rules(df).count() == 0
    good = "The house of the man is in the town and it was old but good."
    df = spark.createDataFrame([(1, good), (2, "### *** " * 20)], "doc_id long, text string")
    assert [r.doc_id for r in df.where(quality_rules.judgement(F.col("text"))["kept"]).collect()] == [1]


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("https://m.example.com/fr/1", "m.example.com", "/fr/1", "com/", "allow"),
        ("https://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        ("https://a.net/ES/1", "a.net", "/ES/1", None, "allow"),
        ("https://a.net", "a.net", "", None, "allow"),
        ("http://com?x", "com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://notcom/", "notcom", "/", None, "allow"),
        ("x://com/", "com", "/", "com/", "allow"),
    ],
)
def test_url_filter(spark, url, host, path, rule, verdict):
    rules = spark.createDataFrame(list(url_filters.CONTRACT_RULES), "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, url, "clash"), (1, url, "clash")], "page_id long, url string, host string")
    rows = url_filters.url_filter(pages, rules).collect()
    assert len(rows) == 2
    assert (rows[0].host, rows[0].path, rows[0].rule, rows[0].verdict) == (host, path, rule, verdict)


def test_url_filter_by_shuffle_and_with_partial_segments(spark):
    rules = spark.createDataFrame([("b.org", "/ads", "block"), ("b.org", "", "allow"), ("b.org", "/ads", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.b.org/adsense/1"), (2, "http://b.org/a"), (3, "http://b.orgs/ads")], "page_id long, url string")
    for limit in (0, 100):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filters.url_filter(pages, rules, broadcast_rules=limit).collect()}
        assert got == {1: ("b.org/ads", "block"), 2: ("b.org", "allow"), 3: (None, "allow")}
    assert url_filters.url_filter(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.url_filter(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_sharding(spark):
    texts = [(i, "t" * (i % 7)) for i in range(2000)] + [(5, "same")] * 500 + [(None, None)] * 3
    out = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string"), [1.0] * 16, 1.0).collect()
    assert len(out) == len(texts)
    shards, of = defaultdict(list), defaultdict(set)
    for r in out:
        shards[r.shard].append(r.slot)
        of[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert all(len(v) == 1 for v in of.values())
    moved = sum(r.grown_shard == 16 for r in out if r.doc_id != 5) / 2000
    assert 0.03 < moved < 0.09
    one = next(r for r in out if r.doc_id == 6)
    assert (one.size, one.text_crc32) == (7, zlib.crc32(b"t" * 6))
    none = next(r for r in out if r.doc_id is None)
    assert (none.size, none.text_crc32) == (1, 0)
    heavy = sharding.shard(spark.createDataFrame([(i, "") for i in range(4000)], "doc_id long, text string"), [1.0, 3.0]).groupBy("shard").count().collect()
    assert 2850 < {r.shard: r["count"] for r in heavy}[1] < 3150


def test_chat_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "us%er\n<|", t) for i, t in enumerate(HARD)] + [(None, 0, None, None), (2, 0, "user", None)]
    records = chat_format.conversations_as_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat_format.format_chats(records, ["conv_id"])
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "segments", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t) for _, _, r, t in rows[: len(HARD)]]
    assert got[1].loss == "".join(HARD[1::2])
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    digest = {r.conv_id: r for r in chat_format.digests(out).collect()}
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[: len(HARD)])
    assert digest[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert digest[2].n_turns == 1 and digest[2].loss_chars == 0


def test_chat_layouts(spark):
    df = spark.createDataFrame(
        [(1, "ask", None, "answer", None, None), (2, None, None, "out", "do", "with"), (3, None, None, None, None, None), (4, None, "sys", None, None, None)],
        "id long, prompt string, system string, output string, instruction string, input string",
    ).withColumn("conversations", F.when(F.col("id") == 3, F.array(F.struct(F.lit("human").alias("from"), F.lit("hi").alias("value")))))
    got = {r.id: r for r in chat_format.format_chats(df, ["id"]).collect()}
    assert got[2].layout == "instruction_input" and "do\n\nwith" in got[2].formatted
    assert got[3].layout == "share" and got[3].formatted == "<|im_start|>user\nhi<|im_end|>\n"
    assert got[1].layout is None and got[4].formatted is None


def test_url_filter_plans_agree(spark):
    """By shape, exploded with a broadcast and exploded by shuffle."""
    hosts = ["a.b.c.com", "com", "x.com", "", "c.com", "b.c.com"]
    paths = ["", "/", "/p", "/p/", "/p/q/r", "/pq/"]
    pages = spark.createDataFrame([(i, None if i == 7 else f"http://{h}{p}?x") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)], "page_id long, url string").withColumn("_host", F.lit("clash"))
    rules = spark.createDataFrame([("com", "/", "block"), ("c.com", "", "allow"), ("c.com", "/p", "block"), ("c.com", "/p", "allow"), ("b.c.com", "/p/q", "allow"), ("x.com", None, "block"), ("", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    plans = [url_filters.url_filter(pages, rules, **k) for k in ({}, {"max_shapes": 1}, {"broadcast_rules": 1})]
    got = [sorted(map(tuple, p.collect()), key=str) for p in plans]
    assert got[0] == got[1] == got[2] and len(got[0]) == 36
    by_id = {r.page_id: r for r in plans[0].collect()}
    assert by_id[2].rule == "c.com/p" and by_id[2].verdict == "block" and by_id[4].rule == "b.c.com/p/q" and by_id[7].rule is None
    assert "Exchange hashpartitioning(_id" not in plans[0]._jdf.queryExecution().toString()


def test_stop_words_judge_known_languages_alone(spark):
    text = "ala ma kota i psa ktorego bardzo lubi wiec chodzi z nim codziennie rano albo wieczorem nad rzeke gdzie plywaja kaczki oraz labedzie potem wraca domu pije herbate czyta gazete slucha radia pisze listy swoich dawnych kolegow szkolnych."
    df = spark.createDataFrame([(1, text, "en"), (2, text, "pl"), (3, text, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df, lang_col="lang").collect()}
    assert [got[i].failed_stop_word_share for i in (1, 2, 3)] == [True, False, False] and [got[i].kept for i in (1, 2, 3)] == [False, True, True]
    assert all(r.kept for r in quality_rules.quality_rules(df).collect())


def test_quality_rules_of_a_very_long_text(spark):
    words = [f"w{i % 50_000}" for i in range(100_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:50_000]))], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality_rules.quality_rules(df).collect()} == {1: (100_000, 100_000), 2: (50_000, 0)}


def test_chats_with_extra_filled_fields(spark):
    df = spark.createDataFrame([(1, "q", "a", "crawl 7", 3, "x"), (2, "q", None, "s", 4, None)], "_turns long, prompt string, response string, origin string, layout int, _m string")
    got = {r["_turns"]: r for r in chat_format.format_chats(df, ["_turns"]).collect()}
    assert got[1].layout == "prompt_response" and "q" in got[1].formatted and got[2].layout is None and got[2].formatted is None
    assert chat_format.format_chats(df.limit(0), ["_turns"]).count() == 0


def test_shards_are_the_rendezvous_winners(spark):
    """Recomputed key by key; slots without gaps over several buckets; names that clash."""
    import math

    weights = [1.0, 2.0, 1.0]
    df = spark.createDataFrame([(i if i % 50 else None, f"t{i % 7}") for i in range(2000)], "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("key", F.lit("y"))
    rows = sharding.shard(df, weights, 1.5, bucket_rows=10).collect()
    keys = sorted({r.doc_id for r in rows if r.doc_id is not None})
    hashed = spark.createDataFrame([(f"k{k}", j) for k in keys for j in range(4)], "k string, j int").select("k", "j", F.xxhash64("k", "j").alias("h")).collect()
    score = {(r.k, r.j): -[*weights, 1.5][r.j] / math.log((((r.h % (1 << 64)) >> 12) + 0.5) / (1 << 52)) for r in hashed}
    winner = {k: [max(range(n), key=lambda j: (score[f"k{k}", j], -j)) for n in (3, 4)] for k in keys}
    assert all([r.shard, r.grown_shard] == winner[r.doc_id] for r in rows if r.doc_id is not None)
    for shard in range(3):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert sharding.shard(df.limit(0), weights).count() == 0


def test_chats_with_empty_optional_fields_and_more_layouts(spark):
    rows = [
        ("a", {"instruction": "Name three colours.", "input": "", "output": "red"}, [("user", "Name three colours."), ("assistant", "red")]),
        ("b", {"instruction": "Name", "input": "  ", "output": "x", "system": ""}, [("user", "Name"), ("assistant", "x")]),
        ("c", {"instruction": "Name", "input": "three", "output": "x", "system": "Be brief"}, [("system", "Be brief"), ("user", "Name\n\nthree"), ("assistant", "x")]),
        ("d", {"system": "S", "messages": [("user", "hi", None), ("assistant", "ok", None)]}, [("system", "S"), ("user", "hi"), ("assistant", "ok")]),
        ("e", {"system": "", "messages": [("user", "hi", None)]}, [("user", "hi")]),
        ("f", {"messages": [("user", "sum", None), ("assistant", None, [("add", "1,2")]), ("tool", "3", None)]}, [("user", "sum"), ("assistant", '[{"name":"add","arguments":"1,2"}]'), ("tool", "3")]),
        ("g", {"query": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
        ("h", {"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
        ("i", {"text": "plain"}, [("assistant", "plain")]),
        ("j", {"prompt": "", "response": "r"}, [("user", ""), ("assistant", "r")]),
        ("k", {"answer": "alone"}, None),
    ]
    fields = ("instruction", "input", "output", "system", "query", "question", "answer", "text", "prompt", "response")
    schema = "id string, " + ", ".join(f"{f} string" for f in fields) + ", messages array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>>>"
    df = spark.createDataFrame([(k, *[v.get(f) for f in fields], v.get("messages")) for k, v, _ in rows], schema)
    got = {r.id: r.turns for r in chat_format.format_chats(df, ["id"]).select("id", chat_format.read_back(F.col("formatted")).alias("turns")).collect()}
    assert {k: None if v is None else [tuple(t) for t in v] for k, v in got.items()} == {k: want for k, _, want in rows}
