"""Language ID, quality classifier, packing, HTML extraction, near-dedup, decontamination."""

import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scriptoria.llm import decontaminate, html_extract, language_id, near_dedup, packing, quality_model
from scriptoria.llm.samples import labelled_sample
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_50k.json")
EN = "the quick brown fox jumps over the lazy dog and the cat sat on the mat while it rained in the town"
DE = "der schnelle braune fuchs springt über den faulen hund und die katze sitzt auf der matte während es regnet"
ODD = [None, "", " ", "Hi there.", "a  b\n\n c \t d", "x\n y", "tail ", "\u00a0 \n z", "it's we'll 12 34!? \n\n\nok", "<|endoftext|> x", "é" * 900 + " word", "a" * 1500, "the cat " * 700]


def longest_phrases(text, source):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in source:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_parse_counts_match_brute_force():
    parser = language_id.Parser({"en": EN, "de": DE})
    table = {n: parser.alphabet.symbols(t) for n, t in (("en", EN), ("de", DE))}
    source = {n: "".join(chr(65 + c) for c in s) for n, s in table.items()}
    rng = random.Random(3)
    for _ in range(30):
        t = "".join(rng.choice("abcdefg thecrn") for _ in range(rng.randint(1, 400)))
        s = parser.alphabet.symbols(t)
        if not len(s):
            continue
        coded = "".join(chr(65 + c) for c in s)
        want = [longest_phrases(coded, source[n]) for n in parser.names]
        assert parser.phrases([s])[0].tolist() == want


def test_language_id_cases(spark):
    rows = [(1, EN, "en"), (2, DE, "de"), (3, "the dog and the cat", None), (4, "der hund und die katze", None), (5, None, "en"), (6, "123 !!", None), (7, "", None), (3, "the dog and the cat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language_id.train(df, "doc_id", "text", "lang")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, model, ["doc_id"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "de", 3: "en", 4: "de", 5: "und", 6: "und", 7: "und"}
    assert all(0 <= v[1] <= 1 for v in got.values())
    assert language_id.identify(df, model, ["doc_id"]).count() == len(rows)
    assert {r.lang_pred for r in language_id.identify(df, {}, ["doc_id"]).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model, ["doc_id"]).count() == 0


def test_sample_is_bounded_and_labelled(spark):
    df = spark.createDataFrame([(i, f"text {i}", None if i % 5 == 0 else i % 2) for i in range(500)], "k long, t string, y int")
    s = labelled_sample(df, df, F.col("k"), F.col("y"), F.col("t"), 20, 4)
    assert 30 <= len(s) <= 40 and all(t == "text" for _, t in s)


def test_quality_model(spark):
    good = [(i, f"a fine text number {i} with the usual words and an end.", 1) for i in range(60)]
    bad = [(100 + i, f"x{i}### y{i}*** z{i}### w{i}*** " * 3, 0) for i in range(60)]
    df = spark.createDataFrame([*good, *bad], "doc_id long, text string, quality int")
    model = quality_model.train(df, df, F.col("doc_id"), F.col("quality"), F.col("text"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "one fine text with words."), (4, "q### r*** s### t*** u###")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_model.score(odd, model, ["doc_id"]).collect()}
    assert got[3].predicted == 1 and got[4].predicted == 0 and got[1].score == got[2].score
    untrained = quality_model.train(df.limit(0), df, F.col("doc_id"), F.col("quality"), F.col("text"))
    assert {r.score for r in quality_model.score(odd, untrained, ["doc_id"]).collect()} == {0.5}


def test_fast_ids_match_the_tokenizer():
    reference = Tokenizer.from_file(PATH)
    reference.encode_special_tokens = True
    bpe = packing.ByteBpe(PATH)
    rng = random.Random(5)
    texts = [t for t in ODD if t] + ["".join(rng.choice("ab c.\n'\u00a0ü1 ") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(bpe.encode(t), dtype="<u4").tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t[:40])


@pytest.mark.parametrize("block", [1 << 19, 1500])
def test_packing_round_trip(spark, block):
    reference = Tokenizer.from_file(PATH)
    reference.encode_special_tokens = True
    texts = ODD + ["A sentence of words. " * n for n in range(1, 60, 7)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    pieces = packing.pack(df, PATH, block=block).collect()
    ids = {i: [*reference.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    whole, filled = {i: [] for i in ids}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        own = ids[p.doc_id]
        assert p.start == len(whole[p.doc_id]) and p.doc_tokens == len(own) and len(p.ids) == p.length
        assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], dtype="<u4").tobytes())
        whole[p.doc_id] += p.ids
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert whole == ids
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, ids.values()))
    assert len(filled) <= total / 1024 * 1.03 + 1
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        steps = [rng.randint(1, 6) for _ in range(rng.randint(1, 9))]
        places = [0, *np.cumsum(steps).tolist()]
        penalty = [0.0, *[rng.choice([0.0, 1.0, 3.0]) for _ in steps]]

        def cost(cuts, places=places, penalty=penalty):
            return sum(10 - (b - a) + penalty[places.index(b)] if b - a <= 10 else float("inf") for a, b in zip(cuts, cuts[1:], strict=False))

        best = min(cost([0, *c, places[-1]]) for k in range(len(places)) for c in combinations(places[1:-1], k))
        assert cost(packing.best_cuts(places, penalty, 10)) == pytest.approx(best)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href='/'>Home</a></nav><article><h1>T &amp; x</h1><p>One<br>two <b>bo</b>ld &lt;p&gt;</p><div class='ad'>Buy</div><p>Three words here</p></article><footer>&copy; me</footer></body></html>", "T & x One two bold <p> Three words here"),
        ("<body><article><p>Real text of the page<section class='comments'><article class='comment'><p>First! I like this page very much</p></article></section></article><aside>more</aside></body>", "Real text of the page"),
        ("<body><div class='cookie-notice'>We use cookies</div><form><p>Name</p><input></form><main><p>Body a < b text<!-- no --><script>var x='<p>';</script></main></body>", "Body a < b text"),
        ("<div id=sidebar>links</div><div id='content'><p>Only a line</div>", "Only a line"),
        ("<body><p>" + "A plain page without any container has one long paragraph of prose that should stay. " * 2 + "</p></body>", ("A plain page without any container has one long paragraph of prose that should stay. " * 2).strip()),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 8)
        scores = [rng.randint(-5, 5) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 4)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(side, scores=scores, edges=edges):
            return sum(max(0, s) if not k else max(0, -s) for s, k in zip(scores, side, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.source_side(scores, edges)) == best


def test_extract_on_tables(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>x</p></article>"), (1, "u", None)], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in html_extract.extract(df, ["page_id", "url"]).collect()) == [("", 0), ("x", 1)]
    assert html_extract.extract(df.limit(0), ["page_id"]).count() == 0


def brute_components(texts, n, num, den):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(texts, 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in texts}, {k: len(s) for k, s in sets.items()}


@pytest.mark.parametrize(("short", "block"), [(32, 1536), (1, 3)])
def test_near_duplicates_match_brute_force(spark, short, block):
    """short=1 sends all lists the long way, block=3 splits them into many cells."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {0: None, 1: "", 2: " \n ", 3: "one two", 4: "ONE two", 5: "one"}
    for _ in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(7):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(t)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    want, sizes = brute_components(texts, 3, 85, 100)
    got = near_dedup.near_duplicates(df, 3, 85, 100, short=short, block=block).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_empty_tables_and_repeated_rows(spark):
    df = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (7, "x y z"), (None, "a b c d")], "doc_id long, text string")
    got = near_dedup.near_duplicates(df, 3, 85, 100).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {7}
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (100, 100)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(4)] + [(9, None), (10, "too short"), (11, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    edited = items[1][1].split()
    edited[4] = edited[15] = "changed"
    del edited[22]
    docs = [(1, filler(50) + " " + items[0][1].upper() + ", " + filler(20)), (2, filler(30) + " " + " ".join(edited) + " " + filler(40)), (3, filler(90)), (4, None), (5, ""), (6, " ".join(items[2][1].split()[:9]) + " " + filler(60))]
    docs += [(100 + i, items[3][1]) for i in range(50)] + [(1, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(df, it).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 0), (2, 1), *((100 + i, 3) for i in range(50))}
    first = next(r for r in got if r.doc_id == 1)
    assert (first.score, first.first_word, first.last_word) == (1.0, 50, 79)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(df, it, bits=6).collect()} == {(r.doc_id, r.item_id) for r in got}
    assert decontaminate.matches(df.limit(0), it).count() == 0 and decontaminate.matches(df, it.limit(0)).count() == 0


def test_decontamination_takes_several_seeds(spark, monkeypatch):
    """Texts that share one rare pair with an item aren't read again; copies are, wherever
    the bounds of cells lie in them, and so are both halves of an item, one of them frequent."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    filler = lambda n: [word() for _ in range(n)]
    item = filler(30)
    docs = [(i, " ".join(filler(40) + item[i : i + 2] + filler(40))) for i in range(28)]
    docs += [(100 + n, " ".join(filler(n) + item + filler(90))) for n in range(96, 132, 3)]
    often, rare = filler(18), filler(18)  # 36 words, of which 16 places are left out
    docs += [(200 + i, " ".join(filler(20) + often)) for i in range(60)] + [(300, " ".join(filler(9) + rare))]
    read = []
    near = decontaminate.near_words
    monkeypatch.setattr(decontaminate, "near_words", lambda texts: read.extend(r.key for r in texts.select("key").collect()) or near(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(100 + n, 1) for n in range(96, 132, 3)}
    it = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(df, it).collect()} == want
    assert sorted(read) == sorted(d for d, _ in want)
    it = spark.createDataFrame([(2, " ".join(often + rare))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(df, it).collect()} == {*range(200, 260), 300}


def test_decontamination_equals_aligning_every_pair(spark):
    """Heavily edited copies, short items and items whose common pairs are all that is left."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [words(n) for n in (1, 2, 3, 4, 5, 9, 15, 15, 20, 27, 59)]
    docs = []
    for item in items * 12:
        # up to every second word changed, dropped or followed by another
        copy, share = [], rng.choice((0.1, 0.2, 0.33, 0.5))
        for w in item:
            edit = rng.random() < share
            kind = rng.randrange(3)
            copy += [w] if not edit else [rng.choice(vocabulary)] if kind == 0 else [] if kind == 1 else [w, rng.choice(vocabulary)]
        docs.append(words(rng.randrange(60)) + copy + words(rng.randrange(200)))
    for item in (items[6], items[9]):
        docs.append(words(30) + [x if k % 5 else f"x{k}" for k, x in enumerate(item)])  # no run of five words is left
        docs.append([x for w in item for x in (w, "and")])
        docs.append(item[: len(item) // 2] + words(70) + item[len(item) // 2 :] + words(300) + item)
    hashes = lambda text: decontaminate.word_hashes(text)[0]
    for min_score in (0.5, 0.7):
        want = {}
        for (d, doc), (i, item) in ((x, y) for x in enumerate(docs) for y in enumerate(items)):
            a, b = hashes(" ".join(item)), hashes(" ".join(doc))
            best, p, q = decontaminate.smith_waterman(a, b)
            if best / (2 * len(a)) >= min_score:
                want[d, i] = (best / (2 * len(a)), q - decontaminate.smith_waterman(a[:p][::-1], b[:q][::-1])[2], q - 1)
        df = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string")
        it = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
        got = {(r.doc_id, r.item_id): (r.score, r.first_word, r.last_word) for r in decontaminate.matches(df, it, min_score=min_score).collect()}
        assert got == want and len(want) > 80


@pytest.mark.parametrize(("attributes", "hidden"), [('class="content overflow-hidden"', False), ('title="Hidden gems"', False), ('data-hidden="false"', False), ('aria-hidden="false"', False), ("hidden", True), ('aria-hidden="true"', True), ("style='color: red; display : none'", True)])
def test_html_hides_only_what_is_hidden(attributes, hidden):
    text = "a long enough sentence that any reader would take for the content of this page " * 3
    assert (html_extract.main_text(f"<body><div {attributes}><p>{text}</p></div></body>") == "") == hidden


def test_html_keeps_text_of_math_and_object():
    page = "<article><p>We know that <math><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow></math> holds, as <object data='x'>this figure shows</object> here.</p></article>"
    assert html_extract.main_text(page) == "We know that E=m holds, as this figure shows here."


LONG = "a long enough sentence that any reader would take for the content of this page, is it not? " * 2


@pytest.mark.parametrize("name", ["post-comments", "entry-footer", "article-sidebar", "post-share", "commentList", "ad-300x250", "cookie-notice", "site-header"])
def test_html_drops_compounds_by_their_head(name):
    assert html_extract.main_text(f"<body><article><p>{LONG}</p><div class='{name}'><p>{LONG}No more.</p></div></article></body>") == LONG.strip()


@pytest.mark.parametrize("name", ["discussion", "legal-analysis", "related-work", "with-sidebar", "social-history", "content-area"])
def test_html_keeps_sections_named_like_boilerplate(name):
    assert html_extract.main_text(f"<body><article><section id='{name}'><h2>Head</h2><p>{LONG}</p></section></article></body>") == "Head " + LONG.strip()


def test_neighbours_flip_a_label():
    """By its own score the word is boilerplate; between paragraphs, or in an article, it is kept."""
    page = f"<body><div><p>{LONG}</p><div>Of</div><p>{LONG}</p></div><div><ul><li><a href='/'>Of</a></li></ul></div></body>"
    blocks = html_extract.blocks_of(page)
    own = html_extract.scores(blocks)
    assert own[0] > 0 > own[1] and own[2] > 0 > own[3]
    assert html_extract.main_text(page) == f"{LONG.strip()} Of {LONG.strip()}"
    inside = "<article><div><a href='/'>See</a></div></article>"
    assert html_extract.scores(html_extract.blocks_of(inside))[0] < 0 and html_extract.main_text(f"<body>{inside}<div><a href='/'>See</a></div></body>") == "See"


def test_classifier_and_cut_on_unseen_fixture_pages():
    from scriptoria.llm import html_fixtures

    wrong = alone = total = 0
    for page in html_fixtures.pages(100, seed=991):
        blocks = html_extract.blocks_of(page)
        truth = [html_fixtures.is_content(text) for text, _, _ in blocks]
        alone += sum((s > 0) != t for s, t in zip(html_extract.scores(blocks), truth, strict=True))
        blocks = html_extract.blocks_of(page)
        wrong += sum(k != t for k, t in zip(html_extract.source_side(*html_extract.graph(blocks)), truth, strict=False))
        total += len(blocks)
    assert total > 1500 and wrong <= 0.015 * total and 2 * wrong < alone


def test_settled_nodes_keep_the_cut_minimal():
    """Directed edges, some capacities greater than all edges of their node."""
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 7)
        capacity = [rng.choice((-40, -9, -3, 0, 3, 9, 40)) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6), rng.randint(0, 6)) for a in range(n) for b in range(a) if rng.random() < 0.6]

        def cost(side, capacity=capacity, edges=edges):
            return sum(max(0, s) if not k else max(0, -s) for s, k in zip(capacity, side, strict=True)) + sum(there if side[a] and not side[b] else back if side[b] and not side[a] else 0 for a, b, there, back in edges)

        assert cost(html_extract.source_side(capacity, edges)) == min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


def test_html_long_deep_and_repeated(spark):
    deep = "<div>" * 20_000 + f"<p>{LONG}"
    assert html_extract.main_text(deep) == LONG.strip()
    assert html_extract.main_text(f"<article>{'<p>Of.</p>' * 20_000}</article>") == " ".join(["Of."] * 20_000)
    df = spark.createDataFrame([(1, "<article><p>x</p></article>", "t", 5)] * 2, "page_id long, html string, text string, n_chars int")
    assert [tuple(r) for r in html_extract.extract(df, ["page_id"]).collect()] == [(1, "x", 1)] * 2


def test_whole_texts_are_parsed_as_one():
    """Longer than a segment, with 6,000 letters, and with letters that no language has."""
    rng = random.Random(1)
    han = [chr(0x4E00 + i) for i in range(6000)]
    texts = {"a": "".join(rng.choice(han[:3000]) for _ in range(9000)), "b": "".join(rng.choice(han[3000:]) for _ in range(9000)), "en": EN * 3}
    parser = language_id.Parser(texts)
    assert parser.alphabet.size > 5000
    code = lambda t: "".join(chr(0x10000 + c) for c in parser.alphabet.symbols(t).tolist())
    mixed = " ".join(rng.choice("the cat ñ fox 中 ø lazy".split()) for _ in range(1500))
    cases = [texts["a"][2000:7000], texts["b"][100:600] + texts["a"][50:2000] + EN, "".join(rng.choice(han) for _ in range(3000)), (EN + " ") * 40, "q" * 1500, "ñ" * 1500 + "the", mixed, "ж", "жa", "aжb", "x" * 512, "the cat " * 64]
    want = [[longest_phrases(code(c), code(texts[n])) for n in parser.names] for c in cases]
    assert parser.phrases([parser.alphabet.symbols(c) for c in cases]).tolist() == want
    assert want[0] == [1, 5000, 5000] and parser.predict(cases)[0][:2] == ["a", "a"]


def test_language_id_ties_long_texts_and_repeated_keys(spark):
    assert language_id.Parser({"b": EN, "a": EN}).predict(["the cat"]) == (["a"], [0.5])
    assert language_id.Parser({"b": EN + "the", "a": EN}).names == ["b", "a"]
    rows = [(1, EN, "en"), (1, DE, None), (1, DE, "de"), (2, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, "doc_id", "text", "lang")
    assert {k: v.strip() for k, v in model.items()} == {"en": EN, "de": DE}
    assert language_id.train(df, "doc_id", "text", "lang", max_labels=1).keys() == {"en"}
    long = spark.createDataFrame([(1, (EN + " ") * 5000), (2, (DE + " ") * 5000)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(long, model, ["doc_id"]).collect()} == {1: "en", 2: "de"}


def test_cuts_with_unpadded_short_windows_are_optimal():
    rng = random.Random(7)
    for _ in range(60):
        total = rng.randint(3, 14)
        places = [0, *sorted(rng.sample(range(1, total), min(total - 1, rng.randint(2, 8)))), total]
        if any(b - a > 10 for a, b in zip(places, places[1:], strict=False)):
            continue
        penalty = [0.0, *[rng.choice([0.0, 1.0, 3.0]) for _ in places[1:]]]
        short_from = rng.choice([0, total // 2])

        def cost(cuts, places=places, penalty=penalty, short_from=short_from):
            def window(a, b):
                if b - a > 10:
                    return float("inf")
                return min(10 - (b - a), 2.0) if a >= short_from and (b - a) in (1, 2, 4, 8) else 10 - (b - a)

            return sum(window(a, b) + penalty[places.index(b)] for a, b in zip(cuts, cuts[1:], strict=False))

        best = min(cost([0, *c, total]) for k in range(len(places)) for c in combinations(places[1:-1], k))
        assert cost(packing.best_cuts(places, penalty, 10, short_from, 2.0)) == pytest.approx(best)


def test_a_stream_ends_in_unpadded_windows(spark):
    """700 ids in one task: padding them to 1,024 would cost 324."""
    df = spark.createDataFrame([(1, " ".join(["the"] * 699))], "doc_id long, text string").coalesce(1)
    lengths = {}
    for p in packing.pack(df, PATH).collect():
        lengths[p.sequence_id] = lengths.get(p.sequence_id, 0) + p.length
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths.values())
    assert sum(lengths.values()) == 700 and padding == 0 and len(lengths) <= 7
    clash = spark.createDataFrame([(None, "a b", 1, 2), (None, None, 3, 4)], "doc_id long, text string, start int, sequence_id int")
    pieces = packing.pack(clash, PATH, with_ids=False).collect()
    assert sum(p.length for p in pieces) == 4 and {p.doc_tokens for p in pieces} == {1, 3} and {p.doc_id for p in pieces} == {None}


@pytest.mark.parametrize("block", [1024, 4])
def test_long_lists_of_copies_and_of_shared_passages(spark, block):
    """Default list length: a group of near copies, one of texts that share half their words,
    chains that drift away from the leader, and sizes around the buckets' edges."""
    rng = random.Random(21)
    word = lambda: f"v{rng.randrange(10**6)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(100)]
    texts = {}
    for _ in range(60):
        texts[len(texts)] = " ".join([*passage, *[word() for _ in range(60)]])
    for _ in range(50):
        t = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            t[rng.randrange(100)] = word()
        texts[len(texts)] = " ".join(t + [word() for _ in range(rng.randrange(12))])
    drift = list(base)
    for _ in range(40):
        drift[rng.randrange(100)] = word()
        texts[len(texts)] = " ".join(drift)
    keys = list(texts)
    rng.shuffle(keys)
    texts = dict(zip(keys, texts.values(), strict=True))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, _ = brute_components(texts, 3, 85, 100)
    got = near_dedup.near_duplicates(df, 3, 85, 100, block=block).collect()
    assert {r.doc_id: r.component_id for r in got} == want and 40 < len(set(want.values())) < 140


@pytest.mark.parametrize("wrapper", ["<div class='content-sidebar-wrap'><article>{}</article></div>", "<div class='layout sidebar-right'><main>{}</main></div>", "<div class='page-menu-push'><div><h1>The title of it all</h1>{}</div></div>", "<div id='sidebar-layout'><div class='inner'><article>{}</article></div><div class='sidebar'><p>" + LONG + "More here.</p></div></div>"])
def test_html_wrappers_named_like_boilerplate_keep_the_article(wrapper):
    body = f"<p>{LONG}</p><p>{LONG}It ends.</p>"
    title = "The title of it all " if "<h1>" in wrapper else ""
    assert html_extract.main_text("<body>" + wrapper.format(body) + "</body>") == f"{title}{LONG.strip()} {LONG}It ends."


def test_html_drops_share_buttons_and_comments_that_are_articles():
    page = f"<body><main><article><p>{LONG}</p><div class='share-buttons'>Tweet this page and tell all of your friends about it.</div></article><div id='comments'><article><p>{LONG}I say.</p></article><article class='comment'><p>{LONG}So do I.</p></article></div></main></body>"
    assert html_extract.main_text(page) == LONG.strip()


def test_ids_do_not_depend_on_the_size_of_the_cache():
    texts = [f"some words {i} and {i % 3} more" for i in range(50)]
    small, large = packing.ByteBpe(PATH, entries=5), packing.ByteBpe(PATH, entries=1000)
    assert [small.encode(t) for t in texts] == [large.encode(t) for t in texts]
    assert len(small.chunks) < 12 and len(large.chunks) > 50
