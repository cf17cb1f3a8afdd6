"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the row's own text, so the operator has
no shuffle and no Python worker; a text of any length costs memory in proportion to
that text alone.

A rule may be keyed to languages: it judges the rows whose language column names one of
them, so a text in a language or script without the table's stop words is not failed for
that, and without a language column such a rule judges nothing.

Defined cases: a null or empty text has no words, all measures 0 and fails the base
rule; repeated rows are judged one by one; an empty table gives an empty result;
input columns pass through unless a result column has the same name, which wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import boxed, let, unboxed, words_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on with as was be by at from this or are "
    "der die und das von zu mit den ist ein eine im für auf des dem nicht sich "
    "le la les de et un une des est pour dans que qui sur par pas avec au elle il "
    "el los las y en del se por con una no es lo su al para"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= numerator / denominator <= high (0 / 0 counts as 0); the
    rule judges texts of from_words words or more, in these languages (none: in any)."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float
    from_words: int = 0
    languages: tuple[str, ...] = ()


#: The threshold table. The base rule of the contract stands beside it.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 1.5, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.25),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.01, 0.8, 30, ("en", "de", "fr", "es")),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", 0.0, 0.5),
)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words that lie in a five-word window found at least twice in the text.

    windows: 64-bit hashes of the windows. They are sorted with their places; a place counts
    if a neighbour in this order has the same five words; the union of the counted spans is
    then summed up. Texts without equal hashes, by far the most, skip all that."""

    def starts(s: Column) -> Column:
        said = lambda k: F.slice(words, F.get(s, k)["i"] + 1, 5)
        inside = lambda k: (k >= 0) & (k < F.size(s))
        same = lambda k, other: F.when(inside(other) & (F.get(s, k)["w"] == F.get(s, other)["w"]), said(k) == said(other)).otherwise(F.lit(False))
        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.array_sort(F.transform(found, lambda k: F.get(s, k)["i"]))

    places = let(F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), starts)
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + 5).cast("int").alias("end"), (a["n"] + 5 - F.greatest(F.lit(0), a["end"] - p)).cast("int").alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0))


def judgement(text: Column, rules: tuple[Rule, ...] = RULES, lang: Column | None = None) -> Column:
    """One struct of all measures, base_failed, failed_<rule> and kept for a text."""
    stop = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})

    def measured(s: Column) -> Column:
        text, words, lines = s["text"], s["words"], s["lines"]
        n = F.size(words)
        hashed = lambda h: F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))
        windows = F.when(n >= 5, let(F.transform(words, lambda w: F.xxhash64(w)), hashed)).otherwise(F.array().cast("array<bigint>"))
        values = (
            n,
            F.length(F.translate(text, " \t\n\v\f\r", "")),
            F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
            F.size(F.filter(words, lambda w: w.isin(stop))),
            F.size(lines),
            F.size(lines) - F.size(F.array_distinct(lines)),
            let(windows, lambda w: _repeat_words(words, w)),
        )
        return F.struct(*[v.cast("long").alias(m) for m, v in zip(MEASURES, values, strict=True)])

    def judged(m: Column) -> Column:
        def failed(r: Rule) -> Column:
            ratio = F.coalesce(F.try_divide(m[r.numerator].cast("double"), m[r.denominator]), F.lit(0.0))
            spoken = F.lit(True) if not r.languages else F.lit(False) if lang is None else F.coalesce(lang.isin(*r.languages), F.lit(False))
            return (m["n_words"] >= r.from_words) & ~ratio.between(r.low, r.high) & spoken

        base = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        fails = {f"failed_{r.name}": failed(r) for r in rules}
        kept = ~reduce(lambda a, b: a | b, fails.values(), base)
        return F.struct(*[m[x].alias(x) for x in MEASURES], *[c.alias(k) for k, c in fails.items()], base.alias("base_failed"), kept.alias("kept"))

    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(let(F.struct(t.alias("text"), words_of(t).alias("words"), lines.alias("lines")), measured), judged)


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, lang_col: str | None = None) -> DataFrame:
    """docs with the measures, one boolean `failed_<rule>` per rule, base_failed and kept."""
    d = boxed(docs, _j=judgement(F.col(f"`{text_col}`"), rules, None if lang_col is None else F.col(f"`{lang_col}`")))
    names = [*MEASURES, *(f"failed_{r.name}" for r in rules), "base_failed", "kept"]
    return unboxed(d, docs.columns, **{n: F.col(f"_j.{n}") for n in names})


def oracle_select() -> str:
    """DuckDB SQL with the operator's measures and verdict for each document."""
    stop = ", ".join("'" + w + "'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))
    spoken = lambda r: f"coalesce(lang IN ({', '.join(repr(x) for x in r.languages)}), false) AND " if r.languages else ""
    fails = " OR ".join(f"{spoken(r)}n_words >= {r.from_words} AND NOT (CASE WHEN {r.denominator} = 0 THEN 0 ELSE {r.numerator}::DOUBLE / {r.denominator} END BETWEEN {r.low} AND {r.high})" for r in RULES)
    return f"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM base)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id),
m AS (
  SELECT b.doc_id, b.lang, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN rep r ON b.doc_id = r.doc_id),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {fails}) AS kept FROM v"""
