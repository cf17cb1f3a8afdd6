"""URL filters: host-suffix and path-prefix expressions joined to rules on hash prefixes.

Each URL is expanded into host suffixes times slash-bounded path heads, of the shapes
(labels, slashes) that rules have. The expressions meet the rules in an equi-join on the
first 8 hex digits of SHA-256; the full digest, the rest of the rule's path and the
precedence (longest rule host, then longest rule path, then block before allow) are
confirmed afterwards.

Two plans give the same rows. While the counted rules are at most `broadcast_rules` and of
at most `max_shapes` shapes, each shape is one expression a URL and one join with the
broadcast rules, so no page is repeated or shuffled. Beyond, the expressions are exploded,
joined (by shuffle beyond broadcast_rules) and gathered again by row.

Defined cases: a null URL or one without "://" has empty host and path and no rule; a
null or empty rule host never fits; rules given twice count once; repeated rows are
judged one by one; an empty page or rule table works; input columns pass through
unless a result column has the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import ascii_lower, boxed, unboxed

#: The rules of the contract: host, path, verdict.
CONTRACT_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first "://"; empty without one. (?s) keeps line breaks."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", broadcast_rules: int = 20_000, max_shapes: int = 16) -> DataFrame:
    """pages with host, path, rule (host + path of the winning rule) and verdict.

    rules: columns host, path, verdict ("allow" or "block")."""
    r = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("length(r_host) > 0").distinct()
    head = F.regexp_extract("r_path", r"(?s)^(.*/)", 1)
    r = r.withColumns({"r_digest": F.sha2(F.concat_ws("\n", "r_host", head), 256), "r_labels": F.size(F.split("r_host", r"\.")), "r_slashes": F.length(head) - F.length(F.translate(head, "/", ""))})
    shapes = r.groupBy("r_labels", "r_slashes").agg(F.count("*").alias("n")).limit(max_shapes + 1).collect()
    n_rules = sum(x.n for x in shapes) if len(shapes) <= max_shapes else r.count()
    r = r.withColumn("r_key", F.substring("r_digest", 1, 8))
    p = boxed(pages, _host=host_of(F.col(f"`{url_col}`")), _path=path_of(F.col(f"`{url_col}`")))
    if len(shapes) <= max_shapes and n_rules <= broadcast_rules:
        best = _by_shape(p, r, [(x.r_labels, x.r_slashes) for x in shapes])
    else:
        best = _exploded(p, r, n_rules <= broadcast_rules)
    return unboxed(best, pages.columns, host=F.col("_host"), path=F.col("_path"), rule=F.col("_hit.rule"), verdict=F.coalesce("_hit.verdict", F.lit(default)))


def _expression(labels: int, slashes: int) -> Column:
    """Host suffix and path head of this shape; null if the URL has none."""
    parts = F.split("_host", r"\.")
    suffix = F.array_join(F.slice(parts, -labels, labels), ".")
    has = (F.size(parts) >= labels) & (F.length("_path") - F.length(F.translate("_path", "/", "")) >= slashes)
    head = F.concat(F.substring_index("_path", "/", slashes), F.lit("/")) if slashes else F.lit("")
    return F.when(has, F.concat_ws("\n", suffix, head))


def _confirmed(digest: Column, rule: Column) -> Column:
    """The rule with what decides its precedence, if it fits; else null."""
    fits = (digest == rule["r_digest"]) & F.col("_path").startswith(rule["r_path"])
    return F.when(fits, F.struct(F.length(rule["r_host"]).alias("a"), F.length(rule["r_path"]).alias("b"), rule["r_verdict"].alias("verdict"), F.concat(rule["r_host"], rule["r_path"]).alias("rule")))


def _hits(rules_col: str, digest: Column) -> Column:
    """What confirms among a row's rules of one hash prefix."""
    return F.coalesce(F.transform(rules_col, lambda x: _confirmed(digest, x)), F.array())


def _by_shape(p: DataFrame, r: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    one = F.struct("r_digest", "r_host", "r_path", "r_verdict")
    by_key = r.groupBy("r_key").agg(F.collect_list(one).alias("r_rules"))
    found = []
    for k, (labels, slashes) in enumerate(sorted(shapes)):
        p = p.withColumn(f"_digest{k}", F.sha2(_expression(labels, slashes), 256))
        p = p.join(F.broadcast(by_key.select(F.col("r_key").alias(f"_key{k}"), F.col("r_rules").alias(f"_rules{k}"))), F.substring(f"_digest{k}", 1, 8) == F.col(f"_key{k}"), "left")
        found.append(_hits(f"_rules{k}", F.col(f"_digest{k}")))
    if not found:
        return p.withColumn("_hit", F.lit(None).cast("struct<verdict:string,rule:string>"))
    return p.withColumn("_hit", F.array_max(F.concat(*found)))


def _exploded(p: DataFrame, r: DataFrame, small: bool) -> DataFrame:
    bounds = r.agg(F.coalesce(F.max("r_labels"), F.lit(0)), F.coalesce(F.max("r_slashes"), F.lit(0))).first()
    labels, slashes = int(bounds[0]), int(bounds[1])
    r, p = r.drop("r_labels", "r_slashes"), p.withColumn("_id", F.monotonically_increasing_id())
    parts = F.split("_host", r"\.")
    k = F.least(F.size(parts), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), ".")) if labels else F.array().cast("array<string>")
    # heads with 0 to `slashes` slashes; a path of fewer has only its own
    depth = F.least(F.length("_path") - F.length(F.translate("_path", "/", "")), F.lit(slashes))
    heads = F.transform(F.sequence(F.lit(0), depth), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", F.col("_path"), F.lit("/"), i), F.lit("/"))))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.concat_ws("\n", s, h))))
    e = p.select("_id", "_row", "_host", "_path", F.explode_outer(expressions).alias("_expression"))
    e = e.withColumn("_digest", F.sha2("_expression", 256)).withColumn("_key", F.substring("_digest", 1, 8))
    joined = e.join(F.broadcast(r) if small else r, F.col("_key") == F.col("r_key"), "left")
    hit = _confirmed(F.col("_digest"), F.struct("r_digest", "r_host", "r_path", "r_verdict"))
    return joined.groupBy("_id").agg(F.first("_row").alias("_row"), F.first("_host").alias("_host"), F.first("_path").alias("_path"), F.max(hit).alias("_hit"))


def oracle_select() -> str:
    """DuckDB SQL of the contract's rules over pages."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in CONTRACT_RULES)
    return f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
r(h, pre, v) AS (VALUES {values}),
hits AS (
  SELECT page_id, h || pre AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(pre) DESC) AS k
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.v, 'allow') AS verdict
FROM p LEFT JOIN hits h ON p.page_id = h.page_id AND h.k = 1"""
