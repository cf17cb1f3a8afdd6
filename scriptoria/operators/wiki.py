"""Pages of a wiki and what hangs on them: links, saved versions, annotations, points of a
vector collection and candidates that answer open gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: code points of an annotation that are stored.
ANNOTATION_CHARS = 20_000


def page_links(pages: DataFrame) -> DataFrame:
    """(target, from_slug, from_title, alt): the distinct links [[target]] and [[target|alt]]
    of pages (slug, title, text). Links of a page to itself are left out; a page without a
    title goes by its slug."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[\[([^\]|]+(?:\|[^\]]+)?)\]\]"), F.lit(1))
    link = pages.select(F.col("slug").alias("from_slug"), F.coalesce("title", "slug").alias("from_title"), F.explode(F.array_distinct(found)).alias("_link"))
    cut = F.split("_link", r"\|", 2)
    alt = F.coalesce(F.get(cut, F.lit(1)), F.lit(""))
    return link.select(F.get(cut, F.lit(0)).alias("target"), "from_slug", "from_title", alt.alias("alt")).where("target <> from_slug")


def page_markdown(title: Column, kind: Column, sources: Column, updated: Column, content: Column) -> Column:
    """A page's file: front matter, an empty line, the content."""
    n = F.coalesce(F.size(sources), F.lit(0)).cast("string")
    return F.concat(F.lit("---\ntitle: "), title, F.lit("\ntype: "), kind, F.lit("\nsources: "), n, F.lit(" papers\nlast_updated: "), F.date_format(updated, "yyyy-MM-dd"), F.lit("\n---\n\n"), content)


def save_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages (slug, title, kind, sources, words, needs_rewrite) after saving new ones (slug,
    title, kind, content, sources): a known slug keeps its kind, all else is replaced and
    its rewrite is done. One new row a slug."""
    o, n = old.alias("o"), new.alias("n")
    is_new = F.col("n.slug").isNotNull()
    words = F.size(F.filter(F.split(F.coalesce("n.content", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    sources = F.when(F.size("n.sources") > 0, F.col("n.sources"))
    pick = lambda c, value: F.when(is_new, value).otherwise(F.col(f"o.{c}")).alias(c)
    return o.join(n, F.col("o.slug") == F.col("n.slug"), "full").select(
        F.coalesce("n.slug", "o.slug").alias("slug"), pick("title", F.col("n.title")), F.coalesce("o.kind", "n.kind").alias("kind"), pick("sources", sources), pick("words", words), pick("needs_rewrite", F.lit(False))
    )


def annotate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Annotations (slug, body, updated_at) after new ones: trimmed and cut to their stored
    length; an empty body deletes. One new row a slug."""
    body = F.substring(F.regexp_replace(F.coalesce("body", F.lit("")), r"(?U)^\s+|\s+$", ""), 1, ANNOTATION_CHARS)
    kept = old.join(new.select("slug"), "slug", "left_anti").select("slug", "body", "updated_at")
    return kept.unionByName(new.select("slug", body.alias("body"), "updated_at").where("body <> ''"))


def points(chunks: DataFrame, model: str, preview: int = 200) -> DataFrame:
    """Points of a vector collection from chunks (document, place, section, title, content,
    dense, sparse): (point_id, dense, sparse, payload). The id depends on document and place
    alone, so that a task done twice writes the same point."""
    point = F.md5(F.concat_ws(":", F.col("document").cast("string"), F.col("place").cast("string")))
    payload = F.struct(
        F.col("document").alias("document_id"), F.col("section").alias("section_type"), F.col("title").alias("section_title"),
        F.col("place").alias("chunk_index"), F.substring("content", 1, preview).alias("content_preview"), F.lit(model).alias("embedding_model"),
    )
    return chunks.select(point.alias("point_id"), "dense", "sparse", payload.alias("payload"))


def upsert_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """The collection after new points: they replace those with their id."""
    return old.join(new.select("point_id"), "point_id", "left_anti").select(*old.columns).unionByName(new)


def gap_candidates(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doi, title, year, relevance, gap_ids, n_gaps): works found for open gaps (gap_id,
    place, doi, title, year, relevance), one row a DOI, without those whose DOI the corpus
    (doi) has in any case. The details are those of the first gap, gap_ids go by place;
    sort by n_gaps, relevance and year, descending, for the report."""
    g = found.where("doi <> ''").groupBy("doi").agg(
        F.min_by(F.struct("title", "year", "relevance"), F.struct("place", "gap_id")).alias("w"), F.array_sort(F.collect_set(F.struct("place", "gap_id"))).alias("g")
    )
    known = corpus.where("doi IS NOT NULL").select(F.lower("doi").alias("_doi")).distinct()
    g = g.withColumn("_doi", F.lower("doi")).join(known, "_doi", "left_anti")
    ids = F.array_distinct(F.transform("g", lambda x: x["gap_id"]))
    return g.select("doi", "w.title", "w.year", "w.relevance", ids.alias("gap_ids"), F.size(ids).alias("n_gaps"))


def inbound_candidates(edges: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, n_seeds): works outside the corpus (id) that cite works in it, by edges (citing,
    cited), with the number of different works they cite."""
    own = corpus.select("id").distinct()
    hit = edges.join(own.withColumnRenamed("id", "cited"), "cited", "left_semi").join(own.withColumnRenamed("id", "citing"), "citing", "left_anti")
    return hit.distinct().groupBy(F.col("citing").alias("id")).agg(F.count("*").alias("n_seeds"))


def figure_markers(drafts: DataFrame) -> DataFrame:
    """(draft, place, marker, family, number, sentence) of the markers like [Fig. 2] in drafts
    (draft, text). The sentence is the one around a marker's first appearance; without a
    boundary on a side it reaches 120 characters there."""
    text = F.coalesce("text", F.lit(""))
    pattern = r"(?i)\[\s*(?:Fig(?:ure)?|Tab(?:le)?|Eq(?:uation)?)\s*\.?\s*\d+(?:\s*[a-z])?\s*\]"
    m = drafts.select("draft", "text", F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("place", "marker"))
    short = F.substring(F.lower(F.regexp_replace("marker", r"[\[\s]", "")), 1, 2)
    family = F.when(short == "fi", "figure").when(short == "ta", "table").otherwise("equation")
    number = F.regexp_extract("marker", r"\d+", 0).cast("int")
    at = F.position
    m = m.withColumn("_i", at(F.col("marker"), F.col("text")))
    head = F.substring(F.col("text"), F.lit(1), F.col("_i") - 1)
    ends = (". ", "? ", "! ", "\n")
    last = lambda p: F.when(at(F.lit(p[::-1]), F.reverse(head)) > 0, F.length(head) - at(F.lit(p[::-1]), F.reverse(head)) - len(p) + 1)
    start = F.coalesce(F.greatest(*[last(p) for p in ends]) + 2, F.greatest(F.lit(0), F.col("_i") - 121))
    after = F.col("_i") + F.length("marker")
    first = lambda p: F.nullif(at(F.lit(p), F.col("text"), after), F.lit(0))
    stop = F.coalesce(F.least(*[first(p) for p in ends]), F.least(F.length("text"), F.col("_i") + 119))
    sentence = F.regexp_replace(F.substring(F.col("text"), start + 1, F.greatest(F.lit(0), stop - start)), r"(?U)^\s+|\s+$", "")
    return m.select("draft", "place", "marker", family.alias("family"), number.alias("number"), sentence.alias("sentence"))


def figure_report(drafts: DataFrame, visuals: DataFrame, entailment: DataFrame | None = None, floor: float = 0.15, high: float = 0.8) -> DataFrame:
    """Per draft: markers, those without a visual of their family and number among its
    visuals (draft, kind, figure, score), those whose sentence a caption supports by less
    than floor (given entailment: draft, place, score), the share resolved (1 without
    markers), and the score of the use of visuals: 0 with an unresolved marker, 1 without a
    visual of the high score, 0.5 without a marker, 0.7 with three markers or more that are
    over 1.5 times the high visuals, else 0.7 + 0.3 * mean entailment, within 0.5 and 1."""
    family = F.when(F.col("kind").isin("figure", "chart", "image"), "figure").when(F.col("kind").isin("table", "equation"), F.col("kind"))
    number = F.nullif(F.regexp_extract(F.coalesce("figure", F.lit("")), r"\d+", 0), F.lit("")).cast("int")
    keys = visuals.select("draft", family.alias("family"), number.alias("number")).where("family IS NOT NULL AND number IS NOT NULL").distinct().withColumn("known", F.lit(True))
    m = figure_markers(drafts).join(keys, ["draft", "family", "number"], "left")
    m = m.withColumn("entailed", F.lit(None).cast("double")) if entailment is None else m.join(entailment.select("draft", "place", F.col("score").alias("entailed")), ["draft", "place"], "left")
    unknown = F.col("known").isNull()
    sums = m.groupBy("draft").agg(
        F.count("*").alias("n"), F.count_if(unknown).alias("bad"), F.count_if(~unknown & (F.col("entailed") < floor)).alias("low"), F.avg(F.when(~unknown, F.col("entailed"))).alias("mean"),
        F.transform(F.array_sort(F.collect_list(F.when(unknown, F.struct("place", "marker")))), lambda x: x["marker"]).alias("missing"),
    )
    best = visuals.groupBy("draft").agg(F.count_if(F.col("score") >= high).alias("best"))
    d = drafts.select("draft").join(sums, "draft", "left").join(best, "draft", "left")
    n, bad, low, good = (F.coalesce(c, F.lit(0)) for c in ("n", "bad", "low", "best"))
    used = F.greatest(F.lit(0.5), F.least(F.lit(1.0), 0.7 + 0.3 * F.col("mean")))
    score = F.when(bad > 0, 0.0).when(good == 0, 1.0).when(n == 0, 0.5).when((n > good * 1.5) & (n >= 3), 0.7).otherwise(F.coalesce(used, F.lit(1.0)))
    resolved = F.round((n - bad) / F.greatest(n, F.lit(1)), 3)
    return d.select(
        "draft", n.alias("n_markers"), bad.alias("n_hallucinated"), low.alias("n_low_entailment"), F.coalesce("missing", F.array().cast("array<string>")).alias("hallucinated_markers"),
        F.when(n == 0, 1.0).otherwise(resolved).alias("resolved_ratio"), score.alias("score"),
    )
