"""Sources: files, block lists, event logs, shortlists, leaderboards, paged services."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scriptoria.functions import text as tx

BLOCKS = "array<struct<type:string,text:string,text_level:int,table_body:string,list_items:array<string>,page_idx:int>>"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, sha256 of every file below path that fits the pattern."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return d.select("path", "length", F.sha2("content", 256).alias("file_hash"))


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose hash isn't known yet, one per hash."""
    return found.join(known.select("file_hash"), "file_hash", "left_anti").groupBy("file_hash").agg(F.min("path").alias("path"))


def blocks(rows: DataFrame, json_col: str) -> DataFrame:
    """One row per block of a JSON block list, with its place; text of lists is joined."""
    b = rows.select("*", F.posexplode(F.from_json(json_col, BLOCKS)).alias("place", "b"))
    text = F.coalesce("b.text", F.array_join("b.list_items", "\n"), "b.table_body")
    return b.select(*rows.columns, "place", F.col("b.type").alias("type"), F.col("b.text_level").alias("level"), text.alias("text"), F.col("b.page_idx").alias("page"))


def block_sections(block_rows: DataFrame, key: str) -> DataFrame:
    """Sections of block rows: a section starts at each heading (a level of 1 to 4)."""
    w = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("level").between(1, 4)
    d = block_rows.withColumn("section", F.sum(F.coalesce(heading.cast("int"), F.lit(0))).over(w)).withColumn("is_heading", F.coalesce(heading, F.lit(False)))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("place", "text")))), lambda x: x["text"])
    return d.groupBy(key, "section").agg(F.max(F.when(F.col("is_heading"), F.col("text"))).alias("title"), F.array_join(body, "\n\n").alias("content"))


# Block types of a layout tree that hold text, and those that are left out with
# all below them. Blocks of any other type stand for their children.
TEXT_BLOCKS = ("Text", "ListItem", "Caption", "Footnote", "Code", "Handwriting", "TextInlineMath")
SKIPPED_BLOCKS = ("PageHeader", "PageFooter", "Figure", "Picture", "Form", "ComplexRegion", "TableOfContents", "Reference")
_LEAVES = {"SectionHeader", "Table", "Equation", *TEXT_BLOCKS}


def tree_blocks(tree: str | None) -> list[dict]:
    """The text blocks of one layout tree in reading order, at any depth; none if the tree
    is null or isn't a JSON object."""
    try:
        root = json.loads(tree or "null")
    except (ValueError, RecursionError):
        return []
    out, left = [], list(reversed(root.get("children") or [])) if isinstance(root, dict) else []
    while left:
        node = left.pop()
        if not isinstance(node, dict) or node.get("block_type") in SKIPPED_BLOCKS:
            continue
        if node.get("block_type") in _LEAVES:
            out.append({"kind": node["block_type"], "html": node.get("html") or ""})
        else:
            left.extend(reversed(node.get("children") or []))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("html", T.StringType())])))
def _tree_blocks(trees: pd.Series) -> pd.Series:
    return trees.map(tree_blocks)


def tree_text(tree: Column) -> Column:
    """Plain text of a layout tree: headings as Markdown, tables by rows, blocks apart by an
    empty line. A tree is walked in Python, its HTML is stripped in the JVM."""

    def shown(b: Column) -> Column:
        plain = tx.strip_html(b["html"])
        text = F.when(b["kind"] == "SectionHeader", F.concat(F.lit("## "), plain)).when(b["kind"] == "Table", tx.table_to_text(b["html"])).otherwise(plain)
        return F.when(plain != "", text)

    return F.array_join(F.array_compact(F.transform(_tree_blocks(tree), shown)), "\n\n")


def markdown_pages(spark: SparkSession, base: str, kinds: tuple[str, ...] = ("papers", "concepts", "synthesis")) -> DataFrame:
    """(slug, kind, title, text) of the Markdown files base/<kind>/<slug>.md; the title is the
    front matter's, null without one. Missing folders count as empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    there = [f"{base}/{k}" for k in kinds if hadoop.Path(f"{base}/{k}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(f"{base}/{k}"))]
    if not there:
        return spark.createDataFrame([], "slug string, kind string, title string, text string")
    d = spark.read.option("pathGlobFilter", "*.md").text(there, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    part = lambda i: F.url_decode(F.replace(F.element_at(F.split("path", "/"), i), F.lit("+"), F.lit("%2B")))
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    title = F.nullif(F.regexp_extract(front, r"(?m)^title: (.*)$", 1), F.lit(""))
    return d.select(F.regexp_replace(part(-1), r"\.md$", "").alias("slug"), part(-2).alias("kind"), title.alias("title"), F.col("value").alias("text"))


def replay(log: DataFrame, key: Column, order: Column, value: Column) -> DataFrame:
    """Latest state per key of an append-only log; a null value deletes."""
    latest = log.groupBy(key.alias("key")).agg(F.max(F.struct(order.alias("o"), value.alias("v"))).alias("s"))
    return latest.where("s.v IS NOT NULL").select("key", F.col("s.v").alias("value"))


def shortlist(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated shortlist; columns by header, so new ones don't disturb."""
    return spark.read.csv(path, sep="\t", header=True)


def leaderboard(rows: DataFrame, text_col: str, key: str, top: int = 10) -> DataFrame:
    """(key, model, score) of the last pipe table whose header says "model"; the score is
    the last numeric cell of a row."""
    lines = rows.select(key, F.posexplode(F.split(text_col, "\n")).alias("n", "line")).where(F.trim("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    lines = lines.select(key, "n", cells.alias("c")).withColumn("gap", F.col("n") - F.row_number().over(Window.partitionBy(key).orderBy("n")))
    heads = lines.where(F.exists("c", lambda x: F.contains(F.lower(x), F.lit("model")))).groupBy(key).agg(F.max_by(F.struct("n", "gap"), "n").alias("h"))
    body = lines.join(heads, key).where((F.col("gap") == F.col("h.gap")) & (F.col("n") > F.col("h.n") + 1))
    numbers = F.filter(F.transform("c", lambda x: F.try_to_number(F.regexp_replace(x, "[%*]", ""), F.lit("999999.9999")).cast("double")), lambda x: x.isNotNull())
    scored = body.select(key, F.get("c", F.lit(0)).alias("model"), F.try_element_at(numbers, F.lit(-1)).alias("score")).where("score IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "model"))
    return scored.withColumn("r", rank).where(F.col("r") <= top).drop("r")


def sampled(rows: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """A repeatable sample of n rows: the least hashes of id and seed."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


class PagedSource(DataSource):
    """A service read in pages through a fetch function (page number -> rows), given by
    subclassing; option `pages` sets how many pages are read, each by one task."""

    fetch: Callable[[int], Iterator[tuple]]
    columns = "value string"

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(type(self).fetch, int(self.options.get("pages", "1")))


class _PagedReader(DataSourceReader):
    def __init__(self, fetch, pages: int):
        self.fetch, self.pages = fetch, pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.fetch(partition.value)
