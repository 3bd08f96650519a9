"""Wiki folders: articles, their links and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import trim_ws
from graphloom.operators.text import wikilinks

#: Files at the root of a wiki that are no articles.
INFRASTRUCTURE = ("index.md", "log.md", "readme.md", "claude.md", "agents.md", "contributing.md")


def read_articles(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root, without ending), content of each Markdown file; infrastructure files at the root are left out."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    full = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/"))
    rel = F.regexp_replace(full, "^" + root.rstrip("/").replace("\\", "\\\\") + "/", "")
    return raw.select(rel.alias("file"), F.col("value").alias("content")).where(~F.lower("file").isin(*INFRASTRUCTURE)).select(F.regexp_replace("file", r"\.md$", "").alias("path"), "content")


def article_nodes(articles: DataFrame) -> DataFrame:
    """Nodes: title (first heading, else base name), summary (first paragraph, 200 characters), links, complexity by links."""
    title = F.regexp_extract("content", r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)
    base = F.element_at(F.split("path", "/"), -1)
    body = F.regexp_replace(F.regexp_replace("content", r"(?s)\A---\n.*?\n---\n", ""), r"(?m)^#.*$", "")
    links = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(r"\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]"), F.lit(1)), lambda x: F.trim(x)))
    n = F.size(links)
    return articles.select(
        F.concat(F.lit("article:"), "path").alias("id"), F.lit("article").alias("type"), F.when(title != "", title).otherwise(base).alias("name"), "path",
        F.substring(trim_ws(F.regexp_extract(trim_ws(body), r"(?s)\A(.+?)(?:\n[ \t]*\n|\z)", 1)), 1, 200).alias("summary"), links.alias("wikilinks"),
        F.when(n > 15, "complex").when(n > 5, "moderate").otherwise("simple").alias("complexity"),
    )


def article_edges(articles: DataFrame) -> DataFrame:
    """related edges of weight 0.7: a link means the article of that path, or the only one of that base name; case does not matter."""
    links = wikilinks(articles, "path", "content").select("path", F.lower("target").alias("want")).distinct()
    by_path = articles.select(F.lower("path").alias("want"), F.col("path").alias("to_path"))
    by_name = articles.groupBy(F.lower(F.element_at(F.split("path", "/"), -1)).alias("want")).agg(F.min("path").alias("to_name"), F.count("*").alias("k")).where("k = 1").drop("k")
    hit = links.join(by_path, "want", "left").join(by_name, "want", "left").withColumn("to", F.coalesce("to_path", "to_name")).where("`to` is not null and `to` <> path")
    return hit.select(F.concat(F.lit("article:"), "path").alias("source"), F.concat(F.lit("article:"), "to").alias("target"), F.lit("related").alias("type"), F.lit(0.7).alias("weight")).distinct()
