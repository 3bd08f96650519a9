"""What is written out: claim graphs, principles, evidence, reports, issues, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.claims import linked
from graphloom.operators.dedup import last_value_first_place, merged_claim_edges
from graphloom.operators.traverse import numbered, topological_levels


def slug(c) -> F.Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def claim_edges(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """graphId, source, target, type, weight, description, agreed_by: a claim documents what its reference means.

    claims: graphId, ref, text, weight, ord. A claim is named by the digest of reference and text. Exact links keep
    their weight, links by class have 0.8 of it, links by file 0.6. Of repeated edges the first stays with the largest weight
    and the longest description, and tells how many agreed. Claims that mean no node are left out.
    """
    how = linked(claims, nodes).where("node is not null")
    part = F.when(F.col("how") == "exact", 1.0).when(F.col("how") == "class", 0.8).otherwise(0.6)
    c = claims.join(how, ["graphId", "ref"]).select(
        "graphId", F.concat(F.lit("claim:"), F.substring(F.sha2(F.concat_ws(":", "ref", F.lower(F.trim("text"))), 256), 1, 12)).alias("source"), F.col("node").alias("target"), F.lit("documents").alias("type"),
        F.round(F.col("weight") * part, 6).alias("weight"), F.col("text").alias("description"), "ord",
    )
    return merged_claim_edges(c, ["graphId", "source", "target", "type"], "ord")


def principle_nodes(nodes: DataFrame, least: int = 2) -> DataFrame:
    """graphId, id, name, n_evidence: one principle per slug of names that at least so many rows give; the first spelling stands for it."""
    n = nodes.where("name is not null").select("graphId", slug("name").alias("slug"), "name", "node_row").where("slug <> ''")
    g = n.groupBy("graphId", "slug").agg(F.min_by("name", "node_row").alias("name"), F.count("*").alias("n_evidence")).where(F.col("n_evidence") >= least)
    return g.select("graphId", F.concat(F.lit("principle:"), "slug").alias("id"), "name", "n_evidence")


def ranked_evidence(votes: DataFrame, key: list[str], k: int = 3) -> DataFrame:
    """The k best votes of each claim: verified ones first, then the heavier, then the first; key, place, edge_row."""
    w = Window.partitionBy(*key).orderBy(F.desc(F.coalesce("verified", F.lit(False))), F.desc_nulls_last("weight"), "edge_row")
    return votes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(*key, "place", "edge_row")


def verdict_report(results: DataFrame) -> DataFrame:
    """graphId, report: verdicts and agreement of a graph with counts, as Markdown in order."""
    c = results.groupBy("graphId", F.coalesce("verdict", F.lit("none")).alias("verdict"), "agreement").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("| "), F.col("verdict"), F.lit(" | "), F.col("agreement"), F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    rows = c.groupBy("graphId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("verdict", "agreement", line.alias("l")))), lambda x: x["l"]), "\n").alias("rows"))
    return rows.select("graphId", F.concat(F.lit("| verdict | agreement | n |\n|-|-|-|\n"), F.col("rows")).alias("report"))


def diff_text(impact: DataFrame, nodes: DataFrame, risks: DataFrame, most: int = 50) -> DataFrame:
    """graphId, text: risks of a change, changed nodes and affected ones, each list in order and cut at ``most`` with the number left out."""
    n = impact.join(nodes.select("graphId", "id", "type"), ["graphId", "id"]).withColumn("line", F.concat(F.lit("- "), F.col("type"), F.lit(" "), F.col("id")))
    w = Window.partitionBy("graphId", "role")
    n = n.withColumns({"r": F.row_number().over(w.orderBy("line")), "all": F.count("*").over(w)})
    part = n.groupBy("graphId", "role").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.col("line")))), "\n").alias("t"), F.max("all").alias("all"))
    part = part.withColumn("t", F.concat("t", F.when(F.col("all") > most, F.concat(F.lit("\n- and "), (F.col("all") - most).cast("string"), F.lit(" more"))).otherwise("")))
    both = part.groupBy("graphId").agg(F.max(F.when(F.col("role") == "changed", F.col("t"))).alias("changed"), F.max(F.when(F.col("role") == "affected", F.col("t"))).alias("affected"))
    j = both.join(risks.select("graphId", "risks"), "graphId", "left")
    return j.select("graphId", F.concat(F.lit("Risk: "), F.coalesce("risks", F.lit("low")), F.lit("\n## Changed\n"), F.coalesce("changed", F.lit("")), F.lit("\n## Affected\n"), F.coalesce("affected", F.lit("")), F.lit("\n")).alias("text"))


def with_baseline(nodes: DataFrame, batch: str = "batch_ord") -> DataFrame:
    """Node rows with the state before the last batch of each graph as a batch of its own (-1) in front of the last one.

    Of rows with one id the last counts, at the place of the first.
    """
    last = nodes.groupBy("graphId").agg(F.max(batch).alias("_last"))
    n = nodes.join(last, "graphId").withColumn(batch, F.when(F.col(batch) < F.col("_last"), -1).otherwise(F.col(batch))).drop("_last")
    return last_value_first_place(n, ["graphId", "id"], "node_row")


def chunk_tour(nodes: DataFrame, edges: DataFrame, size: int = 3) -> DataFrame:
    """graphId, step, id: nodes in topological order (levels, then delivery; cycles last) in steps of ``size``, numbered without a task per graph."""
    lv = topological_levels(nodes, edges).withColumn("rank", F.when(F.col("level") < 0, 1 << 30).otherwise(F.col("level")))
    n = nodes.select("graphId", "id", "node_ord").join(lv.select("graphId", "id", "rank"), ["graphId", "id"])
    return numbered(n, ["graphId"], ["rank", "node_ord"], "k").select("graphId", F.floor(F.col("k") / size).cast("int").alias("step"), "id")


def article_links(articles: DataFrame) -> DataFrame:
    """graphId, id, target, how of the links in articles (graphId, id, name, content) that mean one article: by name, or by the only one whose name ends with it."""
    link = F.regexp_extract_all("content", F.lit(r"\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]"), F.lit(1))
    l = articles.select("graphId", "id", F.explode(link).alias("x")).select("graphId", "id", F.lower(F.trim("x")).alias("want")).where("want <> ''").distinct()
    named = articles.where("name is not null").select("graphId", F.lower(F.trim("name")).alias("name"), F.col("id").alias("target"))
    exact = named.groupBy("graphId", F.col("name").alias("want")).agg(F.min("target").alias("exact"), F.countDistinct("target").alias("k")).where("k = 1").drop("k")
    words = F.split("name", " ")
    tails = named.withColumn("want", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))))
    tails = tails.groupBy("graphId", "want").agg(F.min("target").alias("tail"), F.countDistinct("target").alias("k")).where("k = 1").drop("k")
    j = l.join(exact, ["graphId", "want"], "left").join(tails, ["graphId", "want"], "left")
    return j.select("graphId", "id", F.coalesce("exact", "tail").alias("target"), F.when(F.col("exact").isNotNull(), "name").otherwise("tail").alias("how")).where("target is not null and target <> id").distinct()


def issues(nodes: DataFrame) -> DataFrame:
    """graphId, ord, level, issue, node_row of what cleaning finds in node rows: dropped ones before corrected ones, then by row.

    nodes: raw rows; a row can have several issues. Deletes have none.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    one = lambda test, rank, what: F.when(test, F.struct(F.lit(rank).alias("rank"), F.lit("auto-corrected" if rank else "dropped").alias("level"), F.lit(what).alias("issue")))
    found = F.array_compact(F.array(
        one(blank("id"), 0, "no id"), one(blank("name"), 0, "no name"), one(blank("type"), 1, "no type"), one(blank("complexity"), 1, "no complexity"), one(blank("summary"), 1, "no summary"), one(F.col("tags").isNull(), 1, "no tags"),
    ))
    i = nodes.where("op = 'upsert'").select("graphId", "node_row", F.inline(found))
    return numbered(i, ["graphId"], ["rank", "node_row", "issue"], "ord").select("graphId", F.col("ord").cast("long").alias("ord"), "level", "issue", "node_row")


def rolled_up(freshness: DataFrame) -> DataFrame:
    """The status of highest risk over all graphs, and how many have each: stale before unknown before fresh."""
    rank = F.create_map(*[F.lit(x) for k, s in enumerate(("fresh", "unknown", "stale")) for x in (s, k)])[F.col("status")]
    return freshness.agg(F.max_by("status", rank).alias("status"), F.count_if(F.col("status") == "stale").alias("n_stale"), F.count_if(F.col("status") == "unknown").alias("n_unknown"), F.count_if(F.col("status") == "fresh").alias("n_fresh"))
