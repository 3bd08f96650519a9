"""Filters, aggregates and groupings of a cleaned graph. All work per graphId, for any number of graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions.paths import basename


def filter_nodes(nodes: DataFrame, members: DataFrame, types: list[str], complexities: list[str], layers: list[str]) -> DataFrame:
    """Type and (if given) complexity, and membership in any of the layers (if given)."""
    out = nodes.where(F.col("type").isin(*types))
    if complexities:
        out = out.where(F.col("complexity").isin(*complexities))
    return out.join(members.where(F.col("layer_name").isin(*layers)), ["graphId", "id"], "left_semi") if layers else out


def filter_edges(edges: DataFrame, visible: DataFrame, categories: list[str]) -> DataFrame:
    """Both ends visible, category wanted; edges of unknown category pass."""
    cat = S.lookup(S.EDGE_CATEGORY, F.col("type"))
    ids = visible.select("graphId", "id")
    return (
        edges.where(cat.isNull() | cat.isin(*categories))
        .join(ids.withColumnRenamed("id", "source"), ["graphId", "source"], "left_semi")
        .join(ids.withColumnRenamed("id", "target"), ["graphId", "target"], "left_semi")
    )


def neighbours(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Ids one step from the focus, either way, and the focus itself."""
    both = edges.select("graphId", F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select("graphId", "target", "source"))
    near = both.join(focus.select("graphId", "id"), ["graphId", "id"], "left_semi").select("graphId", F.col("other").alias("id"))
    return near.union(focus.select("graphId", "id")).distinct()


def histogram(nodes: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Counts per level and graph; levels without rows count zero."""
    every = nodes.select("graphId").distinct().select("graphId", F.explode(F.array(*map(F.lit, levels))).alias(column))
    return every.join(nodes.groupBy("graphId", column).agg(F.count("*").alias("n")), ["graphId", column], "left").fillna(0, ["n"])


def degrees(edges: DataFrame) -> DataFrame:
    """Undirected degree; a self-loop counts twice."""
    return edges.select("graphId", F.explode(F.array("source", "target")).alias("id")).groupBy("graphId", "id").agg(F.count("*").alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes of highest degree in each graph; of equal degree the first delivered."""
    d = degrees(edges).join(nodes.select("graphId", "id", "node_ord"), ["graphId", "id"])
    w = Window.partitionBy("graphId").orderBy(F.desc("degree"), "node_ord")
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("graphId", "place", "id", "degree")


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges and average connections (to one decimal, half up) per graph."""
    e = edges.groupBy("graphId").agg(F.count("*").alias("n_edges"))
    out = nodes.groupBy("graphId").agg(F.count("*").alias("n_nodes")).join(e, "graphId", "left").fillna(0, ["n_edges"])
    return out.withColumn("avg_connections", F.floor(2 * F.col("n_edges") / F.col("n_nodes") * 10 + 0.5) / 10)


def layer_stats(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Members found and overall complexity: complex above 30 % complex members, else moderate above 30 % moderate ones."""
    m = members.join(nodes.select("graphId", "id", "complexity"), ["graphId", "id"])
    share = lambda v: F.count_if(F.col("complexity") == v) / F.count("*")
    return m.groupBy("graphId", "layer_id").agg(
        F.count("*").alias("n_members"), F.when(share("complex") > 0.3, "complex").when(share("moderate") > 0.3, "moderate").otherwise("simple").alias("complexity")
    )


def first_layer(members: DataFrame) -> DataFrame:
    """The first layer (by delivery order) that holds a node."""
    return members.groupBy("graphId", "id").agg(F.min_by("layer_id", F.struct("layer_ord", "pos")).alias("layer_id"), F.countDistinct("layer_id").alias("n_layers"))


def grouped_edges(edges: DataFrame, group_of: DataFrame, group: str) -> DataFrame:
    """Edges between groups: ordered pair, count, distinct types; ends without group are ignored, inner edges are kept apart."""
    s = group_of.select("graphId", F.col("id").alias("source"), F.col(group).alias("from_group"))
    t = group_of.select("graphId", F.col("id").alias("target"), F.col(group).alias("to_group"))
    e = edges.join(s, ["graphId", "source"]).join(t, ["graphId", "target"])
    return e.groupBy("graphId", "from_group", "to_group").agg(F.count("*").alias("n_edges"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def portals(layer_edges: DataFrame) -> DataFrame:
    """Outer layers linked with each layer, with the connections of both ways."""
    out = layer_edges.where("from_group <> to_group")
    both = out.select("graphId", F.col("from_group").alias("layer_id"), F.col("to_group").alias("portal"), "n_edges").union(out.select("graphId", "to_group", "from_group", "n_edges"))
    return both.groupBy("graphId", "layer_id", "portal").agg(F.sum("n_edges").alias("connections"))


def fan(edges: DataFrame, types: list[str], k: int = 20) -> DataFrame:
    """The k nodes of highest fan-in and of highest fan-out in each graph."""
    e = edges.where(F.col("type").isin(*types))
    both = e.select("graphId", F.lit("in").alias("side"), F.col("target").alias("id")).union(e.select("graphId", F.lit("out"), "source"))
    counted = both.groupBy("graphId", "side", "id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("graphId", "side").orderBy(F.desc("n"), "id")
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def folders(nodes: DataFrame) -> DataFrame:
    """Container of each node with a path: the first folder below what all paths of its graph share, ``~`` at the root."""
    f = nodes.where("filePath is not null and filePath <> ''").select("graphId", "id", F.split("filePath", "/").alias("parts"))
    ends = f.groupBy("graphId").agg(F.min("parts").alias("a"), F.max("parts").alias("b"))
    # Of sorted paths the first and the last share what all share.
    n_shared = F.size(F.filter(F.sequence(F.lit(0), F.least(F.size("a"), F.size("b")) - 1), lambda i: F.slice("a", 1, i + 1) == F.slice("b", 1, i + 1)))
    depth = ends.select("graphId", F.least(n_shared, F.size("a") - 1, F.size("b") - 1).alias("depth"))
    return f.join(depth, "graphId").select("graphId", "id", F.when(F.size("parts") - 1 > F.col("depth"), F.get("parts", F.col("depth"))).otherwise("~").alias("folder"))


def group_density(edges: DataFrame, group_of: DataFrame, group: str) -> DataFrame:
    """Inner edges, edges that touch the group, and their ratio."""
    e = grouped_edges(edges, group_of, group)
    side = e.select("graphId", F.explode(F.array_distinct(F.array("from_group", "to_group"))).alias(group), "n_edges", (F.col("from_group") == F.col("to_group")).alias("inner"))
    out = side.groupBy("graphId", group).agg(F.sum(F.when(F.col("inner"), F.col("n_edges")).otherwise(0)).alias("inner_edges"), F.sum("n_edges").alias("all_edges"))
    return out.withColumn("density", F.round(F.col("inner_edges") / F.col("all_edges"), 6))


def dependency_direction(group_edges: DataFrame) -> DataFrame:
    """Of each pair of groups the dominant direction; ties have none."""
    e = group_edges.where("from_group <> to_group")
    a, b = F.least("from_group", "to_group"), F.greatest("from_group", "to_group")
    p = e.groupBy("graphId", a.alias("a"), b.alias("b")).agg(F.sum(F.when(F.col("from_group") == a, F.col("n_edges")).otherwise(0)).alias("ab"), F.sum(F.when(F.col("from_group") == b, F.col("n_edges")).otherwise(0)).alias("ba"))
    return p.withColumn("dominant", F.when(F.col("ab") > F.col("ba"), F.concat("a", F.lit(">"), "b")).when(F.col("ba") > F.col("ab"), F.concat("b", F.lit(">"), "a")))


def type_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by type of source, type of target and type of edge."""
    t = nodes.select("graphId", "id", F.col("type").alias("t"))
    e = edges.join(t.select("graphId", F.col("id").alias("source"), F.col("t").alias("source_type")), ["graphId", "source"]).join(t.select("graphId", F.col("id").alias("target"), F.col("t").alias("target_type")), ["graphId", "target"])
    return e.groupBy("source_type", "target_type", "type").agg(F.count("*").alias("n"))


def _with_rank(df: DataFrame, value: str, out: str, descending: bool) -> DataFrame:
    """Percent rank of a whole number within its graph, from a histogram of its values: no task sorts a graph."""
    hist = df.groupBy("graphId", value).agg(F.count("*").alias("_n"))
    by = Window.partitionBy("graphId")
    order = by.orderBy(F.desc(value) if descending else F.asc(value))
    ranks = hist.select("graphId", value, F.coalesce((F.sum("_n").over(order) - F.col("_n")) / F.nullif(F.sum("_n").over(by) - 1, F.lit(0)), F.lit(0.0)).alias(out))
    return df.join(ranks, ["graphId", value])


def entry_scores(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Additive entry-point score of files: name, depth, fan-out in the top tenth, fan-in in the bottom quarter."""
    out_deg = edges.groupBy("graphId", F.col("source").alias("id")).agg(F.count("*").alias("fan_out"))
    in_deg = edges.groupBy("graphId", F.col("target").alias("id")).agg(F.count("*").alias("fan_in"))
    f = nodes.where("type in ('file', 'document') and filePath is not null").join(out_deg, ["graphId", "id"], "left").join(in_deg, ["graphId", "id"], "left").fillna(0, ["fan_out", "fan_in"])
    f = _with_rank(_with_rank(f, "fan_out", "out_rank", True), "fan_in", "in_rank", False)
    by = Window.partitionBy("graphId")
    name = F.lower(basename(F.col("filePath")))
    score = (
        F.when(name.rlike(r"^(?:main|index|app|server|cli|mod|lib)\.[a-z]+$"), 3).otherwise(0) + F.when(F.size(F.split("filePath", "/")) <= 2, 1).otherwise(0)
        + F.when(F.col("out_rank") <= 0.1, 1).otherwise(0) + F.when(F.col("in_rank") <= 0.25, 1).otherwise(0)
        + F.when(name == "readme.md", 5).when(name.endswith(".md"), 2).otherwise(0)
    )
    ranked = f.withColumn("score", score).withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("place") <= k).select("graphId", "place", "id", "score")


def distribution(df: DataFrame, key: str, value: str) -> DataFrame:
    """min, nearest-rank p50 and p95, max, mean (two decimals, half up) of a whole-number column."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.expr(f"percentile_disc(0.5) within group (order by {value})").cast("long").alias("p50"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").cast("long").alias("p95"), F.max(value).alias("max"), (F.floor(F.avg(value) * 100 + 0.5) / 100).alias("mean"),
    )


def detect_layers(nodes: DataFrame) -> DataFrame:
    """Layer of each file node: first pattern that equals a path segment or is it without its plural s; else Core."""
    spark = nodes.sparkSession
    rules = F.broadcast(spark.createDataFrame([(i, name, p + s) for i, (name, ps) in enumerate(S.LAYER_PATTERNS) for p in ps for s in ("", "s")], "ord int, layer string, segment string"))
    f = nodes.where("type = 'file'").select("graphId", "id", F.coalesce("filePath", F.lit("")).alias("path"))
    hits = f.select("graphId", "id", F.explode(F.split(F.lower("path"), "/")).alias("segment")).join(rules, "segment").groupBy("graphId", "id").agg(F.min_by("layer", "ord").alias("layer"))
    return f.join(hits, ["graphId", "id"], "left").select("graphId", "id", F.coalesce("layer", F.lit("Core")).alias("layer"))


def file_tree(nodes: DataFrame) -> DataFrame:
    """Every folder and file of the paths: graphId, path, parent, kind, best node of a file."""
    f = nodes.where("filePath is not null and filePath <> ''").select("graphId", "filePath", "id", (F.col("type") == "file").alias("is_file"), "node_ord")
    files = f.groupBy("graphId", F.col("filePath").alias("path")).agg(F.min_by("id", F.struct(~F.col("is_file"), F.col("node_ord"))).alias("node"))
    parts = F.split("path", "/")
    up = files.where(F.size(parts) > 1).select("graphId", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return files.select("graphId", "path", parent.alias("parent"), F.lit("file").alias("kind"), "node").unionByName(up.select("graphId", "path", parent.alias("parent"), F.lit("folder").alias("kind"), F.lit(None).cast("string").alias("node")))


def node_size(edges: DataFrame) -> DataFrame:
    """Width and height by degree: clamp(0.85 + 0.03 degree, 0.85, 1.5) of 280 by 120, rounded half up."""
    scale = F.greatest(F.lit(0.85), F.least(F.lit(1.5), 0.85 + 0.03 * F.col("degree")))
    return degrees(edges).select("graphId", "id", F.floor(scale * 280 + 0.5).alias("width"), F.floor(scale * 120 + 0.5).alias("height"))
