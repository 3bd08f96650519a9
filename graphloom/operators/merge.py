"""Merging of partial graphs: layers, tours, project data, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import basename


def merge_layers(layers: DataFrame) -> DataFrame:
    """Layers of one id in a graph become one: attributes of the first delivery, distinct members of all in order."""
    first = layers.groupBy("graphId", "id").agg(F.min_by(F.struct("name", "description"), "layer_row").alias("v"))
    m = layers.select("graphId", "id", "layer_row", F.posexplode_outer("nodeIds").alias("pos", "ref"))
    d = m.where("ref is not null").groupBy("graphId", "id", "ref").agg(F.min(F.struct("layer_row", "pos")).alias("at"))
    members = d.groupBy("graphId", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("nodeIds"))
    return first.join(members, ["graphId", "id"], "left").select("graphId", "id", "v.name", "v.description", F.coalesce("nodeIds", F.array().cast("array<string>")).alias("nodeIds"))


def merge_projects(graphs: DataFrame) -> DataFrame:
    """One project of all graphs: last name (by graphId), distinct languages and frameworks in order, latest analysis."""
    langs = graphs.select(F.explode("languages").alias("x")).distinct()
    frames = graphs.select(F.explode("frameworks").alias("x")).distinct()
    one = graphs.agg(F.max_by("name", F.when(F.coalesce("name", F.lit("")) != "", F.col("graphId"))).alias("name"), F.max("analyzedAt").alias("analyzedAt"), F.count("*").alias("n_graphs")).withColumn("k", F.lit(0))
    joined = lambda df, n: df.agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias(n)).withColumn("k", F.lit(0))
    return one.join(joined(langs, "languages"), "k").join(joined(frames, "frameworks"), "k").drop("k")


def is_test_path(path: Column) -> Column:
    """Whether a path is a test by the naming rules of its language."""
    b = basename(path)
    return (
        b.rlike(r"(?:\.|_)(?:test|spec)\.[jt]sx?$") | b.rlike(r"^test_.*\.py$") | b.rlike(r"_test\.(?:py|go|rb|exs)$") | b.rlike(r"(?:Test|Tests|IT|Spec)\.(?:java|kt|scala|cs|swift|php)$")
        | b.rlike(r"_spec\.rb$") | F.concat(F.lit("/"), path).rlike(r"/(?:__tests__|tests?|spec)/")
    )


def pair_tests(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Production and test of each tested_by edge: (production, test), flipped ones turned, others dropped; strongest wins."""
    c = nodes.where("filePath is not null").select("graphId", "id", is_test_path(F.col("filePath")).alias("is_test"))
    e = edges.where("type = 'tested_by'").join(c.select("graphId", F.col("id").alias("source"), F.col("is_test").alias("s_test")), ["graphId", "source"]).join(c.select("graphId", F.col("id").alias("target"), F.col("is_test").alias("t_test")), ["graphId", "target"])
    flip = F.col("s_test") & ~F.col("t_test")
    p = e.where(F.col("s_test") != F.col("t_test")).select("graphId", F.when(flip, F.col("target")).otherwise(F.col("source")).alias("production"), F.when(flip, F.col("source")).otherwise(F.col("target")).alias("test"), "weight", "edge_ord", flip.alias("flipped"))
    return p.groupBy("graphId", "production", "test").agg(F.max_by(F.struct("weight", "flipped"), F.struct("weight", -F.col("edge_ord"))).alias("v")).select("graphId", "production", "test", F.round("v.weight", 6).alias("weight"), "v.flipped")


def build_graph(files: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and contains edges (weight 1) from files and their function and class lists."""
    f = files.select("graphId", F.col("path").alias("filePath")).distinct()
    file_nodes = f.select("graphId", F.concat(F.lit("file:"), "filePath").alias("id"), F.lit("file").alias("type"), basename(F.col("filePath")).alias("name"), "filePath")
    parts = []
    for column, kind, prefix in (("functions", "function", "function:"), ("classes", "class", "class:")):
        x = fingerprints.select("graphId", F.col("path").alias("filePath"), F.explode(column).alias("x")).select("graphId", "filePath", "x.name").where("name is not null").distinct()
        parts.append(x.select("graphId", F.concat(F.lit(prefix), "filePath", F.lit(":"), "name").alias("id"), F.lit(kind).alias("type"), "name", "filePath"))
    children = parts[0].unionByName(parts[1]).join(f, ["graphId", "filePath"], "left_semi")
    edges = children.select("graphId", F.concat(F.lit("file:"), "filePath").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight"))
    return file_nodes.unionByName(children.select(*file_nodes.columns)), edges


def missing_parts(df: DataFrame, key: list[str], part: str) -> DataFrame:
    """Numbers that are missing from 1 to the largest part of each key."""
    g = df.groupBy(*key).agg(F.collect_set(F.col(part).cast("int")).alias("have"), F.max(F.col(part).cast("int")).alias("top"))
    return g.select(*key, F.explode(F.array_except(F.sequence(F.lit(1), F.greatest("top", F.lit(1))), "have")).alias("missing"))


def capped(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group in order: the feature is the cap."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
