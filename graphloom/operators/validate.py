"""Checks of graphs; every finding is a row, nothing is raised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions.ids import trim_ws

# Edge types of which a node of the type should have one.
EXPECTED_EDGES = {"document": ["documents"], "config": ["configures"], "table": ["reads_from", "writes_to", "migrates", "defines_schema"], "pipeline": ["triggers", "deploys"], "resource": ["provisions", "deploys", "configures"]}


def node_violations(nodes: DataFrame) -> DataFrame:
    """Counts of nodes that validation would drop, by reason, and of those it keeps."""
    reason = (
        F.when(F.coalesce(trim_ws(F.col("id")), F.lit("")) == "", "no id").when(F.coalesce("name", F.lit("")) == "", "no name")
        .when(~F.coalesce(F.lower("type"), F.lit("file")).isin(*S.NODE_CATEGORY), "unknown type").otherwise("valid")
    )
    return nodes.groupBy(reason.alias("violation")).agg(F.count("*").alias("n"))


def validation_report(nodes: DataFrame, dropped: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """graphId, check, n for each kind of finding that occurs."""
    touched = edges.select("graphId", F.explode(F.array("source", "target")).alias("id")).distinct()
    found = {
        "dangling-edge": dropped.select("graphId"),
        "orphan-node": nodes.join(touched, ["graphId", "id"], "left_anti").select("graphId"),
        "file-without-layer": nodes.where("type = 'file'").join(members, ["graphId", "id"], "left_anti").select("graphId"),
        "node-in-several-layers": members.groupBy("graphId", "id").agg(F.countDistinct("layer_id").alias("k")).where("k > 1").select("graphId"),
        "self-edge": edges.where("source = target").select("graphId"),
    }
    return reduce(DataFrame.unionByName, [df.groupBy("graphId").agg(F.lit(k).alias("check"), F.count("*").alias("n")) for k, df in found.items()])


def missing_expected_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of a type that should have certain edges and have none of them."""
    spark = nodes.sparkSession
    want = F.broadcast(spark.createDataFrame([(t, e) for t, es in EXPECTED_EDGES.items() for e in es], "type string, edge_type string"))
    ends = edges.select("graphId", F.col("type").alias("edge_type"), F.explode(F.array("source", "target")).alias("id"))
    have = ends.join(want, "edge_type").select("graphId", "id", "type")
    return nodes.where(F.col("type").isin(*EXPECTED_EDGES)).join(have, ["graphId", "id", "type"], "left_anti").select("graphId", "id", "type")


def id_fix(raw: Column, fixed: Column) -> Column:
    """Label of what a repair changed."""
    t = trim_ws(raw)
    return F.when(t == fixed, "white space").when(F.instr(raw, ":") == 0, "bare path").when(F.endswith(t, fixed), "foreign prefix").otherwise("rebuilt")
