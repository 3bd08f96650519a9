"""Design documents: structural nodes of a layer tree, tokens of styles, merging into a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

# Node types of a design tree and the graph types they become; other nodes are looked through.
DESIGN_TYPES = {"CANVAS": "page", "FRAME": "screen", "COMPONENT": "component", "COMPONENT_SET": "componentSet", "INSTANCE": "instance"}


def nearest_structural(tree: DataFrame) -> DataFrame:
    """doc, id, holder, kind of every node of a tree (doc, id, parent, type, name): the nearest structural node above it.

    Frames are screens only where no screen is above them; sections, groups and inner frames are looked through. The walk goes
    level by level from the roots, so cycles, which no root leads to, are left out.
    """
    kind = F.create_map(*[F.lit(x) for k, v in DESIGN_TYPES.items() for x in (k, v)])[F.col("type")]
    t = cut_lineage(tree.select("doc", "id", "parent", kind.alias("kind"), "name"))
    known = t.select("doc", F.col("id").alias("parent"))
    front = cut_lineage(t.join(known, ["doc", "parent"], "left_anti").select("doc", "id", F.lit(None).cast("string").alias("holder"), F.when(F.col("kind") != "screen", F.col("kind")).alias("kind"), "name", F.lit(False).alias("in_screen")))
    done = front
    while not front.isEmpty():
        up = front.select("doc", F.col("id").alias("parent"), F.when(F.col("kind").isNotNull(), F.col("id")).otherwise(F.col("holder")).alias("holder"), (F.col("in_screen") | F.coalesce(F.col("kind").isin("screen", "component", "componentSet", "instance"), F.lit(False))).alias("in_screen"))
        below = t.join(up, ["doc", "parent"])
        own = F.when((F.col("kind") == "screen") & F.col("in_screen"), None).otherwise(F.col("kind"))
        front = cut_lineage(below.select("doc", "id", "holder", own.alias("kind"), "name", "in_screen"))
        done = done.union(front)
    return done


def parse_document(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc, id, type, name) and contains edges (doc, source, target) of the structural nodes of a tree."""
    s = cut_lineage(nearest_structural(tree).where("kind is not null"))
    return s.select("doc", "id", F.col("kind").alias("type"), "name"), s.where("holder is not null").select("doc", F.col("holder").alias("source"), F.col("id").alias("target"))


def tokens(tree: DataFrame, styles: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Token nodes (doc, id, kind, name) and uses_token edges (doc, source, target) from the nearest structural node of each use.

    styles: doc, local_id, key, name, kind; uses: doc, id (a node of the tree), style (a local id or a published key). Of styles with
    one name the first by local id stands for all.
    """
    first = Window.partitionBy("doc", "name").orderBy("local_id")
    s = styles.withColumns({"head": F.first("local_id").over(first)})
    token = F.concat(F.lit("token:"), F.regexp_replace(F.lower(F.trim("name")), r"[^a-z0-9]+", "-"))
    nodes = s.where("head = local_id").select("doc", token.alias("id"), "kind", "name")
    by_any = s.select("doc", F.col("local_id").alias("style"), token.alias("target")).union(s.where("key is not null").select("doc", "key", token)).distinct()
    n = nearest_structural(tree).select("doc", "id", F.when(F.col("kind").isNotNull(), F.col("id")).otherwise(F.col("holder")).alias("source"))
    return nodes, uses.join(by_any, ["doc", "style"]).join(n, ["doc", "id"]).where("source is not null").select("doc", "source", "target").distinct()


def patched(nodes: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes (doc, id, ...) with the non-null values of patches (doc, id, ord, columns); of several the last counts. Thumbnails are patches too."""
    last = patches.groupBy("doc", "id").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"_{c}") for c in columns])
    j = nodes.join(last, ["doc", "id"], "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in nodes.columns])


def design_tour(nodes: DataFrame, size: int = 8) -> DataFrame:
    """doc, step, id: screens and components in the order of their names, ``size`` a step."""
    w = Window.partitionBy("doc").orderBy("name", "id")
    n = nodes.where(F.col("type").isin("screen", "component", "componentSet"))
    return n.select("doc", F.floor((F.row_number().over(w) - 1) / size).cast("int").alias("step"), "id")
