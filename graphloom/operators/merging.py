"""Merging of whole graphs: subdomains, knowledge bases, tours, pending edges, recovery and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import trim_ws
from graphloom.operators.building import entity_name, knowledge_edge_type, knowledge_node_type
from graphloom.operators.dedup import first_by, last_by, strongest

# Edges of the hierarchy, which are tried again in the next run if an endpoint is missing.
STRUCTURAL_EDGES = ("contains_flow", "flow_step", "cross_domain")


def _resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with s_ok and t_ok: whether source and target are nodes."""
    ids = nodes.select(F.col("id").alias("_i"), F.lit(True).alias("_ok"), "graphId")
    s = ids.select("graphId", F.col("_i").alias("source"), F.col("_ok").alias("s_ok"))
    t = ids.select("graphId", F.col("_i").alias("target"), F.col("_ok").alias("t_ok"))
    return edges.join(s, ["graphId", "source"], "left").join(t, ["graphId", "target"], "left").fillna(False, ["s_ok", "t_ok"])


def merge_subdomains(nodes: DataFrame, edges: DataFrame, pending: tuple[str, ...] = STRUCTURAL_EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and dropped edges of graphs that are merged by graphId, in the order of their rows.

    nodes: graphId, id, node_row, ...; edges: graphId, source, target, type, weight, edge_row. Of nodes with one id the last
    counts, of edges with one source, target and type the strongest, ties to the first. Null ids are left out. Dropped edges tell
    what is missing and whether they are kept for the next run. An edge of an earlier run that is fed in again
    takes part like any other, so it resolves once its node has come.
    """
    n = last_by(nodes.where(F.coalesce("id", F.lit("")) != ""), ["graphId", "id"], "node_row")
    e = strongest(edges.withColumn("weight", F.coalesce(F.nanvl("weight", F.lit(0.0)), F.lit(0.0))), ["graphId", "source", "target", "type"], "weight", "edge_row")
    j = _resolved(e, n)
    missing = F.when(~F.col("s_ok") & ~F.col("t_ok"), "both").when(~F.col("s_ok"), "source").otherwise("target")
    dropped = j.where("not (s_ok and t_ok)").select("graphId", "source", "target", "type", "weight", "edge_row", missing.alias("missing"), F.coalesce(F.col("type").isin(*pending), F.lit(False)).alias("retry"))
    return n, j.where("s_ok and t_ok").drop("s_ok", "t_ok"), dropped


def merge_report(nodes: DataFrame, edges: DataFrame, kept_nodes: DataFrame, kept_edges: DataFrame, dropped: DataFrame) -> DataFrame:
    """graphId, item, n: what went in, what was merged away, what was dropped, what came out."""
    count = lambda df, name: df.groupBy("graphId").agg(F.count("*").alias("n")).select("graphId", F.lit(name).alias("item"), "n")
    parts = [count(nodes, "input nodes"), count(edges, "input edges"), count(kept_nodes, "output nodes"), count(kept_edges, "output edges"), count(dropped, "dropped edges"), count(dropped.where("retry"), "pending edges")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def merge_knowledge(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (graphId, id, type, node_row) and edges of a knowledge graph.

    Types are cleaned, rows of unknown node types left out, unknown edge types are ``related``. Entities of one name are one: the first
    delivered stands for them and edges are led to it. Of other nodes with one id the last counts. Edges between nodes
    that exist are kept, the first of each source, target and type.
    """
    n = nodes.where("id is not null").select("graphId", "id", "node_row", knowledge_node_type(F.col("type")).alias("type"), entity_name(F.coalesce("name", F.lit(""))).alias("norm")).where("type is not null")
    ent = n.where("type = 'entity'")
    head = first_by(ent, ["graphId", "norm"], "node_row").select("graphId", "norm", F.col("id").alias("head"))
    remap = ent.join(head, ["graphId", "norm"]).where("id <> head").select("graphId", "id", "head").groupBy("graphId", "id").agg(F.min("head").alias("head"))
    kept = first_by(ent, ["graphId", "norm"], "node_row").unionByName(n.where("type <> 'entity'"))
    kept = last_by(kept, ["graphId", "id"], "node_row").drop("norm")
    e = edges.where("source is not null and target is not null").select("graphId", "source", "target", knowledge_edge_type(F.col("type")).alias("type"), "edge_row")
    s = remap.select("graphId", F.col("id").alias("source"), F.col("head").alias("s"))
    t = remap.select("graphId", F.col("id").alias("target"), F.col("head").alias("t"))
    e = e.join(s, ["graphId", "source"], "left").join(t, ["graphId", "target"], "left").select("graphId", F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), "type", "edge_row")
    e = _resolved(e, kept).where("s_ok and t_ok").drop("s_ok", "t_ok")
    return kept, first_by(e, ["graphId", "source", "target", "type"], "edge_row")


def with_other_layer(nodes: DataFrame, members: DataFrame, other: str = "layer:other") -> DataFrame:
    """Every node with its first layer, those without one in the bucket ``other``."""
    first = members.groupBy("graphId", "id").agg(F.min_by("layer_id", F.struct("layer_ord", "pos")).alias("layer_id"))
    return nodes.select("graphId", "id").join(first, ["graphId", "id"], "left").select("graphId", "id", F.coalesce("layer_id", F.lit(other)).alias("layer_id"))


def place_orphans(orphans: DataFrame, articles: DataFrame) -> DataFrame:
    """graphId, id, article: articles whose file name holds the orphan's stem as a whole run of its words; the first by id.

    orphans and articles: graphId, id. Names are cut into runs of words, so that the lookup is an equi-join. Stems without an
    article are left out.
    """
    words = lambda c: F.split(F.lower(F.regexp_replace(F.element_at(F.split(c, "[:/]"), -1), r"\.[a-z]+$", "")), "[^a-z0-9]+")
    runs = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(i, F.size(w)), lambda j: F.array_join(F.slice(w, i, j - i + 1), "-"))))
    a = articles.select("graphId", F.col("id").alias("article"), F.explode(F.array_distinct(runs(words(F.col("id"))))).alias("stem"))
    o = orphans.select("graphId", "id", F.array_join(words(F.col("id")), "-").alias("stem")).where("stem <> ''")
    return o.join(a, ["graphId", "stem"]).groupBy("graphId", "id").agg(F.min("article").alias("article"))


def merge_tours(steps: DataFrame) -> DataFrame:
    """Steps of one title as one: graphId, step, title, description, n_nodes, nodes.

    steps: graphId, ord (unique), title, description, nodeIds. The order is that of first titles, the longest description
    stays (ties to the first), and the nodes are those of all, each once, in order.
    """
    heads = steps.groupBy("graphId", "title").agg(F.min("ord").alias("at"), F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("ord"))).alias("description"))
    ids = steps.select("graphId", "title", "ord", F.posexplode("nodeIds").alias("pos", "id")).groupBy("graphId", "title", "id").agg(F.min(F.struct("ord", "pos")).alias("first"))
    lists = ids.groupBy("graphId", "title").agg(F.count("*").alias("n_nodes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "id"))), lambda x: x["id"]), "|").alias("nodes"))
    w = Window.partitionBy("graphId").orderBy("at")
    return heads.join(lists, ["graphId", "title"], "left").select("graphId", F.row_number().over(w).alias("step"), "title", "description", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("nodes", F.lit("")).alias("nodes"))


def recover_imports(imports: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graphId, source, target, outcome of each import pair: recovered, present, self, no-source or no-target.

    imports: graphId, source, target (ids). Only pairs whose both ends are nodes and that no edge of the type has are recovered.
    """
    have = edges.where("type = 'imports'").select("graphId", "source", "target", F.lit(True).alias("have"))
    j = _resolved(imports.distinct(), nodes).join(have, ["graphId", "source", "target"], "left")
    outcome = F.when(F.col("source") == F.col("target"), "self").when(~F.col("s_ok"), "no-source").when(~F.col("t_ok"), "no-target").when(F.col("have"), "present").otherwise("recovered")
    return j.select("graphId", "source", "target", outcome.alias("outcome"))


def integrity(expected: DataFrame, got: DataFrame, key: list[str]) -> DataFrame:
    """key, n_expected, n_got, finding of every key that differs: missing, unexpected or repeated."""
    a = expected.groupBy(*key).agg(F.count("*").alias("n_expected"))
    b = got.groupBy(*key).agg(F.count("*").alias("n_got"))
    j = a.join(b, key, "full_outer").fillna(0, ["n_expected", "n_got"])
    finding = F.when(F.col("n_got") == 0, "missing").when(F.col("n_expected") == 0, "unexpected").when(F.col("n_got") > F.col("n_expected"), "repeated")
    return j.withColumn("finding", finding).where("finding is not null")


def batch_outcomes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph and batch: rows, valid and invalid nodes, deletes, edges and those with a blank end; batches of nothing valid are empty."""
    ok = F.coalesce(trim_ws(F.col("id")), F.lit("")) != ""
    n = nodes.groupBy("graphId", "batch_ord").agg(F.count_if(ok & (F.col("op") != "delete")).alias("n_nodes"), F.count_if(~ok).alias("n_invalid"), F.count_if(ok & (F.col("op") == "delete")).alias("n_deletes"))
    blank = (F.coalesce(trim_ws(F.col("source")), F.lit("")) == "") | (F.coalesce(trim_ws(F.col("target")), F.lit("")) == "")
    e = edges.groupBy("graphId", "batch_ord").agg(F.count("*").alias("n_edges"), F.count_if(blank).alias("n_blank"))
    j = n.join(e, ["graphId", "batch_ord"], "full_outer").fillna(0, ["n_nodes", "n_invalid", "n_deletes", "n_edges", "n_blank"])
    return j.withColumn("empty", (F.col("n_nodes") == 0) & (F.col("n_edges") == F.col("n_blank")))
