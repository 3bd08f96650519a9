"""Cleaning of nodes and edges: vocabulary, defaults, ids, dangling and repeated edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions.ids import trim_ws, with_repaired_id, with_repaired_ref
from graphloom.operators.dedup import first_by
from graphloom.session import written


def node_type(c: Column, kind: str = "code") -> Column:
    """Canonical node type: lower case, aliases by kind of graph; missing is ``file``."""
    low = F.lower(c)
    table = S.NODE_ALIASES | (S.DESIGN_NODE_ALIASES if kind == "design" else S.CODE_NODE_ALIASES)
    return F.when(F.coalesce(low, F.lit("")) == "", "file").otherwise(F.coalesce(S.lookup(table, low), low))


def edge_type(c: Column, kind: str = "code") -> Column:
    low = F.lower(c)
    table = S.EDGE_ALIASES | (S.DESIGN_EDGE_ALIASES if kind == "design" else S.CODE_EDGE_ALIASES)
    return F.when(F.coalesce(low, F.lit("")) == "", "depends_on").otherwise(F.coalesce(S.lookup(table, low), low))


def direction(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.coalesce(low, F.lit("")) == "", "forward").otherwise(F.coalesce(S.lookup(S.DIRECTION_ALIASES, low), low))


def batch_direction(c: Column) -> Column:
    """The batch merger's narrower rule: only both and mutual are aliases, all else that is unknown is forward."""
    low = F.lower(trim_ws(c))
    return F.when(low.isin("both", "mutual"), "bidirectional").when(low.isin(*S.DIRECTIONS), low).otherwise("forward")


def complexity(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.coalesce(low, F.lit("")) == "", "moderate").otherwise(F.coalesce(S.lookup(S.COMPLEXITY_ALIASES, low), low))


def batch_complexity(c: Column) -> Column:
    """Complexity of raw batch rows: twelve aliases, numbers 1-3, 4-6 and above; all else is moderate."""
    low = F.lower(trim_ws(c))
    n = low.try_cast("double")
    return (
        F.when(low.isin("simple", "moderate", "complex"), low)
        .when(S.lookup(S.COMPLEXITY_BATCH_ALIASES, low).isNotNull(), S.lookup(S.COMPLEXITY_BATCH_ALIASES, low))
        .when((n >= 1) & (n <= 3), "simple").when((n > 3) & (n <= 6), "moderate").when((n > 6) & ~F.isnan(n), "complex").otherwise("moderate")
    )


def merged_complexity(c: Column) -> Column:
    """value and status (valid, mapped, unknown) by the merger's rule: seven aliases, truncated numbers."""
    low = F.lower(trim_ws(c))
    n = low.try_cast("double").cast("long")
    alias = S.lookup(S.COMPLEXITY_ALIASES, low)
    value = F.when(low.isin("simple", "moderate", "complex"), low).when(alias.isNotNull(), alias).when(n <= 3, "simple").when(n <= 6, "moderate").when(n > 6, "complex").otherwise("moderate")
    status = F.when(low.isin("simple", "moderate", "complex"), "valid").when(alias.isNotNull() | n.isNotNull(), "mapped").otherwise("unknown")
    return F.struct(value.alias("value"), status.alias("status"))


def weight(c: Column) -> Column:
    """Number in [0, 1]: leading number of a text, 0.5 for null, NaN and no number."""
    n = F.regexp_extract(c.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(n, F.lit(0.5))))


def clean_nodes(nodes: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Living nodes, one row per (graphId, repaired id), fields defaulted.

    The latest delivery (arrivedAt, then node_row) counts; if it is a delete the node is gone. Rows without id
    are left out. Columns: graphId, id, type, name, filePath, summary, tags, complexity, node_ord, and those of
    ``more`` as they are.
    """
    n = with_repaired_id(nodes.where(trim_ws(F.col("id")) != ""), "rid")
    kept = ["op", "type", "name", "filePath", "summary", "tags", "complexity", "node_row", *more]
    last = n.groupBy("graphId", "rid").agg(F.max_by(F.struct(*kept), F.struct("arrivedAt", "node_row")).alias("v")).where("v.op <> 'delete'")
    return last.select("graphId", F.col("rid").alias("id"), "v.*").select(
        "graphId", "id", node_type(F.col("type")).alias("type"), "name", "filePath",
        F.when(F.coalesce("summary", F.lit("")) == "", F.coalesce(F.nullif("name", F.lit("")), F.lit("No summary"))).otherwise(F.col("summary")).alias("summary"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), complexity(F.col("complexity")).alias("complexity"), F.col("node_row").alias("node_ord"), *more,
    )


@dataclass
class NormalizedEdges:
    """Edges between living nodes without repeats, and what was dropped with the reason."""

    edges: DataFrame
    dropped: DataFrame


def id_aliases(nodes: DataFrame) -> DataFrame:
    """graphId, ref, alias: the repaired id that a raw id of the deliveries stands for; of several the last delivered.

    Ids that stand for themselves are left out, which are nearly all.
    """
    raw = with_repaired_id(nodes.where(trim_ws(F.col("id")) != ""), "rid")
    return raw.groupBy("graphId", F.col("id").alias("ref")).agg(F.max_by("rid", F.struct("arrivedAt", "node_row")).alias("alias")).where("alias <> ref")


def resolve_aliased(refs: DataFrame, aliases: DataFrame, living: DataFrame) -> DataFrame:
    """graphId, ref, rid, ok of every distinct reference: raw id of a delivery, else itself, else its repair if living."""
    ids = living.select("graphId", "id")
    step = refs.select("graphId", "ref").distinct().join(aliases, ["graphId", "ref"], "left").join(ids.select("graphId", F.col("id").alias("ref"), F.lit(True).alias("known")), ["graphId", "ref"], "left")
    # Nearly all stand for themselves and live; only the others are moved on.
    step, plain = written(step), F.col("alias").isNull() & F.col("known").isNotNull()
    rest = step.where(~plain).withColumn("one", F.coalesce("alias", "ref")).join(ids.select("graphId", F.col("id").alias("one"), F.lit(True).alias("ok1")), ["graphId", "one"], "left")
    rest = with_repaired_ref(rest, "one", "two").join(ids.select("graphId", F.col("id").alias("two"), F.lit(True).alias("ok2")), ["graphId", "two"], "left")
    ok1, ok2 = F.coalesce("ok1", F.lit(False)), F.coalesce("ok2", F.lit(False))
    rest = rest.select("graphId", "ref", F.when(~ok1 & ok2, F.col("two")).otherwise(F.col("one")).alias("rid"), (ok1 | ok2).alias("ok"))
    return step.where(plain).select("graphId", "ref", F.col("ref").alias("rid"), F.lit(True).alias("ok")).union(rest)


def resolve_refs(refs: DataFrame, nodes: DataFrame, living: DataFrame) -> DataFrame:
    """As resolve_aliased, from the raw deliveries."""
    return resolve_aliased(refs, id_aliases(nodes), living)


def resolved_edges(edges: DataFrame, aliases: DataFrame, living: DataFrame) -> DataFrame:
    """Endpoints repaired and vocabulary cleaned; reason tells why an edge is dropped, null for those that are kept.

    Of repeated edges the first is kept, the others are left out. Null endpoints never resolve. Ordinals (edge_ord)
    come from edge_row.
    """
    refs = edges.select("graphId", F.explode(F.array("source", "target")).alias("ref")).where("ref is not null")
    got = resolve_aliased(refs, aliases, living)
    s = got.select("graphId", F.col("ref").alias("source"), F.col("rid").alias("s"), F.col("ok").alias("s_ok"))
    t = got.select("graphId", F.col("ref").alias("target"), F.col("rid").alias("t"), F.col("ok").alias("t_ok"))
    s_ok, t_ok = F.coalesce("s_ok", F.lit(False)), F.coalesce("t_ok", F.lit(False))
    # The source is settled before the second join, so it is moved once.
    e = edges.join(s, ["graphId", "source"], "left").select("graphId", F.coalesce("s", "source").alias("source"), s_ok.alias("s_ok"), "target", "type", "direction", "weight", "edge_row")
    e = e.join(t, ["graphId", "target"], "left").select(
        "graphId", "source", F.coalesce("t", "target").alias("target"), edge_type(F.col("type")).alias("type"),
        direction(F.col("direction")).alias("direction"), weight(F.col("weight")).alias("weight"), F.col("edge_row").alias("edge_ord"),
        F.when(~F.col("s_ok") & ~t_ok, "missing-both").when(~F.col("s_ok"), "missing-source").when(~t_ok, "missing-target").alias("reason"),
    )
    # Dropped edges are each a group of their own, so one pass serves both.
    own = F.when(F.col("reason").isNotNull(), F.col("edge_ord"))
    return first_by(e.withColumn("own", own), ["graphId", "source", "target", "type", "own"], "edge_ord").drop("own")


def normalize_edges(edges: DataFrame, nodes: DataFrame, living: DataFrame) -> NormalizedEdges:
    """Edges between living nodes without repeats, and what was dropped with the reason."""
    every = resolved_edges(edges, id_aliases(nodes), living)
    return NormalizedEdges(every.where("reason is null").drop("reason"), every.where("reason is not null").select("graphId", "edge_ord", "source", "target", "type", "reason"))
