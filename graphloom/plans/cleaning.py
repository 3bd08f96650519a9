"""Queries of cleaning, deduplication and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions.ids import with_repaired_id
from graphloom.operators import dedup, normalize, validate
from graphloom.plans.base import BASE, Graphs
from graphloom.plans.integrity import repaired
from graphloom.session import table


def n1_n3_nodes(spark: SparkSession, d: str) -> DataFrame:
    return normalize.clean_nodes(table(spark, d, "nodes")).select("graphId", "id", "type", "name", "filePath", "summary", F.array_join("tags", ",", "").alias("tags"), "complexity", "node_ord")


def n4_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges")
    return e.select("edge_row", normalize.edge_type(F.col("type")).alias("type"), normalize.direction(F.col("direction")).alias("direction"), F.round(normalize.weight(F.col("weight")), 6).alias("weight"))


def n8_batch_complexity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select("node_row", normalize.batch_complexity(F.col("complexity")).alias("complexity"))


def n10_edges(spark: SparkSession, d: str) -> DataFrame:
    """From the raw tables, not from those written once."""
    n = table(spark, d, "nodes")
    return normalize.normalize_edges(table(spark, d, "edges"), n, normalize.clean_nodes(n)).edges.withColumn("weight", F.round("weight", 6))


def n7_ids(spark: SparkSession, d: str) -> DataFrame:
    return with_repaired_id(table(spark, d, "nodes"), "rid").select("node_row", "rid")


def n14_merged_complexity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select("node_row", normalize.merged_complexity(F.col("complexity")).alias("c")).select("node_row", "c.value", "c.status")


def n15_batch_direction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").groupBy(normalize.batch_direction(F.col("direction")).alias("direction")).agg(F.count("*").alias("n"))


def n20_node_category(spark: SparkSession, d: str) -> DataFrame:
    return Graphs(spark, d).nodes.groupBy("graphId", F.coalesce(S.lookup(S.NODE_CATEGORY, F.col("type")), F.lit("code")).alias("category")).agg(F.count("*").alias("n"))


def j1_dropped(spark: SparkSession, d: str) -> DataFrame:
    return Graphs(spark, d).normalized.dropped


def j2_layer_members(spark: SparkSession, d: str) -> DataFrame:
    m = Graphs(spark, d).members
    return m.groupBy("graphId", "layer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), "|").alias("members"))


def dedup_edges_strongest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").where("source is not null and target is not null").select("graphId", "source", "target", normalize.edge_type(F.col("type")).alias("type"), normalize.batch_direction(F.col("direction")).alias("direction"), normalize.weight(F.col("weight")).alias("weight"), "edge_row")
    return dedup.strongest(e, ["graphId", "source", "target", "type", "direction"], "weight", "edge_row").withColumn("weight", F.round("weight", 6))


def dedup_nodes_last_first_place(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").where("id is not null").select("graphId", "id", "name", "node_row")
    return dedup.last_value_first_place(n, ["graphId", "id"], "node_row")


def r27_validation(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return validate.validation_report(g.nodes, g.normalized.dropped, g.edges, g.members)


def r28_expected_edges(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return validate.missing_expected_edges(g.nodes, g.edges)


def n5_violations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").where("op <> 'delete'")
    return validate.node_violations(n)


def g24_fix_patterns(spark: SparkSession, d: str) -> DataFrame:
    n = with_repaired_id(table(spark, d, "nodes").where("id is not null"), "rid")
    return n.where("id <> rid").groupBy(validate.id_fix(F.col("id"), F.col("rid")).alias("pattern")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        n1_n3_nodes, n4_edges, n5_violations, n7_ids, n8_batch_complexity, n10_edges, n14_merged_complexity, n15_batch_direction, n20_node_category, j1_dropped, j2_layer_members,
        dedup_edges_strongest, dedup_nodes_last_first_place, r27_validation, r28_expected_edges, g24_fix_patterns,
    )
}

_CX12 = ", ".join(f"({k!r}, {v!r})" for k, v in S.COMPLEXITY_BATCH_ALIASES.items())
_EXPECTED = ", ".join(f"({t!r}, {e!r})" for t, es in validate.EXPECTED_EDGES.items() for e in es)
_TYPES = ", ".join(repr(t) for t in S.NODE_CATEGORY)
ORACLE = {
    "n1_n3_nodes": BASE + "select graphId, id, type, name, filePath, summary, coalesce(list_aggregate(list_transform(tags, lambda t: coalesce(t, '')), 'string_agg', ','), '') as tags, complexity, node_ord from n",
    "n4_edges": BASE + "select e.edge_row, x.type, x.direction, round(x.weight, 6) as weight from edges e join e0 x on x.edge_ord = e.edge_row",
    "n5_violations": f"""select violation, count(*) as n from (select case when trim(coalesce(id, '')) = '' then 'no id' when coalesce(name, '') = '' then 'no name'
      when lower(coalesce(type, 'file')) not in ({_TYPES}) then 'unknown type' else 'valid' end as violation from nodes where op <> 'delete') group by 1""",
    "n7_ids": f"select node_row, {repaired('id', 'type', 'filePath', 'name')} as rid from nodes",
    "n8_batch_complexity": f"""select node_row, case when lower(trim(complexity)) in ('simple', 'moderate', 'complex') then lower(trim(complexity)) when a.v is not null then a.v
      when try_cast(complexity as double) between 1 and 3 then 'simple' when try_cast(complexity as double) > 3 and try_cast(complexity as double) <= 6 then 'moderate'
      when try_cast(complexity as double) > 6 then 'complex' else 'moderate' end as complexity from nodes left join (values {_CX12}) a(k, v) on a.k = lower(trim(complexity))""",
    "n10_edges": BASE + "select graphId, source, target, type, direction, round(weight, 6) as weight, edge_ord from e",
    "n14_merged_complexity": """with a(k, v) as (values ('low', 'simple'), ('easy', 'simple'), ('medium', 'moderate'), ('intermediate', 'moderate'), ('high', 'complex'), ('hard', 'complex'), ('difficult', 'complex'))
      select node_row, case when c in ('simple', 'moderate', 'complex') then c when a.v is not null then a.v when x <= 3 then 'simple' when x <= 6 then 'moderate' when x > 6 then 'complex' else 'moderate' end as value,
      case when c in ('simple', 'moderate', 'complex') then 'valid' when a.v is not null or x is not null then 'mapped' else 'unknown' end as status
      from (select node_row, lower(trim(complexity)) as c, trunc(try_cast(complexity as double)) as x from nodes) left join a on a.k = c""",
    "n15_batch_direction": "select case when lower(trim(direction)) in ('both', 'mutual') then 'bidirectional' when lower(trim(direction)) in ('forward', 'backward', 'bidirectional') then lower(trim(direction)) else 'forward' end as direction, count(*) as n from edges group by 1",
    "n20_node_category": BASE + "select graphId, coalesce(nc.v, 'code') as category, count(*) as n from n left join nc on nc.k = n.type group by 1, 2",
    "j1_dropped": BASE + "select graphId, edge_ord, source, target, type, case when not s_ok and not t_ok then 'missing-both' when not s_ok then 'missing-source' else 'missing-target' end as reason from e0 where not (s_ok and t_ok)",
    "j2_layer_members": BASE + "select graphId, layer_id, string_agg(id, '|' order by pos, id) as members from lm group by 1, 2",
    "dedup_edges_strongest": BASE.rstrip() + """, q as (select e.graphId, e.source, e.target, x.type, case when lower(trim(e.direction)) in ('both', 'mutual') then 'bidirectional'
      when lower(trim(e.direction)) in ('forward', 'backward', 'bidirectional') then lower(trim(e.direction)) else 'forward' end as direction, x.weight, e.edge_row from edges e join e0 x on x.edge_ord = e.edge_row where e.source is not null and e.target is not null)
      select graphId, source, target, type, direction, round(weight, 6) as weight, edge_row from q qualify row_number() over (partition by graphId, source, target, type, direction order by weight desc, edge_row) = 1""",
    "dedup_nodes_last_first_place": "select graphId, id, arg_max(struct_pack(v := name), node_row).v as name, min(node_row) as node_row from nodes where id is not null group by 1, 2",
    "r27_validation": BASE + """select graphId, 'dangling-edge' as "check", count(*) as n from e0 where not (s_ok and t_ok) group by 1
      union all select n.graphId, 'orphan-node', count(*) from n where not exists (select 1 from e where e.graphId = n.graphId and (e.source = n.id or e.target = n.id)) group by 1
      union all select n.graphId, 'file-without-layer', count(*) from n where type = 'file' and not exists (select 1 from lm where lm.graphId = n.graphId and lm.id = n.id) group by 1
      union all select graphId, 'node-in-several-layers', count(*) from (select graphId, id from lm group by 1, 2 having count(distinct layer_id) > 1) group by 1
      union all select graphId, 'self-edge', count(*) from e where source = target group by 1""",
    "r28_expected_edges": BASE.rstrip() + f", x(t, et) as (values {_EXPECTED}) select n.graphId, n.id, n.type from n where n.type in (select t from x) and not exists (select 1 from e join x on x.et = e.type and x.t = n.type where e.graphId = n.graphId and (e.source = n.id or e.target = n.id))",
    "g24_fix_patterns": f"""with q as (select id, {repaired('id', 'type', 'filePath', 'name')} as rid from nodes where id is not null)
      select case when regexp_replace(id, '^\\s+|\\s+$', '', 'g') = rid then 'white space' when strpos(id, ':') = 0 then 'bare path' when ends_with(trim(id), rid) then 'foreign prefix' else 'rebuilt' end as pattern, count(*) as n from q where id <> rid group by 1""",
}
