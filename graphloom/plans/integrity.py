"""Queries on references (p1) and snapshots (p6), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import orphans, snapshots
from graphloom.session import table

_NODE_COLS = ["node_row", "graphId", "id", "type", "name", "filePath", "op", "arrivedAt"]


def p1_misses(spark: SparkSession, d: str) -> DataFrame:
    refs = (
        orphans.references_of_edges(table(spark, d, "edges"), "edges", "edge_row", "arrivedAt")
        .unionByName(orphans.references_of_edges(table(spark, d, "dropped_edges"), "dropped_edges", "drop_row", "droppedAt"))
        .unionByName(orphans.references_of_members(table(spark, d, "layers"), "layers", "layer_row", "arrivedAt"))
    )
    return orphans.classify_references(refs, table(spark, d, "nodes").select(*_NODE_COLS))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_misses(spark, d).select("ref_table", "row_id", "node_ref", "state")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p1_misses(spark, d))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    dropped = table(spark, d, "dropped_edges")
    refs = orphans.references_of_edges(dropped, "dropped_edges", "drop_row", "droppedAt")
    misses = orphans.classify_references(refs, table(spark, d, "nodes").select(*_NODE_COLS))
    return orphans.drop_reasons(misses, dropped)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "fingerprints"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(p6_found(spark, d))


_V = "file|func|class|module|concept|config|document|service|table|endpoint|pipeline|schema|resource|domain|flow|step"
_PRE = f"'(?s)^(?:[^:]+:)*?(?:(?:{_V}):)*({_V}):(.*)$'"
_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def repaired(id_: str, type_: str, path: str, name: str) -> str:
    """SQL of the repaired id of a node row; steps do not occur without flow in these tables."""
    t = _TRIM.format(x=id_)
    return f"""(case when {t} = '' then '' when regexp_extract({t}, {_PRE}, 1) <> ''
      then regexp_extract({t}, {_PRE}, 1) || ':' || regexp_extract({t}, {_PRE}, 2)
      when lower({type_}) in ('function', 'class') and coalesce({path}, '') <> '' and coalesce({name}, '') <> ''
      then (case when lower({type_}) = 'class' then 'class' else 'func' end) || ':' || {path} || ':' || {name}
      when lower({type_}) = 'function' then 'func:' || regexp_replace({t}, '^(?:[^:]+:)+', '')
      when lower({type_}) in ('{_V.replace("|", "', '")}') and lower({type_}) <> 'func'
      then lower({type_}) || ':' || regexp_replace({t}, '^(?:[^:]+:)+', '') else {t} end)"""


def repaired_ref(x: str) -> str:
    t = _TRIM.format(x=x)
    return f"""(case when regexp_extract({t}, {_PRE}, 1) <> '' then regexp_extract({t}, {_PRE}, 1) || ':' || regexp_extract({t}, {_PRE}, 2)
      else 'file:' || regexp_replace({t}, '^(?:[^:]+:)+', '') end)"""


_P1 = f"""
with n as (select node_row, graphId, id as raw, op, arrivedAt, {repaired("id", "type", "filePath", "name")} as rid
           from nodes where trim(coalesce(id, '')) <> ''),
al as (select graphId, raw, arg_max(rid, (arrivedAt, node_row)) as rid from n group by 1, 2),
ids as (select distinct graphId, rid from n),
refs as (
  select distinct 'edges' as ref_table, edge_row as row_id, graphId, unnest([source, target]) as node_ref, arrivedAt as moment from edges
  union all select distinct 'dropped_edges', drop_row, graphId, unnest([source, target]), droppedAt from dropped_edges
  union all select distinct 'layers', layer_row, graphId, unnest(nodeIds), arrivedAt from layers),
r as (select * from refs where {_TRIM.format(x="node_ref")} <> ''),
m as (select r.*, coalesce(al.rid, own.rid, rep.rid) as rid from r
  left join al on al.graphId = r.graphId and al.raw = r.node_ref
  left join ids own on own.graphId = r.graphId and own.rid = r.node_ref
  left join ids rep on rep.graphId = r.graphId and rep.rid = {repaired_ref("r.node_ref")}),
l as (select m.ref_table, m.row_id, m.node_ref, m.graphId, m.moment, m.rid,
        arg_max(n.op, (n.arrivedAt, n.node_row)) filter (n.arrivedAt <= m.moment) as last_op
      from m left join n on n.graphId = m.graphId and n.rid = m.rid group by all),
p1 as (select *, case when rid is null then 'missing' when last_op is null then 'late' else 'deleted' end as state
       from l where rid is null or last_op is null or last_op = 'delete')
"""

_P6 = """
with f as (select graphId, snapshot_no, fp_row, deliveredAt, functions,
    regexp_replace(regexp_replace(replace(filePath, '\\', '/'), '/+', '/', 'g'), '^(\\./|/)+', '') as filePath,
    nullif(regexp_replace(lower(trim(contentHash)), '^sha-?256:\\s*', ''), '') as h from fingerprints),
v as (select *, list_sort(list_distinct(list_transform(coalesce(functions, []), lambda x: (x.name, list_sort(x.params), x.returnType, x.exported, x.lineCount)::varchar))) as fns
      from f qualify row_number() over (partition by graphId, snapshot_no, filePath order by deliveredAt desc, fp_row desc) = 1),
s as (select graphId, snapshot_no, lag(snapshot_no) over (partition by graphId order by snapshot_no) as prev
      from (select distinct graphId, snapshot_no from v)),
o as (select s.graphId, s.snapshot_no, v.* exclude (graphId, snapshot_no) from s join v on v.graphId = s.graphId and v.snapshot_no = s.prev),
n as (select v.* from s join v using (graphId, snapshot_no) where s.prev is not null),
p6 as (select coalesce(n.graphId, o.graphId) as graphId, coalesce(n.snapshot_no, o.snapshot_no) as snapshot_no,
    coalesce(n.filePath, o.filePath) as filePath,
    case when o.fp_row is null then 'added' when n.fp_row is null then 'removed'
      when n.h is not null and o.h is not null then (case when n.h <> o.h then 'changed' end)
      when n.fns is distinct from o.fns then 'changed' end as change
  from n full join o on n.graphId = o.graphId and n.snapshot_no = o.snapshot_no and n.filePath = o.filePath)
"""

QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report, "p1_reasons": p1_reasons, "p6_found": p6_found, "p6_counts": p6_counts,
}
ORACLE = {
    "p1_found": _P1 + "select ref_table, row_id, node_ref, state from p1",
    "p1_report": _P1 + "select ref_table, strftime(moment, '%Y-%m') as month, state, count(*) as n_refs, count(distinct graphId) as n_graphs from p1 group by 1, 2, 3",
    "p1_reasons": _P1
    + """select d.drop_row, d.reason as logged, case when s.row_id is not null and t.row_id is not null then 'missing-both'
      when s.row_id is not null then 'missing-source' when t.row_id is not null then 'missing-target' else 'not-dangling' end as actual
      from dropped_edges d
      left join p1 s on s.ref_table = 'dropped_edges' and s.row_id = d.drop_row and s.node_ref = d.source
      left join p1 t on t.ref_table = 'dropped_edges' and t.row_id = d.drop_row and t.node_ref = d.target""",
    "p6_found": _P6 + "select graphId, snapshot_no, filePath, change from p6 where change is not null",
    "p6_counts": _P6 + "select graphId, snapshot_no, change, count(*) as n_files from p6 where change is not null group by 1, 2, 3",
}
