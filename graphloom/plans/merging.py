"""Queries of whole-graph merges, recovery and integrity, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import with_repaired_id
from graphloom.operators import merging as M
from graphloom.operators.incremental import merge_update
from graphloom.plans.base import BASE, Graphs
from graphloom.plans.integrity import repaired
from graphloom.session import table


def _subdomains(spark: SparkSession, d: str):
    n = table(spark, d, "nodes").where("op = 'upsert'").select("graphId", "id", "type", "node_row")
    e = table(spark, d, "edges").where("source is not null and target is not null").select("graphId", "source", "target", "type", "weight", "edge_row")
    return n, e, *M.merge_subdomains(n, e, ("contains", "related"))


def r25_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _subdomains(spark, d)[2]


def r25_edges(spark: SparkSession, d: str) -> DataFrame:
    return _subdomains(spark, d)[3].withColumn("weight", F.round("weight", 6))


def i9_pending(spark: SparkSession, d: str) -> DataFrame:
    """Edges that a first run over the earlier half of the batches drops, and that a second run over all nodes resolves."""
    n = table(spark, d, "nodes").where("op = 'upsert' and id is not null").select("graphId", "id", "node_row", "batch_ord")
    e = table(spark, d, "edges").where("source is not null and target is not null").select("graphId", "source", "target", "type", "weight", "edge_row", "batch_ord")
    early = M.merge_subdomains(n.where("batch_ord <= 2").drop("batch_ord"), e.where("batch_ord <= 2").drop("batch_ord"), ("contains", "calls"))[2].where("retry").select("graphId", "source", "target", "type", "weight", "edge_row")
    return M.merge_subdomains(n.drop("batch_ord"), early, ())[1].select("graphId", "edge_row")


def r24_report(spark: SparkSession, d: str) -> DataFrame:
    n, e, kn, ke, dr = _subdomains(spark, d)
    return M.merge_report(n, e, kn, ke, dr)


def r26_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").where("op = 'upsert'")
    return M.merge_knowledge(n, table(spark, d, "edges"))[0]


def r26_edges(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge merge with configurations taken as entities, so that names repeat."""
    n = table(spark, d, "nodes").where("op = 'upsert'").withColumn("type", F.when(F.lower("type") == "config", "entity").otherwise(F.col("type")))
    return M.merge_knowledge(n, table(spark, d, "edges"))[1].select("edge_row", "source", "target", "type")


def j3_other_layer(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return M.with_other_layer(g.nodes, g.members).groupBy("graphId", "layer_id").agg(F.count("*").alias("n"))


def j14_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Configurations and documents without a link, placed by the words of their names below the articles that hold them."""
    g = Graphs(spark, d)
    touched = g.edges.where("type in ('documents', 'related')").select("graphId", F.explode(F.array("source", "target")).alias("id")).distinct()
    orphans = g.nodes.where("type = 'document' or type = 'config'").join(touched, ["graphId", "id"], "left_anti")
    return M.place_orphans(orphans.select("graphId", "id"), g.nodes.where("type <> 'config' and type <> 'document'").select("graphId", "id"))


def g26_tours(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of layers taken as steps of a tour; those of one name are one step."""
    s = table(spark, d, "layers").where("name is not null").select("graphId", F.col("layer_row").alias("ord"), F.col("name").alias("title"), "description", F.filter(F.coalesce("nodeIds", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("nodeIds"))
    return M.merge_tours(s)


def j3_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Logged drops of import edges against the graph as it is now."""
    g = Graphs(spark, d)
    imports = table(spark, d, "dropped_edges").where("lower(type) = 'imports' and source is not null and target is not null").select("graphId", "source", "target")
    return M.recover_imports(imports, g.edges, g.nodes)


def j3_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Files of the nodes against the files delivered."""
    g = Graphs(spark, d)
    files = g.nodes.where("type = 'file' and filePath is not null").select("graphId", F.col("filePath").alias("path"))
    return M.integrity(table(spark, d, "source_files").select("graphId", "path").distinct(), files, ["graphId", "path"])


def g36_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return M.batch_outcomes(table(spark, d, "nodes"), table(spark, d, "edges"))


def g17_sums(spark: SparkSession, d: str) -> DataFrame:
    o = M.batch_outcomes(table(spark, d, "nodes"), table(spark, d, "edges"))
    return o.groupBy("graphId").agg(F.count("*").alias("n_batches"), *[F.sum(c).alias(c) for c in ("n_nodes", "n_invalid", "n_deletes", "n_edges", "n_blank")], F.count_if("empty").alias("n_empty"))


def i7_appended(spark: SparkSession, d: str) -> DataFrame:
    """The graph of the batches before the last one, updated by the files of the last batch: rows removed, then appended."""
    n = with_repaired_id(table(spark, d, "nodes").where("op = 'upsert' and trim(coalesce(id, '')) <> ''"), "rid").select("graphId", F.col("rid").alias("id"), "filePath", "batch_ord", "node_row")
    e = Graphs(spark, d).edges.select("graphId", "source", "target", "type", "edge_ord")
    last = n.groupBy("graphId").agg(F.max("batch_ord").alias("last"))
    n = n.join(last, "graphId")
    new = n.where("batch_ord = last and filePath is not null")
    changed = new.select("graphId", "filePath").distinct()
    nodes, edges = merge_update(n.where("batch_ord < last").drop("batch_ord", "last"), e, changed, new.drop("batch_ord", "last"), e.limit(0))
    a = nodes.groupBy("graphId").agg(F.lit("nodes").alias("what"), F.count("*").alias("n"), F.sum("node_row").alias("check_sum"))
    return a.union(edges.groupBy("graphId").agg(F.lit("edges"), F.count("*"), F.sum("edge_ord")))


QUERIES = {f.__name__: f for f in (r25_nodes, r25_edges, i9_pending, r24_report, r26_nodes, r26_edges, j3_other_layer, j14_orphans, g26_tours, j3_recovered, j3_integrity, g36_outcomes, g17_sums, i7_appended)}

_B = BASE.rstrip()
_SUB = """sn as (select graphId, id, type, node_row from nodes where op = 'upsert' and coalesce(id, '') <> '' qualify row_number() over (partition by graphId, id order by node_row desc) = 1),
 se0 as (select graphId, source, target, type, case when weight is null or isnan(weight) then 0.0 else weight end as weight, edge_row from edges where source is not null and target is not null),
 se as (select * from se0 qualify row_number() over (partition by graphId, source, target, type order by weight desc, edge_row) = 1),
 sj as (select se.*, a.id is not null as s_ok, b.id is not null as t_ok from se left join sn a on a.graphId = se.graphId and a.id = se.source left join sn b on b.graphId = se.graphId and b.id = se.target)"""
_KT = lambda t: f"case when {t} in ('note', 'page', 'wiki_page') then 'article' else {t} end"
_OUT = """oc as (select coalesce(a.graphId, b.graphId) as graphId, coalesce(a.batch_ord, b.batch_ord) as batch_ord, coalesce(n_nodes, 0) as n_nodes, coalesce(n_invalid, 0) as n_invalid, coalesce(n_deletes, 0) as n_deletes, coalesce(n_edges, 0) as n_edges, coalesce(n_blank, 0) as n_blank from
 (select graphId, batch_ord, count(*) filter (trim(coalesce(id, '')) <> '' and op <> 'delete') as n_nodes, count(*) filter (trim(coalesce(id, '')) = '') as n_invalid, count(*) filter (trim(coalesce(id, '')) <> '' and op = 'delete') as n_deletes from nodes group by 1, 2) a
 full join (select graphId, batch_ord, count(*) as n_edges, count(*) filter (trim(coalesce(source, '')) = '' or trim(coalesce(target, '')) = '') as n_blank from edges group by 1, 2) b on a.graphId = b.graphId and a.batch_ord = b.batch_ord),
 o2 as (select *, n_nodes = 0 and n_edges = n_blank as empty from oc)"""
ORACLE = {
    "r25_nodes": f"with {_SUB} select * from sn",
    "r25_edges": f"with {_SUB} select graphId, source, target, type, round(weight, 6)::double as weight, edge_row from sj where s_ok and t_ok",
    "i9_pending": """with n1 as (select distinct graphId, id from nodes where op = 'upsert' and coalesce(id, '') <> '' and batch_ord <= 2), na as (select distinct graphId, id from nodes where op = 'upsert' and coalesce(id, '') <> ''),
      e0 as (select graphId, source, target, type, case when weight is null or isnan(weight) then 0.0 else weight end as w, edge_row from edges where source is not null and target is not null and batch_ord <= 2), e as (select * from e0 qualify row_number() over (partition by graphId, source, target, type order by w desc, edge_row) = 1)
      select e.graphId, e.edge_row from e where type in ('contains', 'calls') and not ((graphId, source) in (select (graphId, id) from n1) and (graphId, target) in (select (graphId, id) from n1)) and (graphId, source) in (select (graphId, id) from na) and (graphId, target) in (select (graphId, id) from na)""",
    "r24_report": f"with {_SUB}, un as (select graphId from nodes where op = 'upsert') select graphId, 'input nodes' as item, count(*) as n from un group by 1 union all select graphId, 'input edges', count(*) from se0 group by 1 union all select graphId, 'output nodes', count(*) from sn group by 1 union all select graphId, 'output edges', count(*) from sj where s_ok and t_ok group by 1 union all select graphId, 'dropped edges', count(*) from sj where not (s_ok and t_ok) group by 1 union all select graphId, 'pending edges', count(*) from sj where not (s_ok and t_ok) and type in ('contains', 'related') group by 1",
    "r26_nodes": "select graphId, id, node_row, t as type from (select graphId, id, node_row, lower(trim(type)) as t from nodes where op = 'upsert' and id is not null) where t in ('article', 'entity', 'topic', 'claim', 'source', 'file', 'function', 'class', 'module', 'concept', 'config', 'document', 'service', 'table', 'endpoint', 'pipeline', 'schema', 'resource', 'domain', 'flow', 'step') qualify row_number() over (partition by graphId, id order by node_row desc) = 1",
    "r26_edges": """with n0 as (select graphId, id, node_row, case when lower(trim(type)) = 'config' then 'entity' else lower(trim(type)) end as type, regexp_replace(lower(trim(coalesce(name, ''))), '\\s+', ' ', 'g') as norm from nodes where op = 'upsert' and id is not null),
      k as (select * from n0 where type in ('article', 'entity', 'topic', 'claim', 'source', 'file', 'function', 'class', 'module', 'concept', 'document', 'service', 'table', 'endpoint', 'pipeline', 'schema', 'resource', 'domain', 'flow', 'step')),
      hd as (select graphId, norm, arg_min(id, node_row) as head from k where type = 'entity' group by 1, 2), rm as (select k.graphId, k.id, min(head) as head from k join hd using (graphId, norm) where k.type = 'entity' and k.id <> head group by 1, 2),
      kn as (select distinct graphId, head as id from hd union select graphId, id from k where type <> 'entity'),
      e as (select e.graphId, coalesce(a.head, source) as source, coalesce(b.head, target) as target, case when lower(trim(type)) in ('cites', 'contradicts', 'builds_on', 'exemplifies', 'categorized_under', 'authored_by', 'related', 'similar_to', 'imports', 'exports', 'contains', 'inherits', 'implements', 'calls', 'subscribes', 'publishes', 'middleware', 'reads_from', 'writes_to', 'transforms', 'validates', 'depends_on', 'tested_by', 'configures', 'deploys', 'serves', 'provisions', 'triggers', 'migrates', 'documents', 'routes', 'defines_schema', 'contains_flow', 'flow_step', 'cross_domain') then lower(trim(type)) else 'related' end as type, edge_row
        from edges e left join rm a on a.graphId = e.graphId and a.id = e.source left join rm b on b.graphId = e.graphId and b.id = e.target where source is not null and target is not null)
      select edge_row, source, target, type from e where (graphId, source) in (select (graphId, id) from kn) and (graphId, target) in (select (graphId, id) from kn) qualify row_number() over (partition by graphId, source, target, type order by edge_row) = 1""",
    "j3_other_layer": _B + ", fl as (select graphId, id, arg_min(layer_id, (layer_ord, pos)) as layer_id from lm group by 1, 2) select n.graphId, coalesce(fl.layer_id, 'layer:other') as layer_id, count(*) as n from n left join fl using (graphId, id) group by 1, 2",
    "j14_orphans": _B + """, th as (select distinct graphId, id from (select graphId, unnest([source, target]) as id from e where type in ('documents', 'related'))),
      wd as (select graphId, id, type, '-' || regexp_replace(lower(regexp_replace(list_last(string_split_regex(id, '[:/]')), '\\.[a-z]+$', '')), '[^a-z0-9]+', '-', 'g') || '-' as w from n),
      o as (select * from wd where type in ('document', 'config') and (graphId, id) not in (select (graphId, id) from th) and w <> '--') select o.graphId, o.id, min(a.id) as article from o join wd a on a.graphId = o.graphId and a.type not in ('document', 'config') and contains(a.w, o.w) group by 1, 2""",
    "g26_tours": """with s as (select graphId, layer_row as ord, name as title, description, nodeIds from layers where name is not null), h as (select graphId, title, min(ord) as at_, arg_max(description, (length(coalesce(description, '')), -ord)) as description from s group by 1, 2),
      x as (select graphId, title, ord, unnest(nodeIds) as id, generate_subscripts(nodeIds, 1) as pos from s), y as (select graphId, title, id, min((ord, pos)) as f from x where id is not null group by 1, 2, 3), l as (select graphId, title, count(*) as n_nodes, string_agg(id, '|' order by f) as nodes from y group by 1, 2)
      select h.graphId, row_number() over (partition by h.graphId order by at_) as step, h.title, h.description, coalesce(n_nodes, 0) as n_nodes, coalesce(nodes, '') as nodes from h left join l using (graphId, title)""",
    "j3_recovered": _B + ", im as (select distinct graphId, source, target from dropped_edges where lower(type) = 'imports' and source is not null and target is not null) select im.*, case when im.source = im.target then 'self' when a.id is null then 'no-source' when b.id is null then 'no-target' when exists (select 1 from e where e.type = 'imports' and e.graphId = im.graphId and e.source = im.source and e.target = im.target) then 'present' else 'recovered' end as outcome from im left join n a on a.graphId = im.graphId and a.id = im.source left join n b on b.graphId = im.graphId and b.id = im.target",
    "j3_integrity": _B + ", a as (select graphId, path, 1 as k from (select distinct graphId, path from source_files)), b as (select graphId, filePath as path, count(*) as k from n where type = 'file' and filePath is not null group by 1, 2) select * from (select coalesce(a.graphId, b.graphId) as graphId, coalesce(a.path, b.path) as path, coalesce(a.k, 0)::bigint as n_expected, coalesce(b.k, 0)::bigint as n_got, case when b.k is null then 'missing' when a.k is null then 'unexpected' when b.k > a.k then 'repeated' end as finding from a full join b on a.graphId = b.graphId and a.path = b.path) where finding is not null",
    "g36_outcomes": f"with {_OUT} select * from o2",
    "g17_sums": f"with {_OUT} select graphId, count(*) as n_batches, sum(n_nodes)::bigint as n_nodes, sum(n_invalid)::bigint as n_invalid, sum(n_deletes)::bigint as n_deletes, sum(n_edges)::bigint as n_edges, sum(n_blank)::bigint as n_blank, count(*) filter (empty) as n_empty from o2 group by 1",
    "i7_appended": _B + f", un as (select graphId, {repaired('id', 'type', 'filePath', 'name')} as id, filePath, batch_ord, node_row from nodes where op = 'upsert' and trim(coalesce(id, '')) <> ''), la as (select graphId, max(batch_ord) as last from un group by 1), u2 as (select * from un join la using (graphId)), chg as (select distinct graphId, filePath from u2 where batch_ord = last and filePath is not null), kp as (select * from u2 where batch_ord < last and (filePath is null or (graphId, filePath) not in (select (graphId, filePath) from chg))), gone as (select distinct graphId, id from u2 where batch_ord < last and filePath is not null and (graphId, filePath) in (select (graphId, filePath) from chg)), nn as (select graphId, node_row from kp union all select graphId, node_row from u2 where batch_ord = last and filePath is not null), oe as (select * from e where (graphId, source) not in (select (graphId, id) from gone) and (graphId, target) not in (select (graphId, id) from gone)) select graphId, 'nodes' as what, count(*) as n, sum(node_row)::bigint as check_sum from nn group by 1 union all select graphId, 'edges', count(*), sum(edge_ord)::bigint from oe group by 1",
}
