"""Queries of what is written out, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import emitting as E
from graphloom.operators import incremental, traverse
from graphloom.plans.base import BASE, Graphs
from graphloom.plans.claims import _KEY, _V, _consensus
from graphloom.plans.querying import _BR, _IMP, _changed, r3_risk
from graphloom.session import table


def q12_claim_edges(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of edges as claims about their targets."""
    e = table(spark, d, "edges").where("target is not null and length(trim(description)) > 0").select("graphId", F.col("target").alias("ref"), F.col("description").alias("text"), F.coalesce(F.nanvl("weight", F.lit(0.5)), F.lit(0.5)).alias("weight"), F.col("edge_row").alias("ord"))
    return E.claim_edges(e, Graphs(spark, d).nodes)


def b14_principles(spark: SparkSession, d: str) -> DataFrame:
    return E.principle_nodes(table(spark, d, "nodes").where("op = 'upsert'"))


def o11_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").where("source is not null and target is not null and type is not null")
    v = e.select(*_KEY, "edge_row", F.nullif(F.nanvl("weight", F.lit(-1.0)), F.lit(-1.0)).alias("weight"))
    return E.ranked_evidence(v.withColumn("verified", F.col("weight").isNotNull()), _KEY)


def s31_report(spark: SparkSession, d: str) -> DataFrame:
    return E.verdict_report(_consensus(spark, d))


def s28_diff(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return E.diff_text(traverse.diff_impact(g.nodes, g.edges, _changed(spark, d)), g.nodes, r3_risk(spark, d))


def i8_baseline(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").where("op = 'upsert' and id is not null").select("graphId", "id", "name", "batch_ord", "node_row")
    return E.with_baseline(n)


def r9_chunks(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return E.chunk_tour(g.nodes, g.edges.where("type = 'contains'"))


def j8_links(spark: SparkSession, d: str) -> DataFrame:
    """Links in the last delivery of each article's text, by the names of articles."""
    a = table(spark, d, "nodes").where("op = 'upsert' and lower(type) = 'article' and id is not null").groupBy("graphId", "id").agg(F.max_by(F.struct("name", F.col("knowledgeMeta.content").alias("content")), "node_row").alias("v"))
    return E.article_links(a.select("graphId", "id", "v.name", "v.content"))


def n6_issues(spark: SparkSession, d: str) -> DataFrame:
    return E.issues(table(spark, d, "nodes"))


def g35_rollup(spark: SparkSession, d: str) -> DataFrame:
    return E.rolled_up(incremental.freshness(table(spark, d, "fingerprints"), table(spark, d, "graphs")))


def f11_changed(spark: SparkSession, d: str) -> DataFrame:
    """Files of the last batch of each graph, with the batch they are in."""
    n = table(spark, d, "nodes").where("lower(type) = 'file' and filePath is not null and op = 'upsert'").select("graphId", F.regexp_replace("filePath", r"^\./", "").alias("path"), "batch_ord")
    last = n.groupBy("graphId").agg(F.max("batch_ord").alias("batch_ord"))
    changed = n.join(last, ["graphId", "batch_ord"], "left_semi").select("graphId", "path").distinct()
    return n.join(changed, ["graphId", "path"], "left_semi").groupBy("graphId", "path").agg(F.min("batch_ord").alias("first"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (q12_claim_edges, b14_principles, o11_evidence, s31_report, s28_diff, i8_baseline, r9_chunks, j8_links, n6_issues, g35_rollup, f11_changed)}

_B = BASE.rstrip()
_SLUG = "regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_PART = "coalesce(string_agg(line, chr(10) order by line) filter (r <= 50), '') || case when max(a) > 50 then chr(10) || '- and ' || (max(a) - 50) || ' more' else '' end"
_LV = ", lv0 as (select graphId, id, 0 as level from n union select l.graphId, e.target, l.level + 1 from lv0 l join e on e.graphId = l.graphId and e.source = l.id and e.source <> e.target and e.type = 'contains' where l.level < 30), lv as (select graphId, id, case when max(level) >= 30 then -1 else max(level) end as level from lv0 group by 1, 2)"
ORACLE = {
    "q12_claim_edges": _B + """, c as (select graphId, target as ref, description as text, case when weight is null or isnan(weight) then 0.5 else weight end as weight, edge_row as ord, split_part(target, ':', 2) as p, split_part(split_part(target, ':', 3), '.', 1) as k, len(string_split(target, ':')) as m from edges where target is not null and length(trim(description)) > 0),
      h as (select c.*, coalesce(a.id, b.id, f.id) as node, case when a.id is not null then 1.0 when b.id is not null then 0.8 else 0.6 end as part from c left join n a on a.graphId = c.graphId and a.id = c.ref left join n b on m > 2 and b.graphId = c.graphId and b.id = 'class:' || p || ':' || k left join n f on m > 1 and f.graphId = c.graphId and f.id = 'file:' || p)
      select graphId, 'claim:' || substr(sha256(ref || ':' || lower(trim(text))), 1, 12) as source, node as target, 'documents' as type, max(round((weight * part)::double, 6)) as weight, arg_max(text, (length(text), -ord)) as description, count(*) as agreed_by from h where node is not null group by 1, 2, 3""",
    "b14_principles": f"select graphId, 'principle:' || slug as id, arg_min(name, node_row) as name, count(*) as n_evidence from (select graphId, {_SLUG} as slug, name, node_row from nodes where op = 'upsert' and name is not null) where slug <> '' group by graphId, slug having count(*) >= 2",
    "o11_evidence": "with v as (select graphId, source, target, type, edge_row, case when isnan(weight) then null else weight end as w from edges where source is not null and target is not null and type is not null) select * from (select graphId, source, target, type, row_number() over (partition by graphId, source, target, type order by w is not null desc, w desc nulls last, edge_row) as place, edge_row from v) where place <= 3",
    "s31_report": f"with {_V}, c as (select graphId, coalesce(verdict, 'none') as verdict, agreement, count(*) as n from cs group by 1, 2, 3) select graphId, '| verdict | agreement | n |' || chr(10) || '|-|-|-|' || chr(10) || string_agg('| ' || verdict || ' | ' || agreement || ' | ' || n || ' |', chr(10) order by verdict, agreement) as report from c group by 1",
    "s28_diff": _BR + _IMP + """, rk as (select graphId, coalesce(nullif(concat_ws(',', case when count(*) filter (role = 'changed' and complexity = 'complex') > 0 then 'complex' end, case when count(distinct fl.layer_id) > 1 then 'layers' end, case when count(*) filter (role = 'affected') > 5 then 'wide' end, case when (select count(*) from ch where ch.graphId = q.graphId and not exists (select 1 from n m where m.graphId = ch.graphId and m.filePath = ch.filePath)) > 0 then 'unmapped' end), ''), 'low') as risks
      from (select im.*, n.complexity from im join n using (graphId, id)) q left join (select graphId, id, arg_min(layer_id, (layer_ord, pos)) as layer_id from lm group by 1, 2) fl using (graphId, id) group by graphId),
      ln as (select im.graphId, role, '- ' || n.type || ' ' || id as line from im join n using (graphId, id)), rn as (select *, row_number() over (partition by graphId, role order by line) as r, count(*) over (partition by graphId, role) as a from ln), pt as (select graphId, role, """ + _PART + """ as t from rn group by 1, 2),
      bt as (select graphId, max(t) filter (role = 'changed') as c, max(t) filter (role = 'affected') as f from pt group by 1) select bt.graphId, 'Risk: ' || coalesce(risks, 'low') || chr(10) || '## Changed' || chr(10) || coalesce(c, '') || chr(10) || '## Affected' || chr(10) || coalesce(f, '') || chr(10) as text from bt left join rk using (graphId)""",
    "i8_baseline": "with l as (select graphId, max(batch_ord) as last from nodes where op = 'upsert' and id is not null group by 1) select n.graphId, n.id, arg_max(name, node_row) as name, arg_max(case when batch_ord < last then -1 else batch_ord end, node_row) as batch_ord, min(node_row) as node_row from nodes n join l using (graphId) where op = 'upsert' and id is not null group by 1, 2",
    "r9_chunks": _BR + _LV + " select graphId, ((row_number() over (partition by graphId order by case when level < 0 then 1 << 30 else level end, node_ord) - 1) // 3)::int as step, id from n join lv using (graphId, id)",
    "j8_links": """with a as (select graphId, id, arg_max(struct_pack(name := name, content := knowledgeMeta.content), node_row) as v from nodes where op = 'upsert' and lower(type) = 'article' and id is not null group by 1, 2), ar as (select graphId, id, v.name as name, v.content as content from a),
      l as (select distinct graphId, id, lower(trim(x)) as want from (select graphId, id, unnest(regexp_extract_all(content, '\\[\\[([^\\[\\]|\\n]+)(?:\\|[^\\[\\]\\n]*)?\\]\\]', 1)) as x from ar) where trim(x) <> ''), nm as (select graphId, lower(trim(name)) as name, id as target from ar where name is not null),
      h as (select l.graphId, l.id, l.want, min(target) filter (nm.name = want) as ex, count(distinct target) filter (nm.name = want) as kx, min(target) as tl, count(distinct target) as kt from l join nm on nm.graphId = l.graphId and (nm.name = want or ends_with(nm.name, ' ' || want)) group by 1, 2, 3), r as (select graphId, id, case when kx = 1 then ex when kt = 1 then tl end as target, case when kx = 1 then 'name' else 'tail' end as how from h)
      select distinct * from r where target is not null and target <> id""",
    "n6_issues": """with r as (select graphId, node_row, unnest([case when trim(coalesce(id, '')) = '' then (0, 'dropped', 'no id') end, case when trim(coalesce(name, '')) = '' then (0, 'dropped', 'no name') end, case when trim(coalesce(type, '')) = '' then (1, 'auto-corrected', 'no type') end, case when trim(coalesce(complexity, '')) = '' then (1, 'auto-corrected', 'no complexity') end, case when trim(coalesce(summary, '')) = '' then (1, 'auto-corrected', 'no summary') end, case when tags is null then (1, 'auto-corrected', 'no tags') end]) as x from nodes where op = 'upsert')
      select graphId, row_number() over (partition by graphId order by x[1], node_row, x[3]) - 1 as ord, x[2] as level, x[3] as issue, node_row from r where x is not null""",
    "f11_changed": "with n as (select graphId, regexp_replace(filePath, '^\\./', '') as path, batch_ord from nodes where lower(type) = 'file' and filePath is not null and op = 'upsert'), l as (select graphId, max(batch_ord) as b from n group by 1), c as (select distinct n.graphId, path from n join l on l.graphId = n.graphId and l.b = n.batch_ord) select n.graphId, n.path, min(batch_ord) as first, count(*) as n from n join c on c.graphId = n.graphId and c.path = n.path group by 1, 2",
    "g35_rollup": "with h as (select graphId, arg_max(gitCommitHash, (snapshot_no, generatedAt)) as head, list(distinct gitCommitHash) as known from fingerprints group by 1), s as (select case when head is null then 'unknown' when g.gitCommitHash = head then 'fresh' when list_contains(known, g.gitCommitHash) then 'stale' else 'unknown' end as status from graphs g left join h using (graphId)) select arg_max(status, case status when 'stale' then 2 when 'unknown' then 1 else 0 end) as status, count(*) filter (status = 'stale') as n_stale, count(*) filter (status = 'unknown') as n_unknown, count(*) filter (status = 'fresh') as n_fresh from s",
}
