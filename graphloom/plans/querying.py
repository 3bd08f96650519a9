"""Queries of traversal, search and interval joins, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.operators import intervals, search, traverse
from graphloom.plans.base import BASE, Graphs
from graphloom.session import table


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """All TypeScript files, which stand for what is changed in a working tree."""
    f = table(spark, d, "source_files").where("path like '%.ts'").select("graphId", F.col("path").alias("filePath"))
    return f.distinct()


def r2_impact(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return traverse.diff_impact(g.nodes, g.edges, _changed(spark, d))


def r3_risk(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    files = _changed(spark, d)
    return traverse.risk(traverse.diff_impact(g.nodes, g.edges, files), g.nodes, g.members, traverse.unmapped_files(g.nodes, files))


def j3_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return traverse.unmapped_files(Graphs(spark, d).nodes, table(spark, d, "fingerprints").select("graphId", "filePath").distinct())


def r4_explain(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return traverse.explain(g.nodes, g.edges, g.members, g.nodes.where("type = 'file'"))


def j7_symbols(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").where("type in ('function', 'class') and filePath is not null").select("graphId", "filePath", F.concat(F.lit("Outer."), F.col("name")).alias("symbol")).distinct()
    return traverse.find_symbol(Graphs(spark, d).nodes, n)


def r6_distance(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    first = g.nodes.where("type = 'file'").groupBy("graphId").agg(F.min_by("id", "node_ord").alias("id"))
    return traverse.distances(g.edges, first, directed=False)


def r7_depths(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    first = g.nodes.where("type = 'file'").groupBy("graphId").agg(F.min_by("id", "node_ord").alias("id"))
    return traverse.distances(g.edges.where("type in ('imports', 'calls', 'contains')"), first)


def r8_levels(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return traverse.topological_levels(g.nodes, g.edges.where("type = 'contains'"))


def r14_components(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    c = traverse.components(g.nodes, g.edges.where("type in ('contains', 'documents')"))
    return c.groupBy("graphId", "component").agg(F.count("*").alias("n"))


def r13_batches(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return traverse.split_batches(traverse.communities(g.nodes.where("type = 'file'"), g.edges.where("type = 'imports'")))


def w3_chunks(spark: SparkSession, d: str) -> DataFrame:
    return traverse.chunks(Graphs(spark, d).nodes.select("graphId", "id", "node_ord"), ["graphId"], ["node_ord"], 12)


def z1_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(Graphs(spark, d).searched, "query tunnel", 50)


def r1_context(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    hits = search.search(g.searched, "cursor", 15)
    near = traverse.neighbours(g.edges, hits)
    return near.join(g.nodes.select("graphId", "id", "type"), ["graphId", "id"])


def z1_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Misspelled words, files and functions only."""
    return search.search(Graphs(spark, d).searched, "harbr registri", 20, ["file", "function"])


def z3_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.nearest(e.where("vec_id % 20 = 0"), e)


def z2_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector with the next one."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(search.cosine(F.col("embedding"), F.col("next")), 5).alias("similarity"))


def z5_concepts(spark: SparkSession, d: str) -> DataFrame:
    return search.concepts(Graphs(spark, d).nodes).groupBy("graphId", "concept").agg(F.count("*").alias("n"))


def j15_next_purchase(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    out = intervals.asof_next(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.col("event_id").alias("purchase_id")), ["user_id"], "ts", "bought_at", ["purchase_id"])
    return out.select("event_id", "user_id", "next_purchase_id")


def j16_innermost(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").where("lineRange is not null and size(lineRange) = 2 and filePath is not null")
    r = n.where("lower(type) in ('class', 'function')").select("graphId", "filePath", F.col("lineRange")[0].alias("start"), F.col("lineRange")[1].alias("stop"), F.col("node_row").alias("range_id"))
    p = n.select("graphId", "filePath", F.col("lineRange")[0].alias("line")).distinct()
    return intervals.innermost(p, r, ["graphId", "filePath"], "line").groupBy("graphId").agg(F.count("*").alias("n_points"), F.sum("range_id").alias("check_sum"))


def j10_nearest_config(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select("graphId", "path").distinct()
    folders = f.where("path like '%.json' or path like '%.yaml'").select("graphId", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("folder")).distinct()
    return intervals.nearest_ancestor(f, folders, ["graphId"])


def j12_suffix(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select("graphId", "path").distinct()
    refs = f.select("graphId", F.element_at(F.split("path", "/"), -1).alias("ref")).distinct()
    return intervals.by_suffix(refs, f, ["graphId"])


QUERIES = {
    f.__name__: f
    for f in (
        r2_impact, r3_risk, j3_unmapped, r4_explain, j7_symbols, r6_distance, r7_depths, r8_levels, r14_components, r13_batches, w3_chunks, z1_search, z1_fuzzy, r1_context, z2_similarity, z3_nearest, z5_concepts,
        j15_next_purchase, j16_innermost, j10_nearest_config, j12_suffix,
    )
}

_B = BASE.rstrip()
_BR = BASE.replace("with na(k, v)", "with recursive na(k, v)", 1).rstrip()
_NEAR = "list_min(list_transform(list_distinct(string_split_regex(lower({c}), '[^a-z0-9]+')), lambda w: least(levenshtein('{t}', left(w, {n})), levenshtein('{t}', left(w, {n} + 1)))))"
_MISS = "case when lower({c}) = '{t}' then 0.0 when starts_with(lower({c}), '{t}') then 0.1 when contains(lower({c}), '{t}') then 0.3 when " + _NEAR + " <= {m} then 0.3 + " + _NEAR + " / {n}.0 else 1.0 end"


def _score(t: str) -> str:
    m = lambda c: _MISS.format(c=c, t=t, n=len(t), m=len(t) * 2 // 5)
    tags = "coalesce(list_aggregate(list_transform(tags, lambda t: coalesce(t, '')), 'string_agg', ' '), '')"
    return f"(0.4 * {m('coalesce(name, ' + repr('') + ')')} + 0.3 * {m(tags)} + 0.2 * {m('coalesce(summary, ' + repr('') + ')')} + 0.1 * {m('coalesce(languageNotes, ' + repr('') + ')')})"


def _search(tokens: list[str], k: int, only: str = "") -> str:
    s = f"least({', '.join(map(_score, tokens))}, 1.0)"
    return f"(select graphId, id, score, place from (select *, row_number() over (partition by graphId order by score, node_ord) as place from (select graphId, id, node_ord, round({s}::double, 6) as score from n{only}) where score < 1) where place <= {k})"


_CH = ", ch as (select distinct graphId, path as filePath from source_files where path like '%.ts')"
_IMP = _CH + """, st as (select n.graphId, n.id, -1::bigint as ats from n join ch using (graphId, filePath)),
  gr as (select graphId, id, ats from st union select g.graphId, e.target, e.edge_ord from gr g join e on e.graphId = g.graphId and e.source = g.id and e.type = 'contains' and e.edge_ord > g.ats),
  cg as (select distinct graphId, id from gr), im as (select graphId, id, 'changed' as role from cg union all select graphId, id, 'affected' from (
  select e.graphId, e.target as id from e join cg on cg.graphId = e.graphId and cg.id = e.source union select e.graphId, e.source from e join cg on cg.graphId = e.graphId and cg.id = e.target) x
  where not exists (select 1 from cg where cg.graphId = x.graphId and cg.id = x.id))"""
_FLS = ", fl as (select graphId, id, arg_min(layer_id, (layer_ord, pos)) as layer_id from lm group by 1, 2)"
_BFS = """, s0 as (select graphId, arg_min(id, node_ord) as id from n where type = 'file' group by 1), ee as materialized ({edges}),
  bf as (select graphId, id, 0 as depth from s0 union select b.graphId, ee.b, b.depth + 1 from bf b join ee on ee.graphId = b.graphId and ee.a = b.id where b.depth < {most})
  select graphId, id, min(depth) as depth from bf group by 1, 2"""
_TXT = "lower(coalesce(list_aggregate(list_transform(tags, lambda t: coalesce(t, '')), 'string_agg', ' '), '') || ' ' || coalesce(summary, ''))"
_CON = " union all ".join("select graphId, {!r} as concept from tx where {}".format(c, " or ".join("contains(t, '" + w.lower().replace("'", "''") + "')" for w in ws)) for c, ws in S.CONCEPTS.items())
ORACLE = {
    "r2_impact": _BR + _IMP + " select * from im",
    "r3_risk": _BR + _IMP + _FLS + """ select graphId, n_complex, n_layers, n_affected, n_unmapped, coalesce(nullif(concat_ws(',', case when n_complex > 0 then 'complex' end, case when n_layers > 1 then 'layers' end, case when n_affected > 5 then 'wide' end, case when n_unmapped > 0 then 'unmapped' end), ''), 'low') as risks
      from (select im.graphId, count(*) filter (role = 'changed' and complexity = 'complex') as n_complex, count(distinct fl.layer_id) as n_layers, count(*) filter (role = 'affected') as n_affected,
      (select count(*) from ch where ch.graphId = im.graphId and not exists (select 1 from n m where m.graphId = ch.graphId and m.filePath = ch.filePath)) as n_unmapped from im join n using (graphId, id) left join fl using (graphId, id) group by im.graphId)""",
    "j3_unmapped": _B + ", ch as (select distinct graphId, filePath from fingerprints) select graphId, filePath from ch where not exists (select 1 from n where n.graphId = ch.graphId and n.filePath = ch.filePath)",
    "r4_explain": _B + _FLS + " select n.graphId, n.id, coalesce(o.a, 0) as n_children, coalesce(o.b, 0) as n_out, coalesce(i.c, 0) as n_in, fl.layer_id from n left join (select graphId, source as id, count(*) filter (type = 'contains') as a, count(*) filter (type <> 'contains') as b from e group by 1, 2) o using (graphId, id) left join (select graphId, target as id, count(*) as c from e group by 1, 2) i using (graphId, id) left join fl using (graphId, id) where n.type = 'file'",
    "j7_symbols": _B + ", w as (select distinct graphId, filePath, 'Outer.' || name as symbol from nodes where type in ('function', 'class') and filePath is not null), c as (select w.*, n.id, node_ord, case when n.name = symbol then 0 when split_part(symbol, '.', -1) = n.name then 1 when n.type = 'file' then 2 end as tier from w join n using (graphId, filePath)) select graphId, filePath, symbol, arg_min(id, (tier, node_ord)) as id, min(tier) as tier from c where tier is not null group by 1, 2, 3",
    "w3_chunks": BASE + "select graphId, id, node_ord, ((row_number() over (partition by graphId order by node_ord) - 1) // 12)::int as chunk from n",
    "z1_search": BASE + "select * from " + _search(["query", "tunnel"], 50),
    "z1_fuzzy": BASE + "select * from " + _search(["harbr", "registri"], 20, " where type in ('file', 'function')"),
    "r1_context": _B + ", h as " + _search(["cursor"], 15) + " select x.graphId, x.id, n.type from (select graphId, id from h union select e.graphId, e.target from e join h on h.graphId = e.graphId and h.id = e.source union select e.graphId, e.source from e join h on h.graphId = e.graphId and h.id = e.target) x join n using (graphId, id)",
    "z3_nearest": "select query, vec_id, round(1 - s, 5) + 0.0 as score, place from (select *, row_number() over (partition by query order by s desc, vec_id) as place from (select q.vec_id as query, e.vec_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 12) as s from embeddings q join embeddings e on q.vec_id % 20 = 0 and q.vec_id <> e.vec_id)) where place <= 10",
    "z2_similarity": "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "z5_concepts": _B + f", tx as (select graphId, {_TXT} as t from n) select graphId, concept, count(*) as n from ({_CON}) group by 1, 2",
    "j15_next_purchase": "select v.event_id, v.user_id, arg_min(p.event_id, (p.ts, p.event_id)) as next_purchase_id from events v left join events p on p.user_id = v.user_id and p.event_type = 'purchase' and p.ts >= v.ts where v.event_type = 'view' group by 1, 2",
    "j16_innermost": "with q as (select * from nodes where len(lineRange) = 2 and filePath is not null), p as (select distinct graphId, filePath, lineRange[1] as line from q), m as (select p.graphId, p.filePath, p.line, arg_max(node_row, (lineRange[1], -lineRange[2], -node_row)) as r from p join q using (graphId, filePath) where lower(q.type) in ('class', 'function') and line between lineRange[1] and lineRange[2] group by 1, 2, 3) select graphId, count(*) as n_points, sum(r)::bigint as check_sum from m group by 1",
    "j10_nearest_config": "with f as (select distinct graphId, path from source_files), c as (select distinct graphId, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as folder from f where path like '%.json' or path like '%.yaml') select f.graphId, f.path, arg_max(folder, length(folder)) as folder from f join c on c.graphId = f.graphId and (c.folder = '' or starts_with(f.path, c.folder || '/')) group by 1, 2",
    "j12_suffix": "with f as (select distinct graphId, path from source_files), r as (select distinct graphId, split_part(path, '/', -1) as ref from f) select r.graphId, r.ref, count(*) as n_matches, case when count(*) = 1 then min(path) end as path from r join f on f.graphId = r.graphId and (f.path = r.ref or ends_with(f.path, '/' || r.ref)) group by 1, 2",
    "r8_levels": _BR + ", lv0 as (select graphId, id, 0 as level from n union select l.graphId, e.target, l.level + 1 from lv0 l join e on e.graphId = l.graphId and e.source = l.id and e.source <> e.target and e.type = 'contains' where l.level < 30), mx as (select graphId, id, max(level) as level from lv0 group by 1, 2) select graphId, id, case when level >= 30 then -1 else level end as level from mx",
    "r7_depths": _BR + _BFS.format(edges="select distinct graphId, source as a, target as b from e where type in ('imports', 'calls', 'contains') and source <> target", most=40),
    "r6_distance": _BR + _BFS.format(edges="select distinct graphId, source as a, target as b from e where source <> target union select distinct graphId, target, source from e where source <> target", most=25),
    "r14_components": _BR + ", ee as materialized (select distinct graphId, source as a, target as b from e where type in ('contains', 'documents') and source <> target union select distinct graphId, target, source from e where type in ('contains', 'documents') and source <> target), cc as (select graphId, id, id as c from n union select x.graphId, ee.b, x.c from cc x join ee on ee.graphId = x.graphId and ee.a = x.id where x.c < ee.b), mn as (select graphId, id, min(c) as component from cc group by 1, 2) select graphId, component, count(*) as n from mn group by 1, 2",
}
