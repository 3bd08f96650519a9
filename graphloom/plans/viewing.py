"""Queries of filters, aggregates and groupings, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.operators import views as V
from graphloom.plans.base import BASE, Graphs
from graphloom.session import table

_LEVELS = ["simple", "moderate", "complex"]
_CATS = ["structural", "behavioral"]


def f1_filter_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.filter_nodes(g.nodes, g.members, ["file", "class", "config"], ["simple", "moderate"], []).select("graphId", "id")


def f1_layer_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.filter_nodes(g.nodes, g.members, ["file", "function", "class"], [], ["Anchor", "Ferry", "Harbor"]).select("graphId", "id")


def f2_filter_edges(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.filter_edges(g.edges, g.nodes.where("type in ('file', 'function')"), _CATS).select("graphId", "edge_ord")


def f5_focus(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.neighbours(g.edges, g.nodes.where("type = 'config'"))


def f13_self_edges(spark: SparkSession, d: str) -> DataFrame:
    return Graphs(spark, d).edges.groupBy((F.col("source") == F.col("target")).alias("self")).agg(F.count("*").alias("n"))


def g1_complexity(spark: SparkSession, d: str) -> DataFrame:
    return V.histogram(Graphs(spark, d).nodes, "complexity", _LEVELS)


def g2_degrees(spark: SparkSession, d: str) -> DataFrame:
    return V.degrees(Graphs(spark, d).edges)


def g3_overview(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.overview(g.nodes, g.edges)


def g4_edge_categories(spark: SparkSession, d: str) -> DataFrame:
    return Graphs(spark, d).edges.groupBy("graphId", F.coalesce(S.lookup(S.EDGE_CATEGORY, F.col("type")), F.lit("other")).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("avg_weight"))


def g5_layer_stats(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.layer_stats(g.nodes, g.members)


def g6_layer_edges(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.grouped_edges(g.edges, V.first_layer(g.members), "layer_id").where("from_group <> to_group")


def g7_folder_edges(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.grouped_edges(g.edges, V.folders(g.nodes), "folder")


def g8_portals(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.portals(V.grouped_edges(g.edges, V.first_layer(g.members), "layer_id"))


def g11_language_stats(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select("graphId", F.lower(F.trim("language")).alias("language"), "sizeBytes")
    return f.cube("graphId", "language").agg(F.count("*").alias("n_files"), F.sum("sizeBytes").alias("bytes"), F.grouping_id().cast("int").alias("margin"))


def g13_fan(spark: SparkSession, d: str) -> DataFrame:
    return V.fan(Graphs(spark, d).edges, ["imports", "calls"])


def g14_type_matrix(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.type_matrix(g.nodes, g.edges)


def g14_density(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.group_density(g.edges.where("type = 'imports'"), V.folders(g.nodes), "folder")


def g14_direction(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.dependency_direction(V.grouped_edges(g.edges.where("type = 'imports'"), V.folders(g.nodes), "folder"))


def g15_entry_points(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.entry_scores(g.nodes, g.edges)


def g16_line_distribution(spark: SparkSession, d: str) -> DataFrame:
    return V.distribution(table(spark, d, "fingerprints"), "graphId", "totalLines")


def j18_layer_index(spark: SparkSession, d: str) -> DataFrame:
    return V.first_layer(Graphs(spark, d).members)


def o2_hubs(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return V.hubs(g.nodes, g.edges)


def r10_layers(spark: SparkSession, d: str) -> DataFrame:
    return V.detect_layers(Graphs(spark, d).nodes)


def r15_folders(spark: SparkSession, d: str) -> DataFrame:
    return V.folders(Graphs(spark, d).nodes).groupBy("graphId", "folder").agg(F.count("*").alias("n"))


def r19_file_tree(spark: SparkSession, d: str) -> DataFrame:
    return V.file_tree(Graphs(spark, d).nodes)


def r31_node_size(spark: SparkSession, d: str) -> DataFrame:
    return V.node_size(Graphs(spark, d).edges)


QUERIES = {
    f.__name__: f
    for f in (
        f1_filter_nodes, f1_layer_nodes, f2_filter_edges, f5_focus, f13_self_edges, g1_complexity, g2_degrees, g3_overview, g4_edge_categories, g5_layer_stats, g6_layer_edges,
        g7_folder_edges, g8_portals, g11_language_stats, g13_fan, g14_type_matrix, g14_density, g14_direction, g15_entry_points, g16_line_distribution, j18_layer_index, o2_hubs, r10_layers, r15_folders, r19_file_tree, r31_node_size,
    )
}

_B = BASE.rstrip()
_FL = ", fl as (select graphId, id, arg_min(layer_id, (layer_ord, pos)) as layer_id, count(distinct layer_id) as n_layers from lm group by 1, 2)"
_LE = _FL + ", le as (select e.graphId, a.layer_id as from_group, b.layer_id as to_group, count(*) as n_edges, string_agg(distinct e.type, ',' order by e.type) as types from e join fl a on a.graphId = e.graphId and a.id = e.source join fl b on b.graphId = e.graphId and b.id = e.target group by 1, 2, 3)"
_FO = """, fp as (select graphId, id, string_split(filePath, '/') as parts from n where coalesce(filePath, '') <> ''),
  px as (select graphId, max(len(list_filter(range(0, len(a)), lambda i: a[1:i + 1] = b[1:i + 1])))::int as k, any_value(least(len(a), len(b)) - 1) as m from (select graphId, min(parts) as a, max(parts) as b from fp group by 1) group by 1),
  fo as (select fp.graphId, id, case when len(parts) - 1 > least(k, m) then parts[least(k, m) + 1] else '~' end as folder from fp join px using (graphId)),
  fe as (select e.graphId, a.folder as from_group, b.folder as to_group, e.type from e join fo a on a.graphId = e.graphId and a.id = e.source join fo b on b.graphId = e.graphId and b.id = e.target)"""
_DEG = ", dg as (select graphId, id, count(*) as degree from (select graphId, unnest([source, target]) as id from e) group by 1, 2)"
_LP = ", ".join(f"({i}, {name!r}, {p + s!r})" for i, (name, ps) in enumerate(S.LAYER_PATTERNS) for p in ps for s in ("", "s"))
ORACLE = {
    "f1_filter_nodes": BASE + "select graphId, id from n where type in ('file', 'class', 'config') and complexity in ('simple', 'moderate')",
    "f1_layer_nodes": BASE + "select graphId, id from n where type in ('file', 'function', 'class') and (graphId, id) in (select (graphId, id) from lm where layer_name in ('Anchor', 'Ferry', 'Harbor'))",
    "f2_filter_edges": BASE + "select e.graphId, e.edge_ord from e left join ec on ec.k = e.type join n a on a.graphId = e.graphId and a.id = e.source and a.type in ('file', 'function') join n b on b.graphId = e.graphId and b.id = e.target and b.type in ('file', 'function') where ec.v is null or ec.v in ('structural', 'behavioral')",
    "f5_focus": BASE + "select e.graphId, e.target as id from e join n on n.graphId = e.graphId and n.id = e.source and n.type = 'config' union select e.graphId, e.source from e join n on n.graphId = e.graphId and n.id = e.target and n.type = 'config' union select graphId, id from n where type = 'config'",
    "f13_self_edges": BASE + "select source = target as self, count(*) as n from e group by 1",
    "g1_complexity": BASE + "select g.graphId, l.complexity, count(n.id) as n from (select distinct graphId from n) g join (values ('simple'), ('moderate'), ('complex')) l(complexity) on true left join n on n.graphId = g.graphId and n.complexity = l.complexity group by 1, 2",
    "g2_degrees": _B + _DEG + " select * from dg",
    "g3_overview": BASE + "select n.graphId, count(*) as n_nodes, coalesce(any_value(x.c), 0) as n_edges, floor(2.0 * coalesce(any_value(x.c), 0) / count(*) * 10 + 0.5) / 10 as avg_connections from n left join (select graphId, count(*) as c from e group by 1) x using (graphId) group by 1",
    "g4_edge_categories": BASE + "select graphId, coalesce(ec.v, 'other') as category, count(*) as n, round(avg(weight), 6) as avg_weight from e left join ec on ec.k = e.type group by 1, 2",
    "g5_layer_stats": BASE + "select lm.graphId, layer_id, count(*) as n_members, case when count(*) filter (complexity = 'complex') / count(*) > 0.3 then 'complex' when count(*) filter (complexity = 'moderate') / count(*) > 0.3 then 'moderate' else 'simple' end as complexity from lm join n using (graphId, id) group by 1, 2",
    "g6_layer_edges": _B + _LE + " select * from le where from_group <> to_group",
    "g7_folder_edges": _B + _FO + " select graphId, from_group, to_group, count(*) as n_edges, string_agg(distinct type, ',' order by type) as types from fe group by 1, 2, 3",
    "g8_portals": _B + _LE + " select graphId, layer_id, portal, sum(n_edges)::bigint as connections from (select graphId, from_group as layer_id, to_group as portal, n_edges from le where from_group <> to_group union all select graphId, to_group, from_group, n_edges from le where from_group <> to_group) group by 1, 2, 3",
    "g11_language_stats": "select graphId, lower(trim(language)) as language, count(*) as n_files, sum(sizeBytes)::bigint as bytes, grouping(graphId, lower(trim(language)))::int as margin from source_files group by cube (graphId, lower(trim(language)))",
    "g13_fan": BASE + "select * from (select *, row_number() over (partition by graphId, side order by n desc, id) as place from (select graphId, side, id, count(*) as n from (select graphId, 'in' as side, target as id from e where type in ('imports', 'calls') union all select graphId, 'out', source from e where type in ('imports', 'calls')) group by 1, 2, 3)) where place <= 20",
    "g14_type_matrix": BASE + "select a.type as source_type, b.type as target_type, e.type, count(*) as n from e join n a on a.graphId = e.graphId and a.id = e.source join n b on b.graphId = e.graphId and b.id = e.target group by 1, 2, 3",
    "g14_density": _B + _FO + " select graphId, folder, sum(case when inn then 1 else 0 end)::bigint as inner_edges, count(*) as all_edges, round(sum(case when inn then 1 else 0 end) / count(*), 6) as density from (select graphId, from_group as folder, from_group = to_group as inn from fe where type = 'imports' union all select graphId, to_group, false from fe where type = 'imports' and from_group <> to_group) group by 1, 2",
    "g14_direction": _B + _FO + " select *, case when ab > ba then a || '>' || b when ba > ab then b || '>' || a end as dominant from (select graphId, least(from_group, to_group) as a, greatest(from_group, to_group) as b, count(*) filter (from_group < to_group) as ab, count(*) filter (from_group > to_group) as ba from fe where type = 'imports' and from_group <> to_group group by 1, 2, 3)",
    "g15_entry_points": BASE + """select graphId, place, id, score from (select *, row_number() over (partition by graphId order by score desc, id) as place from (
      select graphId, id, (case when regexp_matches(nm, '^(?:main|index|app|server|cli|mod|lib)\\.[a-z]+$') then 3 else 0 end + case when len(string_split(filePath, '/')) <= 2 then 1 else 0 end
      + case when percent_rank() over (partition by graphId order by fo desc) <= 0.1 then 1 else 0 end + case when percent_rank() over (partition by graphId order by fi) <= 0.25 then 1 else 0 end
      + case when nm = 'readme.md' then 5 when ends_with(nm, '.md') then 2 else 0 end) as score from (select n.graphId, n.id, filePath, lower(split_part(filePath, '/', -1)) as nm, coalesce(o.c, 0) as fo, coalesce(i.c, 0) as fi from n
      left join (select graphId, source as id, count(*) as c from e group by 1, 2) o using (graphId, id) left join (select graphId, target as id, count(*) as c from e group by 1, 2) i using (graphId, id) where type in ('file', 'document') and filePath is not null))) where place <= 5""",
    "g16_line_distribution": "select graphId, count(*) as n, min(totalLines) as min, quantile_disc(totalLines, 0.5) as p50, quantile_disc(totalLines, 0.95) as p95, max(totalLines) as max, floor(avg(totalLines) * 100 + 0.5) / 100 as mean from fingerprints where totalLines is not null group by 1",
    "j18_layer_index": _B + _FL + " select * from fl",
    "o2_hubs": _B + _DEG + " select graphId, place, id, degree from (select dg.*, row_number() over (partition by dg.graphId order by degree desc, node_ord) as place from dg join n using (graphId, id)) where place <= 5",
    "r10_layers": _B + f", lp(ord, layer, segment) as (values {_LP}) select n.graphId, n.id, coalesce(arg_min(lp.layer, lp.ord), 'Core') as layer from n left join lp on list_contains(string_split(lower(coalesce(n.filePath, '')), '/'), lp.segment) where n.type = 'file' group by 1, 2",
    "r15_folders": _B + _FO + " select graphId, folder, count(*) as n from fo group by 1, 2",
    "r19_file_tree": BASE + """select graphId, path, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as parent, kind, node from (
      select graphId, filePath as path, 'file' as kind, arg_min(id, (type <> 'file', node_ord)) as node from n where coalesce(filePath, '') <> '' group by 1, 2
      union all select distinct graphId, array_to_string(parts[1:i], '/'), 'folder', null from (select graphId, string_split(filePath, '/') as parts, unnest(range(1, len(string_split(filePath, '/')))) as i from n where coalesce(filePath, '') <> ''))""",
    "r31_node_size": _B + _DEG + " select graphId, id, floor(greatest(0.85, least(1.5, 0.85 + 0.03::double * degree)) * 280 + 0.5)::bigint as width, floor(greatest(0.85, least(1.5, 0.85 + 0.03::double * degree)) * 120 + 0.5)::bigint as height from dg",
}
