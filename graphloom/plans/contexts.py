"""Queries of contexts, overlays, groups and labels, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import contexts as X
from graphloom.operators import search, traverse, views
from graphloom.plans.base import BASE, Graphs
from graphloom.plans.querying import _BFS, _BR, _FLS, _IMP, _changed, _search
from graphloom.plans.viewing import _FO as _FOLDERS
from graphloom.session import table

_KINDS = ("config", "document", "table")
_WORDS = ["queue", "harbor", "tunnel"]
_LAYERS = [("Services", "services/"), ("Applications", "app/"), ("Packages", "packages/"), ("Sources", "src/")]


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("graphId", "path").distinct()


def r1_chat(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return X.chat_context(search.search(g.searched, "cursor", 15), g.nodes, g.edges, g.members)


def r2_edges(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return X.impacted_edges(g.edges, traverse.diff_impact(g.nodes, g.edges, _changed(spark, d)))


def r2_layers(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return X.touching_layers(traverse.diff_impact(g.nodes, g.edges, _changed(spark, d)), g.members)


def r4_text(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return X.explain_text(g.nodes, g.edges, g.members, g.nodes.where("type = 'file'"))


def r6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Shortest ways from the first file of each graph to the last node of each type."""
    g = Graphs(spark, d)
    first = g.nodes.where("type = 'file'").groupBy("graphId").agg(F.min_by("id", "node_ord").alias("source"))
    ends = g.nodes.groupBy("graphId", "type").agg(F.max_by("id", "node_ord").alias("target")).select("graphId", "target")
    return traverse.shortest_paths(g.edges, first.join(ends, "graphId"))


def r17_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Nodes on a cycle when each follows its first outgoing link by target."""
    e = Graphs(spark, d).edges.where("source <> target")
    return X.cycle_nodes(e.groupBy("graphId", F.col("source").alias("id")).agg(F.min("target").alias("next")))


def r18_overview(spark: SparkSession, d: str) -> DataFrame:
    """Files taken as domains and what they contain as flows."""
    g = Graphs(spark, d)
    return X.children_counts(g.nodes, g.edges, "file", "contains")


def r18_order(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return X.step_order(g.nodes, g.edges, "file", "contains")


def r29_overlays(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return X.overlays(g.nodes, g.edges, search.search(g.searched, "cursor", 15), traverse.diff_impact(g.nodes, g.edges, _changed(spark, d)))


def r32_knowledge(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return X.knowledge_view(g.nodes, g.edges, ()).select("graphId", "edge_ord")


def f3_persona(spark: SparkSession, d: str) -> DataFrame:
    return X.persona_view(Graphs(spark, d).nodes, False, ("infra",)).groupBy("graphId", "type").agg(F.count("*").alias("n"))


def f4_detail(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return X.detail_view(g.members, g.nodes, g.edges)


def g9_hits(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return X.hits_per_layer(search.search(g.searched, "cursor", 50), g.members)


def g14_imports(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return views.grouped_edges(g.edges.where("type = 'imports'"), views.folders(g.nodes), "folder").where("from_group <> to_group").select("graphId", "from_group", "to_group", "n_edges")


def g14_labels(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("graphId", "path", X.path_labels(F.col("path")).alias("label"))


def g14_topology(spark: SparkSession, d: str) -> DataFrame:
    return X.deployment(_files(spark, d))


def g14_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return X.pipeline_files(_files(spark, d))


def g14_coverage(spark: SparkSession, d: str) -> DataFrame:
    return X.doc_coverage(_files(spark, d))


def r11_layers(spark: SparkSession, d: str) -> DataFrame:
    return X.listed_layers(Graphs(spark, d).nodes, _LAYERS)


def s27_contents(spark: SparkSession, d: str) -> DataFrame:
    return X.safe_contents(table(spark, d, "source_files"), Graphs(spark, d).nodes)


def s23_scan(spark: SparkSession, d: str) -> DataFrame:
    return X.domain_scan(table(spark, d, "source_files"), 4, 3, 200)


def s25_trimmed(spark: SparkSession, d: str) -> DataFrame:
    return X.trimmed(table(spark, d, "source_files").groupBy("graphId", "path").agg(F.max("content").alias("content")), 64 * 1024)


def o5_sampled(spark: SparkSession, d: str) -> DataFrame:
    return X.sampled_files(table(spark, d, "source_files"), _WORDS)


def r16_clusters(spark: SparkSession, d: str) -> DataFrame:
    return X.mutual_clusters(Graphs(spark, d).edges.where("type in ('related', 'cites', 'builds_on', 'calls')"))


def j25_connections(spark: SparkSession, d: str) -> DataFrame:
    """Links of every configuration, each way, with the children apart."""
    g = Graphs(spark, d)
    c = g.nodes.where("type = 'config'").select("graphId", "id")
    out = c.join(g.edges.select("graphId", F.col("source").alias("id"), F.col("target").alias("other"), "type"), ["graphId", "id"]).withColumn("way", F.when(F.col("type") == "contains", "child").otherwise("out"))
    return out.unionByName(c.join(g.edges.select("graphId", F.col("target").alias("id"), F.col("source").alias("other"), "type"), ["graphId", "id"]).withColumn("way", F.lit("in")))


def j26_article_links(spark: SparkSession, d: str) -> DataFrame:
    """Per article: links to others, links from others, categories."""
    g = Graphs(spark, d)
    a = g.nodes.where("type = 'article'").select("graphId", "id")
    e = g.edges.where("type in ('related', 'cites', 'builds_on')")
    out = e.groupBy("graphId", F.col("source").alias("id")).agg(F.count("*").alias("n_links"))
    back = e.groupBy("graphId", F.col("target").alias("id")).agg(F.count("*").alias("n_backlinks"))
    return a.join(out, ["graphId", "id"], "left").join(back, ["graphId", "id"], "left").fillna(0, ["n_links", "n_backlinks"])


def o4_community_order(spark: SparkSession, d: str) -> DataFrame:
    """Folders of each graph by size, then by their first path, as communities are ordered."""
    from pyspark.sql import Window

    f = views.folders(Graphs(spark, d).nodes).groupBy("graphId", "folder").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return f.select("graphId", "folder", "n", F.row_number().over(Window.partitionBy("graphId").orderBy(F.desc("n"), "first")).alias("place"))


def o8_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first three members of each layer."""
    return Graphs(spark, d).members.where("pos < 1000000").groupBy("graphId", "layer_id", "id").agg(F.min("pos").alias("pos")).select("graphId", "layer_id", "id", "pos", F.expr("row_number() over (partition by graphId, layer_id order by pos, id)").alias("r")).where("r <= 3").drop("pos")


def u4_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files named by nodes, fingerprints or deliveries, each once."""
    n = table(spark, d, "nodes").select("graphId", F.col("filePath").alias("path"))
    f = table(spark, d, "fingerprints").select("graphId", F.col("filePath").alias("path"))
    return n.union(f).union(table(spark, d, "source_files").select("graphId", "path")).where("path is not null").distinct().groupBy("graphId").agg(F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))


def u6_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Paths that only nodes or only deliveries have."""
    n = table(spark, d, "nodes").where("lower(type) = 'file' and filePath is not null").select("graphId", F.col("filePath").alias("path")).distinct()
    f = _files(spark, d)
    return n.join(f, ["graphId", "path"], "left_anti").withColumn("side", F.lit("nodes")).union(f.join(n, ["graphId", "path"], "left_anti").withColumn("side", F.lit("files")))


QUERIES = {
    f.__name__: f
    for f in (
        r1_chat, r2_edges, r2_layers, r4_text, r6_paths, r17_cycles, r18_overview, r18_order, r29_overlays, r32_knowledge, f3_persona, f4_detail, g9_hits, g14_imports, g14_labels, g14_topology,
        g14_pipeline, g14_coverage, r11_layers, s27_contents, s23_scan, s25_trimmed, o5_sampled, r16_clusters, j25_connections, j26_article_links, o4_community_order, o8_samples, u4_changed_files, u6_both_ways,
    )
}

_B = BASE.rstrip()
_H = ", h as " + _search(["cursor"], 15) + ", nh as (select graphId, id from h union select e.graphId, e.target from e join h on h.graphId = e.graphId and h.id = e.source union select e.graphId, e.source from e join h on h.graphId = e.graphId and h.id = e.target)"
_LN = """, l_{x} as (select graphId, line, row_number() over (partition by graphId order by line) as r from (select distinct graphId, line from {x}0)), t_{x} as (select graphId, coalesce(string_agg(line, chr(10) order by line) filter (r <= 50), '') || case when count(*) > 50 then chr(10) || '- and ' || (count(*) - 50) || ' more' else '' end as t from l_{x} group by 1)"""
_LABEL = "case " + " ".join(f"when regexp_matches(path, '{p}') then '{name}'" for name, p in X.FILE_LABELS) + " else coalesce(fl.label, 'other') end"
_FOLD = ", ".join(f"('{f}', '{name}')" for name, fs in X.FOLDER_LABELS.items() for f in fs)
_F = "with f as (select distinct graphId, path, split_part(path, '/', -1) as b, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as folder from source_files)"
_KN = ", ".join(repr(x) for x in X.KNOWLEDGE_TYPES)
ORACLE = {
    "r1_chat": _B + _H + ", q as (select nh.graphId, nh.id, n.type, n.name from nh join n using (graphId, id)), a0 as (select graphId, '- ' || type || ': ' || coalesce(name, id) || ' (' || id || ')' as line from q)" + _LN.format(x="a")
    + ", b0 as (select e.graphId, '- ' || source || ' -[' || e.type || ']-> ' || target as line from e where (graphId, source) in (select (graphId, id) from q) and (graphId, target) in (select (graphId, id) from q))" + _LN.format(x="b")
    + ", c0 as (select distinct lm.graphId, '- ' || coalesce(layer_name, layer_id) as line from lm join q using (graphId, id))" + _LN.format(x="c")
    + " select t_a.graphId, '## Nodes' || chr(10) || t_a.t || chr(10) || '## Relationships' || chr(10) || coalesce(t_b.t, '') || chr(10) || '## Layers' || chr(10) || coalesce(t_c.t, '') || chr(10) as context from t_a left join t_b using (graphId) left join t_c using (graphId)",
    "r2_edges": _BR + _IMP + " select e.graphId, e.edge_ord, e.source, e.target, e.type from e where (graphId, source) in (select (graphId, id) from cg) or (graphId, target) in (select (graphId, id) from cg)",
    "r2_layers": _BR + _IMP + " select distinct lm.graphId, layer_id, layer_name from lm join im using (graphId, id)",
    "r4_text": _B + _FLS + """, nm as (select graphId, id, coalesce(name, id) as label from n), rw as (select e.graphId, e.source as id, case when e.type = 'contains' then '1 contains ' || nm.label else '2 ' || e.type || ' ' || nm.label end as line from e join nm on nm.graphId = e.graphId and nm.id = e.target union select e.graphId, e.target, '3 ' || e.type || ' by ' || nm.label from e join nm on nm.graphId = e.graphId and nm.id = e.source),
      ls as (select graphId, id, string_agg('- ' || substr(line, 3), chr(10) order by line) as list from rw group by 1, 2) select n.graphId, n.id, '# ' || coalesce(n.name, n.id) || chr(10) || 'Layer: ' || coalesce(fl.layer_id, 'none') || chr(10) || coalesce(ls.list, '') as text from n left join fl using (graphId, id) left join ls using (graphId, id) where n.type = 'file'""",
    "r6_paths": _BR + _BFS.format(edges="select distinct graphId, source as a, target as b from e where source <> target union select distinct graphId, target, source from e where source <> target", most=25).replace("select graphId, id, min(depth) as depth from bf group by 1, 2", """, dm as materialized (select graphId, id, min(depth) as depth from bf group by 1, 2),
      pr as materialized (select x.graphId, x.id, min(ee.a) as parent from dm x join ee on ee.graphId = x.graphId and ee.b = x.id join dm y on y.graphId = x.graphId and y.id = ee.a and y.depth = x.depth - 1 group by 1, 2),
      en as (select graphId, arg_max(id, node_ord) as target from n group by graphId, type), wy as (select en.graphId, en.target, en.target as at_, en.target as path, 0 as k from en union all select w.graphId, w.target, pr.parent, pr.parent || '>' || w.path, k + 1 from wy w join pr on pr.graphId = w.graphId and pr.id = w.at_)
      select s0.graphId, s0.id as source, w.target, dm.depth as length, w.path from s0 join dm using (graphId) join wy w on w.graphId = dm.graphId and w.target = dm.id and w.k = dm.depth where dm.graphId = s0.graphId"""),
    "r17_cycles": _BR + ", nx as materialized (select graphId, source as id, min(target) as nxt from e where source <> target group by 1, 2), wk as (select graphId, id, nxt as cur from nx union select w.graphId, w.id, nx.nxt from wk w join nx on nx.graphId = w.graphId and nx.id = w.cur) select graphId, id from wk where cur = id",
    "r18_overview": _B + " select n.graphId, n.id, coalesce(k, 0) as n from n left join (select graphId, source as id, count(*) as k from e where type = 'contains' group by 1, 2) using (graphId, id) where type = 'file'",
    "r18_order": _B + " select e.graphId, e.target as id, floor(arg_max(e.weight, edge_ord) * 10 + 0.5)::int as ord from e join n on n.graphId = e.graphId and n.id = e.source and n.type = 'file' where e.type = 'contains' group by 1, 2",
    "r29_overlays": _BR + _IMP + _H + ", fg as (select n.graphId, n.id, (n.graphId, n.id) in (select (graphId, id) from h) as found, (n.graphId, n.id) in (select (graphId, id) from im where role = 'changed') as changed, (n.graphId, n.id) in (select (graphId, id) from im where role = 'affected') as affected, (n.graphId, n.id) in (select (graphId, id) from nh) and not (n.graphId, n.id) in (select (graphId, id) from h) as near from n) select * from fg where found or changed or affected or near",
    "r32_knowledge": _B + f" select e.graphId, e.edge_ord from e join n a on a.graphId = e.graphId and a.id = e.source and a.type not in ({_KN}) join n b on b.graphId = e.graphId and b.id = e.target and b.type not in ({_KN})",
    "f3_persona": _B + f" select graphId, type, count(*) as n from n left join nc on nc.k = type where coalesce(nc.v, 'code') <> 'infra' and type in ({', '.join(repr(x) for x in X.STRUCTURAL_TYPES)}) and type not in ('function', 'class') group by 1, 2",
    "f4_detail": _B + ", ow as (select distinct graphId, layer_id, id from lm) select * from ow union select ow.graphId, ow.layer_id, e.target from ow join e on e.graphId = ow.graphId and e.source = ow.id and e.type = 'contains' join n on n.graphId = e.graphId and n.id = e.target and n.type = 'class'",
    "g9_hits": _B + _FLS + ", h as " + _search(["cursor"], 50) + " select h.graphId, fl.layer_id, count(*) as n_hits from h join fl using (graphId, id) group by 1, 2",
    "g14_imports": _B + _FOLDERS + " select graphId, from_group, to_group, count(*) as n_edges from fe where type = 'imports' and from_group <> to_group group by 1, 2, 3",
    "g14_labels": f"with f as (select distinct graphId, path from source_files), lb(folder, label) as (values {_FOLD}), s as (select graphId, path, unnest(string_split(lower(path), '/')[:-2]) as seg, generate_subscripts(string_split(lower(path), '/')[:-2], 1) as pos from f), fl as (select graphId, path, arg_max(label, pos) as label from s join lb on lb.folder = s.seg group by 1, 2) select f.graphId, f.path, {_LABEL} as label from f left join fl using (graphId, path)",
    "g14_topology": _F + ", k as (select graphId, regexp_matches(b, '^Dockerfile(?:\\..*)?$') as a, regexp_matches(b, '^(?:docker-)?compose[^/]*\\.ya?ml$') as c, regexp_matches(path, '(?:^|/)(?:k8s|kubernetes|helm)/') as k, regexp_matches(b, '\\.(?:tf|tfvars)$') as t, regexp_matches(path, '(?:^|/)\\.github/workflows/|(?:^|/)(?:\\.gitlab-ci\\.ya?ml|Jenkinsfile)$') as i from f) select graphId, bool_or(a) as has_dockerfile, bool_or(c) as has_compose, bool_or(k) as has_k8s, bool_or(t) as has_terraform, bool_or(i) as has_ci, count(*) filter (a or c or k or t or i) as n_infra from k group by 1",
    "g14_pipeline": _F + ", s as (select graphId, case when regexp_matches(lower(path), '(?:^|/)migrations?/') then 'migration' when regexp_matches(lower(path), '\\.(?:sql|graphql|gql|proto|prisma)$') then 'schema' when regexp_matches(lower(path), '(?:^|/)(?:models?|entities|entity)/') then 'model' when regexp_matches(lower(path), '(?:^|/)(?:routes?|controllers?|handlers?|endpoints?|api)/') then 'handler' end as stage from f) select graphId, stage, count(*) as n from s where stage is not null group by 1, 2",
    "g14_coverage": _F + ", g as (select graphId, folder, bool_or(regexp_matches(path, '(?i)\\.md$')) as d from f group by 1, 2) select graphId, count(*) as n_groups, count(*) filter (d) as n_documented, round(count(*) filter (d) / count(*), 6) as coverage from g group by 1",
    "r11_layers": _B + " select graphId, id, case " + " ".join(f"when starts_with(lower(coalesce(filePath, '')), '{p}') or contains(lower(coalesce(filePath, '')), '/{p}') then '{name}'" for name, p in _LAYERS) + " else 'Other' end as layer from n where type = 'file'",
    "s27_contents": _B + ", kp as (select distinct graphId, filePath as path from n where filePath is not null) select f.file_row, case when f.path is null or f.path = '' or starts_with(f.path, '/') or list_contains(string_split_regex(f.path, '[/\\\\]'), '..') then 'outside' when kp.path is null then 'unknown' when octet_length(encode(coalesce(content, ''))) > 1048576 then 'large' when contains(coalesce(content, ''), chr(0)) then 'binary' else 'ok' end as status from source_files f left join kp on kp.graphId = f.graphId and kp.path = f.path",
    "s23_scan": _F + ", a as (select graphId, path, row_number() over (partition by graphId, folder order by path) as r from f where len(string_split(path, '/')) - 1 <= 4), b as (select graphId, path, row_number() over (partition by graphId order by path) as k from a where r <= 3) select graphId, path from b where k <= 200",
    "s25_trimmed": "with f as (select graphId, path, octet_length(encode(coalesce(max(content), ''))) as size from source_files group by 1, 2), g as (select *, coalesce(sum(size) over (partition by graphId order by size, path rows between unbounded preceding and 1 preceding), 0) as before from f) select graphId, path, greatest(0, least(size, 65536 - before))::bigint as kept from g",
    "o5_sampled": "with f as (select distinct graphId, path, " + " + ".join(f"contains(lower(path || ' ' || coalesce(content, '')), '{w}')::int" for w in _WORDS) + " as n_words from source_files), g as (select *, row_number() over (partition by graphId order by n_words desc, path) as r from f where n_words > 0) select graphId, path, n_words from g where r <= 40",
    "j25_connections": _B + ", c as (select graphId, id from n where type = 'config') select e.graphId, e.source as id, e.target as other, e.type, case when e.type = 'contains' then 'child' else 'out' end as way from e join c on c.graphId = e.graphId and c.id = e.source union all select e.graphId, e.target, e.source, e.type, 'in' from e join c on c.graphId = e.graphId and c.id = e.target",
    "j26_article_links": _B + ", l as (select * from e where type in ('related', 'cites', 'builds_on')) select n.graphId, n.id, coalesce(a.k, 0) as n_links, coalesce(b.k, 0) as n_backlinks from n left join (select graphId, source as id, count(*) as k from l group by 1, 2) a using (graphId, id) left join (select graphId, target as id, count(*) as k from l group by 1, 2) b using (graphId, id) where n.type = 'article'",
    "o4_community_order": _B + _FOLDERS + " select graphId, folder, n, row_number() over (partition by graphId order by n desc, first) as place from (select graphId, folder, count(*) as n, min(id) as first from fo group by 1, 2)",
    "o8_samples": _B + ", m as (select graphId, layer_id, id, min(pos) as pos from lm group by 1, 2, 3) select graphId, layer_id, id, r from (select *, row_number() over (partition by graphId, layer_id order by pos, id) as r from m) where r <= 3",
    "u4_changed_files": "select graphId, count(*) as n, min(path) as first, max(path) as last from (select graphId, filePath as path from nodes union select graphId, filePath from fingerprints union select graphId, path from source_files) where path is not null group by 1",
    "u6_both_ways": "with a as (select distinct graphId, filePath as path from nodes where lower(type) = 'file' and filePath is not null), b as (select distinct graphId, path from source_files) select *, 'nodes' as side from (select * from a except select * from b) union all select *, 'files' from (select * from b except select * from a)",
}
