"""Queries of tours, guides, groupings and rule lookups, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.operators import consensus, guides, traverse, views
from graphloom.operators.merge import capped
from graphloom.plans.base import BASE, Graphs
from graphloom.plans.viewing import _DEG, _LP
from graphloom.session import table
from graphloom.sources import languages, parsers


def r9_tour(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return guides.layer_tour(g.nodes, g.edges.where("type = 'contains'"), views.detect_layers(g.nodes), ["article"])


def r5_guide(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return guides.guide(table(spark, d, "graphs"), g.nodes, g.edges, views.detect_layers(g.nodes))


def r20_neighbours(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    batches = traverse.chunks(g.nodes.where("type = 'file'").select("graphId", "id", "node_ord"), ["graphId"], ["node_ord"], 12, "batch")
    return guides.neighbour_map(g.edges.where("type = 'imports' and source <> target"), batches)


def r21_noncode(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select("graphId", "path").distinct().where(languages.category(F.col("path")) != "code")
    return guides.noncode_groups(f)


def j11_prefix(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").where("path like '%.java'")
    refs = f.select("graphId", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^import ([\w.]+);"), F.lit(1))).alias("ref")).distinct()
    packages = f.select(F.regexp_extract("content", r"(?m)^package ([\w.]+);", 1).alias("prefix")).where("prefix <> ''").distinct()
    return guides.longest_prefix(refs, packages)


def c1_calls(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").where("path like '%.py'").select("graphId", "path", F.lit("python").alias("lang"), "content")
    e = parsers.extract_entities(f).distinct()
    calls = e.where("kind = 'call' and not contains(name, '.')").select("graphId", "path", F.col("parent").alias("caller"), "name").distinct()
    symbols = e.where("kind in ('function', 'class') and parent is null")
    mods = e.where("kind = 'import'").select("graphId", "path", F.element_at(F.split("name", r"\."), -1).alias("stem"))
    paths = f.select("graphId", F.col("path").alias("to_path"), F.regexp_extract("path", r"([^/]+)\.py$", 1).alias("stem")).distinct()
    return guides.resolve_calls(calls, symbols, mods.join(paths, ["graphId", "stem"]).select("graphId", "path", "to_path"))


def z7_qualifiers(spark: SparkSession, d: str) -> DataFrame:
    n = Graphs(spark, d).nodes.select("graphId", F.explode(guides.qualifiers(F.col("summary"))).alias("word"))
    return n.groupBy("graphId", "word").agg(F.count("*").alias("n"))


def u5_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of one node whose tags share at least half with those of the delivery before."""
    n = table(spark, d, "nodes").where("size(tags) > 0").select("graphId", "id", "node_row", F.array_distinct("tags").alias("tags"))
    w = Window.partitionBy("graphId", "id").orderBy("node_row")
    p = n.withColumns({"other": F.lag("node_row").over(w), "t2": F.lag("tags").over(w)}).where("other is not null")
    return p.select("node_row", "other", F.round(consensus.jaccard(F.col("tags"), F.col("t2")), 6).alias("jaccard")).where("jaccard >= 0.5")


def o3_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of hubs: those of nodes with more than 50 links, the best 50 by degree."""
    g = Graphs(spark, d)
    deg = views.degrees(g.edges)
    hubs = deg.where("degree > 50").select("graphId", "id")
    both = g.edges.select("graphId", F.col("source").alias("id"), F.col("target").alias("other")).union(g.edges.select("graphId", "target", "source")).distinct()
    j = both.join(hubs, ["graphId", "id"]).join(deg.select("graphId", F.col("id").alias("other"), "degree"), ["graphId", "other"])
    return capped(j, ["graphId", "id"], [F.desc("degree"), "other"], 50).select("graphId", "id", "other", "degree")


def g20_backlinks(spark: SparkSession, d: str) -> DataFrame:
    e = Graphs(spark, d).edges.where("type in ('related', 'cites', 'builds_on')")
    return e.groupBy("graphId", "target").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))


def r16_mutual(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nodes linked both ways."""
    e = Graphs(spark, d).edges.select("graphId", "source", "target").distinct()
    return e.join(e.select("graphId", F.col("target").alias("source"), F.col("source").alias("target")), ["graphId", "source", "target"], "left_semi").where("source < target")


def r12_owner(spark: SparkSession, d: str) -> DataFrame:
    """The file that contains each function or class, through containment of any depth, by distance."""
    g = Graphs(spark, d)
    c = g.edges.where("type = 'contains'")
    levels = traverse.topological_levels(g.nodes, c)
    return levels.join(traverse.containers(g.nodes, c), ["graphId", "id"]).groupBy("graphId", "level").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"))


QUERIES = {f.__name__: f for f in (r9_tour, r5_guide, r20_neighbours, r21_noncode, j11_prefix, c1_calls, z7_qualifiers, u5_jaccard, o3_truncated, g20_backlinks, r16_mutual, r12_owner)}

_B = BASE.rstrip()
_DL = f", lp(ord, layer, segment) as (values {_LP}), dl as (select n.graphId, n.id, coalesce(arg_min(lp.layer, lp.ord), 'Core') as layer from n left join lp on list_contains(string_split(lower(coalesce(n.filePath, '')), '/'), lp.segment) where n.type = 'file' group by 1, 2)"
_LV = ", lv0 as (select graphId, id, 0 as level from n union select l.graphId, e.target, l.level + 1 from lv0 l join e on e.graphId = l.graphId and e.source = l.id and e.source <> e.target and e.type = 'contains' where l.level < 30), lv as (select graphId, id, case when max(level) >= 30 then -1 else max(level) end as level from lv0 group by 1, 2)"
_BR = BASE.replace("with na(k, v)", "with recursive na(k, v)", 1).rstrip()
_CAT = ", ".join(f"({k!r})" for k in languages.CATEGORY_BY_EXT)
_QUAL = "only|never|always|unless|except|at most|at least|until|before|after|every|each|may|must|cannot"
ORACLE = {
    "r9_tour": _BR + _LV + _DL + """, st as (select n.graphId, coalesce(dl.layer, 'Supporting Components') as title, min(case when level < 0 then 1 << 30 else level end) as at_, count(*) as n_nodes, max((dl.layer is null)::int) as rank from n join lv using (graphId, id) left join dl using (graphId, id) where n.type <> 'article' group by 1, 2
      union all select graphId, 'Key Concepts', 0, count(*), 2 from n where type = 'article' group by 1) select graphId, row_number() over (partition by graphId order by rank, at_, title) as step, title, n_nodes from st""",
    "r5_guide": _B + _DL + _DEG + """, a as (select graphId, count(*) as n_nodes, count(*) filter (complexity = 'complex') as n_complex from n group by 1), b as (select graphId, count(*) as n_edges from e group by 1), l as (select graphId, string_agg('- ' || layer || ': ' || k, chr(10) order by layer) as layers from (select graphId, layer, count(*) as k from dl group by 1, 2) group by 1),
      h as (select graphId, string_agg('- ' || id || ' (' || degree || ')', chr(10) order by r) as hot from (select *, row_number() over (partition by graphId order by degree desc, id) as r from dg) where r <= 5 group by 1)
      select g.graphId, '# ' || coalesce(name, g.graphId) || chr(10) || chr(10) || coalesce(n_nodes, 0) || ' nodes, ' || coalesce(n_edges, 0) || ' edges, ' || coalesce(n_complex, 0) || ' complex' || chr(10) || chr(10) || '## Layers' || chr(10) || chr(10) || coalesce(layers, '') || chr(10) || chr(10) || '## Hotspots' || chr(10) || chr(10) || coalesce(hot, '') || chr(10) as guide
      from graphs g left join a using (graphId) left join b using (graphId) left join l using (graphId) left join h using (graphId)""",
    "r20_neighbours": _B + """, bt as (select graphId, id, (row_number() over (partition by graphId order by node_ord) - 1) // 12 as batch from n where type = 'file'), bo as (select graphId, source as file, target as neighbour from e where type = 'imports' and source <> target union select graphId, target, source from e where type = 'imports' and source <> target),
      dd as (select graphId, file as neighbour, count(*) as degree from bo group by 1, 2) select graphId, file, neighbour, batch::int as batch from (select bo.*, y.batch, row_number() over (partition by bo.graphId, bo.file order by degree desc, bo.neighbour) as r from bo join bt x on x.graphId = bo.graphId and x.id = bo.file join bt y on y.graphId = bo.graphId and y.id = bo.neighbour join dd on dd.graphId = bo.graphId and dd.neighbour = bo.neighbour where x.batch <> y.batch) where r <= 50""",
    "r21_noncode": f"""with c(k) as (values {_CAT}), f as (select distinct graphId, path, split_part(path, '/', -1) as b, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as dir from source_files),
      x as (select *, lower(case when starts_with(b, '.') then regexp_extract(b, '^\\.([A-Za-z0-9]+)', 1) else regexp_extract(b, '[^.]\\.([^.]+)$', 1) end) as ext from f), g as (select graphId, path, case when regexp_matches(b, '^Dockerfile|^docker-compose|^\\.dockerignore') then 'container:' || dir when regexp_matches(path, '(?:^|/)\\.github/workflows/') then 'workflows'
      when regexp_matches(b, '^(?:Jenkinsfile|\\.gitlab-ci)') then 'pipelines' when regexp_matches(path, '(?:^|/)migrations?/') then 'migrations:' || dir else 'folder:' || dir end as grp from x where regexp_matches(path, '{languages.INFRA_RE}') or ext in (select k from c))
      select graphId, path, grp, ((row_number() over (partition by graphId, grp order by path) - 1) // 20)::int as chunk from g""",
    "j11_prefix": "with r as (select distinct graphId, unnest(regexp_extract_all(content, '(?m)^import ([\\w.]+);', 1)) as ref from source_files where path like '%.java'), p as (select distinct regexp_extract(content, '(?m)^package ([\\w.]+);', 1) as prefix from source_files where path like '%.java') select graphId, ref, arg_max(prefix, length(prefix)) as prefix from r join p on p.prefix <> '' and (ref = prefix or starts_with(ref, prefix || '.')) group by 1, 2",
    "z7_qualifiers": _B + f", w as (select graphId, unnest(list_distinct(regexp_extract_all(lower(summary), '\\b({_QUAL})\\b', 1))) as word from n) select graphId, word, count(*) as n from w group by 1, 2",
    "u5_jaccard": """with x as (select node_row, list_distinct(list_transform(tags, lambda t: coalesce(t, chr(0)))) as t, lag(node_row) over w as other, lag(list_distinct(list_transform(tags, lambda t: coalesce(t, chr(0))))) over w as u from nodes where len(tags) > 0 window w as (partition by graphId, id order by node_row)),
      p as (select node_row, other, len(list_intersect(t, u)) as i, len(t) as a, len(u) as b from x where other is not null) select node_row, other, round(i / (a + b - i), 6) as jaccard from p where i / (a + b - i) >= 0.5""",
    "o3_truncated": _B + _DEG + ", bo as (select graphId, source as id, target as other from e union select graphId, target, source from e) select bo.graphId, bo.id, bo.other, y.degree from bo join dg x on x.graphId = bo.graphId and x.id = bo.id and x.degree > 50 join dg y on y.graphId = bo.graphId and y.id = bo.other qualify row_number() over (partition by bo.graphId, bo.id order by y.degree desc, bo.other) <= 50",
    "g20_backlinks": _B + " select graphId, target, count(*) as n, string_agg(distinct source, '|' order by source) as sources from e where type in ('related', 'cites', 'builds_on') group by 1, 2",
    "r16_mutual": _B + " select distinct a.graphId, a.source, a.target from e a join e b on b.graphId = a.graphId and b.source = a.target and b.target = a.source where a.source < a.target",
    "r12_owner": _BR + _LV + ", dr as (select e.graphId, e.target as id, min(e.source) as file from e join n on n.graphId = e.graphId and n.id = e.source and n.type = 'file' where e.type = 'contains' group by 1, 2) select lv.graphId, level, count(*) as n, count(distinct file) as n_files from lv join dr using (graphId, id) group by 1, 2",
}
