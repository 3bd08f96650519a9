"""Queries of graph construction, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import building as B
from graphloom.plans.base import BASE, Graphs, values
from graphloom.session import table
from graphloom.sources import languages


def b3_import_edges(spark: SparkSession, d: str) -> DataFrame:
    return B.distinct_edges(table(spark, d, "edges"), "imports").select("edge_row", "source", "target", "weight")


def b4_call_edges(spark: SparkSession, d: str) -> DataFrame:
    return B.distinct_edges(table(spark, d, "edges"), "calls").select("edge_row", "source", "target", "weight")


def b5_children(spark: SparkSession, d: str) -> DataFrame:
    return B.table_children(table(spark, d, "source_files"))


def b6_languages(spark: SparkSession, d: str) -> DataFrame:
    return B.languages_used(table(spark, d, "source_files"))


def b13_article_tags(spark: SparkSession, d: str) -> DataFrame:
    return B.article_tags(table(spark, d, "nodes").where("lower(type) = 'article' and op = 'upsert'")).select("node_row", "tags")


def b15_metrics(spark: SparkSession, d: str) -> DataFrame:
    return B.file_metrics(table(spark, d, "fingerprints"))


def b16_node_types(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select("graphId", B.file_node_type(F.col("path"), F.coalesce("content", F.lit(""))).alias("type"))
    return f.groupBy("graphId", "type").agg(F.count("*").alias("n"))


def b17_complexity(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").where("content is not null")
    n = F.size(F.filter(F.split("content", "\n"), lambda x: F.trim(F.regexp_replace(x, "\\s+", " ")) != ""))
    return f.select("file_row", B.size_complexity(n).alias("complexity"))


def b18_symbols(spark: SparkSession, d: str) -> DataFrame:
    return B.significant(table(spark, d, "fingerprints")).groupBy("fp_row", "kind").agg(F.count("*").alias("n"), F.min("name").alias("first"))


def b19_call_weights(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "edges").where("lower(type) = 'calls' and source is not null and target is not null").select("graphId", "source", "target")
    return B.call_edges(calls, Graphs(spark, d).nodes)


def b20_containers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "fingerprints").select("graphId", "filePath", F.explode("classes").alias("c")).select("graphId", "filePath", F.explode(F.concat(F.array("c.name"), F.transform("c.methods", lambda m: F.concat(F.col("c.name"), F.lit("."), m)))).alias("qualname")).where("qualname is not null").distinct()
    return B.nested_contains(c).groupBy("graphId", "container").agg(F.count("*").alias("n"))


def b21_import_map(spark: SparkSession, d: str) -> DataFrame:
    return B.import_edges(table(spark, d, "fingerprints").select("graphId", "filePath", "imports"))


def n11_inferred_types(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").select(F.explode(F.array("source", "target")).alias("id")).where("id is not null")
    return e.groupBy(B.id_type(F.col("id")).alias("type")).agg(F.count("*").alias("n"))


def n12_batch_ids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").where("id is not null")
    return n.select("node_row", B.batch_id(F.col("id"), F.col("type"), F.col("filePath"), F.col("name")).alias("bid"))


def n17_knowledge_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").groupBy(B.knowledge_node_type(F.col("type")).alias("type")).agg(F.count("*").alias("n"))


def n17_knowledge_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").groupBy(B.knowledge_edge_type(F.col("type")).alias("type")).agg(F.count("*").alias("n"))


def n18_entity_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").where("name is not null").groupBy("graphId", B.entity_name(F.col("name")).alias("name")).agg(F.count("*").alias("n"))


def n19_definition_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").groupBy(B.definition_type(F.col("type")).alias("type")).agg(F.count("*").alias("n"))


def i2_signatures(spark: SparkSession, d: str) -> DataFrame:
    return B.signatures(table(spark, d, "fingerprints"))


def i4_store(spark: SparkSession, d: str) -> DataFrame:
    return B.fingerprint_store(table(spark, d, "fingerprints"))


def g31_digests(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fingerprints").select("fp_row", "graphId", "filePath", "contentHash", "snapshot_no", "totalLines")
    return B.canonical_digest(f, "fp_row", ["graphId", "filePath", "contentHash", "snapshot_no", "totalLines"])


QUERIES = {
    f.__name__: f
    for f in (
        b3_import_edges, b4_call_edges, b5_children, b6_languages, b13_article_tags, b15_metrics, b16_node_types, b17_complexity, b18_symbols, b19_call_weights, b20_containers, b21_import_map,
        n11_inferred_types, n12_batch_ids, n17_knowledge_nodes, n17_knowledge_edges, n18_entity_names, n19_definition_types, i2_signatures, i4_store, g31_digests,
    )
}

_ANY = "|".join(B.BATCH_PREFIXES)
_IN = lambda xs: ", ".join(repr(x) for x in xs)
_DISTINCT = "select edge_row, source, target, {w}::double as weight from edges where lower(type) = '{t}' and source is not null and target is not null qualify row_number() over (partition by graphId, source, target order by edge_row) = 1"
_CASES = {
    "infra": languages.INFRA_RE, "ci": r"(?:^|/)\.github/workflows/|(?:^|/)\.circleci/|(?:^|/)(?:\.gitlab-ci\.ya?ml|Jenkinsfile)$",
}
ORACLE = {
    "b3_import_edges": _DISTINCT.format(t="imports", w=0.7),
    "b4_call_edges": _DISTINCT.format(t="calls", w=0.8),
    "b5_children": """with x as (select graphId, path, regexp_extract_all(content, '(?i)create\\s+(?:or\\s+replace\\s+)?(?:unique\\s+)?(?:table|view|index)\\s+(?:if\\s+not\\s+exists\\s+)?[`"]?(\\w+)', 1) as names from source_files where path like '%.sql'),
      y as (select graphId, path, unnest(names) as name, generate_subscripts(names, 1) - 1 as pos from x) select graphId, 'table:' || path || ':' || name as id, 'table' as type, name, min(pos)::int as pos from y group by graphId, path, name""",
    "b6_languages": "select graphId, string_agg(l, ',' order by l) as languages from (select distinct graphId, lower(trim(language)) as l from source_files where trim(coalesce(language, '')) <> '') group by 1",
    "b13_article_tags": """with x as (select node_row, unnest([knowledgeMeta.category, case when contains(filePath, '/') then split_part(filePath, '/', 1) end] || coalesce(tags, [])) as t from nodes where lower(type) = 'article' and op = 'upsert'),
      y as (select distinct node_row, lower(trim(t)) as t from x where trim(coalesce(t, '')) <> '') select n.node_row, coalesce((select string_agg(t, ',' order by t) from y where y.node_row = n.node_row), '') as tags from nodes n where lower(type) = 'article' and op = 'upsert'""",
    "b15_metrics": """select fp_row, coalesce(len(functions), 0)::int as n_functions, coalesce(len(classes), 0)::int as n_classes, coalesce(len(exports), 0)::int as n_exports, coalesce(len(imports), 0)::int as n_imports,
      coalesce(len(list_filter(imports, lambda i: starts_with(i.source, '.'))), 0)::int as n_relative, coalesce(list_sum(list_transform(classes, lambda c: coalesce(len(c.methods), 0))), 0)::int as n_methods from fingerprints""",
    "b16_node_types": f"""with {values(languages.CATEGORY_BY_EXT, 'cx')}, f as (select graphId, path, coalesce(content, '') as c, split_part(path, '/', -1) as b from source_files),
      x as (select *, lower(case when starts_with(b, '.') then regexp_extract(b, '^\\.([A-Za-z0-9]+)', 1) else regexp_extract(b, '[^.]\\.([^.]+)$', 1) end) as ext from f),
      y as (select x.*, case when regexp_matches(path, '{_CASES["infra"]}') then 'infra' else coalesce(cx.v, 'code') end as cat from x left join cx on cx.k = ext)
      select graphId, case cat when 'config' then 'config' when 'docs' then 'document' when 'infra' then (case when regexp_matches(path, '{_CASES["ci"]}') then 'pipeline' when ext in ('tf', 'tfvars') or b = 'Vagrantfile' then 'resource' else 'service' end)
      when 'data' then (case when ext in ('graphql', 'gql', 'proto', 'prisma') then 'schema' when ext = 'sql' and (regexp_matches(c, '(?i)create\\s+table') or regexp_matches(path, '(?:^|/)migrations?/')) then 'table' when regexp_matches(c, '(?i)\\b(?:openapi|swagger)\\b') then 'endpoint' else 'file' end)
      else 'file' end as type, count(*) as n from y group by 1, 2""",
    "b17_complexity": "select file_row, case when k < 50 then 'simple' when k <= 200 then 'moderate' else 'complex' end as complexity from (select file_row, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^\\s]'))) as k from source_files where content is not null)",
    "b18_symbols": """with x as (select fp_row, 'function' as kind, unnest(functions) as f from fingerprints), y as (select fp_row, 'class' as kind, unnest(classes) as c from fingerprints),
      z as (select fp_row, kind, f.name as name from x where f.lineCount >= 10 or f.exported union all select fp_row, kind, c.name from y where len(c.methods) >= 2 or c.lineCount >= 20 or c.exported) select fp_row, kind, count(*) as n, min(name) as first from z group by 1, 2""",
    "b19_call_weights": BASE + "select r.graphId, r.source, r.target, max(case when n.id is not null then 0.8 else 0.6 end)::double as weight from edges r left join n on n.graphId = r.graphId and n.id = r.target where lower(r.type) = 'calls' and r.source is not null and r.target is not null group by 1, 2, 3",
    "b20_containers": """with c as (select graphId, filePath, unnest(classes) as c from fingerprints), q as (select distinct graphId, filePath, unnest([c.name] || list_transform(coalesce(c.methods, []), lambda m: c.name || '.' || m)) as qualname from c),
      k as (select * from q where qualname is not null), p as (select k.*, (select max(a.qualname) from k a where a.graphId = k.graphId and a.filePath = k.filePath and starts_with(k.qualname, a.qualname || '.') and length(a.qualname) = (select max(length(b.qualname)) from k b where b.graphId = k.graphId and b.filePath = k.filePath and starts_with(k.qualname, b.qualname || '.'))) as parent from k)
      select graphId, case when parent is null then 'file:' || filePath else 'symbol:' || parent end as container, count(*) as n from p group by 1, 2""",
    "b21_import_map": "select distinct graphId, filePath as source, i.source as target, 0.7::double as weight from (select graphId, filePath, unnest(imports) as i from fingerprints) where i.source is not null",
    "n11_inferred_types": f"select case when starts_with(id, 'func:') then 'function' when contains(id, ':') and split_part(id, ':', 1) in ({_IN(B.BATCH_PREFIXES)}) then split_part(id, ':', 1) else 'file' end as type, count(*) as n from (select unnest([source, target]) as id from edges) where id is not null group by 1",
    "n12_batch_ids": f"""with p(p) as (values {', '.join(f"('{x}')" for x in B.BATCH_PREFIXES)}),
      a as (select n.*, case when p.p is not null then substr(id, length(p.p) + 2) else id end as one from nodes n left join p on starts_with(n.id, p.p || ':' || p.p || ':') where id is not null),
      b as (select *, case when not regexp_matches(one, '^(?:{_ANY}):') and regexp_matches(one, '^[^:]+:(?:{_ANY}):') then substr(one, position(':' in one) + 1) else one end as two from a),
      c as (select *, case when starts_with(two, 'func:') then 'function:' || substr(two, 6) else two end as three, case when type = 'func' then 'function' when type in ({_IN(B.BATCH_PREFIXES)}) then type else 'file' end as kind from b)
      select node_row, case when regexp_matches(three, '^(?:{_ANY}):') then three when type in ('function', 'class') then kind || ':' || (case when coalesce(filePath, '') <> '' then filePath else '__nofilepath__' end) || ':' || coalesce(name, three) else kind || ':' || three end as bid from c""",
    "n17_knowledge_nodes": f"with {values(B.KNOWLEDGE_NODE_ALIASES, 'ka')} select case when coalesce(v, t) in ({_IN(B.KNOWLEDGE_NODE_TYPES)}) then coalesce(v, t) end as type, count(*) as n from (select lower(trim(type)) as t from nodes) left join ka on ka.k = t group by 1",
    "n17_knowledge_edges": f"with {values(B.KNOWLEDGE_EDGE_ALIASES, 'ka')} select case when coalesce(v, t) in ({_IN(B.KNOWLEDGE_EDGE_TYPES)}) then coalesce(v, t) else 'related' end as type, count(*) as n from (select lower(trim(type)) as t from edges) left join ka on ka.k = t group by 1",
    "n18_entity_names": "select graphId, regexp_replace(lower(trim(name)), '\\s+', ' ', 'g') as name, count(*) as n from nodes where name is not null group by 1, 2",
    "n19_definition_types": f"with {values(B.KIND_TO_TYPE, 'kt')} select coalesce(v, 'concept') as type, count(*) as n from nodes left join kt on kt.k = type group by 1",
    "i2_signatures": "select fp_row, f.name as name, array_to_string(list_transform(coalesce(f.params, []), lambda p: coalesce(p, '')), ',') as params, f.returnType as return_type, coalesce(f.exported, false) or coalesce(list_contains(exports, f.name), false) as exported, f.lineCount as lines from (select fp_row, exports, unnest(functions) as f from fingerprints)",
    "i4_store": "select fp_row, lower(trim(contentHash)) as hash, coalesce(hasStructuralAnalysis, false) as analysed, case when hasStructuralAnalysis then coalesce(len(functions), 0)::int end as n_functions from fingerprints",
    "g31_digests": "select fp_row, sha256('{\"contentHash\":' || coalesce(to_json(contentHash)::varchar, 'null') || ',\"filePath\":' || coalesce(to_json(filePath)::varchar, 'null') || ',\"graphId\":' || coalesce(to_json(graphId)::varchar, 'null') || ',\"snapshot_no\":' || coalesce(snapshot_no::varchar, 'null') || ',\"totalLines\":' || coalesce(totalLines::varchar, 'null') || '}') as digest from fingerprints",
}
