"""Queries of fingerprints, texts, consensus and merging, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import canonical_path, dirname
from graphloom.operators import consensus, incremental, merge, normalize, text
from graphloom.plans.base import BASE, Graphs
from graphloom.session import table


def i1_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_row", F.sha2("content", 256).alias("hash"))


def i3_changes(spark: SparkSession, d: str) -> DataFrame:
    return incremental.compare_fingerprints(table(spark, d, "fingerprints"))


def i6_decisions(spark: SparkSession, d: str) -> DataFrame:
    return incremental.classify_update(i3_changes(spark, d))


def i10_freshness(spark: SparkSession, d: str) -> DataFrame:
    return incremental.freshness(table(spark, d, "fingerprints"), table(spark, d, "graphs"))


def s4_line_counts(spark: SparkSession, d: str) -> DataFrame:
    total, filled = text.line_counts(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.newline_count(F.col("text")).alias("newlines"), total.alias("n_lines"), filled.alias("n_filled"))


def s9_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fingerprints").select("fp_row", canonical_path(F.col("filePath")).alias("path"))


def s13_missing_parts(spark: SparkSession, d: str) -> DataFrame:
    return merge.missing_parts(table(spark, d, "fingerprints").select("graphId", "snapshot_no"), ["graphId"], "snapshot_no")


def s23_capped(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select("graphId", "path").distinct().withColumn("folder", dirname(F.col("path")))
    return merge.capped(f, ["graphId", "folder"], ["path"], 5)


def g32_document_stats(spark: SparkSession, d: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return table(spark, d, "documents").groupBy(F.lower(F.trim("lang")).alias("lang")).agg(F.count("*").alias("n_docs"), F.sum(words).alias("n_words"), F.sum(F.length("text")).alias("n_chars"))


def w1_sections(spark: SparkSession, d: str) -> DataFrame:
    return text.sections(text.lines_of(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


def w5_headings(spark: SparkSession, d: str) -> DataFrame:
    h = text.heading_of_lines(text.lines_of(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    return h.where("heading is not null").groupBy("doc_id", "heading").agg(F.count("*").alias("n_lines"))


def l1_wikilinks(spark: SparkSession, d: str) -> DataFrame:
    return text.wikilinks(table(spark, d, "nodes").select("node_row", "knowledgeMeta.content"), "node_row", "content")


def w4_bins(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").groupBy("graphId", "path").agg(F.max("sizeBytes").alias("bytes"))
    return text.greedy_bins(f, ["graphId"], ["path"], "bytes", 60_000)


def q7_direction_consensus(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").where("source is not null and target is not null").select("graphId", "source", "target", normalize.direction(F.col("direction")).alias("direction"), "batch_ord", "edge_row")
    return consensus.consensus(e, ["graphId", "source", "target"], "direction", "batch_ord", "edge_row")


def q5_quorum(spark: SparkSession, d: str) -> DataFrame:
    return consensus.quorum(table(spark, d, "nodes"), ["graphId"], "summary", "batch_ord", 2)


def g19_type_mode(spark: SparkSession, d: str) -> DataFrame:
    return consensus.first_mode(table(spark, d, "edges").where("source is not null").select("graphId", "source", F.lower("type").alias("type"), "edge_row"), ["graphId", "source"], "type", "edge_row")


def g21_tag_index(spark: SparkSession, d: str) -> DataFrame:
    t = Graphs(spark, d).nodes.select(F.concat("graphId", F.lit("/"), "id").alias("member"), F.explode("tags").alias("tag"))
    return consensus.inverted_index(t, "tag", "member", 2, 40)


def j17_neighbours(spark: SparkSession, d: str) -> DataFrame:
    t = Graphs(spark, d).nodes.select("graphId", "id", F.explode("tags").alias("tag"))
    return consensus.ranked_neighbours(t, "graphId", "tag", "id", 5).drop("place")


def g25_layers(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_layers(table(spark, d, "layers")).withColumn("nodeIds", F.array_join("nodeIds", "|"))


def g27_project(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_projects(table(spark, d, "graphs"))


def f8_tests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_row", merge.is_test_path(F.col("path")).alias("is_test"))


def r23_test_pairs(spark: SparkSession, d: str) -> DataFrame:
    g = Graphs(spark, d)
    return merge.pair_tests(g.edges, g.nodes)


def b2_build(spark: SparkSession, d: str) -> DataFrame:
    fp = incremental.latest_fingerprints(table(spark, d, "fingerprints"))
    nodes, edges = merge.build_graph(table(spark, d, "source_files"), fp)
    return nodes.groupBy("graphId", "type").agg(F.count("*").alias("n")).unionByName(edges.groupBy("graphId", F.concat(F.lit("edge:"), "type").alias("type")).agg(F.count("*").alias("n")))


def u3_new_functions(spark: SparkSession, d: str) -> DataFrame:
    fp = incremental.latest_fingerprints(table(spark, d, "fingerprints"))
    first = fp.groupBy("graphId", "path").agg(F.min_by("functions", "snapshot_no").alias("a"), F.max_by("functions", "snapshot_no").alias("b"))
    names = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast(incremental.F_FUNCS)), lambda f: f["name"]))
    out = first.select("graphId", "path", F.array_join(F.array_sort(F.array_except(names("b"), names("a"))), ",").alias("new"), F.array_join(F.array_sort(F.array_except(names("a"), names("b"))), ",").alias("removed"))
    return out.where("new <> '' or removed <> ''")


QUERIES = {
    f.__name__: f
    for f in (
        i1_hashes, i3_changes, i6_decisions, i10_freshness, s4_line_counts, s9_paths, s13_missing_parts, s23_capped, g32_document_stats, w1_sections, w5_headings, l1_wikilinks, w4_bins,
        q7_direction_consensus, q5_quorum, g19_type_mode, g21_tag_index, j17_neighbours, g25_layers, g27_project, f8_tests, r23_test_pairs, b2_build, u3_new_functions,
    )
}

_B = BASE.rstrip()
_PATH = "regexp_replace(regexp_replace(replace(filePath, '\\', '/'), '/+', '/', 'g'), '^(\\./|/)+', '')"
_FP = f"""with fl as (select *, {_PATH} as path, nullif(regexp_replace(lower(trim(contentHash)), '^sha-?256:\\s*', ''), '') as hash from fingerprints),
  fp as (select * from fl qualify row_number() over (partition by graphId, snapshot_no, path order by deliveredAt desc, fp_row desc) = 1)"""
_I3 = _FP + """, sn as (select graphId, snapshot_no, lag(snapshot_no) over (partition by graphId order by snapshot_no) as prev from (select distinct graphId, snapshot_no from fp)),
  sg as (select graphId, snapshot_no, path, hash, coalesce(hasStructuralAnalysis, false) as an, list_sort(list_transform(coalesce(functions, []), lambda x: (x.name, x.params, x.returnType, x.exported)::varchar)) as fns,
    list_sort(list_transform(classes, lambda x: x.name)) as cls, list_sort(list_transform(imports, lambda x: x.source)) as imp, list_sort(exports) as xp, coalesce(list_sum(list_transform(functions, lambda x: coalesce(x.lineCount, 0))), 0) as lines from fp),
  nn as (select sg.* from sg join sn using (graphId, snapshot_no) where prev is not null), oo as (select sn.snapshot_no as next_no, sg.* from sn join sg on sg.graphId = sn.graphId and sg.snapshot_no = sn.prev),
  i3 as (select coalesce(nn.graphId, oo.graphId) as graphId, coalesce(nn.snapshot_no, oo.next_no) as snapshot_no, coalesce(nn.path, oo.path) as path, case when oo.path is null then 'new' when nn.path is null then 'deleted' else 'kept' end as change,
    case when oo.path is null or nn.path is null then 'STRUCTURAL' when nn.hash = oo.hash then 'NONE' when not nn.an or not oo.an then 'STRUCTURAL' when nn.fns is distinct from oo.fns or nn.cls is distinct from oo.cls or nn.imp is distinct from oo.imp or nn.xp is distinct from oo.xp
      or coalesce(nn.lines / nullif(oo.lines, 0) > 1.5 or nn.lines / nullif(oo.lines, 0) < 0.5, false) then 'STRUCTURAL' else 'COSMETIC' end as level
    from nn full join oo on nn.graphId = oo.graphId and nn.snapshot_no = oo.next_no and nn.path = oo.path)"""
_LINES = "with ln as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)::int as line_no from documents where text is not null)"
_HEAD = "regexp_matches(line, '^#{1,6} +\\S')"
_TITLE = "trim(regexp_extract(line, '^#+ +(.*)$', 1))"
_TEST = "(regexp_matches(b, '(?:\\.|_)(?:test|spec)\\.[jt]sx?$') or regexp_matches(b, '^test_.*\\.py$') or regexp_matches(b, '_test\\.(?:py|go|rb|exs)$') or regexp_matches(b, '(?:Test|Tests|IT|Spec)\\.(?:java|kt|scala|cs|swift|php)$') or regexp_matches(b, '_spec\\.rb$') or regexp_matches('/' || p, '/(?:__tests__|tests?|spec)/'))"
_DIR = "case when coalesce(direction, '') = '' then 'forward' when lower(direction) in ('to', 'outbound') then 'forward' when lower(direction) in ('from', 'inbound') then 'backward' when lower(direction) in ('both', 'mutual') then 'bidirectional' else lower(direction) end"
ORACLE = {
    "i1_hashes": "select file_row, sha256(content) as hash from source_files",
    "i3_changes": _I3 + " select * from i3",
    "i6_decisions": _I3 + """, tp as (select graphId, snapshot_no, bool_or(b = 0) as new_top from (select graphId, snapshot_no, case when contains(path, '/') then split_part(path, '/', 1) else '' end as top, count(*) filter (change <> 'new') as b from i3 group by 1, 2, 3) group by 1, 2),
      c as (select graphId, snapshot_no, count(*) filter (level = 'STRUCTURAL') as n_structural, count(*) filter (level = 'COSMETIC') as n_cosmetic, count(*) filter (level = 'NONE') as n_same, count(*) as n_files from i3 group by 1, 2)
      select c.*, case when n_structural = 0 then 'SKIP' when n_structural > 30 or n_structural > 0.5 * n_files then 'FULL' when new_top or n_structural > 10 then 'ARCHITECTURE' else 'PARTIAL' end as action from c join tp using (graphId, snapshot_no)""",
    "i10_freshness": "with l as (select graphId, arg_max(gitCommitHash, (snapshot_no, generatedAt)) as head, list(distinct gitCommitHash) as known from fingerprints group by 1) select g.graphId, case when head is null then 'unknown' when g.gitCommitHash = head then 'fresh' when list_contains(known, g.gitCommitHash) then 'stale' else 'unknown' end as status from graphs g left join l using (graphId)",
    "s4_line_counts": "select doc_id, length(text) - length(replace(text, chr(10), '')) as newlines, case when length(text) = 0 then 0 when ends_with(text, chr(10)) then len(string_split(text, chr(10))) - 1 else len(string_split(text, chr(10))) end as n_lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(replace(x, chr(13), '')) <> '')) as n_filled from documents",
    "s9_paths": f"select fp_row, {_PATH} as path from fingerprints",
    "s13_missing_parts": "with m as (select graphId, max(snapshot_no) as top from fingerprints group by 1), s as (select graphId, unnest(range(1, greatest(top, 1) + 1))::int as missing from m) select * from s where (graphId, missing) not in (select (graphId, snapshot_no) from fingerprints)",
    "s23_capped": "select graphId, path, folder from (select *, row_number() over (partition by graphId, folder order by path) as r from (select distinct graphId, path, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as folder from source_files)) where r <= 5",
    "g32_document_stats": "select lower(trim(lang)) as lang, count(*) as n_docs, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::bigint as n_words, sum(length(text))::bigint as n_chars from documents group by 1",
    "w1_sections": _LINES + f", f as (select *, regexp_matches(line, '^\\s*(?:```|~~~)') as fence, max(line_no) over (partition by doc_id) as n_lines from ln), c as (select *, fence or sum(fence::int) over (partition by doc_id order by line_no) % 2 = 1 as in_code from f), h as (select * from c where not in_code and {_HEAD}) select doc_id, length(regexp_extract(line, '^(#+)', 1)) as level, {_TITLE} as title, line_no as first_line, coalesce(lead(line_no) over (partition by doc_id order by line_no) - 1, n_lines) as last_line from h",
    "w5_headings": _LINES + f", h as (select *, last_value(case when {_HEAD} then {_TITLE} end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as heading from ln) select doc_id, heading, count(*) as n_lines from h where heading is not null group by 1, 2",
    "l1_wikilinks": "with w as (select node_row, regexp_extract_all(knowledgeMeta.content, '\\[\\[([^\\[\\]|\\n]+)(?:\\|[^\\[\\]\\n]*)?\\]\\]', 1) as l from nodes where knowledgeMeta.content is not null) select node_row, (generate_subscripts(l, 1) - 1)::int as pos, trim(unnest(l)) as target from w",
    "w4_bins": """with recursive f as (select graphId, path, max(sizeBytes) as bytes, row_number() over (partition by graphId order by path) as k from source_files group by 1, 2),
      b as (select graphId, path, bytes, k, 0 as bin, bytes as used from f where k = 1 union all select f.graphId, f.path, f.bytes, f.k, case when b.used + f.bytes <= 60000 then b.bin else b.bin + 1 end, case when b.used + f.bytes <= 60000 then b.used + f.bytes else f.bytes end from b join f on f.graphId = b.graphId and f.k = b.k + 1) select graphId, path, bytes, bin from b""",
    "q7_direction_consensus": f"""with v as (select graphId, source, target, {_DIR} as direction, batch_ord, edge_row from edges where source is not null and target is not null), p as (select graphId, source, target, direction, count(distinct batch_ord) as n, min(edge_row) as f from v group by 1, 2, 3, 4),
      r as (select *, sum(n) over w as al, count(*) over w as kinds, row_number() over (partition by graphId, source, target order by n desc, f) as place from p window w as (partition by graphId, source, target))
      select graphId, source, target, direction, n as support, al::bigint as n_votes, case when al = 1 then 'single' when kinds = 1 then 'unanimous' when n * 2 > al then 'majority' else 'split' end as agreement from r where place = 1""",
    "q5_quorum": "select graphId, regexp_replace(lower(trim(summary)), '\\s+', ' ', 'g') as norm, min(summary) as summary, count(distinct batch_ord) as n_voters from nodes where coalesce(regexp_replace(lower(trim(summary)), '\\s+', ' ', 'g'), '') <> '' group by 1, 2 having count(distinct batch_ord) >= 2",
    "g19_type_mode": "select graphId, source, arg_max(type, (n, -f)) as type from (select graphId, source, lower(type) as type, count(*) as n, min(edge_row) as f from edges where source is not null group by 1, 2, 3) group by 1, 2",
    "g21_tag_index": _B + ", t as (select graphId || '/' || id as member, unnest(tags) as tag from n) select tag, count(distinct member) as n_members from t where tag is not null group by 1 having count(distinct member) between 2 and 40",
    "j17_neighbours": _B + ", t as (select distinct graphId, id, tag from (select graphId, id, unnest(tags) as tag from n) where tag is not null), s as (select graphId, tag, count(*) as df from t group by 1, 2 having count(*) between 2 and 40), p as (select a.graphId, a.id, b.id as other, round(sum(10.0::double / df), 6) as score from t a join s using (graphId, tag) join t b on b.graphId = a.graphId and b.tag = a.tag and b.id <> a.id group by 1, 2, 3) select * from p qualify row_number() over (partition by graphId, id order by score desc, other) <= 5",
    "g25_layers": "with f as (select graphId, id, arg_min(struct_pack(a := name, b := description), layer_row) as v from layers group by 1, 2), m as (select graphId, id, ref, min((layer_row, pos)) as at from (select graphId, id, layer_row, unnest(nodeIds) as ref, generate_subscripts(nodeIds, 1) as pos from layers) where ref is not null group by 1, 2, 3) select f.graphId, f.id, f.v.a as name, f.v.b as description, coalesce((select string_agg(ref, '|' order by m.at, ref) from m where m.graphId = f.graphId and m.id = f.id), '') as nodeIds from f",
    "g27_project": "select arg_max(name, graphId) filter (coalesce(name, '') <> '') as name, max(analyzedAt) as analyzedAt, count(*) as n_graphs, (select string_agg(x, ',' order by x) from (select distinct unnest(languages) as x from graphs)) as languages, (select string_agg(x, ',' order by x) from (select distinct unnest(frameworks) as x from graphs)) as frameworks from graphs",
    "f8_tests": f"select file_row, {_TEST} as is_test from (select file_row, path as p, split_part(path, '/', -1) as b from source_files)",
    "r23_test_pairs": _B + f""", c as (select graphId, id, {_TEST} as t from (select graphId, id, filePath as p, split_part(filePath, '/', -1) as b from n where filePath is not null)),
      q as (select e.graphId, case when s.t and not t.t then e.target else e.source end as production, case when s.t and not t.t then e.source else e.target end as test, e.weight, e.edge_ord, s.t and not t.t as flipped from e join c s on s.graphId = e.graphId and s.id = e.source join c t on t.graphId = e.graphId and t.id = e.target where e.type = 'tested_by' and s.t <> t.t)
      select graphId, production, test, round(weight, 6) as weight, flipped from q qualify row_number() over (partition by graphId, production, test order by weight desc, edge_ord) = 1""",
    "b2_build": _FP + """, sf as (select distinct graphId, path from source_files), c as (select distinct graphId, path, 'function' as type, unnest(list_transform(functions, lambda x: x.name)) as name from fp union select distinct graphId, path, 'class', unnest(list_transform(classes, lambda x: x.name)) from fp),
      k as (select c.* from c join sf using (graphId, path) where name is not null) select graphId, 'file' as type, count(*) as n from sf group by 1 union all select graphId, type, count(*) from k group by 1, 2 union all select graphId, 'edge:contains', count(*) from k group by 1""",
    "u3_new_functions": _FP + """, x as (select graphId, path, list_distinct(list_transform(coalesce(arg_min(struct_pack(f := functions), snapshot_no).f, []), lambda f: f.name)) as a, list_distinct(list_transform(coalesce(arg_max(struct_pack(f := functions), snapshot_no).f, []), lambda f: f.name)) as b from fp group by 1, 2),
      y as (select graphId, path, array_to_string(list_sort(list_filter(b, lambda v: not list_contains(a, v))), ',') as new, array_to_string(list_sort(list_filter(a, lambda v: not list_contains(b, v))), ',') as removed from x) select * from y where new <> '' or removed <> ''""",
}
