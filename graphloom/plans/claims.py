"""Queries of claims, votes and timelines, with SQL. Edges stand for claims, their batches for passes, their direction for a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import claims as C
from graphloom.operators.intervals import asof_next
from graphloom.plans.base import BASE, Graphs
from graphloom.session import table

_KEY = ["graphId", "source", "target", "type"]


def _votes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").where("source is not null and target is not null and type is not null")
    said = F.when(F.col("direction").isin("forward", "to"), "supported").when(F.col("direction") == "both", "contradicted").when(F.col("direction") == "bidirectional", "overstated").otherwise(F.col("direction"))
    verified = F.col("weight").isNotNull() & ~F.isnan("weight")
    return e.select(*_KEY, F.col("batch_ord").alias("voter"), said.alias("original"), C.resolved_verdict(said, verified).alias("verdict"), "arrivedAt", "edge_row")


def _expected(spark: SparkSession, d: str) -> DataFrame:
    dropped = table(spark, d, "dropped_edges").where("source is not null and target is not null and type is not null").select(*_KEY)
    return _votes(spark, d).select(*_KEY).union(dropped).distinct()


def _consensus(spark: SparkSession, d: str) -> DataFrame:
    return C.ranked_consensus(_expected(spark, d), _votes(spark, d), _KEY, "graphId")


def q6_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _votes(spark, d).groupBy("graphId", "original", "verdict").agg(F.count("*").alias("n"))


def q7_consensus(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)


def q8_adjudicated(spark: SparkSession, d: str) -> DataFrame:
    v = _votes(spark, d)
    rulings = C.latest_vote(v, _KEY, ["arrivedAt", "edge_row"]).join(C.disputed(v, _KEY).select(*_KEY), _KEY, "left_semi")
    return C.adjudicated(_consensus(spark, d), rulings, _KEY)


def q9_disputed(spark: SparkSession, d: str) -> DataFrame:
    return C.disputed(_votes(spark, d), _KEY)


def g30_tallies(spark: SparkSession, d: str) -> DataFrame:
    return C.tallies(_consensus(spark, d).withColumn("type", F.lower("type")), "type")


def g18_support(spark: SparkSession, d: str) -> DataFrame:
    return C.support_histogram(_votes(spark, d), _KEY, "voter")


def f9_claim_types(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the wanted types, and the others kept apart rather than lost."""
    t = F.lower("type")
    return _expected(spark, d).select("graphId", t.alias("type"), t.isin("calls", "imports", "depends_on").alias("kept")).groupBy("graphId", "type", "kept").agg(F.count("*").alias("n"))


def f10_principles(spark: SparkSession, d: str) -> DataFrame:
    """Articles that at least two links of weight 0.5 or more lead to."""
    g = Graphs(spark, d)
    e = g.edges.where("weight >= 0.5").join(g.nodes.where("type = 'article'").select("graphId", F.col("id").alias("target")), ["graphId", "target"], "left_semi")
    return e.groupBy("graphId", "target").agg(F.count("*").alias("n")).where("n >= 2")


def z6_roles(spark: SparkSession, d: str) -> DataFrame:
    n = Graphs(spark, d).nodes.select("graphId", C.roles(F.col("summary")).alias("r"))
    return n.groupBy("graphId", F.col("r")[0].alias("primary"), F.array_join("r", ",").alias("roles")).agg(F.count("*").alias("n"))


def z6_symbols(spark: SparkSession, d: str) -> DataFrame:
    n = Graphs(spark, d).nodes.select("graphId", F.explode(C.symbols(F.col("summary"))).alias("symbol"))
    return n.groupBy("graphId", "symbol").agg(F.count("*").alias("n"))


def g21_symbol_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = Graphs(spark, d).nodes.select("graphId", F.col("id").alias("claim"), F.col("type").alias("part"), F.col("summary").alias("text"))
    return C.symbol_blocks(n)


def g28_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return C.collapsed(table(spark, d, "nodes"), ["graphId"], "summary", "node_row")


def j16_contained(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").where("op = 'upsert' and size(lineRange) = 2 and filePath is not null").select("graphId", "filePath", F.lower("type").alias("type"), F.col("lineRange")[0].alias("a"), F.col("lineRange")[1].alias("b"), "node_row")
    inner = n.where("type = 'function'").select("graphId", "filePath", F.col("a").alias("start"), F.col("b").alias("stop"), F.col("node_row").alias("inner_id"))
    outer = n.where("type = 'class'").select("graphId", "filePath", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("node_row").alias("outer_id"))
    return C.contained(inner, outer, ["graphId", "filePath"])


def j6_linkage(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "dropped_edges").select("graphId", F.explode(F.array("source", "target")).alias("ref")).where("ref is not null")
    return C.linked(refs, Graphs(spark, d).nodes)


def g29_principles(spark: SparkSession, d: str) -> DataFrame:
    return C.merged_principles(table(spark, d, "nodes").where("op = 'upsert' and name is not null and lower(type) = 'article'"))


def g23_terms(spark: SparkSession, d: str) -> DataFrame:
    return C.shared_terms(Graphs(spark, d).nodes)


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("graphId is not null").select("doc_id", "graphId", F.col("updatedAt").alias("at"))
    snaps = table(spark, d, "fingerprints").where("generatedAt is not null").select("graphId", F.col("generatedAt").alias("made"), F.col("snapshot_no").alias("release")).distinct()
    return asof_next(docs, snaps, ["graphId"], "at", "made", ["release"]).select("doc_id", "graphId", F.col("next_release").alias("release"))


def q13_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The first snapshot of a document's graph that was made at or after its last change."""
    return _timeline(spark, d)


def g22_series(spark: SparkSession, d: str) -> DataFrame:
    return C.series_viability(_timeline(spark, d), "graphId", "release")


QUERIES = {
    f.__name__: f
    for f in (
        q6_verdicts, q7_consensus, q8_adjudicated, q9_disputed, g30_tallies, g18_support, f9_claim_types, f10_principles, z6_roles, z6_symbols, g21_symbol_blocks, g28_collapsed, j16_contained,
        j6_linkage, g29_principles, g23_terms, q13_timeline, g22_series,
    )
}

_B = BASE.rstrip()
_V = """v0 as (select *, case when direction in ('forward', 'to') then 'supported' when direction = 'both' then 'contradicted' when direction = 'bidirectional' then 'overstated' else direction end as original, weight is not null and not isnan(weight) as fine from edges where source is not null and target is not null and type is not null),
 v as (select graphId, source, target, type, batch_ord as voter, original, arrivedAt, edge_row, case when original in ('overstated', 'supported', 'contradicted') and not fine then 'unverifiable' when original = 'overstated' then 'supported' when original in ('supported', 'contradicted') then original else 'unverifiable' end as verdict from v0),
 x as (select distinct graphId, source, target, type from (select graphId, source, target, type from v union all select graphId, source, target, type from dropped_edges where source is not null and target is not null and type is not null)),
 pv as (select graphId, source, target, type, verdict, count(distinct voter) as n, case verdict when 'contradicted' then 0 when 'unverifiable' then 1 else 2 end as rk from v group by all),
 tp as (select graphId, source, target, type, arg_max(verdict, (n, -rk)) as verdict, max(n) as n, sum(n)::bigint as total from pv group by 1, 2, 3, 4), sn as (select graphId, count(distinct voter) as k from v group by 1),
 cs as (select x.*, tp.verdict, case when total is null then 'missing' when n = total and total >= k and k > 1 then 'unanimous' when n * 2 > total then 'majority' else 'split' end as agreement, coalesce(n, 0) as n_top, coalesce(total, 0) as n_votes from x left join tp using (graphId, source, target, type) left join sn using (graphId)),
 ds as (select graphId, source, target, type, count(*) as n_votes, count(distinct verdict) as n_verdicts from v group by 1, 2, 3, 4 having count(*) >= 2 and count(distinct verdict) > 1)"""
_ROLES = "list_filter([" + ", ".join("case when regexp_matches(coalesce(summary, ''), '" + p.replace("'", "''") + "') then '" + r + "' end" for r, p in C.ROLE_PATTERNS.items()) + "], lambda r: r is not null)"
_ALL = " || ".join(f"regexp_extract_all(summary, '{p}', 1)" for p in C.SYMBOL_PATTERNS)
_STOP = ", ".join(repr(s) for s in C.SYMBOL_STOP)
_SYM = f", sy0 as (select *, list_filter({_ALL}, lambda s: length(s) >= 4 and lower(s) not in ({_STOP})) as kept from n), sy as (select graphId, id, type, summary, unnest(list_distinct(kept || list_transform(list_filter(kept, lambda s: contains(s, '.')), lambda s: split_part(s, '.', -1)))) as symbol from sy0)"
_TL = ", fs as (select distinct graphId, generatedAt as made, snapshot_no as release from fingerprints where generatedAt is not null), tl as (select doc_id, d.graphId, arg_min(release, (made, release)) as release from documents d left join fs on fs.graphId = d.graphId and fs.made >= d.updatedAt where d.graphId is not null group by 1, 2)"
ORACLE = {
    "q6_verdicts": f"with {_V} select graphId, original, verdict, count(*) as n from v group by 1, 2, 3",
    "q7_consensus": f"with {_V} select * from cs",
    "q8_adjudicated": f"with {_V}, ru as (select graphId, source, target, type, arg_max(v.verdict, (arrivedAt, edge_row)) as ruling from v join ds using (graphId, source, target, type) group by 1, 2, 3, 4) select graphId, source, target, type, coalesce(ruling, verdict) as verdict, case when ruling is not null then 'adjudicated' else agreement end as agreement, coalesce(ruling <> verdict, false) as overruled from cs left join ru using (graphId, source, target, type)",
    "q9_disputed": f"with {_V} select * from ds",
    "g30_tallies": f"with {_V} select verdict, lower(type) as type, count(*) as n, grouping(verdict, lower(type))::int as margin from cs where verdict is not null group by cube (verdict, lower(type))",
    "g18_support": f"with {_V} select support, count(*) as n_claims from (select count(distinct voter) as support from v group by graphId, source, target, type) group by 1",
    "f9_claim_types": f"with {_V} select graphId, lower(type) as type, lower(type) in ('calls', 'imports', 'depends_on') as kept, count(*) as n from x group by 1, 2, 3",
    "f10_principles": BASE + "select e.graphId, e.target, count(*) as n from e join n on n.graphId = e.graphId and n.id = e.target and n.type = 'article' where e.weight >= 0.5 group by 1, 2 having count(*) >= 2",
    "z6_roles": _B + f", r as (select graphId, {_ROLES} as r from n), q as (select graphId, case when len(r) > 0 then r else ['mechanism'] end as r from r) select graphId, r[1] as primary, array_to_string(r, ',') as roles, count(*) as n from q group by 1, 2, 3",
    "z6_symbols": _B + _SYM + " select graphId, symbol, count(*) as n from sy group by 1, 2",
    "g21_symbol_blocks": _B + _SYM + f" select graphId, symbol, count(distinct id) as n_claims, count(distinct type) > 1 as crosses from sy group by 1, 2 having count(distinct id) between 2 and 40 and max(len({_ROLES})) > 0",
    "g28_collapsed": "with c as (select graphId, node_row, regexp_replace(lower(trim(summary)), '\\s+', ' ', 'g') as t from nodes) select graphId, node_row, min(node_row) over (partition by graphId, t) as first from c where coalesce(t, '') <> ''",
    "j16_contained": "with q as (select graphId, filePath, lower(type) as type, lineRange[1] as a, lineRange[2] as b, node_row from nodes where op = 'upsert' and len(lineRange) = 2 and filePath is not null) select i.node_row as inner_id, o.node_row as outer_id from q i join q o using (graphId, filePath) where i.type = 'function' and o.type = 'class' and i.a <= i.b and o.a <= o.b and i.a >= o.a - 3 and i.b <= o.b + 3",
    "j6_linkage": _B + ", rf1 as (select distinct graphId, ref, split_part(ref, ':', 2) as p, split_part(split_part(ref, ':', 3), '.', 1) as c, len(string_split(ref, ':')) as k from (select graphId, unnest([source, target]) as ref from dropped_edges) where ref is not null) select r.graphId, r.ref, coalesce(a.id, b.id, f.id) as node, case when a.id is not null then 'exact' when b.id is not null then 'class' when f.id is not null then 'file' else 'none' end as how from rf1 r left join n a on a.graphId = r.graphId and a.id = r.ref left join n b on r.k > 2 and b.graphId = r.graphId and b.id = 'class:' || r.p || ':' || r.c left join n f on r.k > 1 and f.graphId = r.graphId and f.id = 'file:' || r.p",
    "g29_principles": "with p as (select graphId, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, node_row, batch_ord, tags from nodes where op = 'upsert' and name is not null and lower(type) = 'article'), t as (select graphId, slug, count(distinct tag) as n_tags, min(tag) as first_tag from (select graphId, slug, unnest(tags) as tag from p) where tag is not null group by 1, 2) select p.graphId, p.slug, count(distinct node_row) as n_rows, count(distinct batch_ord) as n_batches, coalesce(any_value(n_tags), 0) as n_tags, any_value(first_tag) as first_tag from p left join t using (graphId, slug) group by 1, 2",
    "g23_terms": BASE + "select name as term, count(distinct graphId) as n_graphs, count(distinct summary) as n_bodies, min(summary) as body from n where name is not null and summary is not null group by 1 having count(distinct graphId) >= 2 and count(distinct summary) >= 2",
    "q13_timeline": "with z as (select 1)" + _TL + " select * from tl",
    "g22_series": "with z as (select 1)" + _TL + ", p as (select graphId, release, count(*) as n from tl group by 1, 2) select graphId, sum(n)::bigint as n_units, coalesce(sum(n) filter (release is null), 0)::bigint as n_unknown, count(release) as n_series, arg_max(release, (n, -release)) filter (release is not null) as largest, round(coalesce(max(n) filter (release is not null), 0) / sum(n), 6) as share, (coalesce(sum(n) filter (release is not null), 0) - coalesce(max(n) filter (release is not null), 0))::bigint as n_outside from p group by 1",
}
