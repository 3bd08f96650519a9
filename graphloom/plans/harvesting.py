"""Queries of documentation units, orders and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import harvest as H
from graphloom.plans.base import BASE, Graphs
from graphloom.session import table

_LEVEL = {"missing-both": 0, "missing-source": 1, "missing-target": 1}


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").where("path like '%.py'").groupBy("graphId", "path").agg(F.max_by("content", "fetchedAt").alias("content"))
    return H.python_symbols(f)


def q1_units(spark: SparkSession, d: str) -> DataFrame:
    return H.doc_units(_symbols(spark, d))


def q2_findings(spark: SparkSession, d: str) -> DataFrame:
    return H.field_findings(_symbols(spark, d))


def q4_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Folders as subsystems: files, documented symbols and undocumented ones of Python."""
    s = _symbols(spark, d).where("kind <> 'module'")
    folder = F.when(F.instr("path", "/") > 0, F.split("path", "/")[0]).otherwise("~")
    return s.groupBy("graphId", folder.alias("scope")).agg(F.countDistinct("path").alias("n_files"), F.count_if(F.col("doc").isNotNull()).alias("n_documented"), F.count_if(F.col("doc").isNull()).alias("n_bare"))


def g33_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Calls in Python functions that a call edge of the file's nodes names too."""
    g = Graphs(spark, d)
    e = g.edges.where("type = 'calls'").join(g.nodes.select("graphId", F.col("id").alias("source"), F.col("filePath").alias("path")), ["graphId", "source"]).join(g.nodes.select("graphId", F.col("id").alias("target"), "name"), ["graphId", "target"])
    return H.call_coverage(_symbols(spark, d), e.select("graphId", "path", "name"))


def q15_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Lines and characters of Python files before and after their docstrings are taken out."""
    strip = F.udf(H.without_docstrings, "string")
    f = table(spark, d, "source_files").where("path like '%.py' and content is not null").select("file_row", "content").withColumn("bare", strip("content"))
    lines = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    return f.select("file_row", lines("content").alias("n_lines"), lines("bare").alias("n_lines_bare"), (F.length("content") >= F.length("bare") - 1000).alias("ok"))


def g34_issues(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each graph in order of weight, as one text."""
    x = Graphs(spark, d).normalized.dropped
    rank = F.create_map(*[F.lit(v) for k, r in _LEVEL.items() for v in (k, r)])[F.col("reason")]
    c = x.groupBy("graphId", "reason").agg(F.count("*").alias("n")).withColumn("rank", rank)
    line = F.concat(F.col("n").cast("string"), F.lit(" edges dropped: "), F.col("reason"))
    return c.groupBy("graphId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "reason", line.alias("line")))), lambda v: v["line"]), "\n").alias("summary"))


def o10_sorted_tree(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each folder, folders first, then by name."""
    from graphloom.operators.views import file_tree

    t = file_tree(Graphs(spark, d).nodes).select("graphId", "path", "parent", "kind")
    return t.withColumn("place", F.row_number().over(Window.partitionBy("graphId", "parent").orderBy(F.desc(F.col("kind") == "folder"), F.element_at(F.split("path", "/"), -1), "path")))


def o12_warnings(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty dropped edges of each graph, and how many there are."""
    x = Graphs(spark, d).normalized.dropped
    w = Window.partitionBy("graphId")
    return x.select("graphId", "edge_ord", "reason", F.row_number().over(w.orderBy("edge_ord")).alias("place"), F.count("*").over(w).alias("n")).where("place <= 50")


def o7_symbol_cap(spark: SparkSession, d: str) -> DataFrame:
    """The three longest functions of each file, exported ones first."""
    f = table(spark, d, "fingerprints").select("fp_row", F.posexplode("functions").alias("pos", "f")).select("fp_row", "pos", "f.name", F.coalesce("f.exported", F.lit(False)).alias("exported"), F.coalesce("f.lineCount", F.lit(0)).alias("lines"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("fp_row").orderBy(F.desc("exported"), F.desc("lines"), "pos"))).where("place <= 3")


def l27_entries(spark: SparkSession, d: str) -> DataFrame:
    """Where programs begin: main functions, guarded mains, listeners, at most 200 a graph in the order of paths."""
    f = table(spark, d, "source_files").where("content is not null").select("graphId", "path", "content").distinct()
    kind = (
        F.when(F.col("path").endswith(".py") & F.col("content").rlike(r"(?m)^if __name__ == ['\"]__main__['\"]"), "guarded main").when(F.col("path").endswith(".go") & F.col("content").rlike(r"(?m)^func main\("), "main function")
        .when(F.col("path").endswith(".java") & F.col("content").rlike(r"static void main\("), "main method").when(F.col("path").rlike(r"\.(?:js|ts)$") & F.col("content").rlike(r"\.listen\(|(?m)^export (?:async )?function "), "exported function").when(F.col("path").endswith(".sh"), "script")
    )
    e = f.select("graphId", "path", kind.alias("kind")).where("kind is not null")
    return e.withColumn("place", F.row_number().over(Window.partitionBy("graphId").orderBy("path", "kind"))).where("place <= 200")


def z4_similar(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of one node whose summaries share words: the delivery before, of similar length, by word sets."""
    n = table(spark, d, "nodes").where("op = 'upsert' and length(trim(summary)) > 0").select("graphId", "id", "node_row", F.lower("summary").alias("s"))
    n = n.withColumn("w", F.array_distinct(F.filter(F.split("s", "[^a-z0-9]+"), lambda x: x != "")))
    o = Window.partitionBy("graphId", "id").orderBy("node_row")
    p = n.select("node_row", "s", "w", F.lag("node_row").over(o).alias("other"), F.lag("s").over(o).alias("s2"), F.lag("w").over(o).alias("w2")).where("other is not null and size(w) > 0 and size(w2) > 0")
    skew = F.abs(F.length("s") - F.length("s2")) / F.greatest(F.length("s"), F.length("s2"))
    score = F.size(F.array_intersect("w", "w2")) / F.size(F.array_union("w", "w2"))
    return p.where(skew <= 0.4).select("node_row", "other", F.round(score, 6).alias("score")).where("score >= 0.7")


QUERIES = {f.__name__: f for f in (q1_units, q2_findings, q4_scopes, g33_coverage, q15_stripped, g34_issues, o10_sorted_tree, o12_warnings, o7_symbol_cap, l27_entries, z4_similar)}
ORACLE = {
    "g34_issues": BASE + "select graphId, string_agg(n || ' edges dropped: ' || reason, chr(10) order by rank, reason) as summary from (select graphId, reason, count(*) as n, case when reason = 'missing-both' then 0 else 1 end as rank from (select graphId, case when not s_ok and not t_ok then 'missing-both' when not s_ok then 'missing-source' else 'missing-target' end as reason from e0 where not (s_ok and t_ok)) group by 1, 2) group by 1",
    "o12_warnings": BASE + "select * from (select graphId, edge_ord, case when not s_ok and not t_ok then 'missing-both' when not s_ok then 'missing-source' else 'missing-target' end as reason, row_number() over (partition by graphId order by edge_ord) as place, count(*) over (partition by graphId) as n from e0 where not (s_ok and t_ok)) where place <= 50",
    "o10_sorted_tree": BASE + """select graphId, path, parent, kind, row_number() over (partition by graphId, parent order by kind = 'folder' desc, split_part(path, '/', -1), path) as place from (select graphId, path, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as parent, kind from (
      select distinct graphId, filePath as path, 'file' as kind from n where coalesce(filePath, '') <> '' union all select distinct graphId, array_to_string(parts[1:i], '/'), 'folder' from (select graphId, string_split(filePath, '/') as parts, unnest(range(1, len(string_split(filePath, '/')))) as i from n where coalesce(filePath, '') <> '')))""",
    "o7_symbol_cap": "with x as (select fp_row, unnest(functions) as f, generate_subscripts(functions, 1) - 1 as pos from fingerprints), y as (select fp_row, pos::int as pos, f.name as name, coalesce(f.exported, false) as exported, coalesce(f.lineCount, 0) as lines from x) select * from (select *, row_number() over (partition by fp_row order by exported desc, lines desc, pos) as place from y) where place <= 3",
    "l27_entries": r"""with f as (select distinct graphId, path, content as c from source_files where content is not null), k as (select graphId, path, case when path like '%.py' and regexp_matches(c, '(?m)^if __name__ == [''"]__main__[''"]') then 'guarded main' when path like '%.go' and regexp_matches(c, '(?m)^func main\(') then 'main function' when path like '%.java' and regexp_matches(c, 'static void main\(') then 'main method'
      when regexp_matches(path, '\.(?:js|ts)$') and regexp_matches(c, '\.listen\(|(?m)^export (?:async )?function ') then 'exported function' when path like '%.sh' then 'script' end as kind from f) select * from (select *, row_number() over (partition by graphId order by path, kind) as place from k where kind is not null) where place <= 200""",
    "z4_similar": "with n as (select graphId, id, node_row, lower(summary) as s, list_filter(list_distinct(string_split_regex(lower(summary), '[^a-z0-9]+')), lambda x: x <> '') as w from nodes where op = 'upsert' and length(trim(summary)) > 0), p as (select *, lag(node_row) over o as other, lag(s) over o as s2, lag(w) over o as w2 from n window o as (partition by graphId, id order by node_row)), q as (select node_row, other, len(list_intersect(w, w2)) as i, len(w) as a, len(w2) as b from p where other is not null and len(w) > 0 and len(w2) > 0 and abs(length(s) - length(s2)) / greatest(length(s), length(s2)) <= 0.4) select node_row, other, round(i / (a + b - i), 6) as score from q where round(i / (a + b - i), 6) >= 0.7",
}
