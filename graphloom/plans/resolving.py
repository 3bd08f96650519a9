"""Queries of import resolution, with SQL: every import statement with the file it means, null for what lies outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import imports as M
from graphloom.session import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("graphId", "path", "content").where("path is not null")


def _all(statements: DataFrame, resolved: DataFrame) -> DataFrame:
    return statements.join(resolved, ["graphId", "importer", "source"], "left").select("graphId", "importer", "source", "path")


def m1_scripts(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    every = M.statements(f, "tsx?|jsx?|mjs|cjs|mts|cts", r"""(?m)^\s*(?:import|export)\b[^;'"]*?['"]([^'"\n]+)['"]""").union(M.statements(f, "tsx?|jsx?|mjs|cjs|mts|cts", r"""\brequire\(\s*['"]([^'"\n]+)['"]\s*\)""")).distinct()
    return _all(every, M.script_imports(f))


def m1_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Imports that each script would have of the next script of its folder, resolved from the compiled ending to the source."""
    from pyspark.sql import Window

    s = _files(spark, d).where("path like '%.ts' or path like '%.js'").select("graphId", "path").distinct()
    s = s.withColumn("folder", M.folder(F.col("path")))
    nxt = F.lead("path").over(Window.partitionBy("graphId", "folder").orderBy("path"))
    s = s.withColumn("next", nxt).where("next is not null")
    made = s.select("graphId", "path", F.concat(F.lit("import { x } from './"), F.regexp_replace(F.element_at(F.split("next", "/"), -1), r"\.(?:ts|js)$", ".js"), F.lit("';\n")).alias("content"))
    rest = _files(spark, d).select("graphId", "path").distinct().join(made.select("graphId", "path"), ["graphId", "path"], "left_anti").withColumn("content", F.lit(""))
    return M.script_imports(made.unionByName(rest)).select("graphId", "importer", "path")


def m4_go(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return _all(M.statements(f, "go", r'(?m)^import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"'), M.go_imports(f))


def m5_java(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return _all(M.statements(f, "java", r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;"), M.dotted_imports(f, "java"))


def m3_python(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    every = M.statements(f, "pyi?", r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]")
    return _all(every, M.python_imports(f))


def m14_map(spark: SparkSession, d: str) -> DataFrame:
    return M.import_map(_files(spark, d))


QUERIES = {f.__name__: f for f in (m1_scripts, m1_siblings, m4_go, m5_java, m3_python, m14_map)}

_F = "f as (select distinct graphId, path from source_files where path is not null)"
_PROBE = ", ".join(f"({i}, '{x}')" for i, x in enumerate((".ts", ".tsx", ".js", ".jsx")))
_REL = """case when starts_with(source, './') then regexp_replace(importer, '[^/]*$', '') || substr(source, 3) when starts_with(source, '../') and contains(regexp_replace(importer, '/?[^/]*$', ''), '/') then regexp_replace(regexp_replace(importer, '/?[^/]*$', ''), '[^/]*$', '') || substr(source, 4) when starts_with(source, '../') then substr(source, 4) end"""
ORACLE = {
    "m1_scripts": f"""with {_F}, s as (select distinct graphId, path as importer, unnest(regexp_extract_all(content, '(?m)^\\s*(?:import|export)\\b[^;''"]*?[''"]([^''"\\n]+)[''"]', 1) || regexp_extract_all(content, '\\brequire\\(\\s*[''"]([^''"\\n]+)[''"]\\s*\\)', 1)) as source from source_files where regexp_matches(path, '\\.(?:tsx?|jsx?|mjs|cjs|mts|cts)$')),
      b as (select *, {_REL} as base from s), c as (select b.*, 0 as k, base as cand from b union all select b.*, pos + 1, regexp_replace(base, '\\.js$', '') || ext from b, (values {_PROBE}) p(pos, ext) where ends_with(base, '.js') union all select b.*, pos + 1, base || ext from b, (values {', '.join(f"({i}, '{x}')" for i, x in enumerate(M.SCRIPT_PROBES))}) p(pos, ext) where not regexp_matches(base, '\\.(js|jsx|mjs|cjs)$')),
      h as (select c.graphId, importer, source, arg_min(f.path, k) as path from c join f on f.graphId = c.graphId and f.path = c.cand group by 1, 2, 3) select s.graphId, s.importer, s.source, h.path from s left join h using (graphId, importer, source)""",
    "m1_siblings": f"""with {_F}, s as (select graphId, path, regexp_replace(path, '/?[^/]*$', '') as folder, lead(path) over (partition by graphId, regexp_replace(path, '/?[^/]*$', '') order by path) as nxt from f where path like '%.ts' or path like '%.js'),
      b as (select graphId, path as importer, regexp_replace(nxt, '\\.(?:ts|js)$', '') as stem from s where nxt is not null), c as (select b.*, 0 as k, stem || '.js' as cand from b union all select b.*, pos + 1, stem || ext from b, (values {_PROBE}) p(pos, ext))
      select c.graphId, importer, arg_min(f.path, k) as path from c join f on f.graphId = c.graphId and f.path = c.cand group by 1, 2""",
    "m4_go": "select distinct graphId, path as importer, unnest(regexp_extract_all(content, '(?m)^import[ \\t]+(?:[\\w.]+[ \\t]+)?\"([^\"\\n]+)\"', 1)) as source, null as path from source_files where path like '%.go'",
    "m5_java": f"with {_F}, s as (select distinct graphId, path as importer, unnest(regexp_extract_all(content, '(?m)^[ \\t]*import[ \\t]+(?:static[ \\t]+)?([\\w.]+)[ \\t]*;', 1)) as source from source_files where path like '%.java'), h as (select s.*, f.path from s join f on f.graphId = s.graphId and (f.path = replace(source, '.', '/') || '.java' or ends_with(f.path, '/' || replace(source, '.', '/') || '.java'))) select s.graphId, s.importer, s.source, h.path from s left join h using (graphId, importer, source)",
    "m3_python": f"""with {_F}, s as (select distinct graphId, path as importer, unnest(regexp_extract_all(content, '(?m)^[ \\t]*from[ \\t]+(\\.*[\\w.]*)[ \\t]+import[ \\t]', 1)) as source from source_files where regexp_matches(path, '\\.pyi?$')),
      a as (select s.*, unnest(list_transform(range(0, len(string_split(importer, '/'))), lambda i: array_to_string(string_split(importer, '/')[1:i], '/'))) as root from s where source <> '' and not starts_with(source, '.')), c as (select a.*, case when root = '' then '' else root || '/' end || replace(source, '.', '/') as base from a),
      h as (select c.graphId, importer, source, length(root) as k, f.path from c join f on f.graphId = c.graphId and (f.path = base || '.py' or f.path = base || '/__init__.py')), m as (select graphId, importer, source, max(k) as k from h group by 1, 2, 3) select s.graphId, s.importer, s.source, h.path from s left join (select h.* from h join m using (graphId, importer, source, k)) h using (graphId, importer, source)""",
}
