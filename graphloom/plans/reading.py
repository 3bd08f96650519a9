"""Queries of languages and parsed contents, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import consensus
from graphloom.sources import languages, parsers
from graphloom.session import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files")
    return f.select("file_row", "graphId", "path", languages.language(F.col("path")).alias("lang"), "content")


def l26_languages(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files")
    return f.groupBy(languages.language(F.col("path")).alias("lang"), languages.category(F.col("path")).alias("category")).agg(F.count("*").alias("n"))


def l_entities(spark: SparkSession, d: str) -> DataFrame:
    return parsers.extract_entities(_files(spark, d))


def l6_variables(spark: SparkSession, d: str) -> DataFrame:
    return parsers.extract_entities(_files(spark, d).where("lang = 'config'")).groupBy("graphId", "path").agg(F.count("*").alias("n_variables"))


def l3_yaml_keys(spark: SparkSession, d: str) -> DataFrame:
    return parsers.extract_entities(_files(spark, d).where("lang = 'yaml'")).select("graphId", "path", "name", "first_line", "last_line").distinct()


def l2_tables(spark: SparkSession, d: str) -> DataFrame:
    return parsers.extract_entities(_files(spark, d).where("lang = 'sql'")).where("kind = 'table'").select("graphId", "path", "name").distinct()


def l15_go_functions(spark: SparkSession, d: str) -> DataFrame:
    return parsers.extract_entities(_files(spark, d).where("lang = 'go'")).where("kind = 'function'").select("graphId", "path", "name", "first_line", "exported").distinct()


def b18_significant(spark: SparkSession, d: str) -> DataFrame:
    """Functions of at least ten lines and classes of at least twenty, or exported ones."""
    e = l_entities(spark, d).where("kind in ('function', 'method', 'class')")
    return e.where((F.col("last_line") - F.col("first_line") + 1 >= F.when(F.col("kind") == "class", 20).otherwise(10)) | F.col("exported")).groupBy("graphId", "kind").agg(F.count("*").alias("n"))


def g23_shared_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Function names that two to forty files define."""
    e = l_entities(spark, d).where("kind = 'function'").select("name", F.concat("graphId", F.lit("/"), "path").alias("file"))
    return consensus.inverted_index(e, "name", "file", 2, 40)


def l13_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes, interfaces and enumerations of scripts."""
    return parsers.extract_entities(_files(spark, d).where("lang in ('typescript', 'javascript')")).where("kind = 'class'").select("graphId", "path", "name", "first_line").distinct()


def l16_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes, interfaces, enumerations and records of Java."""
    return parsers.extract_entities(_files(spark, d).where("lang = 'java'")).where("kind = 'class'").select("graphId", "path", "name", "first_line").distinct()


QUERIES = {f.__name__: f for f in (l13_classes, l16_classes, l26_languages, l_entities, l6_variables, l3_yaml_keys, l2_tables, l15_go_functions, b18_significant, g23_shared_symbols)}

_EXT = "lower(case when starts_with(b, '.') then regexp_extract(b, '^\\.([A-Za-z0-9]+)', 1) else regexp_extract(b, '[^.]\\.([^.]+)$', 1) end)"
_VALUES = lambda t: ", ".join(f"({k!r}, {v!r})" for k, v in t.items())
# Declarations told by the words of a line once its modifiers are taken off, not by a pattern over the text.
_WORDS = r"""with f as (select distinct graphId, path, string_split(replace(content, chr(13), ''), chr(10)) as ls from source_files where regexp_matches(path, '{ext}')), l as (select graphId, path, unnest(ls) as line, generate_subscripts(ls, 1) as first_line from f),
  w as (select *, list_filter(string_split_regex(trim(line, chr(9) || ' '), '[ \t]+'), lambda x: x not in ({mods})) as ws from l) select distinct graphId, path, regexp_extract(ws[2], '^\w+') as name, first_line::int as first_line from w where ws[1] in ({heads}) and regexp_extract(ws[2], '^\w+') <> ''"""
ORACLE = {
    "l13_classes": _WORDS.format(ext=r"\.(?:tsx?|jsx?|mjs|cjs)$", mods="'export', 'default', 'abstract'", heads="'class', 'interface', 'enum'"),
    "l16_classes": _WORDS.format(ext=r"\.java$", mods="'public', 'private', 'protected', 'static', 'final', 'abstract', 'sealed'", heads="'class', 'interface', 'enum', 'record'"),
    "l26_languages": f"""with f as (select path, {_EXT} as x, b from (select path, split_part(path, '/', -1) as b from source_files)), l(k, v) as (values {_VALUES(languages.LANGUAGE_BY_EXT)}), c(k, v) as (values {_VALUES(languages.CATEGORY_BY_EXT)})
      select case when regexp_matches(b, '^Dockerfile(?:\\.|$)') then 'dockerfile' when x <> '' then coalesce(l.v, x) else 'unknown' end as lang, case when regexp_matches(path, '{languages.INFRA_RE}') then 'infra' else coalesce(c.v, 'code') end as category, count(*) as n
      from f left join l on l.k = x left join c on c.k = x group by 1, 2""",
    "l6_variables": "select graphId, path, count(*) as n_variables from (select graphId, path, unnest(string_split(content, chr(10))) as l from source_files where path like '%.env') where regexp_matches(l, '^[ \\t]*[A-Za-z_][A-Za-z0-9_]*=') group by 1, 2",
    "l3_yaml_keys": """with f as (select distinct graphId, path, replace(content, chr(13), '') as content from source_files where path like '%.yaml'), l as (select graphId, path, unnest(string_split(content, chr(10))) as l, generate_subscripts(string_split(content, chr(10)), 1)::int as k,
      len(string_split(content, chr(10))) - ends_with(content, chr(10))::int as total from f), h as (select *, regexp_extract(l, '^([A-Za-z_][\\w.-]*)\\s*:(?:\\s|$)', 1) as name from l)
      select graphId, path, name, k as first_line, coalesce(lead(k) over (partition by graphId, path order by k) - 1, total)::int as last_line from h where name <> ''""",
    "l2_tables": "select distinct graphId, path, unnest(regexp_extract_all(content, '(?i)CREATE\\s+TABLE\\s+(?:IF\\s+NOT\\s+EXISTS\\s+)?[`\"]?(\\w+)', 1)) as name from source_files where path like '%.sql'",
    "l15_go_functions": "with l as (select distinct graphId, path, unnest(string_split(replace(content, chr(13), ''), chr(10))) as l, generate_subscripts(string_split(content, chr(10)), 1)::int as first_line from source_files where path like '%.go'), h as (select *, regexp_extract(l, '^func\\s+(?:\\([^)]*\\)\\s*)?(\\w+)\\s*(?:\\[[^\\]]*\\])?\\(', 1) as name from l) select graphId, path, name, first_line, regexp_matches(name, '^[A-Z]') as exported from h where name <> ''",
}
