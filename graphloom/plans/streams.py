"""Queries of event windows, digests and ignore rules, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources import ignore
from graphloom.sources.graphs import relative_path, scan_digest
from graphloom.session import table
from graphloom.streaming import changes

_USER = ["*_test.*", "!**/src/*_test.py", "/lib/"]


def st_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return changes.window_counts(table(spark, d, "events"), "ts", ["event_type"], "1 day").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def st_sessions(spark: SparkSession, d: str) -> DataFrame:
    return changes.sessions(table(spark, d, "events"), "ts", ["user_id"], "12 hours").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def s6_digest(spark: SparkSession, d: str) -> DataFrame:
    return scan_digest(table(spark, d, "source_files"))


def s2_ignored(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files")
    return f.select("file_row", ignore.is_ignored(F.col("path"), ignore.DEFAULTS).alias("by_default"), ignore.user_ignored(F.col("path"), _USER).alias("by_user"))


def s27_safe_paths(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fingerprints")
    return f.select("fp_row", relative_path(F.concat(F.lit("/work/repo/"), "filePath"), "/work/repo").alias("inside"), relative_path(F.concat(F.lit("/else/"), "filePath"), "/work/repo").alias("outside"))


QUERIES = {f.__name__: f for f in (st_window_counts, st_sessions, s6_digest, s2_ignored, s27_safe_paths)}


# The rules said anew, by path segments and the database's own wildcards.
_DIRS = [x.rstrip("/") for x in ignore.DEFAULTS if x.endswith("/")]
_NAMES = [x for x in ignore.DEFAULTS if not x.endswith("/")]
_ANY = "len(list_filter({list}, lambda s: {test})) > 0"
_DEFAULT = _ANY.format(list="g[:-2]", test="s in (" + ", ".join(f"'{x}'" for x in _DIRS) + ")") + " or " + _ANY.format(list="g", test=" or ".join(f"s glob '{x}'" for x in _NAMES))
_RULED = "case when len(g) > 1 and g[1] = 'lib' then true when len(list_filter(range(1, len(g)), lambda i: g[i] = 'src' and g[i + 1] glob '*_test.py')) > 0 then false when " + _ANY.format(list="g", test="s glob '*_test.*'") + f" then true else ({_DEFAULT}) end"
ORACLE = {
    "st_window_counts": "select strftime(time_bucket(interval 1 day, ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n from events group by 1, 2",
    "st_sessions": """with s as (select user_id, ts, case when ts - lag(ts) over w < interval 12 hour then 0 else 1 end as f from events window w as (partition by user_id order by ts)), g as (select user_id, sum(f) over (partition by user_id order by ts, f desc rows unbounded preceding) as k from s), c as (select user_id, k, count(*) as n from g group by 1, 2)
      select user_id, count(*) as n_sessions, max(n) as longest from c group by 1""",
    "s6_digest": """with f as (select graphId, path, max(sha256(coalesce(content, ''))) as h from source_files group by 1, 2), p as (select graphId, left(sha256(path), 3) as part, count(*) as n, sha256(string_agg(path || ':' || h, chr(10) order by path)) as h from f group by 1, 2)
      select graphId, sum(n)::bigint as n_files, sha256(string_agg(part || ':' || h, chr(10) order by part)) as digest from p group by 1""",
    "s2_ignored": f"select file_row, ({_DEFAULT}) as by_default, ({_RULED}) and not ({_DEFAULT}) as by_user from (select file_row, string_split(path, '/') as g from source_files)",
    "s27_safe_paths": "select fp_row, replace(filePath, '\\', '/') as inside, split_part(replace(filePath, '\\', '/'), '/', -1) as outside from fingerprints",
}
