"""As-of and interval joins, and prefix or suffix lookups turned into equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_next(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, right_cols: list[str]) -> DataFrame:
    """For each left row the first right row at or after it; null where none is. One sort of the union per key.

    Ties on the right go to the smallest of the right columns; null times match nothing.
    """
    r = right.where(F.col(right_ts).isNotNull()).groupBy(*by, F.col(right_ts).alias("_ts")).agg(F.min(F.struct(*right_cols)).alias("_r"))
    a = left.select(*by, F.col(left_ts).alias("_ts"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(0).alias("_side"))
    b = r.select(*by, "_ts", F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(F.col("_ts").alias(right_ts), "_r.*").alias("_r2"), F.lit(1).alias("_side"))
    kind = b.schema["_r2"].dataType
    u = a.withColumn("_r2", F.lit(None).cast(kind)).drop("_r").unionByName(b)
    w = Window.partitionBy(*by).orderBy(F.desc("_ts"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = u.withColumn("_m", F.last("_r2", ignorenulls=True).over(w)).where("_side = 0")
    hit = F.when(F.col("_ts").isNotNull(), F.col("_m"))
    return got.select("_l.*", *[hit[c].alias(f"next_{c}") for c in (right_ts, *right_cols)])


def innermost(points: DataFrame, ranges: DataFrame, by: list[str], point: str, width: int = 64) -> DataFrame:
    """For each point the range [start, stop] with the greatest start that holds it; ranges are cut into buckets for an equi-join.

    ranges: by, start, stop, range_id. Ties go to the shortest, then the smallest range_id. Points in no range are left out.
    """
    r = ranges.where("start <= stop").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    j = p.join(r, [*by, "_b"]).where((F.col(point) >= F.col("start")) & (F.col(point) <= F.col("stop")))
    return j.groupBy(*points.columns).agg(F.max_by("range_id", F.struct("start", -F.col("stop"), -F.col("range_id"))).alias("range_id"))


def nearest_ancestor(paths: DataFrame, folders: DataFrame, by: list[str]) -> DataFrame:
    """The deepest of the folders (by, folder) above each path (by, path); the root is the empty folder."""
    parts = F.split("path", "/")
    up = paths.withColumn("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    return up.join(folders, [*by, "folder"]).groupBy(*by, "path").agg(F.max_by("folder", F.length("folder")).alias("folder"))


def by_suffix(refs: DataFrame, files: DataFrame, by: list[str], ref: str = "ref") -> DataFrame:
    """Files (by, path) that end with the reference at a segment border; the reference matches if only one does."""
    parts = F.split("path", "/")
    # Only as many last segments as the longest reference has are needed, and that number is read off the references.
    most = refs.agg(F.max(F.size(F.split(ref, "/")))).first()[0] or 0
    n = F.least(F.size(parts), F.lit(max(1, most)))
    tails = files.withColumn(ref, F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "/"))))
    return refs.join(tails, [*by, ref]).groupBy(*refs.columns).agg(F.count("*").alias("n_matches"), F.min("path").alias("path")).withColumn("path", F.when(F.col("n_matches") == 1, F.col("path")))


def first_candidate(candidates: DataFrame, files: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """First existing path of an ordered candidate list (key, by, candidates array<string>)."""
    c = candidates.select(*dict.fromkeys([*key, *by]), F.posexplode("candidates").alias("pos", "path"))
    return c.join(files.select(*by, "path"), [*by, "path"]).groupBy(*key).agg(F.min_by("path", "pos").alias("path"))
