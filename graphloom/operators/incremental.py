"""Fingerprints and incremental updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import canonical_path
from graphloom.operators.snapshots import canonical_hash

# Thresholds of the update decision.
FULL_FILES, FULL_SHARE, ARCHITECTURE_FILES = 30, 0.5, 10
GROWN, SHRUNK = 1.5, 0.5


F_FUNCS = "array<struct<name:string,params:array<string>,returnType:string,exported:boolean,lineCount:int>>"


def latest_fingerprints(fp: DataFrame) -> DataFrame:
    """One row per (graphId, snapshot_no, path): the latest delivery, with path and hash in one spelling."""
    cols = ["functions", "classes", "imports", "exports", "totalLines", "hasStructuralAnalysis", "hash"]
    k = fp.withColumns({"path": canonical_path(F.col("filePath")), "hash": canonical_hash(F.col("contentHash"))})
    return k.groupBy("graphId", "snapshot_no", "path").agg(F.max_by(F.struct(*cols), F.struct("deliveredAt", "fp_row")).alias("v")).select("graphId", "snapshot_no", "path", "v.*")


def compare_fingerprints(fp: DataFrame) -> DataFrame:
    """graphId, snapshot_no, path, change, level of every file of each snapshot and its predecessor in the graph.

    change: new, deleted or kept. level of kept files: NONE for equal hashes, STRUCTURAL without analysis or if
    functions (names, parameters in order, return type, export, size beyond the ratios), class names, imports or
    exports differ, else COSMETIC.
    """
    f = latest_fingerprints(fp)
    snaps = f.select("graphId", "snapshot_no").distinct()
    prev = snaps.withColumn("prev_no", F.lag("snapshot_no").over(Window.partitionBy("graphId").orderBy("snapshot_no"))).where("prev_no is not null")
    sig = f.select(
        "graphId", "snapshot_no", "path", "hash", F.coalesce("hasStructuralAnalysis", F.lit(False)).alias("analysed"),
        F.array_sort(F.transform(F.coalesce("functions", F.array().cast(F_FUNCS)), lambda x: F.to_json(F.struct(x["name"].alias("n"), x["params"].alias("p"), x["returnType"].alias("r"), x["exported"].alias("e"))))).alias("fns"),
        F.array_sort(F.transform("classes", lambda x: x["name"])).alias("cls"), F.array_sort(F.transform("imports", lambda x: x["source"])).alias("imp"), F.array_sort("exports").alias("exp"),
        F.aggregate(F.coalesce("functions", F.array().cast(F_FUNCS)), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["lineCount"], F.lit(0))).alias("lines"),
    )
    n = sig.join(prev, ["graphId", "snapshot_no"]).alias("n")
    o = sig.join(prev.select("graphId", F.col("snapshot_no").alias("next_no"), F.col("prev_no").alias("snapshot_no")), ["graphId", "snapshot_no"]).alias("o")
    j = n.join(o, (F.col("n.graphId") == F.col("o.graphId")) & (F.col("n.snapshot_no") == F.col("o.next_no")) & (F.col("n.path") == F.col("o.path")), "full_outer")
    ratio = F.col("n.lines") / F.nullif(F.col("o.lines"), F.lit(0))
    differs = (
        ~F.col("n.fns").eqNullSafe(F.col("o.fns")) | ~F.col("n.cls").eqNullSafe(F.col("o.cls")) | ~F.col("n.imp").eqNullSafe(F.col("o.imp")) | ~F.col("n.exp").eqNullSafe(F.col("o.exp"))
        | F.coalesce((ratio > GROWN) | (ratio < SHRUNK), F.lit(False))
    )
    level = F.when(F.col("n.hash") == F.col("o.hash"), "NONE").when(~F.col("n.analysed") | ~F.col("o.analysed"), "STRUCTURAL").when(differs, "STRUCTURAL").otherwise("COSMETIC")
    change = F.when(F.col("o.path").isNull(), "new").when(F.col("n.path").isNull(), "deleted").otherwise("kept")
    return j.select(F.coalesce("n.graphId", "o.graphId").alias("graphId"), F.coalesce("n.snapshot_no", "o.next_no").alias("snapshot_no"), F.coalesce("n.path", "o.path").alias("path"), change.alias("change"), F.when(change == "kept", level).otherwise("STRUCTURAL").alias("level"))


def classify_update(changes: DataFrame) -> DataFrame:
    """Per graph and snapshot: counts and SKIP, PARTIAL, ARCHITECTURE or FULL.

    FULL above 30 changed files or half of all; ARCHITECTURE above 10 or if a top folder is new; PARTIAL for any
    structural change; else SKIP.
    """
    c = changes.withColumn("top", F.when(F.instr("path", "/") > 0, F.split("path", "/")[0]).otherwise(""))
    tops = c.groupBy("graphId", "snapshot_no", "top").agg(F.count_if(F.col("change") != "new").alias("before"))
    new_top = tops.groupBy("graphId", "snapshot_no").agg(F.bool_or(F.col("before") == 0).alias("new_top"))
    by = c.groupBy("graphId", "snapshot_no").agg(
        F.count_if(F.col("level") == "STRUCTURAL").alias("n_structural"), F.count_if(F.col("level") == "COSMETIC").alias("n_cosmetic"), F.count_if(F.col("level") == "NONE").alias("n_same"), F.count("*").alias("n_files")
    ).join(new_top, ["graphId", "snapshot_no"])
    n = F.col("n_structural")
    action = F.when(n == 0, "SKIP").when((n > FULL_FILES) | (n > FULL_SHARE * F.col("n_files")), "FULL").when(F.col("new_top") | (n > ARCHITECTURE_FILES), "ARCHITECTURE").otherwise("PARTIAL")
    return by.select("graphId", "snapshot_no", "n_structural", "n_cosmetic", "n_same", "n_files", action.alias("action"))


def merge_update(nodes: DataFrame, edges: DataFrame, files: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph after an update: nodes of the changed files (graphId, filePath) and their edges go, the new ones come."""
    gone = nodes.join(files, ["graphId", "filePath"], "left_semi").select("graphId", "id")
    kept = nodes.join(files, ["graphId", "filePath"], "left_anti").unionByName(new_nodes, allowMissingColumns=True)
    left = edges
    for end in ("source", "target"):
        left = left.join(gone.withColumnRenamed("id", end), ["graphId", end], "left_anti")
    return kept, left.unionByName(new_edges, allowMissingColumns=True)


def freshness(fp: DataFrame, graphs: DataFrame) -> DataFrame:
    """Per graph: fresh if its recorded commit is that of the last snapshot, stale if of an earlier one, else unknown."""
    last = fp.groupBy("graphId").agg(F.max_by("gitCommitHash", F.struct("snapshot_no", "generatedAt")).alias("head"), F.collect_set("gitCommitHash").alias("known"))
    g = graphs.select("graphId", "gitCommitHash").join(last, "graphId", "left")
    return g.select("graphId", F.when(F.col("head").isNull(), "unknown").when(F.col("gitCommitHash") == F.col("head"), "fresh").when(F.array_contains("known", F.col("gitCommitHash")), "stale").otherwise("unknown").alias("status"))


def commits(command: Column) -> Column:
    """Whether a shell command makes commits, so that an update should follow."""
    return F.coalesce(command.rlike(r"(?:^|[;&|(]\s*)(?:\w+=\S+\s+)*git\s+(?:-\S+\s+\S+\s+)*(?:commit|merge|cherry-pick|rebase|pull|am|revert)\b"), F.lit(False))


def version_gate(stored: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of ``current`` whose version is not the one stored; keys that are not stored and null versions always pass."""
    same = stored.select(key, F.col(version).alias("_v"))
    return current.join(same, key, "left").where(~F.coalesce(F.col("_v") == F.col(version), F.lit(False))).drop("_v")


def position(ahead: Column, behind: Column, dirty: Column) -> Column:
    """How a working tree stands to its recorded commit: unknown, dirty, fresh, ahead, behind or diverged."""
    return F.when(ahead.isNull() | behind.isNull(), "unknown").when((ahead > 0) & (behind > 0), "diverged").when(behind > 0, "behind").when(ahead > 0, "ahead").when(F.coalesce(dirty, F.lit(False)), "dirty").otherwise("fresh")
