"""Graph files and batch files: reading whole JSON graphs as tables, writing them back, ordering partial deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NODE = (
    "struct<id:string,type:string,name:string,filePath:string,lineRange:array<int>,summary:string,tags:array<string>,complexity:string,languageNotes:string,"
    "domainMeta:struct<entities:array<string>,businessRules:array<string>,crossDomainInteractions:array<string>,entryPoint:string,entryType:string>,"
    "knowledgeMeta:struct<wikilinks:array<string>,backlinks:array<string>,category:string,content:string>>"
)
_EDGE = "struct<source:string,target:string,type:string,direction:string,description:string,weight:string>"
GRAPH = (
    f"version string, kind string, project struct<name:string,languages:array<string>,frameworks:array<string>,description:string,analyzedAt:string,gitCommitHash:string>, nodes array<{_NODE}>, edges array<{_EDGE}>,"
    " layers array<struct<id:string,name:string,description:string,nodeIds:array<string>>>, tour array<struct<order:int,title:string,description:string,nodeIds:array<string>,languageLesson:string>>, _corrupt_record string"
)
_BATCH_NAME = r"^batch-(existing|\d+)(?:-part-(\d+))?\.json$"


def read_graphs(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per JSON graph file, with its file name; a malformed file keeps its text in _corrupt_record and nulls elsewhere."""
    raw = spark.read.schema(GRAPH).option("multiLine", True).option("mode", "PERMISSIVE").json(list(paths))
    return raw.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def _table(graphs: DataFrame, column: str, ordinal: str, key: Column) -> DataFrame:
    out = graphs.where("_corrupt_record is null").select(key.alias("graphId"), F.posexplode(column).alias(ordinal, "x"))
    return out.select("graphId", F.col(ordinal).cast("long").alias(ordinal), "x.*")


def graph_tables(graphs: DataFrame, key: Column | None = None) -> dict[str, DataFrame]:
    """nodes, edges, layers and tour of all graphs, each with an ordinal inside its graph; the key is the file by default."""
    k = key if key is not None else F.col("file")
    return {
        "nodes": _table(graphs, "nodes", "node_ord", k), "edges": _table(graphs, "edges", "edge_ord", k),
        "layers": _table(graphs, "layers", "layer_ord", k), "tour": _table(graphs, "tour", "tour_ord", k),
    }


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Graphs as JSON lines, one per graphId, lists in the order of their ordinals. A graph must fit into one row."""
    n_cols = [c for c in nodes.columns if c != "graphId"]
    e_cols = [c for c in edges.columns if c != "graphId"]
    lists = lambda df, cols, first, out: df.groupBy("graphId").agg(F.array_sort(F.collect_list(F.struct(first, *[c for c in cols if c != first]))).alias(out))
    both = lists(nodes, n_cols, "node_ord", "nodes").join(lists(edges, e_cols, "edge_ord", "edges"), "graphId", "left")
    both.write.mode("overwrite").json(path)


def batch_order(file: Column) -> tuple[Column, Column, Column]:
    """Ordinal (existing is -1), part (0 if whole) and whether the name is that of a batch at all."""
    n, part = F.regexp_extract(file, _BATCH_NAME, 1), F.regexp_extract(file, _BATCH_NAME, 2)
    return F.when(n == "existing", -1).otherwise(n.try_cast("int")), F.coalesce(part.try_cast("int"), F.lit(0)), file.rlike(_BATCH_NAME)


def read_batches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all batch files in delivery order, and the files that gave none, with the reason.

    Both tables carry batch_ord, part and the ordinal in the file; names that are no batch, malformed files and
    files without rows are reported, not raised.
    """
    g = read_graphs(spark, f"{folder}/*.json")
    order, part, known = batch_order(F.col("file"))
    g = g.withColumns({"batch_ord": order, "part": part, "known": F.coalesce(known, F.lit(False))})
    bad = F.when(~F.col("known"), "unrecognised name").when(F.col("_corrupt_record").isNotNull(), "malformed").when(F.col("nodes").isNull() | F.col("edges").isNull(), "no nodes or edges").when(F.size("nodes") + F.size("edges") == 0, "empty")
    g = g.withColumn("problem", bad)
    rows = g.where("problem is null or problem = 'empty'").select("file", "batch_ord", "part", F.lit("node").alias("what"), F.posexplode("nodes").alias("ord", "node")).withColumn("edge", F.lit(None).cast(_EDGE))
    edges = g.where("problem is null").select("file", "batch_ord", "part", F.lit("edge").alias("what"), F.posexplode("edges").alias("ord", "edge")).withColumn("node", F.lit(None).cast(_NODE))
    return rows.unionByName(edges), g.where("problem is not null").select("file", "problem")


def relative_path(path: Column, root: str) -> Column:
    """Absolute paths become relative to the root, those outside of it their base name; relative ones stay."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    return F.when(p.startswith(base), F.substring(p, F.lit(len(base) + 1), F.length(p))).when(p.rlike(r"^(?:/|[A-Za-z]:/)"), F.element_at(F.split(p, "/"), -1)).otherwise(p)


def scan_digest(files: DataFrame) -> DataFrame:
    """Digest per graph over its paths and contents: of 4,096 parts by path digest, each in path order, then of the parts.

    Splitting by path digest keeps the list of any one task at a 4,096th of a graph; it holds digests, not texts.
    """
    f = files.where("path is not null").groupBy("graphId", "path").agg(F.max(F.sha2(F.coalesce("content", F.lit("")), 256)).alias("h"))
    joined = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: F.concat(x[key], F.lit(":"), x["h"])), "\n"), 256)
    parts = f.groupBy("graphId", F.substring(F.sha2("path", 256), 1, 3).alias("part")).agg(F.count("*").alias("n"), joined("path").alias("h"))
    return parts.groupBy("graphId").agg(F.sum("n").alias("n_files"), joined("part").alias("digest"))
