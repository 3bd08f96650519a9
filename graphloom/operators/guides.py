"""Tours, guides and groupings that explain a graph, and lookups by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import basename, dirname
from graphloom.operators.traverse import chunks, topological_levels


def layer_tour(nodes: DataFrame, edges: DataFrame, layers: DataFrame, concepts: list[str] = ("concept",)) -> DataFrame:
    """Steps of a tour: layers in the order of their first node by topological level, then what no layer holds, then concepts.

    layers: graphId, id, layer. Columns: graphId, step, title, n_nodes.
    """
    levels = topological_levels(nodes, edges)
    level = F.when(F.col("level") < 0, 1 << 30).otherwise(F.col("level"))
    placed = nodes.where(~F.col("type").isin(*concepts)).select("graphId", "id").join(levels, ["graphId", "id"]).join(layers.select("graphId", "id", "layer"), ["graphId", "id"], "left")
    steps = placed.groupBy("graphId", F.coalesce("layer", F.lit("Supporting Components")).alias("title")).agg(F.min(level).alias("at"), F.count("*").alias("n_nodes"), F.max(F.col("layer").isNull()).cast("int").alias("rank"))
    extra = nodes.where(F.col("type").isin(*concepts)).groupBy("graphId").agg(F.count("*").alias("n_nodes")).select("graphId", F.lit("Key Concepts").alias("title"), F.lit(0).alias("at"), "n_nodes", F.lit(2).alias("rank"))
    w = Window.partitionBy("graphId").orderBy("rank", "at", "title")
    return steps.unionByName(extra).select("graphId", F.row_number().over(w).alias("step"), "title", "n_nodes")


def guide(projects: DataFrame, nodes: DataFrame, edges: DataFrame, layers: DataFrame, k: int = 5) -> DataFrame:
    """One Markdown text per graph: overview, layers, hotspots. The lists are short: layers, and the k largest hubs."""
    n = nodes.groupBy("graphId").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("complexity") == "complex").alias("n_complex"))
    e = edges.groupBy("graphId").agg(F.count("*").alias("n_edges"))
    per = layers.groupBy("graphId", "layer").agg(F.count("*").alias("n"))
    ls = per.groupBy("graphId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "n"))), lambda x: F.concat(F.lit("- "), x["layer"], F.lit(": "), x["n"].cast("string"))), "\n").alias("layers"))
    deg = edges.select("graphId", F.explode(F.array("source", "target")).alias("id")).groupBy("graphId", "id").agg(F.count("*").alias("d"))
    top = deg.withColumn("r", F.row_number().over(Window.partitionBy("graphId").orderBy(F.desc("d"), "id"))).where(F.col("r") <= k)
    hs = top.groupBy("graphId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id", "d"))), lambda x: F.concat(F.lit("- "), x["id"], F.lit(" ("), x["d"].cast("string"), F.lit(")"))), "\n").alias("hot"))
    p = projects.select("graphId", F.coalesce("name", "graphId").alias("name"))
    j = p.join(n, "graphId", "left").join(e, "graphId", "left").join(ls, "graphId", "left").join(hs, "graphId", "left")
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0" if c.startswith("n_") else ""))
    text = F.concat(F.lit("# "), F.col("name"), F.lit("\n\n"), s("n_nodes"), F.lit(" nodes, "), s("n_edges"), F.lit(" edges, "), s("n_complex"), F.lit(" complex\n\n## Layers\n\n"), s("layers"), F.lit("\n\n## Hotspots\n\n"), s("hot"), F.lit("\n"))
    return j.select("graphId", text.alias("guide"))


def neighbour_map(imports: DataFrame, batches: DataFrame, k: int = 50) -> DataFrame:
    """Files one import away in other batches, at most k by degree, then path: graphId, file, neighbour, batch."""
    both = imports.select("graphId", F.col("source").alias("file"), F.col("target").alias("neighbour")).union(imports.select("graphId", "target", "source")).distinct()
    deg = both.groupBy("graphId", F.col("file").alias("neighbour")).agg(F.count("*").alias("degree"))
    b = batches.select("graphId", "id", "batch")
    j = both.join(b.select("graphId", F.col("id").alias("file"), F.col("batch").alias("own")), ["graphId", "file"]).join(b.select("graphId", F.col("id").alias("neighbour"), "batch"), ["graphId", "neighbour"]).where("own <> batch").join(deg, ["graphId", "neighbour"])
    w = Window.partitionBy("graphId", "file").orderBy(F.desc("degree"), "neighbour")
    return j.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("graphId", "file", "neighbour", "batch")


def noncode_groups(files: DataFrame, size: int = 20) -> DataFrame:
    """Batches of files that are no code: per container folder, workflows, pipelines, migrations, else by folder in chunks."""
    p = F.col("path")
    kind = (
        F.when(basename(p).rlike(r"^Dockerfile|^docker-compose|^\.dockerignore"), F.concat(F.lit("container:"), dirname(p))).when(p.rlike(r"(?:^|/)\.github/workflows/"), "workflows")
        .when(basename(p).rlike(r"^(?:Jenkinsfile|\.gitlab-ci)"), "pipelines").when(p.rlike(r"(?:^|/)migrations?/"), F.concat(F.lit("migrations:"), dirname(p))).otherwise(F.concat(F.lit("folder:"), dirname(p)))
    )
    return chunks(files.select("graphId", "path", kind.alias("grp")), ["graphId", "grp"], ["path"], size)


def longest_prefix(refs: DataFrame, prefixes: DataFrame, ref: str = "ref") -> DataFrame:
    """Longest registered prefix of each dotted reference (by whole parts): its prefixes are looked up, not scanned."""
    parts = F.split(ref, r"\.")
    up = refs.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))))
    return up.join(prefixes.select("prefix"), "prefix").groupBy(*refs.columns).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Tiers of call resolution: a top symbol of the file itself, else one defined in exactly one imported file.

    calls: graphId, path, caller, name. symbols: graphId, path, name. imports: graphId, path, to_path. Columns of the
    calls with target path, tier and reason (ambiguous, external); calls of oneself are dropped.
    """
    own = symbols.select("graphId", "path", "name").distinct().withColumn("own", F.col("path"))
    far = imports.join(symbols.select("graphId", F.col("path").alias("to_path"), "name").distinct(), ["graphId", "to_path"]).groupBy("graphId", "path", "name").agg(F.countDistinct("to_path").alias("k"), F.min("to_path").alias("far"))
    j = calls.join(own, ["graphId", "path", "name"], "left").join(far, ["graphId", "path", "name"], "left")
    target = F.coalesce("own", F.when(F.col("k") == 1, F.col("far")))
    tier = F.when(F.col("own").isNotNull(), "scope").when(F.col("k") == 1, "import")
    reason = F.when(tier.isNotNull(), None).when(F.col("k") > 1, "ambiguous").otherwise("external")
    out = j.select(*calls.columns, target.alias("target_path"), tier.alias("tier"), reason.alias("reason"))
    return out.where(F.coalesce(F.col("caller") != F.col("name"), F.lit(True)) | F.col("tier").isNull())


def qualifiers(text: Column) -> Column:
    """Words that bound a claim, in lower case, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b(only|never|always|unless|except|at most|at least|until|before|after|every|each|may|must|cannot)\b"), F.lit(1))))


def synthetic_graph(spark, n: int, per_node: float = 1.7, reach: int = 50, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """A random graph with forward edges only, for load tests: nodes and edges of one graph."""
    kinds = F.array(*[F.lit(x) for x in ("file", "function", "class", "module", "concept")])
    h = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 30))
    nodes = spark.range(n).select(F.lit("synthetic").alias("graphId"), F.concat(F.lit("node:"), "id").alias("id"), F.get(kinds, F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(5)).cast("int")).alias("type"), F.concat(F.lit("n"), "id").alias("name"), F.col("id").alias("node_ord"))
    m = int(n * per_node)
    e = spark.range(m).withColumn("s", h(F.col("id"), F.lit("s")) % max(1, n - 1)).withColumn("t", F.least(F.lit(n - 1), F.col("s") + 1 + h(F.col("id"), F.lit("t")) % reach))
    return nodes, e.where("s < t").select(F.lit("synthetic").alias("graphId"), F.concat(F.lit("node:"), "s").alias("source"), F.concat(F.lit("node:"), "t").alias("target"), F.lit("related").alias("type"), F.col("id").alias("edge_ord"))
