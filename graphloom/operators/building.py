"""Rows of a graph made from analysed files: nodes, edges, types, complexity and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions.ids import trim_ws
from graphloom.functions.paths import basename
from graphloom.operators.dedup import first_by
from graphloom.sources import languages

# Node type of a definition by its kind; any other kind is a concept.
KIND_TO_TYPE = {
    "table": "table", "view": "table", "index": "table", "message": "schema", "type": "schema", "enum": "schema", "resource": "resource", "module": "resource", "service": "service",
    "deployment": "service", "job": "pipeline", "stage": "pipeline", "target": "pipeline", "route": "endpoint", "query": "endpoint", "mutation": "endpoint", "variable": "config", "output": "config",
}
# Prefixes that batches may use, and types that a knowledge graph may hold.
BATCH_PREFIXES = (
    "file", "func", "function", "class", "module", "concept", "config", "document", "service", "table", "endpoint", "pipeline", "schema", "resource",
    "domain", "flow", "step", "article", "entity", "topic", "claim", "source",
)
KNOWLEDGE_NODE_TYPES = tuple(p for p in BATCH_PREFIXES if p != "func")
KNOWLEDGE_NODE_ALIASES = {
    "note": "article", "page": "article", "wiki_page": "article", "person": "entity", "actor": "entity", "organization": "entity", "tag": "topic", "category": "topic", "theme": "topic",
    "assertion": "claim", "decision": "claim", "thesis": "claim", "reference": "source", "raw": "source", "paper": "source",
}
KNOWLEDGE_EDGE_ALIASES = {
    "references": "cites", "cites_source": "cites", "conflicts_with": "contradicts", "disagrees_with": "contradicts", "refines": "builds_on", "elaborates": "builds_on",
    "illustrates": "exemplifies", "instance_of": "exemplifies", "example_of": "exemplifies", "belongs_to": "categorized_under", "tagged_with": "categorized_under",
    "written_by": "authored_by", "created_by": "authored_by", "relates_to": "related", "related_to": "related",
}
KNOWLEDGE_EDGE_TYPES = (
    "cites", "contradicts", "builds_on", "exemplifies", "categorized_under", "authored_by", "related", "similar_to", "imports", "exports", "contains", "inherits", "implements",
    "calls", "subscribes", "publishes", "middleware", "reads_from", "writes_to", "transforms", "validates", "depends_on", "tested_by", "configures",
    "deploys", "serves", "provisions", "triggers", "migrates", "documents", "routes", "defines_schema", "contains_flow", "flow_step", "cross_domain",
)


def distinct_edges(edges: DataFrame, kind: str) -> DataFrame:
    """Edges of one type, the first of each source and target, with the weight of the type (else 0.5)."""
    e = edges.where((F.lower("type") == kind) & F.col("source").isNotNull() & F.col("target").isNotNull()).select("graphId", "source", "target", F.lit(kind).alias("type"), "edge_row")
    return first_by(e, ["graphId", "source", "target", "type"], "edge_row").withColumn("weight", F.lit(S.EDGE_WEIGHTS.get(kind, 0.5)))


def call_edges(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls with 0.8 where the target is a node as it is spelled, else 0.6; the strongest of each source and target."""
    known = nodes.select("graphId", F.col("id").alias("target"), F.lit(True).alias("exact"))
    j = calls.join(known, ["graphId", "target"], "left")
    return j.groupBy("graphId", "source", "target").agg(F.max(F.when(F.col("exact"), 0.8).otherwise(0.6)).alias("weight"))


def import_edges(files: DataFrame) -> DataFrame:
    """One edge per entry of a file's import list (graphId, filePath, imports array of structs with source), weight 0.7."""
    return files.select("graphId", F.col("filePath").alias("source"), F.explode("imports").alias("i")).select("graphId", "source", F.col("i.source").alias("target"), F.lit(0.7).alias("weight")).where("target is not null").distinct()


def languages_used(files: DataFrame) -> DataFrame:
    """Distinct languages of a graph's files in order."""
    low = F.lower(F.trim("language"))
    return files.where(F.coalesce(low, F.lit("")) != "").select("graphId", low.alias("l")).distinct().groupBy("graphId").agg(F.array_join(F.array_sort(F.collect_list("l")), ",").alias("languages"))


def article_tags(nodes: DataFrame) -> DataFrame:
    """Category, first folder and given tags of each article as one sorted set, joined by commas."""
    folder = F.when(F.instr("filePath", "/") > 0, F.split("filePath", "/")[0])
    parts = F.concat(F.array("knowledgeMeta.category", folder), F.coalesce("tags", F.array().cast("array<string>")))
    cleaned = F.filter(F.transform(parts, lambda x: F.lower(trim_ws(x))), lambda x: F.coalesce(x, F.lit("")) != "")
    return nodes.select("graphId", "node_row", F.array_join(F.array_sort(F.array_distinct(cleaned)), ",").alias("tags"))


def file_metrics(fingerprints: DataFrame) -> DataFrame:
    """Counts of functions, classes, exports and imports, those of relative imports, and of methods, per analysed file."""
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    methods = F.aggregate(F.transform(F.coalesce("classes", F.array().cast("array<struct<name:string,methods:array<string>,properties:array<string>,exported:boolean,lineCount:int>>")), lambda c: F.coalesce(F.size(c["methods"]), F.lit(0))), F.lit(0), lambda a, x: a + F.greatest(x, F.lit(0)))
    relative = F.size(F.filter(F.coalesce("imports", F.array().cast("array<struct<source:string,specifiers:array<string>>>")), lambda i: F.coalesce(i["source"].startswith("."), F.lit(False))))
    return fingerprints.select("fp_row", size("functions").alias("n_functions"), size("classes").alias("n_classes"), size("exports").alias("n_exports"), size("imports").alias("n_imports"), relative.alias("n_relative"), methods.alias("n_methods"))


def significant(fingerprints: DataFrame, lines: int = 10, methods: int = 2, class_lines: int = 20) -> DataFrame:
    """Functions of at least ``lines`` lines or exported, classes of two methods or twenty lines or exported."""
    f = fingerprints.select("fp_row", F.explode("functions").alias("x")).where(F.coalesce(F.col("x.lineCount") >= lines, F.lit(False)) | F.coalesce("x.exported", F.lit(False))).select("fp_row", F.lit("function").alias("kind"), "x.name")
    c = fingerprints.select("fp_row", F.explode("classes").alias("x")).where(F.coalesce(F.size("x.methods") >= methods, F.lit(False)) | F.coalesce(F.col("x.lineCount") >= class_lines, F.lit(False)) | F.coalesce("x.exported", F.lit(False))).select("fp_row", F.lit("class").alias("kind"), "x.name")
    return f.union(c)


def file_node_type(path: Column, content: Column) -> Column:
    """Node type of a file by its category: config, document, kinds of infrastructure by path, kinds of data by content."""
    kind, b = languages.category(path), basename(path)
    infra = F.when(path.rlike(r"(?:^|/)\.github/workflows/|(?:^|/)\.circleci/") | b.rlike(r"^(?:\.gitlab-ci\.ya?ml|Jenkinsfile)$"), "pipeline").when(b.rlike(r"\.(?:tf|tfvars)$|^Vagrantfile$"), "resource").otherwise("service")
    data = F.when(b.rlike(r"\.(?:graphql|gql|proto|prisma)$"), "schema").when(b.rlike(r"\.sql$") & (content.rlike(r"(?i)create\s+table") | path.rlike(r"(?:^|/)migrations?/")), "table").when(content.rlike(r"(?i)\b(?:openapi|swagger)\b"), "endpoint").otherwise("file")
    return F.when(kind == "config", "config").when(kind == "docs", "document").when(kind == "infra", infra).when(kind == "data", data).otherwise("file")


def size_complexity(non_empty: Column) -> Column:
    """simple under 50 non-empty lines, moderate up to 200, else complex."""
    return F.when(non_empty < 50, "simple").when(non_empty <= 200, "moderate").otherwise("complex")


def nested_contains(symbols: DataFrame) -> DataFrame:
    """One contains edge per symbol: from the nearest emitted ancestor by qualified name, else from its file.

    symbols: graphId, filePath, qualname (dotted). Ancestors are looked up by prefix, not scanned.
    """
    parts = F.split("qualname", r"\.")
    up = symbols.withColumn("parent", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).otherwise(F.array(F.lit(None).cast("string")))))
    known = symbols.select("graphId", "filePath", F.col("qualname").alias("parent"), F.lit(True).alias("there")).distinct()
    best = up.join(known, ["graphId", "filePath", "parent"], "left").groupBy("graphId", "filePath", "qualname").agg(F.max_by(F.when(F.col("there"), F.col("parent")), F.when(F.col("there"), F.length("parent")).otherwise(-1)).alias("parent"))
    return best.select("graphId", "filePath", "qualname", F.coalesce(F.concat(F.lit("symbol:"), F.col("parent")), F.concat(F.lit("file:"), F.col("filePath"))).alias("container"))


def table_children(files: DataFrame) -> DataFrame:
    """Nodes of the tables, views and indexes that SQL files define: id of path and name; of repeated ids the first counts.

    files: graphId, path, content. Columns: graphId, id, type, name, pos.
    """
    found = F.expr(r"regexp_extract_all(content, '(?i)create\\s+(?:or\\s+replace\\s+)?(?:unique\\s+)?(?:table|view|index)\\s+(?:if\\s+not\\s+exists\\s+)?[`\"]?(\\w+)', 1)")
    d = files.where("path like '%.sql'").select("graphId", "path", F.posexplode(found).alias("pos", "name"))
    d = d.select("graphId", F.concat(F.lit("table:"), F.col("path"), F.lit(":"), F.col("name")).alias("id"), F.lit("table").alias("type"), "name", "pos")
    return first_by(d, ["graphId", "id"], "pos")


def id_type(node_id: Column) -> Column:
    """Type that the prefix of an id stands for: function for func, else the prefix if it is one of a type, else file."""
    p = F.substring_index(node_id, ":", 1)
    return F.when(p == "func", "function").when(p.isin(*[x for x in BATCH_PREFIXES if x not in ("func",)]) & F.contains(node_id, F.lit(":")), p).otherwise("file")


def batch_id(node_id: Column, node_type: Column, file_path: Column, name: Column) -> Column:
    """The batch merger's dialect of ids: doubled prefixes and project names go, func is function, bare ids get a prefix."""
    any_of = "|".join(BATCH_PREFIXES)
    single = F.regexp_replace(node_id, rf"^({any_of}):\1:", "$1:")
    project = F.when(single.rlike(rf"^[^:]+:(?:{any_of}):") & ~single.rlike(rf"^(?:{any_of}):"), F.regexp_replace(single, rf"^[^:]+:((?:{any_of}):)", "$1")).otherwise(single)
    plain = F.when(project.startswith("func:"), F.concat(F.lit("function:"), F.substring(project, 6, 1 << 20))).otherwise(project)
    kind = F.when(node_type == "func", "function").when(node_type.isin(*BATCH_PREFIXES), node_type).otherwise("file")
    symbol = F.concat(kind, F.lit(":"), F.when(F.coalesce(file_path, F.lit("")) != "", file_path).otherwise("__nofilepath__"), F.lit(":"), F.coalesce(name, plain))
    return F.when(plain.rlike(rf"^(?:{any_of}):"), plain).when(node_type.isin("function", "class"), symbol).otherwise(F.concat(kind, F.lit(":"), plain))


def knowledge_node_type(c: Column) -> Column:
    """Canonical type in a knowledge graph; null for a type it does not hold."""
    t = F.lower(F.trim(c))
    t = F.coalesce(S.lookup(KNOWLEDGE_NODE_ALIASES, t), t)
    return F.when(t.isin(*KNOWLEDGE_NODE_TYPES), t)


def knowledge_edge_type(c: Column) -> Column:
    """Canonical edge type in a knowledge graph; an unknown one is ``related``."""
    t = F.lower(F.trim(c))
    t = F.coalesce(S.lookup(KNOWLEDGE_EDGE_ALIASES, t), t)
    return F.when(t.isin(*KNOWLEDGE_EDGE_TYPES), t).otherwise("related")


def entity_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim_ws(c)), r"\s+", " ")


def definition_type(kind: Column) -> Column:
    return F.coalesce(S.lookup(KIND_TO_TYPE, kind), F.lit("concept"))


def flow_slugs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graphId, id, slug: of each step the slug of the flow that leads to it; of several the last edge counts."""
    flows = nodes.where("type = 'flow'").select("graphId", F.col("id").alias("source"), F.regexp_replace(F.lower(trim_ws(F.col("name"))), r"\s+", "-").alias("slug"))
    e = edges.where("type = 'flow_step'").join(flows, ["graphId", "source"])
    return e.groupBy("graphId", F.col("target").alias("id")).agg(F.max_by("slug", "edge_ord").alias("slug"))


def signatures(fingerprints: DataFrame) -> DataFrame:
    """One row per function of a file: name, parameters, return type, whether it is exported by mark or by the export list."""
    f = fingerprints.select("fp_row", "exports", F.explode("functions").alias("x"))
    listed = F.coalesce(F.array_contains(F.coalesce("exports", F.array().cast("array<string>")), F.col("x.name")), F.lit(False))
    return f.select("fp_row", "x.name", F.array_join(F.coalesce("x.params", F.array().cast("array<string>")), ",", "").alias("params"), F.col("x.returnType").alias("return_type"), (F.coalesce("x.exported", F.lit(False)) | listed).alias("exported"), F.col("x.lineCount").alias("lines"))


def fingerprint_store(fingerprints: DataFrame) -> DataFrame:
    """What is kept of each file: its hash, and counts only where it was analysed."""
    known = F.coalesce("hasStructuralAnalysis", F.lit(False))
    return fingerprints.select("fp_row", F.lower(F.trim("contentHash")).alias("hash"), known.alias("analysed"), F.when(known, F.size(F.coalesce("functions", F.array().cast(dict(fingerprints.dtypes)["functions"])))).alias("n_functions"))


def canonical_digest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """SHA-256 of each row as JSON with its keys in order and nulls written out."""
    fields = [F.concat(F.to_json(F.array(F.lit(c))).substr(2, len(c) + 2), F.lit(":"), F.coalesce(F.expr(f"trim(both '[]' from to_json(array(`{c}`)))"), F.lit("null"))) for c in sorted(columns)]
    return df.select(key, F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")), 256).alias("digest"))
