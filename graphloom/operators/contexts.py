"""Contexts of a graph as rows and as text, view overlays, groups and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import basename
from graphloom.operators.traverse import _links
from graphloom.operators.views import first_layer, neighbours
from graphloom.session import cut_lineage

# Node types of a structural view, and of knowledge alone.
STRUCTURAL_TYPES = (
    "file", "function", "class", "module", "concept", "config", "document", "service", "table", "endpoint", "pipeline", "schema", "resource", "domain", "flow", "step",
    "page", "screen", "component", "componentSet", "instance", "token",
)
KNOWLEDGE_TYPES = ("article", "entity", "topic", "claim", "source")
# Label of a folder by its name.
FOLDER_LABELS = {
    "api": ["routes", "api", "controllers", "endpoints", "handlers", "serializers", "controller", "routers", "blueprints"],
    "service": ["services", "core", "lib", "domain", "logic", "signals", "internal", "composables", "mailers", "jobs", "channels"],
    "data": ["models", "db", "data", "persistence", "repository", "entities", "migrations", "entity", "sql", "database", "schema"],
    "ui": ["components", "views", "pages", "ui", "layouts", "screens"],
    "middleware": ["middleware", "plugins", "interceptors", "guards"],
    "utility": ["utils", "helpers", "common", "shared", "tools", "templatetags", "pkg"],
    "config": ["config", "constants", "env", "settings", "management", "commands"],
    "test": ["__tests__", "test", "tests", "spec", "specs"],
    "types": ["types", "interfaces", "schemas", "contracts", "dtos", "dto", "request", "response"],
    "hooks": ["hooks"], "state": ["store", "state", "reducers", "actions", "slices"], "assets": ["assets", "static", "public"], "entry": ["cmd", "bin"],
    "documentation": ["docs", "documentation", "wiki"], "infrastructure": ["deploy", "deployment", "infra", "infrastructure", "k8s", "kubernetes", "helm", "charts", "terraform", "tf", "docker"],
    "ci-cd": [".github", ".gitlab", ".circleci"],
}
# Label of a file by its name, in order of precedence.
FILE_LABELS = [
    ("test", r"\.(?:test|spec)\.[^/]+$|(?:^|/)test_[^/]*\.py$|_test\.go$|Test\.java$|_spec\.rb$|Test\.php$|Tests\.cs$"), ("types", r"\.d\.ts$"), ("entry", r"(?:^|/)(?:index\.ts|index\.js|__init__\.py|manage\.py)$"),
    ("config", r"(?:^|/)(?:wsgi|asgi)\.py$"), ("entry", r"(?:^|/)cmd/[^/]+/main\.go$|(?:^|/)src/(?:main|lib)\.rs$|(?:^|/)(?:Application\.java|Program\.cs|config\.ru)$"),
    ("config", r"(?:^|/)(?:Cargo\.toml|go\.mod|Gemfile|pom\.xml|build\.gradle|composer\.json)$"), ("infrastructure", r"(?:^|/)Dockerfile$|(?:^|/)docker-compose\.[^/]*$|\.tf$|\.tfvars$|(?:^|/)Makefile$"),
    ("ci-cd", r"(?:^|/)\.github/workflows/[^/]+$|(?:^|/)(?:\.gitlab-ci\.yml|Jenkinsfile)$"), ("data", r"\.sql$"), ("types", r"\.(?:graphql|gql|proto)$"), ("documentation", r"\.(?:md|rst)$"),
]


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among the nodes (graphId, id)."""
    ids = nodes.select("graphId", "id")
    return edges.join(ids.withColumnRenamed("id", "source"), ["graphId", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["graphId", "target"], "left_semi")


def touching_layers(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Layers that hold any of the nodes."""
    return members.join(nodes.select("graphId", "id"), ["graphId", "id"], "left_semi").select("graphId", "layer_id", "layer_name").distinct()


def _lines(df: DataFrame, line: Column, out: str, most: int) -> DataFrame:
    """The lines of a graph in order, at most ``most`` of them, and the number left out."""
    w = Window.partitionBy("graphId").orderBy("line")
    d = df.select("graphId", line.alias("line")).distinct().withColumn("r", F.row_number().over(w))
    return d.groupBy("graphId").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.col("line")))), "\n").alias(out), F.count_if(F.col("r") > most).alias(f"{out}_more"))


def chat_context(hits: DataFrame, nodes: DataFrame, edges: DataFrame, members: DataFrame, most: int = 50) -> DataFrame:
    """graphId, context: search hits, what is one step away, the edges among them and the layers they touch, as Markdown.

    Each list is in order and has at most ``most`` lines; what is left out is counted.
    """
    near = cut_lineage(neighbours(edges, hits).join(nodes.select("graphId", "id", "type", "name"), ["graphId", "id"]))
    e = induced(edges, near)
    a = _lines(near, F.concat(F.lit("- "), F.col("type"), F.lit(": "), F.coalesce("name", "id"), F.lit(" ("), F.col("id"), F.lit(")")), "nodes", most)
    b = _lines(e, F.concat(F.lit("- "), F.col("source"), F.lit(" -["), F.col("type"), F.lit("]-> "), F.col("target")), "links", most)
    c = _lines(touching_layers(near, members), F.concat(F.lit("- "), F.coalesce("layer_name", "layer_id")), "layers", most)
    j = a.join(b, "graphId", "left").join(c, "graphId", "left")
    part = lambda title, name: F.concat(F.lit(f"## {title}\n"), F.coalesce(name, F.lit("")), F.when(F.coalesce(f"{name}_more", F.lit(0)) > 0, F.concat(F.lit("\n- and "), F.col(f"{name}_more").cast("string"), F.lit(" more"))).otherwise(""), F.lit("\n"))
    return j.select("graphId", F.concat(part("Nodes", "nodes"), part("Relationships", "links"), part("Layers", "layers")).alias("context"))


def impacted_edges(edges: DataFrame, impact: DataFrame) -> DataFrame:
    """Edges that touch a changed node."""
    ch = impact.where("role = 'changed'").select("graphId", "id")
    s = edges.join(ch.withColumnRenamed("id", "source"), ["graphId", "source"], "left_semi")
    t = edges.join(ch.withColumnRenamed("id", "target"), ["graphId", "target"], "left_semi")
    return s.select("graphId", "edge_ord", "source", "target", "type").union(t.select("graphId", "edge_ord", "source", "target", "type")).distinct()


def explain_text(nodes: DataFrame, edges: DataFrame, members: DataFrame, targets: DataFrame) -> DataFrame:
    """graphId, id, text: name and layer of each target, what it contains, and what it is linked with, each list in order."""
    t = targets.select("graphId", "id")
    names = nodes.select("graphId", F.col("id").alias("other"), F.coalesce("name", "id").alias("label"))
    out = t.join(edges.select("graphId", F.col("source").alias("id"), F.col("target").alias("other"), "type"), ["graphId", "id"]).withColumn("way", F.when(F.col("type") == "contains", "child").otherwise("out"))
    inn = t.join(edges.select("graphId", F.col("target").alias("id"), F.col("source").alias("other"), "type"), ["graphId", "id"]).withColumn("way", F.lit("in"))
    rows = out.unionByName(inn).join(names, ["graphId", "other"])
    line = F.when(F.col("way") == "child", F.concat(F.lit("1 contains "), F.col("label"))).when(F.col("way") == "out", F.concat(F.lit("2 "), F.col("type"), F.lit(" "), F.col("label"))).otherwise(F.concat(F.lit("3 "), F.col("type"), F.lit(" by "), F.col("label")))
    lists = rows.select("graphId", "id", line.alias("line")).distinct().groupBy("graphId", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: F.concat(F.lit("- "), F.substring(x, 3, 1 << 20))), "\n").alias("list"))
    layer = first_layer(members).select("graphId", "id", "layer_id")
    j = t.join(nodes.select("graphId", "id", "name"), ["graphId", "id"]).join(layer, ["graphId", "id"], "left").join(lists, ["graphId", "id"], "left")
    return j.select("graphId", "id", F.concat(F.lit("# "), F.coalesce("name", "id"), F.lit("\nLayer: "), F.coalesce("layer_id", F.lit("none")), F.lit("\n"), F.coalesce("list", F.lit(""))).alias("text"))


def cycle_nodes(steps: DataFrame) -> DataFrame:
    """graphId, id of the nodes on a cycle, where every node has at most one step (graphId, id, next).

    The step is doubled until the set of nodes reached no longer shrinks: then it maps that set onto itself.
    """
    f = cut_lineage(steps.where("next is not null").select("graphId", "id", "next"))
    size = -1
    while True:
        image = f.select("graphId", F.col("next").alias("id")).distinct()
        n = image.join(f.select("graphId", "id"), ["graphId", "id"], "left_semi").count()
        if n == size or not n:
            return image.join(f.select("graphId", "id"), ["graphId", "id"], "left_semi")
        size = n
        f = cut_lineage(f.join(f.select("graphId", F.col("id").alias("next"), F.col("next").alias("far")), ["graphId", "next"]).select("graphId", "id", F.col("far").alias("next")))


def children_counts(nodes: DataFrame, edges: DataFrame, kind: str, link: str) -> DataFrame:
    """graphId, id, n of every node of a type: how many links of a kind it has, zero included (flows of a domain, steps of a flow)."""
    n = edges.where(F.col("type") == link).groupBy("graphId", F.col("source").alias("id")).agg(F.count("*").alias("n"))
    return nodes.where(F.col("type") == kind).select("graphId", "id").join(n, ["graphId", "id"], "left").fillna(0, ["n"])


def step_order(nodes: DataFrame, edges: DataFrame, kind: str, link: str) -> DataFrame:
    """graphId, id, ord of what nodes of a type lead to by a link: weight times ten, rounded half up, of the last edge."""
    heads = nodes.where(F.col("type") == kind).select("graphId", F.col("id").alias("source"))
    e = edges.where(F.col("type") == link).join(heads, ["graphId", "source"], "left_semi")
    return e.groupBy("graphId", F.col("target").alias("id")).agg(F.floor(F.max_by("weight", "edge_ord") * 10 + 0.5).cast("int").alias("ord"))


def overlays(nodes: DataFrame, edges: DataFrame, hits: DataFrame, impact: DataFrame) -> DataFrame:
    """Every node that stands out, with flags: found, changed, affected, near a hit."""
    flag = lambda df, name: df.select("graphId", "id").distinct().withColumn(name, F.lit(True))
    near = neighbours(edges, hits).join(hits.select("graphId", "id"), ["graphId", "id"], "left_anti")
    j = nodes.select("graphId", "id")
    for df, name in ((hits, "found"), (impact.where("role = 'changed'"), "changed"), (impact.where("role = 'affected'"), "affected"), (near, "near")):
        j = j.join(flag(df, name), ["graphId", "id"], "left")
    return j.fillna(False, ["found", "changed", "affected", "near"]).where("found or changed or affected or near")


def knowledge_view(nodes: DataFrame, edges: DataFrame, visible: tuple[str, ...]) -> DataFrame:
    """Edges among the nodes that a knowledge view shows: its own types only if they are visible, all others always."""
    shown = nodes.where(~F.col("type").isin(*KNOWLEDGE_TYPES) | F.col("type").isin(*visible))
    return induced(edges, shown)


def detail_view(members: DataFrame, nodes: DataFrame, edges: DataFrame, functions: bool = False) -> DataFrame:
    """graphId, layer_id, id: members of each layer and the classes (and functions, if wanted) they contain."""
    kinds = ["class", "function"] if functions else ["class"]
    own = members.select("graphId", "layer_id", "id").distinct()
    inner = own.join(edges.where("type = 'contains'").select("graphId", F.col("source").alias("id"), F.col("target").alias("child")), ["graphId", "id"]).select("graphId", "layer_id", F.col("child").alias("id"))
    inner = inner.join(nodes.where(F.col("type").isin(*kinds)).select("graphId", "id"), ["graphId", "id"], "left_semi").select("graphId", "layer_id", "id")
    return own.union(inner).distinct()


def persona_view(nodes: DataFrame, technical: bool, hidden: tuple[str, ...]) -> DataFrame:
    """Nodes of structural types, without functions and classes for readers who are not technical, without hidden categories."""
    from graphloom import schema as S

    cat = F.coalesce(S.lookup(S.NODE_CATEGORY, F.col("type")), F.lit("code"))
    out = nodes.where(F.col("type").isin(*STRUCTURAL_TYPES) & ~cat.isin(*hidden))
    return out if technical else out.where(~F.col("type").isin("function", "class"))


def hits_per_layer(hits: DataFrame, members: DataFrame) -> DataFrame:
    return hits.select("graphId", "id").join(first_layer(members).select("graphId", "id", "layer_id"), ["graphId", "id"]).groupBy("graphId", "layer_id").agg(F.count("*").alias("n_hits"))


def path_labels(path: Column) -> Column:
    """Label of a file by its name, else by the innermost folder that has one, else ``other``."""
    by_file = F.coalesce(*[F.when(path.rlike(p), F.lit(name)) for name, p in FILE_LABELS])
    label = F.create_map(*[F.lit(x) for name, folders in FOLDER_LABELS.items() for f in folders for x in (f, name)])
    parts = F.split(F.lower(path), "/")
    found = F.array_compact(F.transform(F.slice(F.reverse(parts), 2, 1 << 20), lambda s: label[s]))
    return F.coalesce(by_file, F.get(found, F.lit(0)), F.lit("other"))


def deployment(files: DataFrame) -> DataFrame:
    """Per graph: whether it has containers, compositions, clusters, infrastructure as code and pipelines, and how many such files."""
    p, b = F.col("path"), basename(F.col("path"))
    kinds = {
        "has_dockerfile": b.rlike(r"^Dockerfile(?:\..*)?$"), "has_compose": b.rlike(r"^(?:docker-)?compose[^/]*\.ya?ml$"), "has_k8s": p.rlike(r"(?:^|/)(?:k8s|kubernetes|helm)/"), "has_terraform": b.rlike(r"\.(?:tf|tfvars)$"),
        "has_ci": p.rlike(r"(?:^|/)\.github/workflows/|(?:^|/)(?:\.gitlab-ci\.ya?ml|Jenkinsfile)$"),
    }
    any_of = F.lit(False)
    for c in kinds.values():
        any_of = any_of | c
    return files.groupBy("graphId").agg(*[F.bool_or(c).alias(k) for k, c in kinds.items()], F.count_if(any_of).alias("n_infra"))


def pipeline_files(files: DataFrame) -> DataFrame:
    """graphId, stage, n: schema, migration, model and handler files of a data pipeline."""
    p = F.lower(F.col("path"))
    stage = F.when(p.rlike(r"(?:^|/)migrations?/"), "migration").when(p.rlike(r"\.(?:sql|graphql|gql|proto|prisma)$"), "schema").when(p.rlike(r"(?:^|/)(?:models?|entities|entity)/"), "model").when(p.rlike(r"(?:^|/)(?:routes?|controllers?|handlers?|endpoints?|api)/"), "handler")
    return files.select("graphId", stage.alias("stage")).where("stage is not null").groupBy("graphId", "stage").agg(F.count("*").alias("n"))


def doc_coverage(files: DataFrame) -> DataFrame:
    """Per graph: folders, those with a Markdown file of their own, and their share."""
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    g = files.groupBy("graphId", folder.alias("folder")).agg(F.bool_or(F.col("path").rlike(r"(?i)\.md$")).alias("documented"))
    return g.groupBy("graphId").agg(F.count("*").alias("n_groups"), F.count_if("documented").alias("n_documented"), F.round(F.count_if("documented") / F.count("*"), 6).alias("coverage"))


def listed_layers(nodes: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Layer of each file by given (layer, pattern) pairs in order: the path starts with the pattern or holds it behind a slash; else Other."""
    p = F.lower(F.coalesce("filePath", F.lit("")))
    layer = F.coalesce(*[F.when(p.startswith(x.lower()) | F.contains(p, F.lit("/" + x.lower())), F.lit(name)) for name, x in patterns], F.lit("Other"))
    return nodes.where("type = 'file'").select("graphId", "id", layer.alias("layer"))


def safe_contents(files: DataFrame, nodes: DataFrame, most: int = 1 << 20) -> DataFrame:
    """file_row, status of each file asked for: ok, outside (absolute, empty or going up), unknown (no node has the path), large, binary."""
    p = F.col("path")
    known = nodes.where("filePath is not null").select("graphId", F.col("filePath").alias("path"), F.lit(True).alias("known")).distinct()
    outside = p.isNull() | (p == "") | p.startswith("/") | F.array_contains(F.split(p, r"[/\\]"), "..")
    c = F.coalesce("content", F.lit(""))
    status = F.when(outside, "outside").when(F.col("known").isNull(), "unknown").when(F.octet_length(c) > most, "large").when(F.instr(c, "\u0000") > 0, "binary").otherwise("ok")
    return files.join(known, ["graphId", "path"], "left").select("file_row", status.alias("status"))


def domain_scan(files: DataFrame, depth: int = 6, per_folder: int = 50, most: int = 5000) -> DataFrame:
    """graphId, path of what a domain scan looks at: not deeper than depth, the first files of each folder by name, the first of each graph."""
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    f = files.select("graphId", "path").distinct().where(F.size(F.split("path", "/")) - 1 <= depth).withColumn("folder", folder)
    f = f.withColumn("r", F.row_number().over(Window.partitionBy("graphId", "folder").orderBy("path"))).where(F.col("r") <= per_folder)
    return f.withColumn("k", F.row_number().over(Window.partitionBy("graphId").orderBy("path"))).where(F.col("k") <= most).select("graphId", "path")


def sampled_files(files: DataFrame, words: list[str], k: int = 40) -> DataFrame:
    """graphId, path, n_words: the k files whose paths and texts hold most of the words, ties by path."""
    text = F.lower(F.concat_ws(" ", "path", "content"))
    score = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    f = files.select("graphId", "path", score.alias("n_words")).distinct().where("n_words > 0")
    return f.withColumn("r", F.row_number().over(Window.partitionBy("graphId").orderBy(F.desc("n_words"), "path"))).where(F.col("r") <= k).drop("r")


def trimmed(files: DataFrame, budget: int) -> DataFrame:
    """graphId, path, kept: how many bytes of each file fit into the budget of its graph, shortest files first, ties by path."""
    w = Window.partitionBy("graphId").orderBy("size", "path").rowsBetween(Window.unboundedPreceding, -1)
    f = files.select("graphId", "path", F.octet_length(F.coalesce("content", F.lit(""))).cast("long").alias("size"))
    before = F.coalesce(F.sum("size").over(w), F.lit(0))
    return f.withColumn("before", before).select("graphId", "path", F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("before"))).cast("long").alias("kept"))


def mutual_clusters(edges: DataFrame) -> DataFrame:
    """graphId, cluster, n: pairs linked both ways, joined by what they share, each named by its smallest member; with the nodes
    that are linked with at least two members of one."""
    from graphloom.operators.traverse import components

    e = edges.where("source <> target").select("graphId", "source", "target").distinct()
    pairs = e.join(e.select("graphId", F.col("target").alias("source"), F.col("source").alias("target")), ["graphId", "source", "target"], "left_semi")
    ids = pairs.select("graphId", F.col("source").alias("id")).distinct()
    core = cut_lineage(components(ids, pairs).select("graphId", "id", F.col("component").alias("cluster")))
    around = _links(edges, False).join(core.select("graphId", F.col("id").alias("next"), "cluster"), ["graphId", "next"]).join(core.select("graphId", "id"), ["graphId", "id"], "left_anti")
    joined = around.groupBy("graphId", "id", "cluster").agg(F.count("*").alias("k")).where("k >= 2").select("graphId", "id", "cluster")
    return core.union(joined.select("graphId", "id", "cluster")).groupBy("graphId", "cluster").agg(F.count("*").alias("n"))
