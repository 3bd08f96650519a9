"""Fixed vocabularies of the graph model and small lookups built from them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


# Aliases of node types, for all graphs and by kind of graph.
NODE_ALIASES = {
    "func": "function", "fn": "function", "method": "function", "interface": "class", "struct": "class", "mod": "module", "pkg": "module", "package": "module", "container": "service",
    "deployment": "service", "pod": "service", "doc": "document", "readme": "document", "docs": "document", "job": "pipeline", "ci": "pipeline", "route": "endpoint", "api": "endpoint",
    "query": "endpoint", "mutation": "endpoint", "setting": "config", "env": "config", "configuration": "config", "infra": "resource", "infrastructure": "resource", "terraform": "resource",
    "migration": "table", "database": "table", "db": "table", "view": "table", "proto": "schema", "protobuf": "schema", "definition": "schema", "typedef": "schema",
    "business_domain": "domain", "business_flow": "flow", "business_process": "flow", "task": "step", "business_step": "step", "note": "article", "wiki_page": "article", "person": "entity",
    "actor": "entity", "organization": "entity", "tag": "topic", "category": "topic", "theme": "topic", "assertion": "claim", "decision": "claim", "thesis": "claim", "reference": "source",
    "raw": "source", "paper": "source",
}
DESIGN_NODE_ALIASES = {
    "frame": "screen", "artboard": "screen", "canvas": "page", "main_component": "component", "component_set": "componentSet", "variant_set": "componentSet", "componentset": "componentSet",
    "design_token": "token", "style": "token",
}
CODE_NODE_ALIASES = {"page": "article"}
EDGE_ALIASES = {
    "extends": "inherits", "invokes": "calls", "invoke": "calls", "uses": "depends_on", "requires": "depends_on", "relates_to": "related", "related_to": "related", "similar": "similar_to",
    "import": "imports", "export": "exports", "contain": "contains", "publish": "publishes", "subscribe": "subscribes", "describes": "documents", "documented_by": "documents",
    "creates": "provisions", "exposes": "serves", "listens": "serves", "deploys_to": "deploys", "migrates_to": "migrates", "routes_to": "routes", "triggers_on": "triggers",
    "fires": "triggers", "defines": "defines_schema", "has_flow": "contains_flow", "next_step": "flow_step", "interacts_with": "cross_domain", "references": "cites",
    "cites_source": "cites", "conflicts_with": "contradicts", "disagrees_with": "contradicts", "refines": "builds_on", "elaborates": "builds_on", "illustrates": "exemplifies",
    "example_of": "exemplifies", "belongs_to": "categorized_under", "tagged_with": "categorized_under", "written_by": "authored_by", "created_by": "authored_by",
}
DESIGN_EDGE_ALIASES = {"instantiates": "instance_of", "variant": "variant_of", "styled_by": "uses_token", "applies_token": "uses_token"}
CODE_EDGE_ALIASES = {"instance_of": "exemplifies"}
COMPLEXITY_ALIASES = {
    "low": "simple", "easy": "simple", "medium": "moderate", "intermediate": "moderate", "high": "complex", "hard": "complex", "difficult": "complex",
}
COMPLEXITY_BATCH_ALIASES = COMPLEXITY_ALIASES | {"trivial": "simple", "basic": "simple", "mid": "moderate", "average": "moderate", "advanced": "complex"}
DIRECTION_ALIASES = {
    "to": "forward", "outbound": "forward", "from": "backward", "inbound": "backward", "both": "bidirectional", "mutual": "bidirectional",
}
DIRECTIONS = ("forward", "backward", "bidirectional")

# Node types by category and edge types by category.
NODE_CATEGORIES = {
    "code": ["file", "function", "class", "module", "concept"], "config": ["config"], "docs": ["document"], "infra": ["service", "resource", "pipeline"],
    "data": ["table", "endpoint", "schema"], "domain": ["domain", "flow", "step"], "knowledge": ["article", "entity", "topic", "claim", "source"],
    "design": ["screen", "page", "component", "componentSet", "instance", "token"],
}
EDGE_CATEGORIES = {
    "structural": ["imports", "exports", "contains", "inherits", "implements"], "behavioral": ["calls", "subscribes", "publishes", "middleware"],
    "data-flow": ["reads_from", "writes_to", "transforms", "validates"], "dependencies": ["depends_on", "tested_by", "configures"], "semantic": ["related", "similar_to"],
    "infrastructure": ["deploys", "serves", "provisions", "triggers", "migrates", "documents", "routes", "defines_schema"], "domain": ["contains_flow", "flow_step", "cross_domain"],
    "knowledge": ["cites", "contradicts", "builds_on", "exemplifies", "categorized_under", "authored_by"], "design": ["instance_of", "variant_of", "uses_token"],
}
NODE_CATEGORY = {t: c for c, ts in NODE_CATEGORIES.items() for t in ts}
EDGE_CATEGORY = {t: c for c, ts in EDGE_CATEGORIES.items() for t in ts}
#: Weight of an edge type where none is given; other types have 0.5.
EDGE_WEIGHTS = {"contains": 1.0, "inherits": 0.9, "implements": 0.9, "calls": 0.8, "exports": 0.8, "defines_schema": 0.8, "imports": 0.7, "deploys": 0.7, "migrates": 0.7, "depends_on": 0.6, "configures": 0.6, "triggers": 0.6}

# Architecture layers in order of precedence, with the path segments that tell them.
LAYER_PATTERNS = [
    ("API Layer", ["routes", "controller", "handler", "endpoint", "api"]), ("Service Layer", ["service", "usecase", "use-case", "business"]),
    ("Data Layer", ["model", "entity", "schema", "database", "db", "migration", "repository", "repo"]), ("UI Layer", ["component", "view", "page", "screen", "layout", "widget", "ui"]),
    ("Middleware Layer", ["middleware", "interceptor", "guard", "filter", "pipe"]), ("External Services", ["client", "integration", "external", "sdk", "vendor", "adapter"]),
    ("Background Tasks", ["worker", "job", "queue", "cron", "consumer", "processor", "scheduler", "background"]), ("Utility Layer", ["util", "helper", "lib", "common", "shared"]),
    ("Test Layer", ["test", "spec", "__test__", "__spec__", "__tests__", "__specs__"]), ("Configuration Layer", ["config", "setting", "env"]),
]

# Concepts and the words that hint at them.
CONCEPTS = {
    "async/await": ["async", "await", "promise", "asynchronous"], "middleware pattern": ["middleware", "interceptor", "pipe"], "generics": ["generic", "type parameter", "template"],
    "decorators": ["decorator", "@", "annotation"], "dependency injection": ["inject", "provider", "container", "di"],
    "observer pattern": ["subscribe", "publish", "event", "observable", "listener"], "singleton": ["singleton", "instance", "shared client"],
    "type guards": ["type guard", "is", "narrowing", "discriminated union"], "higher-order functions": ["callback", "factory", "higher-order", "closure"],
    "error handling": ["try/catch", "error boundary", "exception", "Result type"], "streams": ["stream", "pipe", "transform", "readable", "writable"],
    "concurrency": ["goroutine", "channel", "thread", "worker", "mutex"],
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null where it has none."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))[key]
