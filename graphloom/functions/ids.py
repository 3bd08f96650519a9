"""Node-id repair as column expressions (no Python on the hot path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The id prefixes that count as valid, and the prefix expected for a node type.
VALID_PREFIXES = (
    "file", "func", "class", "module", "concept", "config", "document", "service", "table",
    "endpoint", "pipeline", "schema", "resource", "domain", "flow", "step",
)
TYPE_TO_PREFIX = {p: p for p in VALID_PREFIXES if p != "func"} | {"function": "func"}

# White space as String.prototype.trim sees it.
WS = r"[\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WS_CHARS = " \t\n\u000b\u000c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_V = "|".join(VALID_PREFIXES)
# Lazily skips foreign segments up to the first valid one, then takes the innermost of a run of valid ones.
PREFIX_RE = rf"(?s)^(?:[^:]+:)*?(?:(?:{_V}):)*({_V}):(.*)$"
FOREIGN_RE = r"^(?:[^:]+:)+"
# Most ids are spelled well; one anchored look tells them from those that need the searching pattern.
CLEAN_RE = rf"^(?:{_V}):(?!(?:{_V}):)"


def trim_ws(c: Column) -> Column:
    """Without white space at its ends; a set of characters is stripped many times faster than a pattern."""
    return F.trim(c, F.lit(WS_CHARS))


def has_prefix(trimmed: Column) -> Column:
    return F.when(trimmed.rlike(CLEAN_RE), True).otherwise(trimmed.rlike(PREFIX_RE))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), f"{WS}+", "-")


def expected_prefix(node_type: Column) -> Column:
    """Prefix of a type, null for a type that has none."""
    kind = F.lower(node_type)
    return F.when(kind == "function", "func").when(kind.isin(*[p for p in VALID_PREFIXES if p != "func"]), kind)


def with_repaired_id(
    df: DataFrame, out: str = "rid", node_id: str = "id", node_type: str = "type", file_path: str = "filePath",
    name: str = "name", flow_slug: str | None = None,
) -> DataFrame:
    """Adds the canonical ``prefix:path`` id of each node.

    Doubled prefixes collapse, foreign segments in front of a valid prefix go, bare paths get the prefix of
    the node's type (functions and classes are rebuilt from file and name, steps keep their flow). The type
    is read without regard to case. Null stays null, blank becomes empty, an id without valid prefix whose
    type has none is only trimmed. Worked out in stages so that no expression is repeated in the plan.
    """
    flow = F.coalesce(F.col(flow_slug), F.lit("")) if flow_slug else F.lit("")
    path, label = F.coalesce(F.col(file_path), F.lit("")), F.coalesce(F.col(name), F.lit(""))
    kind = F.coalesce(F.lower(F.col(node_type)), F.lit(""))
    staged = df.withColumn("_t", trim_ws(F.col(node_id))).withColumns(
        {"_clean": F.col("_t").rlike(CLEAN_RE), "_kind": kind, "_exp": expected_prefix(F.col(node_type))}
    )
    staged = staged.withColumn("_canon", F.when(F.col("_clean"), F.col("_t")).otherwise(F.regexp_replace("_t", PREFIX_RE, "$1:$2")))
    # Where the searching pattern does not match, it replaces nothing and the text has no valid prefix.
    staged = staged.withColumns({"_has": F.col("_clean") | F.col("_canon").rlike(CLEAN_RE), "_rest": F.when(F.col("_clean"), F.col("_t")).otherwise(F.regexp_replace("_t", FOREIGN_RE, "")), "_parts": F.split("_canon", ":")})
    step = (F.col("_kind") == "step") & (path != "")
    flow_of = F.when(F.size("_parts") > 2, F.concat(F.element_at("_parts", F.greatest(F.size("_parts") - 1, F.lit(1))), F.lit(":"))).otherwise(F.lit(""))
    made = (
        F.when(F.col("_t").isNull(), F.lit(None).cast("string"))
        .when(F.col("_t") == "", F.lit(""))
        .when(F.col("_has") & step, F.concat(F.element_at("_parts", 1), F.lit(":"), flow_of, path, F.lit(":"), F.element_at("_parts", -1)))
        .when(F.col("_has"), F.col("_canon"))
        .when(F.col("_kind").isin("function", "class") & (path != "") & (label != ""), F.concat("_exp", F.lit(":"), path, F.lit(":"), label))
        .when(step, F.concat("_exp", F.lit(":"), F.when(flow != "", F.concat(flow, F.lit(":"))).otherwise(F.lit("")), path, F.lit(":"), slug(F.col("_rest"))))
        .when(F.col("_exp").isNotNull(), F.concat("_exp", F.lit(":"), F.col("_rest")))
        .otherwise(F.col("_t"))
    )
    return staged.withColumn(out, made).drop("_t", "_has", "_clean", "_kind", "_exp", "_canon", "_rest", "_parts")


def with_repaired_ref(df: DataFrame, ref: str, out: str) -> DataFrame:
    """Adds the repair of an edge endpoint whose node is unknown: the type is inferred from the id itself."""
    t = F.col("_t")
    return (
        df.withColumn("_t", trim_ws(F.col(ref)))
        .withColumn(
            out,
            F.when(t == "", t).when(t.rlike(CLEAN_RE), t).when(t.rlike(PREFIX_RE), F.regexp_replace(t, PREFIX_RE, "$1:$2"))
            .when(t.isNotNull(), F.concat(F.lit("file:"), F.regexp_replace(t, FOREIGN_RE, ""))),
        )
        .drop("_t")
    )
