"""Claims about units: votes, verdicts, evidence, agreement, roles and symbols, release timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Verdicts, those that need evidence, those of former prompts; of equal votes the first of the list wins.
VERDICTS = ("supported", "contradicted", "unverifiable")
EVIDENCE_REQUIRED = ("supported", "contradicted")
LEGACY_VERDICTS = ("overstated",)
TIE_PRIORITY = ("contradicted", "unverifiable", "supported")

# Roles of a claim in order of precedence with the words that tell them, and shapes of symbols.
ROLE_PATTERNS = {
    "rationale": r"(?i)\b(because|forces|would (?:never|otherwise|leak|trade)|enables|ensures|avoids|prevents|so that|makes .* brittle|is the safe default|trades?|suited to|at the cost of)\b",
    "responsibility": r"(?i)\b(owns?|responsib\w+|belongs to|delegat\w+|is not responsible|the .*'s (?:only|sole) )\b",
    "omission": r"(?i)\b(needs no|no handling|deliberately|intentionally|rather than|instead of|does not (?:close|handle|touch|read|mutate)|never (?:closes|handles))\b",
    "lifecycle": r"(?i)\b(lifetime|reclaimed|retired|leaks?|teardown|pinned|shutdown|disposed|survives|for the life of)\b",
    "invariant": r"(?i)\b(never|always|guarantee\w*|invariant|must not|cannot|is fixed for|remains? stable)\b",
}
SYMBOL_PATTERNS = (r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+)\b", r"\b([A-Za-z_][A-Za-z0-9_]*\.[a-z_][A-Za-z0-9_]*)\b", r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b")
SYMBOL_STOP = ("async_generator", "context_manager", "type_check", "read_only", "per_attempt", "round_robin", "load_balancer", "worker_pool", "no_op", "op_out")


def resolved_verdict(verdict: Column, verified: Column) -> Column:
    """A vote's verdict after its evidence was checked: what needs evidence and has none is unverifiable.

    Former ``overstated`` is supported where its evidence holds. Unknown and null verdicts are unverifiable.
    """
    ok = F.coalesce(verified, F.lit(False))
    return F.when(verdict.isin(*LEGACY_VERDICTS, *EVIDENCE_REQUIRED) & ~ok, "unverifiable").when(verdict.isin(*LEGACY_VERDICTS), "supported").when(verdict.isin(*VERDICTS), verdict).otherwise("unverifiable")


def ranked_consensus(expected: DataFrame, votes: DataFrame, key: list[str], bundle: str) -> DataFrame:
    """key, bundle, verdict, agreement, n_top, n_votes of every expected claim.

    expected: key and bundle. votes: key, bundle, voter, verdict; a voter counts once per verdict. Of equally many votes contradicted comes
    before unverifiable before supported. unanimous: all votes, at least as many as voters saw the bundle, and more
    than one; majority: more than half; else split; missing without votes.
    """
    per = votes.groupBy(*key, "verdict").agg(F.countDistinct("voter").alias("n"))
    rank = F.create_map(*[F.lit(x) for i, v in enumerate(TIE_PRIORITY) for x in (v, i)])[F.col("verdict")]
    top = per.groupBy(*key).agg(F.max_by(F.struct("verdict", "n"), F.struct("n", -rank)).alias("v"), F.sum("n").alias("n_votes"))
    seen = votes.groupBy(bundle).agg(F.countDistinct("voter").alias("n_voters"))
    j = expected.select(*dict.fromkeys([*key, bundle])).distinct().join(top, key, "left").join(seen, bundle, "left")
    n, total = F.col("v.n"), F.col("n_votes")
    level = F.when(total.isNull(), "missing").when((n == total) & (total >= F.col("n_voters")) & (F.col("n_voters") > 1), "unanimous").when(n * 2 > total, "majority").otherwise("split")
    return j.select(*dict.fromkeys([*key, bundle]), F.col("v.verdict").alias("verdict"), level.alias("agreement"), F.coalesce(n, F.lit(0)).alias("n_top"), F.coalesce(total, F.lit(0)).alias("n_votes"))


def disputed(votes: DataFrame, key: list[str]) -> DataFrame:
    """Claims with at least two votes and more than one verdict."""
    return votes.groupBy(*key).agg(F.count("*").alias("n_votes"), F.countDistinct("verdict").alias("n_verdicts")).where("n_votes >= 2 and n_verdicts > 1")


def adjudicated(consensus: DataFrame, rulings: DataFrame, key: list[str]) -> DataFrame:
    """Consensus with the rulings (key, ruling) in place of it, and whether a ruling changed it."""
    j = consensus.join(rulings, key, "left")
    return j.select(*key, F.coalesce("ruling", "verdict").alias("verdict"), F.when(F.col("ruling").isNotNull(), "adjudicated").otherwise(F.col("agreement")).alias("agreement"), F.coalesce(F.col("ruling") != F.col("verdict"), F.lit(False)).alias("overruled"))


def tallies(results: DataFrame, group: str) -> DataFrame:
    """Counts and shares of verdicts by group, with all margins in one pass."""
    cube = results.where("verdict is not null").cube("verdict", group).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("margin"))
    return cube


def roles(text: Column) -> Column:
    """Roles that a text plays, in order of precedence; ``mechanism`` where none fits."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(r)) for r, p in ROLE_PATTERNS.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("mechanism")))


def symbols(text: Column) -> Column:
    """Symbols named in a text: camel case, dotted and snake case of four letters and more, and the tails of dotted ones."""
    every = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in SYMBOL_PATTERNS]))
    kept = F.filter(every, lambda s: (F.length(s) >= 4) & ~F.lower(s).isin(*SYMBOL_STOP))
    tails = F.transform(F.filter(kept, lambda s: F.contains(s, F.lit("."))), lambda s: F.substring_index(s, ".", -1))
    return F.array_sort(F.array_distinct(F.concat(kept, tails)))


def symbol_blocks(claims: DataFrame, low: int = 2, high: int = 40) -> DataFrame:
    """graphId, symbol, n_claims, n_roles, crosses of the symbols that low to high claims name and that do more than mechanism.

    claims: graphId, claim, part (what the claim belongs to), text.
    """
    c = claims.select("graphId", "claim", "part", roles(F.col("text")).alias("roles"), F.explode(symbols(F.col("text"))).alias("symbol"))
    b = c.groupBy("graphId", "symbol").agg(F.countDistinct("claim").alias("n_claims"), F.countDistinct("part").alias("n_parts"), F.max(F.size(F.array_except("roles", F.array(F.lit("mechanism"))))).alias("explains"))
    return b.where(F.col("n_claims").between(low, high) & (F.col("explains") > 0)).select("graphId", "symbol", "n_claims", (F.col("n_parts") > 1).alias("crosses"))


def collapsed(claims: DataFrame, scope: list[str], text: str, key: str) -> DataFrame:
    """Each claim with the smallest key among those of equal text (case and white space aside) in its scope."""
    norm = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    c = claims.where(F.coalesce(norm, F.lit("")) != "").select(*scope, key, norm.alias("_norm"))
    first = c.groupBy(*scope, "_norm").agg(F.min(key).alias("first"))
    return c.join(first, [*scope, "_norm"]).select(*scope, key, "first")


def contained(inner: DataFrame, outer: DataFrame, by: list[str], slack: int = 3, width: int = 64) -> DataFrame:
    """Pairs of an inner range (start, stop, inner_id) and an outer one (lo, hi, outer_id) that holds it, ``slack`` lines wider each way.

    Outer ranges are cut into buckets of lines for an equi-join on the bucket in which the inner range starts.
    """
    o = outer.where("lo <= hi").select(*by, (F.col("lo") - slack).alias("lo"), (F.col("hi") + slack).alias("hi"), "outer_id")
    o = o.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    i = inner.where("start <= stop").withColumn("_b", F.floor(F.col("start") / width))
    return i.join(o, [*by, "_b"]).where("start >= lo and stop <= hi and inner_id <> outer_id").select("inner_id", "outer_id")


def linked(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """graphId, ref, node, how: the node a claim's id means: exact, else the class that its dotted name belongs to, else its file."""
    parts = F.split("ref", ":")
    path, name = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    c = claims.select("graphId", "ref", F.concat(F.lit("class:"), path, F.lit(":"), F.substring_index(name, ".", 1)).alias("as_class"), F.concat(F.lit("file:"), path).alias("as_file")).distinct()
    known = lambda x: nodes.select("graphId", F.col("id").alias(x), F.col("id").alias(f"{x}_id"))
    j = c.join(known("ref"), ["graphId", "ref"], "left").join(known("as_class"), ["graphId", "as_class"], "left").join(known("as_file"), ["graphId", "as_file"], "left")
    how = F.when(F.col("ref_id").isNotNull(), "exact").when(F.col("as_class_id").isNotNull(), "class").when(F.col("as_file_id").isNotNull(), "file").otherwise("none")
    return j.select("graphId", "ref", F.coalesce("ref_id", "as_class_id", "as_file_id").alias("node"), how.alias("how"))


def merged_principles(nodes: DataFrame) -> DataFrame:
    """Principles of one slug: rows, batches that gave them, and the distinct tags of all as one sorted list."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    n = nodes.select("graphId", slug.alias("slug"), "batch_ord", F.explode_outer("tags").alias("tag"), "node_row")
    heads = n.groupBy("graphId", "slug").agg(F.countDistinct("node_row").alias("n_rows"), F.countDistinct("batch_ord").alias("n_batches"))
    tags = n.where("tag is not null").select("graphId", "slug", "tag").distinct().groupBy("graphId", "slug").agg(F.count("*").alias("n_tags"), F.min("tag").alias("first_tag"))
    return heads.join(tags, ["graphId", "slug"], "left").fillna(0, ["n_tags"])


def shared_terms(nodes: DataFrame) -> DataFrame:
    """Terms (names) used in at least two graphs with at least two bodies (summaries): term, n_graphs, n_bodies, least body."""
    n = nodes.where("name is not null and summary is not null")
    return n.groupBy(F.col("name").alias("term")).agg(F.countDistinct("graphId").alias("n_graphs"), F.countDistinct("summary").alias("n_bodies"), F.min("summary").alias("body")).where("n_graphs >= 2 and n_bodies >= 2")


def series_viability(timeline: DataFrame, scope: str, series: str) -> DataFrame:
    """Per scope: units, those without a series, distinct series, the largest one (ties to the smallest name) with its share, and units outside it."""
    per = timeline.groupBy(scope, series).agg(F.count("*").alias("n"))
    known = F.when(F.col(series).isNotNull(), F.col("n")).otherwise(0)
    top = F.max_by(F.struct(series, "n"), F.struct(F.when(F.col(series).isNotNull(), F.col("n")), F.negative(F.col(series))))
    g = per.groupBy(scope).agg(F.sum("n").alias("n_units"), F.sum(F.when(F.col(series).isNull(), F.col("n")).otherwise(0)).alias("n_unknown"), F.count_if(F.col(series).isNotNull()).alias("n_series"), F.sum(known).alias("_known"), top.alias("_top"))
    best = F.when(F.col("n_series") > 0, F.col(f"_top.{series}"))
    return g.select(scope, "n_units", "n_unknown", "n_series", best.alias("largest"), F.round(F.coalesce(F.when(F.col("n_series") > 0, F.col("_top.n")), F.lit(0)) / F.col("n_units"), 6).alias("share"), (F.col("_known") - F.coalesce(F.when(F.col("n_series") > 0, F.col("_top.n")), F.lit(0))).alias("n_outside"))


def support_histogram(claims: DataFrame, key: list[str], voter: str) -> DataFrame:
    """How many claims have how many distinct voters."""
    return claims.groupBy(*key).agg(F.countDistinct(voter).alias("support")).groupBy("support").agg(F.count("*").alias("n_claims"))


def latest_vote(votes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Verdict of the last vote of each claim as its ruling."""
    return votes.groupBy(*key).agg(F.max_by("verdict", F.struct(*order)).alias("ruling"))


def first_per(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
