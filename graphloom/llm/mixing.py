"""Mixing sources to target weights (problem 9).

Entropy balancing: the rates closest (in relative entropy) to one copy of every document, among those that give each
source its tokens and no document more copies than allowed, are exponentially tilted in document size,
``min(max_repeats, exp(lambda * size))``, with one multiplier per source. The multipliers solve a convex dual by
Newton steps whose gradient and curvature are distributed sums; only one row per source comes to the driver. Rates
are then rounded to copies by a hash per document with a threshold per source that meets the source's tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.packing import byte_tokens
from graphloom.session import cut_lineage

#: Sources whose targets sum to no more than this may stay short of their target rather than shrink the collection.
SHORT_SHARE = 0.05
#: Newton steps at most, relative error of the tokens at which they end, classes of the rounding threshold.
STEPS, TOLERANCE, CLASSES = 60, 1e-6, 4096


def canonical_source(c: F.Column) -> F.Column:
    """Sources are spelled in any case, with blanks around them, with underscores or blanks for hyphens."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "-")


def plan_totals(have: dict[str, int], target: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens each source should give: its share of the largest total that the sources can carry.

    Sources without documents, and the scarcest sources while their targets sum to at most SHORT_SHARE, give all
    they may instead of bounding the total.
    """
    reach = {s: have.get(s, 0) * rep / share if share > 0 else math.inf for s, (share, rep) in target.items()}
    short = 0.0
    bound = math.inf
    for s in sorted(reach, key=lambda s: (reach[s], s)):
        if reach[s] == 0 or short + target[s][0] <= SHORT_SHARE:
            short += target[s][0]
            continue
        bound = reach[s]
        break
    if not math.isfinite(bound):
        bound = float(sum(have.get(s, 0) for s in target))
    bound = min(bound, total) if total else bound
    return {s: min(share * bound, float(have.get(s, 0) * rep)) for s, (share, rep) in target.items()}


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """doc_id, source, tokens, copies of the chosen documents (copies of at least one).

    documents: doc_id, source, text; null text or source is no candidate. targets: source, target_share,
    max_repeats; few rows. Repeated target rows, null or non-positive shares and repeats are left out. Sources
    without target are not used. The result depends on nothing but the tables.
    """
    spark = documents.sparkSession
    rows = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("r")).collect()
    target = {r["source"]: (float(r["s"]), int(r["r"])) for r in rows}
    empty = spark.createDataFrame([], "doc_id long, source string, tokens long, copies int")
    if not target:
        return empty
    sized = documents.where("text is not null").select("doc_id", canonical_source(F.col("source")).alias("source"), byte_tokens(F.col("text")).alias("tokens")).where(F.col("source").isin(*target))
    sized = cut_lineage(sized)  # three narrow columns; every later step reads these, not the texts
    # Documents of one size in one source move alike: the Newton sums run over these classes.
    classes = cut_lineage(sized.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    stats = {r["source"]: (int(r["t"]), float(r["m"])) for r in classes.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("t"), (F.sum(F.col("n") * F.col("tokens")) / F.sum("n")).alias("m")).collect()}
    if not stats:
        return empty
    goal = plan_totals({s: t for s, (t, _) in stats.items()}, target, total)
    lam = _newton(classes, stats, target, goal)

    params = spark.createDataFrame([(s, stats[s][1], lam[s], target[s][1]) for s in stats], "source string, mean double, lam double, cap int")
    rate = F.least(F.col("cap").cast("double"), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("tokens") / F.col("mean"))))
    rated = sized.join(F.broadcast(params), "source").withColumn("rate", rate)
    unit = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    # A document gets its next copy once the threshold passes u - frac(rate); at zero that is rounding at random.
    rated = rated.withColumns({"base": F.floor("rate").cast("int"), "need": unit - (F.col("rate") - F.floor("rate"))})
    rated = rated.withColumn("class", F.when((F.col("base") >= F.col("cap")) | (F.col("rate") == F.col("base")), CLASSES).otherwise(F.floor((F.col("need") + 1) / 2 * CLASSES)).cast("int"))
    bins = rated.groupBy("source", "class").agg(F.sum(F.col("base") * F.col("tokens")).alias("sure"), F.sum("tokens").alias("more"))
    # At most CLASSES + 1 rows per source from here on.
    upto = Window.partitionBy("source").orderBy("class")
    sure = bins.groupBy("source").agg(F.sum("sure").alias("sure"))
    want = spark.createDataFrame([(s, float(goal[s])) for s in stats], "source string, goal double")
    steps = bins.where(F.col("class") < CLASSES).withColumn("run", F.sum("more").over(upto)).join(sure.withColumnRenamed("sure", "base_tokens"), "source").join(F.broadcast(want), "source")
    cut = steps.where(F.col("base_tokens") + F.col("run") <= F.col("goal") + F.col("more") / 2).groupBy("source").agg(F.max("class").alias("last"))
    copies = F.col("base") + (F.col("class") <= F.coalesce("last", F.lit(-1))).cast("int")
    return rated.join(F.broadcast(cut), "source", "left").select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")


def _newton(classes: DataFrame, stats: dict, target: dict, goal: dict[str, float]) -> dict[str, float]:
    """Multipliers per source; each step is one distributed aggregate that returns a row per source."""
    spark = classes.sparkSession
    lam = {}
    for s, (tokens, _) in stats.items():
        full = tokens * target[s][1]
        lam[s] = 60.0 if goal[s] >= full * (1 - 1e-12) else 0.0
    low, high = {s: -60.0 for s in stats}, {s: 60.0 for s in stats}
    for _ in range(STEPS):
        now = spark.createDataFrame([(s, stats[s][1], lam[s], target[s][1]) for s in stats], "source string, mean double, lam double, cap int")
        x = F.col("tokens") / F.col("mean")
        tilt = F.exp(F.least(F.lit(50.0), F.col("lam") * x))
        got = classes.join(F.broadcast(now), "source").groupBy("source").agg(
            F.sum(F.col("n") * F.col("tokens") * F.least(F.col("cap").cast("double"), tilt)).alias("f"),
            F.sum(F.when(tilt < F.col("cap"), F.col("n") * F.col("tokens") * tilt * x).otherwise(0.0)).alias("df"),
        ).collect()
        worst = 0.0
        for r in got:
            s, gap = r["source"], r["f"] - goal[r["source"]]
            if lam[s] >= 60.0 or abs(gap) <= TOLERANCE * max(1.0, goal[s]):
                continue
            worst = max(worst, abs(gap) / max(1.0, goal[s]))
            (high if gap > 0 else low)[s] = lam[s]
            step = lam[s] - gap / r["df"] if r["df"] > 0 else math.nan
            lam[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2  # a step outside the bracket is halved
        if not worst:
            break
    return lam


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and reached share of the tokens, tokens, documents, copies, largest repeat."""
    by = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    t = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    joined = t.join(by, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over the few target rows
    return joined.select(
        "source", "target_share", "max_repeats", F.round(F.col("tokens") / everything, 6).alias("reached_share"), "tokens",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
