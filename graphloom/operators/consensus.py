"""Votes of several passes: consensus, agreement, inverted indexes and ranked neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import written

#: Terms of a set whose parts are listed, 63 at most.
MOST_TERMS = 6


def consensus(votes: DataFrame, key: list[str], verdict: str, voter: str, order: str) -> DataFrame:
    """Verdict with most votes (ties to the first seen), support and agreement.

    A voter counts once per verdict. agreement: unanimous (one verdict, more than one voter), majority (more than
    half), else split; single for one voter.
    """
    per = votes.where(F.col(verdict).isNotNull()).groupBy(*key, verdict).agg(F.countDistinct(voter).alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(*key)
    ranked = per.withColumns({"all": F.sum("n").over(w), "kinds": F.count("*").over(w), "place": F.row_number().over(w.orderBy(F.desc("n"), "first"))})
    agreement = F.when(F.col("all") == 1, "single").when(F.col("kinds") == 1, "unanimous").when(F.col("n") * 2 > F.col("all"), "majority").otherwise("split")
    return ranked.where("place = 1").select(*key, verdict, F.col("n").alias("support"), F.col("all").alias("n_votes"), agreement.alias("agreement"))


def quorum(claims: DataFrame, key: list[str], text: str, voter: str, least: int) -> DataFrame:
    """Texts of a unit that at least so many distinct voters give, once normalised; the least spelling stands for them."""
    norm = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    g = claims.where(F.coalesce(norm, F.lit("")) != "").groupBy(*key, norm.alias("norm")).agg(F.min(text).alias(text), F.countDistinct(voter).alias("n_voters"))
    return g.where(F.col("n_voters") >= least)


def first_mode(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value, ties to the first seen."""
    c = df.groupBy(*key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return c.groupBy(*key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def inverted_index(df: DataFrame, term: str, member: str, low: int, high: int) -> DataFrame:
    """Terms with between low and high distinct members."""
    return df.where(F.col(term).isNotNull()).groupBy(term).agg(F.countDistinct(member).alias("n_members")).where(F.col("n_members").between(low, high))


def _top(df: DataFrame, of: str, k: int, order: str = "other") -> DataFrame:
    """The k best rows per ``of``, by score, then the lesser ``order``, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(of).orderBy(F.desc("score"), order))).where(F.col("place") <= k)


def _parts(terms: F.Column) -> F.Column:
    """All subsets of an array but the empty one, each in the order of the array."""
    none = F.slice(terms, 1, 0)
    every = F.aggregate(terms, F.array(none), lambda acc, x: F.concat(acc, F.transform(acc, lambda part: F.concat(part, F.array(x)))))
    return F.filter(every, lambda part: F.size(part) > 0)


def _by_common(common: DataFrame, scope: str, term: str, k: int) -> DataFrame:
    """set_no, other, score: the first k + 1 members for each set of common terms.

    Who shares just a part of a set scores what the part weighs, and only the first k + 1 that hold the part can come
    in by it, as all that hold it score no less. So each set meets the holders of its parts, not all the other sets.
    Sets above MOST_TERMS have too many parts; they are met with each set that shares a term.
    """
    weight = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x["w"]), 6)
    small = F.size("set") <= MOST_TERMS
    sets = common.where("no = set_no").select(scope, "set_no", "set")
    firsts = common.where(F.col("nth") <= k + 1).select(scope, "set_no", "set", F.col("no").alias("other"))

    held = firsts.where(small).select(scope, F.explode(_parts(F.col("set"))).alias("part"), "other")
    held = held.withColumn("nth", F.row_number().over(Window.partitionBy(scope, "part").orderBy("other"))).where(F.col("nth") <= k + 1).drop("nth")
    by_part = sets.where(small).select(scope, "set_no", F.explode(_parts(F.col("set"))).alias("part")).join(held, [scope, "part"]).select("set_no", "other", weight("part").alias("score"))

    terms = sets.select(scope, "set_no", small.alias("small"), F.inline("set"))
    theirs = terms.select(scope, term, F.col("set_no").alias("theirs"), F.col("small").alias("small_too"))
    met = terms.where("not small").join(theirs, [scope, term]).select("set_no", "theirs", "w")
    met = met.union(terms.where("small").join(theirs.where("not small_too"), [scope, term]).select("set_no", "theirs", "w"))
    met = met.groupBy("set_no", "theirs").agg(F.round(F.sum("w"), 6).alias("score"))
    by_set = met.join(firsts.select(F.col("set_no").alias("theirs"), "other"), "theirs").select("set_no", "other", "score")
    return _top(by_part.union(by_set).groupBy("set_no", "other").agg(F.max("score").alias("score")), "set_no", k + 1).drop("place")


def ranked_neighbours(df: DataFrame, scope: str, term: str, member: str, k: int, low: int = 2, high: int = 40) -> DataFrame:
    """Best k others per member by what they share: sum of 10 / members-of-term over all shared terms.

    Terms of low..high members make pairs. Commoner ones make none, yet count in full: they are added to the pairs that
    rarer terms make, and members with the same common terms rank the others alike, so one list of k + 1 serves them all.
    An other that is not in that list and shares no rarer term has k better ones. Members are numbered in their order
    and pairs are made of numbers, at the member, so no pair is moved.
    """
    t = df.where(F.col(term).isNotNull()).groupBy(scope, member).agg(F.collect_set(term).alias("terms"))
    members = written(t.sort(scope, member).withColumn("no", F.monotonically_increasing_id()))
    t = members.select(scope, F.explode("terms").alias(term), F.when(F.col(member).isNotNull(), F.col("no")).alias("no"))
    size = t.groupBy(scope, term).agg(F.count("*").alias("df")).where(F.col("df") >= low)
    t = written(t.join(size, [scope, term]).where("no is not null").withColumn("w", 10.0 / F.col("df")))
    common = t.where(F.col("df") > high).groupBy(scope, "no").agg(F.array_sort(F.collect_list(F.struct(term, "w"))).alias("set"))
    alike = Window.partitionBy(scope, "set")
    common = written(common.withColumns({"set_no": F.min("no").over(alike), "nth": F.row_number().over(alike.orderBy("no"))}))

    rare = t.where(F.col("df") <= high).join(common.select("no", "set"), "no", "left")
    rare = rare.withColumn("holders", F.collect_list(F.struct("no", "set")).over(Window.partitionBy(scope, term)))
    pairs = rare.select("no", "w", "set", "holders").repartition("no").select("no", "w", "set", F.inline("holders").alias("other", "theirs")).where("no <> other")
    both = F.when(F.col("set").isNotNull() & F.col("theirs").isNotNull(), F.aggregate(F.array_intersect("set", "theirs"), F.lit(0.0), lambda s, x: s + x["w"])).otherwise(0.0)
    by_rare = pairs.select("no", "other", "w", both.alias("both")).groupBy("no", "other").agg(F.round(F.sum("w") + F.max("both"), 6).alias("score"))
    by_common = common.select("no", "set_no").join(_by_common(common, scope, term, k), "set_no").where("no <> other").select("no", "other", "score")

    scored = _top(by_rare, "no", k).drop("place").union(by_common).groupBy("no", "other").agg(F.max("score").alias("score"))
    names = members.select("no", scope, member)
    best = _top(scored, "no", k).join(names.select(F.col("no").alias("other"), F.col(member).alias("_other")), "other")
    return best.join(names, "no").select(scope, member, F.col("_other").alias("other"), "score", "place")


def jaccard(a: F.Column, b: F.Column) -> F.Column:
    """Share of common elements; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
