"""Fuzzy and vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import schema as S

# Weights of the searched fields.
FIELD_WEIGHTS = {"name": 0.4, "tags": 0.3, "summary": 0.2, "notes": 0.1}
#: Rows and queries of one block of a vector search: bounds the memory of a task to one product of that size.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024


#: Share of a token's letters that may be wrong where it is matched with the beginning of a word.
FUZZ = 0.4


def text_score(token: str, name: Column, tags: Column, summary: Column, notes: Column) -> Column:
    """Badness in [0, 1] of one token, 0 best: weighted over the fields; equal beats prefix beats inside beats nearly.

    Nearly means that the token is the beginning of a word but for FUZZ of its letters at most (edit distance); it
    costs 0.3 and the share of wrong letters.
    """
    t = token.lower()
    most = int(len(t) * FUZZ)

    def near(low: Column) -> Column:
        words = F.array_distinct(F.split(low, "[^a-z0-9]+"))
        wrong = lambda w: F.least(*[F.levenshtein(F.lit(t), F.substring(w, 1, len(t) + d)) for d in (0, 1)])
        return F.array_min(F.transform(words, wrong))

    def miss(c: Column) -> Column:
        low = F.lower(F.coalesce(c, F.lit("")))
        exact = F.when(low == t, 0.0).when(low.startswith(t), 0.1).when(F.instr(low, t) > 0, 0.3)
        return exact.when(near(low) <= most, F.lit(0.3) + near(low) / F.lit(float(len(t)))).otherwise(1.0) if most else exact.otherwise(1.0)

    w = FIELD_WEIGHTS
    return (w["name"] * miss(name) + w["tags"] * miss(F.array_join(tags, " ", "")) + w["summary"] * miss(summary) + w["notes"] * miss(notes)) / sum(w.values())


def search(nodes: DataFrame, query: str, k: int = 50, types: list[str] | None = None) -> DataFrame:
    """Best nodes of every graph for any token of the query; blank queries find nothing. Score in [0, 1], lower is better.

    types are applied after scoring and before the limit. Ties go to the first delivered.
    """
    tokens = query.split()
    if not tokens:
        return nodes.select("graphId", "id", F.lit(1.0).alias("score"), F.lit(0).alias("place")).limit(0)
    n = nodes.where(F.col("type").isin(*types)) if types else nodes
    score = F.least(*[text_score(t, F.col("name"), F.col("tags"), F.col("summary"), F.col("languageNotes")) for t in tokens], F.lit(1.0))
    hit = n.select("graphId", "id", "node_ord", F.round(score, 6).alias("score")).where("score < 1")
    w = Window.partitionBy("graphId").orderBy("score", "node_ord")
    return hit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("graphId", "id", "score", "place")


def cosine(a: Column, b: Column) -> Column:
    """Over the length of the first vector; a shorter second gives null, zero vectors 0."""
    b = F.slice(b, 1, F.size(a))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when((size(a) == 0) | (size(b) == 0), 0.0).otherwise(dot / (size(a) * size(b)))


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar rows of each query by cosine: query, key, score = 1 - similarity, place; ties to the smaller key.

    Rows and queries are spread over blocks of bounded size; each pair of blocks is one matrix product whose best k
    per query are merged afterwards. Null vectors and rows whose length differs from the query's are left out; a zero
    vector has similarity 0. A query is compared with all rows but itself.
    """
    n_rows, n_q = rows.count(), queries.count()
    rb, qb = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_q // BLOCK_QUERIES))
    v = F.transform(vector, lambda x: x.cast("double")).alias("v")
    r = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), v, F.pmod(F.xxhash64(key), F.lit(rb)).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), v, F.pmod(F.xxhash64(key), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rb - 1).cast("long"))).alias("rb"))
    pairs = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb"))
    part = pairs.applyInPandas(lambda a, b: _product(a, b, k), "query long, key long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    best = part.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return best.select("query", F.col("key").alias(key), (F.round(1 - F.col("similarity"), 5) + 0.0).alias("score"), "place")


def _product(q: pd.DataFrame, r: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[pd.DataFrame] = []
    if len(q) and len(r):
        for n, qs in q.groupby(q["v"].map(len)):
            rs = r[r["v"].map(len) == n].sort_values("key")
            if not len(rs):
                continue
            a, b = np.stack(qs["v"].to_numpy()), np.stack(rs["v"].to_numpy())
            unit = lambda m: m / np.where((s := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, s)
            sim = np.round(unit(a) @ unit(b).T, 12)
            keys, ids = rs["key"].to_numpy(), qs["query"].to_numpy()
            sim[ids[:, None] == keys[None, :]] = -np.inf
            top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            s = np.take_along_axis(sim, top, 1)
            f = pd.DataFrame({"query": np.repeat(ids, top.shape[1]), "key": keys[top].ravel(), "similarity": s.ravel()})
            out.append(f[np.isfinite(f["similarity"])])
    return pd.concat(out) if out else pd.DataFrame({"query": np.zeros(0, "i8"), "key": np.zeros(0, "i8"), "similarity": np.zeros(0)})


def concepts(nodes: DataFrame) -> DataFrame:
    """graphId, id, concept of every concept one of whose words occurs in tags or summary (plain substring)."""
    text = F.lower(F.concat_ws(" ", F.array_join("tags", " ", ""), F.coalesce("summary", F.lit(""))))
    found = F.array_compact(F.array(*[F.when(_any(text, words), F.lit(c)) for c, words in S.CONCEPTS.items()]))
    return nodes.select("graphId", "id", F.explode(found).alias("concept"))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (F.instr(text, w.lower()) > 0)
    return out


def similar_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # difflib has no JVM twin
    """ratio of two texts (columns a, b) by longest matching blocks."""
    from difflib import SequenceMatcher

    for pdf in batches:
        yield pdf.assign(ratio=[SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(pdf["a"], pdf["b"], strict=True)])
