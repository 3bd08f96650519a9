"""References to records that do not exist (problem 1).

Parents and references are both addressed by a 128-bit digest of (graph, repaired id). The digest space is cut
into equal ranges, so no range is hot because of similar names and no sampling pass is needed. Every range
holds its parents as sorted arrays (aliases, ids, and the ids' life cycle by time); batches of references are
probed against them by vectorised binary search and only misses leave the task.

A range that gets many references (one popular target may have a third of all) is split by salt: its parent
arrays are repeated per salt and its references spread over the salts. Memory of a task is bounded by the
parents of one range plus one Arrow batch of references.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import has_prefix, trim_ws, with_repaired_id, with_repaired_ref
from graphloom.session import written

#: Parent rows that one range should hold, and references that one salt of a range should get.
PARENTS_PER_RANGE = 25_000
REFS_PER_SALT = 400_000
MAX_RANGES = 1 << 14

ALIAS, EVENT, REF = 0, 1, 2
NEVER = np.iinfo(np.int64).max  # moment of a row without time: later than any other


def references_of_edges(edges: DataFrame, name: str, row_key: str, moment: str) -> DataFrame:
    """Both endpoints of each row, once if they are spelled alike; null and blank endpoints are no references."""
    return _exploded(edges.select(
        F.lit(name).alias("ref_table"), F.col(row_key).cast("long").alias("row_id"), "graphId",
        F.col(moment).alias("moment"), F.array("source", "target").alias("refs"),
    ))


def references_of_members(layers: DataFrame, name: str, row_key: str, moment: str, members: str = "nodeIds") -> DataFrame:
    """The members of each row, once per spelling."""
    return _exploded(layers.select(
        F.lit(name).alias("ref_table"), F.col(row_key).cast("long").alias("row_id"), "graphId",
        F.col(moment).alias("moment"), F.col(members).alias("refs"),
    ))


def _exploded(df: DataFrame) -> DataFrame:
    out = df.withColumn("node_ref", F.explode(F.array_distinct("refs"))).drop("refs")
    return out.where(F.col("node_ref").isNotNull() & (trim_ws(F.col("node_ref")) != ""))


def _digests(graph: F.Column, key: F.Column, name: str) -> list[F.Column]:
    return [F.xxhash64(graph, key).alias(f"{name}1"), F.xxhash64(key, F.lit("#"), graph).alias(f"{name}2")]


def classify_references(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every reference that does not resolve at its moment, with its state.

    refs: ref_table, row_id, graphId, node_ref, moment. nodes: node_row, graphId, id, type, name, filePath, op,
    arrivedAt. Result: ref_table, row_id, graphId, node_ref, moment, state.

    A reference means the node whose raw id it repeats (the last such delivery decides), else the repaired id
    it equals, else the repaired id it would be repaired to. state is ``missing`` (no row at any time),
    ``late`` (only rows after the moment) or ``deleted`` (the latest row not after the moment is a delete).
    A reference without moment is judged by all rows; a node row without arrivedAt is later than any moment.
    Nodes with null or blank id are no parents; a null graphId is a graph of its own. Repeated node rows
    change nothing; of rows with equal arrivedAt the larger node_row counts.
    """
    spark = refs.sparkSession
    n_parents = nodes.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_ranges = int(min(MAX_RANGES, max(4 * tasks, -(-n_parents // PARENTS_PER_RANGE))))
    in_range = lambda d: F.pmod(F.shiftrightunsigned(d, 33), F.lit(n_ranges)).cast("int")
    g = F.coalesce(F.col("graphId"), F.lit("\u0000"))

    n = nodes.select(g.alias("g"), F.col("id").alias("raw"), "type", "filePath", "name", "node_row", "op", F.col("arrivedAt").alias("at"))
    n = with_repaired_id(n.where(trim_ws(F.col("raw")) != ""), "rid", node_id="raw")
    n = with_repaired_ref(with_repaired_ref(n, "raw", "rk"), "rid", "ik")
    n = n.select(
        *_digests(F.col("g"), F.col("raw"), "raw"), *_digests(F.col("g"), F.col("rid"), "id"),
        *_digests(F.col("g"), F.col("rk"), "rk"), *_digests(F.col("g"), F.col("ik"), "ik"),
        (~has_prefix(trim_ws(F.col("raw")))).alias("bare"), "node_row", "op", "at",
    )
    n = written(n)  # numbers only; three aggregates read them, so the repair runs once

    order = F.struct("at", "node_row")
    aliases = n.groupBy("raw1", "raw2").agg(
        F.max_by(F.struct("id1", "id2", "rk1", "rk2", "bare"), order).alias("v")
    ).where(F.col("v.bare") | (F.col("v.id1") != F.col("v.rk1")) | (F.col("v.id2") != F.col("v.rk2")))
    events = n.groupBy("id1", "id2", "ik1", "ik2", "at").agg((F.max_by("op", "node_row") == "delete").alias("gone"))
    # An id reached by an alias that lies elsewhere is told of there too.
    # The test stands behind the aggregate: in front of it, the optimizer would repeat the whole repair inside the filter.
    apart = F.bool_or((F.col("rk1") != F.col("ik1")) | (F.col("rk2") != F.col("ik2")))
    away = n.groupBy("id1", "id2", "rk1", "rk2").agg(apart.alias("apart")).where("apart").drop("apart")
    moved = events.join(away, ["id1", "id2"]).select("id1", "id2", F.col("rk1").alias("ik1"), F.col("rk2").alias("ik2"), "at", "gone")

    null_s, null_l = F.lit(None).cast("string"), F.lit(0).cast("long")
    blank = [null_l.alias("row_id"), null_s.alias("ref_table"), null_s.alias("graphId"), null_s.alias("node_ref")]
    directory = aliases.select(
        in_range(F.col("v.rk1")).alias("part"), F.lit(ALIAS).cast("byte").alias("kind"), F.col("raw1").alias("a1"), F.col("raw2").alias("a2"),
        F.col("v.id1").alias("b1"), F.col("v.id2").alias("b2"), F.lit(None).cast(dict(nodes.dtypes)["arrivedAt"]).alias("t"), F.lit(False).alias("gone"), *blank,
    ).unionByName(
        events.unionByName(moved).select(
            in_range(F.col("ik1")).alias("part"), F.lit(EVENT).cast("byte").alias("kind"), F.col("id1").alias("a1"), F.col("id2").alias("a2"),
            null_l.alias("b1"), null_l.alias("b2"), F.col("at").alias("t"), "gone", *blank,
        )
    )
    rows = with_repaired_ref(refs, "node_ref", "fixed").select(
        *_digests(g, F.col("node_ref"), "a"), *_digests(g, F.col("fixed"), "b"),
        F.col("moment").alias("t"), "row_id", "ref_table", "graphId", "node_ref",
    ).select(in_range(F.col("b1")).alias("part"), F.lit(REF).cast("byte").alias("kind"), "a1", "a2", "b1", "b2", "t", F.lit(False).alias("gone"), "row_id", "ref_table", "graphId", "node_ref")

    rows = written(rows)  # counted by range and then probed, so the repair of references runs once
    # One number per range, at most MAX_RANGES of them, tells which ranges need several tasks.
    hot = [(r["part"], int(-(-r["count"] // REFS_PER_SALT))) for r in rows.groupBy("part").count().where(F.col("count") > REFS_PER_SALT).collect()]
    if hot:
        salts = F.broadcast(spark.createDataFrame(hot, "part int, salts int"))
        directory = directory.join(salts, "part", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        rows = rows.join(salts, "part", "left").withColumn("salt", F.pmod(F.xxhash64("row_id", "a1"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    else:
        directory, rows = directory.withColumn("salt", F.lit(0)), rows.withColumn("salt", F.lit(0))

    tasks = max(tasks, (n_ranges + sum(s - 1 for _, s in hot)) // 4)
    moment_type = dict(refs.dtypes)["moment"]
    return (
        directory.unionByName(rows)
        .repartition(tasks, "part", "salt")
        .sortWithinPartitions("part", "salt", "kind")
        .mapInArrow(_probe, f"ref_table string, row_id long, graphId string, node_ref string, moment {moment_type}, state string")
    )


class _Range:
    """Sorted arrays of the parents of one range."""

    def __init__(self, kind: np.ndarray, a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray, t: np.ndarray, gone: np.ndarray):
        al, ev = kind == ALIAS, kind == EVENT
        self.alias = _Index(a1[al], a2[al])
        self.alias_to = np.column_stack([b1[al], b2[al]])[self.alias.order]
        e1, e2, et, eg = a1[ev], a2[ev], t[ev], gone[ev]
        self.ids = _Index(*_distinct(e1, e2))
        number = self.ids.find(e1, e2)
        self.times = np.unique(et)
        rank = np.searchsorted(self.times, et)
        key = number * (len(self.times) + 1) + rank
        o = np.argsort(key, kind="stable")
        self.key, self.gone = key[o], eg[o]

    def states(self, a1, a2, b1, b2, t) -> np.ndarray:
        """0 resolves, 1 missing, 2 late, 3 deleted."""
        hit = self.alias.find(a1, a2)
        own = self.ids.find(a1, a2)
        number = np.where(own >= 0, own, self.ids.find(b1, b2))
        if len(self.alias_to):
            to = self.alias_to[np.maximum(hit, 0)]
            number = np.where(hit >= 0, self.ids.find(to[:, 0], to[:, 1]), number)
        width = len(self.times) + 1
        rank = np.searchsorted(self.times, t, side="right") - 1  # last event time not after the moment
        pos = np.searchsorted(self.key, number * width + rank, side="right") - 1
        safe = np.maximum(pos, 0)
        there = (number >= 0) & (rank >= 0) & (pos >= 0)
        if len(self.key):
            there &= self.key[safe] // width == number
            gone = self.gone[safe]
        else:
            gone = np.zeros(len(t), bool)
        return np.where(number < 0, 1, np.where(~there, 2, np.where(gone, 3, 0)))


def _distinct(e1: np.ndarray, e2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((e2, e1))
    s1, s2 = e1[o], e2[o]
    new = np.ones(len(s1), bool)
    new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
    return s1[new], s2[new]


class _Index:
    """Binary search over two-part keys; runs of an equal first part are stepped through."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        self.order = np.lexsort((k2, k1))
        self.k1, self.k2 = k1[self.order], k2[self.order]
        starts = np.flatnonzero(np.r_[True, self.k1[1:] != self.k1[:-1]]) if len(k1) else np.zeros(0, int)
        self.run = int(np.diff(np.r_[starts, len(k1)]).max()) if len(k1) else 0

    def find(self, q1: np.ndarray, q2: np.ndarray) -> np.ndarray:
        out = np.full(len(q1), -1, np.int64)
        if not len(self.k1):
            return out
        at = np.searchsorted(self.k1, q1)
        for step in range(self.run):
            p = np.minimum(at + step, len(self.k1) - 1)
            out = np.where((out < 0) & (self.k1[p] == q1) & (self.k2[p] == q2), p, out)
        return out


_STATES = np.array(["", "missing", "late", "deleted"], dtype=object)


def _micros(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(NEVER).to_numpy(zero_copy_only=False)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, pending, arrays = None, [], None
    for batch in batches:
        part = batch.column("part").to_numpy()
        salt = batch.column("salt").to_numpy()
        cuts = np.flatnonzero((part[1:] != part[:-1]) | (salt[1:] != salt[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(part)], strict=True):
            if lo == hi:
                continue
            if current != (part[lo], salt[lo]):
                current, pending, arrays = (part[lo], salt[lo]), [], None
            kind = batch.column("kind").to_numpy()[lo:hi]
            split = lo + int(np.searchsorted(kind, REF))
            if split > lo:
                pending.append(_columns(batch.slice(lo, split - lo)))
            if split < hi:
                if arrays is None:
                    cols = [np.concatenate(x) for x in zip(*pending, strict=True)] if pending else _empty()
                    arrays, pending = _Range(*cols), []
                refs = batch.slice(split, hi - split)
                _, a1, a2, b1, b2, t, _ = _columns(refs)
                state = arrays.states(a1, a2, b1, b2, t)
                miss = np.flatnonzero(state)
                if len(miss):
                    out = refs.take(pa.array(miss))
                    yield pa.RecordBatch.from_arrays(
                        [out.column(c) for c in ("ref_table", "row_id", "graphId", "node_ref", "t")] + [pa.array(_STATES[state[miss]], pa.string())],
                        names=["ref_table", "row_id", "graphId", "node_ref", "moment", "state"],
                    )


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    plain = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "a1", "a2", "b1", "b2")]
    return [*plain, _micros(batch.column("t")), batch.column("gone").to_numpy(zero_copy_only=False)]


def _empty() -> list[np.ndarray]:
    return [np.zeros(0, x) for x in ("i1", "i8", "i8", "i8", "i8", "i8", "?")]


def orphan_report(misses: DataFrame) -> DataFrame:
    """Misses per table, calendar month of the moment and state; the partial counts are made before the shuffle."""
    return misses.groupBy(
        "ref_table", F.date_format("moment", "yyyy-MM").alias("month"), "state"
    ).agg(F.count("*").alias("n_refs"), F.countDistinct("graphId").alias("n_graphs"))


def drop_reasons(misses: DataFrame, dropped: DataFrame) -> DataFrame:
    """What was really wrong with each logged drop: drop_row, logged, actual.

    actual is ``missing-both``, ``missing-source``, ``missing-target`` or ``not-dangling``.
    """
    bad = misses.where(F.col("ref_table") == "dropped_edges").groupBy(F.col("row_id").alias("drop_row")).agg(F.collect_set("node_ref").alias("bad"))
    d = dropped.select("drop_row", "source", "target", F.col("reason").alias("logged")).join(bad, "drop_row", "left")
    s, t = (F.coalesce(F.array_contains("bad", F.col(c)), F.lit(False)) for c in ("source", "target"))
    actual = F.when(s & t, "missing-both").when(s, "missing-source").when(t, "missing-target").otherwise("not-dangling")
    return d.select("drop_row", "logged", actual.alias("actual"))
