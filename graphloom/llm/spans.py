"""Long exact spans shared between records (problem 10).

Sliding spans: from chosen starts in a text a span of consecutive sentences is hashed and the hashes are joined
globally. A shared passage need not begin where a sentence begins nor hold a whole one, so starts are chosen so
that none is missed: in every stretch of WINDOW places the first choice is a sentence start, and where there is none
the place whose 16-gram hashes lowest. The choice depends only on the characters of the stretch, so two texts
that share SPAN characters share a start with its whole hashed run of RUN characters: the run and the stretch, with
the two characters that tell a sentence start, fit into SPAN.

Equal texts are one class and are compared once. Of a passage shared by two classes only the first and the last
common start of each unbroken chain are compared, and the exact check extends them to both sides on the characters
themselves. The two of one chain bound its stretch of that pair; nothing else fills a passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

SPAN, RUN, GRAM, LOOK = 200, 100, 16, 3
#: Places among which one start is certain: LOOK + WINDOW + RUN - 1 characters fit into SPAN.
WINDOW = SPAN - RUN - LOOK
#: Characters hashed at once; bounds the memory of the vectorised pass.
BLOCK = 1 << 19

_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_SENTENCE_END = re.compile(r"[.!?](?:[ \n]|\Z)|[。！？]|\n")
_ENDS = np.array([ord(c) for c in ".!?。！？"], np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _B), ("down", _BINV)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def span_starts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen starts of a text (code points) and the hash of the run at each; runs that leave the text are dropped."""
    n = len(codes)
    if n < RUN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        up, down = _POWERS.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * up[:n], out=sums[1:])
        places = n - GRAM + 1
        gram = _mix((sums[GRAM:] - sums[:places]) * down[:places])
        space = codes == 10
        first = np.zeros(n, bool)
        first[1:] |= space[:-1]
        stop = np.isin(codes, _ENDS)
        wide = stop & (codes > 127)
        first[1:] |= wide[:-1]
        first[2:] |= stop[:-2] & ((codes[1:-1] == 32) | space[1:-1])
        # A sentence start comes before any other place; of equal ones the last counts.
        key = (gram >> np.uint64(1)) | (np.where(first[:places], np.uint64(0), np.uint64(1)) << np.uint64(63))
        chosen = _window_minima(key)
        chosen = chosen[chosen <= n - RUN]
        run = _mix((sums[chosen + RUN] - sums[chosen]) * down[chosen])
    return chosen, run.view(np.int64)


def _window_minima(key: np.ndarray) -> np.ndarray:
    """Places that are the rightmost minimum of some WINDOW neighbouring places."""
    n = len(key)
    if n <= WINDOW:
        return np.array([n - 1 - int(np.argmin(key[::-1]))])
    # Rightmost minimum of each half window inside its block, then the better of the two halves.
    pad = -n % WINDOW
    k = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, WINDOW)
    low_to, low_from = np.minimum.accumulate(k, axis=1), np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1]
    at = np.arange(k.size).reshape(k.shape)
    place_to = np.maximum.accumulate(np.where(k == low_to, at, -1), axis=1).ravel()
    # Scanning back, a place takes over only if it is strictly lower than all behind it.
    behind = np.concatenate([low_from[:, 1:], np.full((len(k), 1), np.iinfo(np.uint64).max, np.uint64)], axis=1)
    mark = np.where(k < behind, at, k.size)
    mark[:, -1] = at[:, -1]
    place_from = np.minimum.accumulate(mark[:, ::-1], axis=1)[:, ::-1].ravel()
    first, second = place_from[: n - WINDOW + 1], place_to[WINDOW - 1 : n]
    flat = k.ravel()
    return np.unique(np.where(flat[first] < flat[second], first, second))


_STARTS = "k1 long, k2 long, pos int, run long, before int, gap int, after int, gap2 int"


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of each text; of equal texts a task gives those of one only, so a text of many copies is never hot."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        out: list[list[np.ndarray]] = []
        for i, text in enumerate(batch.column("text")):
            key = (int(k1[i]), int(k2[i]))
            if key in seen:
                continue
            seen.add(key)
            codes = np.frombuffer(text.as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
            # Long texts go block by block; blocks overlap by what a choice and its run need.
            ps, hs = [], []
            for lo in range(0, len(codes), BLOCK):
                a, b = max(0, lo - 2 * WINDOW), min(len(codes), lo + BLOCK + 2 * WINDOW + RUN)
                p, h = span_starts(codes[a:b])
                p = p + a
                inside = (p >= lo) & (p < lo + BLOCK)
                ps.append(p[inside])
                hs.append(h[inside])
            p, h = np.concatenate(ps or [np.zeros(0, np.int64)]), np.concatenate(hs or [np.zeros(0, np.int64)])
            if len(p):
                short = (h & 0x7FFFFFFF).astype(np.int32)
                gap = np.diff(p)
                out.append([np.full(len(p), k1[i]), np.full(len(p), k2[i]), p.astype(np.int32), h, np.r_[np.int32(-1), short[:-1]], np.r_[0, gap].astype(np.int32), np.r_[short[1:], np.int32(-1)], np.r_[gap, 0].astype(np.int32)])
        if out:
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k1", "k2", "pos", "run", "before", "gap", "after", "gap2"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extends equal runs to both sides, as far as the fetched surroundings go."""
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("la", "ra", "lb", "rb")}
        left, right = [], []
        for la, ra, lb, rb in zip(*cols.values(), strict=True):
            left.append(_common(la[::-1], lb[::-1]))
            right.append(_common(ra, rb))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("a", "pa", "b", "pb", "first", "last")] + [pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=["a", "pa", "b", "pb", "first", "last", "l", "r"]
        )


def _common(x: str, y: str) -> int:
    """Length of the common beginning, by halving."""
    hi = min(len(x), len(y))
    if x[:hi] == y[:hi]:
        return hi
    lo = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[:mid] == y[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _islands(spans: DataFrame) -> DataFrame:
    """rep, start, stop of spans, those that touch or overlap made one."""
    w = Window.partitionBy("rep").orderBy("start", "stop")
    spans = spans.withColumn("reach", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("isle", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w))
    return spans.groupBy("rep", "isle").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("rep", "start", "stop")


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of the sentences of a text, which together are all of it: they end with the blank or line end behind a stop, or at a line end."""
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends, strict=True))


def without_sentences(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the sentences that lie whole within one of the ascending, disjoint stretches."""
    kept, k = [], 0
    for lo, hi in sentences(text):
        while k < len(cuts) and cuts[k][1] < hi:
            k += 1
        if not (k < len(cuts) and cuts[k][0] <= lo and hi <= cuts[k][1]):
            kept.append(text[lo:hi])
    return "".join(kept)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, chars, removed = [], [], []
        for text, copy, cuts in zip(batch.column("text"), batch.column("copy").to_pylist(), batch.column("cuts"), strict=True):
            t = text.as_py()
            left = t if t is None else "" if copy else without_sentences(t, [(c["start"], c["stop"]) for c in cuts.as_py()]) if cuts.is_valid else t
            texts.append(left)
            chars.append(len(t or ""))
            removed.append(len(t or "") - len(left or ""))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(chars, pa.int32()), pa.array(removed, pa.int32())], names=["doc_id", "text", "n_chars", "n_removed"])


class SharedSpans:
    """Passages of at least SPAN characters that texts of different classes share.

    documents: doc_id, text. Null texts and texts shorter than SPAN share nothing. ``members`` has the class of
    each document (its smallest doc_id; texts of equal 128-bit digest are one class), ``links`` the verified class pairs with the
    extent of each passage in both.
    """

    def __init__(self, documents: DataFrame):
        d = documents.select("doc_id", "text").where(F.char_length("text") >= SPAN)
        key = [F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit("#")).alias("k2")]
        ids = d.select("doc_id", *key)
        reps = ids.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
        self.members = cut_lineage(ids.join(reps, ["k1", "k2"]).select("k1", "k2", "doc_id", "rep"))
        # Copies go through the pass too: leaving them out first would send every text through a shuffle.
        self.texts = d.select(F.col("doc_id").alias("rep"), "text")
        starts = d.select(*key, "text").mapInArrow(_starts, _STARTS)
        # Runs of one class only are dropped where they are first brought together; then each class has its rows once.
        w = Window.partitionBy("run")
        one = F.struct("k1", "k2")
        shared = starts.withColumns({"lo": F.min(one).over(w), "hi": F.max(one).over(w)}).where("lo <> hi").drop("lo", "hi").distinct()
        names = self.members.where("doc_id = rep").select("k1", "k2", "rep")
        shared = shared.join(names, ["k1", "k2"]).drop("k1", "k2")
        self.shared = cut_lineage(shared)
        self.links = cut_lineage(self._verified())

    def _verified(self) -> DataFrame:
        a = self.shared.select("run", F.col("rep").alias("a"), F.col("pos").alias("pa"), F.col("before").alias("ba"), F.col("gap").alias("ga"), F.col("after").alias("fa"), F.col("gap2").alias("ha"))
        b = self.shared.select("run", F.col("rep").alias("b"), F.col("pos").alias("pb"), F.col("before").alias("bb"), F.col("gap").alias("gb"), F.col("after").alias("fb"), F.col("gap2").alias("hb"))
        # A common start whose neighbours before and after are common too lies inside a passage: its ends tell all.
        first = ~((F.col("ba") == F.col("bb")) & (F.col("ga") == F.col("gb")) & (F.col("ga") > 0))
        last = ~((F.col("fa") == F.col("fb")) & (F.col("ha") == F.col("hb")) & (F.col("ha") > 0))
        ends = a.join(b, "run").where((F.col("a") < F.col("b")) & (first | last)).select("a", "pa", "b", "pb", first.alias("first"), last.alias("last"))
        spots = ends.select(F.col("a").alias("rep"), F.col("pa").alias("pos")).union(ends.select("b", "pb")).distinct()
        left, right = SPAN - RUN, SPAN - RUN
        near = spots.join(self.texts, "rep").select(
            "rep", "pos", F.substring("text", F.greatest(F.col("pos") - left, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(left))).alias("l"), F.substring("text", F.col("pos") + RUN + 1, F.lit(right)).alias("r"),
            F.substring("text", F.col("pos") + 1, F.lit(RUN)).alias("m"),
        )
        na = near.select(F.col("rep").alias("a"), F.col("pos").alias("pa"), F.col("l").alias("la"), F.col("r").alias("ra"), F.col("m").alias("ma"))
        nb = near.select(F.col("rep").alias("b"), F.col("pos").alias("pb"), F.col("l").alias("lb"), F.col("r").alias("rb"), F.col("m").alias("mb"))
        checked = ends.join(na, ["a", "pa"]).join(nb, ["b", "pb"]).where("ma = mb").select("a", "pa", "b", "pb", "first", "last", "la", "ra", "lb", "rb").mapInArrow(_extend, "a long, pa int, b long, pb int, first boolean, last boolean, l int, r int")
        return checked.where(F.col("l") + F.col("r") >= SPAN - RUN)

    def class_pairs(self) -> DataFrame:
        return self.links.select("a", "b").distinct()

    def class_members(self) -> DataFrame:
        """doc_id, rep (its class), n_copies (documents of the class), n_links (other classes that share a passage with it)."""
        p = self.class_pairs()
        n = p.select(F.col("a").alias("rep")).union(p.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
        size = self.members.groupBy("rep").agg(F.count("*").alias("n_copies"))
        return self.members.select("doc_id", "rep").join(size, "rep").join(n, "rep", "left").fillna(0, ["n_links"])

    def later_passages(self) -> DataFrame:
        """rep, start, stop of the passages of each class that a class of smaller rep has too; those that touch are one."""
        e = self.extents().where(F.col("a") < F.col("b"))
        return _islands(e.select(F.col("b").alias("rep"), (F.col("start") + F.col("shift")).alias("start"), (F.col("stop") + F.col("shift")).alias("stop")).distinct())

    def without_repeats(self, documents: DataFrame) -> DataFrame:
        """doc_id, text, n_chars, n_removed: sentences that lie whole in a passage which an earlier document has are taken out.

        Of equal texts and of shared passages the document with the smallest doc_id keeps them. A document that is left
        without a sentence has an empty text. Null text stays null.
        """
        w = self.later_passages().groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
        per = self.members.select("doc_id", "rep").join(w, "rep", "left")
        out = documents.select("doc_id", "text").join(per, "doc_id", "left").select("doc_id", "text", F.coalesce(F.col("rep") != F.col("doc_id"), F.lit(False)).alias("copy"), "cuts")
        return out.mapInArrow(_without, "doc_id long, text string, n_chars int, n_removed int")

    def document_pairs(self) -> DataFrame:
        """doc_a < doc_b of every pair that shares a passage, equal texts included: class pairs and members expanded."""
        m = self.members
        pairs = self.class_pairs()
        across = pairs.join(m.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("doc_id").alias("y")), "b").select("x", "y")
        crowd = m.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
        same = m.join(crowd, "rep", "left_semi")
        within = same.select("rep", F.col("doc_id").alias("x")).join(same.select("rep", F.col("doc_id").alias("y")), "rep").where("x < y").select("x", "y")
        return across.union(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))

    def extents(self) -> DataFrame:
        """a, start, stop, b, shift (place in b less place in a) of what each class pair shares, from verified ends only.

        On one shift the ends of a class pair follow each other as chains: a first and a last common start with only
        common starts between them, or one that is both. Runs overlap, so a chain has no gap.
        """
        w = Window.partitionBy("a", "b", "shift").orderBy("pa")
        e = self.links.withColumn("shift", F.col("pb") - F.col("pa"))
        e = e.withColumns({"start": F.col("pa") - F.col("l"), "stop": F.col("pa") + RUN + F.col("r")})
        e = e.withColumns({"closes": F.lead(F.col("last") & ~F.col("first")).over(w), "end": F.lead("stop").over(w)})
        stop = F.when(F.col("first") & ~F.col("last") & F.col("closes"), F.col("end")).otherwise(F.col("stop"))
        return e.select("a", "start", stop.alias("stop"), "b", "shift")

    def passages(self) -> DataFrame:
        """rep, start, stop of the shared passages of each class, as places in code points; those that touch are one."""
        e = self.extents()
        both = F.array(F.struct(F.col("a").alias("rep"), "start", "stop"), F.struct(F.col("b").alias("rep"), (F.col("start") + F.col("shift")).alias("start"), (F.col("stop") + F.col("shift")).alias("stop")))
        return _islands(e.select(F.inline(both)).distinct())

    def shares(self, documents: DataFrame) -> DataFrame:
        """doc_id, n_chars, shared_chars, share, n_twins (documents of equal text) of every document.

        A document with an equal twin is shared as a whole if it has SPAN characters. Null text has no characters.
        """
        inside = self.passages().groupBy("rep").agg(F.sum(F.col("stop") - F.col("start")).alias("covered"))
        twins = self.members.groupBy("rep").agg((F.count("*") - 1).alias("n_twins"))
        per = self.members.join(twins, "rep").join(inside, "rep", "left").select("doc_id", "n_twins", "covered")
        n = F.coalesce(F.char_length("text"), F.lit(0))
        out = documents.select("doc_id", n.alias("n_chars")).join(per, "doc_id", "left")
        chars = F.when(F.col("n_twins") > 0, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
        return out.select("doc_id", "n_chars", chars.cast("long").alias("shared_chars"), F.round(F.when(F.col("n_chars") > 0, chars / F.col("n_chars")).otherwise(0.0), 6).alias("share"), F.coalesce("n_twins", F.lit(0)).alias("n_twins"))


def shared_pairs(documents: DataFrame) -> DataFrame:
    return SharedSpans(documents).document_pairs()


def repeated_passages(documents: DataFrame) -> DataFrame:
    """Passages of each class that also occur elsewhere: rep, start, stop."""
    return SharedSpans(documents).passages()


def shared_shares(documents: DataFrame) -> DataFrame:
    return SharedSpans(documents).shares(documents)


def span_classes(documents: DataFrame) -> DataFrame:
    return SharedSpans(documents).class_members()


def without_repeats(documents: DataFrame) -> DataFrame:
    return SharedSpans(documents).without_repeats(documents)
