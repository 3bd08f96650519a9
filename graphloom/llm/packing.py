"""Filling fixed-capacity containers with items (problem 8).

Documents are spread by a hash over shards of a bounded number of items; each shard is packed by bin completion.
Best fit decreasing gives the first incumbent and the waste bound of Martello and Toth the fewest containers there
can be; a shard whose incumbent meets the bound is done. Otherwise the largest document left opens a container and
its fillings that no other filling dominates are tried: those that waste more than a better packing could are cut, and
the search goes back over containers until its budget of steps is spent. It can only improve on best fit decreasing.
A document larger than the capacity, and no other, is cut into pieces of the capacity and a rest.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a shard on average; the last container of a shard is its only one that need not be full.
SHARD_ITEMS = 4000
#: Steps of the search with backtracking, a shard and capacity; past them the incumbent is used.
BUDGET = 20_000
#: First documents tried at each level of the single descent, largest first, before the pair that ends a filling.
BRANCHES = 6
#: Tasks at most that pack; each takes its shards one after another.
MOST_TASKS = 20_000


def byte_tokens(text: F.Column) -> F.Column:
    """Size in tokens of the byte-level tokenizer: one per UTF-8 byte and one end token."""
    return (F.octet_length(text) + 1).cast("long")


class _Stock:
    """Sizes still to be packed, with their documents, smallest first."""

    def __init__(self, sizes: np.ndarray, ids: np.ndarray):
        o = np.lexsort((ids, sizes))
        self.sizes, first, counts = np.unique(sizes[o], return_index=True, return_counts=True)
        self.left, self.start, self.ids = counts.copy(), first, ids[o]
        self.total = int(sizes.sum())

    def take(self, k: int) -> int:
        """Removes one document of the k-th size; returns its item number."""
        self.left[k] -= 1
        item = self.ids[self.start[k] + self.left[k]]
        self.total -= int(self.sizes[k])
        if not self.left[k]:
            for name in ("sizes", "left", "start"):
                setattr(self, name, np.delete(getattr(self, name), k))
        return int(item)


def _complete(s: np.ndarray, left: np.ndarray, room: int) -> list[int]:
    """Sizes that fill ``room`` best: best fit as the incumbent, then the branches that can still beat it."""
    best: list[int] = []
    waste = room
    used: dict[int, int] = {}

    def fit(r: int) -> int:
        """Largest size not above r of which a document is left."""
        k = int(np.searchsorted(s, r, side="right")) - 1
        while k >= 0 and used.get(k, 0) >= left[k]:
            k -= 1
        return k

    def pair(r: int) -> tuple[int, list[int]]:
        """Undominated fillings of one or two documents."""
        k = fit(r)
        if k < 0:
            return r, []
        w, got = r - int(s[k]), [k]
        if not w:
            return 0, got
        m = k + 1
        a = s[:m]
        b = np.searchsorted(a, r - a, side="right") - 1
        b = np.minimum(b, np.arange(m))  # the second is not larger
        rest = np.where(b >= 0, r - a - a[np.maximum(b, 0)], r)
        for j in np.argsort(rest, kind="stable"):
            if rest[j] >= w:
                break
            x, y = int(j), int(b[j])
            if y >= 0 and used.get(x, 0) + (x == y) < left[x] and used.get(y, 0) < left[y]:
                return int(rest[j]), [x, y]
        return w, got

    def search(r: int, chosen: list[int], depth: int) -> None:
        nonlocal best, waste
        w, got = pair(r)
        if w < waste:
            best, waste = chosen + got, w
        if not waste or depth >= 24:
            return
        top, tried = r, 0
        while tried < (BRANCHES if depth < 2 else 1) and waste:
            k = fit(top)
            if k < 0 or int(s[k]) * 3 < r and depth and tried:
                return
            used[k] = used.get(k, 0) + 1
            search(r - int(s[k]), [*chosen, k], depth + 1)
            used[k] -= 1
            tried += 1
            top = int(s[k]) - 1

    # Best fit down to where three documents are left to place, so the exact ending works on a small rest.
    chosen: list[int] = []
    r = room
    small = int(s[0]) if len(s) else 0
    while len(s) and r > 4 * int(s[min(len(s) - 1, len(s) // 2)]) + small:
        k = fit(r)
        if k < 0:
            break
        used[k] = used.get(k, 0) + 1
        chosen.append(k)
        r -= int(s[k])
    best, waste = list(chosen), r
    search(r, chosen, 0)
    return best


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Fewest containers that items need: the waste bound of Martello and Toth, over every threshold."""
    if not len(sizes):
        return 0
    s = np.sort(sizes)[::-1].astype(np.int64)
    sums = np.r_[0, np.cumsum(s)]
    half = int(np.count_nonzero(s * 2 > capacity))  # items above half of the capacity
    t = np.r_[0, np.unique(s[s * 2 <= capacity])]
    alone = np.searchsorted(-s, -(capacity - t), side="left")  # items that no item of at least t fits beside
    alone = np.minimum(alone, half)
    small = np.searchsorted(-s, -t, side="right")
    room = (half - alone) * capacity - (sums[half] - sums[alone])
    more = np.maximum(0, -(-(sums[small] - sums[half] - room) // capacity))
    return int(max((half + more).max(), -(-int(sums[-1]) // capacity)))


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing: containers as lists of positions; of equal sizes the first position comes first."""
    rooms: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for i in np.lexsort((np.arange(len(sizes)), -sizes)).tolist():
        size = int(sizes[i])
        k = bisect.bisect_left(rooms, (size, -1))
        if k < len(rooms):
            room, box = rooms.pop(k)
        else:
            room, box = capacity, len(out)
            out.append([])
        out[box].append(i)
        if room > size:
            bisect.insort(rooms, (room - size, box))
    return out


def _one_descent(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bin completion without a way back: each container gets the best filling found around the largest item left."""
    stock, out = _Stock(sizes, np.arange(len(sizes))), []
    while len(stock.sizes):
        if stock.total <= capacity:
            out.append([stock.take(0) for _ in range(int(stock.left.sum()))])
            break
        room = capacity - int(stock.sizes[-1])
        content = [stock.take(len(stock.sizes) - 1)]
        if len(stock.sizes) and stock.sizes[0] <= room:
            for k in sorted(_complete(stock.sizes, stock.left, room), reverse=True):
                content.append(stock.take(k))
        out.append(content)
    return out


class _Completion:
    """Branch and bound over containers: at each, the undominated fillings around the largest item left."""

    def __init__(self, sizes: np.ndarray, capacity: int, fewest: int, budget: int):
        self.s, counts = np.unique(sizes, return_counts=True)
        self.s, self.left, self.capacity, self.budget = self.s.tolist(), counts.tolist(), capacity, budget
        self.fewest, self.total, self.best = fewest, int(sizes.sum()), None

    def _fillings(self, room: int, top: int, allowed: int):
        """Fillings of ``room`` by sizes up to index ``top`` that waste no more than allowed and that none dominates.

        One is dominated if an item left fits into its waste, or could stand in for a smaller one of it.
        """
        s, left = self.s, self.left
        chosen: list[int] = []

        def walk(r: int, k: int):
            self.budget -= 1
            if self.budget < 0:
                return
            k = min(k, bisect.bisect_right(s, r) - 1)
            while k >= 0 and not left[k]:
                k -= 1
            if k < 0:
                if r <= allowed and not self._dominated(r, chosen):
                    yield list(chosen)
                return
            for j in range(k, -1, -1):
                if not left[j]:
                    continue
                left[j] -= 1
                chosen.append(j)
                yield from walk(r - s[j], j)
                chosen.pop()
                left[j] += 1
                if self.budget < 0:
                    return

        yield from walk(room, top)

    def _dominated(self, waste: int, chosen: list[int]) -> bool:
        s, left = self.s, self.left
        if any(left[k] for k in range(bisect.bisect_right(s, waste))):
            return True
        return any(left[k] for j in set(chosen) for k in range(j + 1, bisect.bisect_right(s, s[j] + waste)))

    def run(self, bound: int) -> list[list[int]] | None:
        """Containers as lists of size indexes, fewer than the incumbent, or None if none were found in the budget."""
        s, left = self.s, self.left
        path: list[list[int]] = []
        stack: list = []
        used_total = 0
        while True:
            top = next((k for k in range(len(s) - 1, -1, -1) if left[k]), -1)
            if top < 0 and len(path) < self.fewest:
                self.best, self.fewest = [list(p) for p in path], len(path)
                if self.fewest <= bound:
                    return self.best
            # Waste that a better packing may still have, after that of the containers so far.
            slack = (self.fewest - 1) * self.capacity - self.total - (len(path) * self.capacity - used_total)
            if top >= 0 and slack >= 0 and len(path) < self.fewest - 1:
                left[top] -= 1
                stack.append((top, self._fillings(self.capacity - s[top], top, slack)))
            elif stack:
                used_total -= sum(s[k] for k in path.pop())
            else:
                return self.best
            # The next filling of the innermost open container, which holds its items back; those without one are closed.
            while stack and self.budget >= 0:
                top, more = stack[-1]
                got = next(more, None)
                if got is not None:
                    path.append([top, *got])
                    used_total += sum(s[k] for k in path[-1])
                    break
                stack.pop()
                left[top] += 1
                if stack:
                    used_total -= sum(s[k] for k in path.pop())
            if not stack or self.budget < 0:
                return self.best


def pack(sizes: np.ndarray, ids: np.ndarray, capacity: int, budget: int = BUDGET) -> list[list[int]]:
    """Containers, as lists of items, for items none of which exceeds the capacity.

    Best fit decreasing is the first incumbent; a packing that meets the waste bound ends the search. Else bin
    completion goes down once, and then searches with backtracking over containers for ``budget`` steps.
    """
    bound = lower_bound(sizes, capacity)
    best = best_fit(sizes, capacity)
    if len(best) > bound:
        other = _one_descent(sizes, capacity)
        best = other if len(other) < len(best) else best
    if len(best) > bound:
        found = _Completion(sizes, capacity, len(best), budget).run(bound)
        if found:
            stock = {}
            for i in np.argsort(sizes, kind="stable")[::-1].tolist():
                stock.setdefault(int(sizes[i]), []).append(i)
            values = np.unique(sizes).tolist()
            best = [[stock[values[k]].pop() for k in box] for box in found]
    return [[int(ids[i]) for i in box] for box in best]


_OUT = "spec_id int, capacity int, doc_id long, piece_no int, tokens long, container long"


def _pack_shard(specs: list[tuple[int, int]], only_best_fit: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        docs, size = pdf["doc_id"].to_numpy(np.int64), pdf["tokens"].to_numpy(np.int64)
        frames = []
        for spec, cap in specs:
            full = np.where(size > cap, size // cap, 0)
            rest = size - full * cap
            box = np.empty(0, np.int64)
            part = np.flatnonzero(rest > 0)
            where = np.full(len(size), -1, np.int64)
            bins = best_fit(rest[part], cap) if only_best_fit else pack(rest[part], np.arange(len(part)), cap)
            for k, content in enumerate(bins):
                where[part[content]] = k
            n = len(bins)
            cut = np.flatnonzero(full)
            doc = np.concatenate([docs[part], np.repeat(docs[cut], full[cut])])
            piece = np.concatenate([full[part], *[np.arange(f) for f in full[cut]]]) if len(cut) else full[part]
            box = np.concatenate([where[part], n + np.arange(int(full.sum()))])
            tok = np.concatenate([rest[part], np.full(int(full.sum()), cap)])
            frames.append(pd.DataFrame({"spec_id": np.int32(spec), "capacity": np.int32(cap), "doc_id": doc, "piece_no": piece.astype(np.int32), "tokens": tok, "container": (shard << 32) + box}))
        return pd.concat(frames)

    return run


def pack_documents(documents: DataFrame, specs: DataFrame, only_best_fit: bool = False) -> DataFrame:
    """spec_id, capacity, doc_id, piece_no, tokens, container for every document and capacity.

    documents: doc_id, text; null text is no document, empty text has its end token. specs: a small fixed table;
    rows with null or non-positive capacity are left out. Containers are numbered within shards
    (shard * 2**32 + number). Pieces of an oversized document are numbered from 0 and come in text order.
    only_best_fit packs by best fit decreasing alone, to compare. Memory of a task is one shard, whose size does not depend on the data: the hash spreads any key evenly.
    """
    caps = [(r["spec_id"], r["capacity"]) for r in specs.where("capacity > 0").select("spec_id", "capacity").distinct().orderBy("spec_id").collect()]
    shards = max(1, -(-documents.count() // SHARD_ITEMS))
    items = documents.where("text is not null").select("doc_id", byte_tokens(F.col("text")).alias("tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    if not caps:
        return documents.sparkSession.createDataFrame([], _OUT)
    # A given number of partitions, as packing takes time out of proportion to the few bytes that would be coalesced.
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(shards, MOST_TASKS))
    return items.repartition(parts, "shard").groupBy("shard").applyInPandas(_pack_shard(caps, only_best_fit), _OUT)


def split_documents(packed: DataFrame) -> DataFrame:
    """The documents that were cut, per spec."""
    return packed.where("piece_no > 0").select("spec_id", "doc_id").distinct()


def fill_report(packed: DataFrame, by_best_fit: DataFrame) -> DataFrame:
    """Per spec: documents, containers, those of best fit alone, tokens, share of the capacity used, fewest possible."""
    n = F.countDistinct("container")
    alone = by_best_fit.groupBy("spec_id", "capacity").agg(n.alias("n_best_fit"))
    return packed.groupBy("spec_id", "capacity").agg(
        F.countDistinct("doc_id").alias("n_docs"), n.alias("n_containers"), F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / (n * F.first("capacity")), 6).alias("fill"), F.ceil(F.sum("tokens") / F.first("capacity")).alias("lower_bound"),
    ).join(alone, ["spec_id", "capacity"])
