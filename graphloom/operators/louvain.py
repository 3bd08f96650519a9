"""Communities of one graph on arrays, in the steps that ``traverse`` takes by joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _apart(move: np.ndarray, more: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of the moves (with their gains) those that are the best of both communities they touch; ties to the smaller node."""
    rank = np.empty(len(move), np.int64)
    rank[np.lexsort((move, -more))] = np.arange(len(move))
    lead = np.full(len(old), len(move))
    np.minimum.at(lead, old[move], rank)
    np.minimum.at(lead, new[move], rank)
    return move[(lead[old[move]] == rank) & (lead[new[move]] == rank)]


def settle(a: np.ndarray, b: np.ndarray, w: np.ndarray, group: np.ndarray, resolution: float, least: float) -> tuple[np.ndarray, bool]:
    """Moves nodes to the neighbouring community of largest modularity gain until a pass over all nodes gains no more than ``least``.

    Nodes move in two groups, so neighbours less often swap places. Of a round that still loses only moves are kept that
    share no community, as the gains of those add up. Links stand in both directions. Gains are taken times the links, so
    that those of whole weights are exact and ties are ties.
    """
    n, here = len(group), np.unique(a)
    k = np.bincount(a, w, n)
    m2 = k.sum()

    def totals(label: np.ndarray) -> np.ndarray:
        return np.bincount(label[here], k[here], n)

    def modularity(label: np.ndarray) -> float:
        every = totals(label)
        return (w[label[a] == label[b]].sum() * m2 - resolution * (every * every).sum()) / (m2 * m2)

    label = np.arange(n)
    best, turn, idle, moved = modularity(label), 0, 0, False
    while idle < 2:
        total, mine, on = totals(label), here[group[here] == turn % 2], (a != b) & (group[a] == turn % 2)
        new, now = label, best
        if len(mine):
            key, at = np.unique(np.concatenate([a[on] * n + label[b[on]], mine * n + label[mine]]), return_inverse=True)
            weight = np.bincount(at, np.concatenate([w[on], np.zeros(len(mine))]))
            node, to = key // n, key % n
            own = to == label[node]
            gain = weight * m2 - resolution * k[node] * (total[to] - np.where(own, k[node], 0.0))
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            most, stay = np.maximum.reduceat(gain, first), gain[own]
            # Of equal gains the own community, then the smallest.
            good = np.flatnonzero(gain == np.repeat(most, np.diff(np.r_[first, len(node)])))
            to = to[good[np.unique(node[good], return_index=True)[1]]]
            goes = most > stay
            new = label.copy()
            new[mine[goes]] = to[goes]
            now = modularity(new)
            if now <= best + least:
                kept = _apart(mine[goes], (most - stay)[goes], label, new)
                every, new = new, label.copy()
                new[kept] = every[kept]
                now = modularity(new)
        turn += 1
        if now > best + least:
            label, best, idle, moved = new, now, 0, True
        else:
            idle += 1
    return label, moved


def communities(t: pa.Table, resolution: float, least: float) -> pa.Table:
    """graphId, id, community of the nodes of one graph, from its linked pairs a, b and the groups they move in."""
    a, b = t["a"].combine_chunks(), t["b"].combine_chunks()
    ids = pc.unique(pa.concat_arrays([a, b]))
    ids = ids.take(pc.sort_indices(ids))
    a, b = (pc.index_in(x, value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    n, group = len(ids), np.zeros(len(ids), np.int8)
    group[a], group[b] = t["group_a"].to_numpy(), t["group_b"].to_numpy()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    w, label = np.ones(len(a)), np.arange(n)
    while True:
        step, moved = settle(a, b, w, group, resolution, least)
        label = step[label]
        if not moved:
            break
        key, at = np.unique(step[a] * n + step[b], return_inverse=True)
        a, b, w = key // n, key % n, np.bincount(at, w)
    graph = t["graphId"].combine_chunks().take(pa.array(np.zeros(n, np.int64)))
    return pa.table({"graphId": graph, "id": ids, "community": ids.take(pa.array(label))})
