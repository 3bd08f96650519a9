"""Ranked neighbours, owners and search on small cases that the whole job decides."""

from __future__ import annotations

import random

from graphloom.operators import consensus, search, traverse


def ranked(rows: set[tuple[str, str, str]], k: int) -> set[tuple]:
    """Every pair scored, by the definition."""
    tags: dict[tuple[str, str], set[str]] = {}
    holders: dict[tuple[str, str], int] = {}
    for g, m, t in rows:
        tags.setdefault((g, m), set()).add(t)
        holders[g, t] = holders.get((g, t), 0) + 1
    out = set()
    for (g, m), mine in tags.items():
        scored = [(-round(sum(10 / holders[g, t] for t in mine & theirs), 6), o) for (h, o), theirs in tags.items() if h == g and o != m and mine & theirs]
        out |= {(g, m, o, -s) for s, o in sorted(scored)[:k]}
    return out


def test_common_terms_count_for_neighbours(spark):
    rng = random.Random(3)
    rows = set()
    for g in ("g", "h"):
        for i in range(130):
            rows |= {(g, f"m{i:03}", f"common{rng.randrange(4)}") for _ in range(rng.randrange(4))} | {(g, f"m{i:03}", f"rare{rng.randrange(40)}") for _ in range(rng.randrange(3))}
        rows |= {(g, f"only{i}", "common0") for i in range(8)}
    df = spark.createDataFrame([*rows, *list(rows)[:50], ("g", "m000", None)], "g string, m string, t string")
    for k in (1, 5):
        got = {(r["g"], r["m"], r["other"], r["score"]) for r in consensus.ranked_neighbours(df, "g", "t", "m", k).collect()}
        assert got == ranked(rows, k)


def test_members_with_many_common_terms_rank_as_defined(spark):
    rng = random.Random(5)
    rows = {("g", f"m{i:03}", f"common{t}") for i in range(120) for t in rng.sample(range(14), rng.choice((1, 2, 3, 6, 7, 9)))} | {("g", f"m{rng.randrange(120):03}", f"rare{t % 30}") for t in range(60)}
    df = spark.createDataFrame([*rows], "g string, m string, t string")
    for k in (1, 5):
        got = {(r["g"], r["m"], r["other"], r["score"]) for r in consensus.ranked_neighbours(df, "g", "t", "m", k, high=10).collect()}
        assert got == ranked(rows, k)


def rows_of_steps(spark, after: int = -1) -> dict[int, int]:
    """By number of execution, the most rows that a step of its plan gave."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen: dict[int, int] = {}
    runs = store.executionsList()
    for i in range(runs.size()):
        if (run := runs.apply(i).executionId()) > after:
            values, steps = store.executionMetrics(run), store.planGraph(run).allNodes()
            metrics = [m for j in range(steps.size()) for m in [steps.apply(j).metrics()]]
            ids = [m.apply(j).accumulatorId() for m in metrics for j in range(m.size()) if m.apply(j).name() == "number of output rows"]
            seen[run] = max([0, *(int(v.get().replace(",", "")) for x in ids if (v := values.get(x)).isDefined())])
    return seen


def test_sets_of_common_terms_do_not_meet_each_other(spark):
    """2,000 members with nearly as many sets of four common terms: no step gives a row for each two of them."""
    rng = random.Random(7)
    rows = {("g", f"m{i:04}", f"common{t}") for i in range(2000) for t in rng.sample(range(25), 4)}
    df = spark.createDataFrame([*rows], "g string, m string, t string")
    before = max(rows_of_steps(spark), default=-1)
    got = {(r["g"], r["m"], r["other"], r["score"]) for r in consensus.ranked_neighbours(df, "g", "t", "m", 5).collect()}
    assert got == ranked(rows, 5)
    most = max(rows_of_steps(spark, before).values())
    assert 10_000 <= most < 500_000, most


def test_owner_is_the_nearest_file_at_any_depth(spark):
    kinds = {"f": "file", "f2": "file", "c": "class", "m": "function", "deep": "function", "two": "function", "x": "class", "y": "class", "alone": "class", "z": "class"}
    nodes = spark.createDataFrame([("g", i, t) for i, t in kinds.items()], "graphId string, id string, type string")
    links = [("f", "c"), ("c", "m"), ("m", "deep"), ("f2", "two"), ("m", "two"), ("x", "y"), ("y", "x"), ("f2", "z"), ("z", "z"), ("m", "c"), ("c", "f2")]
    edges = spark.createDataFrame([("g", a, b) for a, b in links], "graphId string, source string, target string")
    got = {r["id"]: r["file"] for r in traverse.containers(nodes, edges).collect()}
    assert got == {"c": "f", "m": "f", "deep": "f", "two": "f2", "f2": "f", "z": "f2"}


def test_a_hit_in_the_notes_alone_is_found(spark):
    rows = [("g", "a", "x", [], "s", "about a Tunnel", 1), ("g", "b", "tunnel", [], "s", None, 2), ("g", "c", "x", [], "s", None, 3)]
    n = spark.createDataFrame(rows, "graphId string, id string, name string, tags array<string>, summary string, languageNotes string, node_ord long")
    got = [(r["id"], r["score"]) for r in search.search(n, "tunnel").orderBy("place").collect()]
    assert got == [("b", 0.6), ("a", 0.93)]
