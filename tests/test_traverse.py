"""Loops over graphs: no limit of depth, shortest ways, communities, distributed numbering."""

from __future__ import annotations

import random
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame

from graphloom.operators import intervals, traverse


def _edges(spark, pairs, graph="g"):
    return spark.createDataFrame([(graph, a, b) for a, b in pairs], "graphId string, source string, target string")


def _nodes(spark, ids, graph="g"):
    return spark.createDataFrame([(graph, i) for i in ids], "graphId string, id string")


def test_long_chain_has_all_levels_and_distances(spark):
    n = 40
    edges = _edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(n)])
    nodes = _nodes(spark, [f"n{i}" for i in range(n + 1)])
    want = {f"n{i}": i for i in range(n + 1)}
    assert {r["id"]: r["level"] for r in traverse.topological_levels(nodes, edges).collect()} == want
    start = _nodes(spark, ["n0"])
    assert {r["id"]: r["depth"] for r in traverse.distances(edges, start).collect()} == want
    assert {r["id"]: r["depth"] for r in traverse.distances(edges, start, directed=False).collect()} == want
    assert {r["component"] for r in traverse.components(nodes, edges).collect()} == {"n0"}


def test_cycles_and_what_is_behind_them_have_no_level(spark):
    edges = _edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "a")])
    got = {r["id"]: r["level"] for r in traverse.topological_levels(_nodes(spark, "abcde"), edges).collect()}
    assert got == {"a": 0, "b": -1, "c": -1, "d": -1, "e": 0}


def test_shortest_path_takes_the_smallest_predecessor(spark):
    edges = _edges(spark, [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y")])
    pairs = _edges(spark, [("a", "e"), ("e", "a"), ("a", "a"), ("a", "x"), ("a", "b")])
    got = {(r["source"], r["target"]): (r["length"], r["path"]) for r in traverse.shortest_paths(edges, pairs).collect()}
    assert got == {("a", "e"): (3, "a>b>d>e"), ("e", "a"): (3, "e>d>b>a"), ("a", "a"): (0, "a"), ("a", "b"): (1, "a>b")}


def test_three_cliques_are_three_communities(spark):
    trio = [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("b1", "b2"), ("b2", "b3"), ("b1", "b3"), ("c1", "c2"), ("c2", "c3"), ("c1", "c3"), ("a1", "b1")]
    ids = sorted({x for p in trio for x in p})
    got = traverse.communities(_nodes(spark, [*ids, "alone"]), _edges(spark, trio)).collect()
    parts: dict[str, set[str]] = {}
    for r in got:
        parts.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, parts.values())) == [["a1", "a2", "a3"], ["alone"], ["b1", "b2", "b3"], ["c1", "c2", "c3"]]


def _knots(rng, n_knots, size, across):
    """Linked pairs, most of them within knots."""
    ids = [[f"{k}-{i}" for i in range(size)] for k in range(n_knots)]
    pairs = [tuple(rng.sample(k, 2)) for k in ids for _ in range(size * 2)] + [(rng.choice(rng.choice(ids)), rng.choice(rng.choice(ids))) for _ in range(across)]
    return sorted({x for k in ids for x in k}), pairs


def _modularity(pairs, label):
    links = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    ends = Counter(label[x] for p in links for x in p)
    return sum(label[a] == label[b] for a, b in links) / len(links) - sum(n * n for n in ends.values()) / (2 * len(links)) ** 2


def test_communities_of_many_graphs_by_few_jobs_and_by_joins_alike(spark):
    rng = random.Random(11)
    graphs = {"a": _knots(rng, 4, 6, 8), "b": _knots(rng, 6, 9, 25), "c": _knots(rng, 2, 4, 2), "d": (["x", "y"], [("x", "x")])}
    nodes = reduce(DataFrame.union, (_nodes(spark, ids, g) for g, (ids, _) in graphs.items()))
    edges = reduce(DataFrame.union, (_edges(spark, pairs, g) for g, (_, pairs) in graphs.items()))
    label = lambda df: {(r["graphId"], r["id"]): r["community"] for r in df.collect()}
    spark.sparkContext.setJobGroup("communities", "")
    got = label(traverse.communities(nodes, edges))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("communities"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 25, jobs
    # Links within the knots weigh more than any other cut; a graph is told alike without the others.
    for g in "abc":
        mine = {i: c for (h, i), c in got.items() if h == g}
        assert _modularity(graphs[g][1], mine) >= _modularity(graphs[g][1], {i: i.split("-")[0] for i in mine}) - 0.02
    assert label(traverse.communities(_nodes(spark, graphs["c"][0], "c"), _edges(spark, graphs["c"][1], "c"))) == {k: v for k, v in got.items() if k[0] == "c"}
    assert {k[1]: v for k, v in got.items() if k[0] == "d"} == {"x": "x", "y": "y"}
    assert label(traverse.communities(nodes, edges, most_links=15)) == got


def test_numbering_over_partitions_is_that_of_one_sort(spark):
    df = spark.createDataFrame([("g" if i % 3 else None, i * 7 % 101) for i in range(90)], "graphId string, k int")
    got = traverse.numbered(df, ["graphId"], ["k"], "nth").collect()
    for graph in ("g", None):
        ks = sorted(r["k"] for r in got if r["graphId"] == graph)
        assert {r["k"]: r["nth"] for r in got if r["graphId"] == graph} == {k: i for i, k in enumerate(ks)}
    assert len(got) == 90


def test_suffix_of_ten_segments_matches(spark):
    path = "/".join("abcdefghijkl")
    files = spark.createDataFrame([("g", path)], "graphId string, path string")
    refs = spark.createDataFrame([("g", path[4:]), ("g", "none")], "graphId string, ref string")
    assert [(r["ref"], r["path"]) for r in intervals.by_suffix(refs, files, ["graphId"]).collect()] == [(path[4:], path)]
