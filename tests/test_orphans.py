from __future__ import annotations

from datetime import datetime

from graphloom.operators import orphans

N = "node_row long, graphId string, id string, type string, name string, filePath string, op string, arrivedAt timestamp_ntz, part int, state string"
E = "edge_row long, graphId string, source string, target string, arrivedAt timestamp_ntz, kind string, salt int, moment string"
L = "layer_row long, graphId string, nodeIds array<string>, arrivedAt timestamp_ntz"


def t(day):
    return datetime(2025, 1, day)


def found(spark, nodes, edges=(), layers=()):
    n = spark.createDataFrame([(*x, 1, "clash") for x in nodes], N)
    refs = orphans.references_of_edges(spark.createDataFrame([(*x, "clash", 1, "clash") for x in edges], E), "edges", "edge_row", "arrivedAt").unionByName(
        orphans.references_of_members(spark.createDataFrame(list(layers), L), "layers", "layer_row", "arrivedAt")
    )
    return {(r["ref_table"], r["row_id"], r["node_ref"], r["state"]) for r in orphans.classify_references(refs, n).collect()}


def test_states(spark):
    nodes = [
        (1, "g", "file:a", "file", "a", "a", "upsert", t(2)),
        (2, "g", "file:b", "file", "b", "b", "upsert", t(1)), (3, "g", "file:b", "file", "b", "b", "delete", t(3)), (4, "g", "file:b", "file", "b", "b", "upsert", t(5)),
        (5, "g", "f1", "function", "f1", "a", "upsert", t(1)), (6, "g", "article:x", "article", "x", None, "upsert", t(1)), (7, None, "file:n", "file", None, None, "upsert", t(1)),
    ]
    edges = [
        (1, "g", "file:a", "file:b", t(1)), (2, "g", "file:a", "file:b", t(4)), (3, "g", "file:a", "file:b", t(6)), (4, "h", "file:a", "file:a", t(9)),
        (5, "g", "f1", "func:a:f1", t(2)), (6, "g", "x:file:file:a", " file:a ", t(3)), (7, "g", None, "  ", t(3)), (8, "g", "article:x", "repo:article:x", t(3)),
        (9, None, "file:n", "file:m", t(3)), (10, "g", "file:a", "file:b", None),
    ]
    assert found(spark, nodes, edges, [(1, "g", ["file:a", "file:a", None, "", "zzz"], t(3)), (2, "g", None, t(3)), (3, "g", [], t(3))]) == {
        ("edges", 1, "file:a", "late"), ("edges", 2, "file:b", "deleted"), ("edges", 4, "file:a", "missing"), ("edges", 8, "repo:article:x", "missing"),
        ("edges", 9, "file:m", "missing"), ("layers", 1, "zzz", "missing"),
    }


def test_ties_repeats_and_empty_tables(spark):
    nodes = [(1, "g", "file:a", "file", "a", "a", "upsert", t(2)), (2, "g", "file:a", "file", "a", "a", "delete", t(2)), (1, "g", "file:a", "file", "a", "a", "upsert", t(2))]
    edges = [(1, "g", "file:a", "file:a", t(2))]
    assert found(spark, nodes, edges) == {("edges", 1, "file:a", "deleted")}
    assert found(spark, [], edges) == {("edges", 1, "file:a", "missing")}
    assert found(spark, nodes) == set()


def test_one_popular_target_is_split_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(orphans, "REFS_PER_SALT", 50)
    nodes = [(1, "g", "file:a", "file", "a", "a", "upsert", t(5))]
    edges = [(i, "g", "file:a", "file:a", t(1 + i % 9)) for i in range(1000)]
    got = found(spark, nodes, edges)
    assert got == {("edges", i, "file:a", "late") for i in range(1000) if 1 + i % 9 < 5}
