from __future__ import annotations

from datetime import datetime

from graphloom.operators.snapshots import SnapshotIndex, snapshot_changes

S = (
    "fp_row long, graphId string, snapshot_no int, deliveredAt timestamp_ntz, filePath string, contentHash string,"
    " functions array<struct<name:string,params:array<string>,returnType:string,exported:boolean,lineCount:int>>, bucket string, hash string"
)
A, B = ("f", ["x", "y"], "int", True, 3), ("g", [], None, False, 1)


def rows(spark, data):
    return spark.createDataFrame([(i, g, n, datetime(2025, 1, day), p, h, fns, "clash", "clash") for i, (g, n, day, p, h, fns) in enumerate(data)], S)


def changes(spark, data):
    return {(r["graphId"], r["snapshot_no"], r["filePath"], r["change"]) for r in snapshot_changes(rows(spark, data), 4).collect()}


def test_changes_between_snapshots(spark):
    data = [
        ("g", 1, 1, "./a", "SHA256:AB", None), ("g", 1, 1, "b//c", "1", None), ("g", 1, 1, "gone", "1", None), ("g", 1, 1, "v", None, [A, B]), ("g", 1, 1, "w", None, None), ("g", 1, 1, "Case", "1", None),
        ("g", 4, 2, "a", "ab", None), ("g", 4, 2, "b\\c", "2", None), ("g", 4, 2, "v", "x", [B, A, A]), ("g", 4, 2, "w", "y", []), ("g", 4, 2, "new", None, None), ("g", 4, 2, "case", "1", None),
        ("g", 4, 3, "a", "ab", None), ("h", 2, 1, "only", "1", None), (None, 1, 1, "x", "1", None), ("g", 4, 3, None, "1", None),
        ("g", 5, 4, "a", "old", None), ("g", 5, 5, "a", "ab", None), ("g", 5, 4, "v", None, [A]),
    ]
    assert changes(spark, data) == {
        ("g", 4, "b/c", "changed"), ("g", 4, "gone", "removed"), ("g", 4, "new", "added"), ("g", 4, "Case", "removed"), ("g", 4, "case", "added"),
        ("g", 5, "b/c", "removed"), ("g", 5, "w", "removed"), ("g", 5, "new", "removed"), ("g", 5, "case", "removed"), ("g", 5, "v", "changed"),
    }


def test_empty_table_and_repeated_deliveries(spark):
    assert changes(spark, []) == set()
    one = ("g", 1, 1, "a", "1", None)
    assert changes(spark, [one, one, ("g", 2, 1, "a", "1", None)]) == set()


def test_index_is_kept_for_graphs_that_are_not_delivered(spark):
    df = rows(spark, [("g", 1, 1, "a", "1", None), ("h", 1, 1, "b", "1", None), ("g", 2, 1, "a", "2", None), ("h", 3, 1, "b", "2", None)])
    index = SnapshotIndex(spark, df, 4)
    seen = [sorted((r["graphId"], r["change"]) for r in index.apply(df.where(f"snapshot_no = {n}"), n).collect()) for n in (1, 2, 3)]
    assert seen == [[], [("g", "changed")], [("h", "changed")]]
