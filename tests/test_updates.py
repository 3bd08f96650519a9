"""Triggers and gates of incremental updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import incremental


def test_commands_that_commit(spark):
    rows = [("git commit -m x", True), ("cd a && git -C b merge c", True), ("echo git commit", False), ("git status", False), ("A=1 git pull", True), ("legit commit", False), (None, False)]
    got = spark.createDataFrame(rows, "c string, want boolean").select("want", incremental.commits(F.col("c")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_version_gate_and_position(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", None)], "k string, v string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", None)], "k string, v string")
    assert {r["k"] for r in incremental.version_gate(stored, now, "k", "v").collect()} == {"b", "c", "d"}
    rows = [(0, 0, False, "fresh"), (0, 0, True, "dirty"), (2, 0, None, "ahead"), (0, 1, True, "behind"), (1, 1, False, "diverged"), (None, 0, False, "unknown")]
    got = spark.createDataFrame(rows, "a int, b int, d boolean, want string").select("want", incremental.position(F.col("a"), F.col("b"), F.col("d")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
