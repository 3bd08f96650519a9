from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from graphloom.sources import graphs, ignore, parsers, wiki
from graphloom.streaming import changes


def test_graph_files_round_trip_and_malformed_ones(spark, tmp_path):
    g = {"version": "1", "nodes": [{"id": "file:a", "type": "file", "name": "a", "tags": ["x"]}, {"id": "file:b", "type": "file", "name": "b"}], "edges": [{"source": "file:a", "target": "file:b", "type": "imports", "weight": "0.7"}], "layers": None}
    (tmp_path / "g.json").write_text(json.dumps(g))
    (tmp_path / "bad.json").write_text("{nope")
    t = graphs.graph_tables(graphs.read_graphs(spark, str(tmp_path)))
    assert [(r["node_ord"], r["id"]) for r in t["nodes"].orderBy("node_ord").collect()] == [(0, "file:a"), (1, "file:b")]
    assert t["edges"].first()["weight"] == "0.7" and t["layers"].count() == 0
    graphs.write_graphs(t["nodes"], t["edges"], str(tmp_path / "out"))
    back = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("*.json")))
    assert [n["id"] for n in back["nodes"]] == ["file:a", "file:b"] and len(back["edges"]) == 1


def test_batches_in_order_with_problems_told(spark, tmp_path):
    def put(name, nodes, edges=()):
        (tmp_path / name).write_text(json.dumps({"nodes": [{"id": n} for n in nodes], "edges": list(edges)}))

    put("batch-2.json", ["c"])
    put("batch-10-part-2.json", ["e"])
    put("batch-10-part-1.json", ["d"])
    put("batch-existing.json", ["a", "b"])
    put("batch-3.json", [])
    put("notes.json", ["z"])
    (tmp_path / "batch-4.json").write_text("{")
    (tmp_path / "batch-5.json").write_text("{}")
    rows, problems = graphs.read_batches(spark, str(tmp_path))
    assert [r["node"]["id"] for r in rows.where("what = 'node'").orderBy("batch_ord", "part", "ord").collect()] == ["a", "b", "c", "d", "e"]
    assert {(r["file"], r["problem"]) for r in problems.collect()} == {("batch-3.json", "empty"), ("notes.json", "unrecognised name"), ("batch-4.json", "malformed"), ("batch-5.json", "no nodes or edges")}


def test_ignore_rules_last_match_wins(spark):
    paths = ["src/a.ts", "node_modules/x/a.js", "src/a.min.js", "docs/build/x", "keep/build/x", "a.log", "src/deep/test/x.py", "LICENSE"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["x"] for r in df.select("path", ignore.is_ignored(F.col("path"), ignore.DEFAULTS, ["# note", "", "!keep/build/", "src/**/test/"]).alias("x")).collect()}
    assert got == {"src/a.ts": False, "node_modules/x/a.js": True, "src/a.min.js": True, "docs/build/x": True, "keep/build/x": False, "a.log": True, "src/deep/test/x.py": True, "LICENSE": True}


def test_wiki_folder(spark, tmp_path):
    for name, text in {"index.md": "# Index", "a.md": "# Alpha\n\nFirst words.\n\nSee [[b]] and [[sub/C|see]] and [[nowhere]].", "b.md": "no heading [[A]]", "sub/c.md": "# C\n[[c]]"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    articles = wiki.read_articles(spark, str(tmp_path))
    nodes = {r["id"]: (r["name"], r["summary"], r["complexity"]) for r in wiki.article_nodes(articles).collect()}
    assert nodes["article:a"] == ("Alpha", "First words.", "simple") and set(nodes) == {"article:a", "article:b", "article:sub/c"}
    assert {(r["source"], r["target"]) for r in wiki.article_edges(articles).collect()} == {("article:a", "article:b"), ("article:a", "article:sub/c"), ("article:b", "article:a")}


def ents(lang, text):
    return [(e.kind, e.name, e.first, e.last) for e in parsers.entities(lang, text)]


def test_parsers():
    assert ents("sql", "CREATE TABLE users (\n  id INT,\n  PRIMARY KEY (id)\n);\nCREATE VIEW v AS SELECT 1;\n") == [("table", "users", 1, 4), ("view", "v", 5, 5)]
    assert parsers.entities("sql", "CREATE TABLE users (\n  id INT,\n  name TEXT,\n  PRIMARY KEY (id)\n);")[0].fields == ["id", "name"]
    assert ents("config", "# c\nA=1\n\n b_2=x\n") == [("variable", "A", 2, 2), ("variable", "b_2", 4, 4)]
    assert ents("toml", "[a]\nx = 1\n[[b.c]]\ny = 2\n") == [("section", "a", 1, 4), ("section", "[[b.c]]", 3, 4)]
    assert ents("yaml", "a: 1\nb:\n  c: 2\n") == [("section", "a", 1, 1), ("section", "b", 2, 3)]
    assert ents("makefile", "build: x\n\tgo\n.PHONY: a\nX := 1\ntest:\n") == [("target", "build", 1, 1), ("target", "test", 5, 5)]
    assert ents("markdown", "# A\ntext\n```\n# no\n```\n## B\n") == [("section", "A", 1, 5), ("section", "B", 6, 6)]
    assert ("stage", "base", 1, 2) in ents("dockerfile", "FROM node:18 AS base\nRUN x\nFROM scratch\n")
    assert ents("protobuf", "message A {\n  string x = 1;\n}\nservice S {\n  rpc Get (A) returns (A);\n}\n") == [("message", "A", 1, 3), ("service", "S", 4, 6)]
    assert ents("terraform", 'resource "aws_x" "y" {\n  a = "}"\n}\nvariable "v" {}\n') == [("resource", "aws_x.y", 1, 3), ("block", "variable.v", 4, 4)]
    assert ents("shell", "f() {\n  echo '}'\n}\nfunction g {\n}\n") == [("function", "f", 1, 3), ("function", "g", 4, 5)]
    assert ents("graphql", "type Query {\n  users: [U]\n}\ntype U { id: ID }\n") == [("query", "Query", 1, 3), ("type", "U", 4, 4)]
    assert ents("json", '{"a": 1, // c\n "b": {"$ref": "#/d"},}') == [("key", "a", 1, 1), ("key", "b", 2, 2), ("ref", "#/d", 1, 1)]
    py = ents("python", "import os\nclass A:\n    def f(self, x):\n        def g():\n            return os.path.join(x)\n        return g()\n")
    assert ("method", "A.f", 3, 6) in py and ("function", "A.f.g", 4, 5) in py and ("call", "os.path.join", 5, 5) in py and ("import", "os", 1, 1) in py
    ts = ents("typescript", "import { a } from './b';\nexport class C {\n  m(x: number): void {\n    if (x) { }\n  }\n}\nexport function f() { return '}'; }\n")
    assert ts == [("import", "./b", 1, 1), ("class", "C", 2, 6), ("method", "m", 3, 5), ("function", "f", 7, 7)]
    assert [e[:2] for e in ents("go", 'package a\nimport "fmt"\ntype T struct {\n\tA int\n}\nfunc (t *T) F() {\n}\n')] == [("import", "fmt"), ("class", "T"), ("function", "F")]
    assert ents("nolang", "x") == [] and ents("python", "def (") == [] and ents("json", "{") == [] and ents("sql", "") == []


def test_stream_of_deliveries_repeats_no_change(spark, tmp_path):
    schema = "fp_row long, graphId string, snapshot_no int, deliveredAt timestamp_ntz, filePath string, contentHash string, functions array<struct<name:string,params:array<string>,returnType:string,exported:boolean,lineCount:int>>"

    def deliver(k, rows):
        spark.createDataFrame([(k * 10 + i, "g", k, datetime(2025, 1, k), p, h, None) for i, (p, h) in enumerate(rows)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))

    deliver(1, [("a", "1"), ("b", "1"), ("n", None)])
    target = changes.FingerprintStream(spark, str(tmp_path / "state"), 4)
    src = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes.start(src, target, str(tmp_path / "ck")).awaitTermination()
    deliver(2, [("a", "2"), ("c", "1"), ("n", "7")])
    changes.start(src, target, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "state" / "changes")).collect()
    assert {(r["snapshot_no"], r["filePath"], r["change"]) for r in got} == {(2, "a", "changed"), (2, "b", "removed"), (2, "c", "added")}


def test_windows_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("x", datetime(2025, 1, 1, h)) for h in (0, 0, 1, 5)], "kind string, ts timestamp").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("kind string, ts timestamp").parquet(str(tmp_path / "e"))
    q = changes.window_counts(s, "ts", ["kind"], "1 hour", late="10 minutes").writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("win").collect()) == [1, 1, 2]
