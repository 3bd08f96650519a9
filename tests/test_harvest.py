"""Docstrings, fields, designs, trees and registries on small cases."""

from __future__ import annotations

from graphloom.operators import claims, design, harvest, merging
from graphloom.sources import registry, trees

SOURCE = '''"""Module text."""
import os


class A:
    """Of a class.

    :param x: no such
    """

    def f(self, a, *b, c=1, **d):
        """Does it.

        :param a: first
        :param nope: wrong
        :raises ValueError: sometimes
        :raises KeyError: never
        :returns: a number
        :yields: nothing
        """
        if a:
            raise ValueError("x")
        g(a)
        return os.path.join(a)

    def quiet(self, a): pass


async def g(a):
    yield a
'''


def test_symbols_units_and_findings(spark):
    df = spark.createDataFrame([("g", "a.py", SOURCE), ("g", "b.py", "def ("), ("g", "c.py", ""), ("g", "d.py", None), ("g", "e.md", "# x")], "graphId string, path string, content string")
    s = harvest.python_symbols(df)
    got = {r["qualname"]: r for r in s.where("path = 'a.py'").collect()}
    assert set(got) == {"", "A", "A.f", "A.quiet", "g"}
    assert got["A.f"]["params"] == ["a", "b", "c", "d"] and got["A.f"]["raises"] == ["ValueError"] and got["A.f"]["calls"] == ["ValueError", "g", "join"] and got["A.f"]["returns"] and not got["A.f"]["yields"]
    assert got["g"]["yields"] and got["A"]["kind"] == "class" and got["A.f"]["parent"] == "A" and (got[""]["doc_start"], got[""]["doc_end"]) == (1, 1)
    units = harvest.doc_units(s).collect()
    assert {(u["qualname"], u["part"]) for u in units} == {("", 0), ("A", 0), ("A.f", 0)}
    assert all(u["unit"] == harvest.unit_id(u["path"], u["qualname"], u["text"]) for u in units)
    found = {(r["finding"], r["name"]) for r in harvest.field_findings(s).where("qualname = 'A.f'").collect()}
    assert found == {("param-unknown", "nope"), ("param-omitted", "b"), ("param-omitted", "c"), ("param-omitted", "d"), ("raises-unknown", "KeyError"), ("yields-unknown", "")}
    calls = spark.createDataFrame([("g", "a.py", "g")], "graphId string, path string, name string")
    assert [(r["n_calls"], r["n_covered"]) for r in harvest.call_coverage(s, calls).collect()] == [(3, 1)]


def test_parts_of_long_docstrings():
    paragraphs = [("p%d " % i) * 200 for i in range(5)]
    parts = harvest.parts_of("\n\n".join(paragraphs) + "\n\nend.")
    assert all(len(p) <= harvest.PART + harvest.SLIVER for p in parts) and parts[-1].endswith("end.") and len(parts) > 1
    assert harvest.parts_of("") == [] and harvest.parts_of("x" * 5000) == ["x" * 5000]


def test_docstrings_are_stripped_in_place():
    out = harvest.without_docstrings(SOURCE)
    assert out.count("\n") == SOURCE.count("\n") and "Does it" not in out and "raise ValueError" in out
    assert harvest.without_docstrings("def (") == "def ("


def test_design_tree(spark):
    rows = [("d", "0", None, "DOCUMENT", "doc"), ("d", "1", "0", "CANVAS", "Page"), ("d", "2", "1", "SECTION", "s"), ("d", "3", "2", "FRAME", "Home"), ("d", "4", "3", "FRAME", "inner"), ("d", "5", "4", "INSTANCE", "Button"), ("d", "6", "1", "COMPONENT_SET", "Set"), ("d", "7", "6", "COMPONENT", "v1"), ("d", "8", "9", "FRAME", "loop"), ("d", "9", "8", "FRAME", "loop2")]
    tree = spark.createDataFrame(rows, "doc string, id string, parent string, type string, name string")
    nodes, edges = design.parse_document(tree)
    assert {(r["id"], r["type"]) for r in nodes.collect()} == {("1", "page"), ("3", "screen"), ("5", "instance"), ("6", "componentSet"), ("7", "component")}
    assert {(r["source"], r["target"]) for r in edges.collect()} == {("1", "3"), ("3", "5"), ("1", "6"), ("6", "7")}
    styles = spark.createDataFrame([("d", "s1", "k1", "Brand / Red", "FILL"), ("d", "s2", None, "Brand / Red", "FILL")], "doc string, local_id string, key string, name string, kind string")
    uses = spark.createDataFrame([("d", "4", "s2"), ("d", "5", "k1"), ("d", "5", "zz")], "doc string, id string, style string")
    tn, te = design.tokens(tree, styles, uses)
    assert [r["id"] for r in tn.collect()] == ["token:brand-red"] and {(r["source"], r["target"]) for r in te.collect()} == {("3", "token:brand-red"), ("5", "token:brand-red")}
    patch = spark.createDataFrame([("d", "3", 1, "A"), ("d", "3", 2, "B"), ("d", "3", 3, None)], "doc string, id string, ord int, name string")
    assert {r["name"] for r in design.patched(nodes, patch, ["name"]).where("id = '3'").collect()} == {"B"}
    assert design.design_tour(nodes, 2).count() == 3


def test_trees_and_persistence(spark, tmp_path):
    for name, text in {"src/a.ts": "let a = 1;\n", "raw/b.pdf.txt": "x" * 2048, "node_modules/c.js": "x", "README.md": "# r\n" + "y" * 9000, "index.md": "#", "d.md": "#", "package.json": "{}", "e.bin": "a\0b"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = trees.tree_files(spark, str(tmp_path))
    got = {r["path"]: r["language"] for r in files.collect()}
    assert set(got) == {"src/a.ts", "raw/b.pdf.txt", "README.md", "index.md", "d.md", "package.json", "e.bin"} and got["src/a.ts"] == "typescript"
    assert trees.wiki_format(files) == "wiki" and trees.wiki_format(files.where("path = 'd.md'")) == "markdown" and trees.wiki_format(files.limit(0)) == "none"
    assert [(r["id"], r["summary"]) for r in trees.raw_sources(files).collect()] == [("source:b.pdf.txt", "txt, 2.0 KB")]
    texts = trees.tree_texts(spark, str(tmp_path))
    assert "e.bin" not in {r["path"] for r in texts.collect()}
    assert {r["path"]: (len(r["content"]), r["cut"]) for r in trees.metadata_files(texts).collect()} == {"README.md": (3000, True), "package.json": (2, False)}
    assert trees.data_dir(str(tmp_path)).endswith(".graphloom")
    (tmp_path / ".graph").mkdir()
    assert trees.data_dir(str(tmp_path)).endswith("/.graph")
    path = str(tmp_path / "state" / "m.json")
    assert trees.load_json(path, {"a": 1}) == {"a": 1}
    trees.save_json(path, {"b": 2})
    assert trees.load_json(path, {"a": 1}) == {"a": 1, "b": 2}
    (tmp_path / "state" / "m.json").write_text("[")
    assert trees.load_json(path, {"a": 1}) == {"a": 1}
    assert trees.load_table(spark, str(tmp_path / "none"), "a int").count() == 0
    for n in ("z-graph.json", "base-graph.json", "a-graph.json", "out-graph.json"):
        (tmp_path / "state" / n).write_text("{}")
    assert [x.rsplit("/", 1)[-1] for x in trees.graph_files(str(tmp_path / "state"), "out-graph.json")] == ["base-graph.json", "a-graph.json", "z-graph.json"]


def test_registry_last_registration_wins(spark):
    r = registry.Registry()
    r.register("one", ("python", "go"), lambda f: f.select("path", "lang").withColumn("by", registry.F.lit("one")))
    r.register("two", ("python",), lambda f: f.select("path", "lang").withColumn("by", registry.F.lit("two")))
    df = spark.createDataFrame([("a.py", "python"), ("b.go", "go"), ("c.rs", "rust")], "path string, lang string")
    assert {(x["path"], x["by"]) for x in r.analyse(df).collect()} == {("a.py", "two"), ("b.go", "one")}
    r.unregister("two")
    assert {(x["path"], x["by"]) for x in r.analyse(df).collect()} == {("a.py", "one"), ("b.go", "one")}
    assert r.for_language("rust") is None
    assert registry.configured('{"plugins": [{"name": "a", "enabled": false}]}', ["a", "b"]) == ["b"] and registry.configured("{", ["a", "b"]) == ["a", "b"] and registry.configured(None, ["a"]) == ["a"]
    files = spark.createDataFrame([("g", "x/package.json", '{"dependencies": {"React": 1}}'), ("g", "y.json", "react")], "graphId string, path string, content string")
    assert [(x["graphId"], x["framework"]) for x in registry.frameworks(files, [("react", "package.json", "react"), ("vue", "package.json", "vue")]).collect()] == [("g", "react")]


def test_votes_ties_and_missing_claims(spark):
    ddl = "k string, b string, voter int, verdict string"
    votes = spark.createDataFrame([("a", "x", 1, "supported"), ("a", "x", 2, "contradicted"), ("b", "x", 1, "supported"), ("b", "x", 2, "supported"), ("c", "y", 3, "unverifiable")], ddl)
    expected = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "k string, b string")
    got = {r["k"]: (r["verdict"], r["agreement"]) for r in claims.ranked_consensus(expected, votes, ["k"], "b").collect()}
    assert got == {"a": ("contradicted", "split"), "b": ("supported", "unanimous"), "c": ("unverifiable", "majority"), "d": (None, "missing")}


def test_entities_of_one_name_are_one(spark):
    nodes = spark.createDataFrame([("g", "entity:a", 1, "person", "Ada  L"), ("g", "entity:b", 2, "Entity", "ada l"), ("g", "article:x", 3, "note", "X"), ("g", "odd:z", 4, "odd", "Z"), ("g", None, 5, "note", "n")], "graphId string, id string, node_row long, type string, name string")
    edges = spark.createDataFrame([("g", "article:x", "entity:b", "mentions", 1), ("g", "article:x", "entity:a", "related", 2), ("g", "article:x", "odd:z", "cites", 3), ("g", None, "entity:a", "cites", 4)], "graphId string, source string, target string, type string, edge_row long")
    n, e = merging.merge_knowledge(nodes, edges)
    assert {r["id"] for r in n.collect()} == {"entity:a", "article:x"}
    assert [(r["source"], r["target"], r["type"], r["edge_row"]) for r in e.collect()] == [("article:x", "entity:a", "related", 1)]
