from __future__ import annotations

from graphloom.functions.ids import with_repaired_id, with_repaired_ref

S = "id string, type string, filePath string, name string, flow string"


def fixed(spark, *row, flow=None):
    df = spark.createDataFrame([(*row, flow)], S)
    return with_repaired_id(df, "rid", flow_slug="flow").first()["rid"]


def test_repair_of_node_ids(spark):
    cases = [
        (("file:src/a.ts", "file", "src/a.ts", "a"), "file:src/a.ts"),
        (("file:file:src/a.ts", "file", None, None), "file:src/a.ts"),
        (("my-project:file:src/a.ts", "file", None, None), "file:src/a.ts"),
        (("my-project:service:docker", "service", None, None), "service:docker"),
        (("  src/a.ts\t", "file", None, None), "file:src/a.ts"),
        (("src/a.ts", "FILE", None, None), "file:src/a.ts"),
        (("formatDate", "function", "src/u.ts", "formatDate"), "func:src/u.ts:formatDate"),
        (("function:src/u.ts:formatDate", "function", "src/u.ts", "formatDate"), "func:src/u.ts:formatDate"),
        (("class:src/u.ts:A", "class", "src/u.ts", "A"), "class:src/u.ts:A"),
        (("article:x", "article", None, "x"), "article:x"),
        (("repo:article:x", "article", None, "x"), "repo:article:x"),
        (("", "file", None, None), ""),
        ((None, "file", None, None), None),
        (("step:checkout:pay", "step", "src/p.ts", "Pay"), "step:checkout:src/p.ts:pay"),
        (("step:pay", "step", "src/p.ts", "Pay"), "step:src/p.ts:pay"),
        (("Pay Now", "step", "src/p.ts", "Pay"), "step:src/p.ts:pay-now"),
    ]
    for row, want in cases:
        assert fixed(spark, *row) == want, row
    assert fixed(spark, "Pay Now", "step", "src/p.ts", "Pay", flow="checkout") == "step:checkout:src/p.ts:pay-now"


def test_repair_is_idempotent_and_references_infer_their_type(spark):
    df = spark.createDataFrame([("x:func:a.ts:f",), ("a.ts",), (" file:a.ts ",), ("p:class:class:a.ts:C",), ("article:x",), ("",), (None,)], "ref string")
    once = with_repaired_ref(df, "ref", "one")
    got = [(r["one"], r["two"]) for r in with_repaired_ref(once, "one", "two").collect()]
    assert [a for a, _ in got] == ["func:a.ts:f", "file:a.ts", "file:a.ts", "class:a.ts:C", "file:x", "", None]
    assert all(a == b for a, b in got)
