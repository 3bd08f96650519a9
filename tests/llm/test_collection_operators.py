"""Fusion, packing, mixing and shared spans against brute force on small cases."""

from __future__ import annotations

import random
from datetime import datetime

import numpy as np
import pytest

from graphloom.llm import fusion, mixing, packing, queries, spans


# --- fusion

N = "node_row long, graphId string, batch_ord int, op string, arrivedAt timestamp_ntz, id string, type string, name string, filePath string, summary string, tags array<string>, g string, src int, v string"


def test_best_fields(spark):
    def row(i, day, summary, tags, id_="file:a.ts", op="upsert", batch=1, g="g"):
        return (i, g, batch, op, datetime(2025, 1, day) if day else None, id_, "file", "a.ts", "src/a.ts", summary, tags, "clash", 1, "clash")

    data = [
        row(1, 1, "Reads the config.", ["x"]), row(2, 2, "TODO", ["", None]), row(3, 3, "Reads the con…", ["unknown"]), row(4, 4, "src/a.ts", ["untagged", "y"], id_="p:file:file:a.ts"), row(5, None, "Older text.", None),
        row(6, 1, "One.", None, id_="file:one"), row(7, 1, "A.", ["t"], id_="file:d"), row(8, 2, None, None, id_="file:d", op="delete"),
        row(9, 1, None, None, id_="file:n", g=None), row(10, 2, "  ", [], id_="file:n", g=None), row(11, 1, "x", ["t"], id_=None), row(12, 1, "x", ["t"], id_="  "),
    ]
    df = spark.createDataFrame(data, N)
    got = {(r["graphId"], r["id"]): (r["n_rows"], r["n_deletes"], r["summary_row"], r["tags_row"]) for r in fusion.fuse(df).collect()}
    assert got == {("g", "file:a.ts"): (5, 0, 1, 4), ("g", "file:one"): (1, 0, 6, None), ("g", "file:d"): (2, 1, 7, 7), (None, "file:n"): (2, 0, None, None)}
    best = {r["id"]: (r["summary"], r["tags"]) for r in fusion.survivors(df).collect()}
    assert best["file:a.ts"] == ("Reads the config.", ["y"]) and best["file:n"] == (None, None)
    assert fusion.fuse(df.limit(0)).count() == 0


# --- packing


def test_bins_hold_everything_and_waste_little():
    rng = random.Random(3)
    for cap in (50, 997, 6144):
        sizes = np.array([min(cap, int(rng.paretovariate(0.8) * cap / 40) + 1) for _ in range(700)])
        bins = packing.pack(sizes, np.arange(len(sizes)), cap)
        assert sorted(x for b in bins for x in b) == list(range(len(sizes)))
        assert all(sizes[b].sum() <= cap for b in bins)
        assert len(bins) <= max(-(-sizes.sum() // cap) + 2, (sizes > cap / 2).sum() + 2)


def test_small_cases_are_optimal():
    rng = random.Random(5)
    for _ in range(60):
        cap = rng.randint(8, 20)
        sizes = np.array([rng.randint(1, cap) for _ in range(rng.randint(1, 7))])
        best = _fewest(sorted(sizes.tolist(), reverse=True), cap)
        assert len(packing.pack(sizes, np.arange(len(sizes)), cap)) <= best + 1


def _fewest(sizes: list[int], cap: int) -> int:
    best = len(sizes)

    def go(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k, b in enumerate(bins):
            if b + sizes[i] <= cap:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def test_oversized_documents_are_split_and_no_other(spark):
    docs = spark.createDataFrame([(1, "a" * 25, "x", 0), (2, "ü" * 4, "x", 0), (3, "", "x", 0), (4, None, "x", 0), (5, "a" * 9, "x", 0), (6, "a" * 19, "x", 0)], "doc_id long, text string, container string, shard int")
    specs = spark.createDataFrame([(1, 10), (2, 0), (3, None)], "spec_id int, capacity int")
    packed = packing.pack_documents(docs, specs)
    rows = packed.collect()
    assert {r["doc_id"] for r in packing.split_documents(packed).collect()} == {1, 6}
    total: dict = {}
    for r in rows:
        total[r["container"]] = total.get(r["container"], 0) + r["tokens"]
    assert max(total.values()) <= 10 and sum(total.values()) == 26 + 9 + 1 + 10 + 20
    assert sorted(r["piece_no"] for r in rows if r["doc_id"] == 1) == [0, 1, 2]
    assert packing.pack_documents(docs.limit(0), specs).count() == 0 and packing.pack_documents(docs, specs.limit(0)).count() == 0


# --- mixing


def test_shares_are_met_within_the_repeats(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["A ", "b", "b", "b", "c_d", "other"]), "x" * rng.randint(1, 400)) for i in range(3000)] + [(9001, "b", None), (9002, None, "x"), (9003, "b", "")]
    df = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, source string, text string, rate double")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 1), ("c-d", 0.19, 2), ("none", 0.01, 4), ("bad", None, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets)
    got = {r["source"]: r for r in mixing.share_report(mixed, targets).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c-d", 0.19)):
        assert got[s]["reached_share"] == pytest.approx(share / 0.99, abs=0.003)
    assert got["none"]["tokens"] == 0 and got["a"]["most_copies"] <= 3 and got["b"]["most_copies"] == 1
    assert mixed.count() == mixed.select("doc_id").distinct().count() and mixed.where("copies < 1").count() == 0
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


# --- shared spans


def brute(docs: dict[int, str]) -> set[tuple[int, int]]:
    seen: dict[str, set[int]] = {}
    for d, t in docs.items():
        for i in range(len(t) - spans.SPAN + 1):
            seen.setdefault(t[i : i + spans.SPAN], set()).add(d)
    return {(a, b) for ids in seen.values() for a in ids for b in ids if a < b}


def corpus(seed: int) -> dict[int, str]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma.", "delta", "ünï", "图层", "😀", "x", "\n", "e1", "e2", "e3!"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "", "  "]) for _ in range(n))
    docs = {i: text(rng.randint(20, 150)) for i in range(60)}
    for i in range(60, 120):
        src = docs[rng.randrange(60)]
        n = rng.choice([150, 198, 199, 200, 201, 202, 260, 500])
        at = rng.randrange(max(1, len(src) - n))
        docs[i] = text(rng.randint(0, 30)) + src[at : at + n] + text(rng.randint(0, 30))
    docs[120] = docs[121] = docs[3] * 2 + "z" * 300
    docs[122], docs[123] = "z" * 250, "ab" * 400
    docs[124] = "ba" * 120
    return docs


def test_pairs_are_those_of_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(d, t, 0, "c") for d, t in docs.items()] + [(900, None, 0, "c"), (901, "", 0, "c"), (902, "short", 0, "c"), (903, "short", 0, "c")], "doc_id long, text string, pos int, rep string")
        assert {(r["doc_a"], r["doc_b"]) for r in spans.shared_pairs(df).collect()} == brute(docs)


def test_shares_of_a_planted_passage(spark):
    a = "".join(chr(97 + (i * i + 3 * i) % 23) + (". " if i % 40 == 0 else "") for i in range(900))
    b = "Q" * 57 + a[100:400] + "W" * 91
    df = spark.createDataFrame([(1, a), (2, b), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in spans.shared_shares(df).collect()}
    assert got == {1: (len(a), 300), 2: (len(b), 300), 3: (0, 0)}
    assert spans.shared_pairs(df.limit(0)).count() == 0


def brute_chars(docs: dict[int, str]) -> dict[int, int]:
    """Characters of each text that lie in a stretch of SPAN characters that another text has."""
    owners: dict[str, set[int]] = {}
    for d, t in docs.items():
        for i in range(len(t) - spans.SPAN + 1):
            owners.setdefault(t[i : i + spans.SPAN], set()).add(d)
    out = {}
    for d, t in docs.items():
        held = set()
        for i in range(len(t) - spans.SPAN + 1):
            if len(owners[t[i : i + spans.SPAN]]) > 1:
                held.update(range(i, i + spans.SPAN))
        out[d] = len(held)
    return out


def test_a_short_run_of_a_third_text_does_not_lengthen_a_passage(spark):
    rng = random.Random(7)
    noise = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    a = noise(900)
    docs = {1: a, 2: noise(80) + a[300:550] + noise(80), 3: noise(60) + a[500:640] + noise(60), 4: noise(60) + a[620:755] + noise(60)}
    got = spans.repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 300, 550), (2, 80, 330)}


def test_shared_characters_are_those_of_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_shares(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
        assert got == brute_chars(docs)


def test_every_stretch_has_a_start_that_depends_on_it_alone():
    rng = np.random.default_rng(4)
    for _ in range(40):
        text = rng.integers(97, 103, 200).astype(np.uint32)
        frames = [np.concatenate([rng.integers(97, 103, rng.integers(0, 300)).astype(np.uint32), text, rng.integers(97, 103, rng.integers(0, 300)).astype(np.uint32)]) for _ in range(2)]
        runs = []
        for f in frames:
            _, h = spans.span_starts(f)
            runs.append(set(h.tolist()))
        assert runs[0] & runs[1]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    import os

    import duckdb

    from compare import rows

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    df = queries.QUERIES[name](spark, d)
    got = df.collect()
    if name in queries.ORACLE:
        con = duckdb.connect()
        for t in ("nodes", "documents", "pack_specs"):
            con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
        cur = con.execute(queries.ORACLE[name])
        cols = [x[0] for x in cur.description]
        assert rows(cols, cur.fetchall()) == rows(df.columns, got)
