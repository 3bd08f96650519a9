"""Shares, classes and removal of repeated sentences against brute force."""

from __future__ import annotations

import random

from graphloom.llm import spans


def _brute(texts):
    """Per document: the characters in stretches of SPAN and more that occur in another one, and those an earlier one has."""
    n = spans.SPAN
    shared, later = {}, {}
    windows = {k: {t[i : i + n] for i in range(len(t) - n + 1)} for k, t in texts.items()}
    for k, t in texts.items():
        hit, old = [False] * len(t), [False] * len(t)
        for i in range(len(t) - n + 1):
            w = t[i : i + n]
            who = [j for j in texts if j != k and w in windows[j]]
            if who:
                hit[i : i + n] = [True] * n
            if any(j < k for j in who):
                old[i : i + n] = [True] * n
        shared[k], later[k] = hit, old
    return shared, later


def test_shares_and_removal_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["harbor", "queue", "lantern", "voucher", "tariff", "pallet", "kiln", "ember"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(4, 30))) + ". "
    pool = ["".join(sentence() for _ in range(rng.randint(1, 6))) for _ in range(14)]
    texts = {k: "".join(rng.choice(pool) if rng.random() < 0.5 else sentence() for _ in range(rng.randint(1, 9))) for k in range(1, 41)}
    texts[41] = texts[7]
    df = spark.createDataFrame([*texts.items(), (50, None), (51, "")], "doc_id long, text string")
    shared, later = _brute(texts)
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_shares(df).collect()}
    assert got == {k: sum(v) for k, v in shared.items()} | {50: 0, 51: 0}
    classes = {r["doc_id"]: (r["rep"], r["n_copies"], r["n_links"]) for r in spans.span_classes(df).collect()}
    if len(texts[7]) >= spans.SPAN:
        assert classes[41][:2] == (7, 2) and classes[41][2] == classes[7][2]
    for r in spans.without_repeats(df).collect():
        k = r["doc_id"]
        if k in (50, 51):
            assert (r["text"], r["n_removed"]) == ((None, 0) if k == 50 else ("", 0))
            continue
        t = texts[k]
        want = "".join(t[a:b] for a, b in spans.sentences(t) if not all(later[k][a:b]))
        assert r["text"] == want and r["n_removed"] == len(t) - len(want)


def test_chain_of_short_runs_is_not_a_passage(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefghijklmnop .") for _ in range(700))
    texts = [(1, a), (2, "x" * 50 + a[100:350] + "y" * 60), (3, "z" * 80 + a[320:470] + "w" * 70)]
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_shares(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: 250, 2: 250, 3: 0}
