"""Long and odd texts take time in proportion to their length."""

from __future__ import annotations

import time

import numpy as np
import pytest

from graphloom.llm import credentials, grammar, handwritten, markup, spans

ODD = ["a" * 400_000, "// x " * 80_000, "* " * 150_000, "password = " * 40_000, "'svc" * 60_000, "<b>" * 40_000, "$" * 80_000, "[[" * 40_000, "{{" * 40_000, "-----BEGIN PRIVATE KEY-----\n" * 10_000, "://a:b" * 50_000, "\\emph{" * 15_000, "| a " * 60_000, "  \n" * 80_000, "`" * 80_001, "<div " * 40_000, "key" + "y" * 300_000]
CODE = {
    "js": ["x = " + "+".join(["a"] * 10_000) + ";", "if(a)b();else " * 1000 + "c();", "x = " + "a ? b : " * 1000 + "c;", "a b " * 2000, "class A {" + "static async get x " * 1000 + "}", "let x = " + "(" * 1500 + ")" * 1500],
    "ts": ["type A = " + "|".join(["'x'"] * 3000) + ";", "let a: b c: d " * 150, "f(a: " + "b | " * 1000 + "c)"],
    "java": ["class A { int[] a = {" + ",".join(["1"] * 10_000) + "}; }", "class A { " + "a b c " * 400 + "}", "@A " * 1500 + "class B {}"],
    "go": ["package a\nfunc f() {\n" + "if a {\n} else " * 1000 + "{\n}\n}\n", "package a\nfunc f() { " + "a b " * 200 + "}\n"],
    "py": ["x = " + "a if b else " * 1000 + "c\n", "a b " * 1500 + "\n", "f(a for " * 150 + "\n", "x = " + "not " * 2000 + "a\n"],
    "json": ["[" * 2000 + "]" * 2000, "[" + ",".join(["1"] * 50_000) + "]"],
}


def _within(seconds: float, f, *args) -> None:
    t = time.process_time()
    f(*args)
    assert time.process_time() - t < seconds


@pytest.mark.parametrize("k", range(len(ODD)))
def test_odd_texts(k):
    _within(8, lambda t: markup.Builder(t).render(), ODD[k])
    _within(8, lambda t: credentials.Scanner().spans(t.encode()), ODD[k])
    _within(8, handwritten.evidence, "src/a.js", ODD[k])
    _within(8, lambda t: spans.span_starts(np.frombuffer(t.encode("utf-32-le"), np.uint32)), ODD[k])


@pytest.mark.parametrize("lang", sorted(CODE))
def test_odd_code(lang):
    def judge(text):
        left, shapes = grammar.reduce_groups(lang, grammar.lex(lang, text))
        return [grammar.produces(lang, x) for x in [*shapes, *grammar.statements(lang, left)]]

    judge("")  # compiles the productions
    for text in CODE[lang]:
        _within(8, judge, text)
