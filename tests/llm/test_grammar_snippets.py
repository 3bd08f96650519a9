"""Constructs of each language, valid and not, in the grammar itself; the exact Python parser serves as a referee only here."""

from __future__ import annotations

import ast

import pytest

from graphloom.llm import grammar, parsing

VALID = {
    "js": [
        "a?.b?.[0]?.(1);", "const { a, b: [c] } = d;", "let x, y = 1;", "for (const [k, v] of Object.entries(o)) { f(k, v); }", "for await (const x of y) { z(x); }", "for (;;) { break; }", "for (a.b in c) d();",
        "if (a) b(); else if (c) d(); else e();", "if (a) { b(); }\nelse { c(); }", "if (a) if (b) c(); else d(); else e();", "try { a(); } catch { b(); }", "try { a(); } catch (e) { b(); } finally { c(); }", "try { a(); }\nfinally { b(); }",
        "do { a(); } while (b);", "do a(); while (b)", "switch (f(a)) { case 1: case 2: b(); break; default: c(); }", "switch (a) {}", "export default function () { return 1; }", "export default class { }", "export const f = () => {};",
        "class A extends (b, c) { static x = 1; #y; get z() { return this.#y; } static { a(); } }", "const o = { get a() { return 1; }, set a(v) {}, async *b() {}, [c]: 1, default: 2, case: 3 };", "x = async () => { await y; };", "new Foo;", "new (foo())(1).bar;",
        "label: while (true) { continue label; }", "var f = function g(a = 1, ...b) {};", "a = b ? c : d ? e : f;", "a ??= b; a ||= c; a **= 2;", "const t = tag`x${y}z`;", "if (a) ; else b();", "import * as a from 'b';\nimport c, { d } from 'e';\nimport 'f';", "import('x').then(m => m.y);",
        "export { a as b } from 'c';\nexport * as d from 'e';", "void 0;\ntypeof a === 'b';", "a\n  .b()\n  .c();", "x = { ...a, b };", "(function () { a(); })();", "(() => 1)();", "throw new Error(`a`);", "while (i--) ;", "const r = /a\\/[/]/gi.exec(s);", "function* g() { const x = yield; yield* h(); }",
    ],
    "ts": [
        "declare module 'x' { export function f(a: string): void; }", "namespace A.B { export const c = 1; }", "interface F { (a: number): string; new (b: string): F; c?(d: any): void; readonly e: string; [k: string]: unknown }", "const a = <const>['b'];", "let x = <Foo>bar;", "type A<T> = T extends string ? 'a' : never;",
        "type M = { readonly [K in keyof T]?: T[K] };", "function f(this: Foo, a?: number): asserts a is number {}", "abstract class A<T> implements B, C<T> { constructor(private x: number, public readonly y = 1) { super(); } abstract z(): void; }", "enum E { A = 'a', B = 'b' }", "const enum F { A, B = A << 1 }",
        "export type { A } from './a';", "import type { B } from './b';", "let u: string | undefined = x!.y as string;", "declare const v: string;", "declare let w: number, z: string;", "declare global { interface Window { a: string } }", "export default interface A { b: string }", "let f: (a: string, b?: number) => Promise<void> = async () => {};",
        "function g(a: string): void;\nfunction g(a: any) { return a; }", "@Component({ a: 'b' })\nexport class C { @Input() d: string; @Output() e = new F<string>(); }", "type T1 = [a: string, b?: number];", "type U =\n  | 'a'\n  | { b: string };", "const s = x satisfies Y;", "export abstract class Z { protected static readonly m: Map<string, number[]> = new Map(); }",
        "let k: keyof typeof obj;", "class Q { private a?: string; b!: number; get c(): string { return this.a ?? ''; } }", "type G = typeof import('x');", "import fs = require('fs');", "export = foo;", "let n: unique symbol;", "for (const x of y as string[]) { z(x); }",
    ],
    "java": [
        "public @interface V { int v() default 1; String[] w() default {}; }", "class A { String f(Object o) { return switch (o) { case Point(int x, int y) when x > 0 -> \"a\"; case String s -> s; default -> { yield \"b\"; } }; } }", "class A { void f() throws E { try (var x = y(); z) { a(); } } }",
        "class A { <U> void f(U u) {} static <K extends Comparable<K>, V> Map<K, V> g() { return null; } }", "module a.b { requires java.base; requires transitive c.d; exports e.f to g.h, i.j; opens k; uses l.M; provides n.O with p.Q; }", "class A { void f() { for (int i = 0, j = 1; i < j; i++, j--) g(); for (;;) { break; } for (final String s : ss) {} } }",
        "class A { int[] a = new int[3]; int[][] b = {{1}, {2}}; long c = 0xFFL; char d = '\\u0041'; String e = \"\"\"\n  x\n  \"\"\"; }", "record P(int x, String... y) implements Q { P { if (x < 0) throw new E(); } static int z; }", "sealed interface S permits A, B {}", "enum E { A(1) { int f() { return 2; } }, B; private final int x = 1; E(int... y) {} int f() { return x; } }",
        "class A { void f() { if (a) b(); else if (c) d(); else { e(); } do { g(); } while (h); while (i) j(); synchronized (k) { l(); } } }", "class A { void f() { try { a(); } catch (B | C e) { d(); } finally { g(); } } }", "class A { void f() { switch (x) { case 1: case 2: a(); break; default: b(); } } }",
        "class A { Runnable r = () -> {}; Function<A, B> g = A::new; Supplier<int[]> h = int[]::new; Comparator<A> c = (x, y) -> x.z - y.z; }", "class A { void f() { outer: for (;;) { continue outer; } int x = (int) y; Object o = (A & B) z; assert x > 0 : \"m\"; } }", "@A(b = 1, c = {2, 3}) @D class E<T extends F & G> extends H<T> implements I<T>, J { static { k(); } { l(); } }",
        "class A { void f() { if (o instanceof final B b && b.c > 1) return; this.<T>g(); new B() { void h() {} }.h(); int a[] = {1}, b = 2; } }", "package a.b;\nimport a.*;\nimport static b.C.d;\n;\ninterface X { default void f() {} static int g() { return 1; } private void h() {} }",
    ],
    "go": [
        "package a\n\nimport (\n\t. \"x\"\n\t_ \"y\"\n\tz \"w\"\n)\n", "package a\n\nfunc f() {\nouter:\n\tfor i := 0; i < 3; i++ {\n\t\tcontinue outer\n\t}\n}\n", "package a\n\nfunc f() {\n\tfor {\n\t\tbreak\n\t}\n\tfor x {\n\t}\n\tfor i := range c {\n\t\tg(i)\n\t}\n\tfor range 3 {\n\t}\n}\n",
        "package a\n\ntype S struct {\n\tA, B int `x`\n\t*C\n\tD map[string][]int\n\tE func(a int) (b string, err error)\n\tF chan<- int\n}\n\ntype I interface {\n\tM(a int) error\n\tN\n\t~int | ~string\n}\n", "package a\n\nfunc F[T any, K comparable](m map[K]T) []T {\n\treturn G[T](m)\n}\n",
        "package a\n\nfunc (s *S[T]) f() (x int) {\n\tswitch y := z.(type) {\n\tcase int, string:\n\t\treturn 1\n\tcase nil:\n\tdefault:\n\t\tfallthrough\n\t}\n\tselect {\n\tcase v := <-c:\n\t\tg(v)\n\tcase c <- 1:\n\t}\n\tdefer func() { h() }()\n\tgo k(1)\n\treturn\n}\n",
        "package a\n\nvar (\n\tx = []struct{ a int }{{1}, {2}}\n\ty, z = 1, 2\n)\n\nconst A = iota\n\ntype B = c.D\n", "package a\n\nfunc f() {\n\tif x := g(); x != nil {\n\t} else if y {\n\t} else {\n\t}\n\ta[1:2], b = c[:], *d\n\te.f++\n\t<-g\n\t_ = func(h ...int) {}\n}\n",
        "package a\n\nfunc f() {\n\tx := map[string]func(){\n\t\t\"a\": g,\n\t\t\"b\": func() {},\n\t}\n\ty := &S{A: 1, B: []int{1, 2}}\n\tvar z [3]int\n\tgoto end\nend:\n\treturn\n}\n",
    ],
    "py": [
        "match x:\n    case {'a': 1, **r} if r:\n        pass\n    case Point(x=0) | [1, *_]:\n        pass\n    case _:\n        pass\n", "match = 3\nmatch.x\nprint(match)\n", "try:\n    a()\nexcept* E as e:\n    b()\nelse:\n    c()\nfinally:\n    d()\n", "for a, *b in c:\n    pass\nelse:\n    pass\n", "while (x := f()):\n    pass\nelse:\n    y = 1\n",
        "with (open(a) as b, c):\n    pass\n", "async def f():\n    async with a as b, c:\n        await d\n    async for e in g():\n        yield e\n    return [x async for x in y if x]\n", "lambda *a, b=1, **c: (a, b)\n", "x: int = 3\ny: 'str'\n", "def f(a, /, b, *, c=1, **d) -> int: ...\n", "class A(B, metaclass=C):\n    x = 1\n\n    @property\n    def y(self): return 1\n",
        "a = b if c else d if e else f\n", "print(*a, **b, sep='')\n", "global_ = 1\ndef f():\n    global x, y\n    nonlocal z\n", "x = {**a, 'b': 1, **c}\ny = {*a, 1}\n", "a[1:2, ..., None:3:4] = b\n", "not_ = not a and (not b) or c is not d not in e\n", "raise A from b\n", "import a.b as c, d\nfrom .. import e\nfrom .f import (g as h,\n  i,\n)\n", "assert (a, b), 'c'\ndel a[0], b.c\n",
        "if a:\n    pass\nelif b: pass\nelse:\n    if c:\n        d()\n    else:\n        e()\nx = 1\n", "@a.b\n@c(1)[0]\nclass D: pass\n", "x = [i for a in b for i in a if i if not j]\n", "def g():\n    x = yield\n    y = yield a, b\n    z = yield from c\n", "f(x for x in y)\nf(a, *b, c=d, **e)\n", "type_ = 1; pass; break_ = 2\n", "a = b = c, = d\nx += y\n", "try:\n    pass\nfinally:\n    pass\n",
        "def f(): return lambda: (yield)\n", "s = 'a' \"b\" f'{c!r:>{d}}'\n", "x = (\n    1 +\n    2)\n", "if True:\n    # c\n\n    pass\n",
    ],
}
INVALID = {
    "js": [
        "const x;", "function (){}", "class { }", "else { }", "case 1:", "if (a) b(); c(); else d();", "try { a(); }", "catch (e) {}", "finally { }", "let = = 3;", "for (const x) {}", "for (let i = 0; i < 3) {}", "do { a(); }", "switch (a);", "a.[0];", "x = {a: 1, b};; }", "function f() { case 1: }", "if a { b(); }", "while { }", "const {a};", "let [b];",
        "import a b from 'c';", "return = 1;", "var 1 = 2;", "f(a b);", "a = ;", "a +;", "(a, b", "x => { ", "new ;", "if (a) else b();", "for (a) b();", "try { } else { }", "class A { x y z }", "export default;", "switch (a) { case: b(); }", "{ a: 1, b: 2 ",
    ],
    "ts": ["interface { }", "const x: string;", "enum { A }", "namespace { }", "function f(a: ): void {}", "let x: = 1;", "class { a: string }", "interface A { b: string c: number }", "type A = ;", "else { }", "declare;x y", "let a: string b: number;", "abstract class { }"],
    "java": [
        "class A { void f() { x y z; } }", "class A { void f() { for (int i) {} } }", "class A { void f() { else { } } }", "class A { void f() { case 1: a(); } }", "class A { void f() { try { a(); } } }", "class A { void f() { catch (E e) {} } }", "class A { void f() { for (int i = 0; i < 3) {} } }", "class A { void f() { do { a(); } } }", "class { }", "class A { int }", "class A { void f( { } }",
        "class A { void f() { if (a) b(); c(); else d(); } }", "class A { void f() { int = 3; } }", "class A { void f() { a b; c d e; } }", "interface A { int f() }", "class A { void f() { return a b; } }", "class A { int x = ; }", "class A extends { }", "package ;\nclass A {}", "import a.b\nclass A {}", "class A { void f() { while { } } }", "class A { void f() { new ; } }", "void f() { x }", "class A { foo bar baz; }",
    ],
    "go": [
        "package a\n\nfunc f() {\n\ta b\n}\n", "package a\n\nfunc f() {\n\tfor i := 0; i < 3 {\n\t}\n}\n", "package a\n\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n", "package a\n\nfunc f() {\n\tcase 1:\n}\n", "package a\n\nelse {\n}\n", "package a\n\nfunc f() {\n\tx := \n}\n", "package a\n\nfunc () {\n}\n", "package a\n\ntype struct {\n}\n", 
        "package a\n\nimport fmt\n", "package a\n\nfunc f() {\n\treturn 1 2\n}\n", "package a\n\nfunc f() {\n\tgo\n}\n", "package a\n\nvar\n", "package\n", "package a\n\nfunc f() {\n\twhile x {\n\t}\n}\n", "package a\n\nfunc f() {\n\tif {\n\t}\n}\n", "package a\n\nx = 3\n", "package a\n\nfunc f() {\n\tif a; b; c {\n\t}\n}\n",
    ],
    "py": [
        "try:\n    pass\n", "else:\n    pass\n", "elif a:\n    pass\n", "except E:\n    pass\n", "if a:\n    pass\nx = 1\nelse:\n    pass\n", "try:\n    a()\nx = 1\nexcept E:\n    pass\n", "def f():\n    try:\n        a()\n\ndef g(): pass\n", "finally:\n    pass\n", "for x in y:\n    pass\nelif z:\n    pass\n", "with a:\n    pass\nelse:\n    pass\n", "try:\n    a\nelse:\n    b\n",
        "if a\n    pass\n", "def f(:\n    pass\n", "class :\n    pass\n", "for x y:\n    pass\n", "x = = 1\n", "x = 1 2\n", "import\n", "from a import\n", "return return\n", "lambda x y: z\n", "f(a b)\n", "while:\n    pass\n", "a ++ \n", "def f()\n", "x = [1, 2\n", "print 'a'\n", "x = 'a\n", "a = b c\n", "if a:\npass\n", "  x = 1\n", "import a.b as\n", "from import b\n", "raise from b\n", "not\n", "a if b\n", "for in x:\n    pass\n", "with as b:\n    pass\n", "x = (1,, 2)\n", "async x = 1\n",
    ],
}


def parses(lang: str, text: str) -> bool:
    letters = grammar.lex(lang, text)
    left, shapes = grammar.reduce_groups(lang, letters)
    if grammar.pair_set(letters) - grammar.permitted_pairs(lang) or any(c in left for c in "()[]{}"):
        return False
    if not all(grammar.produces(lang, x) for x in [*shapes, *grammar.statements(lang, left)]):
        return False
    return lang != "py" or parsing.clause_chains(grammar.clauses(left))


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid(lang, text):
    if lang == "py":
        ast.parse(text)
    assert parses(lang, text)


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, ts in INVALID.items() for t in ts])
def test_invalid(lang, text):
    if lang == "py":
        with pytest.raises(SyntaxError):
            ast.parse(text)
    assert not parses(lang, text)
