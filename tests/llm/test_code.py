"""Syntax, functions with documentation, and origin of source files."""

from __future__ import annotations

import ast
import glob
import json
import os

import pytest

from treeline.llm import functions as Fn
from treeline.llm import origin as O
from treeline.llm.lexers import EXTENSIONS
from treeline.llm.syntax import LANGUAGES, invalid_texts, judge, permissible

VALID = {
    "python": ["", "x = 1\n", "@a.b(1)\nasync def f(a, /, *, b: int = 2, **k) -> list[int]:\n    '''doc'''\n    return [x async for x in y if x]\n", "if a:\n\tb\nelif c: d\nelse:\n    e\n", "x = f'{a!r:>{w}} {b[\"k\"]}'\nlambda *a, b=1: (yield)\n", "match x:\n    case [1, *_] if y:\n        pass\n"],
    "javascript": ["", "#!/bin/x\nimport a, { b as c } from 'd'\nexport default class A extends B { #p = 1; static async *m(x = 1, ...r) { for await (const y of z) yield* y } get q() { return this.#p } }\n", "const r = /[/\\]]+/g, t = `a${b ? `c${d}` : e}f`, f = async (x) => ({ ...x, [k]: 1, g() {} })\nlet a\n[b] = c\n++d\n", "label: for (let i = 0, j; i < 5; i++) if (a) continue label; else break\n", "a = b ? c : d ? e : f; x = y / 2 / z; switch (a) { case 1: default: }\n"],
    "typescript": ["interface A<T extends B = C> extends D { readonly x?: T[]; (y: number): string; [k: string]: unknown }\n", "export const f = <T>(x: Map<string, T[]>, y?: number): x is Y => !!x as any;\ntype M = { [K in keyof T]?: T[K] extends infer U ? U : never };\nabstract class Q<T> implements R { constructor(private a: string, public b = 1) { super() } protected abstract m(): void }\n", "declare module 'x' { export function f(a: string): void }\nenum E { A = 1, B }\n"],
    "rust": ["", "#![allow(x)]\nuse a::{b, c as d, *};\npub(crate) async fn f<'a, T: B<'a> + ?Sized>(x: &'a mut T, y: Vec<Vec<u8>>) -> Result<(), Box<dyn E>> where T: C { let Some(z) = x.y()? else { return Ok(()) }; match z { 0..=9 | 'a' if q => {} _ => f::<u8>(&mut 1, |a, &b| a + b)?, } Ok(()) }\n", "/* a /* b */ c */ struct S<T>(T); impl<T> D for S<T> { const N: usize = 1 << 3; fn g(&self) -> i32 { if self.0 > 1 { 2 } else { 3 } } }\nmacro_rules! m { ($x:expr) => { $x + } }\n", "fn r() { let s = r#\"a\"b\"#; for i in (0..n).rev() { x[i] += 1; } loop { break 'l } }\n"],
    "go": ["package a\n\nimport (\n\t\"b\"\n\tc \"d\"\n)\n\ntype S[T any] struct {\n\tx, y int `tag`\n\t*E\n}\n\nfunc (s *S[T]) F(a, b int, c ...string) (r map[string][]int, err error) {\n\tif x := g(); x != nil {\n\t\treturn nil, x\n\t} else if y {\n\t}\n\tfor i := range 10 {\n\t\tswitch v := z.(type) {\n\t\tcase int, string:\n\t\tdefault:\n\t\t}\n\t}\n\tgo func() { ch <- T{1, 2} }()\n\treturn\n}\n"],
    "java": ["", "package a.b;\nimport static c.D.*;\n@A(x = {1, 2}) public final class E<T extends F & G> extends H<T> implements I, J { private static final int[] K = {1, 2}; E() { super(); } <U> List<? extends U> m(final T... t) throws X { for (var i : t) if (i > 1) return (List<U>) n; else k++; int r = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; Runnable q = () -> {}; var s = \"\"\"\n  a \"b\"\n  \"\"\"; try (var z = y()) { } catch (A | B e) { } finally { } return a ? b : c; } enum L { M(1) { }, N; int f; } record R(int a) { R { } } }\n"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"]}'],
    "toml": ["", "a.b = 1\n[x.'y z']\nd = 1979-05-27T07:32:00Z\ne = [1, # c\n  2,\n]\nf = { g = \"h\", i = 0x1f }\n[[t]]\n\"q\" = '''a\nb'''\n"],
}
INVALID = {
    "python": ["def f(:\n", "if a:\nb\n", "x = (1\n", "  x\n y\n", "<<<<<<< a\nx\n", "'abc\n", "for x y:\n  z\n", "a b\n"],
    "javascript": ["function f( {", "const x = ;", "a b", "if (x {}", "`${a", "const y", "}", "let a = 1 let b", "<<<<<<< x\n", "class { m() }"],
    "typescript": ["interface A { x: }", "function f(x: number { }", "type = = 1", "let x: = 1;"],
    "rust": ["fn f( { }", "let x = 1;", "fn f() { let = 1; }", "struct S { a b }", "fn f() { x y }", "fn g() {"],
    "go": ["", "func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nfunc f() {\n\tx :=\n}\n", "package a\nvar x = []int{\n1\n}\n", "package a\nx := 1\n"],
    "java": ["class A { void m( { } }", "class A { int x = 1 }", "class A { void m() { return } }", "class { }", "public void m() { }}"],
    "json": ["", "{", '{"a": 1,}', "[1 2]", "{'a': 1}", "01", "NaN"],
    "toml": ["a = \n", "[x\n", "a b = 1\n", "= 1\n", "a = {b = 1\n}\n", "version https://x\n", "a = tru\n"],
}


@pytest.mark.parametrize("language", LANGUAGES)
def test_valid_texts(language):
    for text in VALID[language]:
        reason, pairs = judge(language, text)
        assert reason is None and permissible(language).issuperset(pairs), (language, text, reason)


@pytest.mark.parametrize("language", LANGUAGES)
def test_invalid_texts(language):
    for text in INVALID[language]:
        reason, pairs = judge(language, text)
        assert reason or not permissible(language).issuperset(pairs), (language, text)


def test_own_sources_and_their_truncations_against_the_standard_parser():
    for path in sorted(glob.glob(os.path.join(os.path.dirname(O.__file__), "*.py")))[:6]:
        text = open(path, encoding="utf8").read()
        for cut in (len(text), len(text) // 2, len(text) // 3 + 7):
            try:
                ast.parse(text[:cut])
                ok = True
            except SyntaxError:
                ok = False
            assert (judge("python", text[:cut])[0] is None) == ok


def files(spark, rows):
    return spark.createDataFrame([(bytes([i]), p, t) for i, (p, t) in enumerate(rows)], "fk binary, path string, content string")


def test_invalid_texts_as_a_table(spark):
    rows = [("a.py", "x = (\n"), ("a.PY", "x = 1\n"), ("b.go", ""), ("c.json", "{}"), ("d.css", "{{{"), ("noext", "("), ("e.rs", "fn f() {}"), ("f.ts", "let x: = 1"), ("a.py", "x = (\n"), ("deep.json", "[" * 5000 + "]" * 5000)]
    got = {r.fk[0] for r in invalid_texts(files(spark, rows)).collect()}
    assert got == {0, 2, 7, 8}
    assert invalid_texts(files(spark, rows).limit(0)).count() == 0


DOCS = {
    "a.py": ("# Reads the whole file into memory at once.\n@cached\ndef one(x):\n    return x\n\n\ndef two():\n    '''Helper.'''\n\nclass A(B):\n    def three(self):\n        \"\"\"Gives back the number of open files.\n\n        Args:\n            x: the thing that is passed on to others here\n        \"\"\"\n\n# def old():\n#     '''This text belongs to code that was disabled.'''\ndef four():\n    s = 'def five(): pass'\n", {("one", 3), ("three", 11)}, {"one", "two", "three", "four"}),
    "b.ts": ("/** Counts the entries that are still open. */\nexport const six = async (x: number): Promise<void> => { };\n// Too far away to belong to the function.\n\nfunction seven<T>(x: T): T { return x }\nclass C extends D {\n  /** @param x the value that the caller wants to have */\n  private eight(x?: number): { a: string } { return y }\n  // Keeps the cursor of the reader in place.\n  // eslint-disable-next-line no-console\n  static nine() { }\n}\nabstract class E { abstract ten(): void }\n", {("six", 2), ("nine", 11)}, {"six", "seven", "eight", "nine"}),
    "c.rs": ("/// Moves all rows to the next page.\n#[inline]\npub(crate) async fn ten<'a>(x: &'a str) -> Vec<u8> where A: B { vec![] }\nimpl T for S {\n    #[doc = \"Closes the log and reports what was lost.\"]\n    fn eleven(&self) -> i32 { 1 }\n    fn twelve(&self);\n}\n", {("ten", 3), ("eleven", 6)}, {"ten", "eleven"}),
    "d.go": ("package a\n\n// Thirteen tells which of the tables is full.\n// nolint\nfunc Thirteen() (a, b int) {\n\tfunc() {}()\n}\n\n// TODO: write the documentation for this one soon\nfunc (s *S) fourteen() {}\n", {("Thirteen", 5)}, {"Thirteen", "fourteen"}),
    "E.java": ("class F extends G implements H {\n    /**\n     * Tells whether the given name is free.\n     * @param n the name\n     */\n    @Override\n    @X({1, 2})\n    public final boolean fifteen(String n) throws E { return new Object() { int x() { return 1; } } == null; }\n    F() { if (a(b)) { } }\n}\n", {("fifteen", 8)}, {"fifteen", "x", "F"}),
}


@pytest.mark.parametrize("path", DOCS)
def test_functions(path):
    text, documented, names = DOCS[path]
    got = Fn.functions(EXTENSIONS[path[path.rfind(".") :]], text)
    assert {(f[1], f[0]) for f in got if f[7]} == documented
    assert {f[1] for f in got} == names


def test_inherited_documentation(spark):
    cols = "id int, project string, symbol_name string, symbol_parent string, parents array<string>, doc string, documented boolean, inherits boolean"
    rows = [
        (1, "p", "run", "A", [], "Runs the job until it is done.", True, False), (2, "p", "run", "B", ["A"], "", False, True), (3, "p", "run", "C", ["B", "X"], "{@inheritDoc}", False, True),
        (4, "p", "stop", "C", ["B"], "", False, True), (5, "q", "run", "B", ["A"], "", False, True), (6, "p", "run", "D", ["D"], "", False, True), (7, "p", "run", "B2", ["A"], "tbd", False, False), (8, "p", "f", "", [], None, False, True),
    ]
    got = {r.id: r.inherited_doc for r in Fn.resolve_inherited(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: None, 2: rows[0][5], 3: rows[0][5], 4: None, 5: None, 6: None, 7: None, 8: None}


ORIGIN = [
    ("src/a.go", "// Code generated by x. DO NOT EDIT.\n\npackage a\n", "generated"), ("src/b.js", "const NOTICE = 'Code generated by x. DO NOT EDIT.';\n", None), ("src/c.java", "// emits the header \"@generated\" into the output\nclass C {}\n", None),
    ("src/generated_columns/d.py", "x = 1\n", None), ("third_party/e/f.py", "x = 1\n", "vendored"), ("src/vendors/g.py", "x\n", None), ("deps/h-2.4.1/i.rs", "fn f() {}\n", "vendored"), ("deps/mine/i.rs", "fn f() {}\n", None),
    ("a/j-lock.json", "{}", "lockfile"), ("a/lockfile.py", "x = 1\n", None), ("a/k.min.js", "var a=1;", "minified"), ("a/min.js", "var a = 1;\n", None), ("a/l.css", ".a{b:c;d:e}" * 60, "minified"),
    ("a/m.py", "T = [\n" + "    0x1f, 0x2a, 0x33, 0x44,\n" * 30 + "]\n", "data"), ("a/n.py", "T = [1, 2, 3]\n\n\ndef f(a, b):\n    return a + b\n", None), ("a/o.json", '{\n "comment": "AUTO-GENERATED FILE",\n "x": 1}', "generated"),
    ("a/s.py", '"""Reads streams generated by older versions, and files generated with other tools."""\nimport r\n', None), ("a/t.py", "# This was generated by q.\nx = 1\n", "generated"),
    ("a/p.py", '"""Vendored from q 1.2."""\nimport r\n', "vendored"), ("a/q.py", "", None), ("a/r.md", "This page is about files that are generated.\nDo not edit them.\n", None),
]


def test_origin(spark):
    nodes = spark.createDataFrame([(i, bytes([i]), p) for i, (p, _, _) in enumerate(ORIGIN)] + [(99, b"zz", "vendor/no_text.py")], "node_id int, fk binary, path string")
    got = {r.node_id: r.reason for r in O.foreign_files(nodes, files(spark, [(p, t) for p, t, _ in ORIGIN])).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(ORIGIN) if w}


def test_json_reference_parser_is_strict():
    with pytest.raises(ValueError):
        json.loads("{")
