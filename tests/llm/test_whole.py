"""Cases that a part of a grammar or a bounded walk would lose."""

from __future__ import annotations

import ast

import pytest

from treeline.llm import functions as Fn
from treeline.llm.syntax import judge, permissible


def flagged(language, text):
    reason, pairs = judge(language, text)
    return bool(reason) or not permissible(language).issuperset(pairs)


PYTHON = [
    "try:\n x = 1\n", "try:\n x\nelse:\n y\n", "try:\n x\nfinally:\n y\nexcept A:\n z\n", "try:\n x\nexcept A, e:\n y\n", "try:\n x\nexcept A:\n y\nexcept* B:\n z\n", "try:\n x\nexcept*:\n y\n",
    "x = 1\nelse:\n y\n", "elif a:\n b\n", "if a:\n b\nelse:\n c\nelif d:\n e\n", "if a:\n b\nelse:\n c\nelse:\n d\n", "except A:\n x\n", "finally:\n x\n", "while a:\n b\nelif c:\n d\n", "with a:\n b\nelse:\n c\n",
    "case 1:\n x\n", "match x:\n y\n", "match x:\n case 1:\n  y\n z\n", "def f(a=1, b): pass\n", "def f(*, **k): pass\n", "def f(*): pass\n", "def f(/, a): pass\n", "def f(a, /, b, /): pass\n", "def f(*a, *b): pass\n",
    "def f(**k, a): pass\n", "lambda a=1, b: a\n", "f(a=1, b)\n", "f(**a, *b)\n", "f(**a, b)\n", "f(a for a in b, c)\n", "class A(b=1, C): pass\n", "def f[](): pass\n", "def f[*T: int](): pass\n",
    "f'{a b}'\n", "f'{}'\n", "f'{a'\n", "f'}'\n", "f'{a!x}'\n", "f'{a!}'\n", "f'{lambda x: 1}'\n", "f'{a:{b c}}'\n", "f'{(a}'\n", "f'{a;b}'\n", "f'''{a\n b}'''\n", "f'{f\"{a b}\"}'\n", "f'{a:{b:{c:{d}}}}'\n",
]


@pytest.mark.parametrize("text", PYTHON)
def test_python_that_the_standard_parser_refuses(text):
    with pytest.raises(SyntaxError):
        ast.parse(text)
    assert flagged("python", text)


def test_python_that_is_valid_passes_the_method_alone(monkeypatch):
    monkeypatch.setattr("treeline.llm.syntax._strictly_valid", lambda language, text: False)
    for text in [
        "if a: b\nelif c:\n d\n\n# x\nelse: e\nfor x in y: z\nelse:\n w\nwhile a: b\nelse: c\n", "try: a\nexcept A as e: b\nexcept (B, C):\n c\nexcept: d\nelse: e\nfinally: f\n", "try:\n a\nexcept* A: b\ntry: a\nfinally: b\n",
        "match x:\n  case [1, *_] if y: z\n  case A(b=1) as c:\n    match = case\n", "def f(a, b: int, /, c=1, *d: *T, e, f=2, **g,): pass\ndef f(a=1, /, b=2, *, c): pass\ndef f(*, a): pass\ndef f(a, /): pass\nlambda a, b=1, /, *c, d, **e: a\n",
        "f(a, *b, c, d=1, *e, f=2, **g, h=3, **i,)\nf(a for a in b if c)\nf(*a)\nf()\nclass A(B, c=1): pass\ndef f[T: int = str, *U = *V, **W](): pass\n",
        "f'{a!r:>{w}} {b[\"k\"]} {{x}} {c=} {d = !s} {e:%Y-%m} {f,} {*g,}'\nf'{a['b']}' 'c' rf'\\d{n}' f'\\N{DIGIT ONE}{x}'\nf'''{\n a # x\n :{b}c}'''\nf'{(lambda x: 1)(2)}{ {1: 2}[1] }{f'{f'{a}'}'}{a!=b}{x:{y:{z}}}'\n",
    ]:
        ast.parse(text)
        assert not flagged("python", text), text


@pytest.mark.parametrize("statement", ["try { }", "foo;", "a + 1;", '"x";', "a.b;", "a[1];", "5;", "null;", "a == b;", "(A) b.c();", "new int[3];", "x -> y;", "A::b;", "a instanceof B;", "a ? b() : c();", "-a;", "for (a; b; c) { }", "for (int i = 0; b; i + 1) { }", "switch (a) { case 1 -> b; }", "int c = switch (a) { case 1: b; };"])
def test_java_that_is_no_statement(statement):
    assert flagged("java", "class A { void m() { " + statement + " } }")


@pytest.mark.parametrize("statement", [
    "try (a) { }", "try { } catch (A | B e) { }", "try { } finally { }", "try { } catch (A e) { } catch (B f) { } finally { }", "a = b = c;", "a.b[1] += 2;", "this.x = 1; super.y = 2;", "++a.b; a[i]--; (a) = 1; --(b);", "a(); a.b().c(1)[2].d(); super.a(); this.<T>b();", "((A) b).c();",
    "new A(1); new A() { void f() { } }; new A<>().b(); a.new B(); new int[]{1}.clone(); new A[3].b();", '"x".isEmpty(); A.class.getName(); int[].class.getName();', "for (i = 0, j++; a; i++, f()) { }", "for (;;) { }", "A<B> c = d -> e + 1; int f, g[] = {1};",
    "switch (a) { case 1, 2 -> b(); case C c when c.d() -> { } default -> throw e; }", "int c = switch (a) { case 1 -> b; case D d -> d + 1; default -> { yield 4; } };", "switch (a) { case 1: case 2: b(); break; default: }", "a >>>= 2; if (b) c++; else d(); x: y();", "f(() -> g(), h -> i, A::b); run(switch (x) { default -> 1; });",
])
def test_java_statements(statement):
    assert not flagged("java", "class A { A() { this(1); } void m() { " + statement + " } }"), statement


@pytest.mark.parametrize("language", ["javascript", "typescript"])
def test_try_needs_a_clause(language):
    assert flagged(language, "try { a() }") and flagged(language, "try { a() }\nb()")
    for text in ["try { a() } catch { }", "try { a() } catch (e) { } finally { }", "try { a() }\nfinally { }\nb()"]:
        assert not flagged(language, text), text


def test_documentation_inherited_over_many_classes_and_around_cycles(spark):
    cols = "id int, project string, symbol_name string, symbol_parent string, parents array<string>, doc string, documented boolean, inherits boolean"
    rows = [(0, "p", "run", "C0", [], "Runs the job until it is done.", True, False)] + [(i, "p", "run", f"C{i}", [f"C{i - 1}", "L1"], "", False, True) for i in range(1, 13)]
    rows += [(21, "p", "run", "L1", ["L2"], "", False, True), (22, "p", "run", "L2", ["L1"], "", False, True)]
    got = {r.id: r.inherited_doc for r in Fn.resolve_inherited(spark.createDataFrame(rows, cols)).collect()}
    assert got == {0: None, 21: None, 22: None} | {i: rows[0][5] for i in range(1, 13)}


def test_body_closed_over_many_open_brackets():
    text = "function f(a) {\n  x = " + "(" * 60 + "\n}\n"
    s = Fn.Source("javascript", text)
    assert s.match[s.tok.index("{")] == s.tok.index("}")
    assert [f[1] for f in Fn.functions("javascript", text)] == ["f"]


def test_documentation_is_not_inherited_from_classes_of_other_languages_or_of_unclear_names(spark):
    cols = "id int, project string, language string, file string, symbol_name string, symbol_parent string, parents array<string>, doc string, documented boolean, inherits boolean"
    doc = "Runs the job until it is done."
    rows = [
        (1, "p", "java", "A.java", "run", "Base", [], doc, True, False), (2, "p", "python", "b.py", "run", "Sub", ["Base"], "", False, True),  # Base exists in Java only
        (3, "p", "java", "C.java", "run", "Own", ["Base"], "", False, True),  # the only Base of the language
        (4, "p", "python", "d.py", "go", "Twice", [], doc, True, False), (5, "p", "python", "e.py", "go", "Twice", [], doc + " e", True, False), (6, "p", "python", "f.py", "go", "G", ["Twice"], "", False, True),  # two files declare Twice
        (7, "p", "python", "e.py", "go", "H", ["Twice"], "", False, True),  # the same file's Twice
    ]
    got = {r.id: r.inherited_doc for r in Fn.resolve_inherited(spark.createDataFrame(rows, cols)).collect() if r.inherited_doc}
    assert got == {3: doc, 7: doc + " e"}
    full = {r.id: r.origin for r in Fn.with_documentation(spark.createDataFrame(rows, cols)).collect()}
    assert full == {1: 1, 3: 1, 4: 4, 5: 5, 7: 5}


def test_pairs_are_judged_by_the_join_alone(spark):
    from treeline.llm.syntax import invalid_texts, lexed, token_facts

    rows = [(b"a", "a.py", "x = = 1\n"), (b"b", "b.py", "x = 1\n"), (b"c", "c.json", "[1 2]")]
    files = spark.createDataFrame(rows, "fk binary, path string, content string")
    facts = {(bytes(r.fk), r.check) for r in token_facts(lexed(files)).collect()}
    assert {(b"a", "pair"), (b"b", "pair"), (b"c", "pair")} <= facts
    got = {(bytes(r.fk), r.reason) for r in invalid_texts(files).collect()}
    assert {(b"a", "pair"), (b"c", "pair")} <= got and not any(k == b"b" for k, _ in got)


def test_nesting_is_judged_by_the_windows(spark):
    from treeline.llm.syntax import lexed, nesting_faults

    texts = ["f(a[1])", "f(a[1)]", "f(", ")(", "f(a))", "", "x = {a: [1, (2)]}", "f(`${g(1)}`)", "f(`${g(1]}`)", "(" * 400 + ")" * 400, "(" * 400 + ")" * 399]
    files = spark.createDataFrame([(bytes([i]), f"{i}.js", t) for i, t in enumerate(texts)] + [(bytes([0]), "0.js", texts[0])], "fk binary, path string, content string")
    got = {r.fk[0] for r in nesting_faults(lexed(files)).collect()}
    assert got == {1, 2, 3, 4, 10}  # the eighth ends inside a template and is lexical


@pytest.mark.parametrize("language", ["python", "javascript", "typescript", "rust", "go", "java", "json", "toml"])
def test_the_windows_find_what_the_reduction_calls_nesting(spark, language):
    """Random cuts of nested texts: wherever the reduction meets brackets that don't match, the windows do too."""
    import random

    from treeline.llm.lexers import EXTENSIONS
    from treeline.llm.syntax import lexed, nesting_faults, read

    r = random.Random(3)
    ext = next(x for x, y in EXTENSIONS.items() if y == language)
    texts = ["".join(r.choice("()[]{}a,;:?=1\n ") for _ in range(r.randrange(1, 30))) for _ in range(150)]
    reasons = [read(language, t)[0] for t in texts]
    files = spark.createDataFrame([(i.to_bytes(2), f"a{ext}", t) for i, t in enumerate(texts)], "fk binary, path string, content string")
    got = {int.from_bytes(x.fk) for x in nesting_faults(lexed(files)).collect()}
    assert {i for i, x in enumerate(reasons) if x == "nesting"} <= got


def test_inheritance_of_empty_tables_and_clashing_columns(spark):
    cols = "id int, project string, language string, file string, symbol_name string, symbol_parent string, parents array<string>, doc string, documented boolean, inherits boolean, origin string, level int, base string"
    none = spark.createDataFrame([], cols)
    assert Fn.resolve_inherited(none.drop("origin", "level", "base")).count() == 0 and Fn.overridden(none).count() == 0
    rows = [(1, "p", "java", "A", "f", "A", [], "d", True, False, "x", 1, "y"), (2, "p", "java", "B", "f", "B", ["A", "A"], None, False, True, "x", 1, "y"), (2, "p", "java", "B", "f", "B", ["A"], None, False, True, "x", 1, "y"), (3, None, None, None, None, None, None, None, None, None, None, None, None)]
    assert {(r.id, r.origin) for r in Fn.overridden(spark.createDataFrame(rows, cols)).collect()} == {(2, 1)}


def test_invalid_texts_of_odd_tables(spark):
    from treeline.llm.syntax import invalid_texts

    rows = [(b"a", "a.py", "x = (", "q", 1), (b"a", "a.py", "x = (", "q", 1), (b"b", "b.json", "[" * 20_000, None, None), (b"c", "c.go", "", None, None)]
    files = spark.createDataFrame(rows, "fk binary, path string, content string, language string, value int")
    assert {bytes(r.fk) for r in invalid_texts(files).collect()} == {b"a", b"b", b"c"}
    assert invalid_texts(files.limit(0)).count() == 0
