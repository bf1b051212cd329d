"""Symbols, calls and imports against fixtures, and against the stored entities of the index."""

from __future__ import annotations

import pytest

from treeline.operators import symbols as S

CASES = {
    "python": (
        "import os.path as p\nfrom .a import b as c, d\n\nclass A(B):\n    @x.y\n    def run(self, n):\n        s = 'def no(): pass'\n        return self.go(n) + len(s)\n\nasync def main():\n    A().run(1)\n",
        {("A", "class", None, 4, 8), ("run", "method", "A", 6, 8), ("main", "function", None, 10, 11)}, {("run", "self.go"), ("run", "len"), ("main", "A")}, {("os.path", None, "p"), (".a", "b", "c"), (".a", "d", "d")},
    ),
    "typescript": (
        "import q, { a as b, type T } from './m';\nimport * as n from \"x\";\n// function no() {}\nexport class C extends D {\n  private f(x: number): void {\n    if (x) { b('g()'); }\n  }\n}\nexport const h = async (y) => {\n  return new C().f(y);\n};\nfunction k() { n.z(`s(${1})`) }\n",
        {("C", "class", None, 4, 8), ("f", "method", "C", 5, 7), ("h", "function", None, 9, 11), ("k", "function", None, 12, 12)}, {("f", "b"), ("h", "C"), ("h", "f"), ("k", "n.z")}, {("./m", "default", "q"), ("./m", "a", "b"), ("./m", "T", "T"), ("x", "*", "n")},
    ),
    "rust": (
        "use std::{fs, io::{self, Read as R}};\npub struct S { a: u8 }\nimpl<T> Tr for S {\n    fn f(&self) -> u8 {\n        g::<u8>(\"fn no() {\");\n        self.a.max(1)\n    }\n}\n#[cfg(test)]\nmod t {\n    fn u() { println!(\"x\") }\n}\n",
        {("S", "struct", None, 2, 2), ("S", "impl", None, 3, 8), ("f", "method", "S", 4, 7), ("t", "module", None, 10, 12), ("u", "function", None, 11, 11)}, {("f", "g"), ("f", "self.a.max"), ("u", "println!")}, {("std", "fs", "fs"), ("std::io", None, "io"), ("std::io", "Read", "R")},
    ),
    "go": (
        "package a\n\nimport (\n\t\"fmt\"\n\tx \"b/c\"\n)\n\ntype S struct {\n\tn int\n}\n\nfunc (s *S) Run(k int) error {\n\treturn fmt.Errorf(\"a(%d)\", k)\n}\n\nfunc Main() { x.Go() }\n",
        {("S", "struct", None, 8, 10), ("Run", "method", "S", 12, 14), ("Main", "function", None, 16, 16)}, {("Run", "fmt.Errorf"), ("Main", "x.Go")}, {("fmt", None, "fmt"), ("b/c", None, "x")},
    ),
    "java": (
        "import java.util.List;\nimport static a.B.*;\n\npublic class C implements D {\n    @Override\n    public List<String> run(int n) throws E {\n        if (n > 0) { return go(n); }\n        return null;\n    }\n    C() { this.x = new F(); }\n}\n",
        {("C", "class", None, 4, 11), ("run", "method", "C", 6, 9), ("C", "method", "C", 10, 10)}, {("run", "go"), ("C", "F")}, {("java.util", "List", "List"), ("a.B", "*", "*")},
    ),
}


@pytest.mark.parametrize("language", CASES)
def test_sources(language):
    text, symbols, calls, imports = CASES[language]
    _, got, relations, found = S.read_source(language, text)
    assert {(s.name, s.kind, s.parent, s.first, s.last) for s in got} == symbols
    assert {(s, t) for s, k, t, _ in relations if k == "calls"} == calls
    assert {x[:3] for x in found} == imports
    if language == "python":
        assert {x[:3] for x in S.parse_imports("python", text)} == imports


def test_damaged_and_empty_sources():
    assert [s.name for s in S.read_source("python", "def f(:\n  class G: pass\n")[1]] == ["f", "G"]
    for language in (*CASES, "cargo-manifest", "json", "toml"):
        assert S.read_source(language, "")[1:] == ([], [], [])
        S.read_source(language, "{" * 3000 + '"\\' + "(" * 100 + "\x00")
    assert S.read_source("markdown", "# x")[0] == "none"


def test_manifests():
    text = '[package]\nname = "a"\nversion = "1"\n[dependencies]\nb = "2"\nc = { path = "../c" }\n[dev-dependencies]\nd = "1"\n'
    _, symbols, uses, _ = S.read_source("cargo-manifest", text)
    assert [s.name for s in symbols] == ["a"] and {(x, t) for x, _, t, _ in uses} == {("a", "b"), ("a", "c"), ("a", "d")}
    lock = '[[package]]\nname = "a"\nversion = "1"\ndependencies = ["b 1.0"]\n[[package]]\nname = "b"\n'
    assert S.read_source("cargo-lock", lock)[2] == [("a", "depends-on", "b", 1)]
    assert S.read_source("json", '{"name": "w", "dependencies": {"x": "^1"}}')[2] == [("w", "depends-on", "x", 1)]
    assert S.manifest("json", "[1") == ([], []) == S.manifest("cargo-manifest", "= 1")


def test_summaries():
    assert S.structural_summary("markdown", "# A\n```\n# no\n```\n## B\n") == "Markdown document with 2 headings: A, B"
    assert S.structural_summary("json", '{"a": 1, "b": 2}') == "JSON object with keys a, b" and S.structural_summary("json", "{") == "JSON that cannot be read"
    assert S.structural_summary("toml", "[a]\nx = 1\n[b.c]\n") == "TOML with tables a, b.c" and S.structural_summary("python", "x") is None and S.structural_summary("css", " ") is None
    assert S.leading_documentation("python", '# c\n"""Reads  it\nall."""\n') == "Reads it all." and S.leading_documentation("rust", "//! One\n//! two\nfn f() {}") == "One two" and S.leading_documentation("go", "package a") is None


def test_stored_entities_are_found_in_the_texts(spark):
    """Symbols that the index holds for files whose text is the current one must be declared in it by name and parent."""
    from treeline.plans.index_tables import entities, latest_states, nodes
    from treeline.plans.symbols import s280_symbols

    root = "/root/testdata/sf0.01"
    fresh = nodes(spark, root).where("exists_now").join(latest_states(spark, root).select("pid", "path", "content_hash"), ["pid", "path", "content_hash"], "left_semi").select("pid", "path")
    want = entities(spark, root).where("kind = 'symbol'").join(fresh, ["pid", "path"]).select("pid", "path", "name", "symbol_parent").distinct()
    got = s280_symbols(spark, root).where("kind <> 'impl'").select("pid", "path", "name", "parent").distinct()
    missing = want.join(got, (want.pid == got.pid) & (want.path == got.path) & (want.name == got.name) & want.symbol_parent.eqNullSafe(got.parent), "left_anti").count()
    assert missing <= 0.05 * want.count()


def test_scripts_inside_pages():
    page = "<template><a>f(1)</a></template>\n<script lang=\"ts\">\nimport q from 'q'\nexport function f(x: number) {\n  g(x)\n}\n</script>\n<style>a{b:c}</style>\n"
    kind, symbols, relations, imports = S.read_source("vue", page)
    assert kind == "embedded" and [(s.name, s.first, s.last) for s in symbols] == [("f", 4, 6)] and ("f", "calls", "g", 5) in relations and imports == [("q", "default", "q", 3)]
    assert [s.name for s in S.read_source("astro", "---\nfunction h() { }\n---\n<p/>")[1]] == ["h"] and S.read_source("html", "<p>x</p>")[1:] == ([], [], [])


def test_a_tree_is_staged_and_published_as_one_version(spark, tmp_path):
    from treeline.operators.changes import Generations
    from treeline.sources.files import ignore_rules, map_lines, stage

    src = tmp_path / "src"
    (src / "pkg").mkdir(parents=True)
    (src / "pkg/a.py").write_text('"""Opens files."""\nimport os\n\ndef run():\n    os.getcwd()\n')
    (src / "README.md").write_text("# Title\n")
    (src / "x.bin").write_bytes(b"\xff\x00")
    (src / "pkg/b.log").write_text("x")
    tables = stage(spark, str(src), rules=ignore_rules(["*.log"]))
    g = Generations(spark, str(tmp_path / "index"))
    assert g.publish(tables) == 1
    nodes = {r.path: (r.kind, r.language, r.content_class) for r in g.read("nodes").collect()}
    assert nodes == {".": ("folder", None, None), "pkg": ("folder", None, None), "pkg/a.py": ("file", "python", "source"), "README.md": ("file", "markdown", "documentation"), "x.bin": ("file", None, "opaque")}
    assert [(r.path, r.name) for r in g.read("symbols").collect()] == [("pkg/a.py", "run")] and {(r.kind, r.target) for r in g.read("relations").collect()} == {("calls", "os.getcwd"), ("imports", "os")}
    assert {(r.path, r.summary, r.documentation) for r in g.read("summaries").collect()} == {("README.md", "Markdown document with 1 headings: Title", None), ("pkg/a.py", None, "Opens files.")}
    assert {r.line for r in map_lines(g.read("nodes").where("kind = 'folder'"), ["kind", "language"]).collect()} == {'{"path":".","kind":"folder"}', '{"path":"pkg","kind":"folder"}'}


def test_watched_files_and_artifacts(spark, tmp_path):
    from treeline.sources.files import read_artifacts, watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"name": "x", "value": 2}')
    (tmp_path / "in/b.json").write_text("[")
    (tmp_path / "in/c.json").write_text('{"name": "' + "y" * 100 + '"}')
    got = {r.path.rsplit("/", 1)[-1]: (r.outcome, r.name, r.value) for r in read_artifacts(spark, str(tmp_path / "in"), "name string, value int", limit=60).collect()}
    assert got == {"a.json": ("read", "x", 2), "b.json": ("not_json", None, None), "c.json": ("too_large", None, None)}
    q = watch(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("watched").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert {r.path for r in spark.table("watched").collect()} == {"a.json", "b.json", "c.json"}


def test_calibration(spark):
    import os

    from treeline.operators.usage import calibration

    file = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(file):
        pytest.skip("no vocabulary here")
    t = spark.createDataFrame([("hello world",), ("",), (None,)], "content string")
    r = calibration(t, file, r"\s+|\S+").first()
    assert (r.texts, r.byte_tokens) == (2, 3) and r.tokens > 0 and r.ratio == 3 / r.tokens
    assert calibration(t.limit(0), file, r"\S+").first().ratio is None
