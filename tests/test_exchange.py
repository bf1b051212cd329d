"""Exports and imports, SQLite, listings, git paths, cursors, and rules that the test tables have no rows for."""

from __future__ import annotations

import sqlite3
import subprocess

import pytest
from pyspark.sql import functions as F

from treeline.functions import cursor as C
from treeline.functions import facts as X
from treeline.functions import languages as L
from treeline.functions import paths as P
from treeline.functions import text as T
from treeline.operators import graph as G
from treeline.operators import ranking as R
from treeline.operators import usage as U
from treeline.operators.changes import replace_paths
from treeline.operators.search import bounded, page
from treeline.plans import predicates as Q
from treeline.plans.exchange import trigram_candidates, trigram_index
from treeline.plans.resolution import local_matches
from treeline.sources import exchange as E
from treeline.sources.files import ignore_rules, ignored


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_export_and_import(spark, tmp_path):
    t = {"a": spark.createDataFrame([(1, "x"), (2, None), (2, None)], "n bigint, s string"), "b": spark.createDataFrame([], "k string")}
    folder = str(tmp_path / "x")
    E.export_tables(t, folder, "s1")
    back = E.import_tables(spark, folder, "s1")
    assert sorted(map(tuple, back["a"].collect()), key=str) == [(1, "x"), (2, None), (2, None)] and back["b"].count() == 0
    with pytest.raises(ValueError):
        E.import_tables(spark, folder, "s2")
    t["a"].limit(2).write.mode("overwrite").parquet(folder + "/a")
    with pytest.raises(ValueError):
        E.import_tables(spark, folder, "s1")
    assert E.table_digest(t["a"]) == E.table_digest(t["a"].orderBy(F.desc("n")).repartition(3)) != E.table_digest(t["a"].distinct())


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(i, None if i % 5 == 0 else f"v{i}") for i in range(100)])
        con.execute("CREATE TABLE e (a INTEGER)")
    rows = {tuple(r) for r in E.read_sqlite(spark, path, "t", "a bigint, b string", 4).collect()}
    assert rows == {(i, None if i % 5 == 0 else f"v{i}") for i in range(100)} and E.read_sqlite(spark, path, "e", "a bigint").count() == 0
    with pytest.raises(ValueError):
        E.read_sqlite(spark, path, "t; DROP", "a bigint")


def test_listings():
    rows = [{"path": "a,b.md", "purpose": 'says "x"'}, {"path": "c", "purpose": "plain"}]
    lines = E.write_listing("files", rows, ["path", "purpose"])
    assert E.read_listing(lines, ["path"]) == (rows, [])
    assert E.read_listing(["files[2]{path}:", "  a", "  b,c"], ["path", "purpose"])[1] == ["line 1: no column purpose", "line 3: not a row", "2 rows announced, 1 read"]
    assert E.read_listing([], ["path"]) == ([], [])


def test_changed_paths(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a").write_text("1")
    git("add", "a")
    git("commit", "-qm", "one")
    (tmp_path / "a").write_text("2")
    (tmp_path / "b c").write_text("3")
    assert E.changed_paths(str(tmp_path)) == ["a", "b c"]
    git("add", "-A")
    git("commit", "-qm", "two")
    assert E.changed_paths(str(tmp_path), "HEAD~1", "HEAD") == ["a", "b c"] and E.changed_paths(str(tmp_path)) == []
    assert E.changed_paths(str(tmp_path), "--output=x") is None and E.changed_paths(str(tmp_path), "nope") is None and E.changed_paths("/nowhere") is None


def test_poll(spark):
    a = spark.createDataFrame([("x", "file", 1, "h"), ("y", "file", 1, "h")], "path string, kind string, size_bytes int, content_hash string")
    b = spark.createDataFrame([("x", "file", 1, "g"), ("z", "file", None, None)], a.schema)
    assert {tuple(r) for r in E.poll(a, b).collect()} == {("x", "modified"), ("y", "removed"), ("z", "added")}


def test_cursors():
    b = {"project": "p", "generation": 3, "query": "é"}
    cur = C.encode_cursor(b, ["src/a", 5, None])
    assert C.decode_cursor(b, cur) == ["src/a", 5, None]
    for other, text in ((b | {"generation": 4}, cur), (b, cur[:-3] + "AAA"), (b, "?"), (b, "")):
        with pytest.raises(C.StaleCursor):
            C.decode_cursor(other, text)


def test_languages(spark):
    """Expected values are the published ones, written by hand."""
    paths = ["a/Cargo.toml", "cargo.toml", "build.rs", "x.d.ts", "x.TSX", "q.R", "s.sql", "Makefile", "makefile", "p.properties", "n", ".py", None, "a.b/c.hh", "w.foo"]
    language = column(spark, paths, lambda c: L.detect_language(c, extra={".foo": "foo"})[0])
    assert language == ["cargo-manifest", "toml", "rust-build-script", "typescript", "tsx", "r", "sql", "makefile", None, "config", None, None, None, "hpp", "foo"]
    assert column(spark, paths[:5], lambda c: L.detect_language(c, {".ts": "x", ".d.ts": "y", "cargo.toml": "z"})[1]) == ["filename", "override", "filename", "override", "extension"]
    assert column(spark, ["rust", "markdown", "cargo-lock", "text", "config", None, "nosuch"], lambda c: L.content_class(c, F.lit(True))) == ["source", "documentation", "configuration_data", "other_text", "configuration_data", "other_text", "other_text"]
    assert column(spark, ["rust", None], lambda c: L.content_class(c, F.lit(False))) == ["source", "opaque"]
    with pytest.raises(ValueError):
        L.selected(F.lit("source"), "all")


def test_facts(spark):
    calls = ['os.getenv("HOME")', "env::var('A_1')", 'getenv("lower")', 'x.getenv("A")', 'read_to_string("a\\\\b")', "f(`x`)", 'f("${a}")', "f( 'b' , 1)", 'f("")', "f()"]
    assert column(spark, calls, X.static_argument) == ["HOME", "A_1", "lower", "A", None, None, None, "b", "", None]
    target = lambda c: F.regexp_extract(c, r"^([\w.:]+)", 1)
    assert column(spark, calls[:4], lambda c: X.environment_key(target(c), c)) == ["HOME", "A_1", None, None]
    assert column(spark, ["fs.readFileSync", "File::open", "io::write", "std::fs::File::create", "reader"], X.data_access) == ["reads", "reads", "writes", "writes", None]
    assert column(spark, ["./a/../b.txt", "../x", "/etc", "~/x", "a/${b}", "http://x/y", "c:/x", "a b/c", ""], X.static_path) == ["b.txt", None, None, None, None, None, None, "a b/c", None]
    routes = ['app.route("/a", handler)', 'route("/a", own)', 'route("a", h)', 'route("/a", h, g)', 'map_get("/x", m::h);', 'route("/a", 1h)']
    assert column(spark, routes, lambda c: X.route_handler(target(c), c, F.lit("own"))) == ["handler", None, None, None, "m::h", None]
    assert column(spark, [".env.local", "x/settings.yml", "config.py"], X.config_identity) == ["dotenv", "application-config", None]
    assert column(spark, ["a.tf", "b.tf.json", "Dockerfile.dev", "k8s/x.yaml", "x.bicep", "my-cloudformation.yml", "playbook.yml", "Chart.yaml", "tf"], X.deploy_platform) == ["terraform", "terraform", "containers", "kubernetes", "azure-bicep", "cloudformation", "ansible", "kubernetes", None]
    assert column(spark, ["a::b.c", "a.b::c", "a", "x.", None], lambda c: F.concat_ws("|", *X.qualified_parts(c))) == ["a::b|c", "a.b|c", "", "x|", ""]
    assert column(spark, ["src/a/mod.rs", "lib.rs", "src/x/index.ts", "a/b.py", "README.md"], X.module_aliases) == [["a"], [], ["x"], ["a.b", "a::b", "b"], ["README.md"]]
    assert column(spark, ["HEAD~1", "-x", "a..b", "", None, "a b"], X.valid_revision) == [True, False, False, False, False, False]
    assert column(spark, [".", "a/.gitignore", "tsconfig.json", ".git/info/exclude", "a/b"], X.requires_full_scan) == [True, True, True, True, False]
    assert column(spark, [".", "a//b", "./a", "a/../b", "a/b"], X.watch_admitted) == [True, False, False, False, True]
    assert column(spark, ["x, 12 bytes.", "x, 12 bytes", "12 bytes", "x, a bytes", None], X.fallback_summary) == [True, True, False, False, False]
    assert column(spark, ["tests/a.py", "a/__tests__/b", "x.spec.ts", "a_test.go", "test_x.py", "Test/q", "attest.py", "test_x"], Q.graph_test_path) == [True, True, True, True, True, True, False, False]


def test_ignore_rules_hold_below_excluded_folders(spark):
    rules = ignore_rules(["build", "!build/keep.js", "*.log", "!important.log", "/top", "dir/", "# x", "", "\\#y"])
    paths = ["build/keep.js", "a/build/x/y", "x.log", "important.log", "top", "a/top", "dir/f", "dir", "#y", "a"]
    assert column(spark, paths, lambda c: ignored(c, rules)) == [True, True, True, False, True, False, True, False, True, False]


def test_fuzzy_on_long_lines(spark):
    line = "ab" * 50_000
    assert column(spark, [line, line + "c", "xcax", "c-a"], lambda c: T.fuzzy(c, "ac")) == [False, True, False, False]
    assert column(spark, ["a.b^c", "]x[", "-&"], lambda c: T.fuzzy(c, "^c")) == [True, False, False] and column(spark, ["]x["], lambda c: T.fuzzy(c, "][")) == [True]


def test_pages_and_bounds(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)], "k string, n int")
    assert [r.n for r in page(df, ["k", "n"], 3, after=("a", 4)).orderBy("n").collect()] == [5, 6, 7]
    rows = bounded(df, F.col("n") * 10, ["n"], 6, 100, ["k"]).orderBy("n").collect()
    assert [r.reason for r in rows] == [None] * 5 + ["bytes"] + ["files"] * 4


def test_ways(spark):
    e = spark.createDataFrame([("p", a, b) for a, b in ("ab", "ac", "bd", "cd", "de", "xa")], "pid string, src string, dst string")
    seen = G.bounded_bfs(e, spark.createDataFrame([("p", "a")], "pid string, node string"))
    got = {(r.target, r.step, r.node) for r in G.paths_back(e, seen, spark.createDataFrame([("p", "e"), ("p", "a"), ("p", "zz")], "pid string, target string")).collect()}
    assert got == {("e", 3, "e"), ("e", 2, "d"), ("e", 1, "b"), ("e", 0, "a"), ("a", 0, "a")}


def test_components_of_a_chain_and_a_star(spark):
    n = 120
    edges = [("c", f"n{i:04}", f"n{i + 1:04}") for i in range(n)] + [("s", "hub", f"leaf{i}") for i in range(n)]
    nodes = [("c", f"n{i:04}") for i in range(n + 1)] + [("s", f"leaf{i}") for i in range(n)] + [("s", "hub"), ("t", "alone")]
    got = {(r.pid, r.component) for r in G.weak_components(spark.createDataFrame(nodes, "pid string, node string"), spark.createDataFrame(edges, "pid string, src string, dst string")).collect()}
    assert got == {("c", "n0000"), ("s", "hub"), ("t", "alone")}


def test_medians_clocks_and_instances(spark):
    import statistics

    data = {"a": [3.0], "b": [1.0, 1.0, 1.0, 9.0], "c": [float(i % 7) for i in range(50)], "d": [5.0, 1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None), ("e", None)], "k string, v double")
    assert {r.k: r.median for r in U.exact_median(df, ["k"], "v", buckets=4).collect()} == {k: statistics.median(v) for k, v in data.items()}
    seen = U.greatest_before(spark.createDataFrame([("p", 1, 5), ("p", 2, 3), ("p", 9, 9), ("q", 1, 1)], "s string, o int, v int"), "s", "o", "v", piece=2)
    assert {(r.s, r.o, r.before) for r in seen.collect()} == {("p", 1, None), ("p", 2, 5), ("p", 9, 5), ("q", 1, None)}
    ev = spark.createDataFrame([("o", 0), ("o", 90_000), ("o", 176_399), ("o", 262_799), ("p", 5)], "owner string, at bigint")
    assert {(r.owner, r.started, r.last_seen, r.events) for r in U.instances(ev).collect()} == {("o", 0, 0, 1), ("o", 90_000, 176_399, 2), ("o", 262_799, 262_799, 1), ("p", 5, 5, 1)}


def test_replaced_paths(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "path string, v int")
    new = spark.createDataFrame([("a", 9), ("c", 8)], "path string, v int")
    assert {tuple(r) for r in replace_paths(t, new, spark.createDataFrame([("a",), ("d",)], "path string"), ["path"]).collect()} == {("a", 9), ("b", 3)}


def test_local_declarations(spark):
    e = spark.createDataFrame([("p", k, "symbol", "a.py", n, par) for k, n, par in (("1", "run", None), ("2", "run", "A"), ("3", "go", "B"), ("4", "go", "A"))], "pid string, k string, kind string, path string, name string, symbol_parent string")
    f = spark.createDataFrame([("p", "r1", "calls", "a.py", "A", None, "run"), ("p", "r2", "contains", "a.py", "A", None, "run"), ("p", "r3", "calls", "a.py", "m", "B", "go"), ("p", "r4", "imports", "a.py", "A", None, "run"), ("p", "r5", "calls", "b.py", "A", None, "run")], "pid string, rk string, kind string, path string, caller string, caller_parent string, leaf string")
    assert {(r.rk, r.target) for r in local_matches(f, e).collect()} == {("r1", "1"), ("r1", "2"), ("r2", "2"), ("r3", "3")}


def test_anchors(spark):
    e = spark.createDataFrame([("p", "1", "symbol", "a", "close", "method", "A", "s"), ("p", "2", "symbol", "a", "close", "function", None, "s"), ("p", "3", "file", "a", None, None, None, None)], "pid string, k string, kind string, path string, name string, symbol_kind string, symbol_parent string, signature string")
    assert {r.k for r in Q.match_anchor(e, name="close").collect()} == {"1", "2"} and {r.k for r in Q.match_anchor(e, name="close", parent="A").collect()} == {"1"} and {r.k for r in Q.match_anchor(e, path="a").collect()} == {"3"}


def test_evidence(spark):
    rows = [("p", "src/cache.py", "keeps the cache", True, None, "Cache", True, True, 3, 2), ("p", "cache", None, None, None, None, None, None, None, None), ("p", "q/cache", "cache", False, "a cache", None, False, False, 0, 0), ("p", "z", None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "pid string, path string, purpose string, agent_reviewed boolean, summary string, symbol string, text_hit boolean, paired boolean, families int, matches int")
    got = {r.path: r for r in R.score_files(df, "cache").collect()}
    assert got["src/cache.py"].score == 40 + 35 + 15 + 10 + 32 and got["src/cache.py"].reviewed and got["src/cache.py"].codes == ["path", "reviewed_purpose", "symbol", "indexed_text", "paired_file", "graph"]
    assert got["cache"].exact_path and got["cache"].exact_name and got["cache"].score == 0 and got["q/cache"].exact_name and got["q/cache"].score == 60 and not got["q/cache"].reviewed and got["z"].score == 0
    assert [r.path for r in R.ranked(R.score_files(df, "cache"), 3).orderBy("rank").collect()] == ["cache", "q/cache", "src/cache.py"]
    assert R.query_terms("B a_b É") == ["a", "b", "é"] and [R.candidate_target(q, n) for q, n in (("x", 10), ("x", 50), ("", 7), ("x", 200))] == [30, 100, 7, 200]


def test_trigrams_lose_nothing(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["The Ledger", "led ger", "edgeled dger", "x", "", None, "ledgerledger"])], "i int, t string")
    index = trigram_index(rows, ["i"], "t")
    assert {r.i for r in trigram_candidates(index, ["i"], "ledger").collect()} >= {0, 6} and 3 not in {r.i for r in index.collect()}


def test_valid_keys_of_odd_paths(spark):
    assert column(spark, ["", ".", "a\\b"], P.valid_key) == [False, True, True]


def test_overfull_batches_ask_for_a_full_scan(spark):
    import datetime as dt

    from treeline.streaming.usage import change_sets

    day = dt.datetime(2025, 1, 1)
    ev = spark.createDataFrame([(day, "p", f"f{i}", "write") for i in range(4)] + [(day, "q", "g", "write")], "ts timestamp, project string, path string, action string")
    assert sorted((r.project, r.paths, r.full_scan) for r in change_sets(ev, queue=3).collect()) == [("p", [], True), ("q", ["g"], False)]


def test_hydration_and_revalidation(spark, tmp_path):
    from treeline.operators.changes import Generations

    t = {"a": spark.createDataFrame([("x", 1)], "k string, v int")}
    E.export_tables(t, str(tmp_path / "e"), "s")
    assert E.hydrate(spark, str(tmp_path / "e"), str(tmp_path / "g"), "s") == 1
    g = Generations(spark, str(tmp_path / "g"))
    with pytest.raises(RuntimeError):
        g.publish(t, still_true=lambda: False)
    assert g.active() == 1 and g.read("a").count() == 1 and g.publish(t, still_true=lambda: True) == 2


def test_graph_operators_on_empty_tables_nulls_and_repeated_rows(spark):
    edge, node = "pid string, src string, dst string", "pid string, node string"
    none_e, none_n = spark.createDataFrame([], edge), spark.createDataFrame([], node)
    assert G.weak_components(none_n, none_e).count() == G.strong_components(none_n, none_e).count() == G.bounded_bfs(none_e, none_n).count() == G.degrees(none_n, none_e).count() == 0
    v = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b")], node)
    assert {(r.node, r.component) for r in G.weak_components(v, none_e).collect()} == {("a", "a"), ("b", "b")} == {(r.node, r.component) for r in G.strong_components(v, none_e).collect()}
    e = spark.createDataFrame([("p", "a", "b"), ("p", "a", "b"), ("p", None, "b"), ("p", "a", None), ("p", "b", "b")], edge).withColumn("component", F.lit("x")).withColumn("hops", F.lit(9))
    assert {(r.node, r.component) for r in G.weak_components(v, e).collect()} == {("a", "a"), ("b", "a")} and {(r.node, r.component) for r in G.strong_components(v, e).collect()} == {("a", "a"), ("b", "b")}
    assert {(r.node, r.hops) for r in G.bounded_bfs(e, spark.createDataFrame([("p", "a")], node)).collect()} == {("a", 0), ("b", 1)}


def test_usage_operators_on_empty_tables(spark):
    e = spark.createDataFrame([], "event_id bigint, owner string, at bigint, s string, v double, bytes bigint")
    assert U.instances(e).count() == U.exact_median(e, ["s"], "v").count() == U.prune_plan(e, 0, 1, 1, 1).count() == U.greatest_before(e, "s", "event_id", "at").count() == 0


def test_symbols_of_null_empty_long_and_repeated_texts(spark):
    from treeline.operators import symbols as S

    rows = [("a.py", "def f(): pass\n"), ("a.py", "def f(): pass\n"), ("b.py", ""), ("c.py", None), (None, "x"), ("d.js", "function g() {" + " x();" * 50_000 + "}"), ("e.zzz", "x")]
    df = spark.createDataFrame(rows, "path string, content string").withColumn("symbols", F.lit("clash")).withColumn("language", F.lit(None).cast("int"))
    got = sorted((r.path, r.language, len(r.symbols), len(r.relations)) for r in S.symbol_graphs(df, ["path"]).collect())
    assert got == [("a.py", "python", 1, 0), ("a.py", "python", 1, 0), ("b.py", "python", 0, 0), ("d.js", "javascript", 1, 50_000)]
    assert S.symbol_graphs(df.limit(0), ["path"]).count() == S.describe(df.limit(0), ["path"]).count() == 0
