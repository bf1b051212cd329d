"""Functions, sources, search, graph, usage and publication on small inputs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T
from treeline.operators import extract as X
from treeline.operators import graph as G
from treeline.operators import usage as U
from treeline.operators.changes import Generations, delta, replace_scan, upsert
from treeline.operators.search import SearchError, page, search_lines
from treeline.sources.files import git_paths, ignore_rules, ignored, read_texts, scan_tree
from treeline.streaming.usage import EVENT_SCHEMA, change_sets, fold_usage, read_events


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_paths(spark):
    assert column(spark, ["./a\\b/", "", "x", None], P.normalize) == ["a/b", ".", "x", None]
    assert column(spark, ["a/b.TS", ".gitignore", "a.b/c"], P.extension) == [".ts", "", ""]
    assert column(spark, ["a/b/c", "a", "."], P.ancestors) == [["a/b/c", "a/b", "a", "."], ["a", "."], ["."]]
    assert column(spark, ["../x.py", "./y", "../../../z", "/abs", "http://h", "b/../c"], lambda c: P.resolve_relative(F.lit("a/b"), c)) == ["a/x.py", "a/b/y", None, None, None, "a/b/c"]
    assert column(spark, ["a", "/a", "C:/a", "a/../b", None], P.valid_key) == [True, False, False, False, None]


@pytest.mark.parametrize(("glob", "hit", "miss"), [("src/**/*.py", ["src/a.py", "src/x/y.py"], ["a.py", "src/a.ts", "xsrc/a.py"]), ("*.rs", ["a.rs", "q/a.rs"], ["a.rsx"]), ("a/{b,c}/[xy]?", ["a/b/x1", "a/c/yz"], ["a/d/x1", "a/b/x"])])
def test_globs(spark, glob, hit, miss):
    assert column(spark, [*hit, *miss], lambda c: P.matches_glob(c, glob)) == [True] * len(hit) + [False] * len(miss)


def test_lines_and_estimates(spark):
    v = ["", "a", "a\n", "a\r\n\nb", None]
    assert column(spark, v, T.lines) == [[], ["a"], ["a"], ["a", "", "b"], None]
    assert column(spark, v, T.line_count) == [0, 1, 1, 3, None]
    assert column(spark, ["", "abcde", "日本語です"], T.token_estimate) == [0, 2, 2]
    assert column(spark, ["a\nb\nc", "a"], lambda c: T.code_slice(c, 2, 9)) == ["b\nc", None]
    assert column(spark, ["std::io/read!", "", "x"], T.call_leaf) == ["read", None, "x"]


def test_search(spark):
    t = spark.createDataFrame([("p", "one\ntwo Two\nthree"), ("q", ""), ("r", None), ("s", "x" * 200_000 + "\ntwo")], "path string, content string")
    got = {(r.path, r.line_no): (r.before, r.after) for r in search_lines(t, ["path"], "two", context=1).collect()}
    assert got[("p", 2)] == (["one"], ["three"]) and ("s", 2) in got and len(got) == 2
    assert search_lines(t, ["path"], "t.o", regex=True).count() == 2
    assert [r.line for r in search_lines(t, ["path"], "hee", fuzzy=True).collect()] == ["three"]
    with pytest.raises(SearchError):
        search_lines(t, ["path"], "x", regex=True, fuzzy=True)
    with pytest.raises(SearchError):
        page(t, ["path"], 0)


def test_sets_and_generations(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", None), ("z", 3)], "k string, v int")
    b = spark.createDataFrame([("y", None), ("z", 4), ("w", None)], "k string, v int")
    assert {tuple(r) for r in delta(a, b, ["k"], ["v"]).collect()} == {("x", "removed"), ("z", "modified"), ("w", "added")}
    assert {tuple(r) for r in upsert(a, b, ["k"]).collect()} == {("x", 1), ("y", None), ("z", 4), ("w", None)}
    kept = replace_scan(a.withColumn("note", F.lit("n")), b, ["k"], ["note"])
    assert {(r.k, r.v, r.note, r.exists_now) for r in kept.collect()} == {("x", 1, "n", False), ("y", None, "n", True), ("z", 4, "n", True), ("w", None, None, True)}
    g = Generations(spark, str(tmp_path))
    assert g.publish({"t": a}) == 1
    assert g.publish({"t": b}) == 2
    assert {r.k for r in g.read("t").collect()} == {"y", "z", "w"}
    with pytest.raises(RuntimeError):
        g.publish({"t": a}, expect=1)
    assert g.active() == 2


def test_graph(spark):
    e = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "c", "d"), ("p", "e", "e"), ("p", "d", None), ("q", "a", "z")], "pid string, src string, dst string")
    v = spark.createDataFrame([("p", x) for x in "abcdef"] + [("q", "a"), ("q", "z")], "pid string, node string")
    weak = {(r.pid, r.node): r.component for r in G.weak_components(v, e).collect()}
    assert weak == {("p", "a"): "a", ("p", "b"): "a", ("p", "c"): "a", ("p", "d"): "a", ("p", "e"): "e", ("p", "f"): "f", ("q", "a"): "a", ("q", "z"): "a"}
    strong = G.strong_components(v, e)
    assert {(r.pid, r.node): r.component for r in strong.collect()} == {("p", "a"): "a", ("p", "b"): "a", ("p", "c"): "a", ("p", "d"): "d", ("p", "e"): "e", ("p", "f"): "f", ("q", "a"): "a", ("q", "z"): "z"}
    assert {tuple(r) for r in G.cycles(strong, e).collect()} == {("p", "a", 3), ("p", "e", 1)}
    hops = {(r.node): r.hops for r in G.bounded_bfs(e, spark.createDataFrame([("p", "a")], "pid string, node string"), 2).collect()}
    assert hops == {"a": 0, "b": 1, "c": 2}
    assert {r.node: r.degree for r in G.degrees(v, e).collect() if r.pid == "p"} == {"a": 2, "b": 2, "c": 3, "d": 1, "e": 2, "f": 0}


def test_resolution(spark):
    x = spark.createDataFrame([("k", "t1"), ("k", "t1"), ("m", "t2"), ("m", "t1"), (None, "t9")], "key string, target string")
    d = spark.createDataFrame([(1, "k"), (2, "m"), (3, "n"), (4, None)], "id int, key string")
    assert {(r.id, r.candidates, r.target, r.status) for r in G.resolve(d, x, ["key"]).collect()} == {(1, 1, "t1", "resolved"), (2, 2, "t1", "ambiguous"), (3, 0, None, "unresolved"), (4, 0, None, "unresolved")}


def test_usage(spark):
    e = spark.createDataFrame([(1, "s", "i", "f", 100, 10, "session"), (2, "s", "i", "f", 80, 10, "session"), (3, "s", "i", "f", 50, 5, "event")], "event_id int, session string, identity string, fingerprint string, without_tokens bigint, with_tokens bigint, scope string")
    assert tuple(U.session_accounting(e, []).first()) == (150, 25, 125, 1, 3)
    big = spark.createDataFrame([(2**62,)] * 4, "v bigint")
    assert big.agg(U.wide_sum("v").alias("s")).first()[0] == U.MAX_BIGINT
    runs = spark.createDataFrame([("o", 0, 1), ("o", 10, 2), ("o", 10 + U.IDLE, 3)], "owner string, at bigint, event_id int")
    assert {(r.started, r.events) for r in U.instances(runs).collect()} == {(0, 2), (10 + U.IDLE, 1)}
    assert U.bucket_totals(e.limit(0), ["session"]).count() == 0


def test_extractors(spark):
    t = spark.createDataFrame([("a/b.md", "# One Two!\n```\n# no\n```\n## Three\n[x](../c.md#y) [x](../c.md#y) [u](http://h) [r](../../../z)")], "path string, content string")
    assert [(r.line_no, r.level, r.slug) for r in X.headings(t, ["path"]).orderBy("line_no").collect()] == [(1, 1, "one-two"), (5, 2, "three")]
    assert {(r.target, r.file, r.reason) for r in X.link_targets(X.links(t, ["path"])).collect()} == {("../c.md#y", "c.md", None), ("http://h", None, "external"), ("../../../z", None, "outside_root")}
    src = spark.createDataFrame([("x", "pub fn go() {}\nclass A:\n  def f(self):\nimport os\n")], "path string, content string")
    assert {(r.line_no, r.kind, r.name) for r in X.declarations(src, ["path"]).collect()} == {(1, "function", "go"), (2, "class", "A"), (3, "function", "f")}


def test_tree_scan(spark, tmp_path):
    (tmp_path / "src/build").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.bin").write_bytes(b"\xff\x00\xfe")
    (tmp_path / "src/build/c.py").write_text("y")
    rows = {r.path: r for r in scan_tree(spark, str(tmp_path), exclude=["build"]).collect()}
    assert set(rows) == {"src/a.py", "src/b.bin", "src", "."} and rows["src/a.py"].size_bytes == 6 and rows["."].parent_path is None
    out = {r.path: (r.outcome, r.line_count) for r in read_texts(spark, str(tmp_path)).collect()}
    assert out["src/a.py"] == ("indexed", 1) and out["src/b.bin"][0] == "binary_or_non_utf8"
    assert column(spark, ["build/x", "a/build/x", "k.min.js", "public/k.min.js"], lambda c: ignored(c, ignore_rules(["build/", "*.min.js", "!public/*.min.js"]))) == [True, True, True, False]
    assert column(spark, [" M b\0?? a\0 M b\0"], lambda c: git_paths(c, True)) == [["a", "b"]]


def test_streams_equal_batch(spark, tmp_path):
    day = dt.datetime(2025, 1, 1)
    rows = [(i, day + dt.timedelta(hours=7 * i), i % 3, "t", float(i), "") for i in range(20)]
    df = spark.createDataFrame(rows, EVENT_SCHEMA)
    for k in range(3):
        df.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = fold_usage(read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    last = max(int(p.name[2:]) for p in (tmp_path / "out").iterdir())
    got = {(r.day, r.session, r.calls, r.value) for r in spark.read.parquet(str(tmp_path / f"out/v={last}")).collect()}
    want = {(r.day, r.session, r.calls, r.value) for r in df.groupBy(F.date_trunc("day", "ts").alias("day"), F.col("user_id").alias("session")).agg(F.count("*").alias("calls"), F.sum("value").alias("value")).collect()}
    assert got == want
    ev = spark.createDataFrame([(day, "p", "a", "write"), (day + dt.timedelta(seconds=1), "p", "b", "write"), (day + dt.timedelta(seconds=9), "p", ".gitignore", "write"), (day, "p", "c", "access")], "ts timestamp, project string, path string, action string")
    sets = sorted((r.paths, r.full_scan) for r in change_sets(ev).collect())
    assert sets == [([".gitignore"], True), (["a", "b"], False)]


def test_entry_has_all_queries():
    import __spark_entry__ as e

    assert {"p2_found", "p4_found", "p5_found"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
