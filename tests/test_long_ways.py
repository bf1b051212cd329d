"""Ways longer than the bounds of the SQL forms."""

from __future__ import annotations

from treeline.operators import graph as G
from treeline.plans import graph_queries, joins_and_counts

LAST = 19


def chain(spark, extra=()):
    rows = [("p", f"n{i:02}", f"n{i + 1:02}") for i in range(LAST)]
    return spark.createDataFrame([*rows, *extra], "pid string, src string, dst string")


def test_trace_finds_targets_far_away(spark, monkeypatch):
    e = chain(spark, [("q", "a", "b"), ("q", "b", "a"), ("q", "c", "z")])
    monkeypatch.setattr(joins_and_counts, "_live_dependencies", lambda spark, root: (None, e))
    got = {tuple(r) for r in joins_and_counts.s271_trace(spark, "").collect()}
    assert got == {("p", f"n{LAST}", LAST, "confirmed"), ("q", "z", None, "absent")}


def test_impact_reaches_all_dependents(spark, monkeypatch):
    monkeypatch.setattr(graph_queries, "links", lambda spark, root, kinds=None: chain(spark))
    got = {r.node: r.hops for r in graph_queries.s267_impact(spark, "").collect()}
    assert got == {f"n{i:02}": LAST - i for i in range(LAST + 1)}


def test_closure_reaches_all_files(spark, monkeypatch):
    x = spark.createDataFrame([("p", "d", f"k{i}", "t", f"f{i:02}") for i in range(9)], "pid string, domain string, digest string, target string, owner_path string")
    d = spark.createDataFrame([(i, "p", "d", f"k{i}", f"f{i + 1:02}") for i in range(8)], "dependency_id int, pid string, domain string, digest string, owner_path string")
    monkeypatch.setattr(graph_queries, "exports", lambda spark, root: x)
    monkeypatch.setattr(graph_queries, "dependencies", lambda spark, root: d)
    assert {r.node: r.hops for r in graph_queries.s317_closure(spark, "").collect()} == {f"f{i:02}": i for i in range(9)}


def test_cycles_end(spark):
    e = spark.createDataFrame([("p", "a", "b"), ("p", "b", "a")], "pid string, src string, dst string")
    assert {(r.node, r.hops) for r in G.bounded_bfs(e, spark.createDataFrame([("p", "a")], "pid string, node string")).collect()} == {("a", 0), ("b", 1)}
