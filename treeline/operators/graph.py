"""Graph queries by joins: bounded search, components, cycles, distances. Vertices and edges stay distributed.

Edges are (pid, src, dst); searches run in all repositories (pid) at once. Each round of a loop is one join and
one aggregation, checkpointed to the shared folder so that plans stay short and lost executors cost one round.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.sources.tables import checkpointed, written, written_counting

MERGE = 16  # rounds of a search whose findings are brought into one table


def _rows():
    return F.count(F.lit(1))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("pid", F.col("dst").alias("src"), F.col("src").alias("dst"))


def bounded_bfs(edges: DataFrame, anchors: DataFrame, depth: int | None = None) -> DataFrame:
    """(pid, node, hops) of the nodes within ``depth`` steps of the anchors (pid, node), hops the least number of steps.

    Without ``depth`` the walk goes on until nothing new is met. A node is expanded once. Null ends lead nowhere; anchors without edges are reached at 0.
    """
    # Written once; edges that come dealt by (pid, src) are not moved again in any round.
    links = checkpointed(edges.dropna(subset=["src", "dst"]).select("pid", "src", "dst").distinct())
    seen = checkpointed(anchors.select("pid", "node").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for step in count(1) if depth is None else range(1, depth + 1):
        nxt = frontier.select("pid", F.col("node").alias("src")).join(links, ["pid", "src"]).select("pid", F.col("dst").alias("node")).distinct()
        frontier, met = written_counting(nxt.join(seen.select("pid", "node"), ["pid", "node"], "left_anti").withColumn("hops", F.lit(step)), n=_rows())
        if not met["n"]:
            break
        seen = seen.unionByName(frontier)
        if step % MERGE == 0:
            seen = checkpointed(seen)
    return seen


def paths_back(edges: DataFrame, reached: DataFrame, targets: DataFrame, depth: int | None = None) -> DataFrame:
    """(pid, target, step, node): one shortest way from an anchor to each target (pid, target) that was reached.

    reached: pid, node, hops of ``bounded_bfs`` over the same edges. Of several ways the one over the least nodes, seen from the target, is
    taken. Walked back one step a round for all targets at once, up to ``depth`` rounds or until all ways begin.
    """
    hops = checkpointed(reached.select("pid", "node", "hops"))
    into = edges.dropna(subset=["src", "dst"]).select("pid", "src", "dst").distinct()
    before = into.join(hops.select("pid", F.col("node").alias("src"), F.col("hops").alias("_h")), ["pid", "src"])
    before = before.join(hops.select("pid", F.col("node").alias("dst"), "hops"), ["pid", "dst"]).where("_h = hops - 1")
    parent = checkpointed(before.groupBy("pid", F.col("dst").alias("node")).agg(F.min("src").alias("parent")))
    now = checkpointed(targets.select("pid", "target").distinct().join(hops.select("pid", F.col("node").alias("target"), F.col("hops").alias("step")), ["pid", "target"]).select("pid", "target", "step", F.col("target").alias("node")))
    out = now
    for k in count(1) if depth is None else range(1, depth + 1):
        now, left = written_counting(now.where("step > 0").join(parent, ["pid", "node"]).select("pid", "target", (F.col("step") - 1).alias("step"), F.col("parent").alias("node")), n=_rows())
        if not left["n"]:
            break
        out = out.unionByName(now)
        if k % MERGE == 0:
            out = checkpointed(out)
    return out


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pid, node, component): component is the least node connected whatever the direction; lone nodes are their own.

    Two star operations in turn: every node's greater neighbours are hung on the least node around it, then its lesser ones and
    itself. The number of rounds grows with the logarithm of the nodes, not with the length of ways. A node with very many
    neighbours takes part with one row on one side of each join, which can be split on the other. Whether a round changed
    anything is told by sums its write takes.
    """
    links = edges.dropna(subset=["src", "dst"]).where("src <> dst")
    up = written(links.select("pid", F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark = {"n": _rows(), "h": F.sum(F.xxhash64("pid", "a", "b").cast("decimal(38,0)"))}
    last = None
    while True:
        around = up.select("pid", F.explode(F.array(F.struct(F.col("a").alias("b"), F.col("b").alias("m")), F.struct("b", F.col("b").alias("m")))).alias("s")).select("pid", "s.*").groupBy("pid", "b").agg(F.min("m").alias("m"))
        large = written(up.join(around, ["pid", "b"]).select("pid", "a", F.col("m").alias("b")).distinct())
        least = large.groupBy("pid", "a").agg(F.min("b").alias("m"))
        hung = large.join(least, ["pid", "a"]).select("pid", F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s")).select("pid", "s.*")
        up, now = written_counting(hung.where("a <> b").distinct(), **mark)
        if now == last:
            break
        last = now
    root = up.groupBy("pid", F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.select("pid", "node").distinct().join(root, ["pid", "node"], "left").select("pid", "node", F.coalesce("component", "node").alias("component"))


def _among(links: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes kept."""
    return links.join(keep.select("pid", F.col("node").alias("src")), ["pid", "src"], "left_semi").join(keep.select("pid", F.col("node").alias("dst")), ["pid", "dst"], "left_semi").select("pid", "src", "dst")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pid, node, component): nodes that reach each other share the least of their names.

    Forward-backward colouring: labels spread forwards over the nodes that have a way in and out; within a colour the nodes
    that reach its root backwards are one component and leave. Every other node is its own.
    """
    links, some = written_counting(edges.dropna(subset=["src", "dst"]).where("src <> dst").select("pid", "src", "dst").distinct(), n=_rows())
    done = None
    while some["n"]:
        # Nodes without way in or out are in no cycle; without them others may be such nodes.
        while True:
            alive = links.select("pid", F.col("src").alias("node")).intersect(links.select("pid", F.col("dst").alias("node")))
            before = some["n"]
            links, some = written_counting(_among(links, alive), n=_rows())
            if some["n"] == before or not some["n"]:
                break
        if not some["n"]:
            break
        ends = links.select("pid", F.col("src").alias("node")).distinct()
        colour = _spread(ends.withColumn("label", F.col("node")), links)
        same = links.join(colour.select("pid", F.col("node").alias("src"), F.col("label").alias("cs")), ["pid", "src"]).join(colour.select("pid", F.col("node").alias("dst"), F.col("label").alias("cd")), ["pid", "dst"]).where("cs = cd")
        back = bounded_bfs(reverse(same), colour.where("node = label").select("pid", "node")).select("pid", "node")
        members = written(back.join(colour, ["pid", "node"]).select("pid", "node", F.col("label").alias("component")))
        done = members if done is None else done.unionByName(members)
        links, some = written_counting(_among(links, ends.join(members, ["pid", "node"], "left_anti")), n=_rows())
    own = nodes.select("pid", "node").distinct()
    if done is None:
        return own.withColumn("component", F.col("node"))
    return own.join(done, ["pid", "node"], "left").select("pid", "node", F.coalesce("component", "node").alias("component"))


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The least label that reaches each node along edges, none but its own counted as a shortcut. labels: pid, node, label."""
    while True:
        offers = edges.join(labels.select("pid", F.col("node").alias("src"), F.col("label").alias("offer")), ["pid", "src"]).groupBy("pid", F.col("dst").alias("node")).agg(F.min("offer").alias("offer"))
        new = labels.join(offers, ["pid", "node"], "left").select("pid", "node", F.least("label", "offer").alias("label"), F.coalesce(F.col("offer") < F.col("label"), F.lit(False)).alias("moved"))
        labels, seen = written_counting(new, n=F.count_if("moved"))
        labels = labels.drop("moved")
        if not seen["n"]:
            return labels


def cycles(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(pid, component, size) of the components that hold a cycle: several nodes, or one with an edge to itself."""
    size = components.groupBy("pid", "component").agg(F.count(F.lit(1)).alias("size"))
    loops = edges.where("src = dst").select("pid", F.col("src").alias("node")).distinct().join(components, ["pid", "node"]).select("pid", "component").distinct().withColumn("loop", F.lit(True))
    return size.join(loops, ["pid", "component"], "left").where("size > 1 OR loop").select("pid", "component", "size")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pid, node, degree): edge ends at a node, a loop counts twice, a lone node has 0."""
    ends = edges.dropna(subset=["src", "dst"]).select("pid", F.explode(F.array("src", "dst")).alias("node")).groupBy("pid", "node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("pid", "node").distinct().join(ends, ["pid", "node"], "left").select("pid", "node", F.coalesce("degree", F.lit(0)).alias("degree"))


def resolve(dependencies: DataFrame, exports: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``candidates`` and ``target`` to dependencies: how many distinct targets share the key, and the first of them.

    No target: unresolved; one: resolved; more: ambiguous. Exports are reduced to one row per key before the join.
    """
    offered = exports.dropna(subset=keys).groupBy(*keys).agg(F.count_distinct("target").alias("candidates"), F.min("target").alias("target"))
    found = dependencies.join(offered, keys, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return found.withColumn("status", F.when(F.col("candidates") == 0, "unresolved").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous"))
