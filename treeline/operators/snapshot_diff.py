"""Differences between consecutive full snapshots, found by comparing hash trees.

Keys fall into ranges of their hash. A tree node is a hash range of one snapshot with an order-free
digest of its rows (count, xor and sum of 64-bit row hashes); a parent's digest is made of its
children's. Trees of consecutive snapshots are compared from the root down, following only nodes that
differ, and rows are compared only inside leaves that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.sources.tables import written

FANOUT_BITS = 8
DEPTH = 7  # 56 bits of a key's hash; trees are only as deep as the largest snapshot of their series needs
ROWS_PER_LEAF = 256


def _word(c: str) -> Column:
    """Null is a value of its own; hashing alone would skip it."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))


def leaf_level(rows: Column) -> Column:
    """Tree depth (0 = root only) at which a leaf of a snapshot of that many rows holds about ROWS_PER_LEAF."""
    need = F.ceil(F.log2(F.greatest(rows, F.lit(1)) / ROWS_PER_LEAF) / FANOUT_BITS)
    return F.least(F.greatest(F.coalesce(need, F.lit(0)), F.lit(0)), F.lit(DEPTH)).cast("int")


def _range_of(key_hash: str, level: str) -> Column:
    """Number of the hash range of a tree level that holds a 64-bit hash."""
    return F.when(F.col(level) == 0, F.lit(0).cast("bigint")).otherwise(F.expr(f"shiftrightunsigned({key_hash}, 64 - {FANOUT_BITS} * {level})"))


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, key: str, state: list[str]) -> DataFrame:
    """(snapshot, key, change_type) for each pair of consecutive complete snapshots of a series.

    rows: snapshot, ``key`` and the ``state`` columns. snapshots: snapshot, series, seq (orderable),
    row_count. A snapshot whose distinct keys are not ``row_count`` is incomplete and takes no part.

    Repeated rows count once; where rows of one key disagree the greatest state hash is taken. Null is a
    value in ``state``; rows with null snapshot or key are left out, and so are snapshots without metadata
    or with null row_count. A snapshot of zero rows is complete when row_count is 0. Empty tables: no rows.
    """
    snaps = snapshots.select("snapshot", "series", "seq", "row_count").dropna(subset=["snapshot", "series"])
    snaps = snaps.groupBy("snapshot").agg(F.max(F.struct("series", "seq", "row_count")).alias("m")).select("snapshot", "m.*")
    size = W.partitionBy("series")
    snaps = snaps.withColumn("level", leaf_level(F.max("row_count").over(size)))
    deepest = snaps.agg(F.max("level")).first()[0] or 0
    slim = rows.select("snapshot", F.col(key).alias("k"), F.xxhash64(*map(_word, state)).alias("v")).dropna(subset=["snapshot", "k"])
    slim = slim.join(snaps.select("snapshot", "series", "level"), "snapshot").withColumn("h", F.xxhash64("k"))
    # Rows come together by (series, leaf) once and are kept that way: digests read few columns of the written
    # table and combine before their exchange, and only leaves that differ are read for the comparison of rows.
    slim = slim.withColumn("leaf", _range_of("h", "level")).repartition("series", "leaf")
    slim = written(slim.groupBy("series", "leaf", "snapshot", "k").agg(F.max("v").alias("v"), F.first("level").alias("level")))

    mixed = F.xxhash64("k", "v")
    leaves = slim.groupBy("series", "leaf", "snapshot").agg(
        F.first("level").alias("level"), F.count(F.lit(1)).alias("n"), F.bit_xor(mixed).alias("x"), F.sum(F.hash("v", "k").cast("bigint")).alias("s")
    )
    # The tree in long form: each leaf adds to the node above it at every level.
    nodes = (
        leaves.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("level"))))
        .withColumn("node", F.expr(f"shiftright(leaf, (level - at) * {FANOUT_BITS})"))
        .groupBy("series", "snapshot", "at", "node")
        .agg(F.first("level").alias("level"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))
    )
    have = nodes.where("at = 0").select("snapshot", F.col("n").alias("have"))
    order = W.partitionBy("series").orderBy("seq", "snapshot")
    pairs = (
        snaps.join(have, "snapshot", "left")
        .where(F.coalesce("have", F.lit(0)) == F.col("row_count"))
        .withColumn("prev", F.lag("snapshot").over(order))
        .where(F.col("prev").isNotNull())
    )
    # Each pair twice: as the earlier side (-1) and the later side (+1) of its comparison.
    side = lambda of, sign: F.struct(F.col(of).alias("snapshot"), F.lit(sign).alias("sign"))
    sides = pairs.select("series", F.col("snapshot").alias("later"), F.explode(F.array(side("prev", -1), side("snapshot", 1))).alias("e")).select("series", "later", "e.*")
    compared = (
        nodes.join(sides, ["series", "snapshot"])
        .groupBy("series", "later", "level", "at", "node")
        .agg(F.sum(F.col("n") * F.col("sign")).alias("n"), F.bit_xor("x").alias("x"), F.sum(F.col("s") * F.col("sign")).alias("s"))
        .where("n <> 0 OR x <> 0 OR s <> 0")
        .select("series", "later", "level", "at", "node")
    )
    # Top-down: below the root a node counts only if its parent differs too.
    frontier = compared.where("at = 0")
    leaf_hits = frontier.where("level = 0")
    for depth in range(1, deepest + 1):
        below = compared.where(F.col("at") == depth).withColumn("parent", F.shiftright("node", FANOUT_BITS))
        frontier = below.join(frontier.select("series", "later", F.col("node").alias("parent")), ["series", "later", "parent"], "left_semi").drop("parent")
        leaf_hits = leaf_hits.unionByName(frontier.where(F.col("level") == depth))
    # Written too, so that its size is known when the rows are joined: a small one is sent to them.
    wanted = leaf_hits.select("series", "later", F.col("node").alias("leaf")).join(sides, ["series", "later"])
    wanted = written(wanted)
    state_on = lambda sign: F.max(F.when(F.col("sign") == sign, F.col("v")))
    both = slim.join(wanted, ["series", "leaf", "snapshot"]).groupBy("later", "k").agg(state_on(-1).alias("was"), state_on(1).alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(F.col("later").alias("snapshot"), F.col("k").alias(key), kind.alias("change_type"))
