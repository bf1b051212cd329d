"""References whose target does not exist, judged at the end of each reference's period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def orphan_groups(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(target, key, period, refs) of the groups of references without a live parent.

    children: target, key, period. parents: target, key, live_from, live_until (first period in which it
    is no longer live, null = still live); periods are integers, ``key`` is any orderable type.

    Tagged keys of both sides meet in one long table. Before the shuffle it is summed per (target, key,
    period): references count, a parent adds +1 where its life begins and -1 where it ends. A running sum
    over a key's periods then tells the parents alive in each, so one very frequent key costs no more than
    its number of periods, and no parent is repeated for the periods it spans.
    """
    def long(df: DataFrame, period: str, refs: int, step: int) -> DataFrame:
        return df.select("target", "key", F.col(period).alias("period"), F.lit(refs).cast("bigint").alias("refs"), F.lit(step).cast("bigint").alias("step"))

    tagged = long(children, "period", 1, 0).unionByName(long(parents, "live_from", 0, 1)).unionByName(long(parents, "live_until", 0, -1))
    sums = tagged.dropna(subset=["key", "period"]).groupBy("target", "key", "period").agg(F.sum("refs").alias("refs"), F.sum("step").alias("step"))
    so_far = W.partitionBy("target", "key").orderBy("period").rowsBetween(W.unboundedPreceding, W.currentRow)
    return sums.withColumn("alive", F.sum("step").over(so_far)).where("refs > 0 AND alive <= 0").select("target", "key", "period", "refs")


def orphan_rows(children: DataFrame, parents: DataFrame, keep: list[str]) -> DataFrame:
    """The references themselves: ``keep`` columns of each child row in an orphan group, each once.

    A null key refers to nothing and is no case; a null period (row without time) can't be judged and is
    left out; a parent never staged (null live_from) never lives. Repeated child or parent rows change
    nothing. The way back from groups to rows is an inner join on (target, key, period), whose large
    groups AQE splits.
    """
    groups = orphan_groups(children, parents).select("target", "key", "period")
    return children.join(groups, ["target", "key", "period"], "left_semi").select(*keep).distinct()


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
