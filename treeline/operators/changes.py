"""Differences, replacement and publication of keyed tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


LANES, DIGITS = 5, 12


def set_digest(item: Column) -> Column:
    """Aggregate: digest of a multiset of strings, the same in whatever order they come.

    The items' SHA-256 are added up lane by lane, so it is computed by partial sums and no task ever holds a group's items.
    Null items are left out.
    """
    h = F.sha2(item, 256)
    sums = [F.sum(F.conv(F.substring(h, 1 + DIGITS * i, DIGITS), 16, 10).cast("decimal(20,0)")) for i in range(LANES)]
    return F.sha2(F.concat_ws(".", F.count(item).cast("string"), *(x.cast("string") for x in sums)), 256)


def delta(old: DataFrame, new: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """(keys, change) of the keys added, removed or modified; null is a value in ``compare``."""
    state = F.struct(*compare)
    both = old.select(*keys, state.alias("o"), F.lit(True).alias("in_o")).join(new.select(*keys, state.alias("n"), F.lit(True).alias("in_n")), keys, "full")
    kind = F.when(F.col("in_o").isNull(), "added").when(F.col("in_n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "modified")
    return both.withColumn("change", kind).where("change IS NOT NULL").select(*keys, "change")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` take the place of those with their keys, the others stay."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def replace_paths(table: DataFrame, rows: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with all its rows of the changed keys taken out and ``rows`` of those keys put in.

    A changed key without rows is cleared; rows of keys not named as changed are not taken.
    """
    kept = table.join(changed.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(rows.join(changed.select(*keys).distinct(), keys, "left_semi").select(*table.columns))


def replace_scan(table: DataFrame, scan: DataFrame, keys: list[str], authored: list[str]) -> DataFrame:
    """A new scan over the last one: seen rows take its values and keep authored columns, unseen rows stay, marked gone."""
    facts = [c for c in scan.columns if c not in keys]
    both = table.withColumn("_old", F.lit(True)).alias("t").join(scan.withColumn("_new", F.lit(True)).alias("s"), keys, "full")
    pick = [F.when(F.col("_new"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in table.columns else F.col(f"s.{c}").alias(c) for c in facts]
    return both.select(*keys, *pick, *(F.col(f"t.{c}") for c in authored), F.coalesce("_new", F.lit(False)).alias("exists_now"))


class Generations:
    """Complete, immutable versions of a set of tables; readers see the one the pointer names.

    A version is written beside the others and becomes visible by renaming one small file, so a failed or
    repeated write is never seen. Every reader that has asked for its number keeps reading the same version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def active(self) -> int:
        """Number of the visible version, 0 before the first."""
        at = self._path(f"{self.root}/ACTIVE")
        if not self._fs.exists(at):
            return 0
        return int(json.loads(self.spark.read.text(str(at)).first()[0])["generation"])

    def publish(self, tables: dict[str, DataFrame], expect: int | None = None, still_true: Callable[[], bool] | None = None) -> int:
        """Write all tables as the next version and make it visible; refuses if another was published meanwhile.

        ``still_true`` is asked when everything is written, just before it becomes visible: whether the sources are those the
        tables were made from. If not, the version is dropped.
        """
        base = self.active() if expect is None else expect
        n = base + 1
        folder = f"{self.root}/gen={n}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        if still_true is not None and not still_true():
            self._fs.delete(self._path(folder), True)
            raise RuntimeError("the sources changed while the generation was written")
        if self.active() != base:
            self._fs.delete(self._path(folder), True)
            raise RuntimeError("another generation was published meanwhile")
        temp = self._path(f"{self.root}/.ACTIVE-{uuid.uuid4().hex[:8]}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps({"generation": n, "folder": folder}).encode()))
        out.close()
        target = self._path(f"{self.root}/ACTIVE")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(temp), self._fs.makeQualified(target), options)
        return n

    def read(self, name: str) -> DataFrame:
        folder = json.loads(self.spark.read.text(f"{self.root}/ACTIVE").first()[0])["folder"]
        return self.spark.read.parquet(f"{folder}/{name}")
