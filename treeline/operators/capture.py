"""Change capture: what each run must take from an append-only log.

The log is split into partitions (worktrees). A record's offset is its place in its
partition's arrival order. Every run owns a *batch plan*, the offset range
``(from_offset, to_offset]`` it has to read, fixed and written before anything is read. The range of a
run that does not succeed is replayed by the next one that does, because ranges start where
the last *succeeded* run ended. The sink keeps one state per key, chosen by the key's own
version (observation time), so a record delivered twice or late changes nothing.

``capture_changes`` applies all plans of a finished history at once; ``LogCapture`` runs them
one by one against a growing log, with the plan written ahead and replayed after a crash.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.sources.tables import written

HOUR_US = 3_600_000_000


def final_reports(reports: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last report of each run (greatest ``order``), one row per ``key``."""
    rest = [c for c in reports.columns if c not in key]
    last = reports.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*key, "_r.*")


def batch_plans(runs: DataFrame, bucket_us: int = HOUR_US) -> DataFrame:
    """(part, run, to_offset, succeeded) -> the same with from_offset: the end of the partition's last *succeeded* run before.

    A run that does not succeed leaves from_offset where it was, so its range is part of the next plan. Found in two steps, within
    time buckets and over one row per bucket, so that a partition with very many runs is spread.
    """
    b = F.floor(F.col("to_offset") / bucket_us)
    done = F.when(F.col("succeeded"), F.col("to_offset"))
    rows = runs.select("part", "run", "to_offset", "succeeded", b.alias("b"), done.alias("_d"))
    inside = W.partitionBy("part", "b").orderBy("to_offset", "run").rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy("part").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy("part", "b").agg(F.max("_d").alias("_m")).select("part", "b", F.last("_m", ignorenulls=True).over(over).alias("_c"))
    own = rows.withColumn("_p", F.last("_d", ignorenulls=True).over(inside)).join(carried, ["part", "b"])
    return own.select("part", "run", "to_offset", "succeeded", F.coalesce("_p", "_c").alias("from_offset"))


def assign_batches(log: DataFrame, plans: DataFrame, bucket_us: int = HOUR_US) -> DataFrame:
    """Give each log row (part, offset, ...) the batch (to_offset, run) whose range holds it.

    plans: part, run, from_offset, to_offset. An as-of join: the first plan of the partition with ``to_offset >= offset``, if its range
    holds the row. Log and plans meet
    inside (partition, time bucket), so a hot partition is spread over its buckets; the first plan
    after a bucket is carried into it by one extra row. Rows beyond the last plan are dropped: no
    batch has read them yet. No plan is ever multiplied by log rows.
    """
    bucket = lambda c: F.floor(F.col(c) / bucket_us)
    extra = [c for c in log.columns if c not in ("part", "offset")]
    ends = plans.select("part", bucket("to_offset").alias("b"), F.struct("to_offset", "run", "from_offset").alias("_p"))
    used = log.select("part", bucket("offset").alias("b")).distinct().withColumn("_p", F.lit(None).cast(ends.schema["_p"].dataType))
    back = W.partitionBy("part").orderBy(F.desc("b"))
    firsts = (
        ends.unionByName(used)
        .groupBy("part", "b")
        .agg(F.min("_p").alias("_first"))
        .withColumn("_p", F.last("_first", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)))
        .where(F.col("_p").isNotNull())
    )
    none = lambda c: F.lit(None).cast(log.schema[c].dataType).alias(c)
    blank = [none(c) for c in extra]
    no_plan = F.lit(None).cast(ends.schema["_p"].dataType).alias("_p")
    rows = (
        log.select("part", bucket("offset").alias("b"), F.col("offset").alias("_t"), F.lit(2).alias("_tag"), no_plan, *extra)
        .unionByName(ends.select("part", "b", F.col("_p.to_offset").alias("_t"), F.lit(1).alias("_tag"), "_p", *blank))
        .unionByName(firsts.select("part", "b", ((F.col("b") + 1) * bucket_us).alias("_t"), F.lit(0).alias("_tag"), "_p", *blank))
    )
    # Backwards through time: the plan passed last is the first one at or after the row.
    order = W.partitionBy("part", "b").orderBy(F.desc("_t"), "_tag", F.desc("_p")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("_p", F.last("_p", ignorenulls=True).over(order))
        .where((F.col("_tag") == 2) & F.col("_p").isNotNull())
        .where(F.col("_p.from_offset").isNull() | (F.col("_t") > F.col("_p.from_offset")))
        .select("part", F.col("_p.to_offset").alias("to_offset"), F.col("_p.run").alias("run"), F.col("_t").alias("offset"), *extra)
    )


def sink_changes(batches: DataFrame) -> DataFrame:
    """Rows (part, key, run, to_offset, version, value) -> (part, run, key) whose value is new or changed.

    Each batch is first reduced to one row per key, partially before the shuffle; after it, the state a
    run sees is the greatest version so far, and a row is a change when its value differs from the
    state of the key before. A key repeated, or delivered late with an older version, gives no row.
    """
    one = batches.groupBy("part", "key", "run", "to_offset").agg(F.max(F.struct("version", "value")).alias("s"))
    w = W.partitionBy("part", "key").orderBy("to_offset", "run")
    now = F.max("s").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    before = F.max("s").over(w.rowsBetween(W.unboundedPreceding, -1))
    return (
        one.select("part", "key", "run", now.alias("n"), before.alias("o"))
        .where(~F.col("n.value").eqNullSafe(F.col("o.value")))
        .select("part", "run", "key")
    )


def capture_changes(log: DataFrame, runs: DataFrame) -> DataFrame:
    """New or changed keys of every succeeded run.

    log: part, offset (bigint, microseconds of arrival), key, version (orderable), value.
    runs: part, run, to_offset, succeeded. Result: part, run, key, each once.

    Null key, value, part or offset: the row names nothing that could be taken, it is left out. Equal
    versions: the greatest value wins, so the result does not depend on the order of rows. Empty log or
    no succeeded run: no rows. Other columns are ignored.
    """
    log = log.select("part", "offset", "key", "version", "value").dropna(subset=["part", "offset", "key", "value"])
    known = runs.select("part", "run", "to_offset", F.coalesce("succeeded", F.lit(False)).alias("succeeded")).dropna(subset=["part", "run", "to_offset"]).distinct()
    # Plans of all runs are written before the log is read; those without success stay without effect, the next one covers their range.
    plans = written(batch_plans(known))
    return sink_changes(assign_batches(log, plans.where("succeeded").drop("succeeded")))


class LogCapture:
    """Incremental form: one call of ``run`` takes what the log gained since the last success.

    ``state_dir`` (on the shared file system) holds, per batch, ``plan`` (offset range per partition,
    written before reading), ``out`` (the changes) and ``state`` (key -> version, value, of the keys the batch met); a batch
    counts once its ``commit`` file exists. A plan without commit is replayed unchanged, its partial output
    overwritten, so no record is skipped or taken twice whatever the moment of the failure.

    Offsets of a partition may tie. A range therefore begins at the offset the last one ended with, and ``lateness`` below it: what
    was read before meets its own state in the sink and changes nothing, what came later is new. Each ``merge`` batches
    the states are brought into one table, so a batch writes what it met and not the whole state. ``common`` says that all
    partitions count offsets by one clock (arrival times); then the scan of the log begins at the least offset any goes on from.
    """

    def __init__(self, spark: SparkSession, state_dir: str, lateness: int = 0, merge: int = 16, common: bool = False):
        self.spark, self.dir, self.lateness, self.merge, self.common = spark, state_dir.rstrip("/"), lateness, merge, common
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.dir}/{name}"))

    def _numbers(self, name: str) -> list[int]:
        """Numbers of the finished entries below a folder."""
        if not self._exists(name):
            return []
        found = (x.getPath() for x in self._fs.listStatus(self._path(f"{self.dir}/{name}")))
        return sorted(int(x.getName()) for x in found if x.getName().isdigit())

    def committed(self) -> int:
        """Number of the last committed batch, 0 before the first."""
        return max(self._numbers("commit"), default=0)

    def plan(self, log: DataFrame) -> int:
        """Write the next batch's plan unless one is waiting; return its number."""
        done = self.committed()
        n = done + 1
        if not self._exists(f"plan/{n}/_SUCCESS"):
            old = None
            if done:
                old = self.spark.read.parquet(f"{self.dir}/plan/{done}").select("part", F.col("to_offset").alias("from_offset"))
                log = self._since(log, old)
            ends = log.dropna(subset=["part", "offset"]).groupBy("part").agg(F.max("offset").alias("to_offset"))
            if old is not None:
                ends = ends.join(old, "part", "full").select("part", F.greatest("to_offset", "from_offset").alias("to_offset"), "from_offset")
            else:
                ends = ends.withColumn("from_offset", F.lit(None).cast("bigint"))
            ends.write.mode("overwrite").parquet(f"{self.dir}/plan/{n}")
        return n

    def _since(self, log: DataFrame, plan: DataFrame) -> DataFrame:
        """The log from the least offset on that any partition goes on from, as a literal that reaches the scan."""
        least = plan.agg(F.min("from_offset")).first()[0] if self.common else None
        return log if least is None else log.where(F.col("offset") >= least - self.lateness)

    def _state(self, n: int) -> DataFrame | None:
        """(part, key, o) of all keys met before batch ``n``."""
        base = max((k for k in self._numbers("merged") if k < n and self._exists(f"merged/{k}/_SUCCESS")), default=0)
        parts = ([f"{self.dir}/merged/{base}"] if base else []) + [f"{self.dir}/state/{k}" for k in range(base + 1, n)]
        return self.spark.read.parquet(*parts).groupBy("part", "key").agg(F.max("o").alias("o")) if parts else None

    def apply(self, log: DataFrame, n: int) -> DataFrame:
        """Process batch ``n`` as planned, however often it was begun before."""
        plan = self.spark.read.parquet(f"{self.dir}/plan/{n}")
        cols = ["part", "offset", "key", "version", "value"]
        rows = log.select(*cols).dropna(subset=["part", "offset", "key", "value"])
        rows = self._since(rows, plan).join(plan, "part")
        rows = rows.where((F.col("offset") <= F.col("to_offset")) & (F.col("from_offset").isNull() | (F.col("offset") >= F.col("from_offset") - self.lateness)))
        new = rows.groupBy("part", "key").agg(F.max(F.struct("version", "value")).alias("n"))
        old = self._state(n)
        both = new.withColumn("o", F.lit(None).cast(new.schema["n"].dataType)) if old is None else new.join(old, ["part", "key"], "left")
        met = both.select("part", "key", F.greatest("n", "o").alias("n"), "o")
        moved = met.where(~F.col("n").eqNullSafe(F.col("o")))
        moved.select("part", "key", F.col("n").alias("o")).write.mode("overwrite").parquet(f"{self.dir}/state/{n}")
        moved.where(~F.col("n.value").eqNullSafe(F.col("o.value"))).select("part", "key", "n.version", "n.value").write.mode("overwrite").parquet(f"{self.dir}/out/{n}")
        return self.spark.read.parquet(f"{self.dir}/out/{n}")

    def commit(self, n: int) -> None:
        """Make batch ``n`` count. States of earlier batches are merged now and then; a merge that breaks off is not used and done again later."""
        out = self._fs.create(self._path(f"{self.dir}/commit/{n}"), True)
        out.write(bytearray(json.dumps({"batch": n}).encode()))
        out.close()
        if n % self.merge == 0:
            self._state(n + 1).write.mode("overwrite").parquet(f"{self.dir}/merged/{n}")
            # What the merged table holds is no longer read.
            for name, last in (("state", n), ("merged", n - 1)):
                for k in self._numbers(name):
                    if k <= last:
                        self._fs.delete(self._path(f"{self.dir}/{name}/{k}"), True)

    def run(self, log: DataFrame) -> DataFrame:
        """Plan, process and commit one batch; the changes it found."""
        n = self.plan(log)
        out = self.apply(log, n)
        self.commit(n)
        return out
