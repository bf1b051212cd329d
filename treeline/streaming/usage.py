"""Streams: file changes in debounced batches, and usage events folded into aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
FULL_SCAN_NAMES = [".gitignore", ".ignore", "treeline.toml"]


QUEUE = 1024  # paths of one batch beyond which it is no longer worth naming them


def change_sets(events: DataFrame, gap: str = "2 seconds", watermark: str = "10 seconds", queue: int = QUEUE) -> DataFrame:
    """Batches of file events (ts, project, path, action) that no pause of ``gap`` interrupts.

    Reads are left out. Renames and changes of policy files ask for a full scan, and so does a batch of more than ``queue`` paths, which
    then names none.
    """
    kept = events.where("action <> 'access'").withWatermark("ts", watermark)
    full = (F.col("action") == "rename") | F.element_at(F.split("path", "/"), -1).isin(FULL_SCAN_NAMES)
    g = kept.groupBy("project", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.max(full).alias("full_scan"))
    over = F.size("paths") > queue
    paths = F.when(over, F.array().cast("array<string>")).otherwise(F.col("paths"))
    return g.select("project", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), paths.alias("paths"), (F.col("full_scan") | over).alias("full_scan"))


def idle_instances(events: DataFrame, gap: str = "24 hours", watermark: str = "1 hour") -> DataFrame:
    """Instances by owner (ts, owner): a pause of ``gap`` ends one."""
    g = events.withWatermark("ts", watermark).groupBy("owner", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_seen"))
    return g.select("owner", F.col("w.start").alias("started"), "last_seen", "events")


def fold_usage(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep daily sums per session current; each batch is added once, however often it is tried.

    The sums of batch n are written as a version of their own from those of batch n - 1, so a batch that is
    repeated after a failure overwrites its own unfinished version and changes nothing else; versions no batch can need are removed.
    """

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        day = F.date_trunc("day", "ts")
        new = batch.groupBy(day.alias("day"), F.col("user_id").alias("session")).agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("value"))
        if n:
            new = new.unionByName(spark.read.parquet(f"{target}/v={n - 1}")).groupBy("day", "session").agg(F.sum("calls").alias("calls"), F.sum("value").alias("value"))
        new.write.mode("overwrite").parquet(f"{target}/v={n}")
        # Batch n can be tried again and then needs version n - 1; none before.
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/v={n - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
