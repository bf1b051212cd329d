"""Reading the stored tables and the places the session shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """The stored table, cut to the named columns at once.

    Cutting first keeps the scan narrow and shuts out extra columns whose names
    would clash with those an operator derives.
    """
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset and everything runs in one process (tests), a temporary folder is used; on a cluster, executors
    would each write to their own disk, so that is refused.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="treeline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: smaller than a checkpoint of wide rows.

    The table is removed when the driver's JVM ends.
    """
    return written_counting(df)[0]


def written_counting(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``written``, with aggregates over the rows that the write itself takes, so that no further job has to."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    seen = Observation() if metrics else None
    (df.observe(seen, *(v.alias(k) for k, v in metrics.items())) if metrics else df).write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), seen.get if metrics else {}


def hex_key(col: Column | str) -> Column:
    """Hex keys mean the same in either letter case; blank is no key."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(c)


def tree_path(col: Column | str) -> Column:
    """One spelling of a path: slashes for backslashes, one leading ``./`` dropped."""
    c = F.translate(F.col(col) if isinstance(col, str) else col, "\\", "/")
    return F.regexp_replace(c, r"^\./", "")


def month_no(col: Column | str) -> Column:
    """Calendar months since year 0, so that months compare as integers."""
    return F.year(col) * 12 + F.month(col) - 1


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by keys if its scan has no more pieces than half the cores; unchanged otherwise.

    For the texts that Python reads token by token: one small file that can't be split would keep a single core busy. Where there is
    a piece for most cores, as with any large table, nothing is moved. The rows are the same either way. Plans with an exchange are left
    as they are: their pieces are known only once they ran.
    """
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if plan.executedPlan().nodeName().startswith("Adaptive"):
        return df
    return df.repartition(cores, *keys) if 2 * plan.toRdd().getNumPartitions() <= cores else df
