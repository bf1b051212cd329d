"""What the operators of this package share: current files and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.sources.tables import hex_key, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query of this package under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def file_key(df: DataFrame) -> DataFrame:
    """Adds ``fk``, 128 bits that stand for (repository, path, content hash), null if one of them is."""
    whole = F.concat(hex_key("project_instance_id"), F.lit("\x1f"), F.col("path"), F.lit("\x1f"), hex_key("content_hash"))
    return df.withColumn("fk", F.unhex(F.substring(F.sha2(whole, 256), 1, 32)))


def current_nodes(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Files that exist now, one row per node_id: node_id, fk and the named columns."""
    need = dict.fromkeys(("node_id", "project_instance_id", "path", "content_hash", "kind", "exists_now", *columns))
    df = file_key(table(spark, root, "nodes", *need).where("kind = 'file' AND exists_now"))
    rest = list(dict.fromkeys(("fk", "path", *columns)))
    # Rows of one node that agree are repeats; where they don't, each may be backed by a text.
    return df.where("node_id IS NOT NULL AND fk IS NOT NULL").groupBy("node_id", "fk").agg(*(F.max(c).alias(c) for c in rest if c != "fk"))


def texts(spark: SparkSession, root: str, where: Column | None = None) -> DataFrame:
    """Stored texts as (fk, path, content), straight from the scan: texts are never shuffled."""
    df = table(spark, root, "file_texts", "project_instance_id", "path", "content_hash", "content")
    if where is not None:
        df = df.where(where)
    return file_key(df).where("fk IS NOT NULL AND content IS NOT NULL").select("fk", "path", "content")


def extension() -> Column:
    """Lower-case extension of ``path`` with its dot, empty without one."""
    return F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
