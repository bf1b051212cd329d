"""The index tables as queries use them, in Spark and in SQL: repeated rows once, keys in one spelling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.text import framed
from treeline.sources.tables import hex_key, table

# Each file or folder of a repository, its last state.
NODES = """n AS (SELECT lower(project_instance_id) AS pid, path, max((last_seen_at, node_id, kind, lower(extension), language, size_bytes, lower(content_hash), exists_now)) AS s FROM nodes WHERE path IS NOT NULL GROUP BY 1, 2),
node AS (SELECT pid, path, s[2] AS node_id, s[3] AS kind, s[4] AS extension, s[5] AS language, s[6] AS size_bytes, s[7] AS content_hash, s[8] AS exists_now FROM n)"""


def nodes(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "nodes", "node_id", "project_instance_id", "path", "kind", "extension", "language", "size_bytes", "content_hash", "exists_now", "last_seen_at")
    state = F.struct("last_seen_at", "node_id", "kind", F.lower("extension").alias("extension"), "language", "size_bytes", hex_key("content_hash").alias("content_hash"), "exists_now")
    one = df.where("path IS NOT NULL").groupBy(hex_key("project_instance_id").alias("pid"), "path").agg(F.max(state).alias("s"))
    return one.select("pid", "path", "s.*").drop("last_seen_at")


TEXTS = """t AS (SELECT lower(project_instance_id) AS pid, path, max((updated_at, lower(content_hash), content)) AS s FROM file_texts WHERE path IS NOT NULL AND content IS NOT NULL GROUP BY 1, 2),
txt AS (SELECT pid, path, s[2] AS content_hash, s[3] AS content FROM t)"""


def _stored(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Rows of the text table with their version; the texts themselves are read only where ``content`` is asked for, nulls then left out."""
    df = table(spark, root, "file_texts", "project_instance_id", "path", "content_hash", "updated_at", *columns).where("path IS NOT NULL")
    df = df.where("content IS NOT NULL") if "content" in columns else df
    pid, h = hex_key("project_instance_id"), hex_key("content_hash")
    return df.select(pid.alias("pid"), "path", h.alias("content_hash"), "updated_at", *columns)


def _version() -> Column:
    return F.unhex(F.md5(framed(F.col("pid"), F.col("path"), F.unix_micros(F.col("updated_at").cast("timestamp")).cast("string"), F.col("content_hash")))).alias("_k")


def latest_states(spark: SparkSession, root: str) -> DataFrame:
    """(pid, path, content_hash, _k) of the last version of each path, without the texts: their column is not read.

    A version whose text is null is one all the same; where it is the last, the path has no text.
    """
    one = _stored(spark, root).groupBy("pid", "path").agg(F.max(F.struct("updated_at", "content_hash")).alias("s"))
    return one.select("pid", "path", "s.*").select("pid", "path", "content_hash", _version())


def from_latest_texts(spark: SparkSession, root: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``derive`` makes of the last text of each path.

    derive gets (pid, path, _k, content) straight from the scan and must keep ``_k``. It runs on every stored version and its
    rows, not the texts, are joined with the versions that are the last, so texts never pass an exchange and filters on them
    stay above the scan. Repeated rows count once. Rows of equal time and hash are taken to hold the same text.
    """
    rows = derive(_stored(spark, root, "content").select("pid", "path", _version(), "content"))
    last = latest_states(spark, root).select("_k")
    return rows.join(last, "_k", "left_semi").distinct().drop("_k")


# Live entities and relations.
ENTITIES = """ent AS (SELECT DISTINCT lower(project_instance_id) AS pid, lower(entity_key) AS k, entity_kind AS kind, repository_path AS path, symbol_name AS name, symbol_kind, symbol_parent, symbol_signature AS signature, external_system, external_identity
  FROM graph_entities WHERE removed_at IS NULL AND entity_key IS NOT NULL)"""
RELATIONS = """rel AS (SELECT DISTINCT lower(project_instance_id) AS pid, lower(relation_key) AS rk, lower(source_entity_key) AS src, lower(target_entity_key) AS dst, relation_scope AS scope, relation_kind AS kind,
  resolution_status AS resolution, reference_text AS ref, candidate_count, confidence, completeness FROM graph_relations WHERE removed_at IS NULL AND relation_key IS NOT NULL)"""


def entities(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "graph_entities", "entity_key", "project_instance_id", "entity_kind", "repository_path", "symbol_name", "symbol_kind", "symbol_parent", "symbol_signature", "external_system", "external_identity", "removed_at")
    return df.where("removed_at IS NULL AND entity_key IS NOT NULL").select(
        hex_key("project_instance_id").alias("pid"), hex_key("entity_key").alias("k"), F.col("entity_kind").alias("kind"), F.col("repository_path").alias("path"), F.col("symbol_name").alias("name"), "symbol_kind", "symbol_parent",
        F.col("symbol_signature").alias("signature"), "external_system", "external_identity",
    ).distinct()


def relations(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "graph_relations", "relation_key", "project_instance_id", "source_entity_key", "target_entity_key", "relation_scope", "relation_kind", "resolution_status", "reference_text", "candidate_count", "confidence", "completeness", "removed_at")
    return df.where("removed_at IS NULL AND relation_key IS NOT NULL").select(
        hex_key("project_instance_id").alias("pid"), hex_key("relation_key").alias("rk"), hex_key("source_entity_key").alias("src"), hex_key("target_entity_key").alias("dst"), F.col("relation_scope").alias("scope"),
        F.col("relation_kind").alias("kind"), F.col("resolution_status").alias("resolution"), F.col("reference_text").alias("ref"), "candidate_count", "confidence", "completeness",
    ).distinct()
