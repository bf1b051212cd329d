"""Queries of the general data-pipeline problems over the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators.capture import capture_changes, final_reports
from treeline.operators.orphans import orphan_groups, orphan_rows, union_all
from treeline.operators.snapshot_diff import snapshot_changes
from treeline.plans.registry import query
from treeline.sources.tables import hex_key, month_no, table, tree_path

# ---------------------------------------------------------------- 2: new or changed records per run

RUNS_SQL = """
runs AS (SELECT run_id, arg_max(lower(project_instance_id), (logged_at, report_id)) pid, arg_max(registration_id, (logged_at, report_id)) reg,
  arg_max(status, (logged_at, report_id)) status, arg_max(started_at, (logged_at, report_id)) started_at FROM scan_runs WHERE run_id IS NOT NULL GROUP BY run_id),
good AS (SELECT run_id, pid, reg, started_at, lag(started_at) OVER (PARTITION BY pid, reg ORDER BY started_at, run_id) prev FROM runs
  WHERE status = 'succeeded' AND started_at IS NOT NULL),
recs AS (SELECT DISTINCT lower(project_instance_id) pid, registration_id reg, regexp_replace(replace(path, '\\', '/'), '^\\./', '') path,
  lower(content_hash) h, observed_at, arrived_at, record_id FROM node_scans WHERE content_hash IS NOT NULL AND path IS NOT NULL),
"""


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _worktree():
    """A worktree in 16 bytes: the repository's id hashed, the registration as it is."""
    return F.struct(F.xxhash64(hex_key("project_instance_id")).alias("p"), F.col("registration_id").alias("r"))


def scan_log(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "node_scans", "record_id", "project_instance_id", "registration_id", "path", "content_hash", "observed_at", "arrived_at")
    return df.select(
        _worktree().alias("part"),
        _micros("arrived_at").alias("offset"),
        tree_path("path").alias("key"),
        F.struct(_micros("observed_at").alias("at"), F.col("record_id")).alias("version"),
        # Half of a SHA-256 tells contents apart as well, in a quarter of its hex form.
        F.when(F.char_length("content_hash") == 64, F.unhex(F.substring(hex_key("content_hash"), 1, 32))).otherwise(hex_key("content_hash").cast("binary")).alias("value"),
    )


def scan_history(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "scan_runs", "report_id", "run_id", "project_instance_id", "registration_id", "status", "started_at", "logged_at")
    last = final_reports(df.where("run_id IS NOT NULL"), ["run_id"], ["logged_at", "report_id"])
    return last.select(
        _worktree().alias("part"),
        F.col("run_id").alias("run"),
        _micros("started_at").alias("to_offset"),
        (F.col("status") == "succeeded").alias("succeeded"),
        hex_key("project_instance_id").alias("project_instance_id"),
        "registration_id",
    )


@query("WITH " + RUNS_SQL + """
first_seen AS (SELECT g.run_id, g.started_at, r.* FROM good g JOIN recs r ON g.pid = r.pid AND g.reg = r.reg AND r.arrived_at <= g.started_at
  AND (g.prev IS NULL OR r.arrived_at > g.prev)),
per_run AS (SELECT pid, reg, path, run_id, started_at, max((observed_at, record_id, h)) s FROM first_seen GROUP BY ALL),
states AS (SELECT *, max(s) OVER (PARTITION BY pid, reg, path ORDER BY started_at, run_id) n,
  max(s) OVER (PARTITION BY pid, reg, path ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) o FROM per_run)
SELECT run_id, path FROM states WHERE o IS NULL OR n[3] <> o[3]""")
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Per succeeded run, the paths new or changed since the worktree's last succeeded run."""
    found = capture_changes(scan_log(spark, root), scan_history(spark, root))
    return found.select(F.col("run").alias("run_id"), F.col("key").alias("path"))


@query("WITH " + RUNS_SQL.rstrip().rstrip(",") + """
SELECT pid AS project_instance_id, reg AS registration_id, count(*) AS runs, count(*) FILTER (status = 'succeeded') AS succeeded,
  count(*) FILTER (status IS DISTINCT FROM 'succeeded') AS replayed FROM runs GROUP BY 1, 2""")
def p2_runs(spark: SparkSession, root: str) -> DataFrame:
    """Per worktree, runs and those whose range a later run replays."""
    h = scan_history(spark, root).groupBy("project_instance_id", "registration_id")
    ok = F.coalesce(F.col("succeeded"), F.lit(False))
    return h.agg(F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("replayed"))


# ---------------------------------------------------------------- 4: what changed between snapshots

SNAP_SQL = """
meta AS (SELECT snapshot_id, max((lower(project_instance_id), registration_id, source_generation, row_count)) m FROM snapshot_metadata GROUP BY 1),
snaps AS (SELECT snapshot_id, m[1] pid, m[2] reg, m[3] gen, m[4] row_count FROM meta),
listing AS (SELECT DISTINCT snapshot_id, regexp_replace(replace(path, '\\', '/'), '^\\./', '') path, kind, extension, language, size_bytes, lower(content_hash) h
  FROM node_snapshots WHERE path IS NOT NULL),
full_snaps AS (SELECT s.*, row_number() OVER (PARTITION BY pid, reg ORDER BY gen, s.snapshot_id) i FROM snaps s
  LEFT JOIN (SELECT snapshot_id, count(DISTINCT path) have FROM listing GROUP BY 1) c USING (snapshot_id) WHERE coalesce(have, 0) = row_count),
diffs AS (SELECT b.snapshot_id, coalesce(o.path, n.path) path, o.path IS NULL AS is_new, n.path IS NULL AS is_gone,
    (o.kind, o.extension, o.language, o.size_bytes, o.h) IS DISTINCT FROM (n.kind, n.extension, n.language, n.size_bytes, n.h) AS is_other
  FROM (SELECT f.snapshot_id sid, listing.* FROM full_snaps f JOIN full_snaps p ON f.pid = p.pid AND f.reg = p.reg AND f.i = p.i + 1 JOIN listing ON listing.snapshot_id = p.snapshot_id) o
  FULL JOIN (SELECT f.snapshot_id sid, listing.* FROM full_snaps f JOIN listing ON listing.snapshot_id = f.snapshot_id WHERE f.i > 1) n ON o.sid = n.sid AND o.path = n.path
  JOIN full_snaps b ON b.snapshot_id = coalesce(o.sid, n.sid))
"""


def worktree_changes(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "node_snapshots", "snapshot_id", "path", "kind", "extension", "language", "size_bytes", "content_hash").select(
        F.col("snapshot_id").alias("snapshot"), tree_path("path").alias("path"), "kind", "extension", "language", "size_bytes", hex_key("content_hash").alias("content_hash")
    )
    meta = table(spark, root, "snapshot_metadata", "snapshot_id", "project_instance_id", "registration_id", "source_generation", "row_count").select(
        F.col("snapshot_id").alias("snapshot"),
        F.struct(F.xxhash64(hex_key("project_instance_id")).alias("p"), F.col("registration_id").alias("r")).alias("series"),
        F.col("source_generation").alias("seq"),
        "row_count",
    )
    return snapshot_changes(rows, meta, "path", ["kind", "extension", "language", "size_bytes", "content_hash"])


@query("WITH " + SNAP_SQL + """SELECT snapshot_id, path, CASE WHEN is_new THEN 'added' WHEN is_gone THEN 'removed' ELSE 'changed' END AS change_type
  FROM diffs WHERE is_new OR is_gone OR is_other""")
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Paths added, removed or changed in each complete snapshot against the one before."""
    return worktree_changes(spark, root).withColumnRenamed("snapshot", "snapshot_id")


@query("WITH " + SNAP_SQL + """SELECT snapshot_id, count(*) FILTER (is_new) AS added, count(*) FILTER (is_gone) AS removed,
  count(*) FILTER (NOT is_new AND NOT is_gone) AS changed FROM diffs WHERE is_new OR is_gone OR is_other GROUP BY 1""")
def p4_counts(spark: SparkSession, root: str) -> DataFrame:
    """Change counts per snapshot that differs from the one before."""
    kind = lambda k: F.count_if(F.col("change_type") == k).alias(k)
    return worktree_changes(spark, root).groupBy(F.col("snapshot").alias("snapshot_id")).agg(kind("added"), kind("removed"), kind("changed"))


# ---------------------------------------------------------------- 5: references to records that do not exist

_KEYED = [("graph_entities", "entity_key", None), ("graph_relations", "relation_key", None), ("graph_entity_exports", "key_digest", "resolution_domain")]
_REFERENCES = [
    ("graph_relations", "relation_id", "source_entity_key", "graph_entities", None),
    ("graph_relations", "relation_id", "target_entity_key", "graph_entities", None),
    ("graph_entity_exports", "export_id", "entity_key", "graph_entities", None),
    ("graph_relation_dependencies", "dependency_id", "relation_key", "graph_relations", None),
    ("graph_relation_dependencies", "dependency_id", "key_digest", "graph_entity_exports", "resolution_domain"),
]


def _key_in(domain: str | None, key: str):
    """128 bits that stand for (repository, key[, domain]); null when the key is null."""
    parts = [hex_key("project_instance_id"), hex_key(key), F.col(domain) if domain else F.lit("")]
    whole = F.concat_ws("\x1f", *(F.coalesce(p, F.lit("\x1e")) for p in parts))
    return F.when(F.col(key).isNotNull(), F.unhex(F.substring(F.sha2(whole, 256), 1, 32)))


def graph_parents(spark: SparkSession, root: str) -> DataFrame:
    return union_all([
        table(spark, root, t, *filter(None, ("project_instance_id", key, domain, "staged_at", "removed_at")))
        .select(F.lit(i).alias("target"), _key_in(domain, key).alias("key"), month_no("staged_at").alias("live_from"), F.greatest(month_no("removed_at"), month_no("staged_at")).alias("live_until"), F.col("removed_at").isNull().alias("stays"))
        .withColumn("live_until", F.when(~F.col("stays"), F.col("live_until")))
        .where("live_from IS NOT NULL").drop("stays")
        for i, (t, key, domain) in enumerate(_KEYED)
    ])


def graph_references(spark: SparkSession, root: str) -> DataFrame:
    number = {t: i for i, (t, _, _) in enumerate(_KEYED)}
    return union_all([
        table(spark, root, t, *filter(None, ("project_instance_id", row_id, field, domain, "staged_at")))
        .select(F.lit(number[target]).alias("target"), _key_in(domain, field).alias("key"), month_no("staged_at").alias("period"), F.lit(i).alias("ref"), F.col(row_id).alias("row_id"))
        .where("key IS NOT NULL")
        for i, (t, row_id, field, target, domain) in enumerate(_REFERENCES)
    ])


def _named(df: DataFrame) -> DataFrame:
    pick = lambda k: F.element_at(F.array(*(F.lit(r[k]) for r in _REFERENCES)), F.col("ref") + 1)
    return df.select(pick(0).alias("table_name"), "*", pick(2).alias("field_name"))


REFS_SQL = """
refs AS (
  SELECT 'graph_relations' table_name, relation_id row_id, 'source_entity_key' field_name, 0 target, lower(project_instance_id) pid, lower(source_entity_key) k, '' dom, staged_at FROM graph_relations
  UNION ALL SELECT 'graph_relations', relation_id, 'target_entity_key', 0, lower(project_instance_id), lower(target_entity_key), '', staged_at FROM graph_relations
  UNION ALL SELECT 'graph_entity_exports', export_id, 'entity_key', 0, lower(project_instance_id), lower(entity_key), '', staged_at FROM graph_entity_exports
  UNION ALL SELECT 'graph_relation_dependencies', dependency_id, 'relation_key', 1, lower(project_instance_id), lower(relation_key), '', staged_at FROM graph_relation_dependencies
  UNION ALL SELECT 'graph_relation_dependencies', dependency_id, 'key_digest', 2, lower(project_instance_id), lower(key_digest), resolution_domain, staged_at FROM graph_relation_dependencies),
targets AS (
  SELECT 0 target, lower(project_instance_id) pid, lower(entity_key) k, '' dom, staged_at, removed_at FROM graph_entities
  UNION ALL SELECT 1, lower(project_instance_id), lower(relation_key), '', staged_at, removed_at FROM graph_relations
  UNION ALL SELECT 2, lower(project_instance_id), lower(key_digest), resolution_domain, staged_at, removed_at FROM graph_entity_exports),
found AS (SELECT DISTINCT table_name, row_id, field_name, year(staged_at) * 12 + month(staged_at) - 1 AS period FROM refs r WHERE k IS NOT NULL AND staged_at IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM targets t WHERE t.target = r.target AND t.pid = r.pid AND t.k = r.k AND t.dom = r.dom
    AND t.staged_at < date_trunc('month', r.staged_at) + INTERVAL 1 MONTH AND (t.removed_at IS NULL OR t.removed_at >= date_trunc('month', r.staged_at) + INTERVAL 1 MONTH)))
"""


@query("WITH " + REFS_SQL + "SELECT DISTINCT table_name, row_id, field_name FROM found")
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """References to entities, relations and exports that are not live at the end of the reference's month."""
    rows = orphan_rows(graph_references(spark, root), graph_parents(spark, root), ["ref", "row_id"])
    return _named(rows).select("table_name", "row_id", "field_name")


@query("WITH " + REFS_SQL + "SELECT table_name, field_name, cast(period // 12 AS INT) AS year, cast(period % 12 + 1 AS INT) AS month, count(DISTINCT row_id) AS orphans FROM found GROUP BY ALL")
def p5_counts(spark: SparkSession, root: str) -> DataFrame:
    """Orphan references per table, field and month."""
    rows = orphan_rows(graph_references(spark, root), graph_parents(spark, root), ["ref", "row_id", "period"])
    sums = rows.groupBy("ref", "period").agg(F.count_distinct("row_id").alias("orphans"))
    return _named(sums).select("table_name", "field_name", F.floor(F.col("period") / 12).cast("int").alias("year"), (F.col("period") % 12 + 1).cast("int").alias("month"), "orphans")
