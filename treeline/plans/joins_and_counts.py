"""Queries of the remaining joins, counts, rankings and cascades over the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions.text import framed
from treeline.operators import graph as G
from treeline.operators.changes import set_digest
from treeline.plans.graph_queries import _EDGES, _LIVE, _live_dependencies, anchors, links, vertices
from treeline.plans.index_tables import ENTITIES, NODES, RELATIONS, TEXTS, entities, from_latest_texts, latest_states, nodes, relations
from treeline.functions.languages import CLASS_OF, lookup
from treeline.plans.registry import query
from treeline.plans.search_and_sets import _LANES_SQL, _PURPOSES, purposes
from treeline.plans.usage_queries import _EV, calls
from treeline.sources.tables import checkpointed, hex_key, table

c = F.col


@query(f"WITH {_PURPOSES}, {TEXTS} SELECT node.pid, node.path, node.language, purpose.status, length(txt.content) AS chars FROM node JOIN purpose USING (pid, path) LEFT JOIN txt USING (pid, path) WHERE node.kind = 'file'")
def s080_indexed_nodes(spark: SparkSession, root: str) -> DataFrame:
    """Files with purpose and text, where they have one."""
    n = nodes(spark, root).where("kind = 'file'").select("pid", "path", "language")
    t = from_latest_texts(spark, root, lambda x: x.select("pid", "path", "_k", F.char_length("content").alias("chars")))
    return n.join(purposes(spark, root).select("pid", "path", "status"), ["pid", "path"]).join(t, ["pid", "path"], "left")


@query(f"WITH {_EV}, dim AS (SELECT DISTINCT command, layer, md5(command || ':' || layer) AS dimension_id FROM ev), fact AS (SELECT md5(command || ':' || layer) AS dimension_id, without_tokens FROM ev) SELECT command, layer, count(*) AS calls, sum(without_tokens)::BIGINT AS without_tokens FROM fact JOIN dim USING (dimension_id) GROUP BY 1, 2")
def s081_star_join(spark: SparkSession, root: str) -> DataFrame:
    """Facts joined with their dimension by its key."""
    e = calls(spark, root).withColumn("dimension_id", F.md5(F.concat_ws(":", "command", "layer")))
    dim = e.select("dimension_id", "command", "layer").distinct()
    return e.select("dimension_id", "without_tokens").join(dim, "dimension_id").groupBy("command", "layer").agg(F.count(F.lit(1)).alias("calls"), F.sum("without_tokens").alias("without_tokens"))


@query(f"WITH {_EV} SELECT strftime(ts, '%Y-%m') AS period, count(*) AS calls, sum(without_tokens)::BIGINT AS without_tokens, sum(without_tokens)::BIGINT - sum(with_tokens)::BIGINT AS saved FROM ev GROUP BY 1")
def s126_period_totals(spark: SparkSession, root: str) -> DataFrame:
    return calls(spark, root).groupBy(F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("calls"), F.sum("without_tokens").alias("without_tokens"), F.sum(c("without_tokens") - c("with_tokens")).alias("saved"))


@query(f"WITH {_EV}, d AS (SELECT session, sum(without_tokens) w, sum(with_tokens) s FROM ev GROUP BY 1) SELECT session, greatest(w - s, 0)::BIGINT AS gained, greatest(s - w, 0)::BIGINT AS lost FROM d")
def s120_delta_pair(spark: SparkSession, root: str) -> DataFrame:
    """A signed difference as a pair that is not negative."""
    g = calls(spark, root).groupBy("session").agg(F.sum(c("without_tokens") - c("with_tokens")).alias("d"))
    return g.select("session", F.greatest("d", F.lit(0)).alias("gained"), F.greatest(-c("d"), F.lit(0)).alias("lost"))


@query(f"WITH {_EV}, s AS (SELECT session, max(sec) last FROM (SELECT session, tick AS sec FROM ev) GROUP BY 1) SELECT session, last AS last_seen, row_number() OVER (ORDER BY last, session)::INT AS eviction FROM s QUALIFY eviction <= 25")
def s182_oldest_first(spark: SparkSession, root: str) -> DataFrame:
    """The 25 sessions an eviction takes first: those unseen for longest."""
    s = calls(spark, root).groupBy("session").agg(F.max("at").alias("last_seen")).orderBy("last_seen", "session").limit(25)
    return s.withColumn("eviction", F.row_number().over(W.orderBy("last_seen", "session")))


@query(f"WITH {_EV}, d AS (SELECT command, tick // 86400 AS day, count(*) n FROM ev GROUP BY 1, 2) SELECT command, day, n FROM d WHERE day >= (SELECT max(day) FROM d) - 10")
def s184_daily_prune(spark: SparkSession, root: str) -> DataFrame:
    """Daily rows of the last ten days."""
    d = calls(spark, root).groupBy("command", F.floor(c("at") / 86_400).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = d.agg(F.max("day").alias("last"))
    return d.join(F.broadcast(last), c("day") >= c("last") - 10).drop("last")


@query(f"WITH {ENTITIES}, w AS (SELECT lower(project_instance_id) pid, scope_path AS path, max(CASE WHEN state IN ('complete', 'no_candidates') THEN 0 WHEN state = 'partial' THEN 1 ELSE 2 END) t FROM graph_coverage GROUP BY 1, 2) SELECT ent.pid, ent.k, CASE WHEN path IS NULL THEN NULL ELSE coalesce(t, 2) END AS trust FROM ent LEFT JOIN w USING (pid, path)")
def s094_coverage_join(spark: SparkSession, root: str) -> DataFrame:
    """Trust of each entity's file: 0 trusted, 1 partial, 2 untrusted or unknown; null for entities without file."""
    t = F.when(c("state").isin("complete", "no_candidates"), 0).when(c("state") == "partial", 1).otherwise(2)
    w = table(spark, root, "graph_coverage", "project_instance_id", "scope_path", "state").groupBy(hex_key("project_instance_id").alias("pid"), c("scope_path").alias("path")).agg(F.max(t).alias("t"))
    return entities(spark, root).join(w, ["pid", "path"], "left").select("pid", "k", F.when(c("path").isNotNull(), F.coalesce("t", F.lit(2))).alias("trust"))


_CLASS_SQL = "CASE " + " ".join(f"WHEN language = '{k}' THEN '{v}'" for k, v in CLASS_OF.items()) + " END"


@query(f"WITH {ENTITIES}, {NODES} SELECT ent.pid, ent.kind, {_CLASS_SQL} AS class, count(*) AS entities FROM ent JOIN node ON node.pid = ent.pid AND node.path = ent.path GROUP BY ALL")
def s096_class_join(spark: SparkSession, root: str) -> DataFrame:
    """Entities by the class of their file."""
    n = nodes(spark, root).select("pid", "path", lookup(c("language"), CLASS_OF).alias("class"))
    return entities(spark, root).join(n, ["pid", "path"]).groupBy("pid", "kind", "class").agg(F.count(F.lit(1)).alias("entities"))


@query(f"WITH {ENTITIES}, {RELATIONS} SELECT rel.pid, rk, s.path AS source_path, t.path AS target_path FROM rel JOIN ent s ON s.pid = rel.pid AND s.k = rel.src JOIN ent t ON t.pid = rel.pid AND t.k = rel.dst")
def s090_hydration(spark: SparkSession, root: str) -> DataFrame:
    """Resolved relations with the paths of both ends."""
    e = entities(spark, root)
    return relations(spark, root).join(e.select("pid", c("k").alias("src"), c("path").alias("source_path")), ["pid", "src"]).join(e.select("pid", c("k").alias("dst"), c("path").alias("target_path")), ["pid", "dst"]).select("pid", "rk", "source_path", "target_path")


@query(f"WITH {_EDGES}, a AS (SELECT pid, min(src) AS node FROM dep GROUP BY 1) SELECT r.pid, r.rk, r.kind FROM (SELECT pid, rk, src, kind FROM rel UNION SELECT pid, rk, src, kind FROM rel) r JOIN a ON a.pid = r.pid AND a.node = r.src")
def s089_adjacency(spark: SparkSession, root: str) -> DataFrame:
    """Outbound relations of each repository's anchor."""
    a = anchors(links(spark, root, ["imports", "calls", "depends-on", "tests", "routes-to", "configures"])).withColumnRenamed("node", "src")
    return relations(spark, root).select("pid", "rk", "src", "kind").distinct().join(a, ["pid", "src"]).select("pid", "rk", "kind")


@query(f"""WITH RECURSIVE {_EDGES}, a AS (SELECT pid, min(src) AS node FROM dep GROUP BY 1), w AS (SELECT pid, node, 0 AS h FROM a UNION SELECT w.pid, dep.dst, h + 1 FROM w JOIN dep ON dep.pid = w.pid AND dep.src = w.node WHERE h < 3), v AS (SELECT DISTINCT pid, node FROM w)
SELECT rel.pid, count(*) AS outbound, count(*) FILTER (EXISTS (SELECT 1 FROM v x WHERE x.pid = rel.pid AND x.node = rel.dst)) AS inner_edges, count(*) FILTER (rel.resolution IN ('ambiguous', 'unresolved')) AS gaps FROM rel JOIN v ON v.pid = rel.pid AND v.node = rel.src GROUP BY 1""")
def s261_closure(spark: SparkSession, root: str) -> DataFrame:
    """Outbound relations of the nodes near the anchor: how many stay among them, how many lead nowhere."""
    e = links(spark, root, ["imports", "calls", "depends-on", "tests", "routes-to", "configures"])
    v = G.bounded_bfs(e, anchors(e), 3).select("pid", "node")
    out = relations(spark, root).join(v.withColumnRenamed("node", "src"), ["pid", "src"]).join(v.select("pid", c("node").alias("dst"), F.lit(1).alias("within")), ["pid", "dst"], "left")
    return out.groupBy("pid").agg(F.count(F.lit(1)).alias("outbound"), F.count("within").alias("inner_edges"), F.count_if(c("resolution").isin("ambiguous", "unresolved")).alias("gaps"))


@query(f"""WITH RECURSIVE {_EDGES}, {_LIVE}, a AS (SELECT pid, min(src) AS s, max(dst) AS t FROM live GROUP BY 1), w AS (SELECT pid, s AS node, 0 AS h FROM a UNION SELECT w.pid, live.dst, h + 1 FROM w JOIN live ON live.pid = w.pid AND live.src = w.node WHERE h < 8)
SELECT a.pid, a.t AS target, min(h) AS hops, CASE WHEN min(h) IS NULL THEN 'absent' ELSE 'confirmed' END AS status FROM a LEFT JOIN w ON w.pid = a.pid AND w.node = a.t GROUP BY 1, 2""")
def s271_trace(spark: SparkSession, root: str) -> DataFrame:
    """Steps from each repository's first to its last dependency; 'absent' if no way of any length leads there. The SQL form stops at eight steps."""
    e = checkpointed(_live_dependencies(spark, root)[1])
    ends = e.groupBy("pid").agg(F.min("src").alias("node"), F.max("dst").alias("target"))
    seen = G.bounded_bfs(e, ends.select("pid", "node")).withColumnRenamed("node", "target")
    return ends.select("pid", "target").join(seen, ["pid", "target"], "left").select("pid", "target", "hops", F.when(c("hops").isNull(), "absent").otherwise("confirmed").alias("status"))


@query(f"WITH {ENTITIES}, {RELATIONS}, m AS (SELECT pid, name, count(*) n FROM ent WHERE kind = 'symbol' AND name IS NOT NULL GROUP BY 1, 2) SELECT pid, name, n AS copies, n = 1 AS is_unique FROM m")
def s139_name_counts(spark: SparkSession, root: str) -> DataFrame:
    e = entities(spark, root).where("kind = 'symbol' AND name IS NOT NULL").groupBy("pid", "name").agg(F.count(F.lit(1)).alias("copies"))
    return e.withColumn("is_unique", c("copies") == 1)


@query(f"WITH {_PURPOSES}, i AS (SELECT pid, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS path, sha256(length(path)::VARCHAR || ':' || path || ';' || length(purpose)::VARCHAR || ':' || purpose || ';') h FROM purpose), g AS (SELECT pid, path, count(*) n, {_LANES_SQL} FROM i GROUP BY 1, 2) SELECT pid, path, n AS children, sha256(concat_ws('.', n, s0, s1, s2, s3, s4)) AS digest FROM g")
def s145_folder_hash(spark: SparkSession, root: str) -> DataFrame:
    """Digest of each folder's children and their purposes."""
    p = purposes(spark, root).select("pid", P.parent(c("path")).alias("folder"), framed(c("path"), c("purpose")).alias("child"))
    return p.groupBy("pid", c("folder").alias("path")).agg(F.count(F.lit(1)).alias("children"), set_digest(c("child")).alias("digest"))


@query(f"WITH {NODES}, k AS (SELECT pid, path, CASE WHEN extension IN ('.css', '.md') THEN 'asset' WHEN regexp_extract(path, '^[^/]*') IN ('src', 'lib', 'app') THEN 'allowed' ELSE 'disallowed' END AS verdict FROM node WHERE kind = 'file') SELECT pid, verdict, count(*) AS files FROM k GROUP BY 1, 2")
def s144_untracked(spark: SparkSession, root: str) -> DataFrame:
    """Files by the verdict of a policy on untracked ones."""
    verdict = F.when(c("extension").isin(".css", ".md"), "asset").when(F.regexp_extract("path", "^[^/]*", 0).isin("src", "lib", "app"), "allowed").otherwise("disallowed")
    return nodes(spark, root).where("kind = 'file'").groupBy("pid", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {NODES}, {TEXTS}, d AS (SELECT node.pid, node.path, txt.path IS NULL AS fresh, node.content_hash IS DISTINCT FROM txt.content_hash AS other, size_bytes FROM node LEFT JOIN txt USING (pid, path) WHERE kind = 'file') SELECT pid, count(*) FILTER (fresh) AS added, count(*) FILTER (NOT fresh AND other) AS modified, coalesce(sum(size_bytes) FILTER (fresh OR other), 0)::BIGINT AS changed_bytes, CASE WHEN count(*) FILTER (fresh OR other) * 5 > count(*) THEN 'full' ELSE 'incremental' END AS plan FROM d GROUP BY 1")
def s147_delta_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts of what differs from the indexed texts, and whether a full scan is due."""
    t = latest_states(spark, root).select("pid", "path", c("content_hash").alias("h"), F.lit(True).alias("known"))
    d = nodes(spark, root).where("kind = 'file'").join(t, ["pid", "path"], "left")
    new, other = c("known").isNull(), ~c("content_hash").eqNullSafe(c("h"))
    moved = F.count_if(new | other)
    return d.groupBy("pid").agg(F.count_if(new).alias("added"), F.count_if(~new & other).alias("modified"), F.coalesce(F.sum(F.when(new | other, c("size_bytes"))), F.lit(0)).alias("changed_bytes"), F.when(moved * 5 > F.count(F.lit(1)), "full").otherwise("incremental").alias("plan"))


@query(f"WITH {NODES}, k AS (SELECT pid, path, row_number() OVER (PARTITION BY pid ORDER BY path) i FROM node WHERE NOT exists_now) SELECT pid, path FROM k WHERE i <= 8")
def s189_sample(spark: SparkSession, root: str) -> DataFrame:
    """The first eight vanished paths of each repository."""
    w = W.partitionBy("pid").orderBy("path")
    return nodes(spark, root).where("NOT exists_now").withColumn("i", F.row_number().over(w)).where("i <= 8").select("pid", "path")


@query(f"WITH {ENTITIES}, {RELATIONS}, r AS (SELECT rk, max((coalesce(candidate_count, 0), pid, kind, src)) s, count(*) n FROM rel GROUP BY 1) SELECT rk, s[1] AS candidates, s[3] AS kind, n AS copies FROM r")
def s180_one_per_key(spark: SparkSession, root: str) -> DataFrame:
    """One row per relation key: of rows that disagree, the one with more candidates."""
    r = relations(spark, root).groupBy("rk").agg(F.max(F.struct(F.coalesce("candidate_count", F.lit(0)).alias("candidates"), "pid", "kind", "src")).alias("s"), F.count(F.lit(1)).alias("copies"))
    return r.select("rk", "s.candidates", "s.kind", "copies")


@query("SELECT DISTINCT coverage_id, lower(project_instance_id) AS pid, scope_path, state FROM graph_coverage WHERE state IN ('partial', 'failed', 'stale') AND starts_with(scope_path, 'src/')")
def s277_coverage_filters(spark: SparkSession, root: str) -> DataFrame:
    """Coverage records of some states below a folder."""
    t = table(spark, root, "graph_coverage", "coverage_id", "project_instance_id", "scope_path", "state").where(c("state").isin("partial", "failed", "stale") & c("scope_path").startswith("src/"))
    return t.select("coverage_id", hex_key("project_instance_id").alias("pid"), "scope_path", "state").distinct()


@query(f"WITH {_PURPOSES}, {_EDGES} SELECT pid, status, source, CASE WHEN status = 'missing' THEN 1 WHEN status = 'stale' THEN 2 WHEN status = 'suggested' THEN 3 WHEN source <> 'agent' THEN 4 ELSE 5 END AS priority, count(*) AS nodes FROM purpose GROUP BY ALL")
def s239_review_signal(spark: SparkSession, root: str) -> DataFrame:
    """Review priority of purposes by the first condition that holds."""
    first = F.when(c("status") == "missing", 1).when(c("status") == "stale", 2).when(c("status") == "suggested", 3).when(c("source") != "agent", 4).otherwise(5)
    return purposes(spark, root).groupBy("pid", "status", "source", first.alias("priority")).agg(F.count(F.lit(1)).alias("nodes"))


@query(f"WITH {_EDGES}, d AS (SELECT pid, node, count(*) n FROM (SELECT pid, unnest([src, dst]) AS node FROM edge) GROUP BY ALL) SELECT pid, node, n AS degree FROM d JOIN node_ USING (pid, node) QUALIFY row_number() OVER (PARTITION BY pid ORDER BY n DESC, node) = 1")
def s179_bottleneck(spark: SparkSession, root: str) -> DataFrame:
    """The live entity of greatest degree in each repository."""
    d = G.degrees(vertices(spark, root), links(spark, root)).where("degree > 0")
    return d.groupBy("pid").agg(F.min_by(F.struct("node", "degree"), F.struct(-c("degree"), "node")).alias("b")).select("pid", "b.node", "b.degree")
