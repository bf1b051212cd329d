"""Queries that analyse the graph as a whole, across repositories, and after changes; and the stages of a publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.operators import graph as G
from treeline.operators.changes import replace_paths
from treeline.plans.graph_queries import _EDGES, _EXPORTS, _LIVE, DEPENDENCY, anchors, dependencies, exports, links, vertices
from treeline.plans.index_tables import ENTITIES, NODES, RELATIONS, TEXTS, entities, latest_states, nodes, relations
from treeline.plans.predicates import _in
from treeline.plans.registry import query
from treeline.plans.search_and_sets import _PURPOSES, purposes
from treeline.sources.tables import checkpointed, hex_key, table

c = F.col
ONE = lambda name: F.count(F.lit(1)).alias(name)


def live_links(spark: SparkSession, root: str, contained: bool = True, kinds: list[str] | None = None) -> DataFrame:
    """Edges whose both ends are live entities."""
    v = vertices(spark, root)
    r = relations(spark, root).where("src IS NOT NULL AND dst IS NOT NULL")
    r = r if contained else r.where("kind <> 'contains'")
    r = r.where(c("kind").isin(kinds)) if kinds else r
    e = r.select("pid", "src", "dst").distinct()
    return e.join(v.withColumnRenamed("node", "src"), ["pid", "src"], "left_semi").join(v.withColumnRenamed("node", "dst"), ["pid", "dst"], "left_semi")


_FREE = "free AS (SELECT DISTINCT rel.pid, src, dst FROM rel JOIN node_ a ON a.pid = rel.pid AND a.node = rel.src JOIN node_ b ON b.pid = rel.pid AND b.node = rel.dst WHERE kind <> 'contains')"
_REACHED = "u AS (SELECT pid, src, dst FROM {e} UNION SELECT pid, dst, src FROM {e}), reach AS (SELECT pid, node, node AS seen FROM node_ UNION SELECT r.pid, r.node, u.dst FROM reach r JOIN u ON u.pid = r.pid AND u.src = r.seen), comp AS (SELECT pid, node, min(seen) AS component FROM reach GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_EDGES}, {_FREE}, " + _REACHED.format(e="free") + " SELECT pid, component AS community, count(*) AS size FROM comp GROUP BY 1, 2 HAVING count(*) > 1")
def s265_communities(spark: SparkSession, root: str) -> DataFrame:
    """Groups of entities that belong together by relations other than containment, with their sizes."""
    comp = G.weak_components(vertices(spark, root), live_links(spark, root, contained=False))
    return comp.groupBy("pid", c("component").alias("community")).agg(ONE("size")).where("size > 1")


@query(f"WITH RECURSIVE {_EDGES}, {_LIVE}, " + _REACHED.format(e="liveu") + ", s AS (SELECT pid, component, count(*) size FROM comp GROUP BY 1, 2), e AS (SELECT pid, count(*) edges FROM liveu GROUP BY 1), d AS (SELECT pid, node, count(*) n FROM (SELECT pid, unnest([src, dst]) node FROM liveu) GROUP BY 1, 2), m AS (SELECT pid, max(n) degree FROM d GROUP BY 1) SELECT s.pid, count(*) AS components, sum(size)::BIGINT AS nodes, max(size) AS largest, coalesce(max(edges), 0) AS edges, coalesce(max(degree), 0) AS degree FROM s LEFT JOIN e USING (pid) LEFT JOIN m USING (pid) GROUP BY 1")
def s264_architecture(spark: SparkSession, root: str) -> DataFrame:
    """Shape of each repository's graph: components, nodes, the largest component, edges (262), greatest degree."""
    v, e = vertices(spark, root), live_links(spark, root)
    s = G.weak_components(v, e).groupBy("pid", "component").agg(ONE("size")).groupBy("pid").agg(ONE("components"), F.sum("size").alias("nodes"), F.max("size").alias("largest"))
    n, m = e.groupBy("pid").agg(ONE("edges")), G.degrees(v, e).groupBy("pid").agg(F.max("degree").alias("degree"))
    out = s.join(n, "pid", "left").join(m, "pid", "left")
    return out.select("pid", "components", "nodes", "largest", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("degree", F.lit(0)).alias("degree"))


@query(f"WITH {ENTITIES}, {RELATIONS}, s AS (SELECT DISTINCT pid, k FROM ent), o AS (SELECT rel.pid, rel.src, rel.dst, rel.resolution FROM rel JOIN s ON s.pid = rel.pid AND s.k = rel.src) SELECT pid, count(DISTINCT src) AS sources, count(*) AS relations, count(DISTINCT (src, dst)) FILTER (dst IS NOT NULL AND resolution = 'resolved') AS edges FROM o GROUP BY 1")
def s262_collected(spark: SparkSession, root: str) -> DataFrame:
    """Nodes and resolved edges that the relations of live entities bring together."""
    s = entities(spark, root).select("pid", c("k").alias("src")).distinct()
    o = relations(spark, root).join(s, ["pid", "src"])
    ends = o.where("dst IS NOT NULL AND resolution = 'resolved'").select("pid", "src", "dst").distinct().groupBy("pid").agg(ONE("edges"))
    g = o.groupBy("pid").agg(F.count_distinct("src").alias("sources"), ONE("relations"))
    return g.join(ends, "pid", "left").select("pid", "sources", "relations", F.coalesce("edges", F.lit(0)).alias("edges"))


@query(f"WITH RECURSIVE {_EDGES}, {_LIVE}, " + _REACHED.format(e="liveu") + f""", {_PURPOSES}, m AS (SELECT DISTINCT comp.pid, comp.component, e.path, CASE WHEN p.status = 'approved' AND p.source = 'agent' THEN p.purpose END AS purpose FROM comp JOIN (SELECT DISTINCT pid, k, path FROM ent) e ON e.pid = comp.pid AND e.k = comp.node LEFT JOIN purpose p ON p.pid = e.pid AND p.path = e.path),
g AS (SELECT pid, component, count(DISTINCT purpose) purposes, bool_or(purpose IS NULL) unavailable FROM m GROUP BY 1, 2) SELECT pid, component, purposes, CASE WHEN purposes > 1 THEN 'drift' WHEN purposes = 1 AND NOT unavailable THEN 'aligned' ELSE 'inconclusive' END AS verdict FROM g""")
def s134_purpose_alignment(spark: SparkSession, root: str) -> DataFrame:
    """Whether the owners in a component share one reviewed purpose, have several, or lack one."""
    comp = G.weak_components(vertices(spark, root), live_links(spark, root))
    e = entities(spark, root).select("pid", c("k").alias("node"), "path").distinct()
    p = purposes(spark, root).where("status = 'approved' AND source = 'agent'").select("pid", "path", "purpose")
    g = comp.join(e, ["pid", "node"]).join(p, ["pid", "path"], "left").groupBy("pid", "component")
    g = g.agg(F.count_distinct("purpose").alias("purposes"), F.bool_or(c("purpose").isNull()).alias("unavailable"))
    return g.select("pid", "component", "purposes", F.when(c("purposes") > 1, "drift").when((c("purposes") == 1) & ~c("unavailable"), "aligned").otherwise("inconclusive").alias("verdict"))


_TRUSTED = "w AS (SELECT lower(project_instance_id) pid, scope_path path, max(CASE WHEN state IN ('complete', 'no_candidates') THEN 0 WHEN state = 'partial' THEN 1 ELSE 2 END) t FROM graph_coverage GROUP BY 1, 2)"


def worst_trust(spark: SparkSession, root: str) -> DataFrame:
    t = F.when(c("state").isin("complete", "no_candidates"), 0).when(c("state") == "partial", 1).otherwise(2)
    return table(spark, root, "graph_coverage", "project_instance_id", "scope_path", "state").groupBy(hex_key("project_instance_id").alias("pid"), c("scope_path").alias("path")).agg(F.max(t).alias("t"))


@query(f"WITH {ENTITIES}, {RELATIONS}, {_TRUSTED}, i AS (SELECT pid, dst AS k, bool_and(resolution = 'resolved' AND completeness = 'complete') ok FROM rel WHERE dst IS NOT NULL GROUP BY 1, 2) SELECT ent.pid, ent.k, coalesce(w.t, 2) = 0 AND coalesce(i.ok, true) AND ent.symbol_kind IS NOT NULL AND ent.signature IS NOT NULL AS complete FROM ent LEFT JOIN w USING (pid, path) LEFT JOIN i USING (pid, k) WHERE ent.kind = 'symbol'")
def s269_dead_code_scope(spark: SparkSession, root: str) -> DataFrame:
    """Whether enough is known of a symbol to call it unused: exact identity, trusted file, and only complete, resolved relations into it."""
    ok = (c("resolution") == "resolved") & (c("completeness") == "complete")
    i = relations(spark, root).where("dst IS NOT NULL").groupBy("pid", c("dst").alias("k")).agg(F.bool_and(ok).alias("ok"))
    e = entities(spark, root).where("kind = 'symbol'").join(worst_trust(spark, root), ["pid", "path"], "left").join(i, ["pid", "k"], "left")
    return e.select("pid", "k", ((F.coalesce("t", F.lit(2)) == 0) & F.coalesce("ok", F.lit(True)) & c("symbol_kind").isNotNull() & c("signature").isNotNull()).alias("complete"))


@query(f"WITH {ENTITIES}, {RELATIONS}, {_TRUSTED}, a AS (SELECT pid, bool_and(completeness = 'complete') ok FROM rel GROUP BY 1), b AS (SELECT ent.pid, bool_and(ent.path IS NOT NULL AND coalesce(w.t, 2) = 0) ok FROM ent LEFT JOIN w USING (pid, path) GROUP BY 1) SELECT b.pid, coalesce(a.ok, true) AS relations_complete, b.ok AS entities_covered, coalesce(a.ok, true) AND b.ok AS complete FROM b LEFT JOIN a USING (pid)")
def s270_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Whether a repository's graph is complete evidence: every relation complete, every entity in a trusted file."""
    a = relations(spark, root).groupBy("pid").agg(F.bool_and(c("completeness") == "complete").alias("relations_complete"))
    e = entities(spark, root).join(worst_trust(spark, root), ["pid", "path"], "left")
    b = e.groupBy("pid").agg(F.bool_and(c("path").isNotNull() & (F.coalesce("t", F.lit(2)) == 0)).alias("entities_covered"))
    out = b.join(a, "pid", "left").withColumn("relations_complete", F.coalesce("relations_complete", F.lit(True)))
    return out.withColumn("complete", c("relations_complete") & c("entities_covered"))


# ---------------------------------------------------------------- walks to the end

_DEPTH = 64


@query(f"""WITH RECURSIVE {_EDGES}, seed AS (SELECT pid, max(dst) AS node FROM dep GROUP BY pid), walk AS (SELECT pid, node, 0 AS hops FROM seed UNION SELECT w.pid, dep.src, w.hops + 1 FROM walk w JOIN dep ON dep.pid = w.pid AND dep.dst = w.node WHERE w.hops < {_DEPTH})
SELECT pid, count(DISTINCT node) AS nodes FROM walk GROUP BY 1""")
def s267_impact_size(spark: SparkSession, root: str) -> DataFrame:
    """How many entities depend on a changed one, over any number of steps."""
    e = links(spark, root, DEPENDENCY)
    return G.bounded_bfs(G.reverse(e).repartition("pid", "src"), e.groupBy("pid").agg(F.max("dst").alias("node"))).groupBy("pid").agg(ONE("nodes"))


@query("""WITH RECURSIVE x AS (SELECT DISTINCT lower(project_instance_id) pid, owner_path, resolution_domain AS domain, lower(key_digest) AS digest FROM graph_entity_exports WHERE removed_at IS NULL), d AS (SELECT DISTINCT lower(project_instance_id) pid, owner_path, resolution_domain AS domain, lower(key_digest) AS digest FROM graph_relation_dependencies),
e AS (SELECT DISTINCT x.pid, x.owner_path AS a, d.owner_path AS b FROM x JOIN d USING (pid, domain, digest)), s AS (SELECT pid, min(owner_path) AS node FROM x GROUP BY 1), w AS (SELECT pid, node FROM s UNION SELECT w.pid, e.b FROM w JOIN e ON e.pid = w.pid AND e.a = w.node)
SELECT pid, node AS path FROM w""")
def s317_closure_files(spark: SparkSession, root: str) -> DataFrame:
    """All files to resolve again when a repository's first file changes, however far."""
    x, d = exports(spark, root), dependencies(spark, root)
    keys = ["pid", "domain", "digest"]
    e = x.select(*keys, c("owner_path").alias("src")).distinct().join(d.select(*keys, c("owner_path").alias("dst")).distinct(), keys).select("pid", "src", "dst").distinct()
    return G.bounded_bfs(e.repartition("pid", "src"), x.groupBy("pid").agg(F.min("owner_path").alias("node"))).select("pid", c("node").alias("path"))


# ---------------------------------------------------------------- across repositories


@query(f"WITH {ENTITIES}, {RELATIONS}, x AS (SELECT DISTINCT pid, k, external_system, external_identity FROM ent WHERE kind = 'external' AND external_identity IS NOT NULL), n AS (SELECT external_system, external_identity, count(DISTINCT pid) projects FROM x GROUP BY 1, 2) SELECT rel.pid, rel.rk, rel.kind, external_system, external_identity, projects - 1 AS others FROM rel JOIN x ON x.pid = rel.pid AND x.k = rel.dst JOIN n USING (external_system, external_identity) WHERE projects > 1")
def s274_federated_relations(spark: SparkSession, root: str) -> DataFrame:
    """Relations to external things that other repositories refer to as well, and how many of those there are."""
    x = entities(spark, root).where("kind = 'external' AND external_identity IS NOT NULL").select("pid", c("k").alias("dst"), "external_system", "external_identity").distinct()
    n = x.groupBy("external_system", "external_identity").agg((F.count_distinct("pid") - 1).alias("others")).where("others > 0")
    return relations(spark, root).select("pid", "rk", "kind", "dst").join(x, ["pid", "dst"]).join(n, ["external_system", "external_identity"]).select("pid", "rk", "kind", "external_system", "external_identity", "others")


@query(f"WITH {ENTITIES}, {RELATIONS}, x AS (SELECT DISTINCT pid, k, external_system, external_identity FROM ent WHERE kind = 'external' AND external_identity IS NOT NULL), r AS (SELECT pid, dst AS k, count(*) n FROM rel WHERE dst IS NOT NULL GROUP BY 1, 2), g AS (SELECT external_system, external_identity, count(DISTINCT pid) AS participants, coalesce(sum(n), 0)::BIGINT AS relations FROM x LEFT JOIN r USING (pid, k) GROUP BY 1, 2) SELECT * FROM g")
def s275_federated_analysis(spark: SparkSession, root: str) -> DataFrame:
    """External things with the repositories that take part (158: summed over them) and all relations to them."""
    x = entities(spark, root).where("kind = 'external' AND external_identity IS NOT NULL").select("pid", "k", "external_system", "external_identity").distinct()
    r = relations(spark, root).where("dst IS NOT NULL").groupBy("pid", c("dst").alias("k")).agg(ONE("n"))
    return x.join(r, ["pid", "k"], "left").groupBy("external_system", "external_identity").agg(F.count_distinct("pid").alias("participants"), F.coalesce(F.sum("n"), F.lit(0)).alias("relations"))


# ---------------------------------------------------------------- stages of a publication

_DIRTY = "dirty AS (SELECT node.pid, node.path FROM node LEFT JOIN txt USING (pid, path) WHERE node.kind = 'file' AND (NOT exists_now OR node.content_hash IS DISTINCT FROM txt.content_hash))"


def dirty_files(spark: SparkSession, root: str) -> DataFrame:
    """(pid, path) of files that are gone or differ from their indexed text."""
    t = latest_states(spark, root).select("pid", "path", c("content_hash").alias("h"))
    return nodes(spark, root).where("kind = 'file'").join(t, ["pid", "path"], "left").where(~c("exists_now") | ~c("content_hash").eqNullSafe(c("h"))).select("pid", "path")


@query("WITH k AS (SELECT DISTINCT lower(project_instance_id) pid, scope_path AS path, state FROM graph_coverage), n AS (SELECT DISTINCT lower(project_instance_id) pid, path FROM nodes WHERE kind = 'file') SELECT k.pid, k.path, k.state FROM k JOIN n USING (pid, path)")
def s029_file_rows_only(spark: SparkSession, root: str) -> DataFrame:
    """Records whose path is a file; those of other nodes are dropped."""
    k = table(spark, root, "graph_coverage", "project_instance_id", "scope_path", "state").select(hex_key("project_instance_id").alias("pid"), c("scope_path").alias("path"), "state").distinct()
    return k.join(table(spark, root, "nodes", "project_instance_id", "path", "kind").where("kind = 'file'").select(hex_key("project_instance_id").alias("pid"), "path").distinct(), ["pid", "path"], "left_semi")


@query(f"WITH {NODES}, {TEXTS}, {_DIRTY} SELECT node.pid, node.path, exists_now AND dirty.path IS NULL AS exists_now FROM node LEFT JOIN dirty USING (pid, path)")
def s031_mark_absent(spark: SparkSession, root: str) -> DataFrame:
    """Nodes after some paths were found absent: the rows stay, marked."""
    gone = dirty_files(spark, root).withColumn("gone", F.lit(True))
    return nodes(spark, root).join(gone, ["pid", "path"], "left").select("pid", "path", (c("exists_now") & c("gone").isNull()).alias("exists_now"))


@query(f"WITH {NODES}, {TEXTS}, {_DIRTY} SELECT pid, path, content_hash FROM txt WHERE NOT EXISTS (SELECT 1 FROM dirty WHERE dirty.pid = txt.pid AND dirty.path = txt.path) UNION ALL SELECT node.pid, node.path, node.content_hash FROM node JOIN dirty USING (pid, path) WHERE exists_now")
def s032_text_stage(spark: SparkSession, root: str) -> DataFrame:
    """Text rows after a stage: those of changed paths replaced, those of absent ones cleared, the others kept."""
    new = nodes(spark, root).where("exists_now").select("pid", "path", "content_hash")
    return replace_paths(latest_states(spark, root).select("pid", "path", "content_hash"), new, dirty_files(spark, root), ["pid", "path"])


@query(f"WITH {NODES}, {TEXTS}, {ENTITIES}, {_DIRTY} SELECT pid, path, count(*) AS symbols FROM ent WHERE kind = 'symbol' AND NOT EXISTS (SELECT 1 FROM dirty WHERE dirty.pid = ent.pid AND dirty.path = ent.path) GROUP BY 1, 2")
def s033_symbol_stage(spark: SparkSession, root: str) -> DataFrame:
    """Symbols per file after those of changed paths were cleared."""
    e = entities(spark, root).where("kind = 'symbol'").select("pid", "path", "k")
    return replace_paths(e, e.limit(0), dirty_files(spark, root), ["pid", "path"]).groupBy("pid", "path").agg(ONE("symbols"))


@query(f"WITH {NODES}, {TEXTS}, {ENTITIES}, {RELATIONS}, {_DIRTY}, s AS (SELECT DISTINCT pid, k, path FROM ent WHERE path IS NOT NULL) SELECT rel.pid, count(*) AS relations, count(*) FILTER (dirty.path IS NOT NULL) AS replaced FROM rel JOIN s ON s.pid = rel.pid AND s.k = rel.src LEFT JOIN dirty ON dirty.pid = s.pid AND dirty.path = s.path GROUP BY 1")
def s034_graph_stage(spark: SparkSession, root: str) -> DataFrame:
    """Relations of each repository and how many a stage for its changed paths replaces."""
    s = entities(spark, root).where("path IS NOT NULL").select("pid", c("k").alias("src"), "path").distinct()
    r = relations(spark, root).join(s, ["pid", "src"]).join(dirty_files(spark, root).withColumn("dirty", F.lit(True)), ["pid", "path"], "left")
    return r.groupBy("pid").agg(ONE("relations"), F.count_if(c("dirty").isNotNull()).alias("replaced"))


@query(f"WITH {NODES}, {TEXTS}, {_DIRTY}, {_EXPORTS}, k AS (SELECT DISTINCT pid, domain, digest FROM (SELECT lower(project_instance_id) pid, resolution_domain AS domain, lower(key_digest) AS digest, owner_path FROM graph_entity_exports WHERE removed_at IS NULL) o WHERE EXISTS (SELECT 1 FROM dirty WHERE dirty.pid = o.pid AND dirty.path = o.owner_path)) SELECT pid, path, 'changed' AS why FROM dirty UNION ALL SELECT DISTINCT d.pid, d.owner_path, 'depends' FROM d JOIN k USING (pid, domain, digest) WHERE NOT EXISTS (SELECT 1 FROM dirty WHERE dirty.pid = d.pid AND dirty.path = d.owner_path)")
def s316_incremental_refresh(spark: SparkSession, root: str) -> DataFrame:
    """What an incremental refresh handles: the changed files, and the files whose relations depend on keys those export."""
    dirty = dirty_files(spark, root)
    mine = dirty.select("pid", c("path").alias("owner_path"))
    keys = exports(spark, root).join(mine, ["pid", "owner_path"], "left_semi").select("pid", "domain", "digest")
    other = dependencies(spark, root).join(keys, ["pid", "domain", "digest"], "left_semi").select("pid", "owner_path").distinct().join(mine, ["pid", "owner_path"], "left_anti")
    return dirty.select("pid", "path", F.lit("changed").alias("why")).unionByName(other.select("pid", c("owner_path").alias("path"), F.lit("depends").alias("why")))


@query("WITH m AS (SELECT snapshot_id, max((lower(project_instance_id), registration_id, source_generation, lower(source_state_digest))) s FROM snapshot_metadata GROUP BY 1), o AS (SELECT snapshot_id, s[1] pid, s[2] reg, s[3] gen, s[4] digest FROM m) SELECT snapshot_id, pid, reg AS registration_id, gen AS generation, gen = max(gen) OVER (PARTITION BY pid, reg) AS current, digest = lag(digest) OVER (PARTITION BY pid, reg ORDER BY gen, snapshot_id) AS unchanged FROM o")
def s276_revalidated(spark: SparkSession, root: str) -> DataFrame:
    """Captured snapshots: whether each is its worktree's newest generation, and whether its state is that of the one before."""
    t = table(spark, root, "snapshot_metadata", "snapshot_id", "project_instance_id", "registration_id", "source_generation", "source_state_digest")
    one = t.groupBy("snapshot_id").agg(F.max(F.struct(hex_key("project_instance_id").alias("pid"), "registration_id", c("source_generation").alias("generation"), hex_key("source_state_digest").alias("digest"))).alias("s")).select("snapshot_id", "s.*")
    w = W.partitionBy("pid", "registration_id")  # the snapshots of one worktree, a row each
    return one.select("snapshot_id", "pid", "registration_id", "generation", (c("generation") == F.max("generation").over(w)).alias("current"), (c("digest") == F.lag("digest").over(w.orderBy("generation", "snapshot_id"))).alias("unchanged"))


# ---------------------------------------------------------------- findings brought together


from treeline.plans import graph_queries as Q  # noqa: E402
from treeline.plans.registry import ORACLES  # noqa: E402

_FINDINGS = f"""fnd AS (SELECT pid, 'dead_code' AS kind, node, '' AS detail FROM ({ORACLES["s268_dead_code"]}) UNION ALL SELECT pid, 'gap', node, kind || ':' || ref FROM ({ORACLES["s263_gaps"]}) WHERE node IS NOT NULL UNION ALL SELECT pid, 'hub', hub, kind FROM ({ORACLES["s135_hubs"]}))"""


def findings(spark: SparkSession, root: str) -> DataFrame:
    """(pid, kind, node, detail): unused symbols, references without target, and hubs, in one table."""
    dead = Q.s268_dead_code(spark, root).select("pid", F.lit("dead_code").alias("kind"), "node", F.lit("").alias("detail"))
    gaps = Q.s263_gaps(spark, root).where("node IS NOT NULL").select("pid", F.lit("gap").alias("kind"), "node", F.concat_ws(":", "kind", "ref").alias("detail"))
    hubs = Q.s135_hubs(spark, root).select("pid", F.lit("hub").alias("kind"), c("hub").alias("node"), c("kind").alias("detail"))
    return dead.unionByName(gaps).unionByName(hubs)


@query(f"WITH {_FINDINGS} SELECT pid, kind, count(*) AS findings FROM fnd GROUP BY 1, 2")
def s272_findings(spark: SparkSession, root: str) -> DataFrame:
    """Findings of an analysis by kind."""
    return findings(spark, root).groupBy("pid", "kind").agg(ONE("findings"))


@query(f"WITH {_FINDINGS}, o AS (SELECT DISTINCT pid, kind, node, detail FROM fnd), r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY kind, node, detail) - 1 AS position FROM o), t AS (SELECT pid, count(*) total FROM o GROUP BY 1) SELECT pid, kind, node, detail, position::INT AS position, total FROM r JOIN t USING (pid) WHERE position BETWEEN 10 AND 19")
def s273_finding_page(spark: SparkSession, root: str) -> DataFrame:
    """Findings 10 to 19 of each repository with their number."""
    f = findings(spark, root).distinct()
    w = W.partitionBy("pid").orderBy("kind", "node", "detail")
    top = f.withColumn("n", F.row_number().over(w)).where("n <= 20").where("n > 10").withColumn("position", c("n") - 1).drop("n")
    return top.join(f.groupBy("pid").agg(ONE("total")), "pid")


@query(f"WITH {NODES}, {TEXTS}, k AS (SELECT node.pid, node.path, txt.content_hash IS NOT DISTINCT FROM node.content_hash AS same, size_bytes, txt.path IS NULL AS untexted FROM node LEFT JOIN txt USING (pid, path) WHERE kind = 'file' AND exists_now) SELECT pid, path, CASE WHEN untexted THEN 'no_text' WHEN same THEN 'unchanged' WHEN size_bytes > 1048576 THEN 'too_large' ELSE 'parse' END AS job FROM k")
def s301_parse_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Which files have to be parsed again: not those whose hash is the indexed one, too large ones, or those without text."""
    t = latest_states(spark, root).select("pid", "path", c("content_hash").alias("h"), F.lit(True).alias("texted"))
    k = nodes(spark, root).where("kind = 'file' AND exists_now").join(t, ["pid", "path"], "left")
    job = F.when(c("texted").isNull(), "no_text").when(c("content_hash").eqNullSafe(c("h")), "unchanged").when(c("size_bytes") > 1 << 20, "too_large").otherwise("parse")
    return k.select("pid", "path", job.alias("job"))


@query(f"WITH {NODES}, w AS (SELECT lower(project_instance_id) pid, scope_path path, bool_or(state IN ('failed', 'quarantined', 'oversized')) failed, bool_or(state IN ('partial', 'stale')) partial FROM graph_coverage WHERE relation_kind IS NULL GROUP BY 1, 2) SELECT node.pid, node.path, CASE WHEN w.path IS NULL THEN 'unparsed' WHEN failed THEN 'failed' WHEN partial THEN 'partial' ELSE 'parsed' END AS status FROM node LEFT JOIN w USING (pid, path) WHERE kind = 'file'")
def s241_summary_status(spark: SparkSession, root: str) -> DataFrame:
    """Status of each file's summary by what is known of its parsing: the worst record counts, none means unparsed."""
    g = table(spark, root, "graph_coverage", "project_instance_id", "scope_path", "relation_kind", "state").where("relation_kind IS NULL")
    w = g.groupBy(hex_key("project_instance_id").alias("pid"), c("scope_path").alias("path")).agg(F.bool_or(c("state").isin("failed", "quarantined", "oversized")).alias("failed"), F.bool_or(c("state").isin("partial", "stale")).alias("partial"))
    n = nodes(spark, root).where("kind = 'file'").join(w, ["pid", "path"], "left")
    return n.select("pid", "path", F.when(c("failed").isNull(), "unparsed").when(c("failed"), "failed").when(c("partial"), "partial").otherwise("parsed").alias("status"))


_PREVIEW = """size AS (SELECT pid, component, count(*) n FROM comp GROUP BY 1, 2), big AS (SELECT pid, component FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY n DESC, component) i FROM size) WHERE i = 1),
deg AS (SELECT pid, node, count(*) d FROM (SELECT pid, unnest([src, dst]) node FROM liveu) GROUP BY 1, 2), hub AS (SELECT pid, node FROM (SELECT deg.pid, deg.node, row_number() OVER (PARTITION BY deg.pid ORDER BY d DESC, deg.node) i FROM deg JOIN comp ON comp.pid = deg.pid AND comp.node = deg.node JOIN big ON big.pid = comp.pid AND big.component = comp.component) WHERE i = 1),
walk AS (SELECT pid, node, 0 AS hops FROM hub UNION SELECT w.pid, u.dst, w.hops + 1 FROM walk w JOIN u ON u.pid = w.pid AND u.src = w.node WHERE w.hops < 2), near AS (SELECT pid, node, min(hops) hops FROM walk GROUP BY 1, 2),
pick AS (SELECT pid, node FROM (SELECT near.pid, near.node, row_number() OVER (PARTITION BY near.pid ORDER BY hops, d DESC, near.node) i FROM near JOIN deg ON deg.pid = near.pid AND deg.node = near.node) WHERE i <= 48)"""


@query(f"WITH RECURSIVE {_EDGES}, {_LIVE}, " + _REACHED.format(e="liveu") + f", {_PREVIEW} SELECT pid, src, dst FROM (SELECT e.pid, e.src, e.dst, row_number() OVER (PARTITION BY e.pid ORDER BY e.src, e.dst) i FROM liveu e JOIN pick a ON a.pid = e.pid AND a.node = e.src JOIN pick b ON b.pid = e.pid AND b.node = e.dst) WHERE i <= 64")
def s190_preview(spark: SparkSession, root: str) -> DataFrame:
    """A small picture of each repository's graph: around the busiest node of its largest component, the 48 nearest and busiest nodes within two steps, and 64 edges between them."""
    v, e = vertices(spark, root), checkpointed(live_links(spark, root))
    comp, deg = G.weak_components(v, e), G.degrees(v, e).where("degree > 0")
    first = lambda df, *order: df.withColumn("i", F.row_number().over(W.partitionBy("pid").orderBy(*order))).where("i <= 1").drop("i")
    big = first(comp.groupBy("pid", "component").agg(ONE("n")), F.desc("n"), "component").select("pid", "component")
    hub = first(deg.join(comp.join(big, ["pid", "component"], "left_semi"), ["pid", "node"]), F.desc("degree"), "node").select("pid", "node")
    near = G.bounded_bfs(e.unionByName(G.reverse(e)), hub, 2).join(deg, ["pid", "node"])
    pick = near.withColumn("i", F.row_number().over(W.partitionBy("pid").orderBy("hops", F.desc("degree"), "node"))).where("i <= 48").select("pid", "node")
    inner = e.join(pick.withColumnRenamed("node", "src"), ["pid", "src"], "left_semi").join(pick.withColumnRenamed("node", "dst"), ["pid", "dst"], "left_semi")
    return inner.withColumn("i", F.row_number().over(W.partitionBy("pid").orderBy("src", "dst"))).where("i <= 64").select("pid", "src", "dst")
