"""Queries of joins and traversals over the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.operators import graph as G
from treeline.plans.index_tables import ENTITIES, NODES, RELATIONS, entities, nodes, relations
from treeline.plans.registry import query
from treeline.sources.tables import hex_key, table

c = F.col

# Relation kinds that make one thing depend on another, and the ranks of trust.
DEPENDENCY = ["imports", "calls", "depends-on", "tests", "routes-to", "configures"]
CONFIDENCE = {"exact": 4, "high": 3, "medium": 2, "low": 1}
RESOLUTION = {"resolved": 4, "external": 3, "ambiguous": 2, "unresolved": 1}


def rank_of(col, ranks: dict[str, int]):
    out = F.lit(0)
    for name, r in ranks.items():
        out = F.when(col == name, r).otherwise(out)
    return out


def _rank_sql(col: str, ranks: dict[str, int]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + " ELSE 0 END"


_DEP = "(" + ", ".join(f"'{k}'" for k in DEPENDENCY) + ")"
_EDGES = f"{ENTITIES}, {RELATIONS}, node_ AS (SELECT DISTINCT pid, k AS node FROM ent), edge AS (SELECT DISTINCT pid, src, dst FROM rel WHERE dst IS NOT NULL AND src IS NOT NULL), dep AS (SELECT DISTINCT pid, src, dst FROM rel WHERE dst IS NOT NULL AND src IS NOT NULL AND kind IN {_DEP})"


def vertices(spark: SparkSession, root: str) -> DataFrame:
    return entities(spark, root).select("pid", c("k").alias("node")).distinct()


def links(spark: SparkSession, root: str, kinds: list[str] | None = None) -> DataFrame:
    r = relations(spark, root).where("src IS NOT NULL AND dst IS NOT NULL")
    return (r.where(c("kind").isin(kinds)) if kinds else r).select("pid", "src", "dst").distinct()


@query(f"WITH {_EDGES}, e AS (SELECT pid, unnest([src, dst]) AS node FROM edge), d AS (SELECT pid, node, count(*) degree FROM e GROUP BY ALL) SELECT node_.pid, node_.node, coalesce(degree, 0) AS degree FROM node_ LEFT JOIN d USING (pid, node)")
def s132_degree(spark: SparkSession, root: str) -> DataFrame:
    return G.degrees(vertices(spark, root), links(spark, root))


@query(f"WITH {RELATIONS} SELECT pid, dst AS node, count(*) AS uses FROM rel WHERE dst IS NOT NULL AND kind <> 'contains' GROUP BY 1, 2")
def s133_usage_in_degree(spark: SparkSession, root: str) -> DataFrame:
    return relations(spark, root).where("dst IS NOT NULL AND kind <> 'contains'").groupBy("pid", c("dst").alias("node")).agg(F.count(F.lit(1)).alias("uses"))


@query(f"WITH {RELATIONS}, g AS (SELECT pid, kind, src, count(*) n FROM rel WHERE resolution = 'resolved' AND src IS NOT NULL GROUP BY ALL) SELECT pid, kind, src AS hub, n AS degree FROM g QUALIFY row_number() OVER (PARTITION BY pid, kind ORDER BY n DESC, src) <= 3")
def s135_hubs(spark: SparkSession, root: str) -> DataFrame:
    """The three busiest sources of each relation kind."""
    g = relations(spark, root).where("resolution = 'resolved' AND src IS NOT NULL").groupBy("pid", "kind", c("src").alias("hub")).agg(F.count(F.lit(1)).alias("degree"))
    w = W.partitionBy("pid", "kind").orderBy(F.desc("degree"), "hub")
    return g.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query(f"WITH {RELATIONS} SELECT pid, rk, row_number() OVER (PARTITION BY pid ORDER BY {_rank_sql('confidence', CONFIDENCE)} DESC, {_rank_sql('resolution', RESOLUTION)} DESC, coalesce(ref, ''), rk, coalesce(dst, ''), kind)::INT AS rank FROM rel QUALIFY rank <= 20")
def s173_relation_rank(spark: SparkSession, root: str) -> DataFrame:
    """The twenty most trusted relations of each repository."""
    w = W.partitionBy("pid").orderBy(F.desc(rank_of(c("confidence"), CONFIDENCE)), F.desc(rank_of(c("resolution"), RESOLUTION)), F.coalesce("ref", F.lit("")), "rk", F.coalesce("dst", F.lit("")), "kind")
    return relations(spark, root).withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("pid", "rk", "rank")


@query(f"WITH {RELATIONS} SELECT pid, kind, count(*) AS relations, count(*) FILTER (confidence IN ('exact', 'high')) AS trusted, count(*) FILTER (resolution = 'resolved') AS resolved FROM rel WHERE kind <> 'documents' GROUP BY 1, 2")
def s055_relation_predicate(spark: SparkSession, root: str) -> DataFrame:
    """Relations by kind with the share that passes a trust floor; document links are hidden by default."""
    r = relations(spark, root).where("kind <> 'documents'")
    return r.groupBy("pid", "kind").agg(F.count(F.lit(1)).alias("relations"), F.count_if(rank_of(c("confidence"), CONFIDENCE) >= 3).alias("trusted"), F.count_if(c("resolution") == "resolved").alias("resolved"))


_ANCHOR = "anchor AS (SELECT pid, min(src) AS node FROM dep GROUP BY pid)"


def anchors(edges: DataFrame) -> DataFrame:
    return edges.groupBy("pid").agg(F.min("src").alias("node"))


@query(f"""WITH RECURSIVE {_EDGES}, {_ANCHOR}, walk AS (SELECT pid, node, 0 AS hops FROM anchor UNION SELECT w.pid, dep.dst, w.hops + 1 FROM walk w JOIN dep ON dep.pid = w.pid AND dep.src = w.node WHERE w.hops < 4)
SELECT pid, node, min(hops) AS hops FROM walk GROUP BY 1, 2""")
def s257_bfs(spark: SparkSession, root: str) -> DataFrame:
    """Nodes within four dependency steps of each repository's anchor."""
    e = links(spark, root, DEPENDENCY)
    return G.bounded_bfs(e, anchors(e), 4)


@query(f"""WITH RECURSIVE {_EDGES}, seed AS (SELECT pid, max(dst) AS node FROM dep GROUP BY pid), walk AS (SELECT pid, node, 0 AS hops FROM seed UNION SELECT w.pid, dep.src, w.hops + 1 FROM walk w JOIN dep ON dep.pid = w.pid AND dep.dst = w.node WHERE w.hops < 6)
SELECT pid, node, min(hops) AS hops FROM walk GROUP BY 1, 2""")
def s267_impact(spark: SparkSession, root: str) -> DataFrame:
    """What depends on a changed entity, and over how many steps, however many. The SQL form stops at six."""
    e = links(spark, root, DEPENDENCY)
    return G.bounded_bfs(G.reverse(e).repartition("pid", "src"), e.groupBy("pid").agg(F.max("dst").alias("node")))


@query(f"""WITH RECURSIVE {_EDGES}, u AS (SELECT pid, src, dst FROM edge UNION SELECT pid, dst, src FROM edge), reach AS (SELECT pid, node, node AS seen FROM node_ UNION SELECT r.pid, r.node, u.dst FROM reach r JOIN u ON u.pid = r.pid AND u.src = r.seen)
SELECT reach.pid, reach.node, min(seen) AS component FROM reach JOIN node_ v ON v.pid = reach.pid AND v.node = seen GROUP BY 1, 2""")
def s130_components(spark: SparkSession, root: str) -> DataFrame:
    """Weak components of live entities; edges to entities that are gone connect nothing here."""
    v = vertices(spark, root)
    e = links(spark, root)
    live = e.join(v.withColumnRenamed("node", "src"), ["pid", "src"], "left_semi").join(v.withColumnRenamed("node", "dst"), ["pid", "dst"], "left_semi")
    return G.weak_components(v, live)


_LIVE = "live AS (SELECT e.* FROM dep e JOIN node_ a ON a.pid = e.pid AND a.node = e.src JOIN node_ b ON b.pid = e.pid AND b.node = e.dst), liveu AS (SELECT e.pid, e.src, e.dst FROM edge e JOIN node_ a ON a.pid = e.pid AND a.node = e.src JOIN node_ b ON b.pid = e.pid AND b.node = e.dst)"
from treeline.plans.registry import ORACLES  # noqa: E402

ORACLES["s130_components"] = f"""WITH RECURSIVE {_EDGES}, {_LIVE}, u AS (SELECT pid, src, dst FROM liveu UNION SELECT pid, dst, src FROM liveu), reach AS (SELECT pid, node, node AS seen FROM node_ UNION SELECT r.pid, r.node, u.dst FROM reach r JOIN u ON u.pid = r.pid AND u.src = r.seen)
SELECT pid, node, min(seen) AS component FROM reach GROUP BY 1, 2"""


def _live_dependencies(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    v = vertices(spark, root)
    e = links(spark, root, DEPENDENCY)
    return v, e.join(v.withColumnRenamed("node", "dst"), ["pid", "dst"], "left_semi").join(v.withColumnRenamed("node", "src"), ["pid", "src"], "left_semi")


_REACH = f"{_EDGES}, {_LIVE}, reach AS (SELECT pid, src AS a, dst AS b FROM live UNION SELECT r.pid, r.a, live.dst FROM reach r JOIN live ON live.pid = r.pid AND live.src = r.b)"


@query(f"""WITH RECURSIVE {_REACH}, mutual AS (SELECT x.pid, x.a, x.b FROM reach x JOIN reach y ON x.pid = y.pid AND x.a = y.b AND x.b = y.a)
SELECT node_.pid, node_.node, least(node_.node, coalesce(min(b), node_.node)) AS component FROM node_ LEFT JOIN mutual ON mutual.pid = node_.pid AND mutual.a = node_.node GROUP BY 1, 2""")
def s131_strong_components(spark: SparkSession, root: str) -> DataFrame:
    v, e = _live_dependencies(spark, root)
    return G.strong_components(v, e)


@query(f"""WITH RECURSIVE {_REACH}, mutual AS (SELECT x.pid, x.a, x.b FROM reach x JOIN reach y ON x.pid = y.pid AND x.a = y.b AND x.b = y.a), m AS (SELECT pid, a AS node, least(a, min(b)) AS component FROM mutual GROUP BY 1, 2)
SELECT pid, component, count(*) AS size FROM m GROUP BY 1, 2""")
def s266_cycles(spark: SparkSession, root: str) -> DataFrame:
    """Dependency cycles with their sizes."""
    v, e = _live_dependencies(spark, root)
    return G.cycles(G.strong_components(v, e), e)


@query(f"WITH {_EDGES}, {_LIVE} SELECT ent.pid, ent.k AS node FROM ent WHERE kind = 'symbol' AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.pid = ent.pid AND rel.dst = ent.k AND rel.kind <> 'contains') AND NOT EXISTS (SELECT 1 FROM graph_entity_exports x WHERE lower(x.project_instance_id) = ent.pid AND lower(x.entity_key) = ent.k AND x.removed_at IS NULL)")
def s268_dead_code(spark: SparkSession, root: str) -> DataFrame:
    """Symbols nothing uses and nothing exports."""
    used = relations(spark, root).where("kind <> 'contains' AND dst IS NOT NULL").select("pid", c("dst").alias("k"))
    exported = table(spark, root, "graph_entity_exports", "project_instance_id", "entity_key", "removed_at").where("removed_at IS NULL").select(hex_key("project_instance_id").alias("pid"), hex_key("entity_key").alias("k"))
    s = entities(spark, root).where("kind = 'symbol'")
    return s.join(used, ["pid", "k"], "left_anti").join(exported, ["pid", "k"], "left_anti").select("pid", c("k").alias("node"))


@query(f"WITH {RELATIONS} SELECT DISTINCT pid, src AS node, kind, resolution, coalesce(ref, '') AS ref FROM rel WHERE resolution IN ('ambiguous', 'unresolved')")
def s263_gaps(spark: SparkSession, root: str) -> DataFrame:
    """Relations that lead to no single target."""
    return relations(spark, root).where("resolution IN ('ambiguous', 'unresolved')").select("pid", c("src").alias("node"), "kind", "resolution", F.coalesce("ref", F.lit("")).alias("ref")).distinct()


_EXPORTS = "x AS (SELECT lower(project_instance_id) pid, resolution_domain AS domain, lower(key_digest) AS digest, lower(entity_key) AS target FROM graph_entity_exports WHERE removed_at IS NULL), d AS (SELECT DISTINCT dependency_id, lower(project_instance_id) pid, resolution_domain AS domain, lower(key_digest) AS digest, owner_path FROM graph_relation_dependencies)"


def exports(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "graph_entity_exports", "project_instance_id", "resolution_domain", "key_digest", "entity_key", "owner_path", "removed_at").where("removed_at IS NULL").select(
        hex_key("project_instance_id").alias("pid"), c("resolution_domain").alias("domain"), hex_key("key_digest").alias("digest"), hex_key("entity_key").alias("target"), "owner_path"
    )


def dependencies(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "graph_relation_dependencies", "dependency_id", "project_instance_id", "resolution_domain", "key_digest", "owner_path").select(
        "dependency_id", hex_key("project_instance_id").alias("pid"), c("resolution_domain").alias("domain"), hex_key("key_digest").alias("digest"), "owner_path"
    ).distinct()


@query(f"WITH {_EXPORTS}, o AS (SELECT pid, domain, digest, count(DISTINCT target) n, min(target) target FROM x GROUP BY ALL) SELECT dependency_id, coalesce(n, 0) AS candidates, target, CASE WHEN n IS NULL OR n = 0 THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM d LEFT JOIN o USING (pid, domain, digest)")
def s097_resolution(spark: SparkSession, root: str) -> DataFrame:
    """Dependency keys against exported keys: none, one or several targets."""
    return G.resolve(dependencies(spark, root), exports(spark, root), ["pid", "domain", "digest"]).select("dependency_id", "candidates", "target", "status")


@query(f"WITH {_EXPORTS}, changed AS (SELECT DISTINCT lower(project_instance_id) pid, resolution_domain AS domain, lower(key_digest) AS digest FROM graph_entity_exports WHERE removed_at IS NULL AND starts_with(owner_path, 'src/')) SELECT DISTINCT d.pid, d.owner_path FROM d JOIN changed USING (pid, domain, digest)")
def s103_affected(spark: SparkSession, root: str) -> DataFrame:
    """Files whose relations depend on keys exported below src/: what a change there makes stale."""
    changed = exports(spark, root).where(c("owner_path").startswith("src/")).select("pid", "domain", "digest")
    return dependencies(spark, root).join(changed, ["pid", "domain", "digest"], "left_semi").select("pid", "owner_path").distinct()


@query("""WITH RECURSIVE x AS (SELECT DISTINCT lower(project_instance_id) pid, owner_path, resolution_domain AS domain, lower(key_digest) AS digest FROM graph_entity_exports WHERE removed_at IS NULL), d AS (SELECT DISTINCT lower(project_instance_id) pid, owner_path, resolution_domain AS domain, lower(key_digest) AS digest FROM graph_relation_dependencies),
e AS (SELECT DISTINCT x.pid, x.owner_path AS a, d.owner_path AS b FROM x JOIN d USING (pid, domain, digest)), s AS (SELECT pid, min(owner_path) AS node FROM x GROUP BY 1), w AS (SELECT pid, node, 0 AS hops FROM s UNION SELECT w.pid, e.b, hops + 1 FROM w JOIN e ON e.pid = w.pid AND e.a = w.node WHERE hops < 5)
SELECT pid, node, min(hops) AS hops FROM w GROUP BY 1, 2""")
def s317_closure(spark: SparkSession, root: str) -> DataFrame:
    """Files to resolve again when a repository's first file changes, step by step to the end. The SQL form stops at five."""
    x, d = exports(spark, root), dependencies(spark, root)
    e = x.select("pid", "domain", "digest", c("owner_path").alias("src")).distinct().join(d.select("pid", "domain", "digest", c("owner_path").alias("dst")).distinct(), ["pid", "domain", "digest"]).select("pid", "src", "dst").distinct()
    return G.bounded_bfs(e.repartition("pid", "src"), x.groupBy("pid").agg(F.min("owner_path").alias("node")))


@query(f"WITH {ENTITIES}, {RELATIONS}, s AS (SELECT pid, name, count(*) n, min(k) k FROM ent WHERE kind = 'symbol' AND name IS NOT NULL GROUP BY 1, 2) SELECT s.pid, s.name, s.k AS callee, r.src AS caller FROM s JOIN (SELECT DISTINCT pid, src, regexp_extract(ref, '[^:./]+$') AS name FROM rel WHERE ref IS NOT NULL) r ON r.pid = s.pid AND r.name = s.name WHERE s.n = 1")
def s107_called_by(spark: SparkSession, root: str) -> DataFrame:
    """Callers by name: a reference's last part against symbols whose name is unique in the repository."""
    s = entities(spark, root).where("kind = 'symbol' AND name IS NOT NULL").groupBy("pid", "name").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("callee")).where("n = 1").drop("n")
    r = relations(spark, root).where("ref IS NOT NULL").select("pid", c("src").alias("caller"), F.regexp_extract("ref", "[^:./]+$", 0).alias("name")).distinct()
    return s.join(r, ["pid", "name"]).select("pid", "name", "callee", "caller")


@query(f"WITH {ENTITIES}, x AS (SELECT DISTINCT external_system, external_identity, pid FROM ent WHERE kind = 'external' AND external_identity IS NOT NULL), n AS (SELECT external_system, external_identity, count(*) AS projects FROM x GROUP BY 1, 2 HAVING count(*) >= 2) SELECT x.external_system, x.external_identity, projects, pid FROM x JOIN n ON x.external_system = n.external_system AND x.external_identity = n.external_identity")
def s111_rendezvous(spark: SparkSession, root: str) -> DataFrame:
    """External things that several repositories refer to: one row per member, with the number of members."""
    e = entities(spark, root).where("kind = 'external' AND external_identity IS NOT NULL").select("external_system", "external_identity", "pid").distinct()
    n = e.groupBy("external_system", "external_identity").agg(F.count(F.lit(1)).alias("projects")).where("projects >= 2")
    return e.join(n, ["external_system", "external_identity"]).select("external_system", "external_identity", "projects", "pid")


@query(f"WITH {ENTITIES} SELECT pid, path, count(*) FILTER (kind = 'symbol') AS symbols, count(DISTINCT name) FILTER (kind = 'symbol') AS names, count(*) FILTER (symbol_kind = 'method') AS methods FROM ent WHERE path IS NOT NULL GROUP BY 1, 2")
def s138_symbol_counts(spark: SparkSession, root: str) -> DataFrame:
    e = entities(spark, root).where("path IS NOT NULL")
    sym = c("kind") == "symbol"
    return e.groupBy("pid", "path").agg(F.count_if(sym).alias("symbols"), F.count_distinct(F.when(sym, c("name"))).alias("names"), F.count_if(c("symbol_kind") == "method").alias("methods"))


@query(f"WITH {ENTITIES}, {RELATIONS}, o AS (SELECT pid, rk, src, row_number() OVER (PARTITION BY pid, src, kind ORDER BY rk, coalesce(dst, ''), resolution) i FROM rel) SELECT pid, rk, src FROM o WHERE i <= 2")
def s188_occurrence_limit(spark: SparkSession, root: str) -> DataFrame:
    """At most two relations of a kind for each source."""
    w = W.partitionBy("pid", "src", "kind").orderBy("rk", F.coalesce("dst", F.lit("")), "resolution")
    return relations(spark, root).withColumn("i", F.row_number().over(w)).where("i <= 2").select("pid", "rk", "src")


@query(f"WITH {NODES}, m AS (SELECT pid, parent AS dir FROM (SELECT pid, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END parent, extension FROM node WHERE kind = 'file') WHERE extension = '.toml' GROUP BY 1, 2) SELECT n.pid, n.path, arg_max(m.dir, CASE WHEN m.dir = '.' THEN 0 ELSE length(m.dir) END) AS package FROM node n JOIN m ON m.pid = n.pid AND (m.dir = '.' OR starts_with(n.path, m.dir || '/')) WHERE n.kind = 'file' GROUP BY 1, 2")
def s105_package_owner(spark: SparkSession, root: str) -> DataFrame:
    """The deepest folder with a manifest that holds each file: an equi-join over ancestors, not a prefix join."""
    from treeline.functions import paths as P

    f = nodes(spark, root).where("kind = 'file'")
    m = f.where("extension = '.toml'").select("pid", P.parent(c("path")).alias("dir")).distinct()
    up = f.select("pid", "path", F.posexplode(P.ancestors(P.parent(c("path")))).alias("d", "dir"))
    return up.join(m, ["pid", "dir"]).groupBy("pid", "path").agg(F.min_by("dir", "d").alias("package"))
