"""Queries that resolve references, hydrate keys, and bring files, symbols and relations together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import facts as X
from treeline.functions import paths as P
from treeline.functions import text as T
from treeline.functions.languages import CLASS_OF
from treeline.operators import graph as G
from treeline.operators.changes import delta, replace_scan, upsert
from treeline.operators.extract import declarations
from treeline.operators.search import bounded
from treeline.plans.extraction import _LINE, _sql_rx
from treeline.plans.graph_queries import _EDGES, _EXPORTS, anchors, dependencies, exports, links, rank_of, vertices
from treeline.plans.graph_queries import CONFIDENCE, DEPENDENCY, RESOLUTION, _rank_sql
from treeline.plans.index_tables import ENTITIES, NODES, RELATIONS, TEXTS, entities, from_latest_texts, latest_states, nodes, relations
from treeline.plans.paths_and_text import _SQL_LINES
from treeline.plans.predicates import _CALLS_SQL, _CLASSED, _in, call_lines, classed_files, graph_test_path
from treeline.plans.registry import query
from treeline.plans.search_and_sets import _HEALTH, _PURPOSES, health_findings, purposes
from treeline.sources.tables import hex_key, table, tree_path

c = F.col
_LEAF = "regexp_extract(ref, '[^:./]+$')"


def leaf(ref):
    return F.regexp_extract(ref, "[^:./]+$", 0)


# ---------------------------------------------------------------- anti-joins, look-ups, hydration


@query(f"WITH {NODES} SELECT DISTINCT lower(project_instance_id) AS pid, scope_path AS path FROM graph_coverage g WHERE NOT EXISTS (SELECT 1 FROM node WHERE node.pid = lower(g.project_instance_id) AND node.path = g.scope_path AND kind = 'file')")
def s086_rows_without_node(spark: SparkSession, root: str) -> DataFrame:
    """Paths that records speak of though no file of that path is known."""
    t = table(spark, root, "graph_coverage", "project_instance_id", "scope_path").select(hex_key("project_instance_id").alias("pid"), c("scope_path").alias("path")).distinct()
    return t.join(nodes(spark, root).where("kind = 'file'").select("pid", "path"), ["pid", "path"], "left_anti")


PATHS = ["internal/parcel_000", "packages/quota_000", "cmd/lease_000", "app/parcel_000", "src/main.rs"]


@query(f"WITH {NODES} SELECT pid, path, kind FROM node WHERE path IN {_in(PATHS)}")
def s088_path_batch(spark: SparkSession, root: str) -> DataFrame:
    """Nodes of a batch of paths; the list reaches the scan."""
    return nodes(spark, root).where(c("path").isin(PATHS)).select("pid", "path", "kind")


@query(f"WITH {ENTITIES}, {RELATIONS}, d AS (SELECT DISTINCT pid, dst AS k FROM rel WHERE dst IS NOT NULL), e AS (SELECT pid, k, min(kind) kind, count(*) n FROM ent GROUP BY 1, 2) SELECT d.pid, d.k, e.kind, e.k IS NULL AS stale FROM d LEFT JOIN e USING (pid, k)")
def s091_entity_hydration(spark: SparkSession, root: str) -> DataFrame:
    """Keys that relations lead to with their entity; one that is missing makes a cursor stale."""
    d = relations(spark, root).where("dst IS NOT NULL").select("pid", c("dst").alias("k")).distinct()
    e = entities(spark, root).groupBy("pid", "k").agg(F.min("kind").alias("kind"))
    return d.join(e, ["pid", "k"], "left").select("pid", "k", "kind", c("kind").isNull().alias("stale"))


@query(f"""WITH {_PURPOSES}, {ENTITIES}, u AS (SELECT pid, path, string_split(path, '/') p FROM (SELECT DISTINCT pid, path FROM ent WHERE path IS NOT NULL)), up AS (SELECT pid, path, array_to_string(p[1:i], '/') a, len(p) - i d FROM (SELECT *, unnest(range(1, len(p) + 1)) i FROM u) UNION ALL SELECT pid, path, '.', len(p) FROM u),
near AS (SELECT up.pid, up.path, arg_min(purpose.path, d) AS owner FROM up JOIN purpose ON purpose.pid = up.pid AND purpose.path = up.a WHERE status = 'approved' AND source = 'agent' GROUP BY 1, 2) SELECT ent.pid, ent.k, CASE WHEN ent.path IS NULL THEN 'not_applicable' WHEN owner IS NULL THEN 'unavailable' ELSE 'approved' END AS state, owner FROM ent LEFT JOIN near USING (pid, path)""")
def s093_purpose_projection(spark: SparkSession, root: str) -> DataFrame:
    """The nearest reviewed purpose over each entity, unavailable if there is none, not applicable to entities without a file."""
    e = entities(spark, root)
    owned = e.where("path IS NOT NULL").select("pid", "path").distinct().select("pid", "path", F.posexplode(P.ancestors(c("path"))).alias("d", "a"))
    p = purposes(spark, root).where("status = 'approved' AND source = 'agent'").select("pid", c("path").alias("a"))
    near = owned.join(p, ["pid", "a"]).groupBy("pid", "path").agg(F.min_by("a", "d").alias("owner"))
    state = F.when(c("path").isNull(), "not_applicable").when(c("owner").isNull(), "unavailable").otherwise("approved")
    return e.join(near, ["pid", "path"], "left").select("pid", "k", state.alias("state"), "owner")


@query("SELECT relation_key, relation_id, i::INT AS occurrence FROM (SELECT lower(relation_key) AS relation_key, relation_id, row_number() OVER (PARTITION BY lower(relation_key) ORDER BY relation_id) i FROM (SELECT DISTINCT relation_key, relation_id FROM graph_relations WHERE relation_key IS NOT NULL AND relation_id IS NOT NULL)) WHERE i <= 2")
def s095_occurrences(spark: SparkSession, root: str) -> DataFrame:
    """At most two stored occurrences of each relation; the rank is cut before the exchange."""
    t = table(spark, root, "graph_relations", "relation_key", "relation_id").dropna().distinct().select(hex_key("relation_key").alias("relation_key"), "relation_id")
    w = W.partitionBy("relation_key").orderBy("relation_id")
    return t.withColumn("occurrence", F.row_number().over(w)).where("occurrence <= 2")


# ---------------------------------------------------------------- resolution

_LOCAL = f"""{ENTITIES}, {RELATIONS}, fact AS (SELECT DISTINCT rel.pid, rel.rk, rel.kind, rel.src, s.path, s.name AS caller, s.symbol_parent AS caller_parent, {_LEAF} AS leaf FROM rel JOIN ent s ON s.pid = rel.pid AND s.k = rel.src WHERE ref IS NOT NULL),
loc AS (SELECT fact.pid, fact.rk, t.k AS target FROM fact JOIN ent t ON t.pid = fact.pid AND t.path = fact.path AND t.name = fact.leaf WHERE t.kind = 'symbol' AND ((fact.kind = 'contains' AND t.symbol_parent = fact.caller) OR (fact.kind = 'calls' AND (t.symbol_parent IS NULL OR t.symbol_parent = fact.caller OR t.symbol_parent = fact.caller_parent))))"""


def relation_facts(spark: SparkSession, root: str) -> DataFrame:
    """(pid, rk, kind, src, path, caller, caller_parent, leaf): relations that name their target, with their source."""
    s = entities(spark, root).select("pid", c("k").alias("src"), "path", c("name").alias("caller"), c("symbol_parent").alias("caller_parent"))
    return relations(spark, root).where("ref IS NOT NULL").select("pid", "rk", "kind", "src", leaf(c("ref")).alias("leaf")).join(s, ["pid", "src"]).distinct()


def local_matches(facts: DataFrame, e: DataFrame) -> DataFrame:
    """(pid, rk, target): declarations of the same file that a 'contains' or 'calls' relation means.

    contains: the target's parent is the source. calls: the target has no parent, or the source or the source's parent is its parent.
    """
    t = e.where("kind = 'symbol'").select("pid", "path", c("name").alias("leaf"), c("k").alias("target"), "symbol_parent")
    near = c("symbol_parent").isNull() | (c("symbol_parent") == c("caller")) | (c("symbol_parent") == c("caller_parent"))
    fits = ((c("kind") == "contains") & (c("symbol_parent") == c("caller"))) | ((c("kind") == "calls") & near)
    return facts.join(t, ["pid", "path", "leaf"]).where(fits).select("pid", "rk", "target")


@query(f"WITH {_LOCAL} SELECT DISTINCT pid, rk, target FROM loc")
def s098_local_matches(spark: SparkSession, root: str) -> DataFrame:
    return local_matches(relation_facts(spark, root), entities(spark, root)).distinct()


_REGISTRY = "reg AS (SELECT DISTINCT d.pid, lower(r.relation_key) AS rk, x.target FROM d JOIN (SELECT DISTINCT dependency_id, relation_key FROM graph_relation_dependencies) r USING (dependency_id) JOIN x USING (pid, domain, digest))"


def registry_matches(spark: SparkSession, root: str) -> DataFrame:
    """(pid, rk, target): what the keys a relation depends on are exported by."""
    d = table(spark, root, "graph_relation_dependencies", "project_instance_id", "relation_key", "resolution_domain", "key_digest").select(hex_key("project_instance_id").alias("pid"), hex_key("relation_key").alias("rk"), c("resolution_domain").alias("domain"), hex_key("key_digest").alias("digest")).distinct()
    x = exports(spark, root).select("pid", "domain", "digest", "target").distinct()
    return d.join(x, ["pid", "domain", "digest"]).select("pid", "rk", "target").distinct()


@query(f"WITH {_EXPORTS}, {_REGISTRY} SELECT pid, rk, target FROM reg")
def s104_candidates(spark: SparkSession, root: str) -> DataFrame:
    return registry_matches(spark, root)


@query(f"""WITH {_LOCAL}, {_EXPORTS}, {_REGISTRY}, f AS (SELECT DISTINCT pid, rk, kind FROM rel WHERE kind IN ('contains', 'calls', 'imports', 'depends-on')), l AS (SELECT pid, rk, count(DISTINCT target) n, min(target) t FROM loc GROUP BY 1, 2), r AS (SELECT pid, rk, count(DISTINCT target) n, min(target) t FROM reg GROUP BY 1, 2),
ext AS (SELECT DISTINCT rel.pid, rel.rk FROM rel JOIN ent ON ent.pid = rel.pid AND ent.k = rel.dst WHERE ent.kind = 'external'),
m AS (SELECT f.pid, f.rk, f.kind, CASE WHEN kind = 'contains' THEN coalesce(l.n, 0) WHEN kind = 'calls' THEN CASE WHEN coalesce(l.n, 0) > 0 THEN l.n ELSE coalesce(r.n, 0) END ELSE coalesce(r.n, 0) END n, CASE WHEN kind = 'contains' OR (kind = 'calls' AND coalesce(l.n, 0) > 0) THEN l.t ELSE r.t END t FROM f LEFT JOIN l USING (pid, rk) LEFT JOIN r USING (pid, rk))
SELECT m.pid, m.rk, kind, n AS candidates, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' WHEN ext.rk IS NOT NULL THEN 'external' ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN t END AS target FROM m LEFT JOIN ext USING (pid, rk)""")
def s099_relation_resolution(spark: SparkSession, root: str) -> DataFrame:
    """Relations resolved anew: what a file contains by its own declarations, calls by those and else by exported keys, imports and dependencies by keys."""
    e, r = entities(spark, root), relations(spark, root)
    f = r.where(c("kind").isin("contains", "calls", "imports", "depends-on")).select("pid", "rk", "kind").distinct()
    counted = lambda df, n, t: df.groupBy("pid", "rk").agg(F.count_distinct("target").alias(n), F.min("target").alias(t))
    loc, reg = counted(local_matches(relation_facts(spark, root), e), "ln", "lt"), counted(registry_matches(spark, root), "rn", "rt")
    outside = r.where("dst IS NOT NULL").select("pid", "rk", c("dst").alias("k")).join(e.where("kind = 'external'").select("pid", "k"), ["pid", "k"], "left_semi").select("pid", "rk").distinct().withColumn("ext", F.lit(True))
    m = f.join(loc, ["pid", "rk"], "left").join(reg, ["pid", "rk"], "left").join(outside, ["pid", "rk"], "left")
    own = (c("kind") == "contains") | ((c("kind") == "calls") & (F.coalesce("ln", F.lit(0)) > 0))
    n = F.coalesce(F.when(own, c("ln")).otherwise(c("rn")), F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").when(c("ext"), "external").otherwise("unresolved")
    return m.select("pid", "rk", "kind", n.alias("candidates"), status.alias("status"), F.when(n == 1, F.when(own, c("lt")).otherwise(c("rt"))).alias("target"))


@query(f"""WITH {NODES}, {_CALLS_SQL}, low AS (SELECT *, lower(regexp_replace(target, '!+$', '')) low FROM arg), acc AS (SELECT pid, path, line_no, CASE WHEN regexp_extract(low, '[^:./]+$') IN {_in(X.READ_CALLS)} OR ends_with(low, 'file::open') THEN 'reads' WHEN regexp_extract(low, '[^:./]+$') IN {_in(X.WRITE_CALLS)} OR ends_with(low, 'file::create') THEN 'writes' END AS kind,
  CASE WHEN argument = '' OR regexp_matches(argument, '^[/~]|://|[${{}}]|^[^/]*:') OR contains('/' || argument || '/', '/../') THEN NULL ELSE nullif(regexp_replace(regexp_replace('/' || argument || '/', '(/\\.)+/', '/', 'g'), '^/+|/+$', '', 'g'), '') END AS target FROM low),
env AS (SELECT pid, path, line_no, argument FROM low WHERE (low IN {_in(X.ENV_CALLS)} OR """ + " OR ".join(f"ends_with(low, '{x}')" for x in X.ENV_ENDINGS) + f""") AND regexp_full_match(argument, '[A-Z0-9_]{{1,128}}'))
SELECT acc.pid, acc.path, line_no, acc.kind, acc.target, CASE WHEN node.path IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution FROM acc LEFT JOIN node ON node.pid = acc.pid AND node.path = acc.target AND node.kind = 'file' WHERE acc.kind IS NOT NULL AND acc.target IS NOT NULL
UNION ALL SELECT pid, path, line_no, 'configures', argument, 'external' FROM env""")
def s294_derived_relations(spark: SparkSession, root: str) -> DataFrame:
    """Relations derived from calls: files read and written (resolved if the repository has them), variables of the environment."""
    calls = call_lines(spark, root)
    acc = calls.select("pid", "path", "line_no", X.data_access(c("target")).alias("kind"), X.static_path(X.static_argument(c("context"))).alias("target")).where("kind IS NOT NULL AND target IS NOT NULL")
    known = nodes(spark, root).where("kind = 'file'").select("pid", c("path").alias("target"), F.lit(True).alias("known"))
    acc = acc.join(known, ["pid", "target"], "left").select("pid", "path", "line_no", "kind", "target", F.when(c("known"), "resolved").otherwise("unresolved").alias("resolution"))
    env = calls.select("pid", "path", "line_no", F.lit("configures").alias("kind"), X.environment_key(c("target"), c("context")).alias("target"), F.lit("external").alias("resolution")).where("target IS NOT NULL")
    return acc.unionByName(env)


_MENTION = r"`([A-Za-z0-9_./-]+\.[a-z]{1,5})`"
_DOCLINK = f"""n AS (SELECT DISTINCT path FROM nodes WHERE path IS NOT NULL AND kind = 'file'), fold AS (SELECT lower(path) low, min(path) path, count(*) spelled FROM n GROUP BY 1),
l AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_MENTION}', 1)) AS target FROM documents), r AS (SELECT l.doc_id, l.target, CASE WHEN n.path IS NOT NULL THEN 'resolved' WHEN fold.low IS NOT NULL THEN 'case_conflict' WHEN starts_with(target, '../') THEN 'outside_root' ELSE 'missing' END AS status FROM l LEFT JOIN n ON n.path = l.target LEFT JOIN fold ON fold.low = lower(l.target))"""


@query(f"WITH {_DOCLINK} SELECT * FROM r")
def s101_document_targets(spark: SparkSession, root: str) -> DataFrame:
    """Files that documents mention: resolved, of another spelling, outside the root, or missing."""
    n = table(spark, root, "nodes", "path", "kind").where("path IS NOT NULL AND kind = 'file'").select("path").distinct()
    d = table(spark, root, "documents", "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MENTION), F.lit(1))).alias("target")).distinct()
    both = d.join(n.select(c("path").alias("target"), F.lit(True).alias("here")), "target", "left").withColumn("low", F.lower("target"))
    both = both.join(n.select(F.lower("path").alias("low")).distinct().withColumn("near", F.lit(True)), "low", "left")
    return both.select("doc_id", "target", F.when(c("here"), "resolved").when(c("near"), "case_conflict").when(c("target").startswith("../"), "outside_root").otherwise("missing").alias("status"))


@query(f"WITH {_DOCLINK} SELECT doc_id, count(*) AS links, count(*) FILTER (status = 'resolved') AS resolved, min(target) FILTER (status = 'resolved') AS first_target FROM r GROUP BY 1")
def s297_document_rows(spark: SparkSession, root: str) -> DataFrame:
    """Documents with the number of different files they mention and how many of those exist."""
    r = s101_document_targets(spark, root)
    hit = c("status") == "resolved"
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(hit).alias("resolved"), F.min(F.when(hit, c("target"))).alias("first_target"))


@query(f"WITH {NODES} SELECT pid, lower(path) AS folded, min(path) AS path, count(*) AS spellings, CASE WHEN count(*) > 1 THEN 'case_conflict' WHEN bool_or(exists_now) THEN 'present' ELSE 'absent' END AS decision FROM node WHERE kind = 'file' GROUP BY 1, 2")
def s102_document_index(spark: SparkSession, root: str) -> DataFrame:
    """What a link to a path can mean: by folded path, present, gone, or several spellings."""
    n = nodes(spark, root).where("kind = 'file'").groupBy("pid", F.lower("path").alias("folded"))
    return n.agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("spellings"), F.when(F.count(F.lit(1)) > 1, "case_conflict").when(F.bool_or("exists_now"), "present").otherwise("absent").alias("decision"))


_DECL = (
    f"{_LINE}, decl_ AS (SELECT *, CASE " + " ".join(f"WHEN regexp_matches(t, '{_sql_rx(r)}') THEN regexp_extract(t, '{_sql_rx(r)}', 1)" for _, r in __import__("treeline.operators.extract", fromlist=["DECLARATIONS"]).DECLARATIONS)
    + " END AS name FROM line), decl AS (SELECT pid, path, line_no, name, t FROM decl_ WHERE name IS NOT NULL)"
)


def declared(spark: SparkSession, root: str) -> DataFrame:
    return from_latest_texts(spark, root, lambda t: declarations(t, ["pid", "path", "_k"]))


@query(f"WITH {_DECL}, {ENTITIES}, one AS (SELECT pid, path, name, min(line_no) line_no, count(*) n FROM decl GROUP BY 1, 2, 3) SELECT ent.pid, ent.k, one.line_no, one.n = 1 AS exact FROM ent JOIN one USING (pid, path, name) WHERE ent.kind = 'symbol'")
def s106_symbol_identity(spark: SparkSession, root: str) -> DataFrame:
    """Symbols of the graph with the line that declares them in the text."""
    one = declared(spark, root).groupBy("pid", "path", "name").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"))
    return entities(spark, root).where("kind = 'symbol'").join(one, ["pid", "path", "name"]).select("pid", "k", "line_no", (c("n") == 1).alias("exact"))


@query(f"WITH {ENTITIES} SELECT pid, path, name, count(*) AS found, CASE WHEN count(*) = 1 THEN 'found' ELSE 'ambiguous' END AS outcome, CASE WHEN count(*) = 1 THEN min(k) END AS k FROM ent WHERE kind = 'symbol' GROUP BY 1, 2, 3")
def s112_symbol_lookup(spark: SparkSession, root: str) -> DataFrame:
    """What a look-up by file and name meets: one symbol, or several candidates."""
    g = entities(spark, root).where("kind = 'symbol'").groupBy("pid", "path", "name").agg(F.count(F.lit(1)).alias("found"), F.min("k").alias("k"))
    return g.select("pid", "path", "name", "found", F.when(c("found") == 1, "found").otherwise("ambiguous").alias("outcome"), F.when(c("found") == 1, c("k")).alias("k"))


@query(f"WITH {_DECL}, u AS (SELECT pid, path, name, min(line_no) AS first FROM decl GROUP BY 1, 2, 3 HAVING count(*) = 1) SELECT u.pid, u.path, u.name, u.first AS line_no, array_to_string(l.l[u.first:u.first + 2], chr(10)) AS slice FROM u JOIN (SELECT DISTINCT pid, path, l FROM ln) l USING (pid, path)")
def s113_symbol_slice(spark: SparkSession, root: str) -> DataFrame:
    """The first three lines of every symbol whose name is declared once in its file, cut out behind the scan."""

    def cut(t: DataFrame) -> DataFrame:
        d = declarations(t.withColumn("_whole", T.lines(c("content"))), ["pid", "path", "_k", "_whole"])
        return d.select("pid", "path", "_k", "name", "line_no", F.array_join(F.slice("_whole", c("line_no"), 3), "\n").alias("slice"))

    rows = from_latest_texts(spark, root, cut)
    once = rows.groupBy("pid", "path", "name").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return rows.join(once, ["pid", "path", "name"]).select("pid", "path", "name", "line_no", "slice")


@query(f"WITH {NODES}, {TEXTS}, {ENTITIES}, dirty AS (SELECT node.pid, node.path FROM node JOIN txt USING (pid, path) WHERE node.kind = 'file' AND node.content_hash IS DISTINCT FROM txt.content_hash) SELECT ent.pid, ent.k, ent.kind FROM ent JOIN dirty USING (pid, path)")
def s114_impact_seeds(spark: SparkSession, root: str) -> DataFrame:
    """Entities of files that differ from their indexed text."""
    t = latest_states(spark, root).select("pid", "path", c("content_hash").alias("h"))
    dirty = nodes(spark, root).where("kind = 'file'").join(t, ["pid", "path"]).where(~c("content_hash").eqNullSafe(c("h"))).select("pid", "path")
    return entities(spark, root).join(dirty, ["pid", "path"]).select("pid", "k", "kind")


# ---------------------------------------------------------------- names of modules and symbols

_ALIAS = f"""stem_ AS (SELECT DISTINCT pid, path, regexp_replace(path, '({"|".join(x.replace(".", "[.]") for x in X.STRIPPED)})$', '') s FROM {{src}}), stems AS (SELECT pid, path, unnest(CASE WHEN regexp_matches(s, '/(index|__init__|mod)$') THEN [s, regexp_replace(s, '/[^/]*$', '')] ELSE [s] END) AS stem FROM stem_),
parts_ AS (SELECT pid, path, list_filter(string_split(stem, '/'), lambda x: x <> '') p FROM stems), parts2 AS (SELECT pid, path, CASE WHEN p[1] = 'src' THEN p[2:] ELSE p END p FROM parts_), parts3 AS (SELECT pid, path, CASE WHEN p[-1] IN ('lib', 'main', 'mod', 'index', '__init__') THEN p[1:len(p) - 1] ELSE p END p FROM parts2),
alias AS (SELECT DISTINCT pid, path, unnest([array_to_string(p, '::'), array_to_string(p, '.'), p[-1]]) AS alias FROM parts3 WHERE len(p) > 0)"""


@query(f"WITH {NODES}, " + _ALIAS.replace("{src}", "node WHERE kind = 'file'") + " SELECT pid, path, alias FROM alias")
def s226_all_aliases(spark: SparkSession, root: str) -> DataFrame:
    """All names a file's module goes by."""
    return nodes(spark, root).where("kind = 'file'").select("pid", "path", F.explode(X.module_aliases(c("path"))).alias("alias"))


_QUALIFIED = f"""{ENTITIES}, sym AS (SELECT DISTINCT pid, k, path, name FROM ent WHERE kind = 'symbol' AND path IS NOT NULL AND name IS NOT NULL), """ + _ALIAS.replace("{src}", "sym") + """,
qual_ AS (SELECT sym.pid, sym.k, sym.path, unnest([alias || '::' || name, alias || '.' || name, 'crate::' || alias || '::' || name, 'crate.' || alias || '.' || name]) AS target FROM sym JOIN alias USING (pid, path) UNION ALL SELECT sym.pid, sym.k, sym.path, unnest(['crate::' || name, 'self::' || name]) FROM sym WHERE NOT EXISTS (SELECT 1 FROM alias WHERE alias.pid = sym.pid AND alias.path = sym.path)), qual AS (SELECT DISTINCT * FROM qual_)"""


def qualified_names(spark: SparkSession, root: str) -> DataFrame:
    """(pid, k, path, target): qualified names that stand for a symbol."""
    s = entities(spark, root).where("kind = 'symbol' AND path IS NOT NULL AND name IS NOT NULL").select("pid", "k", "path", "name").distinct()
    return s.select("pid", "k", "path", F.explode(X.target_aliases(c("path"), c("name"))).alias("target"))


@query(f"WITH {_QUALIFIED} SELECT pid, target, count(*) AS symbols FROM qual GROUP BY 1, 2")
def s140_alias_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many symbols each qualified name stands for."""
    return qualified_names(spark, root).groupBy("pid", "target").agg(F.count(F.lit(1)).alias("symbols"))


@query(f"""WITH {_QUALIFIED}, {RELATIONS}, f AS (SELECT DISTINCT rel.pid, rel.rk, s.path, trim(rel.ref) AS target FROM rel JOIN (SELECT DISTINCT pid, k, path FROM ent) s ON s.pid = rel.pid AND s.k = rel.src WHERE rel.kind = 'calls' AND ref IS NOT NULL), nm AS (SELECT pid, name, count(*) n FROM sym GROUP BY 1, 2), q AS (SELECT pid, target, min(k) k FROM qual GROUP BY 1, 2 HAVING count(*) = 1)
SELECT DISTINCT * FROM (SELECT f.pid, f.rk, sym.k, 'name' AS why FROM f JOIN sym ON sym.pid = f.pid AND sym.name = f.target JOIN nm ON nm.pid = sym.pid AND nm.name = sym.name WHERE sym.path = f.path OR nm.n = 1 UNION ALL SELECT f.pid, f.rk, q.k, 'qualified' FROM f JOIN q USING (pid, target))""")
def s108_called_by_rule(spark: SparkSession, root: str) -> DataFrame:
    """Which calls belong to a symbol: its name in its own file or unique in the repository, or a qualified name only it has."""
    e = entities(spark, root)
    s = e.select("pid", c("k").alias("src"), "path").distinct()
    f = relations(spark, root).where("kind = 'calls' AND ref IS NOT NULL").select("pid", "rk", "src", F.btrim("ref").alias("target")).join(s, ["pid", "src"]).select("pid", "rk", "path", "target").distinct()
    sym = e.where("kind = 'symbol' AND path IS NOT NULL AND name IS NOT NULL").select("pid", "k", c("path").alias("home"), c("name").alias("target")).distinct()
    n = sym.groupBy("pid", "target").agg(F.count(F.lit(1)).alias("n"))
    named = f.join(sym, ["pid", "target"]).join(n, ["pid", "target"]).where("home = path OR n = 1").select("pid", "rk", "k", F.lit("name").alias("why"))
    q = qualified_names(spark, root).groupBy("pid", "target").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k")).where("n = 1").drop("n")
    return named.unionByName(f.join(q, ["pid", "target"]).select("pid", "rk", "k", F.lit("qualified").alias("why"))).distinct()


@query(f"WITH {_QUALIFIED} SELECT pid, k, sha256(length('module')::VARCHAR || ':module;' || length(target)::VARCHAR || ':' || target || ';') AS key FROM qual")
def s292_resolution_keys(spark: SparkSession, root: str) -> DataFrame:
    """Keys under which a symbol can be found: digests of its qualified names."""
    return qualified_names(spark, root).select("pid", "k", F.sha2(T.framed(F.lit("module"), c("target")), 256).alias("key"))


# ---------------------------------------------------------------- rows of the graph

_ID = lambda *x: "sha256(" + " || ".join(f"CASE WHEN {y} IS NULL THEN '-;' ELSE length({y})::VARCHAR || ':' || {y} || ';' END" for y in x) + ")"


@query(f"WITH {_DECL}, {NODES}, e AS (SELECT pid, kind AS entity, path, NULL::VARCHAR AS name FROM node WHERE exists_now UNION ALL SELECT DISTINCT pid, 'symbol', path, name FROM decl UNION ALL SELECT DISTINCT pid, 'project', '.', NULL FROM node) SELECT pid, entity, path, name, {_ID('entity', 'path', 'name')} AS identity FROM e")
def s295_entities(spark: SparkSession, root: str) -> DataFrame:
    """Entities of a repository: itself, its folders and files, and what its texts declare, each with its identity."""
    n = nodes(spark, root)
    none = F.lit(None).cast("string").alias("name")
    e = n.where("exists_now").select("pid", c("kind").alias("entity"), "path", none)
    e = e.unionByName(declared(spark, root).select("pid", F.lit("symbol").alias("entity"), "path", "name").distinct())
    e = e.unionByName(n.select("pid").distinct().select("pid", F.lit("project").alias("entity"), F.lit(".").alias("path"), none))
    return e.withColumn("identity", F.sha2(T.framed(c("entity"), c("path"), c("name")), 256))


@query(f"WITH {_DECL}, r AS (SELECT pid, 'contains' AS kind, path, name, count(*) AS occurrences, min(line_no) AS first_line FROM decl GROUP BY pid, path, name) SELECT *, {_ID('kind', 'path', 'name')} AS identity FROM r")
def s296_relation_rows(spark: SparkSession, root: str) -> DataFrame:
    """Files and what they declare as relations; the same one met twice is one relation with two occurrences."""
    r = declared(spark, root).groupBy("pid", "path", "name").agg(F.count(F.lit(1)).alias("occurrences"), F.min("line_no").alias("first_line")).withColumn("kind", F.lit("contains"))
    return r.withColumn("identity", F.sha2(T.framed(c("kind"), c("path"), c("name")), 256))


# Languages read by a full parser; others are read by their structure or line by line.
PARSED = ["python", "javascript", "typescript", "tsx", "rust", "go", "java", "kotlin", "csharp", "c", "cpp", "h", "hpp", "objective-c", "zig", "rust-build-script"]
MANIFESTS = ["cargo-manifest", "cargo-lock"]
STRUCTURAL = ["vue", "markdown", "json", "yaml", "css", "html", "toon", "text", "toml", "xml", "config"]


def parser_of(language):
    return F.when(language.isin(PARSED), "tree-sitter").when(language.isin(MANIFESTS), "manifest").when(language.isin(STRUCTURAL), "structural").otherwise("fallback")


_PARSER = f"CASE WHEN language IN {_in(PARSED)} THEN 'tree-sitter' WHEN language IN {_in(MANIFESTS)} THEN 'manifest' WHEN language IN {_in(STRUCTURAL)} THEN 'structural' ELSE 'fallback' END"


@query(f"WITH {_DECL}, {NODES}, cnt AS (SELECT pid, path, count(*) n FROM decl GROUP BY 1, 2), f AS (SELECT node.pid, node.path, {_PARSER} AS parser, coalesce(n, 0) AS covered FROM node LEFT JOIN cnt USING (pid, path) WHERE kind = 'file' AND exists_now) SELECT *, CASE WHEN parser IN ('tree-sitter', 'manifest') THEN 'complete' WHEN covered > 0 THEN 'partial' ELSE 'failed' END AS state, CASE WHEN parser IN ('tree-sitter', 'manifest') THEN 0 ELSE 1 END AS omitted, CASE WHEN parser IN ('tree-sitter', 'manifest') THEN 'exact' WHEN parser = 'structural' THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN parser IN ('tree-sitter', 'manifest') THEN 'complete' ELSE 'partial' END AS completeness FROM f")
def s298_parse_coverage(spark: SparkSession, root: str) -> DataFrame:
    """What the reading of each file covers (298), and the confidence and completeness of what it gives (300), by its parser."""
    n = declared(spark, root).groupBy("pid", "path").agg(F.count(F.lit(1)).alias("n"))
    f = nodes(spark, root).where("kind = 'file' AND exists_now").join(n, ["pid", "path"], "left").select("pid", "path", parser_of(F.coalesce("language", F.lit(""))).alias("parser"), F.coalesce("n", F.lit(0)).alias("covered"))
    full = c("parser").isin("tree-sitter", "manifest")
    state = F.when(full, "complete").when(c("covered") > 0, "partial").otherwise("failed")
    return f.select("*", state.alias("state"), F.when(full, 0).otherwise(1).alias("omitted"), F.when(full, "exact").when(c("parser") == "structural", "medium").otherwise("low").alias("confidence"), F.when(full, "complete").otherwise("partial").alias("completeness"))


@query("WITH f AS (SELECT doc_id, length(text) - length(replace(text, '```', '')) AS marks, n_chars FROM documents) SELECT doc_id, CASE WHEN n_chars = 0 THEN 'no_candidates' WHEN marks // 3 % 2 = 1 THEN 'partial' ELSE 'complete' END AS state FROM f")
def s299_document_coverage(spark: SparkSession, root: str) -> DataFrame:
    """How far a document could be read: an empty one has nothing to find, one whose fence stays open is read in part."""
    d = table(spark, root, "documents", "doc_id", "text", "n_chars")
    marks = F.floor((F.char_length("text") - F.char_length(F.replace("text", F.lit("```"), F.lit("")))) / 3)
    return d.select("doc_id", F.when(c("n_chars") == 0, "no_candidates").when(marks % 2 == 1, "partial").otherwise("complete").alias("state"))


# ---------------------------------------------------------------- lists and summaries


@query(f"WITH {ENTITIES} SELECT pid, path, name, symbol_kind, signature FROM ent WHERE kind = 'symbol' AND starts_with(path, 'internal/') AND (contains(lower(name), 'journal') OR contains(lower(signature), 'journal'))")
def s253_symbols(spark: SparkSession, root: str) -> DataFrame:
    """Symbols below a folder whose name or signature holds a word."""
    hit = F.lower("name").contains("journal") | F.lower("signature").contains("journal")
    return entities(spark, root).where((c("kind") == "symbol") & c("path").startswith("internal/") & hit).select("pid", "path", "name", "symbol_kind", "signature")


@query(f"WITH {ENTITIES}, {RELATIONS} SELECT rel.pid, rel.rk, s.path, rel.kind, rel.ref FROM rel JOIN ent s ON s.pid = rel.pid AND s.k = rel.src WHERE contains(coalesce(ref, ''), 'freeze') OR contains(coalesce(s.name, ''), 'freeze')")
def s254_relations(spark: SparkSession, root: str) -> DataFrame:
    """Relations whose source or target text holds a word."""
    s = entities(spark, root).select("pid", c("k").alias("src"), "path", "name")
    r = relations(spark, root).select("pid", "rk", "src", "kind", "ref").join(s, ["pid", "src"])
    return r.where(F.coalesce("ref", F.lit("")).contains("freeze") | F.coalesce("name", F.lit("")).contains("freeze")).select("pid", "rk", "path", "kind", "ref")


@query(f"""WITH {ENTITIES}, {RELATIONS}, w AS (SELECT lower(project_instance_id) pid, scope_path path, max(CASE WHEN state IN ('complete', 'no_candidates') THEN 0 WHEN state = 'partial' THEN 1 ELSE 2 END) trust FROM graph_coverage GROUP BY 1, 2), s AS (SELECT DISTINCT pid, k, path FROM ent),
a AS (SELECT pid, path, count(*) FILTER (symbol_kind = 'function') functions, count(*) FILTER (symbol_kind = 'method') methods, count(*) FILTER (symbol_kind IN ('class', 'struct')) types FROM ent WHERE path IS NOT NULL GROUP BY 1, 2),
o AS (SELECT s.pid, s.path, count(*) FILTER (kind = 'imports') imports, count(*) FILTER (kind = 'calls') calls, count(*) FILTER (kind = 'depends-on') deps FROM rel JOIN s ON s.pid = rel.pid AND s.k = rel.src WHERE s.path IS NOT NULL GROUP BY 1, 2),
i AS (SELECT s.pid, s.path, count(*) called_by FROM rel JOIN s ON s.pid = rel.pid AND s.k = rel.dst WHERE rel.kind = 'calls' AND s.path IS NOT NULL GROUP BY 1, 2), x AS (SELECT pid, path, count(*) exports FROM s JOIN (SELECT DISTINCT lower(project_instance_id) pid, lower(entity_key) k FROM graph_entity_exports WHERE removed_at IS NULL) USING (pid, k) WHERE path IS NOT NULL GROUP BY 1, 2)
SELECT pid, path, functions, methods, types, coalesce(imports, 0) AS imports, coalesce(calls, 0) AS calls, coalesce(deps, 0) AS deps, coalesce(called_by, 0) AS called_by, coalesce(exports, 0) AS exports, trust FROM a LEFT JOIN o USING (pid, path) LEFT JOIN i USING (pid, path) LEFT JOIN x USING (pid, path) LEFT JOIN w USING (pid, path)""")
def s255_file_summary(spark: SparkSession, root: str) -> DataFrame:
    """Per file: what it declares, imports, calls, depends on and exports, how often it is called, and how far its reading can be trusted."""
    e, r = entities(spark, root), relations(spark, root)
    k = c("symbol_kind")
    a = e.where("path IS NOT NULL").groupBy("pid", "path").agg(F.count_if(k == "function").alias("functions"), F.count_if(k == "method").alias("methods"), F.count_if(k.isin("class", "struct")).alias("types"))
    s = e.where("path IS NOT NULL").select("pid", "k", "path").distinct()
    out = r.join(s.withColumnRenamed("k", "src"), ["pid", "src"]).groupBy("pid", "path").agg(*(F.count_if(c("kind") == x).alias(n) for x, n in (("imports", "imports"), ("calls", "calls"), ("depends-on", "deps"))))
    into = r.where("kind = 'calls'").join(s.withColumnRenamed("k", "dst"), ["pid", "dst"]).groupBy("pid", "path").agg(F.count(F.lit(1)).alias("called_by"))
    x = exports(spark, root).select("pid", c("target").alias("k")).distinct().join(s, ["pid", "k"]).groupBy("pid", "path").agg(F.count(F.lit(1)).alias("exports"))
    t = F.when(c("state").isin("complete", "no_candidates"), 0).when(c("state") == "partial", 1).otherwise(2)
    w = table(spark, root, "graph_coverage", "project_instance_id", "scope_path", "state").groupBy(hex_key("project_instance_id").alias("pid"), c("scope_path").alias("path")).agg(F.max(t).alias("trust"))
    every = a.join(out, ["pid", "path"], "left").join(into, ["pid", "path"], "left").join(x, ["pid", "path"], "left").join(w, ["pid", "path"], "left")
    return every.select("pid", "path", "functions", "methods", "types", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("imports", "calls", "deps", "called_by", "exports")), "trust")


@query(f"WITH {TEXTS} SELECT pid, count(*) AS texts, sum(strlen(content))::BIGINT AS bytes, sum(length(content))::BIGINT AS chars, sum(ceil(length(content) / 4.0))::BIGINT AS tokens FROM txt GROUP BY 1")
def s256_text_totals(spark: SparkSession, root: str) -> DataFrame:
    """A pass over all texts: their sizes and estimates."""
    t = from_latest_texts(spark, root, lambda x: x.select("pid", "path", "_k", F.octet_length("content").alias("b"), F.char_length("content").alias("n"), T.token_estimate(c("content")).alias("k")))
    return t.groupBy("pid").agg(F.count(F.lit(1)).alias("texts"), F.sum("b").alias("bytes"), F.sum("n").alias("chars"), F.sum("k").alias("tokens"))


@query(f"WITH {NODES} SELECT pid, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'folder') AS folders FROM node WHERE exists_now GROUP BY 1")
def s142_map_counters(spark: SparkSession, root: str) -> DataFrame:
    return nodes(spark, root).where("exists_now").groupBy("pid").agg(F.count_if(c("kind") == "file").alias("files"), F.count_if(c("kind") == "folder").alias("folders"))


@query(f"WITH {NODES} SELECT {_PARSER} AS support, count(DISTINCT language) AS languages, count(*) AS files FROM node WHERE kind = 'file' AND language IN {_in(list(CLASS_OF))} GROUP BY 1")
def s137_capability_counts(spark: SparkSession, root: str) -> DataFrame:
    """Languages met and their files by the kind of support they have."""
    n = nodes(spark, root).where((c("kind") == "file") & c("language").isin(list(CLASS_OF)))
    return n.groupBy(parser_of(c("language")).alias("support")).agg(F.count_distinct("language").alias("languages"), F.count(F.lit(1)).alias("files"))


# ---------------------------------------------------------------- sets


@query("SELECT DISTINCT lower(project_instance_id) AS pid, lower(source_entity_key) AS src, lower(target_entity_key) AS dst, relation_kind AS kind FROM graph_relations WHERE removed_at IS NULL AND relation_key IS NOT NULL AND target_entity_key IS NOT NULL")
def s181_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges once each; equal ones of different relations are one."""
    return relations(spark, root).where("dst IS NOT NULL").select("pid", "src", "dst", "kind").distinct()


@query(f"WITH {NODES}, {TEXTS}, a AS (SELECT node.pid, node.path, false AS full_scan FROM node JOIN txt USING (pid, path) WHERE node.content_hash IS DISTINCT FROM txt.content_hash UNION ALL SELECT pid, path, kind = 'folder' FROM node WHERE NOT exists_now) SELECT pid, path, bool_or(full_scan) AS full_scan FROM a GROUP BY 1, 2")
def s196_change_sets(spark: SparkSession, root: str) -> DataFrame:
    """Two sets of changed paths as one; a path asks for a full scan if it does in either."""
    n, t = nodes(spark, root), latest_states(spark, root).select("pid", "path", c("content_hash").alias("h"))
    changed = n.join(t, ["pid", "path"]).where(~c("content_hash").eqNullSafe(c("h"))).select("pid", "path", F.lit(False).alias("full_scan"))
    gone = n.where("NOT exists_now").select("pid", "path", (c("kind") == "folder").alias("full_scan"))
    return changed.unionByName(gone).groupBy("pid", "path").agg(F.bool_or("full_scan").alias("full_scan"))


@query(f"WITH {ENTITIES}, {RELATIONS} SELECT DISTINCT * FROM (SELECT rel.pid, rel.src, rel.dst, rel.ref FROM rel JOIN ent ON ent.pid = rel.pid AND ent.k = rel.src WHERE rel.kind = 'imports' AND starts_with(ent.path, 'internal/') UNION ALL SELECT rel.pid, rel.src, rel.dst, rel.ref FROM rel JOIN ent ON ent.pid = rel.pid AND ent.k = rel.dst WHERE rel.kind = 'imports' AND starts_with(ent.path, 'internal/'))")
def s198_distinct_imports(spark: SparkSession, root: str) -> DataFrame:
    """Imports from and into a folder, read by either end, each once."""
    e = entities(spark, root).where(c("path").startswith("internal/")).select("pid", "k").distinct()
    r = relations(spark, root).where("kind = 'imports'").select("pid", "src", "dst", "ref")
    by = lambda end: r.join(e.withColumnRenamed("k", end), ["pid", end], "left_semi").select("pid", "src", "dst", "ref")
    return by("src").unionByName(by("dst")).distinct()


@query(f"WITH {_PURPOSES} SELECT pid, path, coalesce(CASE WHEN status = 'approved' THEN purpose END, CASE WHEN kind = 'folder' THEN 'folder ' || path END) AS purpose FROM purpose WHERE status = 'approved' OR kind = 'folder'")
def s202_merged_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of folders, overridden by approved ones of the same path."""
    p = purposes(spark, root)
    base = p.where("kind = 'folder'").select("pid", "path", F.concat(F.lit("folder "), "path").alias("purpose"))
    return upsert(base, p.where("status = 'approved'").select("pid", "path", "purpose"), ["pid", "path"])


@query(f"WITH {ENTITIES}, x AS (SELECT DISTINCT pid, external_system, external_identity FROM ent WHERE kind = 'external' AND external_identity IS NOT NULL), m AS (SELECT min(pid) lo, max(pid) hi FROM x) SELECT external_system, external_identity FROM x, m WHERE pid < 'a' INTERSECT SELECT external_system, external_identity FROM x, m WHERE pid >= 'a'")
def s203_shared_externals(spark: SparkSession, root: str) -> DataFrame:
    """External things that two groups of repositories both refer to."""
    x = entities(spark, root).where("kind = 'external' AND external_identity IS NOT NULL").select("pid", "external_system", "external_identity")
    side = lambda cond: x.where(cond).select("external_system", "external_identity")
    return side(c("pid") < "a").intersect(side(c("pid") >= "a"))


@query(f"WITH {NODES}, last AS (SELECT lower(project_instance_id) pid, regexp_replace(replace(path, '\\', '/'), '^\\./', '') path, max((observed_at, record_id, lower(content_hash))) s FROM node_scans WHERE content_hash IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2), a AS (SELECT pid, path, content_hash h FROM node WHERE kind = 'file' AND NOT exists_now), "
       "e AS (SELECT pid, path, content_hash h FROM node WHERE kind = 'file' AND exists_now) SELECT coalesce(e.pid, last.pid) AS pid, coalesce(e.path, last.path) AS path, coalesce(last.s[3], e.h) AS content_hash FROM e FULL JOIN last USING (pid, path) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.pid = coalesce(e.pid, last.pid) AND a.path = coalesce(e.path, last.path))")
def s318_expected_nodes(spark: SparkSession, root: str) -> DataFrame:
    """Files expected after a delta: those known, without the absent, with the hashes of the last scan records."""
    n = nodes(spark, root).where("kind = 'file'")
    s = table(spark, root, "node_scans", "project_instance_id", "path", "content_hash", "observed_at", "record_id").where("content_hash IS NOT NULL AND path IS NOT NULL")
    last = s.groupBy(hex_key("project_instance_id").alias("pid"), tree_path("path").alias("path")).agg(F.max_by(hex_key("content_hash"), F.struct("observed_at", "record_id", hex_key("content_hash"))).alias("content_hash"))
    live, gone = n.where("exists_now").select("pid", "path", "content_hash"), n.where("NOT exists_now").select("pid", "path")
    return upsert(live, last, ["pid", "path"]).join(gone, ["pid", "path"], "left_anti")


# ---------------------------------------------------------------- coverage samples, lint, fitting


@query("WITH k AS (SELECT DISTINCT coverage_id, lower(project_instance_id) pid, scope_path, state FROM graph_coverage WHERE relation_kind IS NULL AND state NOT IN ('complete', 'no_candidates')), r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY state, coverage_id) i FROM k) SELECT pid, coverage_id, scope_path, state FROM r WHERE i <= 5")
def s278_coverage_sample(spark: SparkSession, root: str) -> DataFrame:
    """The first five records of incomplete parsing of each repository."""
    t = table(spark, root, "graph_coverage", "coverage_id", "project_instance_id", "scope_path", "relation_kind", "state").where("relation_kind IS NULL AND state NOT IN ('complete', 'no_candidates')")
    t = t.select(hex_key("project_instance_id").alias("pid"), "coverage_id", "scope_path", "state").distinct()
    return t.withColumn("i", F.row_number().over(W.partitionBy("pid").orderBy("state", "coverage_id"))).where("i <= 5").drop("i")


@query(f"WITH {_HEALTH}, u AS (SELECT pid, count(*) FILTER (extension NOT IN ('.css', '.md') AND regexp_extract(path, '^[^/]*') NOT IN ('src', 'lib', 'app')) n FROM node WHERE kind = 'file' GROUP BY 1), f AS (SELECT pid, count(*) FILTER (category IN ('stale_purpose', 'duplicate_purpose', 'temporary_folder')) n FROM finding GROUP BY 1) SELECT u.pid, u.n AS untracked, coalesce(f.n, 0) AS blocking, CASE WHEN u.n > 0 OR coalesce(f.n, 0) > 0 THEN 1 ELSE 0 END AS exit_code FROM u LEFT JOIN f USING (pid)")
def s310_lint(spark: SparkSession, root: str) -> DataFrame:
    """Outcome of a lint at its lowest level: untracked files that no rule allows (311) and findings that block."""
    n = nodes(spark, root).where("kind = 'file'")
    bad = ~c("extension").isin(".css", ".md") & ~F.regexp_extract("path", "^[^/]*", 0).isin("src", "lib", "app")
    u = n.groupBy("pid").agg(F.count_if(bad).alias("untracked"))
    f = health_findings(purposes(spark, root)).where(c("category").isin("stale_purpose", "duplicate_purpose", "temporary_folder")).groupBy("pid").agg(F.count(F.lit(1)).alias("blocking"))
    out = u.join(f, "pid", "left").withColumn("blocking", F.coalesce("blocking", F.lit(0)))
    return out.withColumn("exit_code", F.when((c("untracked") > 0) | (c("blocking") > 0), 1).otherwise(0))


@query(f"WITH {_HEALTH}, k AS (SELECT pid, category || ':' || path AS item, row_number() OVER (PARTITION BY pid ORDER BY category || ':' || path) n FROM (SELECT DISTINCT pid, category, path FROM finding)), cum AS (SELECT *, sum(strlen(item) + 1) OVER (PARTITION BY pid ORDER BY item) total FROM k) SELECT pid, item FROM cum WHERE n <= 100 AND total <= 500")
def s042_fitting(spark: SparkSession, root: str) -> DataFrame:
    """The longest beginning of each repository's findings that takes at most 500 bytes (a line each), of a hundred rows at most."""
    f = health_findings(purposes(spark, root)).select("pid", F.concat_ws(":", "category", "path").alias("item")).distinct()
    return bounded(f, F.octet_length("item") + 1, ["item"], 100, 500, ["pid"]).where("admitted").select("pid", "item")


# ---------------------------------------------------------------- stored nodes against what scans recorded

_LAST_SCAN = "scan AS (SELECT lower(project_instance_id) pid, regexp_replace(replace(path, '\\', '/'), '^\\./', '') path, max((observed_at, record_id, lower(content_hash))) s FROM node_scans WHERE content_hash IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2)"


def last_scan(spark: SparkSession, root: str) -> DataFrame:
    """(pid, path, content_hash) of the last record of each path."""
    s = table(spark, root, "node_scans", "project_instance_id", "path", "content_hash", "observed_at", "record_id").where("content_hash IS NOT NULL AND path IS NOT NULL")
    state = F.struct("observed_at", "record_id", hex_key("content_hash").alias("content_hash"))
    return s.groupBy(hex_key("project_instance_id").alias("pid"), tree_path("path").alias("path")).agg(F.max(state).alias("s")).select("pid", "path", "s.content_hash")


@query(f"WITH {NODES}, {_LAST_SCAN}, f AS (SELECT pid, path, content_hash FROM node WHERE kind = 'file' AND exists_now) SELECT coalesce(f.pid, scan.pid) AS pid, coalesce(f.path, scan.path) AS path, CASE WHEN f.path IS NULL THEN 'added' WHEN scan.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM f FULL JOIN scan ON f.pid = scan.pid AND f.path = scan.path WHERE f.path IS NULL OR scan.path IS NULL OR f.content_hash IS DISTINCT FROM scan.s[3]")
def s195_nodes_and_scans(spark: SparkSession, root: str) -> DataFrame:
    """What the last scan records add to, miss from and change in the stored files."""
    f = nodes(spark, root).where("kind = 'file' AND exists_now").select("pid", "path", "content_hash")
    return delta(f, last_scan(spark, root), ["pid", "path"], ["content_hash"])


@query(f"WITH {_PURPOSES}, {_LAST_SCAN}, f AS (SELECT node.pid, node.path, node.content_hash, purpose FROM node JOIN purpose USING (pid, path) WHERE node.kind = 'file') SELECT coalesce(f.pid, scan.pid) AS pid, coalesce(f.path, scan.path) AS path, CASE WHEN scan.path IS NOT NULL THEN scan.s[3] ELSE f.content_hash END AS content_hash, purpose, scan.path IS NOT NULL AS exists_now FROM f FULL JOIN scan ON f.pid = scan.pid AND f.path = scan.path")
def s030_replaced_by_scan(spark: SparkSession, root: str) -> DataFrame:
    """Stored files after the last scan: seen ones take its hash, unseen ones stay, marked gone, and purposes survive."""
    p = purposes(spark, root).select("pid", "path", "purpose")
    f = nodes(spark, root).where("kind = 'file'").select("pid", "path", "content_hash").join(p, ["pid", "path"])
    return replace_scan(f, last_scan(spark, root), ["pid", "path"], ["purpose"])
