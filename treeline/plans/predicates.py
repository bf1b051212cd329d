"""Queries of predicates and scalar functions over nodes, calls, relations, coverage and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import facts as X
from treeline.functions import paths as P
from treeline.functions import text as T
from treeline.functions.languages import CLASS_OF, content_class, selected
from treeline.plans.graph_queries import DEPENDENCY
from treeline.plans.index_tables import ENTITIES, NODES, RELATIONS, TEXTS, entities, from_latest_texts, latest_states, nodes, relations
from treeline.plans.paths_and_text import _SQL_CLASS, _SQL_LINES
from treeline.plans.registry import query
from treeline.plans.search_and_sets import _HEALTH, health_findings, purposes
from treeline.plans.usage_queries import _EV, calls
from treeline.sources.tables import hex_key, table

c = F.col


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


def _files(spark: SparkSession, root: str) -> DataFrame:
    return nodes(spark, root).where("kind = 'file'")


_CLASSED = f"{NODES}, {TEXTS}, classed AS (SELECT pid, path, language, {_SQL_CLASS} AS class FROM (SELECT node.pid, node.path, node.language, txt.path IS NOT NULL AS has_text FROM node LEFT JOIN txt USING (pid, path) WHERE kind = 'file'))"


def classed_files(spark: SparkSession, root: str) -> DataFrame:
    """(pid, path, language, class) of files."""
    text = latest_states(spark, root).select("pid", "path", F.lit(True).alias("has_text"))
    f = _files(spark, root).select("pid", "path", "language").join(text, ["pid", "path"], "left")
    return f.select("pid", "path", "language", content_class(c("language"), F.coalesce("has_text", F.lit(False))).alias("class"))


@query(f"WITH {_CLASSED} SELECT pid, count(*) AS unspecified, count(*) FILTER (class = 'source') AS source, count(*) FILTER (class = 'documentation') AS documentation, count(*) FILTER (class IN ('source', 'documentation')) AS both_ways FROM classed GROUP BY 1")
def s050_content_selection(spark: SparkSession, root: str) -> DataFrame:
    """Files each content selection takes."""
    n = lambda s, name: F.count_if(selected(c("class"), s)).alias(name)
    return classed_files(spark, root).groupBy("pid").agg(n(None, "unspecified"), n("source", "source"), n("documentation", "documentation"), n("both", "both_ways"))


@query(f"WITH {_CLASSED} SELECT pid, path, class, class IS DISTINCT FROM 'documentation' AS refused FROM classed WHERE starts_with(path, 'docs')")
def s051_selection_guard(spark: SparkSession, root: str) -> DataFrame:
    """Which files below docs a request for documentation must refuse."""
    f = classed_files(spark, root).where(c("path").startswith("docs"))
    return f.select("pid", "path", "class", (~selected(c("class"), "documentation")).alias("refused"))


@query(f"WITH {RELATIONS} SELECT pid, rk, kind, resolution FROM rel WHERE kind IN ('calls', 'references') AND confidence IN ('exact', 'high') AND resolution IN ('resolved', 'ambiguous')")
def s056_analysis_relations(spark: SparkSession, root: str) -> DataFrame:
    """Relations of two kinds over a trust floor, whatever their direction."""
    r = relations(spark, root)
    return r.where(c("kind").isin("calls", "references") & c("confidence").isin("exact", "high") & c("resolution").isin("resolved", "ambiguous")).select("pid", "rk", "kind", "resolution").distinct()


@query(f"WITH {RELATIONS} SELECT pid, rk, direction, CASE WHEN direction = 'inbound' THEN src WHEN resolution = 'resolved' THEN dst END AS endpoint FROM (SELECT DISTINCT pid, rk, src, dst, resolution FROM rel), (VALUES ('inbound'), ('outbound')) d(direction)")
def s057_traversable(spark: SparkSession, root: str) -> DataFrame:
    """Where a walk goes on from a relation: inbound to its source, outbound to a resolved target only."""
    r = relations(spark, root).select("pid", "rk", "src", "dst", "resolution").distinct().withColumn("direction", F.explode(F.array(F.lit("inbound"), F.lit("outbound"))))
    return r.select("pid", "rk", "direction", F.when(c("direction") == "inbound", c("src")).when(c("resolution") == "resolved", c("dst")).alias("endpoint"))


@query(f"WITH {ENTITIES}, {_CLASSED} SELECT ent.pid, ent.kind, count(*) AS entities, count(*) FILTER (class = 'source') AS selected FROM ent LEFT JOIN classed USING (pid, path) GROUP BY 1, 2")
def s058_entity_selection(spark: SparkSession, root: str) -> DataFrame:
    """Entities that a selection of source files takes: those with a file of that class, no others."""
    e = entities(spark, root).join(classed_files(spark, root).select("pid", "path", "class"), ["pid", "path"], "left")
    return e.groupBy("pid", "kind").agg(F.count(F.lit(1)).alias("entities"), F.count_if(selected(c("class"), "source")).alias("selected"))


@query(f"WITH {RELATIONS} SELECT kind, kind IN {_in(DEPENDENCY)} AS dependency, kind <> 'contains' AS network, count(*) AS relations FROM rel GROUP BY 1, 2, 3")
def s059_relation_families(spark: SparkSession, root: str) -> DataFrame:
    """Kinds that make a dependency (059) and kinds that take part in the network view (060)."""
    r = relations(spark, root)
    return r.groupBy("kind", c("kind").isin(DEPENDENCY).alias("dependency"), (c("kind") != "contains").alias("network")).agg(F.count(F.lit(1)).alias("relations"))


@query(f"WITH {ENTITIES} SELECT pid, k, path FROM ent WHERE kind = 'symbol' AND name = 'close' AND symbol_kind = 'method'")
def s061_anchor_match(spark: SparkSession, root: str) -> DataFrame:
    """Entities an anchor by name and kind means; parent and signature left open."""
    return match_anchor(entities(spark, root), name="close", symbol_kind="method").select("pid", "k", "path")


def match_anchor(e: DataFrame, path: str | None = None, name: str | None = None, symbol_kind: str | None = None, parent: str | None = None, signature: str | None = None) -> DataFrame:
    """Symbols (or, without a name, files) that agree with every part of an anchor that is given."""
    hit = e.where(c("kind") == ("file" if name is None else "symbol"))
    for col, want in (("path", path), ("name", name), ("symbol_kind", symbol_kind), ("symbol_parent", parent), ("signature", signature)):
        hit = hit if want is None else hit.where(c(col) == want)
    return hit


_GRAPH_TEST = "(list_has_any(string_split(low, '/'), ['test', 'tests', '__tests__']) OR contains(base, '.test.') OR contains(base, '.spec.') OR (contains(base, '.') AND (ends_with(split_part(base, '.', 1), '_test') OR starts_with(base, 'test_'))))"


def graph_test_path(path):
    """The graph's notion of a test path: letter case aside, a whole component, .test. or .spec., or a stem (to the first dot) that begins with test_ or ends in _test."""
    low = F.lower(F.translate(path, "\\", "/"))
    base = P.basename(low)
    stem = F.substring_index(base, ".", 1)
    return F.exists(F.split(low, "/"), lambda x: x.isin("test", "tests", "__tests__")) | base.contains(".test.") | base.contains(".spec.") | (base.contains(".") & (stem.endswith("_test") | stem.startswith("test_")))


@query(f"WITH {NODES}, b AS (SELECT pid, path, lower(path) low, lower(regexp_extract(path, '[^/]*$')) base FROM node WHERE kind = 'file') SELECT pid, path FROM b WHERE {_GRAPH_TEST}")
def s064_graph_tests(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root).where(graph_test_path(c("path"))).select("pid", "path")


# Languages with a symbol parser of their own or a fallback one; structural and opaque ones have none.
SYMBOLLESS = ["json", "yaml", "css", "html", "toon", "text", "toml", "xml", "config"]


@query(f"WITH {NODES} SELECT pid, path, language FROM node WHERE kind = 'file' AND exists_now AND language IN {_in([x for x in CLASS_OF if x not in SYMBOLLESS])}")
def s065_symbol_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Live files whose language has a symbol parser."""
    return _files(spark, root).where(c("exists_now") & c("language").isin([x for x in CLASS_OF if x not in SYMBOLLESS])).select("pid", "path", "language")


# The commands of the event table stand for those that replace reading a file (view, click) or searching (signup).
@query(f"WITH {_EV} SELECT session, count(*) FILTER (without_tokens > 0 AND command IN ('view', 'click')) AS replaced, count(*) FILTER (without_tokens > 0 AND command = 'signup' AND scope = 'session') AS avoided FROM ev GROUP BY 1")
def s067_read_events(spark: SparkSession, root: str) -> DataFrame:
    """Reads replaced (067) and avoided (068) per session: only events with a baseline count, avoidance also needs its kind of denominator."""
    some = c("without_tokens") > 0
    return calls(spark, root).groupBy("session").agg(F.count_if(some & c("command").isin("view", "click")).alias("replaced"), F.count_if(some & (c("command") == "signup") & (c("scope") == "session")).alias("avoided"))


# Findings that block at every level, and those that block above the lowest.
ALWAYS_BLOCKING = ["stale_purpose", "duplicate_purpose", "temporary_folder"]
BLOCKING_ABOVE_LOW = ["missing_purpose", "suggested_review", "agent_review_required"]


@query(f"WITH {_HEALTH} SELECT pid, count(*) FILTER (category IN {_in(ALWAYS_BLOCKING)}) AS low, count(*) FILTER (category IN {_in(ALWAYS_BLOCKING + BLOCKING_ABOVE_LOW)}) AS medium, count(*) FILTER (category IN {_in(ALWAYS_BLOCKING + BLOCKING_ABOVE_LOW)}) AS strict FROM finding GROUP BY 1")
def s069_lint_blocking(spark: SparkSession, root: str) -> DataFrame:
    """Findings that block a lint at each level."""
    f = health_findings(purposes(spark, root))
    blocks = lambda level: c("category").isin(ALWAYS_BLOCKING + ([] if level == "low" else BLOCKING_ABOVE_LOW))
    return f.groupBy("pid").agg(*(F.count_if(blocks(x)).alias(x) for x in ("low", "medium", "strict")))


@query(f"WITH {_HEALTH} SELECT pid, category, path, related_path FROM finding WHERE category = 'duplicate_purpose' AND (starts_with(path, 'src') OR starts_with(related_path, 'src'))")
def s070_health_filters(spark: SparkSession, root: str) -> DataFrame:
    """Findings of one category whose path, or the related one, begins as asked."""
    near = c("path").startswith("src") | F.coalesce(c("related_path").startswith("src"), F.lit(False))
    return health_findings(purposes(spark, root)).where((c("category") == "duplicate_purpose") & near)


@query("SELECT DISTINCT coverage_id, lower(project_instance_id) AS pid, scope_path, relation_kind, state, reason FROM graph_coverage WHERE starts_with(scope_path, 'src/') AND relation_kind = 'imports' AND reason = 'older_generation'")
def s071_coverage_filters(spark: SparkSession, root: str) -> DataFrame:
    """Coverage records by path prefix, relation and exact reason."""
    t = table(spark, root, "graph_coverage", "coverage_id", "project_instance_id", "scope_path", "relation_kind", "state", "reason")
    t = t.where(c("scope_path").startswith("src/") & (c("relation_kind") == "imports") & (c("reason") == "older_generation"))
    return t.select("coverage_id", hex_key("project_instance_id").alias("pid"), "scope_path", "relation_kind", "state", "reason").distinct()


@query("SELECT count(*) AS pairs, count(*) FILTER (same) AS same_source, count(*) FILTER (same AND m1 IS DISTINCT FROM m2) AS only_time FROM (SELECT a.mtime_ns m1, b.mtime_ns m2, (a.kind, a.extension, a.language, a.size_bytes, lower(a.content_hash)) IS NOT DISTINCT FROM (b.kind, b.extension, b.language, b.size_bytes, lower(b.content_hash)) AS same FROM (SELECT DISTINCT * FROM nodes) a JOIN (SELECT DISTINCT * FROM nodes) b ON a.path = b.path AND a.node_id < b.node_id)")
def s072_same_source(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of nodes of one path in different repositories that hold the same source; a time alone is no difference.

    Pairs are counted from the sizes of their classes, so no pair is ever formed.
    """
    state = ["kind", "extension", "language", "size_bytes", "h"]
    n = table(spark, root, "nodes", "node_id", "project_instance_id", "path", "kind", "parent_path", "extension", "language", "size_bytes", "mtime_ns", "content_hash", "exists_now", "first_seen_at", "last_seen_at").distinct().where("path IS NOT NULL")
    n = n.withColumn("h", F.lower("content_hash"))
    one = n.groupBy("path", "node_id", *state, "mtime_ns").agg(F.count(F.lit(1)).alias("k"))
    two = lambda k, less: (F.sum(k).cast("decimal(38,0)") * F.sum(k) - less) / 2

    def pairs(by: list[str]):
        per = one.groupBy("node_id", *by).agg(F.sum("k").alias("k")).groupBy(*by).agg(two(F.col("k"), F.sum(F.col("k") * F.col("k"))).alias("p"))
        return per.agg(F.coalesce(F.sum("p"), F.lit(0)).cast("bigint")).first()[0]

    every, same, timed = pairs(["path"]), pairs(["path", *state]), pairs(["path", *state, "mtime_ns"])
    return spark.range(1).select(F.lit(every).alias("pairs"), F.lit(same).alias("same_source"), F.lit(same - timed).alias("only_time"))


@query("SELECT path, count(*) FILTER (NOT list_has_any(string_split(p, '/'), ['', '.', '..']) OR p = '.') AS admitted, count(*) AS records FROM (SELECT DISTINCT record_id, path, replace(path, '\\', '/') p FROM node_scans) GROUP BY 1")
def s073_watch_admission(spark: SparkSession, root: str) -> DataFrame:
    """Scan record paths a watcher would take as they are written."""
    t = table(spark, root, "node_scans", "record_id", "path").distinct()
    return t.groupBy("path").agg(F.count_if(X.watch_admitted(F.translate("path", "\\", "/"))).alias("admitted"), F.count(F.lit(1)).alias("records"))


@query(f"WITH {NODES} SELECT pid, path FROM node WHERE path = '.' OR regexp_extract(path, '[^/]*$') IN {_in(X.FULL_SCAN_NAMES)} OR regexp_matches(path, '(^|/)\\.git(/info/exclude)?$')")
def s074_full_scan_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths whose change asks for a full scan."""
    return nodes(spark, root).where(X.requires_full_scan(c("path"))).select("pid", "path")


@query(f"WITH {NODES} SELECT pid, path, CASE WHEN extension IN ('.css', '.svg', '.png') THEN 'asset' WHEN regexp_extract(path, '[^/]*$') IN ('readme.md', 'Cargo.lock') OR path = 'docs' OR starts_with(path, 'docs/') THEN 'allowed' ELSE 'other' END AS verdict FROM node WHERE kind = 'file'")
def s075_allow_list(spark: SparkSession, root: str) -> DataFrame:
    """Untracked files that are allowed by name or folder (075), and assets by extension (076)."""
    allowed = P.basename(c("path")).isin("readme.md", "Cargo.lock") | P.inside(c("path"), "docs")
    return _files(spark, root).select("pid", "path", F.when(c("extension").isin(".css", ".svg", ".png"), "asset").when(allowed, "allowed").otherwise("other").alias("verdict"))


_VISIBLE_SQL = "CASE WHEN regexp_matches(path, '\\.(rs)$') THEN starts_with(trim(signature), 'pub') WHEN ends_with(path, '.go') THEN regexp_matches(name, '^\\p{Lu}') WHEN regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs|cjs)$') THEN starts_with(trim(signature), 'export') WHEN ends_with(path, '.java') THEN regexp_matches(signature, '\\b(public|protected)\\b') ELSE NOT starts_with(name, '_') END"


@query(f"WITH {ENTITIES} SELECT pid, k, coalesce({_VISIBLE_SQL}, false) AS exported FROM ent WHERE kind = 'symbol' AND name IS NOT NULL AND path IS NOT NULL")
def s077_export_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Whether other files can see a symbol, by the rule of its language."""
    p, s = c("path"), c("signature")
    seen = (
        F.when(p.rlike(r"\.rs$"), F.btrim(s).startswith("pub")).when(p.endswith(".go"), c("name").rlike(r"^\p{Lu}")).when(p.rlike(r"\.(ts|tsx|js|jsx|mjs|cjs)$"), F.btrim(s).startswith("export"))
        .when(p.endswith(".java"), s.rlike(r"\b(public|protected)\b")).otherwise(~c("name").startswith("_"))
    )
    return entities(spark, root).where("kind = 'symbol' AND name IS NOT NULL AND path IS NOT NULL").select("pid", "k", F.coalesce(seen, F.lit(False)).alias("exported"))


@query("SELECT DISTINCT source, path, regexp_full_match(source, '[A-Za-z0-9_./^~][A-Za-z0-9_./^~-]{0,255}') AND NOT contains(source, '..') AS source_ok, coalesce(regexp_full_match(path, '[A-Za-z0-9_./^~][A-Za-z0-9_./^~-]{0,255}') AND NOT contains(path, '..'), false) AS path_ok FROM documents WHERE source IS NOT NULL")
def s078_valid_revisions(spark: SparkSession, root: str) -> DataFrame:
    """Which strings could be handed on as a revision."""
    d = table(spark, root, "documents", "source", "path").where("source IS NOT NULL").distinct()
    return d.select("source", "path", X.valid_revision(c("source")).alias("source_ok"), X.valid_revision(c("path")).alias("path_ok"))


# ---------------------------------------------------------------- scalar functions


@query("SELECT DISTINCT record_id, path, NOT (starts_with(p, '/') OR regexp_matches(p, '^[A-Za-z]:') OR regexp_matches(p, '(^|/)\\.\\.(/|$)')) AND p <> '' AS valid, lower(regexp_extract(p, '(?:^|/)[^/]+(\\.[^./]+)$', 1)) AS extension FROM (SELECT record_id, path, replace(path, '\\', '/') p FROM node_scans)")
def s211_node_keys(spark: SparkSession, root: str) -> DataFrame:
    """Whether scan record paths may name a node (211), and their extension (213)."""
    t = table(spark, root, "node_scans", "record_id", "path").distinct()
    p = F.translate("path", "\\", "/")
    return t.select("record_id", "path", P.valid_key(p).alias("valid"), P.extension(p).alias("extension"))


@query("SELECT DISTINCT record_id, lower(replace(trim(path), '\\', '/')) AS query FROM node_scans")
def s215_exact_queries(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "node_scans", "record_id", "path").select("record_id", X.exact_query(c("path")).alias("query")).distinct()


_CALL = r"([A-Za-z_][A-Za-z0-9_.:]*!?)\s*\("
_CALLS_SQL = f"""{TEXTS}, ln AS (SELECT pid, path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT pid, path, {_SQL_LINES} AS l FROM txt)), lines AS (SELECT pid, path, i::INT AS line_no, trim(l[i], ' ' || chr(9)) AS context FROM ln WHERE contains(l[i], '(')),
call AS (SELECT pid, path, line_no, context, regexp_extract(context, '{_CALL}', 1) AS target FROM lines WHERE regexp_matches(context, '{_CALL}')),
arg AS (SELECT *, CASE WHEN regexp_matches(a, '\\\\|\\$\\{{|#\\{{|[\\x00-\\x1f\\x7f]') THEN NULL ELSE a END AS argument FROM (SELECT *, CASE WHEN regexp_matches(context, '^[^(]*\\(\\s*"[^"]*"') THEN regexp_extract(context, '^[^(]*\\(\\s*"([^"]*)"', 1) WHEN regexp_matches(context, '^[^(]*\\(\\s*''[^'']*''') THEN regexp_extract(context, '^[^(]*\\(\\s*''([^'']*)''', 1) END a FROM call))"""


def call_lines(spark: SparkSession, root: str) -> DataFrame:
    """(pid, path, line_no, context, target): lines with a call, and the first one's target."""

    def found(t: DataFrame) -> DataFrame:
        rows = t.where(c("content").contains("(")).select("pid", "path", "_k", F.posexplode(T.lines(c("content"))).alias("_i", "_l")).where(c("_l").contains("("))
        line = rows.select("pid", "path", "_k", (c("_i") + 1).alias("line_no"), F.btrim("_l", F.lit(" \t")).alias("context"))
        return line.where(c("context").rlike(_CALL)).withColumn("target", F.regexp_extract("context", _CALL, 1))

    return from_latest_texts(spark, root, found)


@query(f"WITH {_CALLS_SQL} SELECT pid, path, line_no, target, argument FROM arg WHERE argument IS NOT NULL")
def s217_static_arguments(spark: SparkSession, root: str) -> DataFrame:
    """Calls whose first argument is a plain string."""
    return call_lines(spark, root).select("pid", "path", "line_no", "target", X.static_argument(c("context")).alias("argument")).where("argument IS NOT NULL")


@query(f"WITH {_CALLS_SQL}, h AS (SELECT *, trim(regexp_replace(trim(regexp_extract(context, '^.*,([^,]*)$', 1)), '[);]+$', '')) handler FROM arg) SELECT pid, path, line_no, regexp_replace(handler, '^\\$+|\\$+$', '', 'g') AS handler FROM h WHERE regexp_extract(target, '([^:./!]+)!*$', 1) IN {_in(X.ROUTE_CALLS)} AND starts_with(argument, '/') AND length(context) - length(replace(context, ',', '')) = 1 AND regexp_full_match(handler, '[A-Za-z_:.$][A-Za-z0-9_:.$]*')")
def s218_route_handlers(spark: SparkSession, root: str) -> DataFrame:
    """Handlers that route registrations name."""
    handler = X.route_handler(c("target"), c("context"), F.lit(None).cast("string"))
    return call_lines(spark, root).select("pid", "path", "line_no", handler.alias("handler")).where("handler IS NOT NULL")


@query(f"WITH {_CALLS_SQL} SELECT pid, path, line_no, argument AS env_key FROM arg WHERE (lower(target) IN {_in(X.ENV_CALLS)} OR " + " OR ".join(f"ends_with(lower(target), '{x}')" for x in X.ENV_ENDINGS) + ") AND regexp_full_match(argument, '[A-Z0-9_]{1,128}')")
def s219_environment_keys(spark: SparkSession, root: str) -> DataFrame:
    """Variables read from the environment."""
    return call_lines(spark, root).select("pid", "path", "line_no", X.environment_key(c("target"), c("context")).alias("env_key")).where("env_key IS NOT NULL")


@query(f"WITH {_CALLS_SQL}, k AS (SELECT *, lower(regexp_replace(target, '!+$', '')) low FROM arg) SELECT pid, path, line_no, CASE WHEN regexp_extract(low, '[^:./]+$') IN {_in(X.READ_CALLS)} OR ends_with(low, 'file::open') THEN 'reads' ELSE 'writes' END AS access FROM k WHERE regexp_extract(low, '[^:./]+$') IN {_in(X.READ_CALLS + X.WRITE_CALLS)} OR ends_with(low, 'file::open') OR ends_with(low, 'file::create')")
def s220_data_access(spark: SparkSession, root: str) -> DataFrame:
    """Calls that read or write files."""
    return call_lines(spark, root).select("pid", "path", "line_no", X.data_access(c("target")).alias("access")).where("access IS NOT NULL")


@query("SELECT DISTINCT record_id, path, CASE WHEN v = '' OR regexp_matches(v, '^[/~]|://|[${}]|^[^/]*:') OR contains('/' || v || '/', '/../') THEN NULL ELSE nullif(regexp_replace(regexp_replace('/' || v || '/', '(/\\.)+/', '/', 'g'), '^/+|/+$', '', 'g'), '') END AS target FROM (SELECT record_id, path, replace(path, '\\', '/') v FROM node_scans)")
def s222_static_paths(spark: SparkSession, root: str) -> DataFrame:
    """Literals as repository paths."""
    return table(spark, root, "node_scans", "record_id", "path").distinct().select("record_id", "path", X.static_path(c("path")).alias("target"))


_B = "regexp_extract(lower(path), '[^/]*$')"


@query(f"""WITH {NODES}, b AS (SELECT pid, path, lower(path) low, {_B} base FROM node WHERE kind = 'file'), r AS (SELECT pid, path, CASE WHEN base = '.env' OR starts_with(base, '.env.') THEN 'dotenv' WHEN base IN {_in(X.CONFIG_NAMES)} THEN 'application-config' END AS config,
  CASE WHEN regexp_matches(base, '[^/]\\.tf(\\.json)?$') THEN 'terraform' WHEN base = 'dockerfile' OR starts_with(base, 'dockerfile.') OR base IN {_in(X.COMPOSE_NAMES)} THEN 'containers' WHEN base IN {_in(X.CLUSTER_NAMES)} OR list_has_any(string_split(low, '/'), {str(X.CLUSTER_FOLDERS)}) THEN 'kubernetes'
  WHEN ends_with(base, '.bicep') THEN 'azure-bicep' WHEN base = 'sam-template.yaml' OR (contains(base, 'cloudformation') AND regexp_matches(base, '\\.(yaml|yml|json)$')) THEN 'cloudformation' WHEN base IN ('playbook.yaml', 'playbook.yml') THEN 'ansible' END AS platform FROM b) SELECT * FROM r WHERE config IS NOT NULL OR platform IS NOT NULL""")
def s223_config_and_platform(spark: SparkSession, root: str) -> DataFrame:
    """Files that configure or deploy something."""
    return _files(spark, root).select("pid", "path", X.config_identity(c("path")).alias("config"), X.deploy_platform(c("path")).alias("platform")).where("config IS NOT NULL OR platform IS NOT NULL")


@query("WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^#{1,6}[ \\t]+([^\\n]*)$', 1)) AS title FROM documents) SELECT doc_id, title, replace(regexp_replace(lower(trim(title)), '[^\\p{L}\\p{N} _-]', '', 'g'), ' ', '-') AS slug, count(*) AS n FROM h GROUP BY ALL")
def s225_slugs(spark: SparkSession, root: str) -> DataFrame:
    """Anchors of lines that look like headings."""
    d = table(spark, root, "documents", "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6}[ \t]+([^\n]*)$"), F.lit(1))).alias("title"))
    return d.groupBy("doc_id", "title", T.slug(c("title")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT relation_id, CASE WHEN regexp_matches(t, '::|\\.') THEN regexp_replace(t, '(::|\\.)[^:.]*$', '') END AS scope, CASE WHEN regexp_matches(t, '::|\\.') THEN regexp_extract(t, '[^:.]*$') END AS name FROM (SELECT relation_id, trim(reference_text) t FROM graph_relations WHERE reference_text IS NOT NULL)")
def s230_qualified(spark: SparkSession, root: str) -> DataFrame:
    """Scope and name of references."""
    scope, name = X.qualified_parts(c("reference_text"))
    return table(spark, root, "graph_relations", "relation_id", "reference_text").where("reference_text IS NOT NULL").select("relation_id", scope.alias("scope"), name.alias("name")).distinct()


@query(f"WITH {_HEALTH} SELECT pid, category || ':' || path || ':' || coalesce(related_path, '') AS finding_id, count(*) AS n FROM finding GROUP BY 1, 2")
def s232_finding_ids(spark: SparkSession, root: str) -> DataFrame:
    f = health_findings(purposes(spark, root))
    return f.groupBy("pid", X.finding_id(c("category"), c("path"), c("related_path")).alias("finding_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EV} SELECT bucket || ':command=' || command || ':path=' || CASE WHEN scope = 'event' THEN '*' ELSE 'src' END || ':query=*' AS identity, count(*) AS events FROM ev GROUP BY 1")
def s233_baseline_identity(spark: SparkSession, root: str) -> DataFrame:
    """Identities of baselines; what is not known is a star."""
    path = F.when(c("scope") != "event", "src")
    return calls(spark, root).groupBy(X.baseline_identity(c("bucket"), c("command"), path, F.lit(None).cast("string")).alias("identity")).agg(F.count(F.lit(1)).alias("events"))


@query(f"WITH {_EV}, d AS (SELECT session, sum(without_tokens)::HUGEINT * 1000000000000000 - sum(with_tokens)::HUGEINT d FROM ev GROUP BY 1) SELECT session, least(greatest(d, (-9223372036854775808)::HUGEINT), 9223372036854775807::HUGEINT)::BIGINT AS delta FROM d")
def s235_saturating(spark: SparkSession, root: str) -> DataFrame:
    """A wide difference, cut at the bounds of bigint only at the end."""
    from treeline.operators.usage import saturated

    wide = lambda x: F.sum(c(x).cast("decimal(38,0)"))
    return calls(spark, root).groupBy("session").agg(saturated(wide("without_tokens") * F.lit(10**15).cast("decimal(16,0)") - wide("with_tokens")).alias("delta"))


@query(f"WITH {_EV} SELECT DISTINCT event_id, tick // 86400 * 86400 AS day, strftime(ts, '%Y-W%W') AS week, strftime(ts, '%Y-%m') AS month FROM ev")
def s236_periods(spark: SparkSession, root: str) -> DataFrame:
    """Day floor (236) and period labels (237) of events."""
    from treeline.operators.usage import day_floor, period_label

    return calls(spark, root).select("event_id", day_floor(c("at")).alias("day"), period_label(c("ts"), "week").alias("week"), period_label(c("ts"), "month").alias("month")).distinct()


OVERHEAD = 64  # bytes an event takes besides its strings


@query(f"WITH {_EV} SELECT session, sum({OVERHEAD} + strlen(command) + coalesce(strlen(fingerprint), 0) + strlen(layer) + strlen(bucket) + strlen(confidence))::BIGINT AS bytes FROM ev GROUP BY 1")
def s238_logical_bytes(spark: SparkSession, root: str) -> DataFrame:
    """Bytes of a session's events: the lengths of their strings and a fixed part."""
    size = sum((F.coalesce(F.octet_length(x), F.lit(0)) for x in ("command", "fingerprint", "layer", "bucket", "confidence")), F.lit(OVERHEAD))
    return calls(spark, root).groupBy("session").agg(F.sum(size).cast("bigint").alias("bytes"))


TRUST = {"complete": "trusted", "no_candidates": "trusted", "partial": "partial"}


@query("SELECT state, CASE WHEN state IN ('complete', 'no_candidates') THEN 'trusted' WHEN state = 'partial' THEN 'partial' ELSE 'untrusted' END AS trust, count(DISTINCT coverage_id) AS records FROM graph_coverage GROUP BY 1, 2")
def s240_trust(spark: SparkSession, root: str) -> DataFrame:
    """Trust that coverage states deserve."""
    trust = F.when(c("state").isin("complete", "no_candidates"), "trusted").when(c("state") == "partial", "partial").otherwise("untrusted")
    return table(spark, root, "graph_coverage", "coverage_id", "state").groupBy("state", trust.alias("trust")).agg(F.count_distinct("coverage_id").alias("records"))


@query(f"WITH {NODES} SELECT pid, path, s AS summary, regexp_matches(s, ', [0-9]+ bytes\\.*$') AS fallback FROM (SELECT pid, path, CASE WHEN language IS NULL THEN path || ', ' || coalesce(size_bytes, 0)::VARCHAR || ' bytes.' ELSE language || ' of ' || path END s FROM node WHERE kind = 'file')")
def s242_fallback_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Summaries that only give a size."""
    s = F.when(c("language").isNull(), F.concat("path", F.lit(", "), F.coalesce("size_bytes", F.lit(0)).cast("string"), F.lit(" bytes."))).otherwise(F.concat("language", F.lit(" of "), "path"))
    return _files(spark, root).select("pid", "path", s.alias("summary")).withColumn("fallback", X.fallback_summary(c("summary")))


@query("SELECT DISTINCT source, regexp_full_match(source, '[a-z0-9._-]{1,64}') AND source <> 'main' AS valid FROM documents WHERE source IS NOT NULL")
def s079_aliases(spark: SparkSession, root: str) -> DataFrame:
    """Which names may stand for a work tree: lower case, digits, dots, dashes; not 'main'."""
    d = table(spark, root, "documents", "source").where("source IS NOT NULL").distinct()
    return d.select("source", (c("source").rlike("^[a-z0-9._-]{1,64}$") & (c("source") != "main")).alias("valid"))
