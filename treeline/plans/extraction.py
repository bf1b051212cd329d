"""Queries of the extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.operators import extract as X
from treeline.operators.usage import IDLE
from treeline.plans.index_tables import TEXTS, from_latest_texts
from treeline.plans.paths_and_text import _SQL_LINES
from treeline.plans.registry import query
from treeline.sources.files import ignore_rules, ignored
from treeline.sources.tables import table
from treeline.streaming.usage import EVENT_SCHEMA  # noqa: F401

c = F.col
_LINE = f"{TEXTS}, ln AS (SELECT pid, path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT pid, path, {_SQL_LINES} AS l FROM txt)), line AS (SELECT pid, path, i::INT AS line_no, trim(l[i], ' ' || chr(9)) AS t FROM ln)"


def _sql_rx(rx: str) -> str:
    return rx.replace("'", "''")


@query(
    f"WITH {_LINE}, k AS (SELECT *, CASE " + " ".join(f"WHEN regexp_matches(t, '{_sql_rx(r)}') THEN {i}" for i, (_, r) in enumerate(X.DECLARATIONS)) + " END AS k FROM line) SELECT pid, path, line_no, CASE k "
    + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(X.DECLARATIONS)) + " END AS kind, CASE k " + " ".join(f"WHEN {i} THEN regexp_extract(t, '{_sql_rx(r)}', 1)" for i, (_, r) in enumerate(X.DECLARATIONS)) + " END AS name FROM k WHERE k IS NOT NULL"
)
def s281_declarations(spark: SparkSession, root: str) -> DataFrame:
    return from_latest_texts(spark, root, lambda t: X.declarations(t, ["pid", "path", "_k"]))


@query(f"WITH {_LINE} SELECT pid, path, line_no, t AS text FROM line WHERE regexp_matches(t, '{_sql_rx(X.IMPORT)}')")
def s283_imports(spark: SparkSession, root: str) -> DataFrame:
    return from_latest_texts(spark, root, lambda t: X.imports(t, ["pid", "path", "_k"]))


@query("""WITH d AS (SELECT doc_id, regexp_replace(text, '(?ms)^ {0,3}```.*?^ {0,3}```[^\\n]*', '', 'g') t FROM documents), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) x FROM d), h AS (SELECT doc_id, length(regexp_extract(x, '^ {0,3}(#{1,6})[ \\t]', 1)) AS level, regexp_extract(x, '^ {0,3}#{1,6}[ \\t]+(.*?)[ \\t]*#*[ \\t]*$', 1) AS title FROM l WHERE regexp_matches(x, '^ {0,3}#{1,6}[ \\t]+.*$'))
SELECT doc_id, level, title, replace(regexp_replace(lower(trim(title)), '[^\\p{L}\\p{N} _-]', '', 'g'), ' ', '-') AS slug, count(*) AS n FROM h GROUP BY ALL""")
def s290_headings(spark: SparkSession, root: str) -> DataFrame:
    """Headings of documents outside fenced code, with their anchors."""
    d = table(spark, root, "documents", "doc_id", "text").select("doc_id", c("text").alias("content"))
    return X.headings(d, ["doc_id"]).groupBy("doc_id", "level", "title", "slug").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT doc_id, path, unnest(regexp_extract_all(text, '`(src/[^`\\s]+)`', 1)) AS target FROM documents), r AS (SELECT DISTINCT doc_id, path, target FROM l) SELECT doc_id, target, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || target AS file FROM r""")
def s224_link_targets(spark: SparkSession, root: str) -> DataFrame:
    """File names that documents mention, seen from the document's folder."""
    d = table(spark, root, "documents", "doc_id", "path", "text")
    found = d.select("doc_id", "path", F.explode(F.regexp_extract_all("text", F.lit(r"`(src/[^`\s]+)`"), F.lit(1))).alias("target")).distinct()
    return X.link_targets(found).select("doc_id", "target", "file")


@query("""WITH RECURSIVE p AS (SELECT DISTINCT path FROM nodes WHERE path IS NOT NULL), up AS (SELECT path, path AS part FROM p UNION ALL SELECT path, regexp_extract(part, '^(.*)/[^/]*$', 1) FROM up WHERE contains(part, '/')),
v AS (SELECT path, CASE WHEN part = 'src/build' THEN false WHEN regexp_matches(part, '^public/(.*/)?[^/]*\\.min\\.[^/]*$') THEN false WHEN regexp_matches(part, '(^|/)[^/]*\\.min\\.[^/]*$') THEN true WHEN part <> path AND regexp_matches(part, '(^|/)generated$') THEN true ELSE regexp_matches(part, '(^|/)build$') END AS out FROM up)
SELECT path, bool_or(out) AS ignored FROM v GROUP BY 1""")
def s007_gitignore(spark: SparkSession, root: str) -> DataFrame:
    """Paths that an ignore file leaves out: build and generated folders and minified files, those below public/ and src/build excepted."""
    rules = ignore_rules(["# built", "build", "generated/", "*.min.*", "!public/**/*.min.*", "!src/build"])
    return table(spark, root, "nodes", "path").where("path IS NOT NULL").distinct().select("path", ignored(c("path"), rules).alias("ignored"))


@query("""WITH g AS (SELECT user_id AS owner, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 24 HOUR THEN 1 ELSE 0 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT owner, ts, sum(b) OVER (PARTITION BY owner ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g)
SELECT owner, min(ts) AS started, max(ts) AS last_seen, count(*) AS events FROM r GROUP BY owner, k""")
def s322_session_windows(spark: SparkSession, root: str) -> DataFrame:
    """The streaming form of instances, over a bounded table: session windows of a day."""
    e = table(spark, root, "events", "user_id", "ts").select(c("user_id").alias("owner"), "ts")
    g = e.groupBy("owner", F.session_window("ts", f"{IDLE} seconds").alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("events"))
    return g.select("owner", "started", "last_seen", "events")


@query("SELECT DISTINCT path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS folder, count(*) OVER (PARTITION BY CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END) AS siblings FROM (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL)")
def s004_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folders implied by document paths, and how many documents each holds."""
    d = table(spark, root, "documents", "path").where("path IS NOT NULL").distinct().select("path", P.parent(c("path")).alias("folder"))
    n = d.groupBy("folder").agg(F.count(F.lit(1)).alias("siblings"))
    return d.join(n, "folder").select("path", "folder", "siblings")


@query(
    f"WITH {_LINE}, k AS (SELECT *, CASE " + " ".join(f"WHEN regexp_matches(t, '{_sql_rx(r)}') THEN {i}" for i, (_, _, r) in enumerate(X.FALLBACK)) + " END AS k FROM line) SELECT pid, path, line_no, CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _, _) in enumerate(X.FALLBACK))
    + " END AS kind, CASE k " + " ".join(f"WHEN {i} THEN '{d}'" for i, (_, d, _) in enumerate(X.FALLBACK)) + " END AS detail, CASE k " + " ".join(f"WHEN {i} THEN regexp_extract(t, '{_sql_rx(r)}', 1)" for i, (_, _, r) in enumerate(X.FALLBACK)) + " END AS name FROM k WHERE k IS NOT NULL"
)
def s282_fallback_symbols(spark: SparkSession, root: str) -> DataFrame:
    """Declarations of lines by the fallback patterns."""
    return from_latest_texts(spark, root, lambda t: X.fallback_symbols(t, ["pid", "path", "_k"]))
