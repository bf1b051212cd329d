"""Queries of search, ranking, set operations, deltas, health rules and overview counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T
from treeline.operators.changes import delta, replace_scan, set_digest, upsert
from treeline.operators.search import bounded, page, search_lines
from treeline.plans.index_tables import NODES, TEXTS, from_latest_texts, latest_states, nodes
from treeline.plans.paths_and_text import _SQL_LINES
from treeline.plans.registry import query
from treeline.sources.tables import hex_key, table

c = F.col
_EXPLODED = f"{TEXTS}, ln AS (SELECT pid, path, l, unnest(range(1, len(l) + 1)) AS line_no FROM (SELECT pid, path, {_SQL_LINES} AS l FROM txt)), line AS (SELECT pid, path, l, line_no::INT AS line_no, l[line_no] AS line FROM ln)"


def lines_of(spark: SparkSession, root: str, pattern: str, **mode) -> DataFrame:
    """Matching lines of the last texts."""
    return from_latest_texts(spark, root, lambda t: search_lines(t, ["pid", "path", "_k"], pattern, **mode))


@query(f"WITH {_EXPLODED} SELECT pid, path, line_no, line FROM line WHERE contains(line, 'return ')")
def s248_search_literal(spark: SparkSession, root: str) -> DataFrame:
    return lines_of(spark, root, "return ")


@query(f"WITH {_EXPLODED} SELECT pid, path, line_no, line, l[greatest(line_no - 2, 1):line_no - 1] AS before, l[line_no + 1:line_no + 2] AS after FROM line WHERE contains(lower(line), 'working tree')")
def s178_search_context(spark: SparkSession, root: str) -> DataFrame:
    """Case-insensitive literal with two lines before and after."""
    return lines_of(spark, root, "Working Tree", context=2, case_sensitive=False)


@query(f"WITH {_EXPLODED} SELECT pid, path, line_no, line FROM line WHERE regexp_matches(line, '\\b(def|fn|func) [a-z_]+_?cache\\b')")
def s052_search_regex(spark: SparkSession, root: str) -> DataFrame:
    return lines_of(spark, root, r"\b(def|fn|func) [a-z_]+_?cache\b", regex=True)


@query(f"WITH {_EXPLODED} SELECT pid, path, line_no, line FROM line WHERE regexp_matches(line, 'p.*b.*l.*s.*h.*q.*u.*e.*u.*e')")
def s053_search_fuzzy(spark: SparkSession, root: str) -> DataFrame:
    return lines_of(spark, root, "pblshqueue", fuzzy=True)


@query(f"WITH {_EXPLODED} SELECT pid, path, line_no, line, (row_number() OVER (ORDER BY pid, path, line_no) - 1)::INT AS position FROM line WHERE contains(line, 'import') QUALIFY position BETWEEN 20 AND 69")
def s177_search_page(spark: SparkSession, root: str) -> DataFrame:
    """The second page of a search, 50 lines from the 20th."""
    return page(lines_of(spark, root, "import"), ["pid", "path", "line_no"], 50, 20)


@query(f"WITH {_EXPLODED} SELECT pid, path, line_no, line, (row_number() OVER (ORDER BY pid, path, line_no) - 1)::INT AS position FROM line WHERE contains(line, 'import') AND (pid, path, line_no) > ('5', 'src/', 3) QUALIFY position < 50")
def s176_search_after(spark: SparkSession, root: str) -> DataFrame:
    """A page that goes on from the last row of another."""
    return page(lines_of(spark, root, "import"), ["pid", "path", "line_no"], 50, after=("5", "src/", 3))


@query(f"""WITH {TEXTS}, w AS (SELECT pid, path, row_number() OVER (PARTITION BY pid ORDER BY path) n, sum(strlen(content)) OVER (PARTITION BY pid ORDER BY path) b FROM txt)
SELECT pid, path, CASE WHEN n > 20 THEN 'files' WHEN b > 30000 THEN 'bytes' END AS reason, n <= 20 AND b <= 30000 AS admitted FROM w""")
def s251_search_bounds(spark: SparkSession, root: str) -> DataFrame:
    """Which texts of a repository a bounded search reads."""
    t = from_latest_texts(spark, root, lambda x: x.select("pid", "path", "_k", F.octet_length("content").alias("bytes")))
    return bounded(t, c("bytes"), ["path"], 20, 30_000, ["pid"]).select("pid", "path", "reason", "admitted")


# ---------------------------------------------------------------- sets and deltas


@query("""WITH o AS (SELECT snapshot_id % 2 AS side, path, max((kind, coalesce(extension, ''), coalesce(language, ''), coalesce(size_bytes, -1), coalesce(lower(content_hash), ''))) s FROM node_snapshots GROUP BY 1, 2)
SELECT coalesce(p.path, q.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN q.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM (SELECT * FROM o WHERE side = 0) p FULL JOIN (SELECT * FROM o WHERE side = 1) q ON p.path = q.path WHERE p.path IS NULL OR q.path IS NULL OR p.s IS DISTINCT FROM q.s""")
def s195_delta(spark: SparkSession, root: str) -> DataFrame:
    """Added, removed and modified paths between two listings: even and odd snapshots, greatest state of each path."""
    t = table(spark, root, "node_snapshots", "snapshot_id", "path", "kind", "extension", "language", "size_bytes", "content_hash")
    one = t.groupBy((c("snapshot_id") % 2).alias("side"), "path").agg(F.max(F.struct("kind", *(F.coalesce(x, F.lit("")).alias(x) for x in ("extension", "language")), F.coalesce("size_bytes", F.lit(-1)).alias("size"), F.coalesce(hex_key("content_hash"), F.lit("")).alias("h"))).alias("s"))
    half = lambda k: one.where(c("side") == k).select("path", "s").where("path IS NOT NULL")
    return delta(half(0), half(1), ["path"], ["s"])


@query(f"""WITH {NODES} SELECT pid, path, language FROM node WHERE kind = 'file' AND NOT (extension = '.py') UNION ALL SELECT pid, path, 'py' FROM node WHERE kind = 'file' AND extension = '.py'
UNION ALL SELECT pid, path, language FROM node WHERE kind = 'file' AND extension IS NULL""")
def s027_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Classifications of files, those of Python files replaced."""
    f = nodes(spark, root).where("kind = 'file'")
    return upsert(f.select("pid", "path", "language"), f.where("extension = '.py'").select("pid", "path", F.lit("py").alias("language")), ["pid", "path"])


@query(f"""WITH {NODES}, o AS (SELECT pid, path, language, 'p:' || path AS purpose FROM node WHERE kind = 'file'), s AS (SELECT DISTINCT pid, path, coalesce(language, 'none') language FROM o WHERE length(path) % 3 <> 0)
SELECT o.pid, o.path, coalesce(s.language, o.language) AS language, purpose, s.path IS NOT NULL AS exists_now FROM o LEFT JOIN s ON o.pid = s.pid AND o.path = s.path""")
def s030_replace_scan(spark: SparkSession, root: str) -> DataFrame:
    """A scan that misses a third of the paths: they stay, marked gone, and purposes survive."""
    old = nodes(spark, root).where("kind = 'file'").select("pid", "path", "language", F.concat(F.lit("p:"), "path").alias("purpose"))
    scan = old.where(F.char_length("path") % 3 != 0).select("pid", "path", F.coalesce("language", F.lit("none")).alias("language"))
    return replace_scan(old, scan, ["pid", "path"], ["purpose"])


@query(f"WITH {NODES}, {TEXTS} SELECT pid, path FROM txt WHERE NOT EXISTS (SELECT 1 FROM node WHERE node.pid = txt.pid AND node.path = txt.path AND kind = 'file' AND exists_now)")
def s028_texts_of_absent(spark: SparkSession, root: str) -> DataFrame:
    """Texts whose node is gone: what a publication deletes."""
    return latest_states(spark, root).select("pid", "path").join(nodes(spark, root).where("kind = 'file' AND exists_now"), ["pid", "path"], "left_anti")


@query(f"WITH {NODES}, {TEXTS} SELECT pid, path FROM node WHERE kind = 'file' AND exists_now AND NOT EXISTS (SELECT 1 FROM txt WHERE node.pid = txt.pid AND node.path = txt.path)")
def s085_files_without_text(spark: SparkSession, root: str) -> DataFrame:
    """Anti-join for completeness: live files with no stored text."""
    return nodes(spark, root).where("kind = 'file' AND exists_now").select("pid", "path").join(latest_states(spark, root), ["pid", "path"], "left_anti")


@query(f"WITH {NODES}, {TEXTS} SELECT node.pid, count(*) FILTER (node.content_hash IS DISTINCT FROM txt.content_hash) AS stale, count(*) AS indexed FROM node JOIN txt USING (pid, path) WHERE kind = 'file' GROUP BY 1")
def s319_freshness(spark: SparkSession, root: str) -> DataFrame:
    """Per repository, texts that no longer match their node."""
    t = latest_states(spark, root).select("pid", "path", c("content_hash").alias("h"))
    return nodes(spark, root).where("kind = 'file'").join(t, ["pid", "path"]).groupBy("pid").agg(F.count_if(~c("content_hash").eqNullSafe(c("h"))).alias("stale"), F.count(F.lit(1)).alias("indexed"))


_LANES_SQL = ", ".join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT)::HUGEINT AS s{i}" for i in range(5))


@query(f"WITH {NODES}, i AS (SELECT pid, sha256(length(path)::VARCHAR || ':' || path || ';' || CASE WHEN content_hash IS NULL THEN '-;' ELSE length(content_hash)::VARCHAR || ':' || content_hash || ';' END) h FROM node WHERE exists_now), g AS (SELECT pid, count(*) n, {_LANES_SQL} FROM i GROUP BY pid) SELECT pid, sha256(concat_ws('.', n, s0, s1, s2, s3, s4)) AS digest FROM g")
def s044_state_digest(spark: SparkSession, root: str) -> DataFrame:
    """Digest of a repository's live nodes, the same in whatever order they come."""
    live = nodes(spark, root).where("exists_now").select("pid", T.framed(c("path"), c("content_hash")).alias("item"))
    return live.groupBy("pid").agg(set_digest(c("item")).alias("digest"))


# ---------------------------------------------------------------- overview, health, duplicates

# Purposes stand in file tables as the class a document was given; here they derive from nodes, the same way in both forms.
_PURPOSES = f"""{NODES}, purpose AS (SELECT pid, path, kind, CASE WHEN language IS NULL THEN 'missing' WHEN size_bytes IS NULL THEN 'suggested' WHEN NOT exists_now THEN 'stale' ELSE 'approved' END AS status,
  CASE WHEN language IS NULL THEN 'missing' WHEN coalesce(size_bytes, 0) % 2 = 0 THEN 'agent' ELSE 'imported' END AS source, coalesce(language, '') || ' of ' || regexp_extract(path, '^[^/]*') AS purpose FROM node)"""


def purposes(spark: SparkSession, root: str) -> DataFrame:
    n = nodes(spark, root)
    status = F.when(c("language").isNull(), "missing").when(c("size_bytes").isNull(), "suggested").when(~c("exists_now"), "stale").otherwise("approved")
    source = F.when(c("language").isNull(), "missing").when(F.coalesce("size_bytes", F.lit(0)) % 2 == 0, "agent").otherwise("imported")
    text = F.concat(F.coalesce("language", F.lit("")), F.lit(" of "), F.regexp_extract("path", "^[^/]*", 0))
    return n.select("pid", "path", "kind", status.alias("status"), source.alias("source"), text.alias("purpose"))


@query(f"WITH {_PURPOSES} SELECT pid, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'folder') AS folders, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("missing", "stale", "approved", "suggested")) + " FROM purpose GROUP BY pid")
def s115_overview(spark: SparkSession, root: str) -> DataFrame:
    n = lambda cond, name: F.count_if(cond).alias(name)
    return purposes(spark, root).groupBy("pid").agg(n(c("kind") == "file", "files"), n(c("kind") == "folder", "folders"), *(n(c("status") == s, s) for s in ("missing", "stale", "approved", "suggested")))


# Names, prefixes and segments of files whose purpose must be reviewed, and names of folders for passing results.
HIGH_IMPACT = (
    "cargo.toml package.json pyproject.toml build.gradle build.gradle.kts settings.gradle settings.gradle.kts gradle.properties dockerfile makefile justfile main.rs lib.rs mod.rs main.py app.py server.py index.ts main.ts "
    "server.ts app.ts index.tsx app.tsx"
).split()
HIGH_IMPACT_PREFIXES = [".github/workflows/"]
HIGH_IMPACT_SEGMENTS = ["/migrations/", "/routes/", "/commands/", "/mcp"]
TEMPORARY = ["tmp", "temp", "cache", "generated", "out", "output"]


def high_impact(path: Column) -> Column:
    """Whether a file path is named, begins or holds a segment as those that everything else leans on."""
    low = F.lower(F.translate(path, "\\", "/"))
    hit = P.basename(low).isin(HIGH_IMPACT)
    for x in HIGH_IMPACT_PREFIXES:
        hit = hit | low.startswith(x)
    for x in HIGH_IMPACT_SEGMENTS:
        hit = hit | low.contains(x)
    return hit


def plain_findings(p: DataFrame) -> DataFrame:
    """Findings that one row tells: missing, suggested, stale and unreviewed purposes. One pass over the rows."""
    reviewed = c("source").isin("agent", "human")
    review = (c("status") == "approved") & ~reviewed & ((c("kind") == "folder") | high_impact(c("path")))
    category = F.when(c("status") == "missing", "missing_purpose").when(c("status") == "suggested", "suggested_review").when(c("status") == "stale", "stale_purpose").when(review, "agent_review_required")
    return p.select("pid", category.alias("category"), "path", F.lit(None).cast("string").alias("related_path")).where("category IS NOT NULL")


def duplicate_findings(p: DataFrame) -> DataFrame:
    """Approved nodes but the first (by path) with the same kind and purpose and, for folders, the same parent."""
    key = ["pid", "kind", F.lower("purpose").alias("_p"), F.when(c("kind") == "folder", P.parent(c("path"))).otherwise("").alias("_in")]
    a = p.where("status = 'approved' AND purpose IS NOT NULL").select(*key, "path")
    first = a.groupBy("pid", "kind", "_p", "_in").agg(F.min("path").alias("related_path"))
    return a.join(first, ["pid", "kind", "_p", "_in"]).where("path <> related_path").select("pid", F.lit("duplicate_purpose").alias("category"), "path", "related_path")


def temporary_findings(p: DataFrame) -> DataFrame:
    """Folders for passing results, where a repository has two or more of one name."""
    base = F.lower(P.basename(c("path")))
    t = p.where((c("kind") == "folder") & base.isin(TEMPORARY)).select("pid", base.alias("base"), "path")
    many = t.groupBy("pid", "base").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return t.join(many, ["pid", "base"]).select("pid", F.lit("temporary_folder").alias("category"), "path", F.lit(None).cast("string").alias("related_path"))


def health_findings(p: DataFrame) -> DataFrame:
    """(pid, category, path, related_path) of all rules. p: pid, path, kind, status, source, purpose, one row per node."""
    return plain_findings(p).unionByName(duplicate_findings(p)).unionByName(temporary_findings(p))


_SQL_HIGH = f"(base IN ({', '.join(f"'{x}'" for x in HIGH_IMPACT)})" + "".join(f" OR starts_with(lower(path), '{x}')" for x in HIGH_IMPACT_PREFIXES) + "".join(f" OR contains(lower(path), '{x}')" for x in HIGH_IMPACT_SEGMENTS) + ")"
_HEALTH = f"""{_PURPOSES}, b AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) base, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END parent FROM purpose),
finding AS (SELECT pid, 'missing_purpose' AS category, path, NULL AS related_path FROM b WHERE status = 'missing' UNION ALL SELECT pid, 'suggested_review', path, NULL FROM b WHERE status = 'suggested'
UNION ALL SELECT pid, 'stale_purpose', path, NULL FROM b WHERE status = 'stale' UNION ALL SELECT pid, 'agent_review_required', path, NULL FROM b WHERE status = 'approved' AND source <> 'agent' AND (kind = 'folder' OR {_SQL_HIGH})
UNION ALL SELECT pid, 'duplicate_purpose', path, f FROM (SELECT *, first(path) OVER (PARTITION BY pid, kind, lower(purpose), CASE WHEN kind = 'folder' THEN parent ELSE '' END ORDER BY path) f FROM b WHERE status = 'approved') WHERE f <> path
UNION ALL SELECT pid, 'temporary_folder', path, NULL FROM (SELECT *, count(*) OVER (PARTITION BY pid, base) k FROM b WHERE kind = 'folder' AND base IN ({', '.join(f"'{x}'" for x in TEMPORARY)})) WHERE k >= 2)"""


@query(f"WITH {_HEALTH} SELECT * FROM finding")
def s303_health(spark: SparkSession, root: str) -> DataFrame:
    return health_findings(purposes(spark, root))


def _rule(name: str, category: str, find) -> None:
    @query(f"WITH {_HEALTH} SELECT pid, path, related_path FROM finding WHERE category = '{category}'", name=name)
    def rule(spark: SparkSession, root: str) -> DataFrame:
        return find(purposes(spark, root)).where(c("category") == category).select("pid", "path", "related_path")


for _name, _category, _find in (
    ("s304_missing_purpose", "missing_purpose", plain_findings), ("s305_suggested_review", "suggested_review", plain_findings), ("s306_stale_purpose", "stale_purpose", plain_findings),
    ("s307_agent_review", "agent_review_required", plain_findings), ("s308_duplicate_purpose", "duplicate_purpose", duplicate_findings), ("s309_temporary_folder", "temporary_folder", temporary_findings),
):
    _rule(_name, _category, _find)


@query(f"WITH {NODES} SELECT pid, path FROM (SELECT pid, path, lower(regexp_extract(path, '[^/]*$')) base FROM node WHERE kind = 'file') WHERE {_SQL_HIGH}")
def s062_high_impact(spark: SparkSession, root: str) -> DataFrame:
    """Files whose purpose must be reviewed."""
    return nodes(spark, root).where("kind = 'file'").where(high_impact(c("path"))).select("pid", "path")


@query(f"WITH {_HEALTH} SELECT pid, category, path, related_path, category || ':' || path || ':' || coalesce(related_path, '') AS finding_id FROM finding WHERE length(path) % 2 = 1")
def s201_unresolved(spark: SparkSession, root: str) -> DataFrame:
    """Findings without those that were resolved (here: of paths of even length), with their ids."""
    f = health_findings(purposes(spark, root)).withColumn("finding_id", F.concat_ws(":", "category", "path", F.coalesce("related_path", F.lit(""))))
    resolved = f.where(F.char_length("path") % 2 == 0).select("pid", "finding_id")
    return f.join(resolved, ["pid", "finding_id"], "left_anti").select("pid", "category", "path", "related_path", "finding_id")


@query(f"WITH {_HEALTH}, o AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY category, path, coalesce(related_path, '')) - 1 i, count(*) OVER (PARTITION BY pid) total FROM finding) SELECT pid, category, path, related_path, i::INT AS position, total FROM o WHERE i BETWEEN 5 AND 14")
def s192_health_page(spark: SparkSession, root: str) -> DataFrame:
    """Findings 5 to 14 of each repository with their number.

    A rank under a bound is cut to its first rows before the exchange; the numbers are counted apart.
    """
    f = health_findings(purposes(spark, root))
    w = W.partitionBy("pid").orderBy("category", "path", F.coalesce("related_path", F.lit("")))
    top = f.withColumn("n", F.row_number().over(w)).where("n <= 15").withColumn("position", c("n") - 1).where("position >= 5").drop("n")
    return top.join(f.groupBy("pid").agg(F.count(F.lit(1)).alias("total")), "pid").select("pid", "category", "path", "related_path", "position", "total")


@query(f"WITH {TEXTS}, k AS (SELECT content_hash, count(*) AS copies, min(path) AS first_path FROM txt WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) >= 2) SELECT content_hash, copies, first_path, pid, path FROM txt JOIN k USING (content_hash)")
def s141_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Texts held under several paths: one row per place, with the number of copies and the least path of its class."""
    t = latest_states(spark, root).where("content_hash IS NOT NULL").select("content_hash", "pid", "path")
    k = t.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).where("copies >= 2")
    return t.join(k, "content_hash").select("content_hash", "copies", "first_path", "pid", "path")


@query(f"""WITH {_PURPOSES}, f AS (SELECT pid, path, string_split(path, '/') p FROM node WHERE kind = 'file'), up AS (SELECT pid, path, array_to_string(p[1:i], '/') a, len(p) - i d FROM (SELECT *, unnest(range(1, len(p) + 1)) i FROM f) UNION ALL SELECT pid, path, '.', len(p) FROM f)
SELECT up.pid, up.path, arg_min(purpose.path, d) AS purpose_path, arg_min(purpose.purpose, d) AS purpose FROM up JOIN purpose ON up.pid = purpose.pid AND up.a = purpose.path WHERE status = 'approved' GROUP BY 1, 2""")
def s092_nearest_purpose(spark: SparkSession, root: str) -> DataFrame:
    """The approved purpose of a file or of the nearest folder above it."""
    f = nodes(spark, root).where("kind = 'file'").select("pid", "path", F.posexplode(P.ancestors(c("path"))).alias("d", "a"))
    p = purposes(spark, root).where("status = 'approved'").select("pid", c("path").alias("a"), "purpose")
    return f.join(p, ["pid", "a"]).groupBy("pid", "path").agg(F.min_by("a", "d").alias("purpose_path"), F.min_by("purpose", "d").alias("purpose"))


@query(f"""WITH {NODES}, s AS (SELECT pid, path, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') stem FROM node WHERE kind = 'file'), t AS (SELECT *, regexp_replace(regexp_replace(stem, '^(test_|min_|ranked_)', ''), '_(test|spec|helpers)$', '') base FROM s)
SELECT a.pid, a.path AS test_path, b.path AS source_path FROM t a JOIN t b ON a.pid = b.pid AND a.base = b.stem AND a.stem <> a.base""")
def s110_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Derived files (prefixed or suffixed stems) with the files their stems stand for."""
    stem = F.regexp_replace(P.basename(c("path")), r"\.[^.]*$", "")
    s = nodes(spark, root).where("kind = 'file'").select("pid", "path", stem.alias("stem"))
    t = s.withColumn("base", F.regexp_replace(F.regexp_replace("stem", "^(test_|min_|ranked_)", ""), "_(test|spec|helpers)$", ""))
    return t.where("stem <> base").select("pid", c("path").alias("test_path"), c("base").alias("stem")).join(s.select("pid", "stem", c("path").alias("source_path")), ["pid", "stem"]).select("pid", "test_path", "source_path")


# ---------------------------------------------------------------- ranking


def rank_files(files: DataFrame, exact: str, words: list[str], limit: int) -> DataFrame:
    """Files (pid, path, language, purpose, reviewed, text_hit) by tiers: exact path, exact name, reviewed purpose, context score, path.

    The score adds 40 for a word in the path (unless the path is exact), 20 in the purpose, 15 for a hit in the
    text; reasons say which.
    """
    path, low = c("path"), T.ascii_lower(c("path"))
    word = lambda col: F.lit(False) if not words else F.greatest(*(col.contains(w) for w in words), F.lit(False))
    exact_path, exact_name = low == exact, T.ascii_lower(P.basename(path)) == exact
    in_path, in_purpose = word(low) & ~exact_path, word(T.ascii_lower(F.coalesce("purpose", F.lit(""))))
    score = F.when(in_path, 40).otherwise(0) + F.when(in_purpose, 20).otherwise(0) + F.when(c("text_hit"), 15).otherwise(0)
    reasons = F.array_compact(F.array(F.when(exact_path, "path"), F.when(exact_name, "name"), F.when(in_path, "path word"), F.when(in_purpose, "purpose"), F.when(c("text_hit"), "text")))
    scored = files.select("pid", "path", exact_path.cast("int").alias("e"), exact_name.cast("int").alias("m"), (c("reviewed") & in_purpose).cast("int").alias("r"), score.alias("score"), reasons.alias("reasons")).where("e + m + r + score > 0")
    order = W.partitionBy("pid").orderBy(F.desc("e"), F.desc("m"), F.desc("r"), F.desc("score"), "path")
    return scored.withColumn("rank", F.row_number().over(order)).where(c("rank") <= limit).select("pid", "path", "score", F.array_join("reasons", ", ").alias("reasons"), "rank")


@query(f"""WITH {_PURPOSES}, {TEXTS}, f AS (SELECT purpose.pid, purpose.path, lower(purpose.path) low, lower(purpose) pu, status = 'approved' AND source = 'agent' reviewed, coalesce(contains(content, 'cache'), false) hit FROM purpose LEFT JOIN txt USING (pid, path) WHERE kind = 'file'),
g AS (SELECT *, low = 'cache.py' e, regexp_extract(low, '[^/]*$') = 'cache.py' m, contains(low, 'cache') OR contains(low, 'python') ip, contains(pu, 'cache') OR contains(pu, 'python') iu FROM f),
s AS (SELECT pid, path, e::INT e, m::INT m, (reviewed AND iu)::INT r, (CASE WHEN ip AND NOT e THEN 40 ELSE 0 END + CASE WHEN iu THEN 20 ELSE 0 END + CASE WHEN hit THEN 15 ELSE 0 END) score,
  concat_ws(', ', CASE WHEN e THEN 'path' END, CASE WHEN m THEN 'name' END, CASE WHEN ip AND NOT e THEN 'path word' END, CASE WHEN iu THEN 'purpose' END, CASE WHEN hit THEN 'text' END) reasons FROM g)
SELECT pid, path, score, reasons, (row_number() OVER (PARTITION BY pid ORDER BY e DESC, m DESC, r DESC, score DESC, path))::INT AS rank FROM s WHERE e + m + r + score > 0 QUALIFY rank <= 10""")
def s159_rank(spark: SparkSession, root: str) -> DataFrame:
    """The ten files of each repository most relevant to 'cache.py', with reasons."""
    hit = from_latest_texts(spark, root, lambda t: t.where(c("content").contains("cache")).select("pid", "path", "_k")).withColumn("text_hit", F.lit(True))
    files = purposes(spark, root).where("kind = 'file'").join(hit, ["pid", "path"], "left").withColumn("text_hit", F.coalesce("text_hit", F.lit(False)))
    files = files.withColumn("reviewed", (c("status") == "approved") & (c("source") == "agent"))
    return rank_files(files, "cache.py", ["cache", "python"], 10)


@query(f"WITH {NODES}, o AS (SELECT pid, path FROM node WHERE path > 'lib' ORDER BY path, pid LIMIT 101) SELECT * FROM (SELECT *, count(*) OVER () > 100 AS truncated FROM o) ORDER BY path, pid LIMIT 100")
def s175_keyset_page(spark: SparkSession, root: str) -> DataFrame:
    """The hundred paths after 'lib', and whether more follow."""
    after = nodes(spark, root).where("path > 'lib'").select("pid", "path").orderBy("path", "pid").limit(101)
    return after.withColumn("truncated", F.count(F.lit(1)).over(W.partitionBy()) > 100).orderBy("path", "pid").limit(100)


@query("SELECT project_instance_id AS pid, scope_path, state_rank AS worst, covered, total FROM (SELECT lower(project_instance_id) project_instance_id, scope_path, max(CASE WHEN state IN ('complete', 'no_candidates') THEN 0 WHEN state = 'partial' THEN 1 ELSE 2 END) state_rank, sum(covered)::BIGINT covered, sum(total)::BIGINT total FROM (SELECT DISTINCT * FROM graph_coverage) GROUP BY 1, 2)")
def s136_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Per file: worst trust (0 trusted, 1 partial, 2 untrusted) and covered of total."""
    t = table(spark, root, "graph_coverage", "coverage_id", "project_instance_id", "scope_kind", "scope_path", "relation_scope", "relation_kind", "state", "total", "covered", "omitted", "reason", "reached_limit").distinct()
    trust = F.when(c("state").isin("complete", "no_candidates"), 0).when(c("state") == "partial", 1).otherwise(2)
    return t.groupBy(hex_key("project_instance_id").alias("pid"), "scope_path").agg(F.max(trust).alias("worst"), F.sum("covered").alias("covered"), F.sum("total").alias("total"))


@query("SELECT DISTINCT coverage_id, total = covered + omitted AND CASE state WHEN 'complete' THEN omitted = 0 WHEN 'partial' THEN covered > 0 AND omitted > 0 ELSE covered = 0 AND omitted > 0 END AS consistent FROM graph_coverage")
def s279_coverage_invariants(spark: SparkSession, root: str) -> DataFrame:
    """Whether a coverage record's counts fit its state."""
    fits = F.when(c("state") == "complete", c("omitted") == 0).when(c("state") == "partial", (c("covered") > 0) & (c("omitted") > 0)).otherwise((c("covered") == 0) & (c("omitted") > 0))
    return table(spark, root, "graph_coverage", "coverage_id", "state", "total", "covered", "omitted").select("coverage_id", ((c("total") == c("covered") + c("omitted")) & fits).alias("consistent")).distinct()
