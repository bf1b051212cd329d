"""Queries of the predicates and scalar functions over paths and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T
from treeline.functions.languages import BY_COMPOUND, BY_EXTENSION, BY_NAME, CLASS_OF, content_class, detect_language
from treeline.plans.index_tables import NODES, TEXTS, from_latest_texts, latest_states, nodes
from treeline.plans.registry import query
from treeline.sources.tables import table

c = F.col


@query(f"WITH {NODES} SELECT pid, path FROM node WHERE kind = 'file' AND starts_with(path, 'src') AND regexp_matches(path, '^src/(.*/)?[^/]*\\.py$')")
def s046_glob_files(spark: SparkSession, root: str) -> DataFrame:
    """Files that a glob matches, its fixed prefix pushed to the scan."""
    return nodes(spark, root).where((c("kind") == "file") & P.matches_glob(c("path"), "src/**/*.py")).select("pid", "path")


@query(f"WITH {NODES} SELECT pid, path FROM node WHERE kind = 'file' AND regexp_matches(path, '(^|/)[^/]*_[^/]*\\.(rs|go)$')")
def s048_glob_any_depth(spark: SparkSession, root: str) -> DataFrame:
    """A glob without a slash matches at any depth."""
    return nodes(spark, root).where((c("kind") == "file") & P.matches_glob(c("path"), "*_*.{rs,go}")).select("pid", "path")


@query(f"WITH {NODES} SELECT pid, path, kind FROM node WHERE path = 'src' OR starts_with(path, 'src/')")
def s049_inside_folder(spark: SparkSession, root: str) -> DataFrame:
    return nodes(spark, root).where(P.inside(c("path"), "src")).select("pid", "path", "kind")


@query(f"""WITH {NODES} SELECT pid, path, starts_with(path, 'tests/') OR contains(path, '/tests/') OR contains(path, '_test.') OR contains(path, '.test.') AS ranking_test,
  regexp_matches(path, '(^|/)(test|tests|__tests__)/') OR regexp_matches(path, '[^/]*\\.(test|spec)\\.[^/]*$') OR regexp_matches(path, '_test(\\.[^./]*)?$') OR regexp_matches(path, '(^|/)test_[^/]*$') AS graph_test FROM node WHERE kind = 'file'""")
def s063_test_paths(spark: SparkSession, root: str) -> DataFrame:
    """Both notions of a test path."""
    return nodes(spark, root).where("kind = 'file'").select("pid", "path", P.test_path_for_ranking(c("path")).alias("ranking_test"), P.test_path_in_graph(c("path")).alias("graph_test"))


@query(f"""WITH {NODES} SELECT pid, path, (list_has_any(string_split(path, '/'), ['node_modules', 'vendor', 'target', 'dist']) OR path = 'build' OR starts_with(path, 'build/')) AS excluded FROM node""")
def s006_exclusion(spark: SparkSession, root: str) -> DataFrame:
    """Paths a scan leaves out."""
    return nodes(spark, root).select("pid", "path", P.excluded(c("path"), ["node_modules", "vendor", "target", "dist"], prefixes=["build"]).alias("excluded"))


@query(f"""WITH {NODES} SELECT pid, path, CASE WHEN path = '.' THEN NULL WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS parent,
  lower(regexp_extract(path, '(?:^|/)[^/]+(\\.[^./]+)$', 1)) AS extension, NOT (starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z]:') OR regexp_matches(path, '(^|/)\\.\\.(/|$)')) AND path <> '' AS valid FROM node""")
def s212_path_parts(spark: SparkSession, root: str) -> DataFrame:
    """Parent, extension and validity of node paths."""
    return nodes(spark, root).select("pid", "path", P.parent(c("path")).alias("parent"), P.extension(c("path")).alias("extension"), P.valid_key(c("path")).alias("valid"))


@query(f"""WITH {NODES}, a AS (SELECT pid, path, string_split(path, '/') p FROM node WHERE kind = 'file'),
e AS (SELECT pid, path, array_to_string(p[1:i], '/') AS ancestor, len(p) - i AS distance FROM (SELECT *, unnest(range(1, len(p) + 1)) i FROM a) UNION ALL SELECT pid, path, '.', len(p) FROM a) SELECT * FROM e""")
def s214_ancestors(spark: SparkSession, root: str) -> DataFrame:
    """Each file with itself and all folders above it."""
    up = nodes(spark, root).where("kind = 'file'").select("pid", "path", F.posexplode(P.ancestors(c("path"))).alias("distance", "ancestor"))
    return up.select("pid", "path", "ancestor", "distance")


@query("SELECT DISTINCT record_id, CASE WHEN p = '' THEN '.' ELSE p END AS path FROM (SELECT record_id, regexp_replace(replace(path, '\\', '/'), '^(\\./)+|/+$', '', 'g') p FROM node_scans)")
def s210_normalized(spark: SparkSession, root: str) -> DataFrame:
    """Scan record paths in one spelling."""
    return table(spark, root, "node_scans", "record_id", "path").select("record_id", P.normalize(c("path")).alias("path")).distinct()


@query(f"""WITH {NODES} SELECT pid, sum(CASE WHEN size_bytes IS NULL THEN ceil(length(path) / 4.0) ELSE (size_bytes + 3) // 4 END)::BIGINT AS tokens, count(*) AS files FROM node WHERE kind = 'file' AND exists_now GROUP BY pid""")
def s021_source_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Estimated tokens of a repository's files; the path stands for a file of unknown size."""
    est = F.when(c("size_bytes").isNull(), T.token_estimate(c("path"))).otherwise(T.byte_tokens(c("size_bytes")))
    return nodes(spark, root).where("kind = 'file' AND exists_now").groupBy("pid").agg(F.sum(est).alias("tokens"), F.count(F.lit(1)).alias("files"))


@query(f"""WITH {TEXTS} SELECT pid, path, (length(content) - length(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines,
  ceil(length(content) / 4.0)::BIGINT AS tokens, ((strlen(content) + 3) // 4)::BIGINT AS byte_tokens FROM txt""")
def s207_text_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Lines and token estimates of texts."""
    return from_latest_texts(spark, root, lambda t: t.select("pid", "path", "_k", T.line_count(c("content")).alias("lines"), T.token_estimate(c("content")).alias("tokens"), T.byte_tokens(F.octet_length("content")).alias("byte_tokens")))


_SQL_LINES = "list_transform(CASE WHEN content = '' THEN [] WHEN ends_with(content, chr(10)) THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END, lambda x: regexp_replace(x, '\\r$', ''))"


@query(f"WITH {TEXTS} SELECT pid, path, array_to_string(list_filter(list_transform({_SQL_LINES}, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')[1:5], chr(10)) AS outline FROM txt")
def s208_outline(spark: SparkSession, root: str) -> DataFrame:
    """First five lines with content."""
    return from_latest_texts(spark, root, lambda t: t.select("pid", "path", "_k", F.array_join(T.outline(c("content"), 5), "\n").alias("outline")))


@query(f"WITH {TEXTS} SELECT pid, path, CASE WHEN len(l) >= 10 THEN array_to_string(l[10:14], chr(10)) END AS slice FROM (SELECT pid, path, {_SQL_LINES} l FROM txt)")
def s209_slice(spark: SparkSession, root: str) -> DataFrame:
    """Lines 10 to 14."""
    return from_latest_texts(spark, root, lambda t: t.select("pid", "path", "_k", T.code_slice(c("content"), 10, 14).alias("slice")))


@query("SELECT DISTINCT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(path, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS terms FROM documents")
def s197_terms(spark: SparkSession, root: str) -> DataFrame:
    """Distinct words of document paths."""
    return table(spark, root, "documents", "doc_id", "path").select("doc_id", T.terms(F.coalesce(c("path"), F.lit(""))).alias("terms")).distinct()


@query("SELECT DISTINCT relation_id, CASE WHEN len(p) > 0 THEN regexp_replace(p[-1], '!$', '') END AS leaf FROM (SELECT relation_id, list_filter(regexp_split_to_array(reference_text, '[:./]'), lambda x: x <> '') p FROM graph_relations WHERE reference_text IS NOT NULL)")
def s221_call_leaf(spark: SparkSession, root: str) -> DataFrame:
    """Last name of each reference."""
    return table(spark, root, "graph_relations", "relation_id", "reference_text").where("reference_text IS NOT NULL").select("relation_id", T.call_leaf(c("reference_text")).alias("leaf")).distinct()


@query("""SELECT doc_id, CASE WHEN length(f) <= 240 THEN f ELSE regexp_replace(substr(f, 1, 237), ' [^ ]*$', '') || '...' END AS summary FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) f FROM documents)""")
def s231_compact(spark: SparkSession, root: str) -> DataFrame:
    """Documents cut to a line."""
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", T.compact(c("text")).alias("summary"))


@query(f"""WITH {NODES}, s AS (SELECT pid, path, regexp_replace(path, '\\.[^./]*$', '') stem FROM node WHERE kind = 'file')
SELECT pid, path, replace(regexp_replace(regexp_replace(stem, '^src/', ''), '(^|/)(lib|main|mod|index|__init__)$', ''), '/', '::') AS module FROM s""")
def s226_module_alias(spark: SparkSession, root: str) -> DataFrame:
    """Module names of files."""
    return nodes(spark, root).where("kind = 'file'").select("pid", "path", P.module_alias(c("path"), "::").alias("module"))


@query(f"""WITH {NODES} SELECT pid, unnest(CASE WHEN regexp_matches(stem, '(^|/)(index|mod|__init__|lib|main)$') AND contains(stem, '/') THEN [stem, regexp_replace(stem, '/[^/]*$', '')] ELSE [stem] END) AS stem, path
FROM (SELECT pid, path, regexp_replace(path, '\\.[^./]*$', '') stem FROM node WHERE kind = 'file')""")
def s227_stems(spark: SparkSession, root: str) -> DataFrame:
    return nodes(spark, root).where("kind = 'file'").select("pid", F.explode(P.source_stems(c("path"))).alias("stem"), "path")


@query(f"""WITH {NODES}, x AS (SELECT pid, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END folder FROM node WHERE kind = 'file')
SELECT pid, path, CASE WHEN folder = '.' THEN NULL WHEN contains(folder, '/') THEN regexp_extract(folder, '^(.*)/[^/]*$', 1) || '/shared/util.py' ELSE 'shared/util.py' END AS target FROM x""")
def s228_relative(spark: SparkSession, root: str) -> DataFrame:
    """Where ``../shared/./util.py`` leads from each file; null where it leaves the repository."""
    f = nodes(spark, root).where("kind = 'file'")
    return f.select("pid", "path", P.resolve_relative(P.parent(c("path")), F.lit("../shared/./util.py")).alias("target"))


@query(f"""WITH {NODES} SELECT pid, path, sha256(concat(length('file')::VARCHAR, ':file;', length(path)::VARCHAR, ':', path, ';', CASE WHEN language IS NULL THEN '-;' ELSE length(language)::VARCHAR || ':' || language || ';' END)) AS identity FROM node WHERE kind = 'file'""")
def s246_identity(spark: SparkSession, root: str) -> DataFrame:
    """Digest of each file's canonical identity."""
    return nodes(spark, root).where("kind = 'file'").select("pid", "path", F.sha2(T.framed(F.lit("file"), c("path"), c("language")), 256).alias("identity"))


# ---------------------------------------------------------------- languages and classes

_SQL_EXT = "lower(regexp_extract(path, '(?:^|/)[^/]+(\\.[^./]+)$', 1))"
_SQL_BASE = "regexp_extract(path, '[^/]*$')"
_SQL_LANG = (
    "coalesce(CASE " + _SQL_BASE + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BY_NAME.items()) + " END, CASE regexp_extract(lower(path), '(\\.[^./]+\\.[^./]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BY_COMPOUND.items())
    + " END, CASE " + _SQL_EXT + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BY_EXTENSION.items()) + " END)"
)


@query(f"""WITH {NODES} SELECT pid, path, CASE WHEN ends_with(lower(path), '.gen.rs') THEN 'generated-rust' ELSE {_SQL_LANG} END AS detected, CASE WHEN ends_with(lower(path), '.gen.rs') THEN 'override' WHEN {_SQL_BASE} IN ({', '.join(f"'{k}'" for k in BY_NAME)}) THEN 'filename'
  WHEN regexp_extract(lower(path), '(\\.[^./]+\\.[^./]+)$', 1) IN ({', '.join(f"'{k}'" for k in BY_COMPOUND)}) THEN 'compound' WHEN {_SQL_LANG} IS NOT NULL THEN 'extension' END AS reason FROM node WHERE kind = 'file'""")
def s008_language(spark: SparkSession, root: str) -> DataFrame:
    """Language of each file with the reason."""
    language, reason = detect_language(c("path"), {".gen.rs": "generated-rust"})
    return nodes(spark, root).where("kind = 'file'").select("pid", "path", language.alias("detected"), reason.alias("reason"))


_SQL_CLASS = "coalesce(CASE " + " ".join(f"WHEN language = '{k}' THEN '{v}'" for k, v in CLASS_OF.items()) + " END, CASE WHEN has_text THEN 'other_text' ELSE 'opaque' END)"


@query(f"WITH {NODES}, {TEXTS} SELECT class, count(*) AS files FROM (SELECT {_SQL_CLASS} AS class FROM (SELECT node.language, txt.path IS NOT NULL AS has_text FROM node LEFT JOIN txt USING (pid, path) WHERE kind = 'file')) GROUP BY class")
def s010_content_class(spark: SparkSession, root: str) -> DataFrame:
    """Files by content class."""
    f = nodes(spark, root).where("kind = 'file'").join(latest_states(spark, root).select("pid", "path", F.lit(True).alias("has_text")), ["pid", "path"], "left")
    return f.groupBy(content_class(c("language"), F.coalesce("has_text", F.lit(False))).alias("class")).agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {NODES} SELECT pid, CASE WHEN e = '' THEN '<no_ext>' ELSE e END AS extension, count(*) AS files FROM (SELECT pid, {_SQL_EXT} e FROM node WHERE kind = 'file') GROUP BY 1, 2")
def s143_extension_histogram(spark: SparkSession, root: str) -> DataFrame:
    e = P.extension(c("path"))
    return nodes(spark, root).where("kind = 'file'").groupBy("pid", F.when(e == "", "<no_ext>").otherwise(e).alias("extension")).agg(F.count(F.lit(1)).alias("files"))
