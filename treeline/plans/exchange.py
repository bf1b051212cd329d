"""Queries of digests, suggestions, statuses and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T
from treeline.functions.text import framed
from treeline.operators.changes import set_digest
from treeline.operators.search import search_lines
from treeline.plans.index_tables import NODES, TEXTS, from_latest_texts, nodes
from treeline.plans.registry import query
from treeline.plans.search_and_sets import _EXPLODED, _LANES_SQL, lines_of
from treeline.plans.usage_queries import _EV, calls
from treeline.sources.tables import table

c = F.col
_FRAME = lambda *cols: " || ".join(f"CASE WHEN {x} IS NULL THEN '-;' ELSE length({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR || ';' END" for x in cols)


@query(f"WITH i AS (SELECT snapshot_id, sha256({_FRAME('path', 'kind', 'content_hash')}) h FROM (SELECT DISTINCT snapshot_id, path, kind, content_hash FROM node_snapshots)), g AS (SELECT snapshot_id, count(*) n, {_LANES_SQL} FROM i GROUP BY 1) SELECT snapshot_id, n AS items, sha256(concat_ws('.', n, s0, s1, s2, s3, s4)) AS digest FROM g")
def s043_snapshot_digest(spark: SparkSession, root: str) -> DataFrame:
    """Digest of each snapshot's rows, the same in whatever order they are listed."""
    t = table(spark, root, "node_snapshots", "snapshot_id", "path", "kind", "content_hash").distinct()
    item = framed(c("path"), c("kind"), c("content_hash"))
    return t.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("items"), set_digest(item).alias("digest"))


@query(f"WITH {_EXPLODED} SELECT pid, path, trim(regexp_extract(line, '(?i)\\bpurpose:\\s*(.*)$', 1)) AS purpose, min(line_no) AS line_no FROM line WHERE line_no <= 5 AND regexp_matches(line, '(?i)\\bpurpose:\\s*\\S') GROUP BY 1, 2, 3")
def s012_header_purposes(spark: SparkSession, root: str) -> DataFrame:
    """Purposes that files state in their first five lines."""
    rows = lines_of(spark, root, r"\bpurpose:\s*\S", regex=True, case_sensitive=False).where("line_no <= 5")
    return rows.groupBy("pid", "path", F.btrim(F.regexp_extract("line", r"(?i)\bpurpose:\s*(.*)$", 1)).alias("purpose")).agg(F.min("line_no").alias("line_no"))


TRIGRAM = "ledger"


def trigrams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def trigram_index(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, gram): the different runs of three characters of a lower-case text; texts shorter than that have none."""
    low = F.lower(c(text))
    grams = F.when(F.char_length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, 3))))
    return rows.select(*keys, F.explode(grams).alias("gram"))


def trigram_candidates(index: DataFrame, keys: list[str], needle: str) -> DataFrame:
    """Keys whose text holds every run of three characters of the needle: all that can contain it, and some more.

    The filter is on the index's gram, so that one ordered or parted by it is read only where the needle's grams are.
    """
    grams = trigrams(needle.lower())
    return index.where(c("gram").isin(grams)).groupBy(*keys).agg(F.count_distinct("gram").alias("n")).where(c("n") == len(grams)).select(*keys)


@query(f"WITH {NODES} SELECT pid, path, contains(lower(path), '{TRIGRAM}') AS confirmed FROM node WHERE " + " AND ".join(f"contains(lower(path), '{g}')" for g in trigrams(TRIGRAM)))
def s249_trigram_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Paths that an index of three-character runs offers for a word, and those that hold it."""
    n = nodes(spark, root).select("pid", "path")
    found = trigram_candidates(trigram_index(n, ["pid", "path"], "path"), ["pid", "path"], TRIGRAM)
    return found.withColumn("confirmed", F.lower("path").contains(TRIGRAM))


@query(f"WITH {NODES}, {TEXTS} SELECT node.pid, node.path, CASE WHEN txt.path IS NULL THEN 'no_text' WHEN strlen(content) > 2000 THEN 'too_large' WHEN node.language IS NULL THEN 'not_selected' ELSE 'read' END AS decision FROM node LEFT JOIN txt USING (pid, path) WHERE kind = 'file' AND exists_now")
def s250_visit(spark: SparkSession, root: str) -> DataFrame:
    """What a visit of texts does with each file by its metadata, before any text is read."""
    size = from_latest_texts(spark, root, lambda t: t.select("pid", "path", "_k", F.octet_length("content").alias("bytes")))
    n = nodes(spark, root).where("kind = 'file' AND exists_now").join(size, ["pid", "path"], "left")
    return n.select("pid", "path", F.when(c("bytes").isNull(), "no_text").when(c("bytes") > 2000, "too_large").when(c("language").isNull(), "not_selected").otherwise("read").alias("decision"))


@query(f"WITH {NODES}, cfg AS (SELECT DISTINCT pid, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END dir FROM node WHERE kind = 'file' AND extension = '.json'), f AS (SELECT pid, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END dir FROM node WHERE kind = 'file' AND extension IN ('.ts', '.js')) SELECT f.pid, f.path, arg_max(cfg.dir, CASE WHEN cfg.dir = '.' THEN 0 ELSE length(cfg.dir) END) AS scope FROM f JOIN cfg ON cfg.pid = f.pid AND (cfg.dir = '.' OR f.dir = cfg.dir OR starts_with(f.dir, cfg.dir || '/')) GROUP BY 1, 2")
def s293_module_scopes(spark: SparkSession, root: str) -> DataFrame:
    """The deepest folder with a configuration file that holds each script: an equi-join over the folders above it."""
    n = nodes(spark, root).where("kind = 'file'")
    cfg = n.where("extension = '.json'").select("pid", P.parent(c("path")).alias("dir")).distinct()
    up = n.where("extension IN ('.ts', '.js')").select("pid", "path", F.posexplode(P.ancestors(P.parent(c("path")))).alias("d", "dir"))
    return up.join(cfg, ["pid", "dir"]).groupBy("pid", "path").agg(F.min_by("dir", "d").alias("scope"))


_STEM = "regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')"


@query(f"WITH {NODES} SELECT pid, path, upper(substr(coalesce(language, 'other'), 1, 1)) || substr(coalesce(language, 'other'), 2) || ' file for ' || replace({_STEM}, '_', ' ') || ' in ' || CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS suggestion FROM node WHERE kind = 'file'")
def s244_suggestions(spark: SparkSession, root: str) -> DataFrame:
    """A sentence about each file from its language, name and folder."""
    language = F.coalesce("language", F.lit("other"))
    stem = F.regexp_replace(P.basename(c("path")), r"\.[^.]*$", "")
    text = F.concat(F.upper(F.substring(language, 1, 1)), F.expr("substr(coalesce(language, 'other'), 2)"), F.lit(" file for "), F.replace(stem, F.lit("_"), F.lit(" ")), F.lit(" in "), P.parent(c("path")))
    return nodes(spark, root).where("kind = 'file'").select("pid", "path", text.alias("suggestion"))


@query(f"WITH {_EV} SELECT DISTINCT event_id, CASE WHEN length(t) > 24 THEN 'sha256:' || sha256(t) ELSE t END AS token FROM (SELECT event_id, command || '/' || layer || '/' || fingerprint t FROM ev)")
def s247_long_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Strings over a length stand as their hash."""
    t = F.concat_ws("/", "command", "layer", "fingerprint")
    return calls(spark, root).select("event_id", F.when(F.char_length(t) > 24, F.concat(F.lit("sha256:"), F.sha2(t, 256))).otherwise(t).alias("token")).distinct()


# Purposes of files that mean the same everywhere.
SEEDS = {"readme.md": "What the project is and how to begin", "cargo.toml": "Package manifest", "package.json": "Package manifest", "go.mod": "Module manifest", "mod.rs": "Module entry", "index.js": "Module entry", "lib.rs": "Library entry", "main.go": "Program entry"}


@query(f"WITH {NODES} SELECT pid, path, CASE lower(regexp_extract(path, '[^/]*$')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEEDS.items()) + f" END AS purpose FROM node WHERE kind = 'file' AND lower(regexp_extract(path, '[^/]*$')) IN ({', '.join(repr(k) for k in SEEDS)})")
def s302_seeds(spark: SparkSession, root: str) -> DataFrame:
    """Built-in purposes of files with names of fixed meaning."""
    from treeline.functions.languages import lookup

    n = nodes(spark, root).where("kind = 'file'").select("pid", "path", lookup(F.lower(P.basename(c("path"))), SEEDS).alias("purpose"))
    return n.where("purpose IS NOT NULL")


@query(f"WITH {_EV}, a AS (SELECT session, command, sum(without_tokens)::BIGINT w, count(*) n FROM ev WHERE event_id < 4000 GROUP BY 1, 2), b AS (SELECT session, command, sum(without_tokens)::BIGINT w, count(*) n FROM ev WHERE event_id >= 4000 GROUP BY 1, 2) SELECT session, command, sum(w)::BIGINT AS without_tokens, sum(n)::BIGINT AS calls FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2")
def s326_backfill(spark: SparkSession, root: str) -> DataFrame:
    """Old rows added to the aggregates of new ones by the same accounting: the sum is that of all rows."""
    e = calls(spark, root)
    agg = lambda df: df.groupBy("session", "command").agg(F.sum("without_tokens").alias("without_tokens"), F.count(F.lit(1)).alias("calls"))
    both = agg(e.where("event_id < 4000")).unionByName(agg(e.where("event_id >= 4000")))
    return both.groupBy("session", "command").agg(F.sum("without_tokens").alias("without_tokens"), F.sum("calls").alias("calls"))
