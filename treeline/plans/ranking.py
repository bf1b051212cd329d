"""Queries of relevance: evidence, ranks, and what is appended to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T
from treeline.functions.languages import selected
from treeline.operators import graph as G
from treeline.operators import ranking as R
from treeline.plans.graph_queries import _EDGES, CONFIDENCE, DEPENDENCY, _rank_sql, anchors, links, rank_of
from treeline.plans.index_tables import ENTITIES, NODES, RELATIONS, TEXTS, entities, from_latest_texts, nodes, relations
from treeline.plans.predicates import _in, classed_files
from treeline.plans.registry import query
from treeline.plans.search_and_sets import _PURPOSES, purposes

c = F.col
QUERY = "cache.py journal"
TERMS = R.query_terms(QUERY)
_TERM = lambda col, terms=TERMS: "CASE " + " ".join(f"WHEN contains(lower({col}), '{t}') THEN '{t}'" for t in terms) + " END"

_SYMS = f"s0 AS (SELECT DISTINCT pid, path, name, coalesce(signature, '') AS signature FROM ent WHERE path IS NOT NULL AND symbol_kind IN {_in(R.SYMBOL_KINDS)}), s1 AS (SELECT *, row_number() OVER (PARTITION BY pid, path ORDER BY name, signature) n FROM s0), s2 AS (SELECT *, coalesce({_TERM('name')}, {_TERM('signature')}) AS term FROM s1 WHERE n <= 50), sym1 AS (SELECT pid, path, arg_min(name, n) AS symbol, arg_min(term, n) AS term FROM s2 WHERE term IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {NODES} SELECT pid, path, {_TERM('path')} AS term FROM node WHERE kind = 'file' AND {_TERM('path')} IS NOT NULL")
def s162_first_term(spark: SparkSession, root: str) -> DataFrame:
    """The first query term that each path holds."""
    return nodes(spark, root).where("kind = 'file'").select("pid", "path", T.first_term(c("path"), TERMS).alias("term")).where("term IS NOT NULL")


@query(f"WITH {ENTITIES}, {_SYMS} SELECT pid, path, symbol, term FROM sym1")
def s163_first_symbol(spark: SparkSession, root: str) -> DataFrame:
    """The first symbol of each file that a term is part of."""
    return R.first_symbol(entities(spark, root), TERMS)


_PAIRS = """pc_ AS (SELECT pid, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END folder, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') stem, regexp_extract(path, '(\\.[^./]*)$', 1) ext FROM node WHERE kind = 'file'),
pc1 AS (SELECT *, regexp_replace(regexp_replace(stem, '^test_', ''), '_test$', '') tested FROM pc_), pc2 AS (SELECT pid, path, folder, unnest(CASE WHEN tested <> stem THEN [tested || ext] ELSE ['test_' || stem || ext, stem || '_test' || ext] END) name FROM pc1), pc AS (SELECT pid, path, unnest([CASE WHEN folder = '.' THEN name ELSE folder || '/' || name END, 'tests/' || name]) AS candidate FROM pc2),
paired AS (SELECT DISTINCT pc.pid, pc.path FROM pc JOIN node ON node.pid = pc.pid AND node.path = pc.candidate AND node.kind = 'file')"""


def paired_files(spark: SparkSession, root: str) -> DataFrame:
    """(pid, path, other): files with their tests or source, where both exist."""
    f = nodes(spark, root).where("kind = 'file'").select("pid", "path")
    return f.select("pid", "path", F.explode(R.pair_candidates(c("path"))).alias("other")).distinct().join(f.select("pid", c("path").alias("other")), ["pid", "other"])


_CONN = f"conn AS (SELECT ent.pid, ent.path, rel.kind, t.name AS target_name, t.path AS target_path, rel.ref FROM rel JOIN (SELECT DISTINCT pid, k, path FROM ent) ent ON ent.pid = rel.pid AND ent.k = rel.src LEFT JOIN (SELECT pid, k, min(name) AS name, min(path) AS path FROM ent GROUP BY 1, 2) t ON t.pid = rel.pid AND t.k = rel.dst WHERE ent.path IS NOT NULL AND rel.kind <> 'contains')"


def connections(spark: SparkSession, root: str) -> DataFrame:
    """(pid, path, kind, target_name, target_path, ref): what leads out of each file, containment aside."""
    e = entities(spark, root)
    s = e.where("path IS NOT NULL").select("pid", c("k").alias("src"), "path").distinct()
    t = e.groupBy("pid", c("k").alias("dst")).agg(F.min("name").alias("target_name"), F.min("path").alias("target_path"))
    r = relations(spark, root).where("kind <> 'contains'").select("pid", "src", "dst", "kind", "ref")
    return r.join(s, ["pid", "src"]).join(t, ["pid", "dst"], "left").select("pid", "path", "kind", "target_name", "target_path", "ref")


_HIT = "(" + " OR ".join(f"contains(lower(coalesce({x}, '')), '{t}')" for x in ("target_name", "target_path", "ref") for t in TERMS) + ")"
_SCORED = f"""{_PURPOSES}, {TEXTS}, {ENTITIES}, {RELATIONS}, {_SYMS}, {_PAIRS}, {_CONN}, cc AS (SELECT pid, path, count(DISTINCT kind) families, count(*) FILTER ({_HIT}) matches FROM conn GROUP BY 1, 2),
f AS (SELECT p.pid, p.path, lower(p.path) low, p.purpose, p.status = 'approved' AND p.source = 'agent' AS ar, sym1.symbol, coalesce({' OR '.join(f"contains(lower(txt.content), '{t}')" for t in TERMS)}, false) AS text_hit, paired.path IS NOT NULL AS paired, coalesce(families, 0) families, coalesce(matches, 0) matches
  FROM purpose p LEFT JOIN txt USING (pid, path) LEFT JOIN sym1 USING (pid, path) LEFT JOIN paired USING (pid, path) LEFT JOIN cc USING (pid, path) WHERE p.kind = 'file'),
g AS (SELECT *, low = '{QUERY}' AS exact_path, regexp_extract(low, '[^/]*$') = '{QUERY}' AS exact_name, {_TERM('path')} IS NOT NULL AND low <> '{QUERY}' AS in_path, ar AND {_TERM('purpose')} IS NOT NULL AS reviewed FROM f),
scored AS (SELECT pid, path, exact_path, exact_name, reviewed, ((CASE WHEN in_path THEN 40 ELSE 0 END) + (CASE WHEN symbol IS NOT NULL THEN 35 ELSE 0 END) + (CASE WHEN text_hit THEN 15 ELSE 0 END) + (CASE WHEN paired THEN 10 ELSE 0 END) + least(families * 2 + matches * 18, 32))::INT AS score,
  list_filter([CASE WHEN exact_path THEN 'exact_path' END, CASE WHEN exact_name THEN 'exact_name' END, CASE WHEN in_path THEN 'path' END, CASE WHEN reviewed THEN 'reviewed_purpose' END, CASE WHEN symbol IS NOT NULL THEN 'symbol' END, CASE WHEN text_hit THEN 'indexed_text' END, CASE WHEN paired THEN 'paired_file' END, CASE WHEN families > 0 THEN 'graph' END], lambda x: x IS NOT NULL)[1:6] AS codes FROM g)"""


def scored_files(spark: SparkSession, root: str) -> DataFrame:
    p = purposes(spark, root).where("kind = 'file'").select("pid", "path", "purpose", ((c("status") == "approved") & (c("source") == "agent")).alias("agent_reviewed"))
    hit = lambda col: T.first_term(F.coalesce(col, F.lit("")), TERMS).isNotNull()
    low = F.lower("content")
    text = from_latest_texts(spark, root, lambda t: t.where(F.greatest(*(low.contains(x) for x in TERMS))).select("pid", "path", "_k")).withColumn("text_hit", F.lit(True))
    conn = connections(spark, root)
    near = conn.groupBy("pid", "path").agg(F.count_distinct("kind").alias("families"), F.count_if(hit(c("target_name")) | hit(c("target_path")) | hit(c("ref"))).alias("matches"))
    pair = paired_files(spark, root).select("pid", "path").distinct().withColumn("paired", F.lit(True))
    whole = p.withColumn("summary", F.lit(None).cast("string")).join(R.first_symbol(entities(spark, root), TERMS), ["pid", "path"], "left").join(text, ["pid", "path"], "left").join(pair, ["pid", "path"], "left").join(near, ["pid", "path"], "left")
    return R.score_files(whole, QUERY)


@query(f"WITH {_SCORED} SELECT * FROM scored")
def s161_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Evidence of every file for a query: tiers, score and reasons."""
    return scored_files(spark, root)


_ORDER = "row_number() OVER (PARTITION BY pid ORDER BY exact_path DESC, exact_name DESC, reviewed DESC, score DESC, path)::INT AS rank"


@query(f"WITH {_SCORED} SELECT *, {_ORDER} FROM scored QUALIFY rank <= 10")
def s160_ranked(spark: SparkSession, root: str) -> DataFrame:
    """The ten most relevant files of each repository."""
    return R.ranked(scored_files(spark, root), 10)


@query(f"WITH {_SCORED} SELECT pid, path, score, {_ORDER} FROM scored WHERE regexp_matches(path, '(^|/)[^/]*\\.rs$') QUALIFY rank <= 5")
def s166_ranked_by_glob(spark: SparkSession, root: str) -> DataFrame:
    """The five most relevant files that a glob matches."""
    return R.ranked(scored_files(spark, root).where(P.matches_glob(c("path"), "*.rs")), 5).select("pid", "path", "score", "rank")


@query(f"WITH {_SCORED}, cls AS (SELECT pid, path, language FROM node) SELECT scored.pid, scored.path, score, {_ORDER.replace('PARTITION BY pid', 'PARTITION BY scored.pid').replace('score DESC, path', 'score DESC, scored.path')} FROM scored JOIN cls USING (pid, path) WHERE cls.language = 'markdown' QUALIFY rank <= 5")
def s167_ranked_by_selection(spark: SparkSession, root: str) -> DataFrame:
    """The five most relevant files of documentation."""
    docs = classed_files(spark, root).where(selected(c("class"), "documentation")).select("pid", "path")
    return R.ranked(scored_files(spark, root).join(docs, ["pid", "path"], "left_semi"), 5).select("pid", "path", "score", "rank")


_CHOSEN = "ch AS (SELECT pid, path FROM (SELECT pid, path, row_number() OVER (PARTITION BY pid ORDER BY path) n FROM node WHERE kind = 'file' AND contains(path, 'journal')) WHERE n <= 2)"


def chosen_files(spark: SparkSession, root: str) -> DataFrame:
    f = nodes(spark, root).where((c("kind") == "file") & c("path").contains("journal")).select("pid", "path")
    return f.withColumn("n", F.row_number().over(W.partitionBy("pid").orderBy("path"))).where("n <= 2").drop("n")


def _append_sql(more: str) -> str:
    return f"""have AS (SELECT pid, count(*) h FROM ch GROUP BY 1), new AS (SELECT pid, path, row_number() OVER (PARTITION BY pid ORDER BY path) n FROM (SELECT DISTINCT pid, path FROM {more} m WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.pid = m.pid AND ch.path = m.path)))
SELECT pid, path, 'chosen' AS source FROM ch UNION ALL SELECT pid, path, 'appended' FROM new LEFT JOIN have USING (pid) WHERE n + coalesce(h, 0) <= 5"""


@query(f"WITH {NODES}, {TEXTS}, {_CHOSEN}, hits AS (SELECT pid, path FROM txt WHERE contains(lower(content), 'journal')), " + _append_sql("hits"))
def s168_content_hits(spark: SparkSession, root: str) -> DataFrame:
    """Files chosen by path, filled up to five of a repository with files whose text has the term."""
    hits = from_latest_texts(spark, root, lambda t: t.where(F.lower("content").contains("journal")).select("pid", "path", "_k"))
    return R.appended(chosen_files(spark, root), hits, 5)


@query(f"WITH {NODES}, {_CHOSEN}, {_PAIRS}, others AS (SELECT pc.pid, pc.candidate AS path FROM pc JOIN ch ON ch.pid = pc.pid AND ch.path = pc.path JOIN node ON node.pid = pc.pid AND node.path = pc.candidate AND node.kind = 'file'), " + _append_sql("others"))
def s169_paired_files(spark: SparkSession, root: str) -> DataFrame:
    """Files chosen by path, filled up with their tests or sources."""
    first = chosen_files(spark, root)
    others = paired_files(spark, root).join(first, ["pid", "path"], "left_semi").select("pid", c("other").alias("path"))
    return R.appended(first, others, 5)


@query(f"WITH {ENTITIES}, {RELATIONS}, {_CONN}, k AS (SELECT DISTINCT pid, path, kind, coalesce(target_path, ref, '') AS target FROM conn), r AS (SELECT *, row_number() OVER (PARTITION BY pid, path ORDER BY kind, target) n FROM k), t AS (SELECT pid, path, count(*) total FROM k GROUP BY 1, 2) SELECT r.pid, r.path, kind, target, total, total > 3 AS truncated FROM r JOIN t USING (pid, path) WHERE n <= 3")
def s170_connections(spark: SparkSession, root: str) -> DataFrame:
    """The first three connections of each file, with how many there are."""
    k = connections(spark, root).select("pid", "path", "kind", F.coalesce("target_path", "ref", F.lit("")).alias("target")).distinct()
    top = k.withColumn("n", F.row_number().over(W.partitionBy("pid", "path").orderBy("kind", "target"))).where("n <= 3").drop("n")
    return top.join(k.groupBy("pid", "path").agg(F.count(F.lit(1)).alias("total")), ["pid", "path"]).withColumn("truncated", c("total") > 3)


@query(f"WITH {_SCORED}, top AS (SELECT pid, 'file' AS kind, path, score, {_ORDER} FROM scored QUALIFY rank <= 3), fs AS (SELECT pid, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS path, sum(score)::BIGINT AS score FROM scored GROUP BY 1, 2) SELECT pid, kind, path, score::BIGINT AS score, rank FROM top UNION ALL SELECT pid, 'folder', path, score, row_number() OVER (PARTITION BY pid ORDER BY score DESC, path)::INT AS rank FROM fs QUALIFY rank <= 3")
def s171_next_steps(spark: SparkSession, root: str) -> DataFrame:
    """The three files and the three folders of each repository to look at next."""
    s = scored_files(spark, root)
    files = R.ranked(s, 3).select("pid", F.lit("file").alias("kind"), "path", c("score").cast("bigint").alias("score"), "rank")
    sums = s.groupBy("pid", P.parent(c("path")).alias("path")).agg(F.sum("score").alias("score"))
    folders = sums.withColumn("rank", F.row_number().over(W.partitionBy("pid").orderBy(F.desc("score"), "path"))).where("rank <= 3")
    return files.unionByName(folders.select("pid", F.lit("folder").alias("kind"), "path", "score", "rank"))


_WALK = f"{_EDGES}, anchor AS (SELECT pid, min(src) AS node FROM dep GROUP BY pid), walk AS (SELECT pid, node, 0 AS hops FROM anchor UNION SELECT w.pid, dep.dst, w.hops + 1 FROM walk w JOIN dep ON dep.pid = w.pid AND dep.src = w.node WHERE w.hops < 3), seen AS (SELECT pid, node, min(hops) hops FROM walk GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_WALK}, o AS (SELECT seen.pid, seen.hops + 1 AS depth, rel.rk, row_number() OVER (PARTITION BY seen.pid ORDER BY seen.hops, {_rank_sql('confidence', CONFIDENCE)} DESC, rel.rk, coalesce(rel.dst, ''), rel.kind, rel.resolution) n FROM seen JOIN rel ON rel.pid = seen.pid AND rel.src = seen.node WHERE seen.hops < 3) SELECT pid, depth, rk, n::INT AS position FROM o WHERE n <= 25")
def s174_page_order(spark: SparkSession, root: str) -> DataFrame:
    """The first 25 relations a walk from each anchor meets: step by step, within a step by trust."""
    e = links(spark, root, DEPENDENCY)
    seen = G.bounded_bfs(e, anchors(e), 2).select("pid", c("node").alias("src"), "hops")
    r = relations(spark, root).join(seen, ["pid", "src"])
    w = W.partitionBy("pid").orderBy("hops", F.desc(rank_of(c("confidence"), CONFIDENCE)), "rk", F.coalesce("dst", F.lit("")), "kind", "resolution")
    return r.withColumn("position", F.row_number().over(w)).where("position <= 25").select("pid", (c("hops") + 1).alias("depth"), "rk", "position")


@query(f"WITH RECURSIVE {_WALK}, parent AS (SELECT s.pid, s.node, min(p.node) AS parent FROM seen s JOIN dep ON dep.pid = s.pid AND dep.dst = s.node JOIN seen p ON p.pid = dep.pid AND p.node = dep.src AND p.hops = s.hops - 1 GROUP BY 1, 2), way AS (SELECT pid, node AS target, hops AS step, node FROM seen WHERE hops = 3 UNION ALL SELECT way.pid, target, step - 1, parent FROM way JOIN parent USING (pid, node) WHERE step > 0) SELECT pid, target, step, node FROM way")
def s258_ways(spark: SparkSession, root: str) -> DataFrame:
    """A shortest way from each anchor to every node three steps away."""
    e = links(spark, root, DEPENDENCY)
    seen = G.bounded_bfs(e, anchors(e), 3)
    return G.paths_back(e, seen, seen.where("hops = 3").select("pid", c("node").alias("target")))
