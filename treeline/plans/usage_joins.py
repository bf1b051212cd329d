"""Queries that join usage with its dimensions and instances, and keep its aggregates, retention and revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators import usage as U
from treeline.plans.index_tables import ENTITIES, RELATIONS, TEXTS, entities, latest_states, relations
from treeline.plans.registry import query
from treeline.plans.search_and_sets import _HEALTH, health_findings, purposes
from treeline.plans.usage_queries import _ARMS, _EV, calls, saving
from treeline.sources.tables import table

c = F.col
ONE = "md5(command || ':' || layer)"
_DIM = f"{_EV}, dim AS (SELECT DISTINCT {ONE} AS dimension_id, command, layer FROM ev), fact AS (SELECT {ONE} AS dimension_id, event_id, session, tick, tick // 86400 * 86400 AS day, without_tokens, with_tokens, event_id % 4 AS k FROM ev)"
# Every fourth event came by a routed worktree, every fourth by a synchronized one; a session stands for a registration.
_KIND = "CASE k WHEN 0 THEN 'routed' WHEN 1 THEN 'synchronized' ELSE 'native' END"


def star(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Facts (dimension_id, session, at, day, estimates, source_kind) and their dimension (dimension_id, command, layer)."""
    e = calls(spark, root).withColumn("dimension_id", F.md5(F.concat_ws(":", "command", "layer")))
    kind = F.when(c("event_id") % 4 == 0, "routed").when(c("event_id") % 4 == 1, "synchronized").otherwise("native")
    facts = e.select("dimension_id", "event_id", "session", "at", U.day_floor(c("at")).alias("day"), "without_tokens", "with_tokens", kind.alias("source_kind"))
    return facts, e.select("dimension_id", "command", "layer").distinct()


def by_dimension(facts: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """Facts summed by keys and dimension before they meet the dimension's names."""
    g = facts.groupBy(*keys, "dimension_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("without_tokens").alias("without_tokens"), F.sum("with_tokens").alias("with_tokens"))
    return g.join(dim, "dimension_id").drop("dimension_id")


_SUMS = "count(*) AS calls, sum(without_tokens)::BIGINT AS without_tokens, sum(with_tokens)::BIGINT AS with_tokens"


@query(f"WITH {_DIM} SELECT strftime(make_timestamp(day * 1000000), '%Y-%m') AS period, command, layer, {_SUMS} FROM fact JOIN dim USING (dimension_id) GROUP BY 1, 2, 3")
def s082_daily_by_period(spark: SparkSession, root: str) -> DataFrame:
    """Daily sums brought to months, then joined with their dimension."""
    facts, dim = star(spark, root)
    return by_dimension(facts.withColumn("period", F.date_format(F.timestamp_seconds("day"), "yyyy-MM")), dim, ["period"])


@query(f"WITH {_DIM} SELECT session AS registration, -1::BIGINT AS day, command, layer, {_SUMS} FROM fact JOIN dim USING (dimension_id) WHERE {_KIND} IN ('routed', 'synchronized') GROUP BY ALL")
def s083_worktree_lifetime(spark: SparkSession, root: str) -> DataFrame:
    """Lifetime rows (day -1) of worktrees whose usage came routed or synchronized."""
    facts, dim = star(spark, root)
    g = by_dimension(facts.where("source_kind IN ('routed', 'synchronized')"), dim, ["session"])
    return g.withColumnRenamed("session", "registration").withColumn("day", F.lit(-1).cast("bigint"))


@query(f"""WITH {_DIM}, g AS (SELECT *, CASE WHEN tick - lag(tick) OVER w >= 86400 OR lag(tick) OVER w IS NULL THEN 1 ELSE 0 END b FROM fact WINDOW w AS (PARTITION BY session ORDER BY tick, event_id)), r AS (SELECT *, sum(b) OVER (PARTITION BY session ORDER BY tick, event_id) run FROM g)
SELECT event_id, session AS owner, min(tick) OVER (PARTITION BY session, run) AS started, command, layer, without_tokens FROM r JOIN dim USING (dimension_id)""")
def s084_raw_events(spark: SparkSession, root: str) -> DataFrame:
    """Raw events with their instance and the names of their dimension."""
    facts, dim = star(spark, root)
    e = U.with_instance(facts.withColumnRenamed("session", "owner"))
    return e.join(dim, "dimension_id").select("event_id", "owner", "started", "command", "layer", "without_tokens")


@query(f"WITH {_EV}, s AS (SELECT session, max(tick) last FROM ev GROUP BY 1), l AS (SELECT fingerprint, session FROM ev GROUP BY 1, 2) SELECT DISTINCT fingerprint FROM l a WHERE NOT EXISTS (SELECT 1 FROM l JOIN s USING (session) WHERE l.fingerprint = a.fingerprint AND s.last >= (SELECT max(tick) FROM ev) - 7200)")
def s087_dead_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels without a session seen in the last two hours: what an eviction takes."""
    e = calls(spark, root).select("session", "fingerprint", "at").where("fingerprint IS NOT NULL")
    last = e.groupBy("session").agg(F.max("at").alias("last"))
    now = e.agg(F.max("at")).first()[0] or 0
    live = e.select("session", "fingerprint").distinct().join(last.where(c("last") >= now - 7200), "session", "left_semi")
    return e.select("fingerprint").distinct().join(live, "fingerprint", "left_anti")


@query(f"WITH {_EV} SELECT session, command AS identity, fingerprint, max(without_tokens) AS max_without, sum(with_tokens)::BIGINT AS spent, count(*) AS calls, max(without_tokens) - sum(with_tokens)::BIGINT AS adjustment FROM ev WHERE scope = 'session' GROUP BY ALL")
def s121_baseline_state(spark: SparkSession, root: str) -> DataFrame:
    """State kept per baseline of a session: its greatest estimate, what was spent, and what that adds to the aggregate."""
    e = calls(spark, root).where("scope = 'session'").groupBy("session", "identity", "fingerprint")
    g = e.agg(F.max("without_tokens").alias("max_without"), F.sum("with_tokens").alias("spent"), F.count(F.lit(1)).alias("calls"))
    return g.withColumn("adjustment", c("max_without") - c("spent"))


@query(f"WITH {_DIM}, r AS (SELECT *, session AS registration FROM fact WHERE {_KIND} = 'routed') SELECT registration, day, {_SUMS} FROM r GROUP BY 1, 2 UNION ALL SELECT registration, -1, {_SUMS} FROM r GROUP BY 1")
def s123_routed_worktrees(spark: SparkSession, root: str) -> DataFrame:
    """Daily and lifetime rows of routed worktrees; the lifetime is summed from the days."""
    f = star(spark, root)[0].where("source_kind = 'routed'").withColumnRenamed("session", "registration")
    d = f.groupBy("registration", "day").agg(F.count(F.lit(1)).alias("calls"), F.sum("without_tokens").alias("without_tokens"), F.sum("with_tokens").alias("with_tokens"))
    total = d.groupBy("registration").agg(*(F.sum(x).alias(x) for x in ("calls", "without_tokens", "with_tokens"))).withColumn("day", F.lit(-1).cast("bigint"))
    return d.unionByName(total)


@query(f"""WITH {_EV}, k AS (SELECT command, session, fingerprint, CASE WHEN scope = 'event' THEN event_id END alone, max(without_tokens) w, sum(with_tokens) s, count(*) n FROM ev GROUP BY ALL), d AS (SELECT command, sum(w - s)::BIGINT deduped, sum(n - 1)::BIGINT repeats FROM k GROUP BY 1),
b AS (SELECT command, {_SUMS} FROM ev GROUP BY 1) SELECT command, calls, without_tokens, with_tokens, without_tokens - with_tokens AS gross, deduped, CASE WHEN command = 'view' THEN without_tokens // 2 ELSE without_tokens END AS averaged, repeats FROM b JOIN d USING (command)""")
def s124_report_rows(spark: SparkSession, root: str) -> DataFrame:
    """Report by command: gross, without double counting, with folder walks at half, and repeats."""
    e = calls(spark, root)
    b = e.groupBy("command").agg(F.count(F.lit(1)).alias("calls"), F.sum("without_tokens").alias("without_tokens"), F.sum("with_tokens").alias("with_tokens"))
    d = U.session_accounting(e, ["command"]).select("command", c("saved").alias("deduped"), "repeats")
    half = F.when(c("command") == "view", F.floor(c("without_tokens") / 2).cast("bigint")).otherwise(c("without_tokens"))
    return b.join(d, "command").select("command", "calls", "without_tokens", "with_tokens", (c("without_tokens") - c("with_tokens")).alias("gross"), "deduped", half.alias("averaged"), "repeats")


@query(f"WITH {_DIM}, p AS (SELECT dimension_id, {_KIND} AS source_kind, {_SUMS} FROM fact GROUP BY 1, 2) SELECT command, sum(calls)::BIGINT AS calls, sum(without_tokens)::BIGINT AS without_tokens, sum(with_tokens)::BIGINT AS with_tokens, count(DISTINCT source_kind) AS sources FROM p JOIN dim USING (dimension_id) GROUP BY 1")
def s127_repository_overview(spark: SparkSession, root: str) -> DataFrame:
    """Native usage and that of worktrees brought together and merged by command."""
    facts, dim = star(spark, root)
    parts = by_dimension(facts.where("source_kind = 'native'"), dim, ["source_kind"]).unionByName(by_dimension(facts.where("source_kind <> 'native'"), dim, ["source_kind"]))
    return parts.groupBy("command").agg(*(F.sum(x).alias(x) for x in ("calls", "without_tokens", "with_tokens")), F.count_distinct("source_kind").alias("sources"))


@query("SELECT l_returnflag AS flag, l_linestatus AS arm, median(l_quantity) AS quantity, median(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2")
def s149_medians(spark: SparkSession, root: str) -> DataFrame:
    """Exact medians of two measures per group."""
    t = table(spark, root, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice").select(c("l_returnflag").alias("flag"), c("l_linestatus").alias("arm"), "l_quantity", "l_extendedprice")
    of = lambda col, name: U.exact_median(t, ["flag", "arm"], col).withColumnRenamed("median", name)
    return of("l_quantity", "quantity").join(of("l_extendedprice", "price"), ["flag", "arm"])


@query(f"WITH {_ARMS}, g AS (SELECT workload, sum(metric::DECIMAL(18, 2)) FILTER (arm = 'F') b, sum(metric::DECIMAL(18, 2)) FILTER (arm = 'O' AND workload <> 3) k FROM m GROUP BY 1) SELECT workload, CASE WHEN b <> 0 THEN (b::DOUBLE - k::DOUBLE) / b::DOUBLE * 100 END AS saving FROM g")
def s150_percent_saving(spark: SparkSession, root: str) -> DataFrame:
    """Percent saved by one arm against the other; null where the other has nothing or one is missing."""
    m = table(spark, root, "lineitem", "l_suppkey", "l_linestatus", "l_extendedprice").select((c("l_suppkey") % 10).alias("workload"), c("l_linestatus").alias("arm"), c("l_extendedprice").cast("decimal(18,2)").alias("metric"))
    g = m.groupBy("workload").agg(F.sum(F.when(c("arm") == "F", c("metric"))).cast("double").alias("b"), F.sum(F.when((c("arm") == "O") & (c("workload") != 3), c("metric"))).cast("double").alias("k"))
    return g.select("workload", saving(c("b"), c("k")).alias("saving"))


_CLASS = "CASE command WHEN 'view' THEN 'read' WHEN 'click' THEN 'navigate' WHEN 'signup' THEN 'search' WHEN 'purchase' THEN 'graph' ELSE 'other' END"


@query(f"WITH {_EV} SELECT {_CLASS} AS class, count(*) AS calls, sum(with_tokens * 4)::BIGINT AS bytes FROM ev WHERE with_tokens > 0 GROUP BY 1 HAVING count(*) > 0")
def s152_contribution(spark: SparkSession, root: str) -> DataFrame:
    """Completed calls and bytes by class of tool; classes without any are left out."""
    k = F.when(c("command") == "view", "read").when(c("command") == "click", "navigate").when(c("command") == "signup", "search").when(c("command") == "purchase", "graph").otherwise("other")
    return calls(spark, root).where("with_tokens > 0").groupBy(k.alias("class")).agg(F.count(F.lit(1)).alias("calls"), F.sum(c("with_tokens") * 4).alias("bytes"))


@query(f"""WITH {_EV}, d AS (SELECT session, tick // 86400 AS day, count(*) n, sum(without_tokens) w FROM ev GROUP BY 1, 2), r AS (SELECT session, count(*) n, sum(without_tokens) w FROM ev GROUP BY 1)
SELECT r.session, r.n = sum(d.n) AND abs(r.w - sum(d.w)) <= 1e-6 * greatest(abs(r.w), 1) AS agrees FROM r JOIN d USING (session) GROUP BY r.session, r.n, r.w""")
def s153_group_validation(spark: SparkSession, root: str) -> DataFrame:
    """Whether declared sums of groups agree with those recomputed from their parts, within a millionth."""
    e = calls(spark, root)
    d = e.groupBy("session", U.day_floor(c("at")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("without_tokens").alias("w")).groupBy("session").agg(F.sum("n").alias("n2"), F.sum("w").alias("w2"))
    r = e.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum("without_tokens").alias("w"))
    near = F.abs(c("w") - c("w2")) <= 1e-6 * F.greatest(F.abs("w"), F.lit(1))
    return r.join(d, "session").select("session", ((c("n") == c("n2")) & near).alias("agrees"))


@query(f"""WITH {_HEALTH}, {TEXTS}, {ENTITIES}, {RELATIONS}, a AS (SELECT pid, 'texts' AS what FROM txt UNION ALL SELECT pid, 'symbols' FROM ent WHERE kind = 'symbol' UNION ALL SELECT pid, 'relations' FROM rel UNION ALL SELECT pid, 'findings' FROM finding)
SELECT pid, count(*) FILTER (what = 'texts') AS texts, count(*) FILTER (what = 'symbols') AS symbols, count(*) FILTER (what = 'relations') AS relations, count(*) FILTER (what = 'findings') AS findings FROM a GROUP BY 1""")
def s155_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Texts, symbols, relations and findings of each repository, counted by source before they are brought together."""
    parts = {"texts": latest_states(spark, root), "symbols": entities(spark, root).where("kind = 'symbol'"), "relations": relations(spark, root), "findings": health_findings(purposes(spark, root))}
    out = None
    for name, df in parts.items():
        n = df.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out.groupBy("pid").agg(*(F.coalesce(F.sum(F.when(c("what") == x, c("n"))), F.lit(0)).alias(x) for x in parts))


@query(f"""WITH {_HEALTH}, {ENTITIES}, totals AS (SELECT (SELECT count(*) FROM node WHERE kind = 'folder' AND content_hash IS NOT NULL) hashed_folders, (SELECT count(*) FROM ent WHERE kind = 'file') entities, (SELECT count(*) FROM finding WHERE category = 'missing_purpose') missing, (SELECT count(*) FROM purpose WHERE status = 'missing') unset)
SELECT unnest(['folders_have_no_hash', 'files_have_entities', 'missing_agrees']) AS "check", unnest([hashed_folders = 0, entities > 0, missing = unset]) AS passed FROM totals""")
def s154_parity(spark: SparkSession, root: str) -> DataFrame:
    """Checks over counts that must agree."""
    p = purposes(spark, root)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    from treeline.plans.index_tables import nodes

    n = one(nodes(spark, root).where("kind = 'folder' AND content_hash IS NOT NULL"), "hashed_folders")
    for df, name in ((entities(spark, root).where("kind = 'file'"), "entities"), (health_findings(p).where("category = 'missing_purpose'"), "missing"), (p.where("status = 'missing'"), "unset")):
        n = n.join(one(df, name), F.lit(True))  # one row each
    checks = {"folders_have_no_hash": c("hashed_folders") == 0, "files_have_entities": c("entities") > 0, "missing_agrees": c("missing") == c("unset")}
    return n.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()))).alias("s")).select("s.*")


@query(f"WITH {_EV}, m AS (SELECT max(tick) t FROM ev) SELECT count(*) AS events, sum(64 + strlen(command) + coalesce(strlen(fingerprint), 0))::BIGINT AS bytes, count(*) FILTER (tick < t - 20 * 86400) AS old FROM ev, m")
def s156_retention_pressure(spark: SparkSession, root: str) -> DataFrame:
    """Rows, bytes and rows past their age: whether a prune is due."""
    e = calls(spark, root)
    now = e.agg(F.max("at")).first()[0] or 0
    return e.agg(F.count(F.lit(1)).alias("events"), F.sum(F.lit(64) + F.octet_length("command") + F.coalesce(F.octet_length("fingerprint"), F.lit(0))).cast("bigint").alias("bytes"), F.count_if(c("at") < now - 20 * U.DAY).alias("old"))


@query(f"WITH {_EV}, stored AS (SELECT session, count(*) n FROM ev WHERE event_id % 1000 <> 7 GROUP BY 1), actual AS (SELECT session, count(*) n FROM ev GROUP BY 1) SELECT session, coalesce(stored.n, 0) AS stored, actual.n AS actual, actual.n - coalesce(stored.n, 0) AS correction FROM actual LEFT JOIN stored USING (session) WHERE actual.n <> coalesce(stored.n, 0)")
def s157_reconcile(spark: SparkSession, root: str) -> DataFrame:
    """Counters that disagree with the rows they count (here: that missed every thousandth event), with their correction."""
    e = calls(spark, root)
    g = e.groupBy("session").agg(F.count_if(c("event_id") % 1000 != 7).alias("stored"), F.count(F.lit(1)).alias("actual"))
    return g.where("stored <> actual").select("session", "stored", "actual", (c("actual") - c("stored")).alias("correction"))


@query(f"WITH {_EV}, i AS (SELECT session, max(tick) last FROM ev GROUP BY 1), k AS (SELECT session, last, row_number() OVER (ORDER BY last DESC, session DESC) n, (SELECT max(tick) FROM ev) m FROM i) SELECT session, CASE WHEN last < m - 86400 THEN 'expired' ELSE 'active' END AS state, last >= m - 90 * 86400 AND n <= 100 AS keep FROM k")
def s185_instance_prune(spark: SparkSession, root: str) -> DataFrame:
    """Sessions idle for a day are expired; beyond a hundred, and past 90 days, the oldest go."""
    e = calls(spark, root)
    now = e.agg(F.max("at")).first()[0] or 0
    i = e.groupBy("session").agg(F.max("at").alias("at")).select("session", "at", c("session").alias("event_id"), F.lit(1).alias("bytes"))
    p = U.prune_plan(i, now, 90 * U.DAY, 100, 1 << 60)
    return p.select("session", F.when(c("at") < now - U.DAY, "expired").otherwise("active").alias("state"), "keep")


@query(f"WITH {_EV}, i AS (SELECT fingerprint, max(tick) last, max(event_id) e FROM ev GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY last DESC, e DESC) n FROM i) SELECT fingerprint, n <= 40 AS keep FROM k")
def s186_label_prune(spark: SparkSession, root: str) -> DataFrame:
    """The forty labels used last are kept."""
    i = calls(spark, root).groupBy("fingerprint").agg(F.max("at").alias("at"), F.max("event_id").alias("event_id")).withColumn("bytes", F.lit(1))
    return U.prune_plan(i, 0, 1 << 60, 40, 1 << 60).select("fingerprint", "keep")


@query(f"WITH {_EV}, d AS (SELECT session, tick // 86400 * 86400 AS day, count(*) calls FROM ev GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (ORDER BY day DESC, session DESC) n FROM d) SELECT session, day, calls FROM k WHERE n > 1000")
def s187_capacity(spark: SparkSession, root: str) -> DataFrame:
    """Daily rows that must go before new ones are written, so that a thousand are left."""
    d = calls(spark, root).groupBy("session", U.day_floor(c("at")).alias("at")).agg(F.count(F.lit(1)).alias("calls"))
    p = U.prune_plan(d.withColumn("event_id", c("session")).withColumn("bytes", F.lit(1)), 0, 1 << 60, 1000, 1 << 60)
    return p.where("NOT keep").select("session", c("at").alias("day"), "calls")


@query(f"WITH {_EV}, a AS (SELECT session, count(*) n, sum(without_tokens) w FROM ev WHERE event_id < 6000 GROUP BY 1), b AS (SELECT session, count(*) n, sum(without_tokens) w FROM ev WHERE event_id >= 3000 GROUP BY 1) SELECT session, coalesce(b.n, 0) >= a.n AND coalesce(b.w, 0) >= a.w AS grew FROM a LEFT JOIN b USING (session)")
def s199_monotone(spark: SparkSession, root: str) -> DataFrame:
    """Whether every counter of a later aggregate is at least what was accepted before."""
    e = calls(spark, root)
    agg = lambda df: df.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum("without_tokens").alias("w"))
    return grown(agg(e.where("event_id < 6000")), agg(e.where("event_id >= 3000")), ["session"], ["n", "w"])


def grown(accepted: DataFrame, offered: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """(keys, grew) of the accepted rows: whether the offered ones hold them with no counter less."""
    new = offered.select(*keys, *(c(x).alias(f"_{x}") for x in counters))
    ok = F.lit(True)
    for x in counters:
        ok = ok & (F.coalesce(c(f"_{x}"), F.lit(0)) >= c(x))
    return accepted.join(new, keys, "left").select(*keys, ok.alias("grew"))


@query(f"""WITH {_EV}, a AS (SELECT session, max(event_id) rev, count(*) n FROM ev WHERE event_id < 6000 GROUP BY 1), b AS (SELECT session, max(event_id) rev, count(*) n FROM ev WHERE event_id >= 3000 GROUP BY 1)
SELECT session, CASE WHEN b.rev > coalesce(a.rev, -1) AND b.n >= coalesce(a.n, 0) THEN b.n ELSE a.n END AS calls, CASE WHEN b.rev > coalesce(a.rev, -1) AND b.n >= coalesce(a.n, 0) THEN b.rev ELSE a.rev END AS revision FROM a FULL JOIN b USING (session)""")
def s200_replace_aggregates(spark: SparkSession, root: str) -> DataFrame:
    """An offered aggregate takes the place of the accepted one only if it is newer and did not shrink."""
    e = calls(spark, root)
    agg = lambda df, p: df.groupBy("session").agg(F.max("event_id").alias(f"{p}rev"), F.count(F.lit(1)).alias(f"{p}n"))
    both = agg(e.where("event_id < 6000"), "a").join(agg(e.where("event_id >= 3000"), "b"), "session", "full")
    take = F.coalesce((c("brev") > F.coalesce("arev", F.lit(-1))) & (c("bn") >= F.coalesce("an", F.lit(0))), F.lit(False))
    return both.select("session", F.when(take, c("bn")).otherwise(c("an")).alias("calls"), F.when(take, c("brev")).otherwise(c("arev")).alias("revision"))


@query(f"WITH {_EV}, k AS (SELECT event_id, session, tick - CASE WHEN event_id % 97 = 0 THEN 0 ELSE event_id % 97 * 60 END AS clock FROM ev), p AS (SELECT *, max(clock) OVER (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) seen FROM k) SELECT event_id, greatest(clock, seen) AS last_seen, coalesce(seen > clock + 300, false) AS clock_anomaly FROM p")
def s323_clocks(spark: SparkSession, root: str) -> DataFrame:
    """Clocks that run behind what was seen before: nothing is dropped, last_seen never goes back, a lag of over five minutes is marked."""
    e = calls(spark, root).select("event_id", "session", (c("at") - F.when(c("event_id") % 97 == 0, 0).otherwise(c("event_id") % 97 * 60)).alias("clock"))
    return U.greatest_before(e, "session", "event_id", "clock").select("event_id", F.greatest("clock", "before").alias("last_seen"), F.coalesce(c("before") > c("clock") + U.FUTURE, F.lit(False)).alias("clock_anomaly"))


@query(f"WITH {_EV}, s AS (SELECT session, max(tick) last FROM ev GROUP BY 1), b AS (SELECT session, count(DISTINCT fingerprint) n FROM ev GROUP BY 1) SELECT session, CASE WHEN last < (SELECT max(tick) FROM ev) - 3600 THEN 'sealed' ELSE 'active' END AS state, CASE WHEN last < (SELECT max(tick) FROM ev) - 3600 THEN 0 ELSE n END AS baselines FROM s JOIN b USING (session)")
def s325_seal(spark: SparkSession, root: str) -> DataFrame:
    """Sessions unseen for an hour are sealed and keep no baselines."""
    e = calls(spark, root)
    now = e.agg(F.max("at")).first()[0] or 0
    g = e.groupBy("session").agg(F.max("at").alias("last"), F.count_distinct("fingerprint").alias("n"))
    sealed = c("last") < now - 3600
    return g.select("session", F.when(sealed, "sealed").otherwise("active").alias("state"), F.when(sealed, 0).otherwise(c("n")).cast("bigint").alias("baselines"))


@query(f"WITH {_EV} SELECT session, tick // 86400 * 86400 AS day, count(*) AS calls, max(event_id) AS revision FROM ev GROUP BY 1, 2 HAVING max(event_id) > 8000")
def s327_changed_aggregates(spark: SparkSession, root: str) -> DataFrame:
    """Daily rows whose revision is past the one acknowledged: what a synchronization sends."""
    d = calls(spark, root).groupBy("session", U.day_floor(c("at")).alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.max("event_id").alias("revision"))
    return d.where("revision > 8000")
