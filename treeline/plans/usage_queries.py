"""Queries of usage accounting over the event table.

An event is a call: its type the command, its user the session, its value the tokens that reading whole
files would have cost, a tenth of it those spent; props stand for the baseline's fingerprint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.text import framed
from treeline.operators import usage as U
from treeline.plans.registry import query
from treeline.sources.tables import table

c = F.col

_EV = """ev AS (SELECT event_id, ts, floor(epoch(ts))::BIGINT AS tick, user_id AS session, event_type AS command, floor(value)::BIGINT AS without_tokens, floor(value / 10)::BIGINT AS with_tokens, props AS fingerprint,
  CASE WHEN event_type = 'error' THEN 'event' ELSE 'session' END AS scope, CASE WHEN event_id % 3 = 0 THEN 'observed_delta' ELSE 'modeled_avoidance' END AS layer, CASE WHEN event_type = 'view' THEN 'full_file_compression' ELSE 'lookup' END AS bucket,
  CASE WHEN event_id % 5 = 0 THEN 'observed' ELSE 'estimated' END AS confidence FROM events)"""


def calls(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    return e.select(
        "event_id", "ts", F.floor(F.unix_micros(c("ts").cast("timestamp")) / 1_000_000).alias("at"), c("user_id").alias("session"), c("event_type").alias("command"), F.floor("value").cast("bigint").alias("without_tokens"),
        F.floor(c("value") / 10).cast("bigint").alias("with_tokens"), c("props").alias("fingerprint"), F.when(c("event_type") == "error", "event").otherwise("session").alias("scope"),
        F.when(c("event_id") % 3 == 0, "observed_delta").otherwise("modeled_avoidance").alias("layer"), F.when(c("event_type") == "view", "full_file_compression").otherwise("lookup").alias("bucket"),
        F.when(c("event_id") % 5 == 0, "observed").otherwise("estimated").alias("confidence"), c("event_type").alias("identity"),
    )


_RATE = "w - s AS saved, CASE WHEN w <> 0 THEN (w - s) / w END AS rate"


@query(f"WITH {_EV} SELECT command, layer, calls, w AS without_tokens, s AS with_tokens, {_RATE} FROM (SELECT command, layer, count(*) AS calls, sum(without_tokens)::BIGINT w, sum(with_tokens)::BIGINT s FROM ev WHERE without_tokens IS NOT NULL AND with_tokens IS NOT NULL GROUP BY 1, 2)")
def s116_buckets(spark: SparkSession, root: str) -> DataFrame:
    return U.bucket_totals(calls(spark, root), ["command", "layer"])


@query(f"WITH {_EV}, f AS (SELECT *, layer = 'observed_delta' OR bucket = 'full_file_compression' OR confidence = 'observed' o FROM ev) SELECT count(*) FILTER (o) AS observed, count(*) FILTER (layer = 'modeled_avoidance' OR NOT o) AS modeled, count(*) FILTER (o AND layer = 'modeled_avoidance') AS both_ways FROM f")
def s066_observed_modeled(spark: SparkSession, root: str) -> DataFrame:
    o, m = (f(c("layer"), c("bucket"), c("confidence")) for f in (U.observed, U.modeled))
    return calls(spark, root).agg(F.count_if(o).alias("observed"), F.count_if(m).alias("modeled"), F.count_if(o & m).alias("both_ways"))


@query(f"WITH {_EV} SELECT w AS without_tokens, s AS with_tokens, calls, {_RATE} FROM (SELECT count(*) AS calls, sum(without_tokens)::BIGINT w, sum(with_tokens)::BIGINT s FROM ev)")
def s117_totals(spark: SparkSession, root: str) -> DataFrame:
    return U.bucket_totals(calls(spark, root), []).select("without_tokens", "with_tokens", "calls", "saved", "rate")


@query(f"""WITH {_EV}, k AS (SELECT command, session, fingerprint, CASE WHEN scope = 'event' THEN event_id END alone, max(without_tokens) w, sum(with_tokens) s, count(*) n FROM ev GROUP BY ALL)
SELECT command, sum(w)::BIGINT AS baseline, sum(s)::BIGINT AS spent, sum(w - s)::BIGINT AS saved, sum(n - 1)::BIGINT AS repeats, sum(n)::BIGINT AS calls FROM k GROUP BY 1""")
def s118_session_dedup(spark: SparkSession, root: str) -> DataFrame:
    return U.session_accounting(calls(spark, root), ["command"])


@query(f"WITH {_EV} SELECT command, CASE WHEN command = 'view' THEN sum(without_tokens)::BIGINT // 2 ELSE sum(without_tokens)::BIGINT END AS baseline, sum(with_tokens)::BIGINT AS spent FROM ev GROUP BY 1")
def s119_average_policy(spark: SparkSession, root: str) -> DataFrame:
    """Walks over folders count half of their baseline, halved once on the sum."""
    g = calls(spark, root).groupBy("command").agg(F.sum("without_tokens").alias("w"), F.sum("with_tokens").alias("spent"))
    return g.select("command", F.when(c("command") == "view", F.floor(c("w") / 2).cast("bigint")).otherwise(c("w")).alias("baseline"), "spent")


def _trend(window: str, label_sql: str):
    @query(f"WITH {_EV} SELECT period, command, calls, w AS without_tokens, s AS with_tokens, {_RATE} FROM (SELECT {label_sql} AS period, command, count(*) AS calls, sum(without_tokens)::BIGINT w, sum(with_tokens)::BIGINT s FROM ev GROUP BY 1, 2)", name=f"s125_trend_{window}")
    def trend(spark: SparkSession, root: str) -> DataFrame:
        return U.bucket_totals(calls(spark, root).withColumn("period", U.period_label(c("ts"), window)), ["period", "command"])

    return trend


for _w, _l in (("day", "strftime(ts, '%Y-%m-%d')"), ("week", "strftime(ts, '%Y-W%W')"), ("month", "strftime(ts, '%Y-%m')"), ("year", "strftime(ts, '%Y')")):
    _trend(_w, _l)


@query(f"WITH {_EV} SELECT tick // 86400 * 86400 AS day, session, count(*) AS calls, sum(without_tokens)::BIGINT AS without_tokens FROM ev GROUP BY 1, 2")
def s122_daily(spark: SparkSession, root: str) -> DataFrame:
    """Daily aggregates of each session."""
    return calls(spark, root).groupBy(U.day_floor(c("at")).alias("day"), "session").agg(F.count(F.lit(1)).alias("calls"), F.sum("without_tokens").alias("without_tokens"))


@query(f"WITH {_EV}, g AS (SELECT session, tick // 86400 * 86400 AS day, command, count(*) n FROM ev GROUP BY 1, 2, 3) SELECT session, day, command, n FROM g UNION ALL SELECT session, -1, command, sum(n)::BIGINT FROM g GROUP BY 1, 3")
def s194_lifetime_and_days(spark: SparkSession, root: str) -> DataFrame:
    """Daily rows and, as day -1, lifetime rows."""
    g = calls(spark, root).groupBy("session", U.day_floor(c("at")).alias("day"), "command").agg(F.count(F.lit(1)).alias("n"))
    return g.unionByName(g.groupBy("session", "command").agg(F.sum("n").alias("n")).withColumn("day", F.lit(-1).cast("bigint")))


@query(f"""WITH {_EV}, g AS (SELECT *, CASE WHEN tick - lag(tick) OVER w >= 86400 THEN 1 WHEN lag(tick) OVER w IS NULL THEN 1 ELSE 0 END b FROM ev WINDOW w AS (PARTITION BY session ORDER BY tick, event_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY session ORDER BY tick, event_id) run FROM g) SELECT session AS owner, min(tick) AS started, max(tick) AS last_seen, count(*) AS events FROM r GROUP BY session, run""")
def s322_instances(spark: SparkSession, root: str) -> DataFrame:
    """Instances of each session: a pause of a day ends one."""
    return U.instances(calls(spark, root).withColumnRenamed("session", "owner"))


@query(f"""WITH {_EV}, r AS (SELECT event_id, tick, 40 + length(command) + length(coalesce(fingerprint, '')) bytes FROM ev), w AS (SELECT *, row_number() OVER (ORDER BY tick DESC, event_id DESC) n, sum(bytes) OVER (ORDER BY tick DESC, event_id DESC) b, (SELECT max(tick) FROM r) m FROM r)
SELECT event_id, tick >= m - 20 * 86400 AND n <= 5000 AND b <= 250000 AS keep FROM w""")
def s183_raw_prune(spark: SparkSession, root: str) -> DataFrame:
    """Which raw events a retention of 20 days, 5000 rows and 250,000 bytes keeps."""
    e = calls(spark, root).select("event_id", "at", (F.lit(40) + F.char_length("command") + F.char_length(F.coalesce("fingerprint", F.lit("")))).alias("bytes"))
    now = e.agg(F.max("at")).first()[0] or 0
    return U.prune_plan(e, now, 20 * U.DAY, 5_000, 250_000).select("event_id", "keep")


@query(f"""WITH {_EV}, f AS (SELECT command, fingerprint, layer, min((tick, event_id)) f FROM ev GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY command ORDER BY f, fingerprint) n FROM f),
e AS (SELECT ev.command, CASE WHEN n <= 30 THEN ev.fingerprint ELSE '<overflow>:' || ev.layer END AS dimension FROM ev JOIN d ON ev.command = d.command AND ev.fingerprint = d.fingerprint AND ev.layer = d.layer) SELECT command, dimension, count(*) AS calls FROM e GROUP BY 1, 2""")
def s324_overflow(spark: SparkSession, root: str) -> DataFrame:
    """Dimensions beyond thirty of a command share an overflow row of their kind."""
    return U.bounded_dimensions(calls(spark, root), "command", "fingerprint", "layer", 30).groupBy("command", "dimension").agg(F.count(F.lit(1)).alias("calls"))


@query(f"WITH {_EV} SELECT event_id, 'modeled:command=' || command || ':path=*:query=' || coalesce(fingerprint, '*') AS identity, sha256(length(command)::VARCHAR || ':' || command || ';' || CASE WHEN fingerprint IS NULL THEN '-;' ELSE length(fingerprint)::VARCHAR || ':' || fingerprint || ';' END) AS key FROM ev")
def s234_baseline_key(spark: SparkSession, root: str) -> DataFrame:
    ident = F.concat(F.lit("modeled:command="), "command", F.lit(":path=*:query="), F.coalesce("fingerprint", F.lit("*")))
    return calls(spark, root).select("event_id", ident.alias("identity"), F.sha2(framed(c("command"), c("fingerprint")), 256).alias("key"))


@query(f"WITH {_EV}, d AS (SELECT session, tick // 86400 d, count(*) n FROM ev GROUP BY 1, 2) SELECT session, min(d) * 86400 AS first_day, max(d) * 86400 AS last_day, count(*) AS days, CASE WHEN count(*) = max(d) - min(d) + 1 THEN 'retained' ELSE 'partial' END AS detail FROM d GROUP BY 1")
def s128_availability(spark: SparkSession, root: str) -> DataFrame:
    """Whether a session has events on every day of its span."""
    d = calls(spark, root).groupBy("session", U.day_floor(c("at")).alias("d")).count()
    span = F.max("d") / U.DAY - F.min("d") / U.DAY + 1
    return d.groupBy("session").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("days"), F.when(F.count(F.lit(1)) == span, "retained").otherwise("partial").alias("detail"))


# ---------------------------------------------------------------- comparing two arms of measurements

_ARMS = "m AS (SELECT l_suppkey % 10 AS workload, l_linestatus AS arm, l_extendedprice AS metric FROM lineitem)"


def saving(base, cand):
    """Percent saved, null when the base is 0 or missing."""
    return F.when(base != 0, (base - cand) / base * 100)


@query(f"""WITH {_ARMS}, g AS (SELECT workload, median(metric) FILTER (arm = 'F') AS baseline, median(metric) FILTER (arm = 'O') AS candidate, max(metric) FILTER (arm = 'F') AS baseline_max, max(metric) FILTER (arm = 'O') AS candidate_max FROM m GROUP BY 1)
SELECT *, (baseline - candidate) / baseline * 100 AS saving FROM g""")
def s148_medians(spark: SparkSession, root: str) -> DataFrame:
    """Median and maximum of both arms per workload, and the saving."""
    m = table(spark, root, "lineitem", "l_suppkey", "l_linestatus", "l_extendedprice").select((c("l_suppkey") % 10).alias("workload"), c("l_linestatus").alias("arm"), c("l_extendedprice").alias("metric"))
    most = m.groupBy("workload").agg(*(F.max(F.when(c("arm") == a, c("metric"))).alias(f"{n}_max") for a, n in (("F", "baseline"), ("O", "candidate"))))
    mid = U.exact_median(m, ["workload", "arm"], "metric").groupBy("workload").agg(*(F.max(F.when(c("arm") == a, c("median"))).alias(n) for a, n in (("F", "baseline"), ("O", "candidate"))))
    return most.join(mid, "workload").withColumn("saving", saving(c("baseline"), c("candidate")))


@query("""WITH g AS (SELECT l_suppkey % 10 AS workload, sum(l_tax) FILTER (l_linestatus = 'O') - sum(l_tax) FILTER (l_linestatus = 'F') AS setup, sum(l_discount) FILTER (l_linestatus = 'F') / count(*) - sum(l_discount) FILTER (l_linestatus = 'O') / count(*) AS warm FROM lineitem GROUP BY 1)
SELECT workload, CASE WHEN setup <= 0 THEN 0 WHEN warm <= 0 THEN NULL ELSE ceil(round(setup / warm, 6))::BIGINT END AS tasks FROM g""")
def s151_break_even(spark: SparkSession, root: str) -> DataFrame:
    """Tasks after which a dearer setup pays; 0 if it isn't dearer, null if it never pays."""
    t = table(spark, root, "lineitem", "l_suppkey", "l_linestatus", "l_tax", "l_discount")
    of = lambda col, a: F.sum(F.when(c("l_linestatus") == a, c(col)))
    g = t.groupBy((c("l_suppkey") % 10).alias("workload")).agg((of("l_tax", "O") - of("l_tax", "F")).alias("setup"), ((of("l_discount", "F") - of("l_discount", "O")) / F.count(F.lit(1))).alias("warm"))
    return g.select("workload", F.when(c("setup") <= 0, F.lit(0)).when(c("warm") <= 0, F.lit(None)).otherwise(F.ceil(F.round(c("setup") / c("warm"), 6))).cast("bigint").alias("tasks"))
